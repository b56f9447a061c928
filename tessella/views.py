"""The driver's tables as cells, in Spark and, word for word, in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    """Of a timestamp without zone, read as UTC whatever the zone of the session is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("user-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("row"),
        F.concat(F.lit("ev:"), F.col("event_type")).alias("column"),
        micros("ts").alias("ts"),
        F.round(F.col("value") * 100).cast("long").cast("string").alias("value"),
    )


def evlog(spark: SparkSession, d: str) -> DataFrame:
    """Writes numbered by event, times coarsened to days so that keys repeat, every seventh an erasure."""
    e = table(spark, d, "events")
    day = 86_400_000_000
    t = micros("ts")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("user-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("row"),
        F.concat(F.lit("ev:"), F.col("event_type")).alias("column"),
        (t - F.pmod(t, F.lit(day))).alias("ts"),
        F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") * 100).cast("long").cast("string")).alias("value"),
    )


def od(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    cells = F.array(
        F.struct(F.lit("meta:status").alias("column"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("meta:priority").alias("column"), F.col("o_orderpriority").alias("value")),
        F.struct(F.lit("amt:cents").alias("column"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("value")),
    )
    each = o.select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("row"), micros("o_orderdate").alias("ts"), F.explode(cells).alias("c"))
    return each.select("row", "c.column", "ts", "c.value")


EV = """select 'user-' || lpad(user_id::varchar, 6, '0') as "row", 'ev:' || event_type as "column", epoch_us(ts) as ts,
round(value * 100)::bigint::varchar as value from events"""
EVLOG = """select event_id as seq, 'user-' || lpad(user_id::varchar, 6, '0') as "row", 'ev:' || event_type as "column",
epoch_us(ts) - epoch_us(ts) % 86400000000 as ts, case when event_id % 7 <> 0 then round(value * 100)::bigint::varchar end as value from events"""
OD = """select lpad(o_orderkey::varchar, 10, '0') as "row", c."column", epoch_us(o_orderdate) as ts, c.value from (
select o_orderkey, o_orderdate, unnest([{'column': 'meta:status', 'value': o_orderstatus}, {'column': 'meta:priority', 'value': o_orderpriority},
{'column': 'amt:cents', 'value': round(o_totalprice * 100)::bigint::varchar}]) as c from orders)"""
