"""Test sets and workloads: grids of cells, random loads, sampled predicates and lines, scans from a log run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def letters(c: Column, seed: str) -> Column:
    """Ten letters from a to p that hang on a value and a seed alone."""
    return F.translate(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string"))), 1, 10), "0123456789abcdef", "abcdefghijklmnop")


def grid(spark: SparkSession, n: int, seed: str = "grid") -> DataFrame:
    """About n cells of a square of rows and columns with names of ten letters, one time, and short values."""
    side = int(n**0.5)
    at = spark.range(side * side)
    row, column = F.floor(F.col("id") / side), F.col("id") % side
    return at.select(letters(row, f"{seed}-row").alias("row"), letters(column, f"{seed}-column").alias("column"), F.lit(0).cast("long").alias("ts"), F.concat(F.lit("v"), (F.col("id") % 1000).cast("string")).alias("value"))


def chance(seed: str, *columns: str) -> Column:
    """A value's own number in [0, 1), in steps of 2^-32: alike in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns))), 1, 8), 16, 10).cast("long") / (1 << 32)


def reload(cells: DataFrame, load_rate: float, sync_rate: float = 0.0, seed: str = "reload") -> DataFrame:
    """The cells that a reload takes, each with the chance `load_rate`, and `sync`: whether it is synced then."""
    taken = cells.filter(chance(seed, "row", "column", "ts") < load_rate)
    return taken.withColumn("sync", chance(f"{seed}-sync", "row", "column", "ts") < sync_rate)


def random_predicates(cells: DataFrame, n: int, seed: str = "scan") -> DataFrame:
    """(predicate): n scans of sampled rows, columns or families, by turns; rows stand for themselves as often as they have cells."""
    from .cells import family

    picked = cells.select("row", "column", F.md5(F.concat_ws("|", F.lit(seed), "row", "column", F.col("ts").cast("string"))).alias("h")).orderBy("h", "row", "column").limit(n)
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    turn = F.instr(F.lit("0123456789abcdef"), F.substring("h", 9, 1)) % 3
    text = F.when(turn == 0, F.concat(F.lit("row = "), quoted(F.col("row")))).when(turn == 1, F.concat(F.lit("column = "), quoted(F.col("column"))))
    return picked.select(text.otherwise(F.concat(F.lit("column ~= "), quoted(F.concat(family(F.col("column")), F.lit(":"))))).alias("predicate"))


def sample_lines(lines: DataFrame, n: int, order: str, seed: str = "lines", value: str = "value") -> DataFrame:
    """n lines as random byte offsets pick them: a line's chance goes by the length of the one before it (the first: by one byte).

    Draws are without replacement: each line's key is u to the power of one over its weight, the n greatest stay.
    """
    from .streams import previous

    before = previous(lines, [value], order)
    weight = F.coalesce(F.octet_length(F.col("__prev")[value]) + 1, F.lit(1))
    key = F.log((chance(seed, order) * (1 << 32) + 1) / ((1 << 32) + 1)) / weight
    return before.withColumn("__key", key).orderBy(F.col("__key").desc(), order).limit(n).drop("__key", "__prev")


def scan_jobs(lines: DataFrame, value: str = "value") -> DataFrame:
    """(table, predicate) of the scans in a server's log, whose lines have table=... and pred=(...)."""
    form = r"table=(\S+) pred=\((.*)\)"
    return lines.filter(F.col(value).rlike(form)).select(F.regexp_extract(value, form, 1).alias("table"), F.regexp_extract(value, form, 2).alias("predicate"))


def replay(spark: SparkSession, jobs: DataFrame, scan: Callable[[str, str], DataFrame], threads: int = 4) -> DataFrame:
    """(table, predicate, runs, cells): each distinct scan of a log run again, so many at a time."""
    from concurrent.futures import ThreadPoolExecutor

    todo = jobs.groupBy("table", "predicate").agg(F.count(F.lit(1)).alias("runs")).orderBy("table", "predicate").collect()
    with ThreadPoolExecutor(threads) as pool:
        counts = list(pool.map(lambda j: scan(j["table"], j["predicate"]).count(), todo))
    return spark.createDataFrame([(j["table"], j["predicate"], j["runs"], n) for j, n in zip(todo, counts, strict=True)], "table string, predicate string, runs long, cells long")
