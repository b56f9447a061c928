"""Counts, sizes, samples and estimates over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import cell_size, family


def cell_stats(cells: DataFrame) -> DataFrame:
    """One row: cells and their bytes."""
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum(cell_size()), F.lit(0)).alias("bytes"))


def table_stats(cells: DataFrame, table: str = "table") -> DataFrame:
    """Cells and bytes of each table and, with a null name, of all of them."""
    return cells.rollup(table).agg(F.count(F.lit(1)).alias("cells"), F.sum(cell_size()).alias("bytes"))


def family_stats(cells: DataFrame) -> DataFrame:
    return cells.groupBy(family(F.col("column")).alias("family")).agg(F.count(F.lit(1)).alias("cells"), F.sum(cell_size()).alias("bytes"))


def profile(cells: DataFrame, exact: bool = False) -> DataFrame:
    """One row: cells, distinct rows and columns (a sketch, unless exact), bytes of rows, columns and values."""
    count = F.count_distinct if exact else F.approx_count_distinct
    return cells.agg(
        F.count(F.lit(1)).alias("cells"),
        count("row").alias("rows"),
        count("column").alias("columns"),
        F.sum(F.octet_length("row")).alias("row_bytes"),
        F.sum(F.octet_length("column")).alias("column_bytes"),
        F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).alias("value_bytes"),
    )


def extrapolate(totals: Column, remaining: Column) -> Column:
    """An estimate of a sum from what the first intervals of a scan came to (an array), and how many remain.

    The mean per interval moves as (a d + x) / (a + 1) in whole numbers, with a the intervals so far, up to ten.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("mean"), F.lit(0).cast("long").alias("total"))

    def step(s: Column, x: Column) -> Column:
        a = F.least(s["n"], F.lit(10))
        mean = F.floor((a * s["mean"] + x) / (a + 1)).cast("long")
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["total"] + x).cast("long").alias("total"))

    return F.aggregate(totals, start, step, lambda s: s["total"] + s["mean"] * remaining)


def chance(key: list[Column], rate: float, seed: int) -> Column:
    """Whether a key is in a sample of this rate: by a hash, so that the same keys come each time."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 31)) < int(rate * (1 << 31))


def sample_cells(cells: DataFrame, row_rate: float, cell_rate: float, interval_rate: float = 1.0, interval: Column | None = None, seed: int = 0) -> DataFrame:
    """Rows of some intervals, of these some rows, of these some cells; any rate of 0 or less leaves nothing."""
    if min(row_rate, cell_rate, interval_rate) <= 0:
        return cells.limit(0)
    by = F.substring("row", 1, 6) if interval is None else interval
    return cells.filter(chance([by], interval_rate, seed) & chance([F.col("row")], row_rate, seed + 1) & chance([F.col("row"), F.col("column"), F.col("ts")], cell_rate, seed + 2))


def reservoir(df: DataFrame, k: int, key: list[str], seed: int = 0) -> DataFrame:
    """k rows, each set of keys as likely as any other: those with the least hashes.  It doesn't depend on partitions."""
    if k <= 0:
        raise ValueError("k has to be 1 at least")
    return df.withColumn("__h", F.xxhash64(F.lit(seed), *key)).orderBy("__h", *key).limit(k).drop("__h")


def distinct_reservoir(df: DataFrame, k: int, column: str, seed: int = 0) -> DataFrame:
    """k distinct values."""
    return reservoir(df.select(column).distinct(), k, [column], seed)
