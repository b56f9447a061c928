"""The cell model: (row, column, ts, value), a null value being an erasure; last writer wins; version history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["row", "column", "ts"]
CELL = "row string, column string, ts long, value string"
LOG = f"seq long, {CELL}"


def family(column: Column) -> Column:
    """What stands before the first colon; empty without one."""
    return F.when(F.instr(column, ":") > 0, F.substring_index(column, ":", 1)).otherwise("")


def qualifier(column: Column) -> Column:
    """What stands behind the first colon; empty without one."""
    at = F.instr(column, ":")
    return F.when(at > 0, column.substr(at + 1, F.length(column))).otherwise("")


def cell_order() -> list[Column]:
    """Rows and columns up, in byte order, times down."""
    return [F.col("row"), F.col("column"), F.col("ts").desc()]


def cell_size(key: bool = True) -> Column:
    """Bytes of row, column and value, and eight for the time."""
    return 8 + F.octet_length("row") + F.octet_length("column") + F.coalesce(F.octet_length("value"), F.lit(0))


def resolve(log: DataFrame, erasures: bool = False) -> DataFrame:
    """The last write to each key of a log with `seq`; erasures are dropped after that, unless they are asked for.

    One hash aggregate with partial sums: a key written often is pre-aggregated before the shuffle.
    Conditions on key columns above it go below it, down to the scan.
    """
    last = log.groupBy(*KEY).agg(F.max_by("value", "seq").alias("value"))
    return last if erasures else last.filter("value is not null")


def keep_history(cells: DataFrame, k: int) -> DataFrame:
    """The newest k versions of each (row, column) for k > 0, all but the newest -k for k < 0, all for 0."""
    if not k:
        return cells
    n = F.row_number().over(Window.partitionBy("row", "column").orderBy(F.col("ts").desc()))
    ranked = cells.withColumn("__n", n)
    return ranked.filter(F.col("__n") <= k if k > 0 else F.col("__n") > -k).drop("__n")


def row_buffers(cells: DataFrame) -> DataFrame:
    """(row, cells): all cells of a row in order, as an array; a row must fit into a task, as it does in its result."""
    order = F.array_sort(F.collect_list(F.struct("column", (-F.col("ts")).alias("back"), "value")))
    return cells.groupBy("row").agg(F.transform(order, lambda x: F.struct(x["column"].alias("column"), (-x["back"]).alias("ts"), x["value"].alias("value"))).alias("cells"))


def latest_values(cells: DataFrame) -> DataFrame:
    """(row, values): the newest value of each column of a row, as a map."""
    newest = cells.groupBy("row", "column").agg(F.max_by("value", "ts").alias("value"))
    return newest.groupBy("row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "value")))).alias("values"))


def resume_after(cells: DataFrame, row: str, column: str, ts: int) -> DataFrame:
    """What comes behind a key in cell order."""
    same = F.col("row") == row
    return cells.filter((F.col("row") > row) | (same & (F.col("column") > column)) | (same & (F.col("column") == column) & (F.col("ts") < ts)))


def tablet_log(log: DataFrame, tablet: str, name: str = "tablet") -> DataFrame:
    """One tablet's writes in a log that several share."""
    return log.filter(F.col(name) == tablet).select("seq", *KEY, "value")
