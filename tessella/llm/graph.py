"""Connected components of a link table, wholly on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, local_roots

#: Links taken together by the local step; what a task holds at once.
BLOCK = 500_000


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        a, b = local_roots(t["a"].to_numpy(), t["b"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= BLOCK:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def shrink(links: DataFrame) -> DataFrame:
    """The same components with fewer links: each block of a partition becomes stars around its smallest nodes."""
    return links.mapInArrow(_shrink, "a long, b long")


def _low(by: DataFrame) -> DataFrame:
    return by.groupBy("u").agg(F.min("v").alias("m"))


def components(spark: SparkSession, links: DataFrame, tag: str) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds on a link table that each round writes to the shared
    folder.  A hub is never gathered: its smallest neighbour is a pre-aggregated minimum, and the join
    back is one whose large partitions Spark splits.  Self-links and repeated links do no harm; nulls
    are left out; without links the result is empty.
    """
    e = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.filter("a is not null and b is not null and a <> b")
    e = cut(spark, shrink(e).distinct(), f"{tag}-links")
    while True:
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = cut(spark, _low(both).select("u", F.least("u", "m").alias("m")), f"{tag}-low")
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        e = cut(spark, shrink(big).distinct(), f"{tag}-large")
        # small star: the smaller neighbours of a node, and itself, go to the smallest of them; a > b here
        low = cut(spark, e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), f"{tag}-low")
        many = low.filter("n > 1")
        if not many.take(1):
            # every node has one parent; done when no parent has one
            if not e.join(low.select(F.col("u").alias("b")), "b", "left_semi").take(1):
                break
        small = e.join(low.select(F.col("u").alias("a"), "m"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(spark, shrink(small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))).distinct(), f"{tag}-small")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
