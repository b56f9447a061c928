"""Interval tables and range-partitioned tables: set algebra, lookups, split points, repair, compaction, garbage."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import materialise
from .streams import BROADCAST_BYTES, number, previous, running_max_before, running_sum, runs


def coalesce_intervals(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Half-open intervals (lo, hi) that overlap or touch as one each, within each group; empty ones go.

    An island starts where `lo` is above every `hi` before it.
    """
    marked = running_max_before(df.filter("lo < hi"), F.col("hi"), ["lo", "hi"], "__reach", within)
    marked = marked.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("lo") > F.col("__reach")), 1).otherwise(0))
    # rows with one start and end lie in one island, and only the first of them can begin it
    ends = marked.groupBy(*within, "lo", "hi").agg(F.max("__new").alias("__new")).withColumn("__at", F.struct("lo", "hi"))
    named = running_sum(ends, "__new", "__at", "__island", within)
    return named.groupBy(*within, "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*within, "lo", "hi")


def intersect_intervals(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Pairwise intersections of two interval sets by key: an equi-join with a range condition."""
    a, b = a.select(*on, F.col("lo").alias("__la"), F.col("hi").alias("__ha")), b.select(*on, F.col("lo").alias("__lb"), F.col("hi").alias("__hb"))
    both = a.join(b, list(on)).filter("__la < __hb and __lb < __ha")
    return both.select(*on, F.greatest("__la", "__lb").alias("lo"), F.least("__ha", "__hb").alias("hi"))


def _first_not_below(df: DataFrame, values: str, x: Column, most: int, out: str) -> DataFrame:
    """Append the position, from 0, of the first of rising values, `most` of them at most, that isn't below x; their
    number if there is none.  A binary search as a projection for each halving, which Spark compiles, unlike lambdas."""
    df = df.withColumn(out, F.lit(0))
    for half in (1 << i for i in reversed(range(most.bit_length()))):
        below = F.get(F.col(values), F.col(out) + F.lit(half - 1)) < x  # null beyond the end
        df = df.withColumn(out, F.col(out) + F.when(below, half).otherwise(0))
    return df


def lookup_ranges(df: DataFrame, value: str, tablets: DataFrame, name: str = "tablet", upper: str = "upper", fanout: int = 4096) -> DataFrame:
    """Append the owner of each value: the tablet with the least upper bound that isn't below it (null: unbounded).

    An as-of search without a range join or a shuffle by value: sorted bounds are the leaves of a tree whose nodes hold
    `fanout` of them, and a node's last bound stands for it in the level above.  The root, one row, goes to all tasks; a
    binary search there finds the next level's node, which an equi-join brings, and so on, so that a row never meets
    more than a node at a time.  Small levels are broadcast, others as the planner finds by their size.
    Of tablets with one bound the least name counts; a null value has no owner.
    """
    spark, fanout, v = df.sparkSession, max(fanout, 2), F.col(value)
    ends = tablets.filter(F.col(upper).isNotNull()).groupBy(F.col(upper).alias("__u")).agg(F.min(name).alias("__n"))
    placed = materialise(spark, number(ends, ["__u"], "__i").withColumn("__i", F.col("__i") - 1), "bounds")
    n, chars = placed.agg(F.count(F.lit(1)), F.sum(F.length(F.col("__u").cast("string")))).first()

    def nodes(level: int, *by: Column) -> DataFrame:
        """Bounds (and names, which count in leaves) of each node of a level, in order."""
        step = fanout**level
        lasts = placed.filter(((F.col("__i") + 1) % step == 0) | (F.col("__i") == n - 1))
        own = lasts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__u", "__n"))).alias("__own"))
        part = lambda c: F.transform("__own", lambda x: x[c]).alias(f"{c}s")
        return own.select(*(["__b"] if by else []), part("__u"), *([] if level else [part("__n")]))

    depth = 0
    while n > fanout ** (depth + 1):
        depth += 1
    open_end = tablets.agg(F.min(F.when(F.col(upper).isNull(), F.col(name))).alias("__rest"))
    found = df.crossJoin(F.broadcast(nodes(depth).crossJoin(open_end)))  # one row
    found = _first_not_below(found, "__us", v, min(n, fanout), "__pos")
    found = found.withColumn("__past", F.col("__pos") >= F.size("__us")).withColumn("__at", F.when(v.isNotNull(), F.col("__pos").cast("long")))
    for level in reversed(range(depth)):
        own = nodes(level, F.floor(F.col("__i") / fanout ** (level + 1)).cast("long").alias("__b"))
        if ((chars or 0) + n * 48) // fanout**level <= BROADCAST_BYTES:
            own = F.broadcast(own)
        found = found.drop("__us", "__pos").join(own, F.col("__at") == F.col("__b"), "left")
        found = _first_not_below(found, "__us", v, fanout, "__pos")
        found = found.withColumn("__at", F.col("__b") * fanout + F.col("__pos")).drop("__b")
    owner = F.when(F.col("__past"), F.col("__rest")).otherwise(F.get("__ns", F.col("__pos")))
    return found.withColumn(name, F.when(v.isNotNull(), owner)).drop("__at", "__pos", "__past", "__rest", "__us", "__ns")


def consecutive(df: DataFrame, row: str = "row", within: Sequence[str] = ()) -> DataFrame:
    """Last rows of tablets as intervals (lower, upper]: the lower end is the row before, null at the start."""
    return previous(df.select(*within, row), [row], row, within).select(*within, F.col("__prev")[row].alias("lower"), F.col(row).alias("upper"))


def _with_total(df: DataFrame, value: str, within: Sequence[str]) -> DataFrame:
    """Append `__all`, the sum of a column over each group, or over all rows without groups."""
    if within:
        return df.withColumn("__all", F.sum(value).over(Window.partitionBy(*within)))
    return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("__all"))))  # one row


def split_points(df: DataFrame, parts: int, row: str = "row", weight: Column | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Rows that cut each group into `parts` of about equal weight: (part, row), the rows where the weight so far passes a boundary.

    Weights are summed by row first, so what a window sorts is one record for each row.
    """
    w = F.lit(1) if weight is None else weight
    rows = df.groupBy(*within, row).agg(F.sum(w).alias("__w"))
    at = _with_total(running_sum(rows, "__w", row, "__at", within), "__w", within)
    edge = lambda x: F.floor(x * parts / F.col("__all"))
    passed = at.withColumn("part", edge(F.col("__at")).cast("int")).withColumn("__before", edge(F.col("__at") - F.col("__w")).cast("int"))
    return passed.filter((F.col("part") > F.col("__before")) & (F.col("part") < parts)).select(*within, "part", row)


def median_row(sizes: DataFrame, row: str = "row", size: str = "bytes", within: Sequence[str] = ()) -> DataFrame:
    """The first row at which the sizes so far reach half of them all."""
    marked = _with_total(running_sum(sizes, size, row, "__at", within), size, within)
    return marked.filter(F.col("__at") * 2 >= F.col("__all")).groupBy(*within).agg(F.min(row).alias("split_row"))


def split_tablet(lower: str | None, upper: str | None, at: str) -> tuple[tuple, tuple]:
    """(lower, at] and (at, upper]; ValueError if either were empty."""
    if (lower is not None and at <= lower) or (upper is not None and at >= upper):
        raise ValueError("one side of the split is empty")
    return (lower, at), (at, upper)


def repair_tablets(tablets: DataFrame, table: str = "table") -> DataFrame:
    """Tablets (table, lower, upper) with `action`: 'erase' for one that the next overlaps after a split that broke off,
    'extend' with the new lower bound `fixed` where a gap is before it, 'keep' otherwise."""
    w = Window.partitionBy(table).orderBy(F.col("upper").asc_nulls_last(), F.col("lower").asc_nulls_first())
    prev, nxt = F.lag("upper").over(w), F.lead("lower").over(w)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    overlapped = ~last & (nxt.isNull() | (nxt < F.col("upper")))
    gap = F.when(first, F.col("lower").isNotNull()).otherwise(F.coalesce(F.col("lower"), F.lit("")) > prev)
    action = F.when(overlapped, "erase").when(gap, "extend").otherwise("keep")
    return tablets.withColumn("action", action).withColumn("fixed", F.when(F.col("action") == "extend", F.when(first, F.lit(None)).otherwise(prev)).otherwise(F.col("lower")))


def merge_runs(rows: DataFrame, value: Sequence[str], order: str, within: Sequence[str] = ()) -> DataFrame:
    """Runs of adjacent records with equal values as one: the first lower bound and the last key of each."""
    named = runs(rows, value, order, within)
    return named.groupBy(*within, "run", *value).agg(F.min_by("lower", order).alias("lower"), F.max(order).alias(order), F.count(F.lit(1)).alias("joined")).drop("run")


def longest_chain(df: DataFrame, member: Column, order: str, within: Sequence[str] = ()) -> DataFrame:
    """Of each group the longest stretch of adjacent members (first, last, length), the earliest of equals."""
    w = Window.partitionBy(*within).orderBy(order)
    marked = df.withColumn("__m", member).withColumn("__i", F.row_number().over(w))
    inside = marked.filter("__m").withColumn("__g", F.col("__i") - F.row_number().over(w))
    chains = inside.groupBy(*within, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length"), F.min("__i").alias("__i"))
    best = F.row_number().over(Window.partitionBy(*within).orderBy(F.col("length").desc(), "__i"))
    return chains.withColumn("__b", best).filter("__b = 1").select(*within, "first", "last", "length")


def compact(log: DataFrame, rooted: bool) -> DataFrame:
    """A log's last writes, as a log; erasures stay unless nothing older can be below (rooted)."""
    last = log.groupBy("row", "column", "ts").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return (last.filter("value is not null") if rooted else last).select("seq", "row", "column", "ts", "value")


def choose_compaction(sizes: Sequence[int], width: int = 16) -> tuple[int, int] | None:
    """Which adjacent tables (first, end), oldest first, to merge: those that gain most for their cost.

    A scan costs bytes times ln(tables + 1); the gain is what merging takes off that, over the bytes merged.
    """
    cost = lambda xs: sum(xs) * math.log(len(xs) + 1)
    best, at = 0.0, None
    for i in range(len(sizes)):
        for j in range(i + 2, min(len(sizes), i + width) + 1):
            part = list(sizes[i:j])
            gain = (cost(list(sizes)) - cost([*sizes[:i], sum(part), *sizes[j:]])) / max(1, sum(part))
            if gain > best:
                best, at = gain, (i, j)
    return at


def simulate_compaction(arrivals: Sequence[int], most: int = 8, width: int = 16) -> tuple[list[int], int]:
    """(table sizes at the end, bytes rewritten) for tables that arrive in turn, compacted when there are over `most`."""
    sizes: list[int] = []
    rewritten = 0
    for x in arrivals:
        sizes.append(x)
        while len(sizes) > most and (at := choose_compaction(sizes, width)):
            i, j = at
            rewritten += sum(sizes[i:j])
            sizes[i:j] = [sum(sizes[i:j])]
    return sizes, rewritten


def fragment_weights(edges: DataFrame) -> DataFrame:
    """Of a tablet-fragment graph (tablet, fragment, bytes, used) the fragments with what merging them would save.

    A fragment weighs the sum, over its tablets, of (chain length - 1) times its wasted bytes.
    """
    chains = edges.groupBy("tablet").agg(F.count(F.lit(1)).alias("chain"))
    return edges.join(chains, "tablet").groupBy("fragment").agg(F.sum((F.col("chain") - 1) * (F.col("bytes") - F.col("used"))).alias("weight"), F.count(F.lit(1)).alias("tablets"))


def fragmentation(edges: DataFrame) -> DataFrame:
    """One row: tablets, mean and longest chain of fragments, and the wasted part of their bytes."""
    chains = edges.groupBy("tablet").agg(F.count(F.lit(1)).alias("chain"), F.sum("bytes").alias("bytes"), F.sum("used").alias("used"))
    return chains.agg(F.count(F.lit(1)).alias("tablets"), F.avg("chain").alias("mean_chain"), F.max("chain").alias("longest_chain"), (1 - F.sum("used") / F.sum("bytes")).alias("wasted"))


def garbage(files: DataFrame, active: DataFrame, before: Column) -> DataFrame:
    """Files (path, modified) older than a time that no active list names."""
    return files.filter(F.col("modified") < before).select("path").distinct().join(active.select("path"), "path", "left_anti")


def truncate_intervals(df: DataFrame, length: int | None = None, delimiter: str | None = None, fields: int = 1, within: Sequence[str] = ()) -> DataFrame:
    """Intervals (lower, upper) with their ends cut to so many characters or delimited fields, as [lower, upper).

    What gets empty, or lies within what came before, goes.
    """
    cut = (lambda c: F.substring(c, 1, length)) if length is not None else (lambda c: F.substring_index(c, delimiter, fields))
    short = df.select(*within, cut(F.col("lower")).alias("lower"), cut(F.col("upper")).alias("upper")).filter("lower is null or upper is null or lower < upper")
    order = [F.col("lower").asc_nulls_first(), F.col("upper").asc_nulls_last()]
    reach = F.struct(F.col("upper").isNull().alias("open"), "upper")
    marked = running_max_before(short, reach, order, "__before", within)
    marked = marked.select(*short.columns, F.col("__before.upper").alias("__reach"), F.coalesce("__before.open", F.lit(False)).alias("__open"))
    return marked.filter("not __open and (__reach is null or upper is null or upper > __reach)").drop("__reach", "__open")


def erase(cells: DataFrame, start: int) -> DataFrame:
    """Writes that erase the given cells, numbered from `start` in key order."""
    keys = number(cells.select("row", "column", "ts").distinct(), ["row", "column", "ts"], "seq")
    return keys.select((F.col("seq") + (start - 1)).alias("seq"), "row", "column", "ts", F.lit(None).cast("string").alias("value"))


def locations(configs: DataFrame, table: str, port: int, scheme: str = "tablet") -> DataFrame:
    """Location cells from config cells, whose value has a line `server = ...`."""
    from tessella.functions.text import config_map

    server = config_map(F.col("value"))["server"]
    return configs.filter(F.col("column") == "config").select("row", F.lit("location").alias("column"), "ts", F.concat(F.lit(f"{scheme}://"), server, F.lit(f":{port}/{table}")).alias("value"))
