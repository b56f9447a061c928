"""Operators on ordered data sets: merging, co-grouping, key selection, de-duplication, ranking, paging.

Order is data here: where it can be observed, an ordinal column carries it, and ties are settled by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .durable import materialise

#: Build sides below this size, by the planner's own estimate, are broadcast; Spark shuffles the others.
BROADCAST_BYTES = 32 << 20


def series(*inputs: DataFrame, ordinal: str = "input") -> DataFrame:
    """All inputs one after another: `ordinal` has the position of each row's input."""
    return reduce(lambda a, b: a.unionByName(b), [x.withColumn(ordinal, F.lit(i)) for i, x in enumerate(inputs)])


def merge(inputs: Sequence[DataFrame], order: Sequence[str], rank: str | None = None, ordinal: str = "input") -> DataFrame:
    """An ordered merge: by `order`, ties by the input's position.  `rank` names a column for the place, from 1,
    which is numbered over range partitions, not in one task."""
    both = series(*inputs, ordinal=ordinal)
    by = [*order, ordinal]
    return number(both, by, rank) if rank else both.orderBy(*by)


def merge_unique(inputs: Sequence[DataFrame], key: Sequence[str], ordinal: str = "input") -> DataFrame:
    """One row for each key, that of the first input that has it (of its rows, the least)."""
    both = series(*inputs, ordinal=ordinal)
    rest = [c for c in both.columns if c not in (*key, ordinal)]
    least = F.min(F.struct(ordinal, *rest)).alias("__kept")
    return both.groupBy(*key).agg(least).select(*key, f"__kept.{ordinal}", *(f"__kept.{c}" for c in rest))


def spread(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows dealt to range partitions by the order, once and for all: `__part` rises with it."""
    return materialise(df.sparkSession, df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "spread")


def number(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """Places from 1 over the whole order: range-partitioned, numbered in each partition, shifted by the counts before.

    The order has to be total.  What reaches one task is a count for each partition.
    """
    parts = spread(df, order)
    counts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = parts.withColumn("__place", place).join(F.broadcast(offsets), "__part")
    return placed.withColumn(out, (F.col("__place") + F.col("__before")).cast("long")).drop("__part", "__place", "__before")


def previous(df: DataFrame, columns: Sequence[str], order: str, within: Sequence[str] = ()) -> DataFrame:
    """Append `__prev`, some columns of the row before as a struct; null for a first row.

    Without groups the order is cut into range partitions, and each takes the last row of those before it.
    """
    held = F.struct(*columns)
    if within:
        return df.withColumn("__prev", F.lag(held).over(Window.partitionBy(*within).orderBy(order)))
    parts = spread(df, [order])
    lasts = parts.groupBy("__part").agg(F.max_by(held, F.col(order)).alias("__last"))
    lasts = lasts.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__last"))  # a row for each partition
    w = Window.partitionBy("__part").orderBy(order)
    first = F.row_number().over(w) == 1
    local = parts.withColumn("__prev", F.lag(held).over(w)).withColumn("__first", first).join(F.broadcast(lasts), "__part")
    return local.withColumn("__prev", F.when(F.col("__first"), F.col("__last")).otherwise(F.col("__prev"))).drop("__part", "__first", "__last")


def running_sum(df: DataFrame, value: str, order: str, out: str, within: Sequence[str] = ()) -> DataFrame:
    """Append the sum of a column so far, the row's own included; without groups over range partitions."""
    if within:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    parts = spread(df, [order])
    sums = parts.groupBy("__part").agg(F.sum(value).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    local = parts.withColumn("__sum", F.sum(value).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return local.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__sum") + F.col("__before")).drop("__part", "__sum", "__before")


def running_max_before(df: DataFrame, value: Column, order: Sequence[str | Column], out: str, within: Sequence[str] = ()) -> DataFrame:
    """Append the maximum of a value over the rows before, null for the first; without groups over range partitions."""
    back = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if within:
        return df.withColumn(out, F.max(value).over(back(*within)))
    parts = spread(df.withColumn("__v", value), order)
    tops = parts.groupBy("__part").agg(F.max("__v").alias("__top"))
    tops = tops.select("__part", F.max("__top").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__top"))
    local = parts.withColumn(out, F.max("__v").over(back("__part"))).join(F.broadcast(tops), "__part")  # a row for each partition
    return local.withColumn(out, F.greatest(out, "__top")).drop("__part", "__v", "__top")


def uniq(df: DataFrame, key: Sequence[str], ordinal: str, keep: str = "first") -> DataFrame:
    """One row of each key: the first or last by ordinal.  A struct's minimum, so it is summed up before the shuffle."""
    rest = [c for c in df.columns if c not in (*key, ordinal)]
    pick = {"first": F.min, "last": F.max}[keep](F.struct(ordinal, *rest)).alias("__kept")
    return df.groupBy(*key).agg(pick).select(*key, *(f"__kept.{c}" for c in (ordinal, *rest)))


def uniq_fold(df: DataFrame, key: Sequence[str], folds: dict[str, Column]) -> DataFrame:
    """Equal keys folded by aggregates: the keep policy as columns."""
    return df.groupBy(*key).agg(*(c.alias(n) for n, c in folds.items()))


def runs(df: DataFrame, value: Sequence[str], ordinal: str, within: Sequence[str] = ()) -> DataFrame:
    """Append `run`, from 0: the place of each row's run of adjacent equal values, by ordinal, within each group."""
    marked = previous(df, value, ordinal, within)
    same = F.col("__prev").isNotNull() & reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col("__prev")[c]) for c in value])
    started = marked.withColumn("__new", F.when(same, 0).otherwise(1)).drop("__prev")
    return running_sum(started, "__new", ordinal, "__run", within).withColumn("run", (F.col("__run") - 1).cast("long")).drop("__new", "__run")


def uniq_adjacent(df: DataFrame, value: Sequence[str], ordinal: str, within: Sequence[str] = (), keep: str = "first") -> DataFrame:
    """One row of each run of adjacent equal values; equal values that don't touch stay apart."""
    return uniq(runs(df, value, ordinal, within), [*within, "run"], ordinal, keep)


def uniq_pairs(df: DataFrame, key: Sequence[str], ordinal: str, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Equal keys folded by a Python function over all rows of a key in order; for policies that no aggregate expresses."""
    return df.groupBy(*key).applyInPandas(lambda g: fold(g.sort_values(ordinal)), schema)


def cogroup(inputs: Sequence[DataFrame], key: Sequence[str], keys: Sequence[Sequence[Column]] | None = None) -> DataFrame:
    """For each key of any input an array of structs per input (i0, i1, ...), sorted; empty where an input lacks it.

    `keys` has, for each input, its own expressions for the key columns.  One shuffle for all inputs: their rows are
    tagged and grouped together, in place of outer joins one by one.
    """
    if keys is not None:
        inputs = [x.select(*(c.alias(k) for k, c in zip(key, own, strict=True)), *(n for n in x.columns if n not in key)) for x, own in zip(inputs, keys, strict=True)]
    tagged = []
    names = [[c for c in x.columns if c not in key] for x in inputs]
    for i, x in enumerate(inputs):
        own = F.struct(*names[i]) if names[i] else F.struct(F.lit(1).alias("present"))
        cols = [own.alias(f"i{j}") if i == j else F.lit(None).cast(inputs[j].select(F.struct(*names[j]) if names[j] else F.struct(F.lit(1).alias("present"))).schema[0].dataType).alias(f"i{j}") for j in range(len(inputs))]
        tagged.append(x.select(*key, *cols))
    both = reduce(DataFrame.unionByName, tagged)
    return both.groupBy(*key).agg(*(F.array_sort(F.collect_list(f"i{i}")).alias(f"i{i}") for i in range(len(inputs))))


def join_optional(inputs: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """A co-group in which each input has a key once or not at all: structs in place of arrays, null for none.

    A key that an input repeats is an error when the rows are computed.
    """
    many = cogroup(inputs, key)
    one = lambda c: F.when(F.size(c) > 1, F.raise_error(F.lit(f"{c}: a key occurs more than once"))).otherwise(F.try_element_at(c, F.lit(1)))
    return many.select(*key, *(one(f"i{i}").alias(f"i{i}") for i in range(len(inputs))))


def select_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is among the keys, all of them, once each: the planner picks the build side by its size."""
    return df.join(keys.select(*on), list(on), "left_semi")


def reject_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key isn't among the keys."""
    return df.join(keys.select(*on), list(on), "left_anti")


def cutoffs(df: DataFrame, value: str, cuts: Sequence, out: str = "segment") -> DataFrame:
    """Append the segment of each row: how many of the cuts, in rising order, its value has reached."""
    if list(cuts) != sorted(cuts):
        raise ValueError("cuts have to rise")
    return df.withColumn(out, reduce(lambda a, b: a + b, [(F.col(value) >= F.lit(c)).cast("int") for c in cuts], F.lit(0)))


def top_k(df: DataFrame, k: int, order: Sequence[str | Column]) -> DataFrame:
    """The first k rows in order; tasks hold k rows each, and only these meet."""
    if k <= 0:
        raise ValueError("k has to be 1 at least")
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, k: int, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first k rows of each key; a rank's limit that Spark applies before the shuffle, too."""
    if k <= 0:
        raise ValueError("k has to be 1 at least")
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("place") <= k)


def chunks(df: DataFrame, size: int, order: Sequence[str | Column], out: str = "chunk") -> DataFrame:
    """Append the number of the chunk, of `size` rows each, in the whole order."""
    if size <= 0:
        raise ValueError("chunks have one row at least")
    return number(df, order, "__at").withColumn(out, F.floor((F.col("__at") - 1) / size).cast("long")).drop("__at")


def pages(df: DataFrame, limit: int, size: Column, order: Sequence[str | Column], within: Sequence[str], out: str = "page") -> DataFrame:
    """Append `page`: a page of each group is full once its sizes reach the limit, the row that reaches it included.

    A greedy fold, which no window expresses: an aggregate over each group's sizes in order, on the JVM.
    Each group is a scan, as it would be paged by one reader, and has to fit into a task.
    """
    w = Window.partitionBy(*within).orderBy(*order)
    placed = df.withColumn("__i", F.row_number().over(w)).withColumn("__s", size.cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("full"), F.array().cast("array<bigint>").alias("ends"))
    step = lambda a, x: F.when(a["full"] + x["__s"] >= limit, F.struct((a["page"] + 1).alias("page"), F.lit(0).cast("long").alias("full"), F.concat(a["ends"], F.array(x["__i"].cast("long"))).alias("ends"))).otherwise(F.struct(a["page"].alias("page"), (a["full"] + x["__s"]).alias("full"), a["ends"].alias("ends")))
    sizes = placed.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("__i", "__s"))).alias("__all"))
    ends = sizes.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(within)), F.aggregate("__all", start, step)["ends"].alias("__ends"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(within)])
    page = F.size(F.filter("__ends", lambda e: e < F.col("__i")))
    return placed.join(ends, on).withColumn(out, page.cast("long")).select(*df.columns, out)


def _fold_blocks(frame: pd.DataFrame, block: np.ndarray, ordinal: str, fold: Callable[[pd.DataFrame, list[str]], pd.DataFrame], by: list[str], batch: int, last: bool) -> pd.DataFrame:
    """Blocks of rows in order, `block` rising with them, folded by batches until each has a batch at most or doesn't
    shrink; at the last each block is a batch, folded once."""
    done = []
    while len(frame):
        at = np.arange(len(frame)) - np.searchsorted(block, block)
        big = np.full(len(frame), True) if last else np.bincount(block)[block] > batch
        if not big.all():
            done.append(frame[~big])
        if not big.any():
            break
        frame, block, at = frame[big], block[big], at[big]
        starts = np.flatnonzero(at % batch == 0)
        owner = block[starts]
        out = fold(frame.assign(__b=np.repeat(np.arange(len(starts)), np.diff([*starts, len(frame)]))), by)
        rows, stuck = len(frame), len(out) >= len(frame)
        out = out.assign(__k=owner[out["__b"].to_numpy(dtype=np.int64)]).sort_values(["__k", ordinal], kind="stable")
        block = out["__k"].to_numpy(dtype=np.int64)
        frame = out[frame.columns]
        if last or stuck:
            done.append(frame)
            break
    return pd.concat(done, ignore_index=True) if done else frame


#: Rows of a key that a task folds down to a batch at once.
FOLDED_ROWS = 8192


def uniq_batches(df: DataFrame, key: Sequence[str], ordinal: str, fold: Callable[..., pd.DataFrame], batch: int = 1000, many: bool = False) -> DataFrame:
    """Equal keys folded in batches of rows in order, partial results first, until each key has one batch left.

    `fold` takes and gives frames of the input's columns (nullable integers, times in the session's zone).  With `many`
    it is called as fold(frame, by) with many batches at once: it folds the groups of the columns `by` each by itself,
    and keeps these columns.  A task takes blocks of some thousand rows of a key and folds them by batches until a
    batch is left; rounds are by (key, block), so a key's rows are never gathered as a whole.  A fold that doesn't shrink
    its batches is an error.
    """

    def one_by_one(frame: pd.DataFrame, by: list[str]) -> pd.DataFrame:
        parts = [fold(g.drop(columns="__b")).assign(__b=b) for b, g in frame.groupby("__b", sort=False)]
        return pd.concat(parts, ignore_index=True)

    each, by = (fold if many else one_by_one), [*key, "__b"]
    size = batch * max(2, -(-FOLDED_ROWS // batch))
    ints = {getattr(pa, n.lower())(): getattr(pd, f"{n}Dtype")() for n in ("Int8", "Int16", "Int32", "Int64")}

    def folded(placed: DataFrame, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None

            def give(rows: pa.Table) -> Iterator[pa.RecordBatch]:
                at = rows["__at"].to_numpy()
                own = rows.drop_columns(["__at"])
                out = _fold_blocks(own.to_pandas(types_mapper=ints.get), np.cumsum(at % size == 0), ordinal, each, by, batch, last)
                yield from pa.Table.from_pandas(out, own.schema, preserve_index=False).to_batches()

            for b in batches:
                rows = pa.Table.from_batches([b])
                held = rows if held is None else pa.concat_tables([held, rows])
                starts = np.flatnonzero(held["__at"].to_numpy() % size == 0)
                if len(starts) and starts[-1]:  # the last block may go on in the next batch
                    yield from give(held.slice(0, starts[-1]))
                    held = held.slice(starts[-1])
            if held is not None and len(held):
                yield from give(held)

        parts = placed.repartition(*key, F.floor(F.col("__at") / size)).sortWithinPartitions(*key, "__at")
        return parts.mapInArrow(run, df.schema)

    place = F.row_number().over(Window.partitionBy(*key).orderBy(ordinal))
    held, rows = df, None
    while True:
        placed = materialise(df.sparkSession, held.withColumn("__at", (place - 1).cast("long")), "batches")
        n, most = placed.agg(F.count(F.lit(1)), F.max("__at")).first()
        if rows is not None and n >= rows:
            raise ValueError("the fold doesn't shrink its batches")
        if (most or 0) < batch:
            return folded(placed, last=True)
        held, rows = folded(placed, last=False), n


def tee(df: DataFrame, *writers: Callable[[DataFrame], None]) -> None:
    """The same rows to several sinks, computed once."""
    held = df.persist()
    try:
        for w in writers:
            w(held)
    finally:
        held.unpersist()


def observe(df: DataFrame, name: str | Observation, **metrics: Column) -> DataFrame:
    """Pass rows on and let Spark report metrics of them under a name, or to an observation that can be asked for them."""
    return df.observe(name, *(c.alias(n) for n, c in metrics.items()))
