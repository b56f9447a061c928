"""Mixing sources to target weights: exact-length counts, a bounded knapsack for the rest, seeded selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size, and a document is taken so often at most.
LIMIT = 3
#: Budget, in words, that the knapsack fits exactly; the proportional part brings the rest below it.
CAPACITY = 1 << 16
#: Hash slices of a length class, so that ranking within a class of very many documents is parted.
SLICES = 256
#: Classes (source and length) up to this number go to all tasks, in about 50 MB; more meet the texts by a shuffle.
BROADCAST_CLASSES = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def knapsack(lengths: list[int], spare: list[int], budget: int) -> list[int]:
    """How many of each length to take, of so many that are spare, for the largest sum not above the budget.

    Reachable sums are a bit set; copies of a length are added in powers of two.  It stops as soon as
    the budget itself is reachable.
    """
    take = [0] * len(lengths)
    if budget <= 0:
        return take
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i, (n, m) in enumerate(zip(lengths, spare, strict=True)):
        m = min(m, budget // n) if n > 0 else 0
        if not m:
            continue
        steps.append((i, reach, m))
        part = 1
        while m:
            part = min(part, m)
            reach |= reach << (n * part) & mask
            m -= part
            part *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    for i, before, m in reversed(steps):
        n = lengths[i]
        for x in range(m + 1):
            if at - x * n >= 0 and before >> (at - x * n) & 1:
                take[i], at = x, at - x * n
                break
    return take


def plan_source(sizes: np.ndarray, counts: np.ndarray, budget: int, capacity: int = CAPACITY) -> np.ndarray:
    """Documents of each length to take once more, so that their sizes come to `budget` or as near below as can be.

    Every length gives its share of the budget, rounded down; what that leaves is lowered below the
    knapsack's capacity a document at a time, largest lost fraction first, and then fitted exactly.
    """
    total = int((sizes * counts).sum())
    k = np.zeros(len(sizes), np.int64)
    if budget <= 0 or total <= 0:
        return k
    if budget >= total:
        return counts.copy()
    parts = [divmod(budget * int(c), total) for c in counts]
    k[:] = [min(q, int(c)) if s else 0 for (q, _), c, s in zip(parts, counts, sizes, strict=True)]
    rest = budget - int((k * sizes).sum())
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: (-parts[i][1], -int(sizes[i])))
    moved = True
    while rest > capacity and moved:
        moved = False
        for i in order:
            if rest <= capacity:
                break
            if k[i] < counts[i] and sizes[i] <= rest:
                k[i] += 1
                rest -= int(sizes[i])
                moved = True
    fit = [i for i in order if k[i] < counts[i] and sizes[i] <= rest]
    if rest <= capacity:
        for i, x in zip(fit, knapsack([int(sizes[i]) for i in fit], [int(counts[i] - k[i]) for i in fit], rest), strict=True):
            k[i] += x
    return k


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, source_size): all sizes shared by weight, none above its limit.

    Targets are least(level * weight, limit * size) for the one level at which they come to the sum of
    sizes.  The rows are one for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by_source.withColumn("w", w).withColumn("cap", limit * F.col("source_size"))
    # sources fill up in the order of cap / weight
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    s = s.withColumn("fits", F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level"))))
    s = s.withColumn("level", F.min("fits").over(everything)["level"])
    target = F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    limit: int = LIMIT,
    seed: int = 7,
    tag: str = "mix",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append mix_size, mix_source_size, mix_target, mix_repeats to every row: how often the mix takes it.

    Sizes are words (null and empty texts: 0, never more than taken along).  A source's target is split
    into whole passes over it and a rest below its size; the rest is planned over the counts of its
    exact lengths and filled with documents chosen by a seeded hash of their id and text.  A null source is one
    source, last in order; rows that repeat an id, or have none, are rows of their own; ties of the hash go by
    id and text (where the text is kept, rows that share both are taken alike); an empty table gives an empty one.  Other columns pass (or those named in `keep`).
    """
    spark = df.sparkSession
    kept = list(df.columns) if keep is None else keep
    fresh(df, "mix_size", "mix_source_size", "mix_target", "mix_repeats")
    named = [
        F.col(source).alias("__s"),
        word_count(F.col(text)).alias("mix_size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("__h"),
        F.col(doc_id).alias("__i"),
        F.xxhash64(F.col(text)).alias("__x"),
    ]
    whole = text in kept
    # small rows: words are counted once, and only these rows are shuffled
    rows = df.select(*([] if whole else kept), *named).withColumn("__b", F.pmod("__h", F.lit(SLICES)).cast("int"))
    rows = cut(spark, rows, f"{tag}-sizes")
    classes = cut(spark, rows.groupBy("__s", "mix_size", "__b").agg(F.count(F.lit(1)).alias("n")), f"{tag}-classes")
    goal = targets(classes.groupBy(F.col("__s").alias("source")).agg(F.sum(F.col("mix_size") * F.col("n")).alias("source_size")), weights, limit)
    goal = goal.select(
        F.col("source").alias("__s"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        F.when(F.col("source_size") > 0, F.least(F.lit(limit), F.floor(F.round("target") / F.col("source_size")))).otherwise(0).cast("long").alias("passes"),
    ).withColumn("rest", (F.round("mix_target") - F.col("passes") * F.col("mix_source_size")).cast("long"))
    goal = goal.withColumn("rest", F.when(F.col("passes") >= limit, 0).otherwise(F.col("rest")))
    goal = cut(spark, goal, f"{tag}-goals")
    counts = classes.groupBy("__s", "mix_size").agg(F.sum("n").alias("n"))
    same = counts["__s"].eqNullSafe(goal["__s"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("mix_size", ascending=False)
        k = plan_source(part["mix_size"].to_numpy(np.int64), part["n"].to_numpy(np.int64), int(part["rest"].iloc[0]))
        return pd.DataFrame({"__s": part["__s"], "mix_size": part["mix_size"], "k": k})

    planned = (
        counts.join(goal, same).select(counts["__s"], "mix_size", "n", "rest")
        .groupBy("__s").applyInPandas(fit, "__s string, mix_size long, k long")
    )
    planned = cut(spark, planned, f"{tag}-plan")
    # a class takes k of its documents in hash order: whole slices, then the first of one slice
    along = Window.partitionBy("__s", "mix_size").orderBy("__b")
    upto = classes.withColumn("upto", F.sum("n").over(along))
    p = upto.join(planned.select(F.col("__s").alias("ps"), F.col("mix_size").alias("pz"), "k"), F.col("__s").eqNullSafe(F.col("ps")) & (F.col("mix_size") == F.col("pz")))
    p = p.select("__s", "mix_size", "__b", F.greatest(F.lit(0), F.least("n", F.col("k") - (F.col("upto") - F.col("n")))).alias("quota"))
    g = goal.select(F.col("__s").alias("gs"), "mix_source_size", "mix_target", "passes")
    p = p.join(g, F.col("__s").eqNullSafe(F.col("gs"))).select(F.col("__s").alias("qs"), F.col("mix_size").alias("qz"), F.col("__b").alias("qb"), "quota", "passes", "mix_source_size", "mix_target")
    p = cut(spark, p, f"{tag}-quota")
    joined = rows.join(p, F.col("__s").eqNullSafe(F.col("qs")) & (F.col("mix_size") == F.col("qz")) & (F.col("__b") == F.col("qb")))
    rank = F.row_number().over(Window.partitionBy("__s", "mix_size", "__b").orderBy("__h", "__i", "__x"))
    if not whole:
        repeats = F.col("passes") + F.when(rank <= F.col("quota"), 1).otherwise(0)
        return joined.withColumn("mix_repeats", repeats.cast("int")).select(*kept, "mix_size", "mix_source_size", "mix_target", "mix_repeats")
    # whole texts stay where they are: each class has a last row that is taken, and rows compare themselves with it
    place = F.struct("__b", "__h", "__i", "__x")
    tops = joined.select("__s", "mix_size", place.alias("at"), (rank <= F.col("quota")).alias("taken")).groupBy("__s", "mix_size").agg(F.max(F.when(F.col("taken"), F.col("at"))).alias("__top"))
    tops = cut(spark, tops.select(F.col("__s").alias("ts"), F.col("mix_size").alias("tz"), "__top"), f"{tag}-tops")
    tops = tops.join(g, F.col("ts").eqNullSafe(F.col("gs"))).drop("gs")
    tops = F.broadcast(tops) if tops.count() <= BROADCAST_CLASSES else tops
    out = df.select(*kept, *named).withColumn("__b", F.pmod("__h", F.lit(SLICES)).cast("int"))
    out = out.join(tops, F.col("__s").eqNullSafe(F.col("ts")) & (F.col("mix_size") == F.col("tz")))
    repeats = F.col("passes") + F.when(F.coalesce(place <= F.col("__top"), F.lit(False)), 1).otherwise(0)
    return out.withColumn("mix_repeats", repeats.cast("int")).select(*kept, "mix_size", "mix_source_size", "mix_target", "mix_repeats")


def mixed(df: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The mix itself: every row as often as it is taken, with the input's columns."""
    out = mix(df, **options).filter("mix_repeats > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_repeats"))))
    return out.select(*df.columns)
