"""Line dedup by the segment-partition edit join, in DataFrame operations only.

Two lines within t edits, the shorter of more than t characters, share one of its t + 1 segments at about
the same place.  So every line is indexed by its segments and probes the lines that are up to t shorter by
its substrings; what meets is verified by a banded bit-parallel edit distance.  A shorter line of t
characters or fewer has too little to part: it meets others by each of its characters.

A key that many lines share makes no pairs.  The shared segment is taken out, and what is left of each
line, which is within t edits if the lines are, is parted again: the key grows by a segment of the rest,
until few lines share it or no more than t characters are left.  With one edit, segments stand at the ends
of a rest, so all lines that have come so far are within an edit, and the earliest stands for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fresh

#: Edits within which two lines count as one.
THRESHOLD = 1
#: Keys that more lines share are parted further; of fewer, pairs are made.
HEAVY = 32
#: Candidate lines up to this number are broadcast as two hashes each (under 64 MB); beyond it, they are shuffled.
BROADCAST_LINES = 1_000_000

REST = "struct<size:int,rest:string>"


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def edit_distance(x: Column, y: Column, t: int) -> Column:
    """Edits between two strings whose lengths differ by t at most; any number above t where there are more.

    The columns of the table of distances are walked with the 2 t + 1 rows around its diagonal packed in
    a word: bits for where a step down adds one (vp), where it takes one off (vn), and where a step
    along the diagonal is free.  The distance is followed on the diagonal that ends in the last cell.
    """
    if not 0 < t <= 30:
        raise ValueError("a band has 1 to 30 edits")
    full = (1 << (2 * t + 1)) - 1
    kept = lambda c: c.bitwiseAND(F.lit(full))
    inverse = lambda c: c.bitwiseXOR(F.lit(full))

    def walk(p: Column, q: Column) -> Column:
        """p has as many characters as q, or more."""
        bit = F.size(p) - F.size(q) + t
        start = F.struct(F.lit(full & ~((1 << t) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), (F.size(p) - F.size(q)).alias("n"))

        def step(s: Column, j: Column) -> Column:
            equal = sum(
                (F.when(F.get(p, j - 1 - t + b) == F.get(q, j - 1), F.lit(1 << b)).otherwise(F.lit(0)) for b in range(1, 2 * t + 1)),
                F.when(F.get(p, j - 1 - t) == F.get(q, j - 1), F.lit(1)).otherwise(F.lit(0)),
            ).cast("long")

            def down(e: Column) -> Column:
                free = kept((e.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(e).bitwiseOR(s["vn"]))
                return _let(free, along)

            def along(free: Column) -> Column:
                more = s["vn"].bitwiseOR(inverse(free.bitwiseOR(s["vp"])))
                less = free.bitwiseAND(s["vp"])
                moved = F.shiftright(free, 1)
                return F.struct(
                    less.bitwiseOR(inverse(moved.bitwiseOR(more))).alias("vp"),
                    moved.bitwiseAND(more).alias("vn"),
                    (s["n"] + 1 - F.getbit(free, bit).cast("int")).alias("n"),
                )

            return _let(equal, down)

        steps = F.when(F.size(q) > 0, F.sequence(F.lit(1), F.size(q))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda s: s["n"])

    chars = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    longer = F.length(x) >= F.length(y)
    pair = F.struct(chars(F.when(longer, x).otherwise(y)).alias("p"), chars(F.when(longer, y).otherwise(x)).alias("q"))
    return F.when(F.abs(F.length(x) - F.length(y)) > t, F.lit(t + 1)).otherwise(_let(pair, lambda z: walk(z["p"], z["q"])))


def _segment(length: Column, i: int, t: int) -> tuple[Column, Column]:
    """Start (from 0) and width of segment i of t + 1: the first ones are the shorter."""
    short = F.floor(length / (t + 1)).cast("int")
    long_ones = length - short * (t + 1)
    from_long = F.greatest(F.lit(0), F.lit(i) - (t + 1 - long_ones))
    return (short * i + from_long).cast("int"), (short + (F.lit(i) >= t + 1 - long_ones).cast("int")).cast("int")


def _places(t: int) -> list[tuple[int, int, int]]:
    """(difference in length, segment, offset) at which the first matching segment of a pair can be.

    Of segment i, only the substrings that start within i of its place and within t - i of its place
    shifted by the difference in length count (multi-match-aware selection).
    """
    return [(s, i, d) for s in range(t + 1) for i in range(t + 1) for d in range(max(-i, s - (t - i)), min(i, s + (t - i)) + 1)]


def _pieces(key: Column, line: Column, length: Column, diff: Column, probe: Column, t: int, rests: bool, only: range | None = None) -> list[Column]:
    """(key, probe, diff, size, rest, place) of each of a line's next keys, null for those it doesn't have.

    `length` is that of the lines that are looked for, `diff` by how much this one is longer; a line that
    is indexed has difference 0 and probes its equals at offsets other than 0.  `size` is what the
    looked-for lines have left.
    """
    out = []
    for place, (s, i, d) in enumerate(_places(t)):
        if only is not None and s not in only:
            continue
        p, width = _segment(length, i, t)
        start = p + d
        one = F.struct(
            F.xxhash64(key, length, F.lit(i), F.substring(line, start + 1, width)).alias("key"),
            (probe | F.lit(d != 0)).alias("probe"),
            diff.alias("diff"),
            (length - width).cast("int").alias("size"),
            (F.concat(F.substring(line, F.lit(1), start), F.substring(line, start + width + 1, F.length(line))) if rests else F.lit(None).cast("string")).alias("rest"),
            F.lit(place).alias("place"),
        )
        out.append(F.when((diff == s) & (length > t) & (start >= 0) & (start + width <= F.length(line)), one))
    return out


def _parted(rows: DataFrame, t: int) -> DataFrame:
    """(g, h, f, line, key, probe, diff, size, rest, place) of the next keys of crowded rows."""
    size, rest = F.col("size"), F.col("rest")
    long = rows.filter(size > t).select("g", "h", "f", "line", F.explode(F.array(*_pieces(F.col("key"), rest, size, F.col("diff"), F.col("probe"), t, True))).alias("k")).filter("k is not null")
    short = rows.filter((size <= t) & (rest != "")).select("g", "h", "f", "line", "key", "probe", "diff", "rest", F.explode(F.array_distinct(F.split(rest, ""))).alias("c"))
    short = short.select("g", "h", "f", "line", F.xxhash64("key", F.lit("one"), "c").alias("key"), "probe", "diff", F.lit(-1).alias("size"), "rest", F.lit(-1).alias("place"))
    return long.select("g", "h", "f", "line", "k.*").union(short)


def _plausible(x: Column, y: Column, t: int) -> Column:
    """Whether enough pieces of the shorter string stand in the longer: t edits leave t + 2 of 2 t + 2 as they are."""
    shorter, longer = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    found = F.lit(0)
    for i in range(2 * t + 2):
        start, width = _segment(F.length(shorter), i, 2 * t + 1)
        piece = F.substring(shorter, start + 1, width)
        there = F.lit(False)
        for d in range(-t, t + 1):
            there = there | ((start + d >= 0) & (F.substring(longer, start + d + 1, width) == piece))
        found = found + there.cast("int")
    return found >= t + 2


def _near(x: Column, y: Column, t: int) -> Column:
    """Within t edits, and not all of the longer one is edited; most pairs are told apart by their pieces."""
    return _plausible(x, y, t) & _let(edit_distance(x, y, t), lambda n: (n <= t) & (n < F.greatest(F.length(x), F.length(y))))


def _meet(rows: DataFrame, *more: str) -> DataFrame:
    """Pairs of different lines (1: any, 2: an indexed one) that share a key; two indexed lines meet once."""
    a = rows.select("key", "probe", *(F.col(c).alias(f"{c}1") for c in ("g", "h", *more)))
    b = rows.filter("not probe").select(F.col("key").alias("key2"), *(F.col(c).alias(f"{c}2") for c in ("g", "h", *more)))
    other = (F.col("g1") != F.col("g2")) | (F.col("h1") != F.col("h2"))
    return a.join(b, (F.col("key") == F.col("key2")) & other & (F.col("probe") | (F.struct("g1", "h1") > F.struct("g2", "h2"))))


def _later() -> Column:
    """Of a pair, the line that comes first later."""
    return F.when(F.col("f1") > F.col("f2"), F.struct(F.col("g1").alias("g"), F.col("h1").alias("h"))).otherwise(F.struct(F.col("g2").alias("g"), F.col("h2").alias("h")))


def near_lines(lines: DataFrame, texts: DataFrame, threshold: int, tag: str) -> DataFrame:
    """(g, h) of the lines that have an earlier line within the threshold, from distinct lines.

    `texts` are all occurrences (g, h, d, s, n, line); `lines` has the first occurrence (d, s, n) of each line as f.
    """
    spark, t = lines.sparkSession, threshold
    line, length, root = F.col("line"), F.length("line"), F.lit(0).cast("long")
    no, yes = F.lit(False), F.lit(True)
    # a line is indexed, and probes what is up to t shorter
    keys = _pieces(root, line, length, F.lit(0), no, t, False, range(1))
    for s in range(1, t + 1):
        keys += _pieces(root, line, length - s, F.lit(s), yes, t, False, range(s, s + 1))
    # the characters of short lines, in the same pass
    for k in range(1, 2 * t + 1):
        one = F.struct(F.xxhash64(root, F.lit("one"), F.substring(line, k, 1)).alias("key"), (length > t).alias("probe"), F.lit(0).alias("diff"), F.lit(-1).alias("size"), F.lit(None).cast("string").alias("rest"), F.lit(-1).alias("place"))
        keys.append(F.when((length <= 2 * t) & (length >= k), one))
    every = texts.select("g", "h", F.explode(F.array(*keys)).alias("k")).filter("k is not null").select("k.key", "g", "h", "k.probe", "k.diff", "k.place")
    made = cut(spark, every.distinct(), f"{tag}-keys")
    # keys of single characters have as many lines as there are strings of 2 t characters: they are not parted
    shared = made.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("place"), F.bool_and("probe").alias("none"))
    shared = cut(spark, shared.filter("c > 1 and not none").select("key", ((F.col("c") > HEAVY) & (F.col("place") >= 0)).alias("heavy")), f"{tag}-shared")
    live = made.join(shared, "key")
    light = cut(spark, _meet(live.filter("not heavy")).select("g1", "h1", "g2", "h2").distinct(), f"{tag}-pairs")
    crowd = cut(spark, live.filter("heavy").drop("heavy"), f"{tag}-crowd")
    ends = light.select(F.col("g1").alias("g"), F.col("h1").alias("h")).union(light.select("g2", "h2")).union(crowd.select("g", "h"))
    wanted = cut(spark, ends.distinct(), f"{tag}-wanted")
    few = wanted.count() <= BROADCAST_LINES
    held = texts.join(F.broadcast(wanted) if few else wanted, ["g", "h"], "left_semi").groupBy("g", "h").agg(F.min("line").alias("line"))
    held = cut(spark, held.join(lines.select("g", "h", "f"), ["g", "h"]), f"{tag}-texts")
    one = held.select(F.col("g").alias("g1"), F.col("h").alias("h1"), F.col("f").alias("f1"), F.col("line").alias("line1"))
    two = held.select(F.col("g").alias("g2"), F.col("h").alias("h2"), F.col("f").alias("f2"), F.col("line").alias("line2"))
    found = light.join(one, ["g1", "h1"]).join(two, ["g2", "h2"]).filter(_near(F.col("line1"), F.col("line2"), t))

    def verified(rows: DataFrame) -> DataFrame:
        pairs = _meet(rows, "f", "line").filter(_near(F.col("line1"), F.col("line2"), t))
        return pairs.select(_later().alias("x")).select("x.g", "x.h")

    near = [cut(spark, found.select(_later().alias("x")).select("x.g", "x.h").distinct(), f"{tag}-near")]
    used = [made, shared, light, wanted]
    # crowded keys: the rest of each line, without the segment that the key stands for
    places = _places(t)
    rest = F.lit(None).cast(REST)
    for s in range(t + 1):
        for place, piece in zip((n for n, x in enumerate(places) if x[0] == s), _pieces(root, line, length - s, F.lit(s), F.col("probe"), t, True, range(s, s + 1)), strict=True):
            rest = F.when(F.col("place") == place, F.struct(piece["size"].alias("size"), piece["rest"].alias("rest"))).otherwise(rest)
    rows = crowd.join(held, ["g", "h"]).select("key", "g", "h", "f", "line", "probe", "diff", rest.alias("k")).select("key", "g", "h", "f", "line", "probe", "diff", "k.size", "k.rest")
    rows = cut(spark, rows, f"{tag}-rests")
    used += [crowd, held]
    while rows.take(1):
        # of these rests, any two are within t edits
        alike = rows.filter(F.col("size") + F.col("diff") <= t)
        if t == 1:
            first = alike.groupBy("key").agg(F.min(F.when(~F.col("probe"), F.col("f"))).alias("i"), F.min(F.when(F.col("probe"), F.col("f"))).alias("p"))
            late = alike.join(first, "key").filter((F.col("i") < F.col("f")) | (~F.col("probe") & (F.col("p") < F.col("f"))))
        else:
            late = verified(alike)
        near.append(cut(spark, late.select("g", "h").distinct(), f"{tag}-near"))
        parted = rows.filter((F.col("size") > t) | (F.col("size") + F.col("diff") > t) | ~F.col("probe"))
        parted = cut(spark, _parted(parted, t), f"{tag}-parted")
        shared = parted.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("place"), F.bool_and("probe").alias("none"))
        shared = cut(spark, shared.filter("c > 1 and not none").select("key", ((F.col("c") > HEAVY) & (F.col("place") >= 0)).alias("heavy")), f"{tag}-shared")
        live = parted.join(shared, "key")
        near.append(cut(spark, verified(live.filter("not heavy")).distinct(), f"{tag}-near"))
        used.append(rows)
        rows = cut(spark, live.filter("heavy").select("key", "g", "h", "f", "line", "probe", "diff", "size", "rest"), f"{tag}-rests")
        used += [parted, shared]
    every = near[0]
    for x in near[1:]:
        every = every.union(x)
    out = cut(spark, every.distinct(), f"{tag}-late")
    discard(spark, *used, rows, *near)
    return out


def dedup_lines(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: int = THRESHOLD,
    tag: str = "lines",
) -> DataFrame:
    """Drop from every text the lines that came earlier; append n_dropped, and leave the other columns as they are.

    Lines part at newlines and are ordered by (doc_id, hash of the text, line number), null ids first.  A line goes if the
    same line, or one within `threshold` edits (0: the same only), first occurs before it; a line that is near an earlier
    one goes wherever it occurs.  Two lines that have no character in place in common aren't near, however
    short they are, and empty lines stay.  Null texts stay null, empty ones empty;
    rows that share an id, or have none, are documents of their own by their texts, and those that repeat
    id and text count as one, so both keep what one keeps; an empty table gives an empty one; a column
    n_dropped in the input is an error, other columns pass.
    """
    spark = df.sparkSession
    fresh(df, "n_dropped")
    split = F.split(F.col(text), "\n")
    # a row is known by its id and its text: ids may be null or repeat
    body = F.xxhash64(F.col(text))
    occ = df.select(F.col(doc_id).alias("d"), body.alias("s"), F.posexplode(split).alias("n", "line")).filter(F.col("line") != "")
    occ = occ.select("d", "s", "n", "line", F.xxhash64("line").alias("g"), F.hash("line").alias("h"))
    # two hashes, 96 bits, stand for a line
    small = occ.select("d", "s", "n", "g", "h")
    first = small.groupBy("g", "h").agg(F.min(F.struct("d", "s", "n")).alias("f"), F.count(F.lit(1)).alias("c"))
    first = cut(spark, first, f"{tag}-first")
    near = near_lines(first, occ, threshold, tag) if threshold > 0 else None
    bad = first.filter("c > 1").select("g", "h", "f")
    if near is not None:
        bad = bad.join(near, ["g", "h"], "left_anti").union(near.select("g", "h", F.lit(None).cast(first.schema["f"].dataType)))
    bad = cut(spark, bad, f"{tag}-bad")
    drops = small.join(bad, ["g", "h"]).filter("f is null or not (d <=> f.d and s = f.s and n = f.n)")
    drops = drops.groupBy("d", F.col("s").alias("__s")).agg(F.array_sort(F.collect_set("n")).alias("__p"))
    drops = cut(spark, drops, f"{tag}-drops")
    discard(spark, first, bad, *([near] if near is not None else []))
    kept = F.expr(
        "flatten(transform(sequence(0, size(__p)), j -> slice(__l, if(j = 0, 1, __p[j - 1] + 2), if(j = size(__p), size(__l), __p[j]) - if(j = 0, 0, __p[j - 1] + 1))))"
    )
    # the same plan at every size: texts meet their drops by a sorted exchange
    out = df.join(drops.hint("merge"), F.col(doc_id).eqNullSafe(F.col("d")) & (body == F.col("__s")), "left")
    clean = out.withColumn("__l", F.when(F.col("__p").isNotNull(), split)).withColumn("__t", F.when(F.col("__p").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    return clean.select(*(F.col("__t").alias(c) if c == text else F.col(c) for c in df.columns), F.coalesce(F.size("__p"), F.lit(0)).alias("n_dropped"))
