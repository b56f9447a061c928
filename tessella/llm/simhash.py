"""Near-duplicates by 64-bit SimHash: Golay-code keys find the pairs, components group them.

Two fingerprints that differ in two bits at most agree wholly in one of three segments, and in the next
segment they differ in two bits at most.  The perfect Golay code (23, 12) turns that into equal keys: a
segment's keys are the indices of the codewords nearest to it and to its one-bit neighbours, and two
segments at distance two share such a neighbour.  A key is the exact segment with a codeword index of
the next, so about 33 bits part the fingerprints.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_column, words_of
from .graph import components

#: Bit ranges of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets above this size are linked through common neighbours in place of pairs.
HEAVY = 64

_golay: list[np.ndarray] = []


def golay_table() -> np.ndarray:
    """For each 23-bit word the 12-bit index of its nearest codeword, which is at distance 3 at most."""
    if not _golay:
        words = np.arange(1 << 12, dtype=np.int64) << 11
        rest = words.copy()
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (0xAE3 << (bit - 11)), rest)
        words |= rest
        errors = [0]
        for i in range(23):
            errors.append(1 << i)
            for j in range(i):
                errors.append(1 << i | 1 << j)
                errors += [1 << i | 1 << j | 1 << k for k in range(j)]
        near = np.empty(1 << 23, np.uint16)
        index = np.arange(1 << 12, dtype=np.uint16)
        for e in errors:
            near[words ^ e] = index
        _golay.append(near)
    return _golay[0]


def simhash(texts: list[str | None], size: int = 3) -> np.ndarray:
    """Fingerprints of texts as signed 64-bit integers: a bit is set if it is in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        w = words_of(text)
        if w:
            s = map(b" ".join, zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
            n = max(1, len(w) - size + 1)
            hashes.append(np.fromiter(map(xxh64_intdigest, s, repeat(42)), np.uint64, n))
            counts[i] = n
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out.view(np.int64)
    h, n = np.concatenate(hashes), counts[counts > 0]
    ends = np.cumsum(n)
    # blocks of up to 255 shingles are summed in eight byte lanes at once
    per = -(-n // 255)
    first = np.cumsum(per) - per
    starts = np.repeat(ends - n, per) + 255 * (np.arange(per.sum()) - np.repeat(first, per))
    votes = np.empty((len(starts), 64), np.int64)
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        votes[:, k::8] = np.add.reduceat(h >> np.uint64(k) & lanes, starts).view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(votes, first, axis=0)
    bits = (2 * total > n[:, None]).astype(np.uint8)
    out[counts > 0] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", carry: list[str] | None = None, size: int = 3) -> DataFrame:
    """Append the SimHash of a text (bigint).  Nulls and texts without words have 0."""
    return map_column(df, text, [T.StructField(out, T.LongType())], lambda: lambda rows: [pa.array(simhash(rows, size), pa.int64())], carry)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for each of its keys."""
    near, u = golay_table(), fp.astype(np.int64, copy=False).view(np.uint64)
    seg = [(u >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        balls = np.stack([near[seg[j]], *(near[seg[j] ^ (1 << k)] for k in range(SEGMENTS[j][1]))], axis=1)
        balls.sort(axis=1)
        new = np.ones(balls.shape, bool)
        new[:, 1:] = balls[:, 1:] != balls[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(np.int64(i) << 60 | seg[i][r] << 12 | balls[r, c].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches):  # noqa: ANN001, ANN202
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            s = b.slice(at, 4096)
            fp, rep = s.column(0).to_numpy(), s.column(1).to_numpy()
            r, k = keys_of(fp)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[r]), pa.array(rep[r])], names=["key", "fp", "rep"])


def near_links(spark: SparkSession, reps: DataFrame, tag: str) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp, rep) whose components are those of all pairs at distance 2 or less.

    Buckets of few fingerprints are joined and verified.  In a bucket of many, pairs could be too many,
    and none is made: two fingerprints are at distance 2 or less just if some word is at distance 1 or
    less from both, so each of them is put to its 65 such words; at most 65 fingerprints meet at a word,
    all of them linked, and a star stands for their pairs.
    """
    keyed = cut(spark, reps.select("fp", "rep").mapInArrow(_emit_keys, "key long, fp long, rep long"), f"{tag}-keys")
    heavy = cut(spark, keyed.groupBy("key").count().filter(F.col("count") > HEAVY).select("key"), f"{tag}-heavy")
    light = keyed.join(heavy, "key", "left_anti")
    one = light.select("key", F.col("fp").alias("f1"), F.col("rep").alias("a"))
    two = light.select("key", F.col("fp").alias("f2"), F.col("rep").alias("b"))
    pairs = one.join(two, "key").filter("a > b and bit_count(f1 ^ f2) <= 2").select("a", "b")
    crowd = keyed.join(heavy, "key", "left_semi").select("fp", "rep").distinct()
    words = crowd.select("rep", F.explode(F.expr("transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))")).alias("w"))
    stars = words.groupBy("w").agg(F.min("rep").alias("b"), F.collect_list("rep").alias("all")).filter("size(all) > 1")
    stars = stars.select(F.explode("all").alias("a"), "b").filter("a > b")
    return pairs.union(stars)


def simhash_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tag: str = "simhash") -> DataFrame:
    """(doc_id, fp, component_id) for every row with an id: the smallest doc_id that links reach.

    Documents link if their fingerprints differ in two bits at most.  Null and empty texts have the
    fingerprint 0 and link like any other; rows with a null id are left out; rows that repeat an id
    give a row each; an empty table gives an empty one; other columns are ignored.  Documents with one
    fingerprint are counted as one node, so a group of copies is never expanded.
    """
    spark = df.sparkSession
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    fps = cut(spark, fingerprints(src, carry=["doc_id"]), f"{tag}-fps")
    reps = cut(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), f"{tag}-reps")
    comp = components(spark, near_links(spark, reps, tag), tag)
    named = reps.join(comp, reps["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = cut(spark, named, f"{tag}-named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def simhash_kept(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tag: str = "kept") -> DataFrame:
    """The rows of `df` of which one of each group of links stays: the smallest id, nulls last, then the text's least hash.

    Rows are known by id and text, so those without an id, or with one that repeats, are compared like any
    other; of rows that share both, one stays.  Null and wordless texts are one group.  Columns and their
    order are those of the input; an empty table gives an empty one.
    """
    spark = df.sparkSession
    src = df.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("x"), F.col(text).alias("text"))
    fps = cut(spark, fingerprints(src, carry=["d", "x"]), f"{tag}-fps")
    # fingerprints are the nodes, named by themselves
    reps = cut(spark, fps.select("fp", F.col("fp").alias("rep")).distinct(), f"{tag}-reps")
    comp = components(spark, near_links(spark, reps, tag), tag)
    group = fps.join(comp.select(F.col("node").alias("fp"), "component"), "fp", "left").select("d", "x", F.coalesce("component", "fp").alias("c"))
    group = cut(spark, group.groupBy("c", "d", "x").agg(F.count(F.lit(1)).alias("n")), f"{tag}-groups")
    first = F.struct(F.col("d").isNull().alias("none"), "d", "x")
    best = group.groupBy("c").agg(F.min(first).alias("b")).select(F.col("c").alias("bc"), "b")
    judged = group.join(best, F.col("c") == F.col("bc")).select("d", "x", "n", (F.col("d").eqNullSafe(F.col("b.d")) & (F.col("x") == F.col("b.x"))).alias("stays"))
    judged = cut(spark, judged, f"{tag}-judged")

    def among(keys: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        keys = keys.select(F.col("d").alias("__d"), F.col("x").alias("__x"))
        return rows.join(keys, F.col(doc_id).eqNullSafe(F.col("__d")) & (F.xxhash64(F.col(text)) == F.col("__x")), how)

    kept = among(judged.filter("not stays"), "left_anti", df)
    repeated = judged.filter("stays and n > 1")
    if repeated.take(1):  # rows that share id and text are seldom: only these are shuffled
        once = among(repeated, "left_semi", kept).dropDuplicates([doc_id, text])
        kept = among(repeated, "left_anti", kept).unionByName(once)
    return kept
