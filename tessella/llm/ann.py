"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions and put in the order of several Hilbert curves, each with a
projection and a shift of its own, by range partitioning.  A query meets what stands within a window of
ranks of it on every curve; what is found along all curves is merged and reranked by exact distances.

The window is fitted: for a bounded sample of the queries the true neighbours are found by a scan, and the
window is the number of ranks within which some curve has the wanted part of them.  How near the curves
bring neighbours hangs on the vectors.  Where these have no structure, windows grow with the table and
the search is no cheaper than a scan; its recall stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard
from .vectors import matrix, packed, rotation

#: Curves, projected dimensions and bits of each: a key has 56 bits.
CURVES, DIMS, BITS = 8, 8, 7
#: Queries whose true neighbours fit the window, and the part of these that it must hold.
SAMPLE, RECALL = 256, 0.97
#: Ranks of the least window, rows of the largest cell that a task searches, and queries of a block.
LEAST, CELL, QUERIES = 512, 4096, 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of cells with `bits` bits in each dimension."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # undo the turns of each level, from the coarsest on; then Gray-code along the dimensions
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) > 0
            t = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def projected(x: np.ndarray, curve: int) -> np.ndarray:
    d = x.shape[1]
    return x @ rotation(d, 100 + curve)[:, : min(DIMS, d)]


def curve_keys(p: np.ndarray, scale: float, curve: int) -> np.ndarray:
    """Keys of projected vectors: `scale` on either side makes half of a curve's box, in which each curve shifts it anew."""
    shift = np.random.default_rng([curve, p.shape[1]]).random(p.shape[1]) / 2
    at = np.clip((p / scale + 1) / 4, 0, 0.5) + shift
    return hilbert(np.floor(at * (1 << BITS)).clip(0, (1 << BITS) - 1).astype(np.int64), BITS)


def _with_keys(scale: float, kind: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), kind)
                for curve in range(CURVES):
                    k = curve_keys(projected(x, curve), scale, curve)
                    yield pa.RecordBatch.from_arrays([pa.array([curve] * len(k), pa.int32()), pa.array(k), b.column(0)], names=["curve", "key", "row"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        at = pa.array(np.arange(n, n + b.num_rows))
        n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int32()), at, *b.columns], names=["part", "at", *b.schema.names])


def ranked(spark: SparkSession, df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """Append `rank`, from 0, in the order of columns whose values are unique: range-partitioned, sorted, numbered.

    What reaches the driver is one count for each partition.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    done = cut(spark, df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, f"part int, at long, {kinds}"), tag)
    counts = sorted((r["part"], r["n"]) for r in done.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets = dict(zip((p for p, _ in counts), np.cumsum([0, *(n for _, n in counts)]).tolist(), strict=False))
    offset = F.element_at(F.create_map(*(F.lit(x) for p, n in offsets.items() for x in (p, n))), F.col("part")) if offsets else F.lit(0)
    return done.withColumn("rank", (F.col("at") + offset).cast("long")).drop("part", "at")


def nearest(q: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, skip: np.ndarray, x_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, position in x, distance) of the k nearest rows to each query, but for its own row.

    Products find who is near; whoever may be among the k gets its distance from the differences.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    big = float((x * x).sum(axis=1).max(initial=0))
    for at in range(0, len(q), 256):
        p = q[at : at + 256]
        far = (p * p).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (p @ x.T)
        far[skip[at : at + 256][:, None] == x_row[None, :]] = np.inf
        slack = 1e-9 * ((p * p).sum(axis=1) + big) + 1e-300
        limit = np.partition(far, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(p), np.inf)
        i, j = np.nonzero(far <= (limit + slack)[:, None])
        keep = np.isfinite(far[i, j])
        i, j = i[keep], j[keep]
        d = np.empty(len(i))
        for a in range(0, len(i), 1 << 16):
            z = p[i[a : a + (1 << 16)]] - x[j[a : a + (1 << 16)]]
            total = np.zeros(len(z))
            for c in range(z.shape[1]):  # component by component, so that the sum hangs on nothing else
                total += z[:, c] * z[:, c]
            d[a : a + (1 << 16)] = np.sqrt(total)
        o = np.lexsort((x_id[j], d, i))
        i, j, d = i[o], j[o], d[o]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        few = place < k
        out.append((i[few] + at, j[few], d[few]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


FOUND = "q_row long, query_id long, row long, vec_id long, score double"


def _search(k: int, window: int, kind: str):  # noqa: ANN202
    """Queries (right) against the rows of one cell (left): the k nearest of these to each whose window reaches the cell."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        i = j = np.zeros(0, np.int64)
        d = np.zeros(0)
        if left.num_rows and right.num_rows:
            at, q_at = left["rank"].to_numpy(), right["rank"].to_numpy()
            meets = np.nonzero((q_at >= at.min() - window) & (q_at <= at.max() + window))[0]
            right = right.take(pa.array(meets))
        if left.num_rows and right.num_rows:
            i, j, d = nearest(matrix(right["v"], kind), matrix(left["v"], kind), left["vec_id"].to_numpy(), k, right["row"].to_numpy(), left["row"].to_numpy())
        i, j = pa.array(i), pa.array(j)
        return pa.table({"q_row": right["row"].take(i), "query_id": right["vec_id"].take(i), "row": left["row"].take(j), "vec_id": left["vec_id"].take(j), "score": pa.array(d)})

    return run


def _scan(q_row: np.ndarray, q_id: np.ndarray, q: np.ndarray, k: int, kind: str):  # noqa: ANN202
    """A few queries against all rows: the k nearest of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, j, d = nearest(q, matrix(b.column(2), kind), b.column(1).to_numpy(), k, q_row, b.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(q_row[i]), pa.array(q_id[i]), b.column(0).take(pa.array(j)), b.column(1).take(pa.array(j)), pa.array(d)], names=["q_row", "query_id", "row", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query with their rank, merged over all groups; a row found twice counts once.

    The rank's limit is applied before rows are shuffled, too, so no query gathers more than k from a task.
    """
    order = Window.partitionBy("q_row").orderBy("score", "vec_id", "row")
    each = found.groupBy("q_row", "query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fitted_window(spark: SparkSession, rows: DataFrame, along: DataFrame, is_query: str, k: int, kind: str, tag: str) -> int:
    """Ranks within which, on some curve, RECALL of the true neighbours of up to SAMPLE queries stand.

    What reaches the driver are the sample's vectors and a distance in ranks for each of its neighbours.
    """
    sample = rows.filter(is_query).orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return LEAST
    scan = _scan(sample["row"].to_numpy(), sample["vec_id"].to_numpy(), matrix(sample["v"], kind), k, kind)
    true = cut(spark, _best(rows.mapInArrow(scan, FOUND), k).select("q_row", "row"), f"{tag}-true")
    ends = F.broadcast(true.select(F.col("q_row").alias("row")).union(true.select("row")).distinct())  # SAMPLE * (k + 1) at most
    placed = cut(spark, along.join(ends, "row").select("curve", "row", "rank"), f"{tag}-placed")
    one = placed.select("curve", F.col("row").alias("q_row"), F.col("rank").alias("at"))
    apart = true.join(one, "q_row").join(placed, ["curve", "row"]).groupBy("q_row", "row").agg(F.min(F.abs(F.col("at") - F.col("rank"))).alias("d"))
    d = apart.select("d").toArrow()["d"].to_numpy()
    discard(spark, true, placed)
    return max(LEAST, int(np.ceil(np.quantile(d, RECALL)))) if len(d) else LEAST


def nearest_neighbours(df: DataFrame, queries: str, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, tag: str = "ann") -> DataFrame:
    """(query_id, rank, vec_id, score): k rows near to each query by Euclidean distance, nearest first, ties to the smaller vec_id.

    `queries` is an SQL condition on vec_id that names the query rows.  Every row but the query's own is
    a candidate, so rows that repeat an id or a vector are found, too.  Distances are exact; the rows are the
    nearest of those in the windows.  Null, empty and zero vectors and
    those that hold a null or a component that isn't finite take no part, nor do rows with a null id;
    other dimensions than the smallest there is are an error.  An empty table gives an empty one; other
    columns are ignored.
    """
    spark = df.sparkSession
    element = df.schema[embedding].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    src = packed(df, vec_id, embedding, kind=kind).filter("vec_id is not null and v is not null").select("vec_id", "v")
    # a row's name: position in the order of its id and vector
    rows = ranked(spark, src.withColumn("tie", F.xxhash64("v")), ["vec_id", "tie"], f"{tag}-rows").select(F.col("rank").alias("row"), "vec_id", "v")
    shape = rows.agg(F.min(F.octet_length("v")), F.max(F.octet_length("v"))).first()
    if shape[0] != shape[1]:
        raise ValueError("the vectors differ in their number of dimensions")
    width = (shape[0] or 0) // int(kind[2]) or 1
    # the box of a projection: three deviations of components that have the root mean square of all
    spread = rows.mapInArrow(_squares(kind), "s double, n long").agg(F.sum("s"), F.sum("n")).first()
    scale = 3.0 * float(np.sqrt(max(spread[0] or 1.0, 1e-300) / max(spread[1] or 1, 1) / width))
    keyed = rows.select("row", "v").mapInArrow(_with_keys(scale, kind), "curve int, key long, row long")
    # curves follow each other in one ranking
    along = ranked(spark, keyed, ["curve", "key", "row"], f"{tag}-curves").select("curve", "row", "rank")
    window = fitted_window(spark, rows, along, queries, k, kind, tag)
    cell = min(window, CELL)
    # queries in blocks along the curves; the cells that a block's windows reach
    asks = ranked(spark, along.join(rows.filter(queries).select("row"), "row", "left_semi").select(F.col("rank").alias("place"), "curve", "row"), ["place"], f"{tag}-asks")
    asks = asks.select(F.col("place").alias("rank"), "curve", "row", F.floor(F.col("rank") / QUERIES).cast("long").alias("block"))
    reach = asks.groupBy("block").agg(F.floor((F.min("rank") - window) / cell).cast("long").alias("lo"), F.floor((F.max("rank") + window) / cell).cast("long").alias("hi"))
    meetings = cut(spark, reach.select("block", F.explode(F.sequence("lo", "hi")).alias("cell")), f"{tag}-meetings")
    left = along.withColumn("cell", F.floor(F.col("rank") / cell).cast("long")).join(meetings, "cell").join(rows, "row")
    left = left.select("curve", "cell", "block", "rank", "row", "vec_id", "v").groupBy("curve", "cell", "block")
    reached = F.explode(F.sequence(F.floor((F.col("rank") - window) / cell).cast("long"), F.floor((F.col("rank") + window) / cell).cast("long")))
    right = cut(spark, asks.withColumn("cell", reached).join(rows, "row").select("curve", "cell", "block", "rank", "row", "vec_id", "v"), f"{tag}-reached").groupBy("curve", "cell", "block")
    seen = cut(spark, left.cogroup(right).applyInArrow(_search(k, window, kind), FOUND), f"{tag}-seen")
    return _best(seen, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _squares(kind: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(b.schema.get_field_index("v")), kind)
                yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum())]), pa.array([len(x)], pa.int64())], names=["s", "n"])

    return run
