"""Near-duplicate vectors by all pairs of a label, met in blobs that stay where they are.

Unit vectors link at a cosine of the threshold or more.  A label's distinct vectors are dealt into blobs
of bounded size by their digest and written once; a label of one blob meets itself, and of larger labels
every two blobs meet in a cartesian product that reads them from the shared folder.  So no vector is
shuffled more than once, however large its label, and disk grows as the table does; comparisons grow with
the square of a label's vectors.

A pair is looked at in single precision first, on a few rotated coordinates and the length of the rest:
by Cauchy-Schwarz its cosine is no more than their product.  What that leaves is verified on the whole
vectors in double precision.  No pairs leave a task: just how often each vector was linked, and a spanning
forest of the links.  Vectors that are equal are one node with a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, local_roots
from .graph import components
from .vectors import packed, rotation, unit

THRESHOLD = 0.93
#: Vectors of a blob, and bytes of their components (unless one vector has more); a task holds two blobs at once.
PART, PART_BYTES = 32_768, 8 << 20
#: Vectors of either side that are multiplied at once; their products stay in a core's cache.
TILE = 512
#: Large labels are met by groups of about so many bytes, as the blobs of a group are all read together; and no more groups than that.
GROUP_BYTES, GROUPS = 1 << 30, 64
#: Counts and links that a task gathers before it sums them up.
HELD = 500_000
#: Rows of megabytes: Parquet looks at their size before it has a hundred of them.
WRITE = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Types whose values single precision holds.
SINGLE = (T.FloatType, T.ByteType, T.ShortType)


def head_dims(d: int) -> int:
    """Rotated coordinates of the first look: of vectors spread evenly it leaves about one pair in 10^6."""
    return min(d, 18 + d // 7)


class Blob(NamedTuple):
    node: np.ndarray
    rep: np.ndarray
    n: np.ndarray
    x: np.ndarray  # unit vectors
    head: np.ndarray  # their first rotated coordinates and the length of the others, in single precision


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal vectors of a label in a batch, one row with their number and smallest id."""
    for b in batches:
        at: dict[tuple, int] = {}
        first, rep, n = [], [], []
        for i, (label, digest, vec_id) in enumerate(zip(*(b.column(c).to_pylist() for c in ("label", "digest", "rep")), strict=True)):
            k = at.setdefault((label, digest), len(first))
            if k == len(first):
                first.append(i)
                rep.append(vec_id)
                n.append(1)
            else:
                rep[k] = min(rep[k], vec_id)
                n[k] += 1
        some = b.take(pa.array(first, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [some.column("label"), some.column("digest"), some.column("dim"), some.column("v"), pa.array(rep, pa.int64()), pa.array(n, pa.int64())],
            names=["label", "digest", "dim", "v", "rep", "n"],
        )


def _pack(t: pa.Table) -> pa.Table:
    """One blob: nodes, smallest ids and numbers of its distinct vectors, then their components."""
    digest = t["digest"].to_pylist()
    at: dict[bytes, int] = {}
    place = np.array([at.setdefault(g, len(at)) for g in digest])
    first = np.zeros(len(at), np.int64)
    first[place[::-1]] = np.arange(len(place))[::-1]
    rep = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(rep, place, t["rep"].to_numpy())
    n = np.zeros(len(at), np.int64)
    np.add.at(n, place, t["n"].to_numpy())
    some = t.take(pa.array(first))
    blob = some["node"].to_numpy().astype("<i8").tobytes() + rep.astype("<i8").tobytes() + n.astype("<i8").tobytes() + b"".join(some["v"].to_pylist())
    keys = [t[c].combine_chunks()[:1] for c in ("grp", "label", "dim", "part")]
    return pa.table([*keys, pa.array([len(at)], pa.int32()), pa.array([blob], pa.binary())], names=["grp", "label", "dim", "part", "rows", "blob"])


def _opener(kind: str) -> Callable[[int, bytes], Blob]:
    turn = cache(rotation)

    def opened(rows: int, blob: bytes) -> Blob:
        node, rep, n = np.frombuffer(blob, "<i8", 3 * rows).reshape(3, rows)
        x = unit(np.frombuffer(blob, kind, offset=24 * rows).reshape(rows, -1).astype(np.float64))
        d = x.shape[1]
        y = x @ turn(d)[:, : head_dims(d)]
        rest = np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))
        return Blob(node, rep, n, x, np.column_stack([y, rest]).astype(np.float32))

    return opened


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots of places after the links (u, v) between places.

    Each round takes one open link of every place, so that a group in which all are linked costs a
    few passes over its links and no sort of them.
    """
    while True:
        a, b = root[u], root[v]
        some = np.nonzero(a != b)[0]
        if not len(some):
            return root
        u, v, a, b = u[some], v[some], a[some], b[some]
        one = np.full(len(root), -1)
        two = np.full(len(root), -1)
        one[u], two[v] = np.arange(len(u)), np.arange(len(v))
        pick = np.concatenate([one[one >= 0], two[two >= 0]])
        nodes, low = local_roots(a[pick], b[pick])
        to = np.arange(len(root))
        to[nodes] = low
        root = to[root]


def links_of(a: Blob, b: Blob | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(vectors linked with each, root of each) for the links between two blobs, or within the one; places in b follow those in a."""
    same = b is None
    b = a if same else b
    off = 0 if same else len(a.n)
    got = np.zeros(off + len(b.n), np.int64)
    root = np.arange(len(got))
    # single precision errs by less, whatever the order of its sums
    least = threshold - 4e-7 * (a.head.shape[1] + 4)
    room = np.empty(TILE * TILE, np.float32)
    for i0 in range(0, len(a.n), TILE):
        p = a.head[i0 : i0 + TILE]
        for j0 in range(i0 if same else 0, len(b.n), TILE):
            q = b.head[j0 : j0 + TILE]
            near = np.matmul(p, q.T, out=room[: len(p) * len(q)].reshape(len(p), len(q)))
            own = same and i0 == j0
            if own:
                np.fill_diagonal(near, -2)
            if near.max() < least:
                continue
            cols = np.nonzero(near.max(axis=0) >= least)[0]
            ok = near[:, cols] >= least
            if own:
                ok &= np.arange(len(p))[:, None] < cols
            rows = np.nonzero(ok.any(axis=1))[0]
            ok = ok[rows]
            rows, cols = rows + i0, cols + j0
            if np.count_nonzero(ok) * 8 > ok.size:
                ok &= a.x[rows] @ b.x[cols].T >= threshold
                got[rows] += (ok @ b.n[cols].astype(np.float64)).astype(np.int64)
                got[off + cols] += (a.n[rows].astype(np.float64) @ ok).astype(np.int64)
                i, j = np.nonzero(ok & (root[rows][:, None] != root[off + cols]))
                i, j = rows[i], cols[j]
            else:
                i, j = np.nonzero(ok)
                i, j = rows[i], cols[j]
                step = max(1, (4 << 20) // a.x.shape[1])
                yes = [np.einsum("ij,ij->i", a.x[i[z : z + step]], b.x[j[z : z + step]]) >= threshold for z in range(0, len(i), step)]
                yes = np.concatenate(yes) if yes else np.zeros(0, bool)
                i, j = i[yes], j[yes]
                got[i0 : i0 + len(p)] += np.bincount(i - i0, weights=b.n[j], minlength=len(p)).astype(np.int64)
                got[off + j0 : off + j0 + len(q)] += np.bincount(j - j0, weights=a.n[i], minlength=len(q)).astype(np.int64)
            if len(i):
                root = _joined(root, i, off + j)
    return got, root


def _meet(threshold: float, kind: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opener(kind)
        nodes, sums, tail, head = ([np.zeros(0, np.int64)] for _ in range(4))
        held = 0

        def out() -> pa.RecordBatch:
            node, at = np.unique(np.concatenate(nodes), return_inverse=True)
            total = np.zeros(len(node), np.int64)
            np.add.at(total, at, np.concatenate(sums))
            u, v = local_roots(np.concatenate(tail), np.concatenate(head))
            link = np.concatenate([np.zeros(len(node), bool), np.ones(len(u), bool)])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, u])), pa.array(np.concatenate([total, v])), pa.array(link)], names=["a", "b", "link"])

        last: tuple[bytes, Blob] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                rows, blob, others, other = (batch.column(c)[i].as_py() for c in range(4))
                # the left blob stays while the right ones pass
                if last is None or last[0] != blob:
                    last = blob, opened(rows, blob)
                a = last[1]
                b = None if other is None else opened(others, other)
                got, root = links_of(a, b, threshold)
                node, rep = (a.node, a.rep) if b is None else (np.concatenate([a.node, b.node]), np.concatenate([a.rep, b.rep]))
                linked, moved = np.nonzero(got)[0], np.nonzero(root != np.arange(len(root)))[0]
                nodes.append(node[linked])
                sums.append(got[linked])
                tail.append(rep[moved])
                head.append(rep[root[moved]])
                held += len(linked)
                if held > HELD:
                    yield out()
                    nodes, sums, tail, head = ([np.zeros(0, np.int64)] for _ in range(4))
                    held = 0
        if held:
            yield out()

    return run


def vector_groups(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = "label", threshold: float = THRESHOLD, tag: str = "vectors") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row with an id; links hold within a label, at a cosine of `threshold` or more.

    Vectors that are null, empty or zero, hold a null or a component that isn't finite, or have a null
    label link with nothing; neither do vectors of different dimensions.  Rows with a null id are left
    out; rows that repeat an id give a row each, link with each other where their vectors do, and are
    one node of the components.  An empty table gives an empty one; other columns are ignored.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold is a cosine between 0 and 1")
    spark = df.sparkSession
    of = df.select(embedding).schema[0].dataType
    kind = "<f4" if isinstance(getattr(of, "elementType", None), SINGLE) else "<f8"
    rows = packed(df, vec_id, embedding, label, kind).filter("vec_id is not null")
    if label is None:
        rows = rows.withColumn("label", F.lit(""))
    part = F.col("v").isNotNull() & F.col("label").isNotNull()
    digest = F.substring(F.unhex(F.sha2("v", 256)), 1, 16)
    rows = rows.select("vec_id", "label", F.when(part, digest).alias("digest"), (F.octet_length("v") / np.dtype(kind).itemsize).cast("int").alias("dim"), "v")
    members = cut(spark, rows.drop("v"), f"{tag}-rows")
    # equal vectors of a label are one node; the digest stands for the vector, which is written in its blob alone
    named = members.filter("digest is not null").groupBy("label", "digest", "dim").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    node = F.xxhash64("label", "digest").alias("node")
    named = cut(spark, named.select(node, "label", "digest", "dim", "rep", "n"), f"{tag}-named")
    size = F.greatest(F.count(F.lit(1)) / PART, F.count(F.lit(1)) * F.col("dim") * np.dtype(kind).itemsize / PART_BYTES)
    large = named.groupBy("label", "dim").agg(F.ceil(size).cast("int").alias("parts")).filter("parts > 1")
    large = cut(spark, large.select(F.col("label").alias("l"), F.col("dim").alias("d"), "parts"), f"{tag}-large")
    n_parts = large.agg(F.sum("parts")).first()[0] or 0
    groups = min(GROUPS, -(-n_parts * PART_BYTES // GROUP_BYTES))
    large = large.withColumn("grp", F.pmod(F.xxhash64("l", "d"), F.lit(max(1, groups))).cast("int"))
    src = rows.filter("digest is not null").select("label", "digest", "dim", "v", F.col("vec_id").alias("rep"))
    src = src.mapInArrow(_combine, "label string, digest binary, dim int, v binary, rep long, n long")
    src = src.join(F.broadcast(large), (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")), "left")
    where = F.coalesce(F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    src = src.select(F.coalesce("grp", F.lit(-1)).alias("grp"), "label", "dim", where, node, "digest", "rep", "n", "v")
    blobs = src.groupBy("grp", "label", "dim", "part").applyInArrow(_pack, "grp int, label string, dim int, part int, rows int, blob binary")
    blobs = cut(spark, blobs, f"{tag}-blobs", ["grp"], WRITE)
    out_type = "a long, b long, link boolean"
    alone = blobs.select("rows", "blob", F.lit(None).cast("int").alias("others"), F.lit(None).cast("binary").alias("other"))
    found = cut(spark, alone.mapInArrow(_meet(threshold, kind), out_type), f"{tag}-found")
    for g in range(groups):
        a = blobs.filter(F.col("grp") == g).select("label", "dim", "part", "rows", "blob")
        b = a.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("part").alias("q"), F.col("rows").alias("others"), F.col("blob").alias("other"))
        # of two blobs either may be the left one, so that no task has all pairs and none has no pairs
        once = F.when((F.col("part") + F.col("q")) % 2 == 0, F.col("part") < F.col("q")).otherwise(F.col("part") > F.col("q"))
        pairs = a.hint("shuffle_replicate_nl").join(b, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & once)
        pairs = pairs.select("rows", "blob", "others", "other")
        found = found.union(cut(spark, pairs.mapInArrow(_meet(threshold, kind), out_type), f"{tag}-found"))
    counts = found.filter("not link").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("m"))
    # an id with several vectors joins them: its rows are linked to the smallest ids of their nodes
    twice = members.filter("digest is not null").join(named.select("label", "digest", "rep"), ["label", "digest"]).filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    comp = components(spark, found.filter("link").select("a", "b").union(twice), tag)
    known = named.join(counts, "node", "left").select("label", "digest", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    out = members.select("vec_id", "label", "digest").join(known, ["label", "digest"], "left").join(comp, members["vec_id"] == comp["node"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
