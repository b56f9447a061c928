"""What the training-data operators share: durable cuts, Arrow column mapping, union-find."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space, as in every contract here.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch between Spark and a Python worker, unless one row alone has more.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local session without one (tests) gets its own.

    A cluster without that setting is an error: no folder of one machine would do.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "/tmp/checkpoints/tessella"
    return d.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes: whole texts are long, and ten thousand of them longer."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def cut(spark: SparkSession, df: DataFrame, tag: str, partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back.

    This ends the lineage durably (a lost executor costs no recomputation of what stands before the
    cut), fixes what is not deterministic, and gives the planner real sizes.  The files go when the
    application ends, or with discard().
    """
    small_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    w = df.write.options(**(options or {}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut = path
    return back


def discard(spark: SparkSession, *cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more: whatever was made of them is cut itself."""
    for df in cuts:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._cut)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, *names: str) -> None:
    """Reject a clash between the columns an operator adds and those the input has."""
    have = {c.lower() for c in df.columns}
    for n in names:
        if n.lower() in have:
            raise ValueError(f"the input already has a column {n!r}; rename it or choose another output name")


def map_column(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list], list[pa.Array]]],
    carry: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from one column, an Arrow batch at a time.

    `make` runs once in each task and returns the function from the column's Python values to Arrow
    arrays.  `carry` names the input columns that are kept (all by default); only `column` itself goes
    to the worker, and only the new columns come back.
    """
    carry = list(df.columns) if carry is None else list(carry)
    fresh(df.select(*carry), *(f.name for f in fields))
    small_batches(df.sparkSession)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for b in batches:
            # long texts: work on slices, so that what is held as Python objects stays small
            parts = [pa.StructArray.from_arrays(f(b.slice(at, 256).to_pylist()), names=names) for at in range(0, len(b), 256)]
            yield pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays(f([]), names=names)

    # the annotations name the kind of function that arrow_udf makes of it
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # evaluated once, wherever its results are filtered or used twice
    new = F.arrow_udf(run, T.StructType(fields)).asNondeterministic()
    out = df.select(*(F.col(c) for c in carry), new(F.col(column)).alias("__new"))
    return out.select(*carry, *(F.col("__new")[n].alias(n) for n in names))


def words_of(text: str | None) -> list[bytes]:
    """Contract words of a text, A-Z lower-cased: bytes.split() parts at exactly x20 and x09-x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over one block of edges: (node, smallest node of its component), roots left out."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while True:  # pointer jumping
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]
