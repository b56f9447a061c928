"""What the operators on embeddings share: packing, validity, rotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Any value will do; it fixes the rotations.
SEED = 20


def packed(df: DataFrame, vec_id: str, embedding: str, label: str | None = None, kind: str = "<f8") -> DataFrame:
    """(vec_id, label, v) of every row: v holds the components (binary, doubles by default), null for vectors that take no part.

    These are null, empty and zero vectors and those that hold a null or a component that isn't finite.
    Single-precision components are widened exactly.
    """
    lab = F.col(label).cast("string") if label else F.lit(None).cast("string")
    src = df.select(F.col(vec_id).cast("long").alias("vec_id"), lab.alias("label"), F.col(embedding).cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for e in b.column(2):
                v = None
                if e.is_valid and len(e.values) and not e.values.null_count:
                    a = e.values.to_numpy(zero_copy_only=False)
                    if np.isfinite(a).all() and a.any():
                        v = a.astype(kind).tobytes()
                out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])

    return src.mapInArrow(run, "vec_id long, label string, v binary")


def matrix(column: pa.Array | pa.ChunkedArray, kind: str = "<f8") -> np.ndarray:
    """Rows of packed vectors of one dimension, as doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64, copy=False) if rows else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for each dimension and seed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))
