"""Record files: frames of a header and data, gzip'd or not; scores by place; managers that know a record's type."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the two headers, both of ten bytes: how they are packed, the order of their fields (l: length of the
#: data, t: type, v: version, f: flags), the byte order of each, and the most that versions and flags can be.
HEADERS = {"vega": ("<IIBB", "ltvf", 255, 255), "sirius": (">IHI", "tvl", 65535, 0)}
RECORD = "type string, version int, flags int, data binary"


def _type(name: str) -> int:
    raw = name.encode("latin-1")
    if len(raw) != 4:
        raise ValueError(f"a type has four characters: {name!r}")
    return int.from_bytes(raw, "little")


def _name(n: int) -> str:
    return n.to_bytes(4, "little").decode("latin-1")


def pack_record(kind: str, version: int, flags: int, data: bytes, header: str = "vega") -> bytes:
    form, order, versions, most = HEADERS[header]
    if not 0 <= version <= versions or not 0 <= flags <= most:
        raise ValueError(f"version {version} or flags {flags} don't fit the header")
    # the type's bytes stand in the file as they are, whatever the order of the numbers is
    code = _type(kind) if header == "vega" else int.from_bytes(kind.encode("latin-1"), "big")
    of = {"l": len(data), "t": code, "v": version, "f": flags}
    _type(kind)
    return struct.pack(form, *(of[x] for x in order)) + data


def unpack_records(raw: bytes, header: str = "vega") -> Iterator[tuple[str, int, int, bytes]]:
    """(type, version, flags, data) of each record; a file that ends within one is a ValueError."""
    form, order, _, _ = HEADERS[header]
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at, size = 0, struct.calcsize(form)
    while at < len(raw):
        if at + size > len(raw):
            raise ValueError("a header is cut off")
        of = dict(zip(order, struct.unpack_from(form, raw, at), strict=True))
        at += size + of["l"]
        if at > len(raw):
            raise ValueError("a record is cut off")
        name = _name(of["t"]) if header == "vega" else of["t"].to_bytes(4, "big").decode("latin-1")
        yield name, of["v"], of.get("f", 0), raw[at - of["l"] : at]


def framed(records: DataFrame, header: str = "vega", compress: bool = False) -> DataFrame:
    """(content): records (type, version, flags, data) as files' contents, one or more from each partition, of about 32 MB."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = bytearray()

        def file() -> pd.DataFrame:
            return pd.DataFrame({"content": [gzip.compress(bytes(out), mtime=0) if compress else bytes(out)]})

        for b in batches:
            for r in b.itertuples(index=False):
                out += pack_record(r.type, int(r.version), int(r.flags), bytes(r.data), header)
                if len(out) >= 32 << 20:
                    yield file()
                    out.clear()
        if out:
            yield file()

    return records.select("type", "version", "flags", "data").mapInPandas(run, "content binary")


def unframed(files: DataFrame, header: str = "vega") -> DataFrame:
    """(type, version, flags, data) of the records in files' contents."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                yield pd.DataFrame(list(unpack_records(bytes(raw), header)), columns=["type", "version", "flags", "data"])

    return files.select("content").mapInPandas(run, RECORD)


def read_framed(spark: SparkSession, path: str, header: str = "vega") -> DataFrame:
    """Record files, gzip'd or not, each read by one task."""
    return unframed(spark.read.format("binaryFile").load(path), header)


def write_files(contents: DataFrame, folder: str, suffix: str = ".rec") -> int:
    """Contents as files of a folder, through the driver one at a time; for exports of a size to match."""
    spark = contents.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    for r in contents.toLocalIterator():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n:06d}{suffix}"), False)
        out.write(bytearray(r["content"]))
        out.close()
        n += 1
    return n


def packed_records(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """(content): columns as fixed-size records of little-endian numbers (name, numpy type), a file for each batch."""
    import numpy as np

    kind = np.dtype([(n, f"<{t}") for n, t in fields])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = np.zeros(len(b), kind)
            for n, _ in fields:
                rows[n] = b[n].to_numpy()
            yield pd.DataFrame({"content": [rows.tobytes()]})

    return df.select(*(n for n, _ in fields)).mapInPandas(run, "content binary")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, score) of files of big-endian floats; a join on the place is the random access."""
    import numpy as np

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                x = np.frombuffer(raw, ">f4").astype(np.float64)
                yield pd.DataFrame({"file": name, "place": np.arange(len(x)), "score": x})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, place long, score double")


@dataclass(frozen=True)
class RecordKind:
    """What is known of a type and version: its sort key, its host's and its URL's key, its partition."""

    order: Callable[[bytes], bytes] | None = None
    host: Callable[[bytes], bytes] | None = None
    url: Callable[[bytes], bytes] | None = None
    partition: Callable[[bytes, int], int] | None = None


class Records:
    """Kinds by type and version."""

    def __init__(self) -> None:
        self.kinds: dict[tuple[str, int], RecordKind] = {}

    def register(self, kind: str, version: int, what: RecordKind) -> None:
        if (kind, version) in self.kinds:
            raise ValueError(f"{kind!r} {version} is registered")
        self.kinds[kind, version] = what

    def keyed(self, records: DataFrame, by: str = "order", out: str = "key") -> DataFrame:
        """Append the key of each record by its type's function; a type without one fails the job.  Order by it."""
        made = {k: getattr(v, by) for k, v in self.kinds.items() if getattr(v, by)}

        def run(kind: pd.Series, version: pd.Series, data: pd.Series) -> pd.Series:
            of = []
            for k, v, d in zip(kind, version, data, strict=True):
                if (k, v) not in made:
                    raise TypeError(f"no {by} for records of type {k!r}, version {v}")
                of.append(made[k, v](bytes(d)))
            return pd.Series(of)

        return records.withColumn(out, F.pandas_udf(run, "binary")("type", "version", "data"))

    def parted(self, records: DataFrame, parts: int, out: str = "part") -> DataFrame:
        """Append the partition of each record by its type's function."""
        made = {k: v.partition for k, v in self.kinds.items() if v.partition}

        def run(kind: pd.Series, version: pd.Series, data: pd.Series) -> pd.Series:
            return pd.Series([made[k, v](bytes(d), parts) for k, v, d in zip(kind, version, data, strict=True)])

        return records.withColumn(out, F.pandas_udf(run, "int")("type", "version", "data"))
