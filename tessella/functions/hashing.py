"""Hashes, rolling hashes and Bloom filters."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M32 = 0xFFFFFFFF
#: Start value: a fixed value.
STRING_SEED = 0x79F862AAC9CC5A8E


def adler32(raw: bytes) -> int:
    return zlib.adler32(raw)


def super_fast_hash(raw: bytes) -> int:
    """The public SuperFastHash of 32 bits: 16-bit words in pairs, signed bytes at the tail; 0 for nothing."""
    if not raw:
        return 0
    h = len(raw) & _M32
    words = np.frombuffer(raw[: len(raw) // 4 * 4], "<u2").tolist()
    for a, b in zip(words[::2], words[1::2], strict=True):
        h = (h + a) & _M32
        h = ((h << 16) ^ ((b << 11) ^ h)) & _M32
        h = (h + (h >> 11)) & _M32
    tail = raw[len(raw) // 4 * 4 :]
    signed = lambda x: x - 256 if x > 127 else x
    if len(tail) == 3:
        h = (h + int.from_bytes(tail[:2], "little")) & _M32
        h ^= h << 16 & _M32
        h ^= signed(tail[2]) << 18 & _M32
        h = (h + (h >> 11)) & _M32
    elif len(tail) == 2:
        h = (h + int.from_bytes(tail, "little")) & _M32
        h ^= h << 11 & _M32
        h = (h + (h >> 17)) & _M32
    elif len(tail) == 1:
        h = (h + signed(tail[0])) & _M32
        h ^= h << 10 & _M32
        h = (h + (h >> 1)) & _M32
    for left, right in ((3, 5), (4, 17), (25, 6)):
        h ^= h << left & _M32
        h = (h + (h >> right)) & _M32
    return h


def shift_add_text(raw: bytes, seed: int = STRING_SEED) -> int:
    """Shift-add-xor over signed bytes in 64 bits; the hash of a first part is the seed of a second."""
    x = seed
    for b in raw:
        x ^= ((x << 7) + (x >> 3) + (b - 256 if b > 127 else b)) & 0xFFFFFFFFFFFFFFFF
    return x


def _column(f, kind: str, c: Column) -> Column:  # noqa: ANN001
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else f(x.encode())), kind)(c)


def shift_add_hash(c: Column) -> Column:
    """As a decimal text, as the number has no sign."""
    return _column(lambda raw: str(shift_add_text(raw)), "string", c)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _byte(raw: Column, i: Column) -> Column:
    """Byte i, from 0, as a number."""
    return F.conv(F.hex(F.substring(raw, i + 1, F.lit(1))), 16, 10).cast("long")


def super_fast_column(c: Column) -> Column:
    """super_fast_hash of a text's bytes, on the JVM: a fold over words of 32 bits, then the tail."""
    low = lambda x: x.bitwiseAND(F.lit(_M32))
    signed = lambda x: F.when(x > 127, x - 256).otherwise(x)
    spread = lambda left: lambda x: x.bitwiseXOR(low(F.shiftleft(x, left)))
    added = lambda h, right: _let(h, lambda x: low(x + F.shiftright(x, right)))

    def hashed(raw: Column) -> Column:
        n = F.octet_length(raw)
        word = lambda i: _byte(raw, i) + _byte(raw, i + 1) * 256
        mixed = lambda h, k: added(_let(low(h + word(k * 4)), lambda x: low(F.shiftleft(x, 16).bitwiseXOR(F.shiftleft(word(k * 4 + 2), 11).bitwiseXOR(x)))), 11)
        groups = F.when(n >= 4, F.sequence(F.lit(0), F.floor(n / 4).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        body = F.aggregate(groups, n.cast("long"), mixed)
        at = (n - n % 4).cast("int")
        three = lambda h: added(_let(low(h + word(at)), lambda x: low(x.bitwiseXOR(F.shiftleft(x, 16)).bitwiseXOR(F.shiftleft(signed(_byte(raw, at + 2)), 18)))), 11)
        two = lambda h: added(_let(low(h + word(at)), lambda x: x.bitwiseXOR(low(F.shiftleft(x, 11)))), 17)
        one = lambda h: added(_let(low(h + signed(_byte(raw, at))), lambda x: x.bitwiseXOR(low(F.shiftleft(x, 10)))), 1)
        out = _let(body, lambda h: F.when(n % 4 == 3, three(h)).when(n % 4 == 2, two(h)).when(n % 4 == 1, one(h)).otherwise(h))
        for left, right in ((3, 5), (4, 17), (25, 6)):
            out = added(_let(out, spread(left)), right)
        return F.when(n == 0, F.lit(0).cast("long")).otherwise(out)

    return _let(F.encode(c, "UTF-8"), hashed)


def adler_column(c: Column) -> Column:
    """Adler-32 of a text's bytes, on the JVM."""
    def summed(raw: Column) -> Column:
        start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
        step = lambda s, i: _let((s["a"] + _byte(raw, i)) % 65521, lambda a: F.struct(a.alias("a"), ((s["b"] + a) % 65521).alias("b")))
        each = F.when(F.octet_length(raw) > 0, F.sequence(F.lit(0), F.octet_length(raw) - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(raw.isNotNull(), F.aggregate(each, start, step, lambda s: s["b"] * 65536 + s["a"]))

    return _let(F.encode(c, "UTF-8"), summed)


class RollingHash:
    """A polynomial hash of the last `window` bytes, modulo a number."""

    def __init__(self, window: int, modulus: int = (1 << 56) - 5, base: int = 257) -> None:
        self.window, self.modulus, self.base = window, modulus, base

    def hashes(self, raw: bytes) -> Iterator[int]:
        """One for each full window, from left to right."""
        out, top = 0, pow(self.base, self.window, self.modulus)
        for i, b in enumerate(raw):
            out = (out * self.base + b + 1) % self.modulus
            if i >= self.window:
                out = (out - top * (raw[i - self.window] + 1)) % self.modulus
            if i >= self.window - 1:
                yield out


class BloomFilter:
    """Bits of several hashes of each item; no item that was put in is missed."""

    def __init__(self, bits: int, hashes: int, data: np.ndarray | None = None) -> None:
        if bits < 8 or hashes < 1:
            raise ValueError("a filter has eight bits and one hash at least")
        self.bits, self.hashes = bits, hashes
        self.data = np.zeros((bits + 7) // 8, np.uint8) if data is None else data

    @staticmethod
    def sized(items: int, error: float = 0.01) -> BloomFilter:
        bits = max(64, int(-items * np.log(error) / np.log(2) ** 2) + 1)
        return BloomFilter(bits, max(1, round(bits / max(1, items) * float(np.log(2)))))

    def _at(self, items: Iterable[str]) -> np.ndarray:
        import xxhash

        h = np.array([xxhash.xxh128_intdigest(x) for x in items], object)
        a = np.array([int(x) & 0xFFFFFFFFFFFFFFFF for x in h], np.uint64)
        b = np.array([int(x) >> 64 | 1 for x in h], np.uint64)
        return (a[:, None] + b[:, None] * np.arange(self.hashes, dtype=np.uint64)[None, :]) % np.uint64(self.bits)

    def insert(self, items: Iterable[str]) -> None:
        at = self._at(items).ravel()
        np.bitwise_or.at(self.data, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))

    def contains(self, items: Iterable[str]) -> np.ndarray:
        at = self._at(items)
        got = self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        return got.astype(bool).all(axis=1)

    def union(self, other: BloomFilter) -> BloomFilter:
        if (self.bits, self.hashes) != (other.bits, other.hashes):
            raise ValueError("filters with other parameters can't be joined")
        return BloomFilter(self.bits, self.hashes, self.data | other.data)

    def dumps(self) -> bytes:
        return self.bits.to_bytes(8, "little") + self.hashes.to_bytes(4, "little") + self.data.tobytes()

    @staticmethod
    def loads(raw: bytes) -> BloomFilter:
        bits, hashes = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:12], "little")
        if len(raw) != 12 + (bits + 7) // 8:
            raise ValueError("not a filter")
        return BloomFilter(bits, hashes, np.frombuffer(raw[12:], np.uint8).copy())


def bloom_of(df: DataFrame, column: str, bits: int, hashes: int) -> BloomFilter:
    """The filter of a column: one from each task, or-ed in rounds on the executors until one is left.

    Its size is a parameter, not the data's.
    """
    size = (bits + 7) // 8

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = BloomFilter(bits, hashes)
        for b in batches:
            f.insert(x for x in b["x"] if x is not None)
        yield pd.DataFrame({"g": [0], "f": [f.data.tobytes()]})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = np.zeros(size, np.uint8)
        for b in batches:
            for f in b["f"]:
                data |= np.frombuffer(f, np.uint8)
        yield pd.DataFrame({"g": [0], "f": [data.tobytes()]})

    parts = df.select(F.col(column).cast("string").alias("x")).mapInPandas(fill, "g int, f binary")
    one = parts.repartition(8).mapInPandas(join, "g int, f binary").coalesce(1).mapInPandas(join, "g int, f binary").first()
    return BloomFilter(bits, hashes, np.frombuffer(bytes(one["f"]), np.uint8).copy() if one else None)


def digest_text(raw: bytes) -> str:
    return base64.b64encode(raw).decode()
