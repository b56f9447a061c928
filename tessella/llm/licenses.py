"""Licence scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Templates are few and given, so their inverted index goes to every task with the code: its size hangs on
the templates alone.  Texts and templates are sequences of words; of every window of consecutive word
shingles, the one with the least hash is a fingerprint.  A passage of a text that has SHINGLE + WINDOW - 1
words in a row with a template has a fingerprint with it, at least.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_column
from .license_texts import TEMPLATES

#: Words of a shingle, shingles of a window, and the part of a template that must match.
SHINGLE, WINDOW, COVERAGE = 3, 2, 0.8
#: Words that a match may drift from its diagonal, as a part of the template (two at least).
DRIFT = 0.2

_WORDS = re.compile("[a-z0-9]+")


def fingerprints(shingles: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window, the last one of equals."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.int64)
    w = min(window, n)
    views = np.lib.stride_tricks.sliding_window_view(shingles, w)[:, ::-1]
    return np.unique(np.arange(len(views)) + w - 1 - views.argmin(axis=1))


class Index:
    """Templates by name, their vocabulary, and where their fingerprints occur."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.names = [n for n, texts in templates.items() for _ in texts]
        self.vocabulary: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        for texts in templates.values():
            for t in texts:
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in _WORDS.findall(t.lower())], np.int64))
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for i, w in enumerate(self.words):
            s = self.shingles(w)
            for at in fingerprints(s).tolist():
                self.postings.setdefault(int(s[at]), []).append((i, at))

    @staticmethod
    def shingles(words: np.ndarray) -> np.ndarray:
        """A hash of every shingle; those with a word that no template has come last."""
        n = len(words) - SHINGLE + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(SHINGLE):
            w = words[k : k + n]
            known &= w > 0
            h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.where(known, h >> np.uint64(1), np.uint64(1 << 63))

    def hits(self, words: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template, the (position in the text, in the template) of shared fingerprints."""
        s = self.shingles(words)
        known = np.nonzero(s < np.uint64(1 << 63))[0]
        out: dict[int, list[tuple[int, int]]] = {}
        if len(known):
            marks = fingerprints(s)
            for at in marks[s[marks] < np.uint64(1 << 63)].tolist():
                for i, place in self.postings.get(int(s[at]), ()):
                    out.setdefault(i, []).append((at, place))
        return out


def align(a: np.ndarray, b: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last position in b) of template a on text b with b's position within `band` of a's plus `shift`.

    Of all alignments in the band, one with the most matched words; of these, one with the shortest span.
    """
    width = 2 * band + 1
    # best[d]: (matched, -span) with the template's words so far and the text up to a_i + shift + d - band
    none = (0, 0, -1, -1)
    row = [none] * (width + 1)
    for i, word in enumerate(a.tolist()):
        new = [none] * (width + 1)
        left = none
        for d in range(width):
            j = i + shift + d - band
            best = max(row[d + 1], left)
            if 0 <= j < len(b) and b[j] == word:
                m, _, first, _ = row[d]
                start = j if m == 0 else first
                best = max(best, (m + 1, start - j, start, j))
            new[d] = left = best
        row = new
    m, _, first, last = max(row)
    return m, first, last


def scan(index: Index, text: str | None, coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(licence, coverage, matched words, start, end) of each match, spans in characters; none overlap."""
    if not text:
        return []
    found = _WORDS.findall(low := _lower(text))
    words = np.fromiter(map(index.vocabulary.get, found, _zeros()), np.int64, len(found))
    if np.count_nonzero(words) < SHINGLE:
        return []
    hits = index.hits(words)
    if not hits:
        return []
    spans = [m.span() for m in _WORDS.finditer(low)]
    matches = []
    for i, pairs in hits.items():
        a = index.words[i]
        band = max(2, int(len(a) * DRIFT))
        done: list[int] = []
        for at, place in pairs:
            shift = at - place
            if any(abs(shift - s) <= band // 2 for s in done):
                continue
            done.append(shift)
            lo = max(0, shift - band)
            m, first, last = align(a, words[lo : shift + len(a) + band + 1], shift - lo, band)
            if m >= coverage * len(a):
                matches.append((m, m / len(a), i, lo + first, lo + last))
    # of overlapping matches the one with the most words stays; of equals, the higher coverage, then the earlier
    out: list[tuple[int, float, int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for x in sorted(matches, key=lambda x: (-x[0], -x[1], x[3], index.names[x[2]])):
        if all(x[4] < s or x[3] > e for s, e in taken):
            taken.append((x[3], x[4]))
            out.append(x)
    return sorted((index.names[i], c, m, spans[s][0], spans[e][1]) for m, c, i, s, e in out)


def _zeros():  # noqa: ANN202
    from itertools import repeat

    return repeat(0)


_FOLD = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    """A-Z only, so that positions stay."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


FIELD = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("matched", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_licenses(df: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE, out: str = "licenses", carry: list[str] | None = None) -> DataFrame:
    """Append the licence matches of a text: an array of (license, coverage, matched, start, end), empty where there are none.

    Texts are read whole.  Nulls and empty texts have no match; rows that repeat are treated alike; an
    empty table gives an empty one; other columns pass, and a clash with `out` is an error.  Where
    matches overlap, the one with the most words is reported.  Nothing is shuffled.
    """
    given = templates or TEMPLATES

    def make() -> Callable[[list], list[pa.Array]]:
        index = Index(given)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        names = ("license", "coverage", "matched", "start", "end")
        return lambda texts: [pa.array([[dict(zip(names, x, strict=True)) for x in scan(index, t, coverage)] for t in texts], kind)]

    return map_column(df, text, [T.StructField(out, FIELD)], make, carry)


def license_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """One row for each match: (doc_id, license, coverage, matched, start, end)."""
    found = scan_licenses(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), carry=["doc_id"], **options)
    return found.select("doc_id", F.explode("licenses").alias("x")).select("doc_id", "x.license", "x.coverage", "x.matched", "x.start", "x.end")
