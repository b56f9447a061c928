"""Language-model scores: smoothed n-grams as an automaton of weighted arcs and failure arcs.

A state is a history that occurs in training: two words, one, or none.  Its arcs are the n-grams that go on
from it, and lead to the longest history that the new word ends.  What has no arc takes the failure arc, to
the state without the history's first word; the state without history has every word.  With Dirichlet
smoothing, c the counts and K the weight of the shorter history,

    p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K)      fail(h) = K / (c(h) + K)

so that arc(h, w) = p(w | h) where c(h w) > 0, and all that can follow a state sums up to one.

The automaton grows with the corpus and is never in one place.  Documents are read in chunks of a few
million tokens; a chunk asks, by sorted keys, for the counts of just its own words and n-grams;
ranges of keys sum up what all chunks report and answer each of them; then the chunk compiles the part of
the automaton that its documents can reach, and runs through them from left to right.  A word or n-gram is
sent once for each chunk that has it, so frequent ones make no hot key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, words_of

#: Tokens that a chunk holds, unless one document alone has more.
CHUNK_TOKENS = 1_500_000
#: Keys that a range should have, and the bytes of packed chunks that stand for one.
RANGE_KEYS, BYTES_A_KEY = 1_000_000, 2
#: Weight of the shorter history in states of one word and of two, as a number of observations.
PRIOR = (400.0, 10.0)
#: Words that have short names in keys, and the chunks whose frequent words they are.  They only make keys shorter.
NAMED, NAMERS = 65_535, 4
#: Tokens of a strip: texts are run through in strips, side by side.
STRIP = 256
#: Spark's setting that deletes shuffle files at the end of the execution that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Added to the unigram counts.
ADD = 0.1
#: What words can't be: the end of a text, and the start as a history.
END, START = b" ", b"\t"

_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; those without an id are trained on."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


_ZSTD = pa.Codec("zstd", 1)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, compressed: small numbers have empty planes."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unplanes(b: bytes, kind: type) -> np.ndarray:
    raw = _ZSTD.decompress(b[8:], int.from_bytes(b[:8], "little")) if int.from_bytes(b[:8], "little") else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b, np.uint64), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def gram_keys(words: list[np.ndarray], hashes: np.ndarray, names: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams, from columns of local words.

    Where all words have names, these are the key, with the n-gram's order; others have a hash of 63 bits
    (64-bit hashes of the words are mixed), marked by the lowest bit.
    """
    key, mixed = np.full(len(words[0]), len(words), np.uint64), np.full(len(words[0]), len(words), np.uint64)
    named = np.ones(len(words[0]), bool)
    for w in words:
        named &= names[w] > 0
        key = key << np.uint64(16) | names[w].astype(np.uint64)
        mixed = _mixed(mixed * _MIX[0] + hashes[w])
    return np.where(named, key << np.uint64(1), mixed | np.uint64(1))


class Chunk:
    """Token sequences of some documents over a vocabulary of their own: 0 is the end, 1 the start."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = _Numbered()
        self.vocabulary.update({END: 0, START: 1})
        self.docs: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        w = words_of(text)
        ids = np.empty(len(w) + 1, np.int32)
        ids[:-1] = np.fromiter(map(self.vocabulary.__getitem__, w), np.int32, len(w))
        ids[-1] = 0
        self.docs.append(doc_id)
        self.parts.append(ids)
        self.size += len(ids)


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _grams(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each position has: its pair (number in `pairs`, the sorted (word before << 32 | word)), and whether
    it has a triple, and the sorted triples (pair before << 32 | word).  A text's first word follows the start."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    starts = np.cumsum(lengths) - lengths
    before[starts] = 1
    pairs, pair = np.unique(before.astype(np.int64) << 32 | ids, return_inverse=True)
    second = np.ones(len(ids), bool)
    second[starts] = False
    triple = np.zeros(len(ids), np.int64)
    triple[1:] = pair[:-1] << 32 | ids[1:]
    return pairs, pair, second, triple


def _planned(x: dict) -> dict:
    """A chunk's row with its arrays: words and their hashes, tokens, pairs and triples."""
    from xxhash import xxh64_intdigest

    size = int.from_bytes(x["words"][:8], "little")
    words = _ZSTD.decompress(x["words"][8:], size, asbytes=True).split(b"\n")
    ids, lengths = _unplanes(x["ids"], np.int32), _unplanes(x["lengths"], np.int64)
    pairs, pair, second, triple = _grams(ids, lengths)
    triples, third = np.unique(triple[second], return_inverse=True)
    hashes = np.fromiter((xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    return {"words": words, "hashes": hashes, "ids": ids, "lengths": lengths, "pairs": pairs, "pair": pair, "triples": triples, "third": third, "second": second}


def _keyed(c: dict, names: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the chunk's words, and those of its pairs followed by its triples."""
    named = np.fromiter((names.get(w, 0) for w in c["words"]), np.int64, len(c["words"]))
    a, b = c["pairs"] >> 32, c["pairs"] & 0xFFFFFFFF
    at, w = c["triples"] >> 32, c["triples"] & 0xFFFFFFFF
    return c["hashes"], np.concatenate([gram_keys([a, b], c["hashes"], named), gram_keys([a[at], b[at], w], c["hashes"], named)])


def _dealt(keys: np.ndarray, log2: int, hashes: bool = False) -> tuple[np.ndarray, list[int]]:
    """Order of keys by range, then by key, and where ranges start and the last ends.

    Hashes go by their first bits, which a range's keys then share; keys of names by a hash of all but the last
    word's low byte, so that neighbours meet.  Both leave smaller differences to pack.
    """
    order = np.argsort(keys)
    k = keys[order]
    if not hashes:
        k = np.where(k & np.uint64(1) > 0, k, _mixed(k >> np.uint64(9)))
    r = (k >> np.uint64(64 - log2)).astype(np.uint16 if log2 <= 16 else np.int64)  # few bits: a radix sort
    by = np.argsort(r, kind="stable")
    return order[by], np.searchsorted(r[by], np.arange((1 << log2) + 1)).tolist()


CHUNKS = "chunk long, docs binary, no_id binary, lengths binary, ids binary, words binary"
ASKS = "chunk long, r int, keys binary, u binary, gkeys binary, g binary"


def _row(kinds: str, *values) -> pa.RecordBatch:  # noqa: ANN002
    of = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], of[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as chunks of token sequences."""
    part, number, c = TaskContext.get().partitionId(), count(), Chunk()

    def row() -> pa.RecordBatch:
        docs = np.fromiter((0 if d is None else d for d in c.docs), np.int64, len(c.docs))
        none = np.fromiter((d is None for d in c.docs), np.uint8, len(c.docs))
        lengths = np.fromiter(map(len, c.parts), np.int64, len(c.parts))
        words = b"\n".join(c.vocabulary)
        packed = len(words).to_bytes(8, "little") + _ZSTD.compress(words, asbytes=True)
        return _row(CHUNKS, part << 24 | next(number), _planes(docs), none.tobytes(), _planes(lengths), _planes(np.concatenate(c.parts)), packed)

    for b in batches:
        for at in range(0, b.num_rows, 256):
            s = b.slice(at, 256)
            for doc_id, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
                c.add(doc_id, text)
                if c.size >= CHUNK_TOKENS:
                    yield row()
                    c = Chunk()
    if c.docs:
        yield row()


def _ask(log2: int, names):  # noqa: ANN001, ANN202
    """Keys and training counts of each chunk's words and n-grams, a row for each range."""

    def rows_of(x: dict) -> Iterator[pa.RecordBatch]:
        c = _planned(x)
        ids, docs = _unplanes(x["docs"], np.int64), np.frombuffer(x["no_id"], np.uint8)
        train = np.repeat(np.fromiter((bool(z) or not held_out(int(d)) for d, z in zip(ids, docs, strict=True)), bool, len(ids)), c["lengths"])
        u = np.bincount(c["ids"][train], minlength=len(c["words"]))
        both = [np.bincount(c["pair"][train], minlength=len(c["pairs"])), np.bincount(c["third"][train[c["second"]]], minlength=len(c["triples"]))]
        keys, gkeys = _keyed(c, names.value)
        g = np.concatenate(both)
        uo, ua = _dealt(keys, log2, hashes=True)
        go, ga = _dealt(gkeys, log2)
        keys, u, gkeys, g = keys[uo], u[uo].astype(np.uint32), gkeys[go], g[go].astype(np.uint32)
        for r in range(1 << log2):
            i, j, k, m = ua[r], ua[r + 1], ga[r], ga[r + 1]
            if i < j or k < m:
                yield _row(ASKS, x["chunk"], r, _pack_keys(keys[i:j]), _planes(u[i:j]), _pack_keys(gkeys[k:m]), _planes(g[k:m]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                yield from rows_of(b.slice(at, 1).to_pylist()[0])

    return run


def _sum_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """Each list's keys with their sums over all lists; all counts, and the keys that have any."""
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")  # runs that are sorted already
    s = k[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    at = np.nonzero(first)[0]
    if not len(at):
        return [np.zeros(0, np.int64) for _ in keys], 0, 0
    sums = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], at)
    out = np.empty(len(k), np.int64)
    out[order] = sums[np.cumsum(first) - 1]
    return np.split(out, np.cumsum([len(x) for x in keys])[:-1]), int(sums.sum()), int((sums > 0).sum())


ANSWERS = "chunk long, r int, u binary, g binary, n long, v long"


def _answer(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    u, n, v = _sum_up([_unpack_keys(x["keys"]) for x in rows], [_unplanes(x["u"], np.uint32) for x in rows])
    g, _, _ = _sum_up([_unpack_keys(x["gkeys"]) for x in rows], [_unplanes(x["g"], np.uint32) for x in rows])
    # the range's totals go with one of its rows
    return pa.table({
        "chunk": pa.array([x["chunk"] for x in rows], pa.int64()), "r": pa.array([x["r"] for x in rows], pa.int32()),
        "u": pa.array(map(_planes, u), pa.binary()), "g": pa.array(map(_planes, g), pa.binary()),
        "n": pa.array([n, *[0] * (len(rows) - 1)], pa.int64()), "v": pa.array([v, *[0] * (len(rows) - 1)], pa.int64()),
    })


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Automaton:
    """The part of the model that one chunk can reach.

    States are numbered: 0 has no history, 1 + w that of a word, 1 + V + p that of a pair.  Arcs are sorted by
    (state << 32 | label) and have a weight and the state that they lead to; 0 has an arc for each label,
    every other state a failure arc.  `after`: the number of the pair that a triple's last two words are.
    """

    def __init__(self, words: np.ndarray, pairs: np.ndarray, c2: np.ndarray, triples: np.ndarray, c3: np.ndarray, total: int, distinct: int, prior: tuple[float, float], after: np.ndarray | None = None) -> None:
        v, (one, two) = len(words), prior
        p1 = (words + ADD) / (total + ADD * (distinct + 1))
        history = words.astype(np.float64)
        history[1] = words[0]  # as many starts as ends
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        p2 = (c2 + one * p1[b]) / (history[a] + one)
        pair, w = triples >> 32, triples & 0xFFFFFFFF
        if after is None:
            after = np.searchsorted(pairs, b[pair] << 32 | w)
        p3 = (c3 + two * p2[after]) / (c2[pair] + two)
        self.root, self.root_to = np.log10(p1), np.where((history > 0) & (np.arange(v) > 0), 1 + np.arange(v), 0)
        seen2, seen3 = np.nonzero(c2 > 0)[0], np.nonzero(c3 > 0)[0]
        # in order, as pairs and triples are
        self.code = np.concatenate([(1 + a[seen2]) << 32 | b[seen2], (1 + v + pair[seen3]) << 32 | w[seen3]])
        self.weight = np.log10(np.concatenate([p2[seen2], p3[seen3]]))
        # nothing follows the end of a text
        self.to = np.concatenate([np.where(b[seen2] > 0, 1 + v + seen2, 0), np.where(w[seen3] > 0, 1 + v + after[seen3], 0)])
        self.fail = np.log10(np.concatenate([[1.0], one / (history + one), two / (c2 + two)]))
        self.fail_to = np.concatenate([np.zeros(1 + v, np.int64), np.where(history[b] > 0, 1 + b, 0)])

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of reading one label in each of some states: failure arcs until there is an arc."""
        state, weight, to = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            s, w = state[left], label[left]
            done = s == 0
            end = left[done]
            weight[end] += self.root[label[end]]
            to[end] = self.root_to[label[end]]
            left, s, w = left[~done], s[~done], w[~done]
            if not len(left):
                break
            key = s << 32 | w
            at = np.searchsorted(self.code, key)
            hit = np.zeros(len(left), bool)
            inside = at < len(self.code)
            hit[inside] = self.code[at[inside]] == key[inside]
            go = left[hit]
            weight[go] += self.weight[at[hit]]
            to[go] = self.to[at[hit]]
            left = left[~hit]
            weight[left] += self.fail[state[left]]
            state[left] = self.fail_to[state[left]]
        return weight, to

    def run(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 weight of each text, read from left to right.

        Texts are cut into strips that are read side by side.  A state hangs on the last two words, so a
        strip is entered two words early, from the state without history, and has its state when it starts.
        """
        starts = np.cumsum(lengths) - lengths
        many = -(-lengths // STRIP)
        doc = np.repeat(np.arange(len(lengths)), many)
        first = STRIP * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
        size = np.minimum(STRIP, lengths[doc] - first)
        order = np.argsort(-size, kind="stable")
        doc, first, size = doc[order], first[order], size[order]
        state = np.where(first == 0, 2, 0)  # a text begins in the state of the start
        at = starts[doc] + first
        later = np.nonzero(first > 0)[0]
        for back in (2, 1):
            state[later] = self.step(state[later], ids[at[later] - back])[1]
        total = np.zeros(len(doc))
        for k in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -k))  # the strips that are longer than k
            weight, state[:n] = self.step(state[:n], ids[at[:n] + k])
            total[:n] += weight
        return np.bincount(doc, weights=total, minlength=len(lengths))


def _scorer(total: int, distinct: int, prior: tuple[float, float], log2: int, names):  # noqa: ANN001, ANN202
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        [x], answers = left.to_pylist(), sorted(right.select(["r", "u", "g"]).to_pylist(), key=lambda a: a["r"])
        c = _planned(x)
        docs, none = _unplanes(x["docs"], np.int64), np.frombuffer(x["no_id"], np.uint8)
        keys, gkeys = _keyed(c, names.value)
        words, grams = np.empty(len(keys), np.int64), np.empty(len(gkeys), np.int64)
        words[_dealt(keys, log2, hashes=True)[0]] = np.concatenate([_unplanes(a["u"], np.int64) for a in answers])
        grams[_dealt(gkeys, log2)[0]] = np.concatenate([_unplanes(a["g"], np.int64) for a in answers])
        n = len(c["pairs"])
        after = np.empty(len(c["triples"]), np.int64)
        after[c["third"]] = c["pair"][c["second"]]
        model = Automaton(words, c["pairs"], grams[:n], c["triples"], grams[n:], total, distinct, prior, after)
        ids, lengths = c["ids"].astype(np.int64), c["lengths"]
        starts = np.cumsum(lengths) - lengths
        out = [None if z else int(d) for d, z in zip(docs, none, strict=True)]
        return pa.table({
            "doc_id": pa.array(out, pa.int64()), "held_out": pa.array([held_out(d) for d in out], pa.bool_()),
            "n_tokens": pa.array(lengths), "n_known": pa.array(np.add.reduceat((words[ids] > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(docs), total)), "base_score": pa.array(np.add.reduceat(model.root[ids], starts)), "score": pa.array(model.run(ids, lengths)),
        })

    return score


def _frequent(chunks: DataFrame) -> dict[bytes, int]:
    """Names, from 1, of the most frequent words of some chunks."""
    seen: dict[bytes, int] = {}
    for x in chunks.select("ids", "words").head(NAMERS):  # an iterator over a limit would shuffle that many of each task
        size = int.from_bytes(x["words"][:8], "little")
        words = _ZSTD.decompress(bytes(x["words"][8:]), size, asbytes=True).split(b"\n")
        for w, n in zip(words, np.bincount(_unplanes(bytes(x["ids"]), np.int32), minlength=len(words)).tolist(), strict=True):
            seen[w] = seen.get(w, 0) + n
    best = sorted(seen, key=lambda w: (-seen[w], w))[:NAMED]
    return {w: i for i, w in enumerate(best, 1)}


def _answered(asked: DataFrame, tag: str) -> DataFrame:
    """The answers, written.  What was shuffled for them, the most that this operator writes, is deleted then, not
    when the driver happens to collect its garbage."""
    spark = asked.sparkSession
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return cut(spark, asked.groupBy("r").applyInArrow(_answer, ANSWERS), tag)
    finally:
        spark.conf.set(CLEANUP, held)


def lm_scores(df: DataFrame, doc_id: str = "doc_id", text: str = "text", prior: tuple[float, float] = PRIOR, tag: str = "lm") -> DataFrame:
    """Train on all texts but the held-out ones and score every text: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Null and empty texts are one end; rows that repeat, with or without an id, are texts of their own,
    and one without an id is trained on; an empty table gives an empty one; other columns are ignored,
    whatever their names.
    """
    spark = df.sparkSession
    small_batches(spark)
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = cut(spark, src.mapInArrow(_read, CHUNKS), f"{tag}-chunks")
    size = chunks.agg(F.sum(F.octet_length("ids") + F.octet_length("words"))).first()[0] or 0
    log2 = max(4, int(size / BYTES_A_KEY / RANGE_KEYS).bit_length())
    names = spark.sparkContext.broadcast(_frequent(chunks))
    asked = chunks.mapInArrow(_ask(log2, names), ASKS)
    answers = _answered(asked, f"{tag}-answers")
    total = answers.agg(F.sum("n"), F.sum("v")).first()
    score = _scorer(int(total[0] or 0), int(total[1] or 0), prior, log2, names)
    return chunks.groupBy("chunk").cogroup(answers.select("chunk", "r", "u", "g").groupBy("chunk")).applyInArrow(score, SCORES)
