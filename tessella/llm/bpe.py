"""Byte-level BPE as a deterministic automaton over tokens, and decoding by its arc labels.

The automaton starts as one state with a loop for each byte.  For each merge (u, v) -> w, in order of
rank, a merge gadget is put in: the state p that u leads to is copied without its v-arc, all u-arcs are
led to the copy, and every state with a u-arc gets a w-arc to where p's v-arc led.  The result accepts
just the token sequences that the merges make, one for each byte string.

Compiled, a state is two numbers, the state it copies and the arc it lacks, and a label three: the merge
that made it, its left part, and the state its arcs lead to (arcs of one label all lead to one state).
A transition is read off these tables: a label that is older than the state is there if the copied state
has it and it isn't the lacking one; a younger one is there if its left part is.

A word is encoded in one pass over its bytes.  Its prefixes each have a state; of the labels that end at a
byte (their trie, with failure links, yields them in one step a byte) just one has an arc from the state
where it starts, and that arc leads to the state of the longer prefix.  Decoding emits arc labels.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_column

#: Where this pattern's character classes are the same in all Unicode versions since 12; other texts
#: are split by the tokenizers library's own pre-tokenizer.
STABLE = "[^\x00-՗ -⁤⁰ⁱ⁴-₎₠-₿℀-↋ぁ-ゖ一-鿯가-힣]"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the standard library's classes are the same too; its matcher is the faster one.
LATIN = "[^\x00-\x1b\x20-\xb1´-¸º»¿-ɏ‐-‧]"
LATIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Entries of a worker's word cache; it is emptied when full.
CACHE = 250_000
#: Entries of a worker's tables of the trie's steps and of transitions that were read off; each is emptied when full.
MOVES = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges; pickles to a few MB, a size that the vocabulary bounds."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are compiled")
        vocab: dict[str, int] = model["vocab"]
        raw = {t: bytes(back[c] for c in t) for t in vocab}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.label: dict[int, bytes] = {i: raw[t] for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.arcs: dict[bytes, int] = {raw[t]: i for t, i in vocab.items() if len(raw[t]) == 1}
        # states, by the number of the gadget that made them: what each copies and the arc it lacks
        self.parent, self.lacks = array("i", [0]), array("i", [-1])
        # labels: the gadget that made them (0: a byte), their left part, and the state that their arcs lead to
        top = max(vocab.values()) + 1
        self.born, self.left, self.target = array("i", [-1]) * top, array("i", [-1]) * top, array("i", [-1]) * top
        for i in self.arcs.values():
            self.born[i] = self.target[i] = 0
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.born[w] >= 0:
                raise ValueError("two merges make one token")
            if self.born[u] < 0 or self.born[v] < 0 or not self.has(self.target[u], v):
                continue  # the arc is gone: this merge can never apply
            p, to = self.target[u], self.target[v]
            self.parent.append(p)
            self.lacks.append(v)
            self.target[u] = len(self.parent) - 1
            self.target[w], self.left[w], self.born[w] = to, u, len(self.parent) - 1
            self.arcs[raw[a + b]] = w

    def has(self, state: int, label: int) -> bool:
        """Whether the state has an arc with this label."""
        parent, lacks, born, left = self.parent, self.lacks, self.born, self.left
        while state or born[label]:
            if born[label] >= state:
                label = left[label]
            elif lacks[state] == label:
                return False
            else:
                state = parent[state]
        return True

    def step(self, state: int, label: int) -> int:
        """The state that the arc leads to, -1 where there is none."""
        return self.target[label] if self.has(state, label) else -1

    def ends(self) -> tuple[dict[int, int], list[int], list[tuple[tuple[int, int], ...]]]:
        """Trie of the arc labels with its failure links: steps by (node << 8 | byte), links, and for each
        node the (token, length) of the labels that end there, longest first."""
        step: dict[int, int] = {}
        own: list[int] = [-1]
        for label, t in self.arcs.items():
            at = 0
            for byte in label:
                k = at << 8 | byte
                at = step.get(k, 0)
                if not at:
                    own.append(-1)
                    at = step[k] = len(own) - 1
            own[at] = t
        below: dict[int, list[int]] = {}
        for k in step:
            below.setdefault(k >> 8, []).append(k)
        link, depth = [0] * len(own), [0] * len(own)
        found: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        level = [0]
        while level:
            after = []
            for at in level:
                for k in below.get(at, ()):
                    to, byte = step[k], k & 255
                    f = link[at]
                    while at and f and f << 8 | byte not in step:
                        f = link[f]
                    link[to] = step.get(f << 8 | byte, 0) if at else 0
                    depth[to] = depth[at] + 1
                    found[to] = (((own[to], depth[to]),) if own[to] >= 0 else ()) + found[link[to]]
                    after.append(to)
            level = after
        return step, link, found

    def encoder(self) -> Callable[[bytes], list[int]]:
        """A function from the bytes of one pre-split word to its tokens."""
        trie, link, found = self.ends()
        step = self.step
        table: dict[int, int] = {}  # transitions (state << 24 | label) that were read off
        jump: dict[int, int] = {}

        def move(k: int) -> int:
            at, byte = k >> 8, k & 255
            while at and at << 8 | byte not in trie:
                at = link[at]
            if len(jump) > MOVES:
                jump.clear()
            to = jump[k] = trie.get(at << 8 | byte, 0)
            return to

        def encode(word: bytes) -> list[int]:
            state, tokens, size = [0], [-1], [0]
            at = end = 0
            for byte in word:
                k = at << 8 | byte
                at = jump.get(k, -1)
                if at < 0:
                    at = move(k)
                end += 1
                for t, n in found[at]:
                    k = state[end - n] << 24 | t
                    to = table.get(k)
                    if to is None:
                        if len(table) > MOVES:
                            table.clear()
                        to = table[k] = step(state[end - n], t)
                    if to >= 0:
                        state.append(to)
                        tokens.append(t)
                        size.append(n)
                        break
            out = []
            while end:
                out.append(tokens[end])
                end -= size[end]
            out.reverse()
            return out

        return encode

    def packer(self) -> Callable[[str | None], bytes]:
        """A function from a text to its ids, packed as little-endian unsigned 32-bit integers."""
        import re

        import regex
        from tokenizers import pre_tokenizers

        find, odd = regex.compile(SPLIT).findall, regex.compile(STABLE).search
        latin_find, not_latin = re.compile(LATIN_SPLIT).findall, re.compile(LATIN).search
        other = pre_tokenizers.ByteLevel(add_prefix_space=False)
        parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        encode, special = self.encoder(), self.special

        class Words(dict):
            def __missing__(self, w: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                ids = array("I", encode(w.encode("utf-8"))).tobytes()
                if len(w) <= 64:
                    self[w] = ids
                return ids

        words = Words()

        def plain(text: str) -> bytes:
            if not not_latin(text):
                split = latin_find(text)
            elif odd(text):
                split = [text[a:b] for _, (a, b) in other.pre_tokenize_str(text)]
            else:
                split = find(text)
            return b"".join(map(words.__getitem__, split))

        def pack(text: str | None) -> bytes:
            if not text:
                return b""
            if parts is None or not parts.search(text):
                return plain(text)
            return b"".join(special[p].to_bytes(4, "little") if p in special else plain(p) for p in parts.split(text) if p)

        return pack

    def unpacker(self) -> Callable[[bytes | None], str]:
        """A function from packed ids to their text; ids that no arc has are left out, as are no specials."""
        label = self.label

        def unpack(ids: bytes | None) -> str:
            if not ids:
                return ""
            return b"".join([label.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")

        return unpack


_held: dict[str, tuple] = {}


def _once(key: str, make: Callable[[], object]) -> object:
    """Worker processes are used again: keep what the last task built."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def _compiled(df: DataFrame, path: str):  # noqa: ANN202
    return df.sparkSession.sparkContext.broadcast(Automaton(path))


def bpe_encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Append the packed token ids of `text` (binary, little-endian unsigned 32-bit).

    Nulls and empty texts give empty ids.  Rows that repeat are encoded alike; an empty table gives an
    empty one; every other column passes, and a clash with `out` is an error.  Nothing is shuffled.
    """
    shared = _compiled(df, path)

    def make():  # noqa: ANN202
        pack = _once(f"pack {path}", lambda: shared.value.packer())
        return lambda texts: [pa.array([pack(t) for t in texts], pa.binary())]

    return map_column(df, text, [T.StructField(out, T.BinaryType())], make, carry)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """Append the text of packed ids: the labels of the arcs they name, joined.  Null ids give an empty text."""
    shared = _compiled(df, path)

    def make():  # noqa: ANN202
        unpack = _once(f"unpack {path}", lambda: shared.value.unpacker())
        return lambda rows: [pa.array([unpack(r) for r in rows], pa.string())]

    return map_column(df, ids, [T.StructField(out, T.StringType())], make, carry)


def bpe_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """Append packed token ids and the text that these ids decode to: bpe_encode and bpe_decode in one pass.

    One worker does both, so a core holds one automaton.  Nulls and empty texts give empty ids and texts.
    """
    shared = _compiled(df, path)

    def make():  # noqa: ANN202
        pack, unpack = _once(f"both {path}", lambda: (shared.value.packer(), shared.value.unpacker()))

        def run(texts: list[str | None]) -> list[pa.Array]:
            packed = [pack(t) for t in texts]
            return [pa.array(packed, pa.binary()), pa.array([unpack(x) for x in packed], pa.string())]

        return run

    return map_column(df, text, [T.StructField(ids, T.BinaryType()), T.StructField(out, T.StringType())], make, carry)


def bpe_checked(df: DataFrame, path: str, text: str = "text", ids: str = "ids", same: str = "round_trip", carry: list[str] | None = None) -> DataFrame:
    """Append packed token ids and whether they decode to the text; the decoded text stays in the worker.

    Nulls and empty texts give empty ids, which decode to the empty text: a null text is read as one.
    """
    shared = _compiled(df, path)

    def make():  # noqa: ANN202
        pack, unpack = _once(f"both {path}", lambda: (shared.value.packer(), shared.value.unpacker()))

        def run(texts: list[str | None]) -> list[pa.Array]:
            packed = [pack(t) for t in texts]
            return [pa.array(packed, pa.binary()), pa.array([unpack(x) == (t or "") for t, x in zip(texts, packed, strict=True)], pa.bool_())]

        return run

    return map_column(df, text, [T.StructField(ids, T.BinaryType()), T.StructField(same, T.BooleanType())], make, carry)
