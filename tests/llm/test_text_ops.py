from __future__ import annotations

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import bpe, langid, licenses, linededup, lm, mixing, pii, simhash
from tessella.llm.common import words_of
from tessella.llm.license_texts import TEMPLATES
from tessella.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "\n\n", "a", "x" * 50_000, "été ñandú 中文 \U0001f600 \x00", "one two", "one two", " \t\v\f\r lead and trail "]


def docs_of(spark, texts, **more):  # noqa: ANN001, ANN003, ANN201
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sample(spark):  # noqa: ANN001, ANN201
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# BPE


def test_bpe_is_the_librarys(spark) -> None:  # noqa: ANN001
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    df = docs_of(spark, ODD).select("doc_id", "text").union(sample(spark).selectExpr("doc_id + 1000", "text"))
    got = bpe.bpe_round_trip(df, tokenizer_path()).collect()
    assert len(got) == df.count()
    for r in got:
        want = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["decoded"] == t.decode(want, skip_special_tokens=False)
    apart = bpe.bpe_decode(bpe.bpe_encode(df, tokenizer_path()), tokenizer_path())
    assert sorted((r["doc_id"], r["decoded"]) for r in apart.collect()) == sorted((r["doc_id"], r["decoded"]) for r in got)


def test_bpe_random_texts() -> None:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    a = bpe.Automaton(tokenizer_path())
    pack, unpack = a.packer(), a.unpacker()
    r = random.Random(3)
    chars = "aabcdefgh  'stre\n\t.,!-_09éßñ中あ한​ \U0001f600<|endoftext|>"
    for _ in range(1500):
        s = "".join(r.choice(chars) for _ in range(r.randrange(40)))
        ids = np.frombuffer(pack(s), "<u4").tolist()
        assert ids == t.encode(s, add_special_tokens=False).ids, s
        assert unpack(pack(s)) == t.decode(ids, skip_special_tokens=False)


def test_gadgets_are_the_construction(tmp_path) -> None:  # noqa: ANN001
    """The compiled tables against the automaton built arc by arc, over a vocabulary of a few merges."""
    import json

    r = random.Random(11)
    for case in range(30):
        tokens, merges = list("abc"), []
        while len(merges) < 14:
            a, b = r.choice(tokens), r.choice(tokens)
            if a + b not in tokens:
                merges.append(f"{a} {b}")
                tokens.append(a + b)
        path = tmp_path / f"{case}.json"
        path.write_text(json.dumps({"model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}, "added_tokens": []}))
        got = bpe.Automaton(str(path))
        arcs = [{t: 0 for t in "abc"}]
        for m in merges:
            u, v = m.split(" ")
            p = arcs[0].get(u)
            if p is None or v not in arcs[p]:
                continue
            to = arcs[p][v]
            arcs.append({x: y for x, y in arcs[p].items() if x != v})
            had = [q for q in arcs if u in q]
            for q in had:
                q[u] = len(arcs) - 1
                q[u + v] = to
        assert len(got.parent) == len(arcs)
        for q, out in enumerate(arcs):
            for i, t in enumerate(tokens):
                if got.born[i] >= 0:
                    assert got.step(q, i) == out.get(t, -1), (merges, q, t)


def test_clashing_names_are_errors(spark) -> None:  # noqa: ANN001
    df = docs_of(spark, ["a"])
    with pytest.raises(ValueError, match="already"):
        bpe.bpe_encode(df.withColumnRenamed("lang", "IDS"), tokenizer_path())
    with pytest.raises(ValueError, match="already"):
        linededup.dedup_lines(df.withColumnRenamed("lang", "n_dropped"))
    with pytest.raises(ValueError, match="already"):
        mixing.mix(df.withColumnRenamed("lang", "mix_size"))
    with pytest.raises(ValueError, match="already"):
        pii.pseudonymise(df.withColumnRenamed("lang", "pii_count"), "k")


def test_empty_tables(spark) -> None:  # noqa: ANN001
    none = docs_of(spark, ["x"]).limit(0)
    assert bpe.bpe_round_trip(none, tokenizer_path()).count() == 0
    assert simhash.simhash_groups(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert pii.pseudonymise(none, "k").count() == 0
    assert lm.lm_scores(none).count() == 0
    assert licenses.license_rows(none).count() == 0
    assert langid.identify(none, langid.train(none), host="source").count() == 0


# SimHash


def brute_simhash(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(nodes, linked):  # noqa: ANN001, ANN201
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
    return low


def test_simhash_against_brute_force(spark) -> None:  # noqa: ANN001
    base = [r["text"] for r in sample(spark).select("text").limit(60).collect()]
    r = random.Random(5)
    near = []
    for t in base[:25]:
        w = t.split(" ")
        for _ in range(2):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    texts = [*base, *near, *base[:10], *ODD]
    got = {x["doc_id"]: x for x in simhash.simhash_groups(docs_of(spark, texts)).collect()}
    fps = [brute_simhash(t) for t in texts]
    assert [got[i]["fp"] & (1 << 64) - 1 for i in range(len(texts))] == fps
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = components_of(range(len(fps)), links)
    assert {i: x["component_id"] for i, x in got.items()} == want


def test_golay_keys_find_all_pairs() -> None:
    r = np.random.default_rng(1)
    fp = r.integers(-(1 << 63), (1 << 63) - 1, 3000)
    other = fp.copy()
    for i in range(len(fp)):
        for b in r.choice(64, r.integers(0, 3), replace=False):
            other[i] ^= np.int64(np.uint64(1) << np.uint64(b))
    mine, theirs = [collections.defaultdict(set) for _ in range(2)]
    for at, (rows, keys) in ((mine, simhash.keys_of(fp)), (theirs, simhash.keys_of(other))):
        for i, k in zip(rows.tolist(), keys.tolist(), strict=True):
            at[i].add(k)
    assert all(mine[i] & theirs[i] for i in range(len(fp)))


def test_heavy_buckets(spark) -> None:  # noqa: ANN001
    """More fingerprints in one bucket than are paired: chains of them still link."""
    r = random.Random(2)
    fps = sorted({r.getrandbits(20) & 0xFFFFF for _ in range(400)})
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    from tessella.llm.graph import components

    comp = {x["node"]: x["component"] for x in components(spark, simhash.near_links(spark, reps, "t"), "t").collect()}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = components_of(range(len(fps)), links)
    assert {i: comp.get(i, i) for i in range(len(fps))} == want


# line dedup


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(texts: list[str | None], t: int = linededup.THRESHOLD) -> list[str | None]:
    first: dict[str, tuple[int, int]] = {}
    for d, x in enumerate(texts):
        for n, line in enumerate((x or "").split("\n")):
            if line:
                first.setdefault(line, (d, n))
    gone = set()
    for a in first:
        for b in first:
            if first[b] < first[a] and abs(len(a) - len(b)) <= t and (e := edits(a, b)) <= t and e < max(len(a), len(b)):
                gone.add(a)
    out: list[str | None] = []
    for d, x in enumerate(texts):
        out.append(None if x is None else "\n".join(line for n, line in enumerate(x.split("\n")) if not line or (line not in gone and first[line] == (d, n))))
    return out


@pytest.mark.parametrize("t", [1, 2, 3])
def test_banded_distance(spark, t: int) -> None:  # noqa: ANN001
    from pyspark.sql import functions as F

    r = random.Random(t)
    word = lambda n: "".join(r.choice("ab\U0001f600é") for _ in range(n))
    pairs = [(word(r.randrange(9)), word(r.randrange(9))) for _ in range(700)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.edit_distance(F.col("a"), F.col("b"), t).alias("d")).collect()
    assert len(rows) == len(pairs)
    for x in rows:
        want = edits(x["a"], x["b"])
        assert x["d"] == want if want <= t else x["d"] > t


@pytest.mark.parametrize(("t", "heavy"), [(1, 2), (2, 4)])
def test_line_dedup_against_brute_force(spark, monkeypatch, t: int, heavy: int) -> None:  # noqa: ANN001
    monkeypatch.setattr(linededup, "HEAVY", heavy)
    r = random.Random(4)
    lines = ["".join(r.choice("abc deé") for _ in range(r.choice([1, 1, 2, 2, 3, 4, 5, 7, 9, 12, 20, 30, 31]))) for _ in range(60)]

    def change(s: str) -> str:
        i = r.randrange(len(s))
        return r.choice([s[:i] + "z" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "z" + s[i:]]) or "q"

    pool = lines + [change(x) for x in lines] + [change(change(x)) for x in lines] + list("abcdef") + ["ab", "ba", "bc", ""]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(1, 6))) for _ in range(80)] + ODD
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(docs_of(spark, texts), threshold=t).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, t)


def test_crowded_lines(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(linededup, "HEAVY", 3)
    base = "the very same first half of the line and "
    texts = [base + f"{i:06d} then a tail {i * i:08d}" for i in range(20)] * 2 + [base + f"{i:06d} then a tail {i * i:08d}x" for i in range(10)]
    texts += [f"page {i} of 99, in a template that all lines share" for i in range(40)]
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


# mixing


def test_mix(spark) -> None:  # noqa: ANN001
    r = random.Random(9)
    texts = [" ".join(["w"] * r.choice([0, 1, 3, 10, 50, 200])) for _ in range(300)] + ODD
    df = docs_of(spark, texts)
    rows = mixing.mix(df, keep=["doc_id", "source"]).collect()
    again = mixing.mix(df.repartition(7), keep=["doc_id", "source"]).collect()
    assert sorted((x["doc_id"], x["mix_repeats"]) for x in rows) == sorted((x["doc_id"], x["mix_repeats"]) for x in again)
    assert len(rows) == len(texts)
    sizes = {i: len(words_of(t)) for i, t in enumerate(texts)}
    by: dict = collections.defaultdict(list)
    for x in rows:
        assert x["mix_size"] == sizes[x["doc_id"]]
        assert 0 <= x["mix_repeats"] <= 3
        by[x["source"]].append(x)
    names = [n for n in sorted(n for n in by if n is not None)] + [None]
    total = {n: sum(x["mix_size"] for x in by[n]) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    capped: set = set()
    while True:
        left = sum(total.values()) - sum(3 * total[n] for n in capped)
        free = [n for n in names if n not in capped]
        target = {n: 3.0 * total[n] if n in capped else left * weight[n] / sum(weight[m] for m in free) for n in names}
        over = {n for n in free if target[n] > 3 * total[n]}
        if not over:
            break
        capped |= over
    for n in names:
        assert by[n][0]["mix_target"] == pytest.approx(target[n])
        assert by[n][0]["mix_source_size"] == total[n]
        assert abs(sum(x["mix_size"] * x["mix_repeats"] for x in by[n]) - target[n]) <= 1
    assert mixing.mixed(df).count() == sum(x["mix_repeats"] for x in rows)


def test_knapsack_is_the_best() -> None:
    r = random.Random(1)
    for _ in range(200):
        lengths, spare = [r.randrange(1, 12) for _ in range(4)], [r.randrange(3) for _ in range(4)]
        budget = r.randrange(40)
        sums = {0}
        for n, m in zip(lengths, spare, strict=True):
            sums = {s + n * k for s in sums for k in range(m + 1)}
        k = mixing.knapsack(lengths, spare, budget)
        assert all(0 <= a <= b for a, b in zip(k, spare, strict=True))
        assert sum(a * b for a, b in zip(k, lengths, strict=True)) == max(s for s in sums if s <= budget)


# PII


def luhn(s: str) -> bool:
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def pseudonyms(spark, texts: list[str | None], key: str = "k") -> list[str | None]:  # noqa: ANN001
    return [r["text"] for r in sorted(pii.pseudonymise(docs_of(spark, texts), key).collect(), key=lambda r: r["doc_id"])]


def test_pii_formats(spark) -> None:  # noqa: ANN001
    from datetime import datetime

    given = ["x 4111 1111 1111 1111 y", "4111111111111111", "4111111111111112", "10.1.2.3 and 999.1.1.1", "1987-02-28", "31/12/1999", "12/31/1999", "1987-02-30", "+1 (961) 555-6946", "123-45-6789", "000-12-3456", "GB82WEST12345698765432", "GB83WEST12345698765432", "a.b@ex.com", "A.B@EX.com", "see 1.2.3.4.5"]
    got = pseudonyms(spark, [*given, *ODD])
    assert re.fullmatch(r"x \d{4} \d{4} \d{4} \d{4} y", got[0])
    assert re.sub(r"\D", "", got[0]) == got[1] != given[1]
    assert luhn(got[1])
    assert got[2] == given[2]
    assert got[3] != given[3]
    assert got[3].endswith("and 999.1.1.1")
    assert all(int(p) < 256 for p in got[3].split(" ")[0].split("."))
    assert datetime.strptime(got[4], "%Y-%m-%d") != datetime(1987, 2, 28)
    assert datetime.strptime(got[5], "%d/%m/%Y") == datetime.strptime(got[6], "%m/%d/%Y")
    assert got[7] == given[7]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[8])
    assert got[8] != given[8]
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", got[9])
    assert got[10] == given[10]
    rearranged = got[11][4:] + got[11][:4]
    assert int("".join(str(int(c, 36)) for c in rearranged)) % 97 == 1
    assert got[12] == given[12]
    assert got[13] == got[14]
    assert "ex.com" not in got[13]
    assert got[15] == given[15]
    assert got[len(given) :] == ODD
    assert pseudonyms(spark, given, "other")[1] != got[1]
    counts = [r["pii_count"] for r in sorted(pii.pseudonymise(docs_of(spark, given), "k").collect(), key=lambda r: r["doc_id"])]
    assert counts == [1, 1, 0, 1, 1, 1, 1, 0, 1, 1, 0, 1, 0, 1, 1, 0]


def test_pii_is_a_permutation(spark) -> None:  # noqa: ANN001
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(pii.permute_digits(F.col("d"), "k", "t").alias("p")).distinct().count() == 1000
    low, high = 5591, 13
    days = spark.range(0, low * high).select(pii.feistel(F.floor(F.col("id") / low), F.col("id") % low, F.lit(high), F.lit(low), "k", F.lit("d")).alias("s"))
    out = days.selectExpr(f"s.x * {low} + s.y as n").agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()
    assert tuple(out) == (low * high, 0, low * high - 1)


# LM


def test_lm_against_brute_force(spark) -> None:  # noqa: ANN001
    texts = [r["text"] for r in sample(spark).limit(120).collect()] + ODD
    got = {r["doc_id"]: r for r in lm.lm_scores(docs_of(spark, texts)).collect()}
    tokens = lambda t: [*words_of(t), None]
    uni: collections.Counter = collections.Counter()
    bi: collections.Counter = collections.Counter()
    tri: collections.Counter = collections.Counter()
    for i, t in enumerate(texts):
        if i is None or zlib.crc32(str(i).encode()) % 10:
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["^", *w], w, strict=False))
            tri.update(zip(["^", *w], w, w[1:], strict=False))
    n, v, (k2, k3) = sum(uni.values()), len(uni), lm.PRIOR
    p1 = lambda a: (uni[a] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda h, a: (bi[h, a] + k2 * p1(a)) / ((uni[None] if h == "^" else uni[h]) + k2)
    p3 = lambda g, h, a: (tri[g, h, a] + k3 * p2(h, a)) / (bi[g, h] + k3)
    for i, t in enumerate(texts):
        w, r = tokens(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(uni[a] > 0 for a in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(p1(a)) for a in w))
        want = math.log10(p2("^", w[0])) + sum(math.log10(p3(*x)) for x in zip(["^", *w], w, w[1:], strict=False))
        assert r["score"] == pytest.approx(want)


def test_lm_rows_without_ids_and_with_the_results_names(spark) -> None:  # noqa: ANN001
    rows = [(None, "a b a b", 1.0, True), (None, "a b", 2.0, None), (4, "a b", 3.0, None), (4, "a b", 3.0, None), (4, None, 3.0, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, score double, held_out boolean")
    got = lm.lm_scores(df).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("4", 1), ("4", 3), ("4", 3), ("None", 3), ("None", 5)]
    assert len({r["score"] for r in got if r["n_tokens"] == 3}) == 1


def test_lm_chunks_agree(spark, monkeypatch) -> None:  # noqa: ANN001
    df = sample(spark)
    one = {r["doc_id"]: r["score"] for r in lm.lm_scores(df).collect()}
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(lm, "RANGE_KEYS", 300)
    many = {r["doc_id"]: r["score"] for r in lm.lm_scores(df).collect()}
    assert one == pytest.approx(many)


def test_lm_keys_are_packed_by_range() -> None:
    """What a range's hashes share isn't sent."""
    r = np.random.default_rng(2)
    hashes = np.unique(r.integers(0, 1 << 63, 800_000, dtype=np.uint64) << np.uint64(1) | np.uint64(1))
    order, at = lm._dealt(hashes, 8)
    assert sorted(order.tolist()) == list(range(len(hashes)))
    assert sum(len(lm._pack_keys(hashes[order][i:j])) for i, j in zip(at, at[1:], strict=False)) < 6.3 * len(hashes)
    assert max(np.diff(at)) < 1.2 * len(hashes) / 256
    names = np.ones(1 << 17, np.int64).cumsum() % lm.NAMED + 1
    a, b, c = (np.minimum(r.zipf(1.3, 1_000_000), 60_000) for _ in range(3))
    keys = np.unique(lm.gram_keys([a, b, c], np.zeros(1 << 17, np.uint64), names))
    order, at = lm._dealt(keys, 8)
    assert (np.sort(keys[order]) == keys).all()
    assert max(np.diff(at)) < 2 * len(keys) / 256


def test_lm_ranges_agree_between_chunks() -> None:
    """A key is in the same range whatever else its chunk has, at few and many ranges."""
    r = np.random.default_rng(3)
    keys = np.unique(np.concatenate([r.integers(0, 1 << 50, 3000, dtype=np.uint64) << np.uint64(1), r.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1) | np.uint64(1)]))
    for log2 in (4, 9, 16, 18):
        for hashes in (False, True):
            where = []
            for part in (keys, r.permutation(keys)[:2500]):
                order, at = lm._dealt(part, log2, hashes)
                dealt, of = part[order], np.repeat(np.arange(1 << log2), np.diff(at))
                assert ((dealt[1:] > dealt[:-1]) | (of[1:] > of[:-1])).all()
                where.append(dict(zip(dealt.tolist(), of.tolist(), strict=True)))
            assert where[1].items() <= where[0].items()


def test_lm_deletes_what_it_shuffled(spark, monkeypatch) -> None:  # noqa: ANN001
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def shuffled() -> dict[str, int]:
        paths = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {p: os.path.getsize(p) for p in paths if p.endswith(".data") and os.path.exists(p)}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had, held, during, write = shuffled(), spark.conf.get(setting), {}, lm.cut

    def cut(s, df, tag):  # noqa: ANN001, ANN202
        during[tag] = s.conf.get(setting)  # without it files go when the driver collects garbage, now and then in time
        return write(s, df, tag)

    monkeypatch.setattr(lm, "cut", cut)
    scores = lm.lm_scores(sample(spark))
    assert during["lm-answers"] == "true"
    assert sum(n for p, n in shuffled().items() if p not in had) < 20_000  # sums of a row for each task
    assert spark.conf.get(setting) == held
    assert scores.count() == sample(spark).count()


def test_lm_beats_unigrams_on_held_out_texts(spark) -> None:  # noqa: ANN001
    rows = lm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_lm_weights_sum_to_one() -> None:
    words = np.array([2, 0, 5, 3, 0])  # end, start, two words, one unknown
    pairs = np.array([1 << 32 | 2, 2 << 32, 2 << 32 | 2, 2 << 32 | 3, 2 << 32 | 4, 3 << 32 | 2])
    c2 = np.array([2, 2, 0, 3, 0, 3])
    triples = np.array([0 << 32 | 3, 3 << 32 | 2, 5 << 32, 5 << 32 | 3])
    a = lm.Automaton(words, pairs, c2, triples, np.array([2, 3, 2, 1]), 10, 3, (50.0, 4.0))
    labels = np.array([0, 2, 3, 4])
    for state in (0, 2 + 1, 3 + 1, 1 + 5 + 3, 1 + 5 + 5):
        weight, _ = a.step(np.full(4, state), labels)
        assert (10**weight).sum() == pytest.approx(1.0), state


def test_lm_strips_agree(monkeypatch) -> None:  # noqa: ANN001
    r = np.random.default_rng(1)
    ids, lengths = r.integers(2, 9, 400), np.array([1, 200, 3, 196])
    ids[np.cumsum(lengths) - 1] = 0
    pairs, pair, second, triple = lm._grams(ids, lengths)
    triples = np.unique(triple[second])
    words = np.bincount(ids, minlength=9)
    c2 = np.bincount(pair) * r.integers(0, 2, len(pairs))
    model = lm.Automaton(words, pairs, c2, triples, np.minimum(1, c2[triples >> 32]) * (c2[np.searchsorted(pairs, (pairs[triples >> 32] & 0xFFFFFFFF) << 32 | triples & 0xFFFFFFFF)] > 0), 400, 8, (5.0, 2.0))
    whole = model.run(ids, lengths)
    monkeypatch.setattr(lm, "STRIP", 7)
    assert model.run(ids, lengths) == pytest.approx(whole)


# licences


def test_license_scan(spark) -> None:  # noqa: ANN001
    mit, apache = TEMPLATES["MIT"][2], TEMPLATES["Apache-2.0"][1]
    r = random.Random(6)
    w = mit.split(" ")
    changed = [x if r.random() > 0.08 else "other" for x in w]
    texts = [f"head line\n{mit}\ntail", " ".join(changed), apache, "Released under the MIT License.", "nothing here", f"{mit}\n\n{apache}", mit[: len(mit) // 2], "the software the software is", *ODD]
    got: dict = collections.defaultdict(list)
    for x in licenses.license_rows(docs_of(spark, texts)).collect():
        got[x["doc_id"]].append(x)
    assert [x["license"] for x in got[0]] == ["MIT"]
    assert texts[0][got[0][0]["start"] : got[0][0]["end"]].startswith("Permission is")
    assert got[0][0]["coverage"] == 1.0
    assert [x["license"] for x in got[1]] == ["MIT"]
    assert 0.8 <= got[1][0]["coverage"] < 1
    assert [x["license"] for x in got[2]] == ["Apache-2.0"]
    assert got[2][0]["matched"] > 50
    assert [x["license"] for x in got[3]] == ["MIT"]
    assert sorted(x["license"] for x in got[5]) == ["Apache-2.0", "MIT"]
    assert set(got) == {0, 1, 2, 3, 5}


def test_every_template_finds_itself() -> None:
    index = licenses.Index(TEMPLATES)
    for name, texts in TEMPLATES.items():
        for t in texts:
            assert licenses.scan(index, f"Some words. {t} More words.")[0][0] == name, t


def test_alignment_against_brute_force() -> None:
    r = random.Random(8)

    def common(a: list[int], b: list[int]) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    for _ in range(100):
        a, b = [r.randrange(4) for _ in range(8)], [r.randrange(4) for _ in range(9)]
        assert licenses.align(np.array(a), np.array(b), 0, 20)[0] == common(a, b)


# language ID


def test_language_id(spark) -> None:  # noqa: ANN001
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(train.filter("doc_id % 10 <> 0"))
    held = train.filter("doc_id % 10 = 0")
    got = langid.identify(held, model, host="source").collect()
    assert len(got) == held.count()
    right = sum(r["lang_id"] == r["lang"] for r in got)
    assert right / len(got) > 0.97
    odd = langid.identify(docs_of(spark, ODD), model, host="source", keep=["doc_id"]).collect()
    assert len(odd) == len(ODD)
    assert not any(r["lang_accepted"] for r in odd if not (ODD[r["doc_id"]] or "").strip())


def test_declared_language_decides_where_text_is_silent(spark) -> None:  # noqa: ANN001
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(train)
    df = spark.createDataFrame([(1, "", "h.example.com", "de"), (2, "", "h.example.com", "xx"), (3, None, None, None)], "id int, text string, host string, declared string")
    got = {r["id"]: r for r in langid.identify(df, model, host="host", declared="declared", keep=["id"]).collect()}
    assert got[1]["lang_id"] == "de"
    assert got[1]["text_lang"] is None
    assert len(got) == 3
