"""Operators against independent, slow versions of what they compute."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
from datetime import date

import numpy as np
import pytest

from tessella.llm import langid, licenses
from tessella.llm.license_texts import TEMPLATES
from tests.llm.test_text_ops import ODD, docs_of, luhn, pseudonyms

# language ID


def grams_of(text: str | None) -> list[int]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = re.sub(rb"[^a-z\x80-\xff]+", b" ", low).strip()
    b = b" " + words + b" " if words else b""
    return [(int.from_bytes(b[i : i + 3], "big") * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(b) - 2)]


def softmax(x: list[float]) -> list[float]:
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def test_language_id_against_brute_force(spark) -> None:  # noqa: ANN001
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()
    langs = sorted({r["lang"] for r in docs})
    counts = {x: collections.Counter(g for r in docs if r["lang"] == x for g in grams_of(r["text"])) for x in langs}
    size = {x: sum(counts[x].values()) + 0.5 * 65536 for x in langs}
    hosts = ["a.x.com", "b.x.com", "c.org", "plain", None, "d.e.x.com"]
    rows = [(i, t, hosts[i % 6], ["de", None, "EN", "xx"][i % 4]) for i, t in enumerate([*(r["text"] for r in docs), *ODD, docs[0]["text"], docs[0]["text"]])]
    rows += [(1, docs[1]["text"], "c.org", None), (None, docs[1]["text"], "c.org", None)]  # a repeated id, and none
    df = spark.createDataFrame(rows, "id int, text string, host string, declared string")
    model = langid.train(spark.createDataFrame([(r["text"], r["lang"]) for r in docs], "text string, lang string"))
    got = {(r["id"], r["text"]): r for r in langid.identify(df, model, host="host", declared="declared", keep=["id", "text"]).collect()}
    evidence, best, lls = [], [], []
    for _, t, _, said in rows:
        g = grams_of(t)
        mean = [sum(math.log(0.9 * (counts[x][k] + 0.5) / size[x] + 0.1 / 65536) for k in g) / max(1, len(g)) for x in langs]
        ll = [m * min(len(g), 50) for m in mean]
        say = (said or "").lower()
        evidence.append([v + (math.log(0.9 if x == say else 0.1 / (len(langs) - 1)) if say in langs else 0.0) for x, v in zip(langs, ll, strict=True)])
        best.append(max(mean) if g else None)
        lls.append(ll)
    path = lambda h: ("", ".".join(h.split(".")[-1:]), ".".join(h.split(".")[-2:]), h) if "." in (h or "") else ("", "", "", h or "")
    votes: list = [collections.defaultdict(lambda: np.zeros(len(langs) + 1)) for _ in range(4)]
    for (_, _, h, _), ev, b in zip(rows, evidence, best, strict=True):
        if b is not None:
            for level in range(4):
                votes[level][path(h)[: level + 1]] += np.array([*softmax(ev), 1.0])
    all_of = votes[0][("",)]
    top = (all_of[:-1] + 1) / (all_of[-1] + len(langs))
    for (i, t, h, _), ev, b, ll in zip(rows, evidence, best, lls, strict=True):
        prior = top
        if path(h) in votes[3]:
            for level in range(1, 4):
                v = votes[level][path(h)[: level + 1]]
                prior = (v[:-1] + 5 * prior) / (v[-1] + 5)
        post = softmax([e + math.log(p) for e, p in zip(ev, prior, strict=True)])
        r = got[i, t]
        assert r["lang_posterior"] == pytest.approx(max(post), rel=1e-3), (i, h)
        assert r["lang_id"] == langs[post.index(max(post))]
        assert r["text_lang"] == (None if b is None else langs[ll.index(max(ll))])
        assert r["lang_accepted"] == (b is not None and max(post) >= 0.5 and b > math.log(1 / 65536))


def test_junk_is_rejected_whatever_the_size(spark) -> None:  # noqa: ANN001
    r = random.Random(5)
    junk = [" ".join("".join(r.choice("qxzjkwvy") for _ in range(9)) for _ in range(40)) for _ in range(5)] + ["1234 5678 !!", ""]
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        model = langid.train(docs)
        rows = langid.identify(docs.select("doc_id", "text").union(docs_of(spark, junk).selectExpr("-1 - doc_id", "text")), model, keep=["doc_id"]).collect()
        assert not any(x["lang_accepted"] for x in rows if x["doc_id"] < 0)
        assert sum(x["lang_accepted"] for x in rows if x["doc_id"] >= 0) >= 0.97 * (len(rows) - len(junk))


def test_language_id_names_clash(spark) -> None:  # noqa: ANN001
    df = docs_of(spark, ["a b c"])
    with pytest.raises(ValueError, match="already"):
        langid.identify(df.withColumnRenamed("source", "lang_id"), langid.train(df))


# licences


def test_candidates_lose_no_licence() -> None:
    """Whole texts: what scan() reports against aligning each planted template where it stands."""
    index, r = licenses.Index(TEMPLATES), random.Random(3)
    filler = "all of these words and the software is not in any of them as such for use or by right of this".split()
    wanted = found = 0
    for name, texts in TEMPLATES.items():
        for t in texts:
            words = t.split()
            if len(words) < 20:
                continue
            changed = [w if r.random() > 0.06 else "other" for w in words]
            text = " ".join([*(r.choice(filler) for _ in range(60)), *changed, *(r.choice(filler) for _ in range(60))])
            seen = np.fromiter((index.vocabulary.get(w, 0) for w in re.findall("[a-z0-9]+", text.lower())), np.int64)
            a = index.words[next(i for i, n in enumerate(index.names) if n == name and len(index.words[i]) == len(re.findall("[a-z0-9]+", t.lower())))]
            band = max(2, int(licenses.DRIFT * len(a)))
            m = licenses.align(a, seen, 60, band)[0]  # the diagonal on which the template was planted
            if m >= 0.8 * len(a):
                wanted += 1
                found += any(x[0] == name for x in licenses.scan(index, text))
    assert wanted >= 10
    assert found == wanted


# PII


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def is_date(s: str) -> bool:
    parts = [s.split("-")] if "-" in s else [(lambda a, b, c: [c, b, a])(*s.split("/")), (lambda a, b, c: [c, a, b])(*s.split("/"))]
    for p in parts:
        try:
            date(*map(int, p))
        except ValueError:
            continue
        return True
    return False


#: Tokens that a detector, written apart from the operator's, calls personal data.
CHECKS = {
    r"\d{3}-\d{2}-\d{4}": lambda s: not re.match("000|666|9", s) and s[4:6] != "00" and s[7:] != "0000",
    r"\d{1,3}(\.\d{1,3}){3}": lambda s: all(int(x) < 256 for x in s.split(".")),
    r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}": is_date,
    r"\d{13,19}": luhn,
    r"[A-Z]{2}\d{2}[A-Z0-9]{11,26}": mod97,
    r"[\w.]+@[\w]+\.[a-z]+": lambda s: True,  # noqa: ARG005
    r"[0-9a-f]{40}": lambda s: True,  # noqa: ARG005
}


def test_pii_against_another_detector(spark) -> None:  # noqa: ANN001
    r = random.Random(7)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    makers = [
        lambda: f"{digits(3)}-{r.choice(['00', digits(2)])}-{r.choice(['0000', digits(4)])}",
        lambda: ".".join(str(r.randrange(0, 320)) for _ in range(4)),
        lambda: f"{r.randrange(1, 9999):04d}-{r.randrange(0, 14):02d}-{r.randrange(0, 33):02d}",
        lambda: f"{r.randrange(0, 33):02d}/{r.randrange(0, 14):02d}/{r.randrange(1800, 2200)}",
        lambda: digits(16),
        lambda: "GB82WEST1234569876543" + r.choice("0123456789"),
        lambda: f"{r.choice('abc')}{digits(2)}@mail.com",
        lambda: hashlib.sha1(digits(3).encode()).hexdigest(),
        lambda: r.choice(["word", "12", "v1.2.3", "2024", "a-b"]),
    ]
    texts = [" and ".join(r.choice(makers)() for _ in range(12)) for _ in range(60)]
    for text, got in zip(texts, pseudonyms(spark, texts), strict=True):
        before, after = text.split(" "), got.split(" ")
        assert len(before) == len(after)
        for a, b in zip(before, after, strict=True):
            personal = any(re.fullmatch(p, a) and ok(a) for p, ok in CHECKS.items())
            if not personal:
                assert a == b, (a, b)
            elif a != b:  # a permutation may leave a value where it is, a hash won't
                assert any(re.fullmatch(p, b) and ok(b) for p, ok in CHECKS.items()) or b.endswith(".invalid"), (a, b)
    changed = sum(a != b for t, g in zip(texts, pseudonyms(spark, texts), strict=True) for a, b in zip(t.split(" "), g.split(" "), strict=True))
    wanted = sum(any(re.fullmatch(p, a) and ok(a) for p, ok in CHECKS.items()) for t in texts for a in t.split(" "))
    assert changed >= 0.99 * wanted


def test_feistel_is_the_network(spark) -> None:  # noqa: ANN001
    from pyspark.sql import functions as F

    from tessella.llm import pii

    def prf(tag: str, i: int, y: int) -> int:
        return int(hashlib.sha256(f"k|{tag}|{i}|{y}".encode()).hexdigest()[:12], 16)

    rows = spark.range(40).select("id", pii.feistel(F.col("id") % 13, F.col("id") * 7 % 29, F.lit(13), F.lit(29), "k", F.lit("t")).alias("s")).collect()
    for r in rows:
        x, y, mx, my = r["id"] % 13, r["id"] * 7 % 29, 13, 29
        for i in range(1, 9):
            x, y, mx, my = y, (x + prf("t", i, y)) % mx, my, mx
        assert (r["s"]["x"], r["s"]["y"]) == (x, y)
