from __future__ import annotations

import collections

import pytest

import __spark_entry__
import corpus_pipeline
from tessella.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

DIR = "/root/testdata/sf0.001"


def test_stages(spark) -> None:  # noqa: ANN001
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept[name] = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
        held = spark.createDataFrame(out.collect(), out.schema)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(kept["language_id"]) >= 0.9 * len(ids)
    assert kept["line_dedup"] == kept["language_id"]
    assert set(kept["near_dedup"]) <= set(kept["line_dedup"])
    assert max(kept["near_dedup"].values()) == 1
    assert max(kept["mix_sources"].values()) <= 3
    assert kept["bpe_tokens"] == kept["mix_sources"]
    assert all(r["round_trip"] for r in held.select("round_trip").collect())


def test_near_dedup_keeps_the_smallest(spark) -> None:  # noqa: ANN001
    a, b, c = "one two three four", "something else it is", "a third text of its own"
    rows = [(3, a), (1, a), (2, b), (None, a), (2, b), (2, c), (None, "what has no id stays"), (None, None), (7, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, df, DIR).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (2, c), (None, "what has no id stays"), (7, "")], key=str)


def test_run_is_its_stages(spark) -> None:  # noqa: ANN001
    """run() against the stages' rules, each worked out by hand from what the one before kept."""
    import numpy as np
    from tokenizers import Tokenizer

    from tests.llm.test_text_ops import brute_simhash, components_of

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = corpus_pipeline.lines(spark, corpus_pipeline.language(spark, docs, DIR), DIR).collect()
    fps = [brute_simhash(r["text"]) for r in held]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    groups = collections.defaultdict(list)
    for i, c in components_of(range(len(fps)), links).items():
        groups[c].append(held[i]["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in held}
    got = corpus_pipeline.run(spark, DIR).collect()
    assert {r["doc_id"] for r in got} <= {min(g) for g in groups.values()}
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["round_trip"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_are_whole(spark, name: str) -> None:  # noqa: ANN001
    assert name in __spark_entry__.queries()
    df = QUERIES[name](spark, DIR)
    n = df.count()
    table = "embeddings" if name.split("_")[0] in ("op4", "op5") else "documents"
    rows = spark.read.parquet(f"{DIR}/{table}.parquet").count()
    if name.split("_")[0] in ("op2", "op3", "op4", "op6", "op7", "op8", "op10"):
        assert n == rows
    else:
        assert n > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name: str) -> None:  # noqa: ANN001
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    cur = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    df = QUERIES[name](spark, DIR)
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    assert got == sorted(cur.fetchall(), key=repr)
