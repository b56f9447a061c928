from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from tessella.llm import ann, vectordup
from tessella.llm.common import shared_dir
from tessella.llm.graph import components

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def planted(n: int = 260, d: int = 32, seed: int = 1):  # noqa: ANN201
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, d))
    base[40:80] = base[:40] + 0.3 * r.standard_normal((40, d))  # about the threshold
    base[80:140] = base[7] + 0.05 * r.standard_normal((60, d))  # one dense group
    base[140:150] = base[3]  # copies
    rows = [(i, base[i].astype(np.float32).tolist(), i % 2 if i < 200 else (None if i % 7 == 0 else 5), "x") for i in range(n)]
    rows += [(n, None, 1, "x"), (n + 1, [0.0] * d, 1, "x"), (n + 2, [None, *[1.0] * (d - 1)], 1, "x"), (n + 3, [float("nan")] * d, 1, "x"), (n + 4, [float("inf")] * d, 1, "x"), (n + 5, [], 1, "x"), (n + 6, [1.0, 2.0], 1, "x"), (n + 7, [2.0, 4.0], 1, "x")]
    return rows


def brute_links(rows, threshold: float):  # noqa: ANN001, ANN201
    good = {}
    for i, e, label, _ in rows:
        if e and label is not None and None not in e:
            v = np.array(e, np.float64)
            if np.isfinite(v).all() and v.any():
                good[i] = (label, v / np.linalg.norm(v))
    return [(a, b) for a in good for b in good if a != b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold]


@pytest.mark.parametrize("part", [2048, 16])
def test_vector_groups_against_brute_force(spark, monkeypatch, part: int) -> None:  # noqa: ANN001
    monkeypatch.setattr(vectordup, "PART", part)
    rows = planted()
    links = brute_links(rows, 0.93)
    low = {r[0]: r[0] for r in rows}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if low[b] < low[a]:
                low[a] = low[b]
                moved = True
    got = {r["vec_id"]: r for r in vectordup.vector_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i in got:
        assert got[i]["n_links"] == sum(a == i for a, _ in links)
        assert got[i]["component_id"] == low[i]
        assert got[i]["kept"] == (low[i] == i)


def test_vector_groups_edges(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame(planted()[:4], SCHEMA)
    assert vectordup.vector_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vectordup.vector_groups(df, threshold=1.5)
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x"), (2, [0.0, 1.0], 1, "x")], SCHEMA)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectordup.vector_groups(twice).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def written(spark) -> int:  # noqa: ANN001
    """Bytes shuffled so far, and those under the shared folder."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    shared = Path(shared_dir(spark))
    return sc.statusStore().executorList(False).apply(0).totalShuffleWrite() + sum(f.stat().st_size for f in shared.rglob("*.parquet"))


def test_disk_of_large_labels(spark, monkeypatch) -> None:  # noqa: ANN001
    """A label of many parts is written no more often than one of few."""
    monkeypatch.setattr(vectordup, "PART", 500)
    n, d = 8000, 64
    r = np.random.default_rng(3)
    x = r.standard_normal((n, d)).astype(np.float32)
    x[4000:4100] = x[:100] + 0.2 * r.standard_normal((100, d))
    x[5000:5300] = x[200] + 0.1 * r.standard_normal((300, d))
    x[6000:6100] = x[200]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(x.tolist())], SCHEMA)
    before = written(spark)
    got = {v["vec_id"]: v for v in vectordup.vector_groups(df).collect()}
    assert written(spark) - before <= 4 * n * d * 4
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    near = u @ u.T >= 0.93
    assert [got[i]["n_links"] for i in range(n)] == (near.sum(axis=1) - 1).tolist()
    low = np.arange(n)
    for _ in range(8):
        low = np.where(near, low[None, :], n).min(axis=1)
    assert [got[i]["component_id"] for i in range(n)] == low.tolist()


@pytest.mark.parametrize("noise", [0.02, 0.37, 0.5])
def test_links_between_blobs(monkeypatch, noise: float) -> None:  # noqa: ANN001
    """Dense and sparse tiles, within a blob and between two, against all pairs."""
    monkeypatch.setattr(vectordup, "TILE", 37)
    r = np.random.default_rng(5)
    x = r.standard_normal((150, 40))
    x[::3] = x[0] + noise * r.standard_normal((50, 40)) * np.linalg.norm(x[0]) / 40**0.5
    opened = vectordup._opener("<f8")
    part = [opened(len(v), np.array([k, k, np.arange(len(v)) + 1], "<i8").tobytes() + v.tobytes()) for v in (x[:90], x[90:]) for k in [np.arange(len(v))]]
    a, b = part
    for p, q in ((a, None), (a, b)):
        y, n = (p.x, p.n) if q is None else (np.concatenate([p.x, q.x]), np.concatenate([p.n, q.n]))
        ok = y @ y.T >= 0.93
        np.fill_diagonal(ok, False)
        if q is not None:
            ok[:90, :90] = ok[90:, 90:] = False
        got, root = vectordup.links_of(p, q, 0.93)
        assert got.tolist() == (ok @ n).tolist()
        low = np.arange(len(y))
        for _ in range(len(y)):
            low = np.minimum(low, np.where(ok, low[None, :], len(y)).min(axis=1))
        assert root.tolist() == low.tolist()


def test_hilbert_is_a_curve() -> None:
    c = np.array(np.meshgrid(*[range(8)] * 3)).reshape(3, -1).T
    k = ann.hilbert(c, 3)
    assert sorted(k.tolist()) == list(range(512))
    assert (np.abs(np.diff(c[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


def brute_neighbours(good: dict, q: int) -> list[tuple[float, int]]:
    ids = np.array([i for i in good if i != q])
    d = np.sqrt(((np.array([good[i] for i in ids]) - good[q]) ** 2).sum(axis=1))
    return [(float(d[j]), int(ids[j])) for j in np.lexsort((ids, d))[:10]]


def test_neighbours_against_brute_force(spark) -> None:  # noqa: ANN001
    """The least window holds all of a small table: the result is exact."""
    rows = [r for r in planted(300) if r[0] < 305]
    df = spark.createDataFrame(rows, SCHEMA)
    got: dict = {}
    for r in ann.nearest_neighbours(df, "vec_id % 20 = 0", k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(e, np.float64) for i, e, *_ in rows if e and None not in e and np.isfinite(np.array(e, float)).all() and np.array(e, float).any()}
    assert set(got) == {i for i in good if i % 20 == 0}
    for q, found in got.items():
        want = brute_neighbours(good, q)
        assert [x[1] for x in sorted(found)] == [i for _, i in want]
        assert [x[0] for x in sorted(found)] == list(range(1, 11))
        assert np.allclose([x[2] for x in sorted(found)], [s for s, _ in want], rtol=0, atol=1e-12)


@pytest.mark.parametrize("path", ["sf0.1", "check_s"])
def test_recall_of_the_windows(spark, monkeypatch, path: str) -> None:  # noqa: ANN001
    """With windows far smaller than the table, at two sizes."""
    for name, n in (("LEAST", 32), ("CELL", 256), ("QUERIES", 64), ("SAMPLE", 64)):
        monkeypatch.setattr(ann, name, n)
    df = spark.read.parquet(f"/root/testdata/{path}/embeddings.parquet")
    good = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect() if r["embedding"]}
    good = {i: v for i, v in good.items() if np.isfinite(v).all() and v.any()}
    got: dict = {}
    for r in ann.nearest_neighbours(df, "vec_id % 100 = 0", k=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = [len(got[q] & {i for _, i in brute_neighbours(good, q)}) for q in got]
    assert len(got) == sum(i % 100 == 0 for i in good)
    assert sum(hits) / (10 * len(hits)) >= 0.9


def test_neighbours_of_few(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (1, [0.0, 1.0], 1, "x"), (None, [1.0, 1.0], 1, "x")], SCHEMA)
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest_neighbours(df, "vec_id = 0").collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 1)]
    assert ann.nearest_neighbours(df.limit(0), "vec_id = 0").count() == 0


def test_components_of_a_long_chain(spark) -> None:  # noqa: ANN001
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000), (5, None), (7, 3), (7, 3)]
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(links, "a long, b long"), "chain").collect()}
    assert got == dict.fromkeys(range(201), 0)
