from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import ranges as R
from tessella.operators import stats as A
from tessella.operators import streams as X

#: Inputs of the merge tests and what comes of them: fixed values.
MERGES = [[1, 4, 6, 6, 7, 12, 15], [2, 2, 3, 7, 11, 12, 12], [1, 1, 5, 7, 9, 13, 14]]
UNIQUE = [1, 2, 3, 4, 5, 6, 7, 9, 11, 12, 13, 14, 15]


def ints(spark, xs):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(x,) for x in xs], "x int")


def test_merge(spark) -> None:  # noqa: ANN001
    dfs = [ints(spark, m) for m in MERGES]
    assert [r["x"] for r in X.merge(dfs, ["x"]).collect()] == sorted(sum(MERGES, []))
    got = X.merge_unique(dfs, ["x"]).orderBy("x").collect()
    assert [r["x"] for r in got] == UNIQUE
    assert got[0]["input"] == 0


def test_cutoffs(spark) -> None:  # noqa: ANN001
    got: dict[int, list[int]] = {}
    for r in X.cutoffs(ints(spark, MERGES[0]), "x", [6, 12]).orderBy("x").collect():
        got.setdefault(r["segment"], []).append(r["x"])
    assert got == {0: [1, 4], 1: [6, 6, 7], 2: [12, 15]}
    with pytest.raises(ValueError):
        X.cutoffs(ints(spark, [1]), "x", [2, 1])


def test_number_is_total(spark) -> None:  # noqa: ANN001
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = [r["place"] for r in X.number(df, ["k"], "place").orderBy("k").collect()]
    assert got == list(range(1, 1001))
    assert X.number(df.limit(0), ["k"], "place").count() == 0


@pytest.mark.parametrize("k", [5, 10, 100])
def test_top_k(spark, k: int) -> None:  # noqa: ANN001
    xs = random.Random(k).sample(range(1000), 50)
    assert [r["x"] for r in X.top_k(ints(spark, xs), k, ["x"]).collect()] == sorted(xs)[:k]
    with pytest.raises(ValueError):
        X.top_k(ints(spark, xs), 0, ["x"])


def test_cogroup(spark) -> None:  # noqa: ANN001
    a = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(1, 10), (2, 20)], "k int, w int")
    got = {r["k"]: ([x["v"] for x in r["i0"]], [x["w"] for x in r["i1"]]) for r in X.cogroup([a, b], ["k"]).collect()}
    assert got == {1: (["a", "b"], [10]), 2: ([], [20]), None: (["n"], [])}
    with pytest.raises(Exception, match="more than once"):
        X.join_optional([a, b], ["k"]).collect()
    assert X.cogroup([a.limit(0), b.limit(0)], ["k"]).count() == 0


def test_select_keeps_duplicates(spark) -> None:  # noqa: ANN001
    df, keys = ints(spark, [1, 1, 2, 3]), ints(spark, [1, 1, 3])
    assert sorted(r["x"] for r in X.select_keys(df, keys, ["x"]).collect()) == [1, 1, 3]
    assert [r["x"] for r in X.reject_keys(df, keys, ["x"]).collect()] == [2]


def test_uniq(spark) -> None:  # noqa: ANN001
    rows = [(i, x) for i, x in enumerate([1, 1, 2, 1, None, None, 2])]
    df = spark.createDataFrame(rows, "i int, x int")
    assert sorted((r["x"], r["i"]) for r in X.uniq(df, ["x"], "i").filter("x is not null").collect()) == [(1, 0), (2, 2)]
    assert sorted((r["x"], r["i"]) for r in X.uniq(df, ["x"], "i", "last").filter("x is not null").collect()) == [(1, 3), (2, 6)]
    assert [r["i"] for r in X.uniq_adjacent(df, ["x"], "i").orderBy("i").collect()] == [0, 2, 3, 4, 6]


def test_pages(spark) -> None:  # noqa: ANN001
    sizes = [3, 3, 3, 10, 1, 1]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(sizes)], "g string, i int, n int")
    got = [r["page"] for r in X.pages(df, 6, F.col("n"), ["i"], ["g"]).orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 2, 2]


def test_chunks(spark) -> None:  # noqa: ANN001
    got = [r["chunk"] for r in X.chunks(ints(spark, range(7)), 3, ["x"]).orderBy("x").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2]


def test_extrapolate(spark) -> None:  # noqa: ANN001
    xs = [10, 20, 7, 9, 30, 1, 2, 3, 4, 5, 6, 7]
    mean = total = 0
    for n, x in enumerate(xs):
        a = min(n, 10)
        mean, total = (a * mean + x) // (a + 1), total + x
    df = spark.createDataFrame([(xs,)], "t array<long>")
    assert df.select(A.extrapolate(F.col("t"), F.lit(5))).first()[0] == total + 5 * mean


def test_samples(spark) -> None:  # noqa: ANN001
    cells = spark.range(4000).select(F.concat(F.lit("r"), F.col("id") % 200).alias("row"), F.concat(F.lit("c:"), "id").alias("column"), F.col("id").alias("ts"), F.lit("v").alias("value"))
    half = A.sample_cells(cells, 1.0, 0.5)
    assert 1700 < half.count() < 2300
    assert half.exceptAll(A.sample_cells(cells.repartition(7), 1.0, 0.5)).count() == 0
    assert 60 < A.sample_cells(cells, 0.5, 1.0).select("row").distinct().count() < 140
    assert A.sample_cells(cells, 0.5, 0.0).count() == 0
    assert A.reservoir(cells, 10, ["column"]).count() == 10
    assert A.distinct_reservoir(cells, 500, "row").count() == 200
    rows = {r["table"]: r["cells"] for r in A.table_stats(cells.withColumn("table", F.lit("t"))).collect()}
    assert rows == {"t": 4000, None: 4000}


def test_compaction_choice() -> None:
    assert R.choose_compaction([]) is None
    assert R.choose_compaction([5]) is None
    i, j = R.choose_compaction([1000, 1, 1, 1, 1])
    assert (i, j) == (1, 5)
    sizes, rewritten = R.simulate_compaction([1] * 64)
    assert sum(sizes) == 64
    assert len(sizes) <= 8
    assert rewritten > 0
    assert R.split_tablet("a", None, "m") == (("a", "m"), ("m", None))
    with pytest.raises(ValueError):
        R.split_tablet("a", "m", "m")


def test_lookup_many_tablets(spark) -> None:  # noqa: ANN001
    bounds = [f"{i:04d}" for i in range(0, 3000, 7)]
    tablets = spark.createDataFrame([(b, b) for b in bounds] + [("rest", None)], "tablet string, upper string")
    values = [f"{i:04d}" for i in range(3001)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["tablet"] for r in R.lookup_ranges(df, "v", tablets).collect()}
    import bisect

    assert got == {v: (bounds[i] if (i := bisect.bisect_left(bounds, v)) < len(bounds) else "rest") for v in values}


def test_checked_and_split(spark, tmp_path) -> None:  # noqa: ANN001
    from tessella.sources.formats import checked, read_records, split_by, write_sorted

    df = ints(spark, [1, 2, 3])
    assert checked(df, F.col("x") > 0, "too small").count() == 3
    with pytest.raises(Exception, match="too small"):
        checked(df, F.col("x") > 1, "too small").collect()
    split_by(df, F.col("x") % 2, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("part = 1").count() == 2
    (tmp_path / "r.bin").write_bytes(b"".join(i.to_bytes(4, "little") + (2 * i).to_bytes(8, "little") for i in range(5)))
    got = read_records(spark, str(tmp_path / "r.bin"), [("a", "i4"), ("b", "i8")]).collect()
    assert [tuple(r) for r in got] == [(i, 2 * i) for i in range(5)]
    cells = spark.createDataFrame([("r", "f:a", 1, "x"), ("q", "g:b", 2, "y")], "row string, column string, ts long, value string")
    write_sorted(cells, str(tmp_path / "w"), by_family=True)
    assert spark.read.parquet(str(tmp_path / "w")).filter("family = 'f'").count() == 1


def test_plans(spark) -> None:  # noqa: ANN001
    from tessella.operators.cells import keep_history, resolve
    from tessella.plans.predicate import parse

    d = "/root/testdata/sf0.001"
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("row"), F.col("o_orderpriority").alias("column"), F.col("o_orderkey").alias("ts"), F.col("o_orderstatus").alias("value"))
    plan = parse("row = 'F' and history = 1").apply(o)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "WindowGroupLimit" in plan
    log = o.withColumn("seq", F.col("ts"))
    below = keep_history(resolve(log), 1).filter("row = 'F'")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in below


def test_uniq_batches(spark) -> None:  # noqa: ANN001
    import pandas as pd

    rows = [(None if i % 3 == 0 else "ab"[i % 2], i, chr(97 + i % 26)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, i long, v string").repartition(7)
    want = {k: (max(i for q, i, _ in rows if q == k), "".join(v for q, _, v in rows if q == k)) for k in ("a", "b", None)}
    calls = spark.sparkContext.accumulator(0)

    def joined(g: pd.DataFrame) -> pd.DataFrame:
        assert len(g) <= 10
        assert g["k"].nunique(dropna=False) == 1
        return g.tail(1).assign(v="".join(g["v"]))

    def joined_many(g: pd.DataFrame, by: list[str]) -> pd.DataFrame:
        calls.add(1)
        assert g.groupby("__b").size().max() <= 10
        return g.groupby(by, as_index=False, dropna=False).agg({"i": "max", "v": "sum"})

    for fold, many in ((joined, False), (joined_many, True)):
        got = {r["k"]: (r["i"], r["v"]) for r in X.uniq_batches(df, ["k"], "i", fold, 10, many=many).collect()}
        assert got == want
    assert 0 < calls.value < 100  # not one for each of 2,000 batches
    with pytest.raises(ValueError, match="shrink"):
        X.uniq_batches(df, ["k"], "i", lambda g: g, 10)
    assert X.uniq_batches(df.filter("false"), ["k"], "i", joined, 10).count() == 0


def test_lookup_rows_meet_a_node_of_bounds_at_a_time(spark, monkeypatch) -> None:  # noqa: ANN001
    """Bounds of many levels; no bound, one bound, and numbers of bounds around the fan-out's powers."""
    import bisect

    values = [f"{i:04d}" for i in range(0, 1300, 3)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for n, fanout in ((0, 2), (1, 1), (2, 2), (3, 2), (4, 2), (5, 2), (16, 4), (17, 4), (600, 5)):
        bounds = [f"{2 * i:04d}" for i in range(n)]
        for rest in ([("rest", None)], []):
            tablets = spark.createDataFrame([(f"t{b}", b) for b in bounds] + [("u" + b, b) for b in bounds] + rest, "tablet string, upper string")
            got = {r["v"]: r["tablet"] for r in R.lookup_ranges(df, "v", tablets, fanout=fanout).collect()}
            last = "rest" if rest else None
            assert got == {v: None if v is None else "t" + bounds[i] if (i := bisect.bisect_left(bounds, v)) < n else last for v in values}
    # no row meets more than a node: of 600 bounds in nodes of five, not the 120 ends of the lowest nodes
    sent, send = [], R.F.broadcast
    monkeypatch.setattr(R.F, "broadcast", lambda x: sent.append(x) or send(x))
    R.lookup_ranges(df, "v", tablets, fanout=5)
    arrays = [c for x in sent for r in x.collect() for c in r if isinstance(c, list)]
    assert max(map(len, arrays)) <= 5
