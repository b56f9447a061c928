"""Nulls, repeats, ties and clashing names of the operators that share these cases."""

from __future__ import annotations

import pytest

from tessella.llm import ann, licenses, mixing, simhash, vectordup
from tessella.llm.license_texts import TEMPLATES
from tests.llm.test_text_ops import docs_of

ROWS = [(1, "one two three four", "a"), (1, "something else it is", "a"), (None, "one two three four", None), (None, None, "b"), (2, "", "b"), (2, "", "b"), (3, "one two three four", None)]


def table(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


def test_simhash_repeated_and_null_ids(spark) -> None:  # noqa: ANN001
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(table(spark)).collect())
    # rows without an id are left out, rows that repeat one are a row each
    assert got == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 1)]


def test_mix_repeated_and_null_ids(spark) -> None:  # noqa: ANN001
    rows = mixing.mix(table(spark), keep=["doc_id", "source"]).collect()
    again = mixing.mix(table(spark).repartition(3), keep=["doc_id", "source"]).collect()
    key = lambda r: (str(r["doc_id"]), r["mix_size"], r["mix_repeats"], str(r["source"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert len(rows) == len(ROWS)
    whole = [sorted(map(str, mixing.mixed(table(spark).repartition(n)).collect())) for n in (1, 4)]
    assert whole[0] == whole[1]


def test_vectors_of_other_dimensions(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="dimensions"):
        ann.nearest_neighbours(df, "vec_id = 0")
    got = {r["vec_id"]: r["component_id"] for r in vectordup.vector_groups(df).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_neighbours_in_double_precision(spark) -> None:  # noqa: ANN001
    df = spark.createDataFrame([(0, [1.0, 1e-12]), (1, [1.0, 2e-12]), (2, [1.0, 4e-12]), (3, [1.0, 2e-12])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"]) for r in ann.nearest_neighbours(df, "vec_id = 0").collect())
    assert got == [(1, 1), (2, 3), (3, 2)]


def test_licences_clash_and_repeats(spark) -> None:  # noqa: ANN001
    mit = TEMPLATES["MIT"][2]
    df = docs_of(spark, [mit, mit, None])
    with pytest.raises(ValueError, match="already"):
        licenses.scan_licenses(df.withColumnRenamed("lang", "licenses"))
    got = licenses.license_rows(df.withColumnRenamed("lang", "license")).collect()
    assert sorted((r["doc_id"], r["license"], r["coverage"]) for r in got) == [(0, "MIT", 1.0), (1, "MIT", 1.0)]
