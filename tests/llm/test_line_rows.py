from __future__ import annotations

import pytest

from tessella.llm import linededup

X, Y, Z = "X" * 25, "Y" * 25, "Z" * 25


def kept(spark, rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str | None, int]]:  # noqa: ANN001
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("i", [None, 7])
def test_rows_that_share_an_id_keep_their_own_lines(spark, i: int | None) -> None:  # noqa: ANN001
    got = kept(spark, [(i, f"{X}\n{Y}"), (i, f"{Z}\n{X}")])
    lines = [x for _, t, _ in got for x in t.split("\n")]
    assert sorted(lines) == [X, Y, Z]
    assert sorted(n for *_, n in got) == [0, 1]


@pytest.mark.parametrize("i", [None, 7])
def test_a_shorter_row_of_the_same_id(spark, i: int | None) -> None:  # noqa: ANN001
    rows = [(i, "a\nb\nc\nd\ne\n" + X), (i, "short\nrow"), (i, None), (i, ""), (-9, X)]
    got = kept(spark, rows)
    assert (i, "short\nrow", 0) in got
    assert (i, None, 0) in got
    assert (i, "", 0) in got
    # null ids come first and -9 comes before 7, so one of the two rows keeps X
    assert sum((t or "").count(X) for _, t, _ in got) == 1
    assert (-9, "" if i is None else X, int(i is None)) in got
