from __future__ import annotations

import re

import pytest

from tests.llm.test_text_ops import docs_of, luhn, pseudonyms
from tessella.llm import pii

LOW = "9233a8ecf7" * 4


def test_upper_case_secrets(spark) -> None:  # noqa: ANN001
    md5 = "AB12" + "0C3D" * 7
    got = pseudonyms(spark, [LOW, f'TOKEN = "{LOW.upper()}"', LOW[:10].upper() + LOW[10:], md5, f"{md5} XYZ", md5.lower(), "A" * 40])
    assert re.fullmatch("[0-9a-f]{40}", got[0])
    assert got[0] != LOW
    assert got[1] == f'TOKEN = "{got[0].upper()}"'
    assert got[2] == got[0]
    assert re.fullmatch("[0-9A-F]{32}", got[3])
    assert got[3] != md5
    assert got[4] == f"{got[3]} XYZ"
    assert got[5] == got[3].lower()
    assert got[6] == "A" * 40


CARD = "4111 1111 1111 1111"


@pytest.mark.parametrize("after", [" 123", " 12/26", "-123 x"])
def test_cards_before_other_digits(spark, after: str) -> None:  # noqa: ANN001
    alone, got = pseudonyms(spark, [CARD, CARD + after])
    assert luhn(re.sub(r"\D", "", alone))
    assert alone != CARD
    assert got == alone + after


def test_what_follows_a_card_is_searched(spark) -> None:  # noqa: ANN001
    given = [CARD, "123-45-6789", f"{CARD} 123-45-6789", "10.1.2.3", f"a {CARD} 10.1.2.3, b@c.de {CARD} 12 {CARD}", "4111 1111 1111 1112 123"]
    rows = sorted(pii.pseudonymise(docs_of(spark, given), "k").collect(), key=lambda r: r["doc_id"])
    got = [r["text"] for r in rows]
    assert got[2] == f"{got[0]} {got[1]}"
    assert got[4].startswith(f"a {got[0]} {got[3]}, u")
    assert got[4].endswith(f".invalid {got[0]} 12 {got[0]}")
    assert got[5] == given[5]
    assert [r["pii_count"] for r in rows] == [1, 1, 2, 1, 5, 0]
    assert rows[4]["pii_kinds"] == ["card", "email", "ip"]


def test_social_security_numbers_stay_valid(spark) -> None:  # noqa: ANN001
    given = [f"{a:03d}-{g:02d}-{n:04d}" for a in (1, 2, 665, 667, 668, 899) for g in (1, 50, 99) for n in (1, 77, 5000, 9999)]
    got = pseudonyms(spark, given)
    assert len(set(got)) == len(given)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in got)
    assert sum(a == b for a, b in zip(given, got, strict=True)) <= 1


def test_dates_of_any_year(spark) -> None:  # noqa: ANN001
    from datetime import date

    given = ["0001-01-01", "0199-12-31", "0200-01-01", "1799-12-31", "1800-01-01", "2201-01-01", "9799-12-31", "9800-01-01", "9999-12-31", "2024-02-29", "1999-02-29", "31/12/1750"]
    got = pseudonyms(spark, given)
    assert got[10] == given[10]
    for a, b in zip(given[:10], got[:10], strict=True):
        x, y = date.fromisoformat(a), date.fromisoformat(b)
        assert a != b
        assert (x.year + 200) // 400 == (y.year + 200) // 400
    assert got[11] != given[11]
