"""PII: format-preserving pseudonyms by keyed Feistel permutations, in DataFrame operations only.

A text is matched once for all kinds.  What a kind's check confirms (Luhn or mod-97 digits, octets up to
255, a day of the calendar) is permuted within its format by a Feistel network whose round function is
SHA-256 under a secret key, so that a value has the same pseudonym wherever it occurs, two values never
have one, and the result passes the same check.  Addresses and secrets, which have no format that bounds them,
get keyed hashes of a like form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8

#: Patterns of the kinds, in order of precedence; all in the syntax of java.util.regex.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){1,8}",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z/\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/\-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .\-]?[0-9]{2,4}){2,3}(?![0-9A-Za-z])|(?<![0-9A-Za-z+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[.\-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: All kinds at once, behind a look at the characters that any of them starts with.
ANY = "|".join(PATTERNS.values())

#: Days are permuted within 400 Gregorian years, of which the years from 200 to 9799 have 24, and within the years before
#: and after these: (first day, counted from the first of year 1; days as the product of a network's halves).
DAY_ONE = "0001-01-01"
ERA_FROM, ERAS, ERA = 72_683, 24, (189, 773)
BEFORE, AFTER = (13, 5591), (184, 397)
#: Areas, and groups with serials, of valid social security numbers.
SSN_AREAS, SSN_REST = 898, 99 * 9_999


def _prf(key: str, tag: Column, number: Column, i: Column) -> Column:
    """48 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), number.cast("string")), 256), 1, 12), 16, 10).cast("long")


def feistel(x: Column, y: Column, mx: Column, my: Column, key: str, tag: Column) -> Column:
    """Struct (x, y) after the rounds: a permutation of [0, mx) x [0, my), in sums modulo either."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), mx.cast("long").alias("mx"), my.cast("long").alias("my"))

    def turn(s: Column, i: Column) -> Column:
        mixed = F.pmod(s["x"] + _prf(key, tag, s["y"], i), s["mx"])
        return F.struct(s["y"].alias("x"), mixed.alias("y"), s["my"].alias("mx"), s["mx"].alias("my"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A string of 2 to 36 digits, permuted among all strings of as many digits."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    out = feistel(F.substring(digits, F.lit(1), a).cast("long"), F.substring(digits, a + 1, n).cast("long"), _power(a), _power(n - a), key, F.concat(F.lit(tag), n.cast("string")))
    return _let(out, lambda s: F.concat(F.lpad(s["x"].cast("string"), a, "0"), F.lpad(s["y"].cast("string"), n - a, "0")))


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column, head: Column | int = 0) -> Column:
    """m with its digits from position `head` (of digits) on replaced by others, one for one."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(m)),
        lambda i: F.when(
            F.substring(m, i, F.lit(1)).rlike("[0-9]"),
            _let(F.length(_digits(F.substring(m, F.lit(1), i))), lambda n: F.when(n <= head, F.substring(m, i, F.lit(1))).otherwise(F.substring(digits, n - head, F.lit(1)))),
        ).otherwise(F.substring(m, i, F.lit(1))),
    )
    return F.array_join(each, "")


def luhn_sum(digits: Column, check_included: bool = True) -> Column:
    """Sum of digits, every second from the right doubled (the first, where the check digit is not there yet)."""
    n = F.length(digits)
    odd = 0 if check_included else 1
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + _let(F.substring(digits, i, F.lit(1)).cast("int"), lambda d: F.when((n - i + odd) % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))),
    )


def _card_end(m: Column) -> Column:
    """Length of the longest start of m that ends where a group of digits does and passes Luhn; null if none does."""
    ends = F.filter(
        F.sequence(F.length(m), F.lit(13), F.lit(-1)),
        lambda n: F.substring(m, n + 1, F.lit(1)).isin("", " ", "-") & _let(_digits(F.substring(m, F.lit(1), n)), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)),
    )
    return F.when(luhn_sum(_digits(m)) % 10 == 0, F.length(m)).otherwise(F.get(ends, F.lit(0)))


def _card(m: Column, key: str) -> Column:
    def masked(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        full = _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, False), F.lit(10)).cast("string")))
        return _let(full, lambda f: _refill(m, f))

    return _let(_digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, masked(d)))


def _phone(m: Column, key: str) -> Column:
    """The country's code stays."""
    code = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .\-(])", 1))

    def masked(d: Column) -> Column:
        return _let(permute_digits(F.substring(d, code + 1, F.length(d)), key, "phone"), lambda p: _refill(m, p, code))

    return _let(_digits(m), lambda d: F.when((F.length(d) - code).between(7, 14), masked(d)))


def _ssn(m: Column, key: str) -> Column:
    """Areas but 000, 666 and those from 900 on, groups but 00 and serials but 0000 go to such again."""
    good = ~m.rlike("^(000|666|9)") & ~m.rlike("^...-00|0000$")
    area, group, serial = (F.substring(m, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9_999 + serial - 1, F.lit(SSN_AREAS), F.lit(SSN_REST), key, F.lit("ssn"))
    new_area = lambda s: s["x"] + F.when(s["x"] >= 665, 2).otherwise(1)
    digits = lambda s: F.format_string("%03d-%02d-%04d", new_area(s), F.floor(s["y"] / 9_999) + 1, s["y"] % 9_999 + 1)
    return F.when(good, _let(out, digits))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    halves = lambda p: feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    shown = lambda s: F.concat_ws(".", *(F.pmod(F.floor(s[h] / d), F.lit(256)).cast("string") for h in ("x", "y") for d in (256, 1)))
    return _let(parts, lambda p: F.when(F.array_max(p) <= 255, _let(halves(p), shown)))


def _date(m: Column, key: str) -> Column:
    """Year first, or day and month in whichever order the calendar allows (day first, if both)."""
    slash = m.contains("/")
    y = F.when(slash, F.substring(m, 7, 4)).otherwise(F.substring(m, 1, 4)).cast("int")
    a, b = (F.when(slash, F.substring(m, i, 2)).otherwise(F.substring(m, j, 2)).cast("int") for i, j in ((4, 6), (1, 9)))
    as_date = lambda y, mo, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd")
    day_first = as_date(y, a, b)
    month_first = F.when(slash, as_date(y, b, a))
    first = F.lit(DAY_ONE).cast("date")

    def moved(n: Column) -> Column:
        """Days since the first of year 1, permuted within the era that they are in."""
        size = ERA[0] * ERA[1]
        era = F.when(n < ERA_FROM, -1).otherwise(F.least(F.floor((n - ERA_FROM) / size), F.lit(ERAS)))
        start = F.when(era < 0, 0).otherwise(ERA_FROM + era * size)
        low = F.when(era < 0, BEFORE[1]).when(era < ERAS, ERA[1]).otherwise(AFTER[1])
        high = F.when(era < 0, BEFORE[0]).when(era < ERAS, ERA[0]).otherwise(AFTER[0])
        place = F.struct((n - start).cast("long").alias("n"), start.cast("long").alias("start"), low.alias("low"), high.alias("high"))
        turned = lambda p: _let(feistel(F.floor(p["n"] / p["low"]), p["n"] % p["low"], p["high"], p["low"], key, F.lit("date")), lambda s: (p["start"] + s["x"] * p["low"] + s["y"]).cast("int"))
        return _let(place, turned)

    def masked(d: Column) -> Column:
        style = F.when(~slash, F.lit("yyyy-MM-dd")).when(day_first.isNotNull(), F.lit("dd/MM/yyyy")).otherwise(F.lit("MM/dd/yyyy"))
        back = lambda n: F.date_add(first, n)
        shown = lambda n: F.when(style == "yyyy-MM-dd", F.date_format(back(n), "yyyy-MM-dd")).when(style == "dd/MM/yyyy", F.date_format(back(n), "dd/MM/yyyy")).otherwise(F.date_format(back(n), "MM/dd/yyyy"))
        return _let(F.datediff(d, first), lambda n: F.when(n >= 0, _let(moved(n), shown)))

    return _let(F.coalesce(day_first, month_first), lambda d: F.when(d.isNotNull(), masked(d)))


def _mod97(s: Column) -> Column:
    """Of letters (A = 10 and so on) and digits read as one number."""
    each = F.transform(F.split(s, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).when(c.rlike("[A-Z]"), F.ascii(c) - 55))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: F.pmod(a * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))


def _iban(m: Column, key: str) -> Column:
    """Letters and their places stay; the account's digits are permuted and the check digits follow."""

    def masked(s: Column) -> Column:
        body = F.substring(s, F.lit(5), F.length(s))
        rest = _let(_digits(body), lambda d: F.when(F.length(d) >= 2, permute_digits(d, key, "iban")).otherwise(d))
        check = lambda r: F.lpad((98 - _mod97(F.concat(_refill(body, r), F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return _let(rest, lambda r: _refill(m, F.concat(check(r), r)))

    return _let(F.replace(m, F.lit(" "), F.lit("")), lambda s: F.when(_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1, masked(s)))


def _email(m: Column, key: str) -> Column:
    return _let(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), lambda h: F.concat(F.lit("u"), F.substring(h, 1, 16), F.lit("@"), F.substring(h, 17, 8), F.lit(".invalid")))


def _secret(m: Column, key: str) -> Column:
    """One pseudonym for a value in either case; upper case stays upper case."""
    low = F.lower(m)
    made = F.substring(F.concat(F.sha2(F.concat(F.lit(f"{key}|secret|1|"), low), 256), F.sha2(F.concat(F.lit(f"{key}|secret|2|"), low), 256)), F.lit(1), F.length(m))
    return F.when((m == F.upper(m)) & (m != low), F.upper(made)).otherwise(made)


_KINDS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace the PII in `text`; append pii_count and pii_kinds (sorted, without repeats).

    What no check confirms stays as it is.  A null text stays null with a count of 0, as an empty one
    does; texts are searched whole; rows that repeat are treated alike; an empty table gives an empty
    one; other columns pass, but pii_count or pii_kinds among them is an error.  Nothing is shuffled.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    fresh(df, "pii_count", "pii_kinds")
    t = F.col(text)

    def renamed(m: Column) -> Column:
        """to: what stands for m; kind; rest: what of m comes after a card that ends early."""
        kind, new = F, F
        for name, make in _KINDS.items():
            test = m.contains("@") if name == "email" else m.rlike(f"^(?:{PATTERNS[name]})$")
            if name == "card":
                made = _let(_card_end(m), lambda n: F.struct(F.when(n.isNotNull(), _card(F.substring(m, F.lit(1), n), key)).alias("to"), n.alias("n")))
            else:
                made = F.struct(make(m, key).alias("to"), F.length(m).alias("n"))
            kind, new = kind.when(test, F.lit(name)), new.when(test, made)
        taken = lambda x: x["to"].isNotNull()
        return _let(new, lambda x: F.struct(F.coalesce(x["to"], m).alias("to"), F.when(taken(x), kind).alias("kind"), F.when(taken(x), F.substring(m, x["n"] + 1, F.length(m))).otherwise("").alias("rest")))

    def scanned(t: Column, again: bool = True) -> Column:
        """The text with its matches renamed, and their kinds; what follows a card that ends early is searched once more."""

        def joined(m: Column) -> Column:
            parts = F.split(t, ANY, -1)
            if again:
                plain = lambda rest, part: F.struct(F.concat(rest, part).alias("text"), F.array().cast("array<string>").alias("kinds"))
                tail = lambda x, part: F.when(x["rest"] == "", plain(x["rest"], part)).otherwise(_let(F.concat(x["rest"], part), lambda y: F.coalesce(scanned(y, False), plain(y, F.lit("")))))
            else:
                tail = lambda x, part: F.struct(F.concat(x["rest"], part).alias("text"), F.array().cast("array<string>").alias("kinds"))

            def shown(p: Column) -> Column:
                each = F.zip_with(m, F.slice(p, F.lit(2), F.size(m)), lambda x, part: _let(tail(x, part), lambda y: F.struct(F.concat(x["to"], y["text"]).alias("text"), F.concat(F.array(x["kind"]), y["kinds"]).alias("kinds"))))
                return _let(each, lambda e: F.struct(F.concat(p[0], F.array_join(e["text"], "")).alias("text"), F.filter(F.flatten(e["kinds"]), lambda k: k.isNotNull()).alias("kinds")))

            return _let(parts, shown)

        return _let(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda found: F.when(F.size(found) > 0, _let(F.transform(found, renamed), joined)))

    out = df.withColumn("__m", F.when(t.rlike("[0-9@]"), scanned(t)))
    hits = F.coalesce(F.col("__m.kinds"), F.array().cast("array<string>"))
    out = out.withColumn("__t", F.coalesce(F.col("__m.text"), t)).withColumn("pii_count", F.size(hits)).withColumn("pii_kinds", F.array_sort(F.array_distinct(hits)))
    return out.select(*(F.col("__t").alias(c) if c == text else F.col(c) for c in df.columns), "pii_count", "pii_kinds")
