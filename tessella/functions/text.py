"""Text functions: as columns where Spark has what they need, as plain functions for literals."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes of one letter.
_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_NAMES = {v: k for k, v in _ESCAPES.items()}


def unescape(s: str) -> str:
    r"""Resolve \n and its like, \xHH, \uHHHH, \UHHHHHHHH; any other character behind a backslash is itself."""

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "xuU" and len(x) > 1:
            return chr(int(x[1:], 16))
        return _ESCAPES.get(x, x)

    if re.search(r"(?<!\\)(?:\\\\)*\\$", s):
        raise ValueError(f"an escape has no end: {s!r}")
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.S)


def escape(s: str) -> str:
    """With escapes for quotes, backslashes and what can't be printed."""
    return "".join("\\" + c if c in '"\\' else f"\\{_NAMES[c]}" if c in _NAMES else f"\\x{ord(c):02x}" if ord(c) < 32 or 127 <= ord(c) < 256 else c for c in s)


def quote(s: str) -> str:
    return f'"{escape(s)}"'


def ascii_lower(c: Column) -> Column:
    """A-Z only: Unicode's lower would turn other letters into ASCII ones."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def alpha_normalize(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, with one blank between them."""
    return F.trim(ascii_lower(F.regexp_replace(c, "[^A-Za-z]+", " ")))


def replace_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def hex_string(c: Column) -> Column:
    return F.lower(F.hex(c))


def dehex(c: Column) -> Column:
    return F.unhex(c)


def parse_int(c: Column) -> Column:
    """The whole text as a number, null for anything else."""
    return F.when(c.rlike("^-?[0-9]+$"), c.try_cast("long"))


def parse_float(c: Column) -> Column:
    return F.when(c.rlike(r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"), c.try_cast("double"))


_SUFFIXES = "KMGTPE"


def size_string(n: Column, base: int = 1024, suffixes: str = _SUFFIXES) -> Column:
    """Divided by the base until below its square, with one digit and a suffix; whole below the base.

    What the last suffix is too small for stays in its unit, however many digits that takes.
    """
    out = F.concat(n.cast("string"), F.lit(" "))
    shown = F
    for i, suffix in enumerate(suffixes, 1):
        top = float(base) ** (i + 1)
        # ties go to the even digit, as in C
        value = F.format_string("%.1f" + suffix, F.bround(n.cast("double") / float(base) ** i, 1))
        shown = shown.when(n < top if i < len(suffixes) else n.isNotNull(), value)
    return F.when(n < base, out).otherwise(shown)


def parse_size(c: Column) -> Column:
    """Digits, perhaps a fraction and one of kKmMgG, as a whole number; null for anything else."""
    form = r"^([0-9]+(?:\.[0-9]+)?)([kKmMgG]?)$"
    number = F.regexp_extract(c, form, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(c, form, 2))
    by = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.when(c.rlike(form), F.floor(number * by).cast("long"))


def lines(c: Column) -> Column:
    """Lines that end with CR, LF or both."""
    return F.split(c, "\r\n|\r|\n")


def xml_escape(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_escape_quoted(c: Column, single: bool = True) -> Column:
    """Escaped for an attribute in double quotes and, if asked for, in single ones."""
    out = F.replace(xml_escape(c), F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&apos;")) if single else out


def xml_characters(c: Column) -> Column:
    """Without the characters that XML 1.0 has no place for."""
    return F.regexp_replace(c, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def host_key(host: Column) -> Column:
    """A host's labels from the last to the first, so that order goes by domain."""
    return F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ".")


def pseudo_numeric_order(c: Column) -> list[Column]:
    """Sort keys: whole numbers first, by value, then the rest."""
    n = parse_int(c)
    return [n.isNull(), n, c]


def variables(template: str, values: dict[str, str]) -> str:
    """$name, $(name), ${name} and $[name] by their values, $$ by a dollar sign; names without a value are empty.

    A bare name starts with a letter; a dollar sign before anything else is itself.
    """

    def one(m: re.Match) -> str:
        name = next((g for g in m.groups() if g is not None), None)
        return "$" if name is None else values.get(name, "")

    return re.sub(r"\$(?:\$|([A-Za-z_]\w*)|\(([^)]*)\)|\{([^}]*)\}|\[([^\]]*)\])", one, template)


def config_map(c: Column) -> Column:
    """Lines of `key = value` as a map; lines without a key are left out, and of repeated keys the last counts."""
    pairs = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*[^=\s][^=]*="))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)
