"""URIs: parts, resolution, normal forms, escapes and query parameters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generic form of RFC 3986, appendix B.
GENERIC = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"
_GROUPS = {"scheme": 2, "authority": 4, "path": 5, "query": 7, "fragment": 9}
_MARKERS = {"scheme": 1, "authority": 3, "query": 6, "fragment": 8}
#: What needs no escape in a path besides letters and digits: fixed values.
UNRESERVED, SAFE = "-._~", "/'!*:(),"


def part(c: Column, name: str) -> Column:
    """A part of a URI, null where it isn't there (a path always is)."""
    value = F.regexp_extract(c, GENERIC, _GROUPS[name])
    return value if name == "path" else F.when(F.regexp_extract(c, GENERIC, _MARKERS[name]) != "", value)


def user(c: Column) -> Column:
    a = part(c, "authority")
    return F.when(F.instr(a, "@") > 0, F.substring_index(a, "@", 1))


def host(c: Column) -> Column:
    return F.regexp_extract(part(c, "authority"), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)


def port(c: Column) -> Column:
    p = F.regexp_extract(part(c, "authority"), r"^(?:[^@]*@)?(?:\[[^\]]*\]|[^:]*):([0-9]+)$", 1)
    return F.when(p != "", p.try_cast("int"))


def query_value(c: Column, key: str) -> Column:
    """The value of a parameter's first occurrence, null without one."""
    pairs = F.split(part(c, "query"), "&")
    hits = F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == key)
    first = F.try_element_at(hits, F.lit(1))
    return F.when(F.instr(first, "=") > 0, first.substr(F.instr(first, "=") + 1, F.length(first))).otherwise(F.when(first.isNotNull(), ""))


def with_query_value(c: Column, key: str, value: str | None) -> Column:
    """The parameter's first occurrence set, or appended; all of them taken out for None."""
    base, fragment = F.regexp_replace(c, r"[?#].*$", ""), part(c, "fragment")
    pairs = F.filter(F.split(F.coalesce(part(c, "query"), F.lit("")), "&"), lambda p: p != "")
    mine = lambda p: F.substring_index(p, "=", 1) == key
    if value is None:
        out = F.filter(pairs, lambda p: ~mine(p))
    else:
        at = F.array_position(F.transform(pairs, mine), True)
        new = F.lit(f"{key}={value}")
        out = F.when(at > 0, F.transform(pairs, lambda p, i: F.when(i + 1 == at, new).otherwise(p))).otherwise(F.concat(pairs, F.array(new)))
    text = F.array_join(out, "&")
    return F.concat(base, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""), F.coalesce(F.concat(F.lit("#"), fragment), F.lit("")))


def top_scheme(c: Column) -> Column:
    """The first of schemes that are joined by +."""
    return F.substring_index(part(c, "scheme"), "+", 1)


def pop_scheme(c: Column) -> Column:
    """Without its first scheme: a+b://x is b://x, and a:x is x."""
    return F.when(F.instr(part(c, "scheme"), "+") > 0, F.regexp_replace(c, r"^[^:+]*\+", "")).otherwise(F.regexp_replace(c, r"^[^:/?#]+:", ""))


def push_scheme(c: Column, scheme: str) -> Column:
    return F.concat(F.lit(scheme), F.when(part(c, "scheme").isNotNull(), "+").otherwise(":"), c)


def encode_bytes(raw: bytes, plus: bool = False, safe: str = SAFE) -> str:
    """Bytes that aren't letters, digits or safe as %hh, in lower case; blanks as + if asked for."""
    keep = (UNRESERVED + safe).encode()
    plain = lambda b: b in keep or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122
    return "".join("+" if plus and b == 32 else chr(b) if plain(b) else f"%{b:02x}" for b in raw)


def decode_bytes(s: str, plus: bool = False) -> bytes:
    """Escapes resolved; one that is cut off ends the text, one with other characters than digits is dropped."""
    raw, out, i = s.encode(), bytearray(), 0
    while i < len(raw):
        if raw[i] == 37:
            two = raw[i + 1 : i + 3]
            if len(two) < 2:
                break
            if re.fullmatch(rb"[0-9A-Fa-f]{2}", two):
                out.append(int(two, 16))
            i += 3
            continue
        out.append(32 if plus and raw[i] == 43 else raw[i])
        i += 1
    return bytes(out)


def encode_text(s: str, plus: bool = False, safe: str = SAFE) -> str:
    return encode_bytes(s.encode(), plus, safe)


def decode_text(s: str, plus: bool = False) -> str:
    return decode_bytes(s, plus).decode("utf-8", "replace")


def _parts(s: str) -> dict[str, str | None]:
    m = re.match(GENERIC, s, re.S)
    return {k: m[i] for k, i in _GROUPS.items()}


def _join(p: dict[str, str | None]) -> str:
    out = "" if p["scheme"] is None else p["scheme"] + ":"
    out += "" if p["authority"] is None else "//" + p["authority"]
    out += p["path"] or ""
    out += "" if p["query"] is None else "?" + p["query"]
    return out + ("" if p["fragment"] is None else "#" + p["fragment"])


def remove_dots(path: str) -> str:
    out: list[str] = []
    segments = path.split("/")
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "..":
            if len(out) > 1 or (out and out[0]):
                out.pop()
            if last:
                out.append("")
        elif s == ".":
            if last:
                out.append("")
        else:
            out.append(s)
    return "/".join(out)


def resolve(base: str, reference: str) -> str:
    """The target of a reference in a base, by RFC 3986, section 5.2 (strict)."""
    b, r = _parts(base), _parts(reference)
    if r["scheme"] is not None:
        return _join({**r, "path": remove_dots(r["path"])})
    if r["authority"] is not None:
        return _join({**r, "scheme": b["scheme"], "path": remove_dots(r["path"])})
    t = {"scheme": b["scheme"], "authority": b["authority"], "fragment": r["fragment"]}
    if not r["path"]:
        return _join({**t, "path": b["path"], "query": b["query"] if r["query"] is None else r["query"]})
    if r["path"].startswith("/"):
        path = r["path"]
    elif b["authority"] is not None and not b["path"]:
        path = "/" + r["path"]
    else:
        path = b["path"][: b["path"].rfind("/") + 1] + r["path"]
    return _join({**t, "path": remove_dots(path), "query": r["query"]})


#: Ports that their schemes imply: fixed values.
PORTS = {"http": "80", "https": "443", "ftp": "21", "gopher": "70"}


def normalize(s: str) -> str:
    """Scheme and host in lower case and without the scheme's own port; dots and doubled slashes of the path
    resolved; only those escapes that are needed; parameters without a key, empty values, an empty query and an
    empty fragment left out."""
    p = _parts(s)
    p["scheme"] = p["scheme"] and p["scheme"].lower()
    if p["authority"] is not None:
        head, at, tail = p["authority"].rpartition("@")
        name = encode_bytes(decode_bytes(tail), safe=SAFE + "[]").lower()
        own = PORTS.get(p["scheme"] or "")
        p["authority"] = head + at + (name[: -len(own) - 1] if own and name.endswith(":" + own) else name)
    path = encode_bytes(decode_bytes(p["path"]), safe=SAFE + "+&=@;$")
    p["path"] = remove_dots(re.sub("/{2,}", "/", path))
    pairs = []
    for x in (p["query"] or "").split("&"):
        key, _, value = x.partition("=")
        shown = [encode_bytes(decode_bytes(y, True), True, SAFE + "?@;$") for y in (key, value)]
        if key:
            pairs.append("=".join(shown) if value else shown[0])
    p["query"] = "&".join(pairs) or None
    p["fragment"] = encode_bytes(decode_bytes(p["fragment"] or "")) or None
    return _join(p)


def _series(f):  # noqa: ANN001, ANN202
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else f(x)), "string")


def normalize_column(c: Column) -> Column:
    return _series(normalize)(c)


def encode_column(c: Column) -> Column:
    return _series(encode_text)(c)


def decode_column(c: Column) -> Column:
    return _series(decode_text)(c)


def resolve_column(base: Column, reference: Column) -> Column:
    def run(b: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else resolve(x, y) for x, y in zip(b, r, strict=True)])

    return F.pandas_udf(run, "string")(base, reference)
