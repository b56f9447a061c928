"""HTML tokens and plain texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKEN = "array<struct<kind string, text string, tag string, opens boolean, closes boolean, attributes map<string,string>>>"
_MARKUP = re.compile(r"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<!(?P<declaration>[^>]*)>|<(?P<slash>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


def tokens(html: str) -> Iterator[dict]:
    """TAG, TEXT, COMMENT, DECLARATION and CDATA tokens in order; bodies of script and style are CDATA, and markup
    that has no end is text."""

    def plain(kind: str, text: str) -> dict:
        return {"kind": kind, "text": text, "tag": None, "opens": False, "closes": False, "attributes": None}

    at = 0
    while at < len(html):
        m = _MARKUP.search(html, at)
        if not m:
            yield plain("TEXT", html[at:])
            return
        if m.start() > at:
            yield plain("TEXT", html[at : m.start()])
        at = m.end()
        for kind in ("comment", "cdata", "declaration"):
            if m[kind] is not None:
                yield plain(kind.upper(), m[kind])
                break
        else:
            tag, rest = m["tag"].lower(), m["rest"]
            empty = rest.endswith("/")
            names: dict[str, str] = {}
            for a in _ATTRIBUTE.finditer(rest):
                names.setdefault(a[1].lower(), next((x for x in a.groups()[1:] if x is not None), ""))
            yield {"kind": "TAG", "text": m[0], "tag": tag, "opens": not m["slash"], "closes": bool(m["slash"]) or empty, "attributes": names}
            if tag in ("script", "style") and not m["slash"] and not empty:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                stop = end.start() if end else len(html)
                if stop > at:
                    yield plain("CDATA", html[at:stop])
                at = stop


def strip_text(html: str, spaces: bool = True) -> str:
    """The TEXT tokens; where something else stood between two of them, one blank."""
    out, apart = [], False
    for t in tokens(html):
        if t["kind"] == "TEXT":
            if apart and out and spaces:
                out.append(" ")
            out.append(t["text"])
            apart = False
        else:
            apart = True
    return "".join(out)


#: Bytes of an Arrow batch of pages between Spark and a Python worker, unless one page alone has more.
BATCH_BYTES = 4 << 20
#: Pages whose tokens a worker holds as Python objects.
PAGES = 64
_MAPS = pa.map_(pa.string(), pa.string())
_TOKENS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("tag", pa.string()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("attributes", _MAPS)]))


def _small_batches() -> None:
    """Bound the Arrow batches of the session by bytes: ten thousand pages, Spark's bound, have any size."""
    spark = SparkSession.active()
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _all_tokens(html: str | None) -> list[dict] | None:
    if html is None:
        return None
    return [t | {"attributes": None if t["attributes"] is None else list(t["attributes"].items())} for t in tokens(html)]


def token_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The tokens of each page as an Arrow array, some pages at a time: as Python objects they take many times their bytes."""
    for b in batches:
        parts = (pa.array([_all_tokens(x) for x in b.slice(at, PAGES).to_pylist()], _TOKENS) for at in range(0, len(b), PAGES))
        yield pa.concat_arrays([pa.array([], _TOKENS), *parts])


# the annotations name the kind of function that arrow_udf makes of it
token_arrays.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def token_column(c: Column) -> Column:
    _small_batches()
    return F.arrow_udf(token_arrays, TOKEN)(c)


def strip_column(c: Column, spaces: bool = True) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else strip_text(x, spaces))

    _small_batches()
    return F.pandas_udf(run, "string")(c)


def strip_plain(c: Column) -> Column:
    """Well-formed pages without Python: scripts, styles, comments and tags cut out, one blank for each stretch of them."""
    return F.regexp_replace(F.regexp_replace(c, r"(?is)(?:<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>)+", " "), "^ | $", "")
