from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import encode, hashing, html, robots, text, uri
from tessella.plans.times import format_time, parse_time, phrase_time, show_time


def one(spark, column, **values):  # noqa: ANN001, ANN003, ANN201
    names = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], names).select(column).first()[0]


ALPHA = [("foo", "foo"), ("foo bar", "foo bar"), ("Foo   baR", "foo bar"), ("***FOO--1234--BAR!!!", "foo bar"), ("  How now,\n Brown Cow?\r\n", "how now brown cow"), ("", ""), ("!", ""), (">>8!  :)", "")]


def test_text(spark) -> None:  # noqa: ANN001
    for given, want in ALPHA:
        assert one(spark, text.alpha_normalize(F.col("a")), a=given) == want
    assert one(spark, text.ascii_lower(F.col("a")), a="AZ\u212a") == "az\u212a"
    assert one(spark, text.size_string(F.lit(512))) == "512 "
    assert one(spark, text.size_string(F.lit(1536))) == "1.5K"
    assert one(spark, text.parse_size(F.col("a")), a="1.5k") == 1536
    assert one(spark, text.parse_size(F.col("a")), a="x") is None
    assert one(spark, text.parse_int(F.col("a")), a="12a") is None
    assert one(spark, text.parse_float(F.col("a")), a="-1.5e2") == -150.0
    assert one(spark, text.lines(F.col("a")), a="a\r\nb\rc\nd") == ["a", "b", "c", "d"]
    assert one(spark, text.config_map(F.col("a")), a="a = 1\nnothing\n b=2\na = 3") == {"a": "3", "b": "2"}


def test_large_sizes(spark) -> None:  # noqa: ANN001
    assert one(spark, text.size_string(F.lit(3 << 40))) == "3.0T"
    assert one(spark, text.size_string(F.lit(3 << 40), suffixes="KMG")) == "3072.0G"
    assert one(spark, text.size_string(F.lit(1 << 62))) == "4.0E"
    assert one(spark, text.size_string(F.lit(None).cast("long"))) is None


def test_size_query_beyond_a_terabyte(spark, tmp_path) -> None:  # noqa: ANN001
    spark.range(262_143, 262_146).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    from tessella.queries import QUERIES

    got = {r["n"]: r["s"] for r in QUERIES["fn_size_string"](spark, str(tmp_path)).collect()}
    assert got == {1099503239184: "1024.0G", 1099511627776: "1024.0G", 1099520016400: "1024.0G"}


def test_escapes() -> None:
    assert text.unescape(r"a\n\x41\u00e9\q\\") == "a\nA\u00e9q\\"
    assert text.escape('a"\n\x01\\') == r"a\"\n\x01\\"
    for s in ["", "\x00\x7f\xff", 'q"\\', "\u4e2d"]:
        assert text.unescape(text.escape(s)) == s
    with pytest.raises(ValueError):
        text.unescape("a\\")


def test_variables() -> None:
    v = {"x": "marks the spot", "1": "is the loneliest number", "": "No", "v": "$var", "var": "$v"}
    for given, want in [("X $x", "X marks the spot"), ("X $$x", "X $x"), ("X $(x)", "X marks the spot"), ("X ${x}", "X marks the spot"), ("X $[x]", "X marks the spot"), ("X $<x>", "X $<x>"), ("One $1", "One $1"), ("One $(1)", "One is the loneliest number"), ("No $", "No $"), ("$[]", "No"), ("$v", "$var")]:
        assert text.variables(given, v) == want


def test_uri_texts() -> None:
    decoded = [("", ""), ("%2", ""), ("%20", " "), ("w%xyz", "wz"), ("foo%20bar", "foo bar"), ("foo+bar", "foo+bar")]
    for given, want in decoded:
        assert uri.decode_text(given) == want
    assert uri.decode_text("foo+bar", True) == "foo bar"
    assert uri.encode_text("`~!@#$%^&*()_-+=", True) == "%60~!%40%23%24%25%5e%26*()_-%2b%3d"
    assert uri.encode_text("{}[]\\|:;\"'<>,./?", True) == "%7b%7d%5b%5d%5c%7c:%3b%22'%3c%3e,./%3f"
    assert uri.encode_text("hi there", True) == "hi+there"
    assert uri.encode_text("`~!@#$%^&*()_-+=", False, "") == "%60~%21%40%23%24%25%5e%26%2a%28%29_-%2b%3d"


NORMAL = [
    ("", ""), ("//", "//"), (":", ":"), ("some/path", "some/path"), ("some//path", "some/path"), ("./some//path/..///stuff/./.", "some/stuff/"),
    ("/space out/path/", "/space%20out/path/"), ("not/a/scheme:", "not/a/scheme:"), ("%6F%76%65%72%65%6E%63%6F%64%65%64%2F%70%61%74%68", "overencoded/path"),
    ("path/containing/a+plus", "path/containing/a+plus"), ("?", ""), ("?q=x", "?q=x"), ("?q==x", "?q=%3dx"), ("?x=", "?x"), ("?x=&", "?x"), ("?x=&y", "?x&y"),
    ("?x=&y=v", "?x&y=v"), ("?=x", ""), ("?=x&y", "?y"), ("?==&&x==&&z&&&==", "?x=%3d&z"), ("?==&&x== foo&&z %20= ?&&&==", "?x=%3d+foo&z++=+?"),
    ("#", ""), ("#f", "#f"), ("#f stop", "#f%20stop"), ("HTTP://www.EXAM%70%6C%65.Com///./..///./index.html?=&=#", "http://www.example.com/index.html"),
    ("http://dont.add.slash.com", "http://dont.add.slash.com"), ("http://foo.com:80/", "http://foo.com/"), ("http://foo.com:443/", "http://foo.com:443/"),
    ("https://foo.com:443/", "https://foo.com/"), ("ftp://foo.com:21/", "ftp://foo.com/"), ("gopher://foo.com:70/", "gopher://foo.com/"),
]


@pytest.mark.parametrize(("given", "want"), NORMAL)
def test_uri_normal(given: str, want: str) -> None:
    assert uri.normalize(given) == want


def test_uri_resolve() -> None:
    want = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../../../g": "http://a/g", "g;x=1/../y": "http://a/b/c/y"}
    for r, t in want.items():
        assert uri.resolve("http://a/b/c/d;p?q", r) == t


def test_uri_columns(spark) -> None:  # noqa: ANN001
    u = "a+b://me@host:81/p/q?x=1&y&x=2#f"
    parts = {n: one(spark, uri.part(F.col("u"), n), u=u) for n in ("scheme", "authority", "path", "query", "fragment")}
    assert parts == {"scheme": "a+b", "authority": "me@host:81", "path": "/p/q", "query": "x=1&y&x=2", "fragment": "f"}
    assert one(spark, uri.host(F.col("u")), u=u) == "host"
    assert one(spark, uri.port(F.col("u")), u=u) == 81
    assert one(spark, uri.user(F.col("u")), u=u) == "me"
    assert one(spark, uri.query_value(F.col("u"), "x"), u=u) == "1"
    assert one(spark, uri.query_value(F.col("u"), "y"), u=u) == ""
    assert one(spark, uri.query_value(F.col("u"), "z"), u=u) is None
    assert one(spark, uri.with_query_value(F.col("u"), "x", "9"), u=u) == "a+b://me@host:81/p/q?x=9&y&x=2#f"
    assert one(spark, uri.with_query_value(F.col("u"), "x", None), u=u) == "a+b://me@host:81/p/q?y#f"
    assert one(spark, uri.top_scheme(F.col("u")), u=u) == "a"
    assert one(spark, uri.pop_scheme(F.col("u")), u=u).startswith("b://")
    assert one(spark, uri.push_scheme(F.col("u"), "c"), u=u).startswith("c+a+b://")


ROBOTS = "# Comments\nUsER-agENT:    *   # all\nDisallow:   / # out\n\ngarbage\n\nUser-Agent: FancyBot\nDisallow:  \n\n\nuser-agent:   SpecialBot\nUser-agent: NotSoSpecialBot   \n  Allow: /searchhistory/\nDisallow: /news?output=xhtml&\nALLOW  : /news?output=xhtml  \n# middle\nDisallow: /search\n  DisalloW :/images  \nDisallow: /?"


def test_robots(spark) -> None:  # noqa: ANN001
    assert not robots.allowed(ROBOTS, "SillyBot", "/something")
    assert robots.allowed(ROBOTS, "fancyBOT", "/?anything")
    for bot in ("specialbot", "NOtSoSPECIAlBOt"):
        for path, ok in {"/": True, "/search": False, "/searchstuff/foo": False, "/searchhistory/foo": True, "/?anything": False, "/news?output=xhtml2": True, "/news?output=xhtml&page=2": False, "/image": True, "/images/": False}.items():
            assert robots.allowed(ROBOTS, bot, path) == ok
    rules = spark.createDataFrame(robots.rules(ROBOTS, "SpecialBot"), "prefix string, ok boolean").withColumn("h", F.lit(1))
    pages = spark.createDataFrame([(1, "/search"), (1, "/searchhistory/x"), (2, "/search")], "h int, p string")
    got = {(r["h"], r["p"]): r["allowed"] for r in robots.match_rules(pages, F.col("p"), rules, ["h"]).collect()}
    assert got == {(1, "/search"): False, (1, "/searchhistory/x"): True, (2, "/search"): True}


def test_html(spark) -> None:  # noqa: ANN001
    page = '<!DOCTYPE html><p class="a" id=b>x<br/>y</p><script>if(a<b)</script><!-- c -->z <b'
    kinds = [(t["kind"], t["tag"]) for t in html.tokens(page)]
    assert kinds == [("DECLARATION", None), ("TAG", "p"), ("TEXT", None), ("TAG", "br"), ("TEXT", None), ("TAG", "p"), ("TAG", "script"), ("CDATA", None), ("TAG", "script"), ("COMMENT", None), ("TEXT", None)]
    assert html.strip_text(page) == "x y z <b"
    assert html.strip_text(page, spaces=False) == "xyz <b"
    assert one(spark, html.strip_column(F.col("a")), a=page) == "x y z <b"
    assert one(spark, html.strip_column(F.col("a")), a=None) is None
    assert one(spark, html.token_column(F.col("a")), a='<p k="v">')[0]["attributes"] == {"k": "v"}


def test_html_batches_are_bounded(spark) -> None:  # noqa: ANN001
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    page = "<p class='a'>x</p>" * 500
    tracemalloc.start()
    [got] = html.token_arrays(iter([pa.array([page, None] * 640)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [None if x is None else len(x) for x in got[:3].to_pylist()] == [1500, None, 1500]
    assert len(got) == 1280
    assert peak < 100 << 20  # all at once are over 400 MB
    size = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "int")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("<p>xy</p>"), 2000).alias("h"))
    html.token_column(F.col("h"))  # bounds the session's batches
    assert pages.select(size("h").alias("n")).agg(F.max("n")).first()[0] * 18_000 <= 5 << 20


def test_encodings(spark) -> None:  # noqa: ANN001
    for x in (b"", b"a\0\0b", b"\0" * 300, b"\0"):
        assert encode.zero_unescape(encode.zero_escape(x)) == x
    with pytest.raises(ValueError):
        encode.zero_unescape(b"a\0")
    import itertools

    tuples = [list(t) for t in itertools.product([b"", b"\0", b"\0a", b"a", b"a\0b", b"ab"], repeat=2)]
    assert sorted(tuples) == sorted(tuples, key=encode.encode_tuple)
    assert all(encode.decode_tuple(encode.encode_tuple(t)) == t for t in tuples)
    for n in (0, 127, 128, 300, 1 << 40):
        assert encode.get_vint(encode.put_vint(n)) == (n, len(encode.put_vint(n)))
    words = ["", "a", "ab", "b", "\x00", "zz"]
    assert sorted(words) == sorted(words, key=lambda w: encode.base64_text(w.encode()))
    assert one(spark, encode.base64_ordered(F.encode("a", "UTF-8"), encode._STANDARD), a="ate") == "YXRl"
    assert one(spark, encode.base64_ordered(F.encode("a", "UTF-8"), encode._STANDARD), a="a") == "YQ"
    assert "a" < encode.interpolate("a", "c", 0.5) < "c"


def test_hashes(spark) -> None:  # noqa: ANN001
    assert hashing.super_fast_hash(b"") == 0
    assert len({hashing.super_fast_hash(b"abcdefg"[:n]) for n in range(1, 8)}) == 7
    assert hashing.shift_add_text(b"yz", hashing.shift_add_text(b"x")) == hashing.shift_add_text(b"xyz")
    assert one(spark, hashing.adler_column(F.col("a")), a="Wikipedia") == 0x11E60398
    rolled = list(hashing.RollingHash(3).hashes(b"abcxabc"))
    assert rolled[0] == rolled[4]
    assert len(set(rolled)) == 4
    f = hashing.BloomFilter.sized(1000, 0.01)
    f.insert(f"in{i}" for i in range(1000))
    assert f.contains([f"in{i}" for i in range(1000)]).all()
    assert f.contains([f"out{i}" for i in range(5000)]).mean() < 0.03
    g = hashing.BloomFilter.loads(f.dumps())
    assert (g.union(f).data == f.data).all()
    with pytest.raises(ValueError):
        f.union(hashing.BloomFilter(64, 1))
    df = spark.createDataFrame([(f"k{i}",) for i in range(50)], "k string").repartition(3)
    assert hashing.bloom_of(df, "k", 1024, 3).contains([f"k{i}" for i in range(50)]).all()


TIMES = [("2008-11-19 11:05:08.204113 -08:00", 1227121508204113), ("1963-02-03 05:07:59.1 -05:00", -218037120900000), ("@42", 42), ("@-7", -7), ("1970-01-01T00:00:00.0000019Z", 1), ("19700102", 86_400_000_000), ("1970-01-01T01+01", 0)]


def test_times() -> None:
    for given, want in TIMES:
        assert parse_time(given) == want
    assert format_time(-1) == "1969-12-31T23:59:59.999999Z"
    assert format_time(0, "Asia/Kolkata") == "1970-01-01T05:30:00.000000+0530"
    assert show_time(9999) == "@9999"
    assert show_time(-10_000).startswith("1969")
    for us in (0, 1, -1, 1227121508204113, -218037120900000):
        for tz in ("UTC", "Europe/Berlin", "America/Los_Angeles"):
            assert parse_time(format_time(us, tz)) == us
    with pytest.raises(ValueError):
        parse_time("yesterday")
    now = datetime(2020, 5, 17, 12, 30)
    for given, want in [("now", now), ("today", datetime(2020, 5, 17)), ("yesterday 3pm", datetime(2020, 5, 16, 15)), ("3 hours ago", datetime(2020, 5, 17, 9, 30)), ("+2 days", datetime(2020, 5, 19, 12, 30)), ("2019/1/2 04:05", datetime(2019, 1, 2, 4, 5)), ("next week", datetime(2020, 5, 24, 12, 30))]:
        assert phrase_time(given, now) == want
    with pytest.raises(ValueError):
        phrase_time("whenever", now)


def test_hashes_on_the_jvm(spark) -> None:  # noqa: ANN001
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "Ünïcödé", "\x7f\x80ÿ中", "x" * 61, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", hashing.super_fast_column(F.col("t")).alias("f"), hashing.adler_column(F.col("t")).alias("a")).collect()
    for r in got:
        raw = None if r["t"] is None else r["t"].encode()
        assert r["f"] == (None if raw is None else hashing.super_fast_hash(raw)), r["t"]
        assert r["a"] == (None if raw is None else hashing.adler32(raw)), r["t"]
