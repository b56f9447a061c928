"""Cell formats: tuple text, cell and document XML in; tuples, XML and Parquet out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import unescape, xml_escape
from tessella.operators.cells import CELL, cell_order
from tessella.plans.times import match_time

#: The elements of a <cell>.
CELL_XML = "r string, c string, t string, v string"
_STRING = r"\s*(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')\s*"


def parse_tuples(text: str, tz: str = "UTC") -> Iterator[tuple[str, str, int, str]]:
    """("row", "column", time, "value") with free white space; anything else is a ValueError."""
    at, string = 0, re.compile(_STRING, re.S)

    def take(what: str) -> None:
        nonlocal at
        m = re.compile(r"\s*" + re.escape(what)).match(text, at)
        if not m:
            raise ValueError(f"{what} expected at {text[at : at + 30]!r}")
        at = m.end()

    def text_of() -> str:
        nonlocal at
        m = string.match(text, at)
        if not m:
            raise ValueError(f"a string expected at {text[at : at + 30]!r}")
        at = m.end()
        return unescape(m[1][1:-1])

    while text[at:].strip():
        take("(")
        row = text_of()
        take(",")
        column = text_of()
        take(",")
        at += len(text[at:]) - len(text[at:].lstrip())
        ts, at = match_time(text, at, tz)
        take(",")
        value = text_of()
        take(")")
        yield row, column, ts, value


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    """Files of tuples; a file may hold one across lines, so each is parsed as a whole."""
    tz = spark.conf.get("spark.sql.session.timeZone")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                rows = list(parse_tuples(text, tz))
                yield pd.DataFrame(rows, columns=["row", "column", "ts", "value"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, CELL)


def read_tuple_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files with one tuple in each line and times as @n: split and parsed in parallel, on the JVM but for escapes."""
    form = r'^\s*\(\s*"((?:[^"\\]|\\.)*)"\s*,\s*"((?:[^"\\]|\\.)*)"\s*,\s*@(-?\d+)\s*,\s*"((?:[^"\\]|\\.)*)"\s*\)\s*$'
    lines = spark.read.text(path).filter(F.trim("value") != "")
    bad = F.raise_error(F.concat(F.lit("not a cell: "), F.col("value")))
    part = lambda i: F.when(F.col("value").rlike(form), F.regexp_extract("value", form, i)).otherwise(bad)
    plain = F.pandas_udf(lambda s: s.map(unescape), "string")
    text = lambda i: plain(part(i))
    return lines.select(text(1).alias("row"), text(2).alias("column"), part(3).cast("long").alias("ts"), text(4).alias("value"))


def parse_time_column(c: Column) -> Column:
    """@n, a number, or an ISO time, as microseconds."""
    number = F.regexp_replace(c, "^@", "")
    return F.when(number.rlike("^-?[0-9]+$"), number.try_cast("long")).otherwise(F.unix_micros(c.try_cast("timestamp")))


def read_cell_xml(spark: SparkSession, path: str) -> DataFrame:
    """<cell><r/><c/><t/><v/></cell>; cells without a row, a column or a time are left out."""
    return _xml_cells(spark.read.schema(CELL_XML).xml(path, rowTag="cell"))


def read_cell_xml_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files with one <cell> in each line and no root, as they are written here: split, and parsed in parallel."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return _xml_cells(lines.select(F.from_xml("value", CELL_XML).alias("x")).select("x.*"))


def _xml_cells(cells: DataFrame) -> DataFrame:
    good = cells.filter("r <> '' and c <> ''").withColumn("ts", parse_time_column(F.col("t"))).filter("ts is not null")
    return good.select(F.col("r").alias("row"), F.col("c").alias("column"), "ts", F.coalesce("v", F.lit("")).alias("value"))


def read_document_xml(spark: SparkSession, path: str, family: str = "doc", key: str = "sbid") -> DataFrame:
    """<document><element name="..."><value>...</value></element></document>: the row is one element, the others are columns."""
    schema = "element array<struct<_name string, value string>>"
    docs = spark.read.schema(schema).xml(path, rowTag="document")
    row = F.try_element_at(F.filter("element", lambda e: e["_name"] == key), F.lit(1))["value"]
    each = docs.withColumn("row", row).filter("row <> ''").select("row", F.explode("element").alias("e"))
    named = each.filter(F.col("e._name") != key)
    return named.select("row", F.concat(F.lit(f"{family}:"), "e._name").alias("column"), F.lit(0).cast("long").alias("ts"), F.coalesce("e.value", F.lit("")).alias("value"))


def _escaped(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for a, b in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def time_text(ts: Column, numeric: bool = False) -> Column:
    """@n near to zero, or always if asked for; ISO in the session's zone otherwise."""
    at = F.concat(F.lit("@"), ts.cast("string"))
    if numeric:
        return at
    iso = F.regexp_replace(F.date_format(F.timestamp_micros(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), r"([+-]\d\d):?00$", "$1")
    return F.when(F.abs(ts) < 10_000, at).otherwise(iso)


def as_tuples(cells: DataFrame, numeric: bool = True) -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), _escaped(F.col(c)), F.lit('"'))
    value = F.when(F.col("value").isNull(), "ERASED").otherwise(q("value"))
    return cells.select(F.concat(F.lit("("), q("row"), F.lit(","), q("column"), F.lit(","), time_text(F.col("ts"), numeric), F.lit(","), value, F.lit(")")).alias("value"))


def as_xml(cells: DataFrame) -> DataFrame:
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    return cells.select(F.concat(F.lit("<cell>"), tag("r", xml_escape(F.col("row"))), tag("c", xml_escape(F.col("column"))), tag("t", time_text(F.col("ts"))), tag("v", xml_escape(F.coalesce("value", F.lit("")))), F.lit("</cell>")).alias("value"))


def write_sorted(cells: DataFrame, path: str, by_family: bool = False, mode: str = "error") -> None:
    """Cells as Parquet in cell order, range-partitioned by row, so that row groups can be skipped by row and time."""
    out = cells.repartitionByRange("row").sortWithinPartitions(*cell_order())
    w = out.write.mode(mode)
    if by_family:
        from tessella.operators.cells import family

        out = cells.withColumn("family", family(F.col("column"))).repartitionByRange("family", "row").sortWithinPartitions("family", *cell_order())
        w = out.write.mode(mode).partitionBy("family")
    w.parquet(path)


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Rows as they are; one that breaks the condition fails the job.  (Typed record streams are checked so.)"""
    ok = F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)))
    return df.filter(ok)


def split_by(df: DataFrame, part: Column, path: str, rows: int = 0) -> None:
    """Rows to one folder for each value of `part`, files of so many rows at most (0: any)."""
    df.withColumn("part", part).write.option("maxRecordsPerFile", rows).partitionBy("part").parquet(path)


def read_records(spark: SparkSession, path: str, fields: list[tuple[str, str]]) -> DataFrame:
    """Files of fixed-size records with little-endian numbers: (name, numpy type) of each field."""
    import numpy as np

    kind = np.dtype([(n, f"<{t}") for n, t in fields])
    names = {"i4": "int", "i8": "long", "f4": "float", "f8": "double"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                if len(raw) % kind.itemsize:
                    raise ValueError("a record is cut off")
                yield pd.DataFrame({n: np.frombuffer(raw, kind)[n].copy() for n, _ in fields})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"{n} {names[t]}" for n, t in fields))
