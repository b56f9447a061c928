"""scan, erase, load, intervals, sample and gc from a shell: python -m tessella.cli <tool> ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.operators import ranges, stats
from tessella.operators.cells import cell_order
from tessella.operators.workloads import chance
from tessella.plans.intervals import Interval
from tessella.plans.predicate import row_predicate
from tessella.sources import formats
from tessella.sources.table import open_table


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:  # noqa: ANN001
    p = argparse.ArgumentParser(prog="tessella")
    tools = p.add_subparsers(dest="tool", required=True)
    scan = tools.add_parser("scan")
    form = scan.add_mutually_exclusive_group()
    form.add_argument("-x", "--xml", action="store_true")
    form.add_argument("-c", "--count", action="store_true")
    form.add_argument("-n", "--numeric", action="store_true")
    scan.add_argument("-p", "--predicate", default="")
    scan.add_argument("-v", "--verbose", action="store_true")
    erase = tools.add_parser("erase")
    erase.add_argument("-p", "--predicate", default="")
    erase.add_argument("-n", "--dryrun", action="store_true")
    erase.add_argument("-v", "--verbose", action="store_true", help="say how many cells of each table go")
    load = tools.add_parser("load")
    load.add_argument("-t", "--table", required=True)
    load.add_argument("-v", "--verbose", action="store_true", help="say how many cells come from each file")
    kind = load.add_mutually_exclusive_group()
    kind.add_argument("--tuple", action="store_true")
    kind.add_argument("-x", "--xml", action="store_true")
    kind.add_argument("--documents", action="store_true")
    cut = tools.add_parser("intervals")
    cut.add_argument("-p", "--parts", type=int, default=8)
    cut.add_argument("-t", "--truncate", type=int, help="cut the ends to so many characters")
    cut.add_argument("-d", "--delimiter", help="cut the ends to their first fields between these")
    cut.add_argument("-c", "--columns", type=int, default=1, help="how many fields to keep")
    cut.add_argument("-v", "--verbose", action="store_true", help="say how many there are, too")
    sample = tools.add_parser("sample")
    sample.add_argument("-f", "--fraction", type=float, help="read such a part of the rows and extrapolate")
    gc = tools.add_parser("gc")
    gc.add_argument("-b", "--before", required=True, help="a time; files that were changed since stay")
    gc.add_argument("-d", "--data", required=True)
    gc.add_argument("-m", "--meta", required=True, help="a Parquet list with the column path")
    gc.add_argument("-n", "--dryrun", action="store_true", help="name the files, and delete none")
    gc.add_argument("-v", "--verbose", action="store_true", help="name the files that are deleted")
    for t in (scan, erase, load, cut, sample):
        t.add_argument("names", nargs="+")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("tessella").getOrCreate()
    say = lambda *x: print(*x, file=out)
    if a.tool == "scan":
        total = 0
        for name in a.names:
            cells = open_table(spark, name).scan(a.predicate)
            if a.count:
                total += cells.count()
            elif a.verbose:
                say(name, *stats.cell_stats(cells).first())
            else:
                shown = cells.orderBy(*cell_order())
                for r in (formats.as_xml(shown) if a.xml else formats.as_tuples(shown, a.numeric)).toLocalIterator():
                    say(r["value"])
        if a.count:
            say(total)
    elif a.tool == "erase":
        for name in a.names:
            keys = open_table(spark, name).erase_where(a.predicate, a.dryrun)
            if a.dryrun:
                for r in keys.toLocalIterator():
                    say(tuple(r))
            if a.verbose:
                say(name, keys.count())
    elif a.tool == "load":
        read = formats.read_cell_xml if a.xml else formats.read_document_xml if a.documents else formats.read_tuples
        table = open_table(spark, a.table)
        for name in a.names:
            cells = read(spark, name)
            table.load(cells)
            if a.verbose:
                say(name, cells.count())
    elif a.tool == "intervals":
        for name in a.names:
            spans = open_table(spark, name).scan_intervals(a.parts)
            if a.truncate or a.delimiter:
                ends = [(x.low and x.low[0], x.high and x.high[0]) for x in spans]
                short = ranges.truncate_intervals(spark.createDataFrame(ends, "lower string, upper string"), a.truncate, a.delimiter, a.columns)
                spans = [Interval.of(r["lower"], r["upper"]) for r in short.orderBy(F.col("lower").asc_nulls_first()).collect()]
            for x in spans:
                say(row_predicate(x))
            if a.verbose:
                say(name, len(spans))
    elif a.tool == "sample":
        for name in a.names:
            cells, rate = open_table(spark, name).scan(), a.fraction or 1.0
            cells = cells.filter(chance("sample", "row") < rate) if a.fraction else cells
            say(name, *stats.profile(cells).first())
            for r in stats.family_stats(cells).orderBy("family").collect():
                say(name, f"{r['family']}:", round(r["cells"] / rate), round(r["bytes"] / rate))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.data).select("path", F.col("modificationTime").alias("modified"))
        for r in ranges.garbage(files, spark.read.parquet(a.meta), F.lit(a.before).cast("timestamp")).toLocalIterator():
            if a.dryrun or a.verbose:
                say(r["path"])
            if not a.dryrun:
                path = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
