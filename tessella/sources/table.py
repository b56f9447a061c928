"""Tables by URI: the scheme picks what a table is, and schemes nest with +.

mem:name                    a log in this session
logged:/folder              a log in this session that is replayed from its files when it is opened
local:/folder               a log as Parquet files, each write a batch of its own
hash:/a?/b?/c               rows dealt out to several tables by a hash
mux:fam1=/a&fam2=/b&*=/c    column families dealt out to several tables
meta+mem:name?name=T        tablets of table T, found by the location cells of a table
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashing import super_fast_column, super_fast_hash
from tessella.operators.cells import CELL, LOG, cell_order, cell_size, family, keep_history, resolve
from tessella.operators.durable import materialise
from tessella.operators.ranges import choose_compaction, compact, lookup_ranges, median_row
from tessella.plans.intervals import Interval, IntervalSet
from tessella.plans.predicate import ScanPredicate, parse

Opener = Callable[[SparkSession, str], "Table"]
_SCHEMES: dict[str, Opener] = {}
_MEMORY: dict[str, list[tuple]] = {}


def register(scheme: str, opener: Opener) -> None:
    if scheme in _SCHEMES:
        raise ValueError(f"the scheme {scheme!r} is taken")
    _SCHEMES[scheme] = opener


def open_table(spark: SparkSession, uri: str) -> Table:
    scheme, colon, _ = uri.partition(":")
    first = scheme.split("+", 1)[0]
    if not colon:
        first, uri = "local", f"local:{uri}"
    if first not in _SCHEMES:
        raise ValueError(f"no table scheme {first!r}")
    rest = uri[len(first) + 1 :]
    return _SCHEMES[first](spark, rest)


class Table:
    """set, erase, sync and scan; a log of writes is behind each table, numbered in their order."""

    #: Whether the log is known to have one write for each key and no erasures.
    compacted = False

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.pending: list[tuple] = []

    def log(self) -> DataFrame:
        raise NotImplementedError

    def store(self, rows: DataFrame) -> None:
        raise NotImplementedError

    def next_seq(self) -> int:
        raise NotImplementedError

    def set(self, row: str, column: str, ts: int, value: str) -> None:
        self.pending.append((row, column, ts, value))

    def erase(self, row: str, column: str, ts: int) -> None:
        self.pending.append((row, column, ts, None))

    def insert(self, cell: tuple) -> None:
        self.pending.append(tuple(cell))

    def sync(self) -> None:
        """Writes are visible and durable from here on."""
        if self.pending:
            at = self.next_seq()
            rows, self.pending = [(at + i, *p) for i, p in enumerate(self.pending)], []
            self.store(self.spark.createDataFrame(rows, LOG))

    def load(self, cells: DataFrame) -> None:
        """Append many cells in the order of their rows: of equal keys the last one is the last write, a null value erases."""
        self.sync()
        at = self.next_seq()
        self.store(cells.select((F.monotonically_increasing_id() + at).alias("seq"), "row", "column", "ts", "value"))

    def erase_where(self, predicate: str | ScanPredicate, dry_run: bool = False) -> DataFrame:
        """Erase all cells that a predicate selects; returns their keys."""
        self.sync()
        keys = self.scan(predicate).select("row", "column", "ts")
        if not dry_run:
            keys = materialise(self.spark, keys, "erased")  # what was there before
            self.store(keys.select(F.lit(self.next_seq()).cast("long").alias("seq"), "row", "column", "ts", F.lit(None).cast("string").alias("value")))
        return keys

    def scan(self, predicate: str | ScanPredicate = "", erasures: bool = False) -> DataFrame:
        """Conditions on keys, then the last writes, then history."""
        self.sync()
        p = parse(predicate, self.spark.conf.get("spark.sql.session.timeZone")) if isinstance(predicate, str) else predicate
        if erasures and p.history:
            raise ValueError("history can't count erasures")
        log = self.log().filter(p.key_filter())
        if "family" in log.columns and (names := p.families()) is not None:
            log = log.filter(F.col("family").isin(names) if names else F.lit(False))
        cells = log.select("row", "column", "ts", "value") if self.compacted else resolve(log, erasures)
        return keep_history(cells, p.history)

    def cells(self, predicate: str = "") -> list[tuple]:
        """What a scan gives, in cell order, on the driver."""
        return [tuple(r) for r in self.scan(predicate).select("row", "column", "ts", "value").orderBy(*cell_order()).collect()]

    def scan_intervals(self, parts: int = 8) -> list[Interval]:
        """Row ranges of about equal numbers of rows: (previous, last]."""
        edges = self.scan().select("row").repartitionByRange(parts, "row").groupBy(F.spark_partition_id().alias("p")).agg(F.max("row").alias("last")).orderBy("last").collect()
        ends = [r["last"] for r in edges][:-1]
        return [Interval.of(a, b, low_closed=False, high_closed=True) for a, b in zip([None, *ends], [*ends, None], strict=True)]


class MemoryTable(Table):
    def __init__(self, spark: SparkSession, name: str) -> None:
        super().__init__(spark)
        self.rows = _MEMORY.setdefault(name, []) if name else []

    def log(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, LOG)

    def store(self, rows: DataFrame) -> None:
        self.rows.extend(tuple(r) for r in rows.collect())

    def next_seq(self) -> int:
        return max((r[0] for r in self.rows), default=-1) + 1


class LoggedTable(MemoryTable):
    """A table in memory that appends each sync to a log of files and replays it when it is opened."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, "")
        self.files = LocalTable(spark, path, most=0)
        self.rows = sorted(tuple(r) for r in self.files.log().collect())

    def store(self, rows: DataFrame) -> None:
        held = materialise(self.spark, rows, "logged")
        self.files.store(held)
        super().store(held)


class LocalTable(Table):
    """Each write is a batch, a folder of Parquet files below the table's.

    Batches are named by the numbers at which their first and last writes start; one that spans others stands in
    their place.  When there are over `most` batches, those adjacent ones are merged that gain most for their
    cost (0: none are).
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 16) -> None:
        super().__init__(spark)
        self.path, self.most = path.rstrip("/"), most
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[str]:
        """Names of the batches that count, oldest first."""
        if not self.fs.exists(self.fs_path):
            return []
        done = lambda n: self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self.fs_path))
        names = [n for n in names if n.startswith("b") and done(n)]
        span = lambda n: (int(n[1:21]), int(n[22:42]))
        merged = [n for n in names if n[43:48] == "merge"]
        hidden = lambda n: any(m != n and span(m)[0] <= span(n)[0] and span(n)[1] <= span(m)[1] and (span(m) != span(n) or n not in merged or m > n) for m in merged)
        return [n for n in names if not hidden(n)]

    @property
    def compacted(self) -> bool:
        """One batch that stands for all: its keys are unique, and a scan needs no last writes."""
        names = self._batches()
        return len(names) == 1 and names[0][43:48] == "merge"

    def _read(self, names: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*(f"{self.path}/{n}" for n in names)) if names else self.spark.createDataFrame([], LOG)

    def _bytes(self, name: str) -> int:
        return self.fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")).getLength()

    def log(self) -> DataFrame:
        return self._read(self._batches())

    def store(self, rows: DataFrame) -> None:
        at = self.next_seq()
        rows.write.parquet(f"{self.path}/b{at:020d}-{at:020d}-part-{uuid.uuid4().hex}")
        while self.most and len(names := self._batches()) > self.most:
            self.merge(*(choose_compaction([self._bytes(n) for n in names]) or (0, len(names))))

    def next_seq(self) -> int:
        """Batches are named by where their numbers start; the next one starts behind the last."""
        names = self._batches()
        if not names:
            return 0
        top = self._read(names[-1:]).agg(F.max("seq")).first()[0]
        return max(int(names[-1][22:42]), -1 if top is None else top) + 1

    def merge(self, first: int, end: int) -> None:
        """One batch in place of some adjacent ones, sorted by key; erasures go where nothing older can be below."""
        names = self._batches()[first:end]
        rows = compact(self._read(names), rooted=first == 0).repartitionByRange("row").sortWithinPartitions(*cell_order())
        rows.write.parquet(f"{self.path}/b{names[0][1:21]}-{names[-1][22:42]}-merge-{uuid.uuid4().hex}")

    def compact(self) -> None:
        """One batch in place of all."""
        self.sync()
        if names := self._batches():
            self.merge(0, len(names))

    def clean(self, dry_run: bool = False) -> list[str]:
        """Delete the batches that merged ones stand for; returns their names.  Scans begun before may still read them."""
        live = set(self._batches())
        gone = [s.getPath() for s in self.fs.listStatus(self.fs_path)] if self.fs.exists(self.fs_path) else []
        gone = [p for p in gone if p.getName().startswith("b") and p.getName() not in live]
        if not dry_run:
            for p in gone:
                self.fs.delete(p, True)
        return sorted(p.getName() for p in gone)

    def scan_index(self) -> list[tuple[str, str, int, int]]:
        """(file, last row, bytes, writes) of each block, from the files' footers: no data is read."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        out = []
        for name in self._batches():
            for f in self.fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")):
                if not f.getPath().getName().startswith("part-"):
                    continue
                reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(f.getPath(), conf))
                try:
                    for block in reader.getFooter().getBlocks():
                        column = next(c for c in block.getColumns() if c.getPath().toDotString() == "row")
                        if block.getRowCount():
                            out.append((f"{name}/{f.getPath().getName()}", bytes(column.getStatistics().getMaxBytes()).decode(), int(block.getTotalByteSize()), int(block.getRowCount())))
                finally:
                    reader.close()
        return out

    def scan_intervals(self, parts: int = 8) -> list[Interval]:
        """Row ranges of about equal bytes, cut at the last rows of blocks; as many as there are blocks, at most."""
        self.sync()
        blocks = sorted((last, size) for _, last, size, _ in self.scan_index())
        total, so_far, ends = sum(n for _, n in blocks), 0, []
        for last, size in blocks[:-1]:
            if (so_far + size) * parts // total > so_far * parts // total and (not ends or last > ends[-1]) and last < blocks[-1][0]:
                ends.append(last)
            so_far += size
        return [Interval.of(a, b, low_closed=False, high_closed=True) for a, b in zip([None, *ends], [*ends, None], strict=True)]


class UnionTable(Table):
    """Several tables as one; `route` gives the position of a cell's table, `routed` that of each row of many cells."""

    def __init__(self, spark: SparkSession, tables: list[Table], route: Callable[[str, str], int], routed: Column) -> None:
        super().__init__(spark)
        self.tables, self.route, self.routed = tables, route, routed

    def sync(self) -> None:
        for p in self.pending:
            self.tables[self.route(p[0], p[1])].insert(p)
        self.pending = []
        for t in self.tables:
            t.sync()

    def load(self, cells: DataFrame) -> None:
        """Each table gets its cells, in their order."""
        self.sync()
        order = cells.select("row", "column", "ts", "value", self.routed.alias("to"), F.monotonically_increasing_id().alias("at"))
        held = materialise(self.spark, order, "routed")
        for r in held.select("to").distinct().orderBy("to").collect():
            self.tables[r["to"]].load(held.filter(F.col("to") == r["to"]).orderBy("at").select("row", "column", "ts", "value"))

    def erase_where(self, predicate: str | ScanPredicate, dry_run: bool = False) -> DataFrame:
        self.sync()
        p = parse(predicate, self.spark.conf.get("spark.sql.session.timeZone")) if isinstance(predicate, str) else predicate
        found = [t.erase_where(p, dry_run) for t in self.chosen(p)]
        return reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], CELL).select("row", "column", "ts")

    def chosen(self, p: ScanPredicate) -> list[Table]:
        return self.tables

    def scan(self, predicate: str | ScanPredicate = "", erasures: bool = False) -> DataFrame:
        self.sync()
        p = parse(predicate, self.spark.conf.get("spark.sql.session.timeZone")) if isinstance(predicate, str) else predicate
        found = [t.scan(p, erasures) for t in self.chosen(p)]
        return reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], CELL)


class HashedTable(UnionTable):
    def __init__(self, spark: SparkSession, tables: list[Table]) -> None:
        super().__init__(spark, tables, lambda row, _: super_fast_hash(row.encode()) % len(tables), (super_fast_column(F.col("row")) % len(tables)).cast("int"))


class FamilyTable(UnionTable):
    """Families to tables; * is for all others, which are an error without it."""

    def __init__(self, spark: SparkSession, groups: dict[str, Table]) -> None:
        self.names = list(groups)

        def route(_: str, column: str) -> int:
            name = column.split(":", 1)[0] if ":" in column else ""
            if name not in groups and "*" not in groups:
                raise ValueError(f"no table for the family {name!r}")
            return self.names.index(name if name in groups else "*")

        own, rest = family(F.col("column")), F.raise_error(F.concat(F.lit("no table for the family "), family(F.col("column")))).cast("int")
        routed = F.when(F.lit(False), 0)
        for i, n in enumerate(self.names):
            routed = routed.when(own == n, i) if n != "*" else routed
        routed = routed.otherwise(F.lit(self.names.index("*")) if "*" in groups else rest)
        super().__init__(spark, list(groups.values()), route, routed)

    def chosen(self, p: ScanPredicate) -> list[Table]:
        names = p.families()
        if names is None:
            return self.tables
        wanted = {n if n in self.names else "*" for n in names}
        return [t for n, t in zip(self.names, self.tables, strict=True) if n in wanted]


class MetaTable(Table):
    """Tablets whose URIs are the newest `location` cells of rows (name, last row): each row belongs to the first
    tablet whose last row isn't below it.  An empty last row is without a bound."""

    SEPARATOR = "\x01"
    LAST = "\x02"

    def __init__(self, spark: SparkSession, meta: Table, name: str) -> None:
        super().__init__(spark)
        self.meta, self.name = meta, name

    @classmethod
    def key(cls, name: str, last: str | None) -> str:
        """Tablets of a table sort by their last rows, the one without a bound behind them."""
        return f"{name}\0{cls.LAST}" if last is None else f"{name}\0{cls.SEPARATOR}{last}"

    def tablets(self) -> list[tuple[Interval, Table]]:
        low, out = None, []
        rows = self.meta.cells(f'row ~= "{self.name}\\x00" and column = "location" and history = 1')
        for row, _, _, uri in rows:
            mark = row[len(self.name) + 1 :]
            last = None if mark.startswith(self.LAST) else mark[1:]
            out.append((Interval.of(low, last, low_closed=low is None, high_closed=True), open_table(self.spark, uri)))
            low = last
        return out

    def sync(self) -> None:
        if self.pending:
            tablets = self.tablets()
            for p in self.pending:
                owner = next((t for span, t in tablets if span.contains(p[0])), None)
                if owner is None:
                    raise ValueError(f"no tablet for the row {p[0]!r}")
                owner.insert(p)
            self.pending = []
            for _, t in tablets:
                t.sync()

    def load(self, cells: DataFrame) -> None:
        """Each tablet gets its cells, in their order; a row without a tablet is an error, before anything is written."""
        self.sync()
        tablets = self.tablets()
        spans = self.spark.createDataFrame([(i, span.high[0] if span.high else None) for i, (span, _) in enumerate(tablets)], "to int, upper string")
        order = lookup_ranges(cells.select("row", "column", "ts", "value").withColumn("at", F.monotonically_increasing_id()), "row", spans, name="to")
        held = materialise(self.spark, order.withColumn("to", F.coalesce("to", F.raise_error(F.concat(F.lit("no tablet for the row "), "row")).cast("int"))), "routed")
        for r in held.select("to").distinct().orderBy("to").collect():
            tablets[r["to"]][1].load(held.filter(F.col("to") == r["to"]).orderBy("at").select("row", "column", "ts", "value"))

    def erase_where(self, predicate: str | ScanPredicate, dry_run: bool = False) -> DataFrame:
        self.sync()
        p = parse(predicate, self.spark.conf.get("spark.sql.session.timeZone")) if isinstance(predicate, str) else predicate
        whole = p.row or IntervalSet([Interval()])
        found = [t.erase_where(p.clip_rows(span), dry_run) for span, t in self.tablets() if not whole.clip(span).empty]
        return reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], CELL).select("row", "column", "ts")

    def split_heavy(self, most: int = 400 << 20) -> list[str]:
        """Split tablets of more bytes at the row that halves them; returns these rows.

        Both sides stay in the tablet's table, of which each reads its own rows; a side without rows is no split.
        """
        self.sync()
        out = []
        for span, t in self.tablets():
            clip = ScanPredicate(row=IntervalSet([span]))
            sizes = t.scan(clip).groupBy("row").agg(F.sum(cell_size()).alias("bytes"))
            total = sizes.agg(F.sum("bytes"), F.max("row")).first()
            if (total[0] or 0) <= most:
                continue
            at = median_row(sizes).first()["split_row"]
            if at == total[1]:
                continue
            key = self.key(self.name, span.high[0] if span.high else None)
            uri = self.meta.cells(f'row = "{key.replace(chr(0), chr(92) + "x00").replace(chr(1), chr(92) + "x01").replace(chr(2), chr(92) + "x02")}" and column = "location" and history = 1')[0][3]
            self.meta.set(self.key(self.name, at), "location", 0, uri)
            out.append(at)
        self.meta.sync()
        return out

    def scan(self, predicate: str | ScanPredicate = "", erasures: bool = False) -> DataFrame:
        """Tablets that the row predicate doesn't touch aren't opened."""
        self.sync()
        p = parse(predicate, self.spark.conf.get("spark.sql.session.timeZone")) if isinstance(predicate, str) else predicate
        found = []
        for span, t in self.tablets():
            rows = (p.row or IntervalSet([Interval()])).clip(span)
            if not rows.empty:
                found.append(t.scan(p.clip_rows(span), erasures))
        return reduce(DataFrame.union, found) if found else self.spark.createDataFrame([], CELL)


def _query(rest: str) -> tuple[str, dict[str, str]]:
    base, _, query = rest.partition("?")
    return base, dict(p.split("=", 1) for p in query.split("&") if "=" in p)


def _open_meta(spark: SparkSession, rest: str) -> Table:
    base, options = _query(rest)
    return MetaTable(spark, open_table(spark, base), options["name"])


def _open_mux(spark: SparkSession, rest: str) -> Table:
    return FamilyTable(spark, {n: open_table(spark, uri) for n, _, uri in (p.partition("=") for p in rest.split("&"))})


register("mem", MemoryTable)
register("local", LocalTable)
register("logged", LoggedTable)
register("hash", lambda spark, rest: HashedTable(spark, [open_table(spark, u) for u in rest.split("?")]))
register("mux", _open_mux)
register("meta", _open_meta)


def create_table(meta: Table, name: str, server: str, force: bool = False) -> None:
    """The row of a table's one tablet without a bound; an error if it is there, unless forced."""
    row = MetaTable.key(name, None)
    if not force and meta.scan(f'row ~= "{name}\\x00"').take(1):
        raise ValueError(f"the table {name!r} exists")
    meta.set(row, "config", 0, f"server = {server}")
    meta.sync()


def meta_rows(name: str, splits: Iterable[str], servers: list[str]) -> list[tuple[str, str, int, str]]:
    """Config cells of tablets that end at the splits and one without a bound, dealt out to the servers in turn."""
    ends = [*splits, None]
    return [(MetaTable.key(name, e), "config", 0, f"server = {servers[i % len(servers)]}") for i, e in enumerate(ends)]


def with_family(cells: DataFrame) -> DataFrame:
    return cells.withColumn("family", family(F.col("column")))
