from __future__ import annotations

import io
import uuid

import pytest

from tessella import cli
from tessella.operators.cells import LOG, latest_values, resolve, row_buffers
from tessella.sources.table import MetaTable, create_table, meta_rows, open_table, register

#: The conformance script of the reference's table interface and what scans give after it: fixed values.
SETS_1 = "r2 c1 2 v212,r3 c2 1 v321,r3 c0 1 v301,r1 c3 3 v133,r1 c4 1 v141,r0 c0 2 v002,r4 c4 1 v441,r3 c0 4 v304,r3 c1 1 v311,r1 c3 4 v134,r4 c2 2 v422,r0 c2 0 v020,r3 c2 3 v323,r0 c1 0 v010,r3 c0 1 v301"
ERASES = "r3 c0 3,r1 c3 3,r3 c0 0,r4 c2 4,r0 c4 3,r3 c0 4,r3 c2 0,r4 c1 4,r1 c3 3,r1 c4 4,r3 c2 2,r1 c0 1,r3 c0 4,r4 c0 0,r1 c1 4,r1 c3 3,r1 c4 1,r0 c0 2,r4 c4 1"
SETS_2 = "r0 c1 0 v010-2,r3 c0 1 v301-2,r3 c2 1 v321-2,r4 c2 4 v424-2,r1 c3 3 v133-2,r0 c4 3 v043-2,r0 c3 2 v032-2"
AFTER_1 = "(r0,c0,2,v002)(r0,c1,0,v010)(r0,c2,0,v020)(r1,c3,4,v134)(r1,c3,3,v133)(r1,c4,1,v141)(r2,c1,2,v212)(r3,c0,4,v304)(r3,c0,1,v301)(r3,c1,1,v311)(r3,c2,3,v323)(r3,c2,1,v321)(r4,c2,2,v422)(r4,c4,1,v441)"
AFTER_2 = "(r0,c1,0,v010)(r0,c2,0,v020)(r1,c3,4,v134)(r2,c1,2,v212)(r3,c0,1,v301)(r3,c1,1,v311)(r3,c2,3,v323)(r3,c2,1,v321)(r4,c2,2,v422)"
SCANS = {
    "": "(r0,c1,0,v010-2)(r0,c2,0,v020)(r0,c3,2,v032-2)(r0,c4,3,v043-2)(r1,c3,4,v134)(r1,c3,3,v133-2)(r2,c1,2,v212)(r3,c0,1,v301-2)(r3,c1,1,v311)(r3,c2,3,v323)(r3,c2,1,v321-2)(r4,c2,4,v424-2)(r4,c2,2,v422)",
    "history=1": "(r0,c1,0,v010-2)(r0,c2,0,v020)(r0,c3,2,v032-2)(r0,c4,3,v043-2)(r1,c3,4,v134)(r2,c1,2,v212)(r3,c0,1,v301-2)(r3,c1,1,v311)(r3,c2,3,v323)(r4,c2,4,v424-2)",
    "history=-1": "(r1,c3,3,v133-2)(r3,c2,1,v321-2)(r4,c2,2,v422)",
    "row='r1'": "(r1,c3,4,v134)(r1,c3,3,v133-2)",
    "'c1' <= column <= 'c2' and history = 1": "(r0,c1,0,v010-2)(r0,c2,0,v020)(r2,c1,2,v212)(r3,c1,1,v311)(r3,c2,3,v323)(r4,c2,4,v424-2)",
    "time < @3": "(r0,c1,0,v010-2)(r0,c2,0,v020)(r0,c3,2,v032-2)(r2,c1,2,v212)(r3,c0,1,v301-2)(r3,c1,1,v311)(r3,c2,1,v321-2)(r4,c2,2,v422)",
}


def shown(table, predicate: str = "") -> str:  # noqa: ANN001
    return "".join(f"({r},{c},{t},{v})" for r, c, t, v in table.cells(predicate))


def uri_of(kind: str, spark, tmp_path) -> str:  # noqa: ANN001
    n = uuid.uuid4().hex
    if kind == "meta":
        meta = open_table(spark, f"mem:{n}-meta")
        for i, end in enumerate(["r0", "r2", None]):
            meta.set(MetaTable.key("T", end), "location", 0, f"mem:{n}-{i}")
        meta.sync()
        return f"meta+mem:{n}-meta?name=T"
    return {"mem": f"mem:{n}", "local": f"local:{tmp_path}/{n}", "hash": f"hash:mem:{n}a?mem:{n}b?mem:{n}c", "mux": f"mux:x=mem:{n}a&*=mem:{n}b"}[kind]


@pytest.mark.parametrize("kind", ["mem", "local", "hash", "mux", "meta"])
def test_conformance(spark, tmp_path, kind: str) -> None:  # noqa: ANN001
    uri = uri_of(kind, spark, tmp_path)
    t = open_table(spark, uri)
    assert t.cells() == []
    for x in SETS_1.split(","):
        r, c, n, v = x.split()
        t.set(r, c, int(n), v)
    t.sync()
    assert shown(t) == AFTER_1
    for x in ERASES.split(","):
        r, c, n = x.split()
        t.erase(r, c, int(n))
    t.sync()
    assert shown(t) == AFTER_2
    for x in SETS_2.split(","):
        r, c, n, v = x.split()
        t.set(r, c, int(n), v)
    t.sync()
    for predicate, want in SCANS.items():
        assert shown(t, predicate) == want
    if kind == "local":
        t.compact()
        again = open_table(spark, uri)
        assert shown(again) == SCANS[""]
        again.erase("r1", "c3", 4)
        assert shown(again, "row = 'r1'") == "(r1,c3,3,v133-2)"


def test_erasures_and_history(spark) -> None:  # noqa: ANN001
    t = open_table(spark, f"mem:{uuid.uuid4().hex}")
    t.set("a", "b:c", 42, "d")
    t.set("a", "b:c", 45, "e")
    t.erase("b", "b:c", 45)
    t.erase("a", "b:c", 42)
    got = sorted(tuple(r) for r in t.scan(erasures=True).collect())
    assert [(r, n, v) for r, _, n, v in got] == [("a", 42, None), ("a", 45, "e"), ("b", 45, None)]
    with pytest.raises(ValueError):
        t.scan("history=1", erasures=True)


def test_empty_and_nulls(spark) -> None:  # noqa: ANN001
    none = spark.createDataFrame([], LOG)
    assert resolve(none).count() == 0
    log = spark.createDataFrame([(1, "r", "c", 1, ""), (2, "r", "c", 2, "x"), (3, "r", "c", 2, None)], LOG)
    assert [tuple(r) for r in resolve(log).collect()] == [("r", "c", 1, "")]
    assert row_buffers(resolve(log)).first()["cells"][0]["value"] == ""
    assert latest_values(resolve(log)).first()["values"] == {"c": ""}


def test_registry(spark) -> None:  # noqa: ANN001
    with pytest.raises(ValueError):
        register("mem", open_table)
    with pytest.raises(ValueError):
        open_table(spark, "nothing:x")
    t = open_table(spark, f"mux:a=mem:{uuid.uuid4().hex}")
    t.set("r", "b:c", 0, "x")
    with pytest.raises(ValueError):
        t.sync()


def test_meta(spark) -> None:  # noqa: ANN001
    meta = open_table(spark, f"mem:{uuid.uuid4().hex}")
    create_table(meta, "T", "host1")
    with pytest.raises(ValueError):
        create_table(meta, "T", "host2")
    create_table(meta, "T", "host2", force=True)
    assert [v for *_, v in meta.cells()] == ["server = host2"]
    rows = meta_rows("T", ["g", "p"], ["a", "b"])
    assert [v for *_, v in rows] == ["server = a", "server = b", "server = a"]
    assert sorted(r for r, *_ in rows) == [r for r, *_ in rows]


def test_erase_intervals_cli(spark, tmp_path) -> None:  # noqa: ANN001
    path = tmp_path / "cells.txt"
    path.write_text('("r1","f:a",@1,"x")\n ( "r2" , "f:b" , @2 ,\n"y\\n\\x41")("r3","g:c",1970-01-01T00:00:00.000003Z,"z")')
    uri = f"local:{tmp_path}/t"
    out = io.StringIO()
    cli.main(["load", "-t", uri, str(path)], spark, out)
    cli.main(["scan", "-n", uri], spark, out)
    assert out.getvalue().splitlines() == ['("r1","f:a",@1,"x")', '("r2","f:b",@2,"y\\nA")', '("r3","g:c",@3,"z")']
    cli.main(["erase", "-p", "column ~= 'f:'", uri], spark, io.StringIO())
    out = io.StringIO()
    cli.main(["scan", "-c", uri], spark, out)
    cli.main(["scan", "-x", uri], spark, out)
    assert out.getvalue().splitlines() == ["1", "<cell><r>r3</r><c>g:c</c><t>@3</t><v>z</v></cell>"]
    cli.main(["intervals", "-p", "2", uri], spark, out)
    cli.main(["sample", uri], spark, out)


def test_xml(spark, tmp_path) -> None:  # noqa: ANN001
    from tessella.sources.formats import as_xml, read_cell_xml, read_document_xml

    cells = spark.createDataFrame([("r<1", "c&", 5, "v>"), ("r2", "c", 1_000_000_000_000, "")], "row string, column string, ts long, value string")
    body = "".join(r["value"] for r in as_xml(cells).collect())
    (tmp_path / "x.xml").write_text(f"<cells>{body}<cell><r></r><c>c</c><t>1</t><v>x</v></cell><cell><r>r</r><c>c</c><t>soon</t><v>x</v></cell></cells>")
    assert sorted(map(tuple, read_cell_xml(spark, str(tmp_path / "x.xml")).collect())) == sorted(map(tuple, cells.collect()))
    (tmp_path / "d.xml").write_text('<docs><document><element name="sbid"><value>k</value></element><element name="title"><value>T</value></element></document></docs>')
    assert [tuple(r) for r in read_document_xml(spark, str(tmp_path / "d.xml"), "aol").collect()] == [("k", "aol:title", 0, "T")]
