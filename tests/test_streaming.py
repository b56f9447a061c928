from __future__ import annotations

from tessella.operators.cells import resolve
from tessella.streaming.ingest import ingest, latest_versions

WRITES = "n long, row string, column string, ts long, value string"


def test_ingest_equals_batch(spark, tmp_path) -> None:  # noqa: ANN001
    rows = [(i, f"r{i % 5}", "c", i % 3, None if i % 7 == 0 else f"v{i}") for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], WRITES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(WRITES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "log"), str(tmp_path / "ck"), "n").awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 40
    want = resolve(spark.createDataFrame(rows, WRITES).withColumnRenamed("n", "seq"))
    assert resolve(log).select("row", "column").distinct().count() == want.select("row", "column").distinct().count()


def test_latest_versions(spark, tmp_path) -> None:  # noqa: ANN001
    rows = [(0, "r", "c", t, f"v{t}") for t in (3, 1, 4, 1, 5)]
    spark.createDataFrame(rows, WRITES).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(WRITES).parquet(str(tmp_path / "in"))
    q = latest_versions(stream, 2).writeStream.format("memory").queryName("newest").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.sql("select ts, value from newest").collect()) == [(4, "v4"), (5, "v5")]
