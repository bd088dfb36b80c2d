"""Streams that run until they have caught up, and again."""

from tallyforge.streaming.ingest import arrivals_by_suffix, arriving_files, first_by_digest, ingest


def test_ingest_takes_each_file_once(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "1.dxf").write_text("one")
    (tmp_path / "in" / "2.DXF").write_text("two")
    ingest(arriving_files(spark, folder), table, state).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    (tmp_path / "in" / "3.txt").write_text("three")
    ingest(arriving_files(spark, folder), table, state).awaitTermination()
    out = spark.read.parquet(table).collect()
    assert sorted((r["suffix"], r["bytes"]) for r in out) == [(".dxf", 3), (".dxf", 3), (".txt", 5)]
    assert len({r["sha256"] for r in out}) == 3


def test_copies_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.dxf").write_text("same")
    files = arriving_files(spark, str(tmp_path / "in"))
    ingest(first_by_digest(files), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    query = arrivals_by_suffix(files).writeStream.format("memory").queryName("arrivals").outputMode("complete").option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["suffix"], r["files"], r["bytes"]) for r in spark.table("arrivals").collect()] == [(".dxf", 3, 12)]
