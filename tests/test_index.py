"""The index of sources: rows replaced by source, versions whole."""

import pytest
from pyspark.errors import AnalysisException

from tallyforge.sources.sinks import SourceIndex

DDL = "source_file_id long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sources_in_one_file_are_replaced_apart(spark, tmp_path):
    index = SourceIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError):
        index.read()
    first = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")]
    assert index.upsert(spark.createDataFrame(first, DDL).coalesce(1)) == 1 and rows(index.read()) == sorted(first, key=str)
    index.upsert(spark.createDataFrame([(1, "new")], DDL))
    assert rows(index.read()) == sorted([(1, "new"), (2, "c"), (None, "d"), (3, "e")], key=str)
    index.upsert(spark.createDataFrame([(None, "null")], DDL), removed=spark.createDataFrame([(3, "")], DDL))
    assert rows(index.read()) == sorted([(1, "new"), (2, "c"), (None, "null")], key=str)
    assert rows(index.read(1)) == sorted(first, key=str) and rows(index.read(2)) == sorted([(1, "new"), (2, "c"), (None, "d"), (3, "e")], key=str)
    assert index.stale_files().count() == 0  # the first file still holds source 2
    index.upsert(spark.createDataFrame([(2, "z")], DDL))
    assert index.stale_files().count() == 1


def test_a_failed_run_leaves_the_version_before(spark, tmp_path, monkeypatch):
    index = SourceIndex(spark, str(tmp_path / "index"))
    index.upsert(spark.createDataFrame([(1, "a"), (2, "b")], DDL))
    monkeypatch.setattr(SourceIndex, "_manifest", lambda self, version: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.upsert(spark.createDataFrame([(1, "lost")], DDL))
    monkeypatch.undo()
    assert rows(index.read()) == [(1, "a"), (2, "b")]
    assert index.upsert(spark.createDataFrame([(1, "second")], DDL)) == 2
    assert rows(index.read()) == [(1, "second"), (2, "b")]


def test_two_runs_from_one_version_publish_once(spark, tmp_path, monkeypatch):
    index = SourceIndex(spark, str(tmp_path / "index"))
    index.upsert(spark.createDataFrame([(1, "a")], DDL))
    monkeypatch.setattr(SourceIndex, "version", lambda self: 0)  # what a run saw that began before
    with pytest.raises(AnalysisException):
        index.upsert(spark.createDataFrame([(2, "b")], DDL))
    monkeypatch.undo()
    assert rows(index.read()) == [(1, "a")]


def test_an_empty_run_changes_nothing(spark, tmp_path):
    index = SourceIndex(spark, str(tmp_path / "index"))
    index.upsert(spark.createDataFrame([(1, "a")], DDL))
    index.upsert(spark.createDataFrame([], DDL))
    assert rows(index.read()) == [(1, "a")]
