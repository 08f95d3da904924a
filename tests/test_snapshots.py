"""Commits of days that appear whole or not at all."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navscore.sources import snapshots as S

A, B, C = (date(2021, 3, d) for d in (18, 19, 20))
SCHEMA = T.StructType(
    [T.StructField("fund", T.StringType()), T.StructField("day", T.DateType()), T.StructField("x", T.IntegerType())]
)


def rows_of(frame):
    return sorted((r.fund, r.day, r.x) for r in frame.collect())


@pytest.fixture
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def test_days_are_replaced_in_one_step(spark, make, tmp_path):
    path = str(tmp_path / "table")
    assert rows_of(S.read(spark, path, SCHEMA)) == []
    assert S.commit(make(("a", A, 1), ("b", A, 2), ("a", B, 3)), path) == 1
    assert S.commit(make(("a", B, 30), ("a", C, 4)), path) == 2
    assert rows_of(S.read(spark, path, SCHEMA)) == [("a", A, 1), ("a", B, 30), ("a", C, 4), ("b", A, 2)]
    assert rows_of(S.read(spark, path, SCHEMA, version=1)) == [("a", A, 1), ("a", B, 3), ("b", A, 2)]
    assert rows_of(S.read(spark, path, SCHEMA, (B, C))) == [("a", B, 30), ("a", C, 4)]
    assert rows_of(S.read(spark, path, SCHEMA, [A, date(2020, 1, 1)])) == [("a", A, 1), ("b", A, 2)]
    # a covered day without rows is gone, days outside stay
    S.commit(make(("c", B, 5)), path, (B, C))
    assert rows_of(S.read(spark, path, SCHEMA)) == [("a", A, 1), ("b", A, 2), ("c", B, 5)]
    S.commit(make(), path, A)
    assert rows_of(S.read(spark, path, SCHEMA)) == [("c", B, 5)]


def test_a_run_that_fails_in_the_middle_changes_nothing(spark, make, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    S.commit(make(("a", A, 1), ("a", B, 2)), path)
    broken = make(("a", A, 10), ("a", B, 20)).withColumn(
        "x", F.when(F.col("day") == F.lit(B), F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("x"))
    )
    with pytest.raises(Exception, match="lost"):
        S.commit(broken, path)
    assert rows_of(S.read(spark, path, SCHEMA)) == [("a", A, 1), ("a", B, 2)]

    def stopped(*args):
        raise RuntimeError("stopped before the manifest")

    with monkeypatch.context() as m:
        m.setattr(S, "_publish", stopped)
        with pytest.raises(RuntimeError):
            S.commit(make(("a", A, 11)), path)
    assert rows_of(S.read(spark, path, SCHEMA)) == [("a", A, 1), ("a", B, 2)]
    assert S.versions(spark, path) == [1]
    assert len(S.vacuum(spark, path)) == 1  # a job that fails clears up after itself
    assert rows_of(S.read(spark, path, SCHEMA)) == [("a", A, 1), ("a", B, 2)]


def test_of_two_commits_at_a_time_one_fails(spark, make, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    S.commit(make(("a", A, 1)), path)
    publish = S._publish

    def late(*args):
        monkeypatch.setattr(S, "_publish", publish)
        S.commit(make(("b", B, 2)), path)  # another run is faster
        publish(*args)

    monkeypatch.setattr(S, "_publish", late)
    with pytest.raises(S.Conflict):
        S.commit(make(("c", C, 3)), path)
    assert rows_of(S.read(spark, path, SCHEMA)) == [("a", A, 1), ("b", B, 2)]


def test_vacuum_keeps_what_is_named(spark, make, tmp_path):
    path = str(tmp_path / "table")
    for x in range(4):
        S.commit(make(("a", A, x), ("a", B, x)) if x == 0 else make(("a", A, x)), path)
    assert len(S.vacuum(spark, path, keep=2)) == 1  # the second commit; the first holds B
    assert S.versions(spark, path) == [3, 4]
    assert rows_of(S.read(spark, path, SCHEMA)) == [("a", A, 3), ("a", B, 0)]
    assert rows_of(S.read(spark, path, SCHEMA, version=3)) == [("a", A, 2), ("a", B, 0)]


def test_only_the_folders_of_the_days_are_opened(spark, make, tmp_path):
    path = str(tmp_path / "table")
    S.commit(make(("a", A, 1), ("a", B, 2)), path)
    S.commit(make(("a", B, 3)), path)
    files = S.read(spark, path, SCHEMA, B).inputFiles()
    held = S.manifest(spark, path)
    assert files and all(f"commit={held[B.isoformat()]}/day=2021-03-19" in f for f in files)
    with pytest.raises(Exception, match="without a day"):
        S.commit(make(("a", None, 1)), path)
