"""The stored daily summary and the report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navscore.operators.summary import in_days
from navscore.schemas import ALL_VENDORS, VALUE, VENDORS, summary_columns
from navscore.sources import snapshots


def summary_schema(code_type: T.DataType = T.StringType()) -> T.StructType:
    """The declared schema of the store, with the columns of every vendor."""
    types = {"fund_code": code_type, "type": T.StringType(), "day": T.DateType()}
    return T.StructType([T.StructField(n, types.get(n, VALUE)) for n in summary_columns()])


def write_summary(summary: DataFrame, path: str, days=None) -> None:
    """Store the summary as Parquet, one folder per day.

    Only the days present are replaced, so a rerun of a day leaves one copy of it. A run that
    knows its ``days`` (as in :func:`navscore.operators.summary.in_days`) passes them: days of
    the store that the run covers and has no rows for are emptied. The rebalance hint lets
    AQE merge small days and cut a hot one into several files; rows are sorted by fund within
    a file, which keeps per-file fund ranges narrow.
    """
    write_days(summary, path, days, ("fund_code",))


def write_days(rows: DataFrame, path: str, days=None, order=()) -> None:
    """Store rows as Parquet, one folder per day, sorted by ``order`` within a file; which days
    are replaced is said at :func:`write_summary`."""
    spark = rows.sparkSession
    before = {} if days is None else _day_files(spark, path, days)
    (
        rows.hint("rebalance", F.col("day"))
        .sortWithinPartitions("day", *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )
    if before:
        after = _day_files(spark, path, days)
        stale = [day for day, files in before.items() if after.get(day) == files]
        for day in stale:  # not written by this run, which covers it
            folder, files = _folder(spark, f"{path.rstrip('/')}/{day}")
            files.delete(folder, True)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _day_files(spark: SparkSession, path: str, days) -> dict[str, set[str]]:
    """The file names in each stored day folder that ``days`` covers."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return {}
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    stored = [(n, n.removeprefix("day=")) for n in names if n.startswith("day=")]
    if not stored:
        return {}
    listed = spark.createDataFrame(stored, "name string, day string")
    covered = listed.select("name", F.col("day").cast("date")).filter(in_days(days)).collect()
    found = {}
    for row in covered:
        inner, _ = _folder(spark, f"{path.rstrip('/')}/{row['name']}")
        found[row["name"]] = {status.getPath().getName() for status in files.listStatus(inner)}
    return found


def read_summary(
    spark: SparkSession, path: str, days=None, code_type: T.DataType = T.StringType()
) -> DataFrame:
    """The stored summary with the columns of every vendor; ``days`` as in
    :func:`navscore.operators.summary.in_days` prunes the day folders.

    The declared schema is read, so days stored without a vendor have nulls in its columns;
    see :func:`complete_rows`.
    """
    stored = spark.read.schema(summary_schema(code_type)).parquet(path).select(*summary_columns())
    return stored if days is None else stored.filter(in_days(days))


def commit_summary(summary: DataFrame, path: str, days=None) -> int:
    """Replace days of an atomic store in one step; see :mod:`navscore.sources.snapshots`. The
    columns of vendors that the summary lacks are null."""
    held = [
        (F.col(f.name) if f.name in summary.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in summary_schema(summary.schema["fund_code"].dataType)
    ]
    return snapshots.commit(summary.select(*held), path, days, ("fund_code",))


def committed_summary(
    spark: SparkSession,
    path: str,
    days=None,
    code_type: T.DataType = T.StringType(),
    version: int | None = None,
) -> DataFrame:
    """The summary of an atomic store as of its last complete commit, or of ``version``."""
    found = snapshots.read(spark, path, summary_schema(code_type), days, version)
    return found.select(*summary_columns())


def complete_rows(stored: DataFrame, vendors=ALL_VENDORS) -> DataFrame:
    """The rows that hold every chosen vendor, as the joins of a single day would give."""
    return stored.dropna(subset=[VENDORS[code].nav for code in vendors])


def incomplete_days(stored: DataFrame, vendors=ALL_VENDORS) -> DataFrame:
    """Days with rows that lack one of ``vendors``, and the number of such rows."""
    lacking = F.lit(False)
    for code in vendors:
        lacking = lacking | F.col(VENDORS[code].nav).isNull()
    return stored.filter(lacking).groupBy("day").agg(F.count(F.lit(1)).alias("rows_left_out"))


def write_csv(
    report: DataFrame, path: str, order=(), mode: str = "append", files: int = 1
) -> None:
    """Add a report to a CSV folder as one file with a header, sorted by ``order``.

    The rows are brought together only after the aggregation is complete: without the
    exchange, the one writing task would also have to merge all partial results. With more
    ``files`` they follow one another in the order.
    """
    if files == 1:
        dealt = report.repartition(1)
    else:
        dealt = report.repartitionByRange(files, *order) if order else report.repartition(files)
    if order:
        dealt = dealt.sortWithinPartitions(*order)
    dealt.write.mode(mode).option("header", True).csv(path)


def preview(frame: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows, for looking at."""
    return frame.limit(rows)
