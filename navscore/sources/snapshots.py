"""Tables by day whose commits are whole: readers see the last complete one or the one before.

A commit writes its days to a folder of its own, then a manifest that names, for every day of
the table, the commit that holds it. The manifest is written beside its place and renamed, so
it appears as a whole or not at all, and its name is the next number, so that of two
commits at a time the second fails instead of hiding the first. A run that breaks down
leaves files that no manifest names; ``vacuum`` removes them.

    data/commit=<id>/day=<day>/part-*.parquet
    manifests/<number>.json          {"2021-03-18": "<id>", ...}

Readers open exactly the folders that the manifest names for the days they want. The manifest
holds one line per day; nothing else passes through the driver.

Defined cases: a table without a manifest has no rows; a day that a commit covers and has no
rows for is gone from the table; rows without a day are refused.
"""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another commit took the number of this one."""


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system for ``path``, which work for every store Spark can use."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, files = _files(spark, path)
    if not files.exists(folder):
        return []
    return [status.getPath().getName() for status in files.listStatus(folder)]


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete commits, in order."""
    names = _names(spark, f"{path}/manifests")
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """Day to commit, of the last complete commit or of ``version``."""
    known = versions(spark, path)
    if not known:
        return {}
    text = spark.read.text(f"{path}/manifests/{known[-1] if version is None else version}.json")
    return json.loads("".join(row["value"] for row in text.collect()))


def _publish(spark: SparkSession, path: str, number: int, days: dict[str, str]) -> None:
    """Write a manifest under its number, whole or not at all."""
    draft, files = _files(spark, f"{path}/manifests/.draft-{uuid.uuid4().hex}")
    place, _ = _files(spark, f"{path}/manifests/{number}.json")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(days, sort_keys=True).encode()))
    finally:
        stream.close()
    if files.exists(place) or not files.rename(draft, place):
        files.delete(draft, False)
        raise Conflict(f"commit {number} of {path} exists already")


def covered(days, known) -> set[str]:
    """Which of the days (as texts) ``days`` covers: a date, a list, or a (first, last) pair."""
    if days is None:
        return set()
    if isinstance(days, tuple):
        first, last = days
        return {d for d in known if first <= date.fromisoformat(d) <= last}
    wanted = days if isinstance(days, list) else [days]
    return {d.isoformat() for d in wanted} & set(known)


def commit(rows: DataFrame, path: str, days=None, order=()) -> int:
    """Replace the days of ``rows``, and those that ``days`` covers, in one step; the number of
    the commit. The other days stay as they are, without being read or copied."""
    spark, path = rows.sparkSession, path.rstrip("/")
    before = versions(spark, path)
    held = manifest(spark, path)
    own = uuid.uuid4().hex
    folder = f"{path}/data/commit={own}"
    day = F.when(F.col("day").isNull(), F.raise_error(F.lit("a row without a day")).cast("date"))
    (
        rows.withColumn("day", day.otherwise(F.col("day")))
        .hint("rebalance", F.col("day"))
        .sortWithinPartitions("day", *order)
        .write.partitionBy("day")
        .parquet(folder)
    )
    written = {n.removeprefix("day=") for n in _names(spark, folder) if n.startswith("day=")}
    gone = covered(days, held) | written
    after = {d: c for d, c in held.items() if d not in gone} | dict.fromkeys(written, own)
    number = before[-1] + 1 if before else 1
    _publish(spark, path, number, after)
    return number


def read(
    spark: SparkSession, path: str, schema: T.StructType, days=None, version: int | None = None
) -> DataFrame:
    """The rows of the last complete commit, or of an earlier ``version``; only the folders of
    the chosen ``days`` are opened."""
    path = path.rstrip("/")
    held = manifest(spark, path, version)
    chosen = sorted(held if days is None else covered(days, held))
    if not chosen:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/data/commit={held[d]}/day={d}" for d in chosen]
    whole = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
    found = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*folders)
    return found.select(*schema.fieldNames())


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove manifests but the last ``keep``, and the commits that those do not name. No
    other run may be writing or reading an older version."""
    path = path.rstrip("/")
    known = versions(spark, path)
    named = {c for v in known[-keep:] for c in manifest(spark, path, v).values()}
    for version in known[:-keep]:
        place, files = _files(spark, f"{path}/manifests/{version}.json")
        files.delete(place, False)
    removed = [n for n in _names(spark, f"{path}/data") if n.removeprefix("commit=") not in named]
    for name in removed:
        folder, files = _files(spark, f"{path}/data/{name}")
        files.delete(folder, True)
    return removed
