"""Helpers shared by the text operators: words, row identity, scratch tables, samples."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
WORD_BREAK = f"[{SPACE}]+"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names.

    A session without that setting gets a folder under the warehouse if it runs on one
    machine, as in tests; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written to the shared scratch folder and read back: lineage ends here."""
    spark = frame.sparkSession
    path = scratch(spark, label)
    schema = frame.schema
    frame.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(columns, name: str) -> str:
    """A name for a helper column that no column has, in any spelling."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """The text, a null text counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of other characters than ASCII white space, in order."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(rows: DataFrame, label: str, per_label: int, order: Column) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash and so the same every time.

    One count per label sets the rate at which its rows are taken; no row is shuffled. The
    expected size is ``per_label`` whatever the table holds. Rows with equal ``order`` come
    together, so the caller makes rows distinct before or after.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return rows.limit(0)
    rate = F.lit(0.0)
    for row in counts:
        share = min(1.0, per_label / row["n"])
        rate = F.when(F.col(label) == F.lit(row[label]), F.lit(share)).otherwise(rate)
    point = F.pmod(F.xxhash64(order, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(point < rate)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps that nothing refers to any more.

    The context cleaner acts when the driver collects garbage, which a driver that only
    plans may not do for half an hour; between large steps that would keep all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def byte_slices(batch: pa.RecordBatch, column: int, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts have together about ``size`` bytes.

    A longer text stands alone. Working on slices bounds the Python objects of a task
    whatever the number of rows in a batch.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(ends):
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(row, stop - row)
        row = stop
