"""Session settings the engine relies on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Runtime settings only, so they can be applied to a session somebody else made.
# Skewed join partitions are split by AQE; the forced form also covers the chain of
# vendor joins, where splitting costs one more exchange. Broadcast joins are never
# forced: Catalyst and AQE choose them from measured sizes.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

TARGET_PARTITION_BYTES = 128 * 1024 * 1024

# Map status on the driver grows with map tasks times reduce partitions.
MOST_PARTITIONS = 20_000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shuffle_partitions(shuffled_bytes: int, cores: int) -> int:
    """Shuffle partitions of about 128 MB of what the largest join shuffles.

    At least one per core, so aggregations, which shuffle little, keep every core busy; AQE
    merges what is too small. At most ``MOST_PARTITIONS``: beyond some 2.5 TB per shuffle the
    partitions grow and spill instead of the driver's map status.
    """
    return min(max(cores, -(-shuffled_bytes // TARGET_PARTITION_BYTES)), max(cores, MOST_PARTITIONS))


def build_session(
    app_name: str = "navscore",
    master: str | None = None,
    shuffled_bytes: int | None = None,
    cores: int = 8,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the engine's settings; ``shuffled_bytes`` (of the vendor joins, not of
    the whole input) sizes the shuffles."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffled_bytes is not None:
        builder = builder.config(
            "spark.sql.shuffle.partitions", shuffle_partitions(shuffled_bytes, cores)
        )
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``. Where that is unset it
    is under the warehouse folder of a session on one machine; on a cluster it is required."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
