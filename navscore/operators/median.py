"""Exact grouped medians for groups of every size.

The values are whole numbers (thousandths). Groups are sorted by their number of rows, which
one scan of the keys counts. The values of a group of up to ``SMALL_ROWS`` rows are collected as
arrays, one shuffled row per row of the input; a task holds no more than the arrays of some
hundred such groups before it sorts by key instead. Larger groups, in which values repeat, are
counted by value:

One aggregation turns the rows into counts per group, measure and value; it combines before
the shuffle, so a hot value or group costs its distinct values and not its rows. Everything
else reads these counts, through the same shuffle: counts per bucket of values, a running count
over the buckets that finds the one or two which hold the middle ranks, and a running count
over the values of those buckets.

A bucket is as wide as 0.1 percent of its values. A group has at most some 40 000 buckets
whatever its number of rows, and a bucket holds at most a thousandth of its largest value
(in thousandths) as distinct values; these are the largest sets one task sorts. For values
near 10 ** 11 thousandths, a deviation of 10 ** 5, that is up to 10 ** 8 values in the two middle
buckets of a group, which the window sorts with spilling. No group is one key.

Only where groups of both sorts occur are the rows matched with the list of the large ones. It
is broadcast if its keys were measured to be within ``BROADCAST_BYTES``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navscore.functions.deviation import thousandths_to_metric

BUCKETS_PER_E_FOLD = 1000

# Values are never negative, so this marks a missing one and sorts before all others.
MISSING = -1

# Rows up to which the values of a group are collected. Ten measures of 8192 rows are about
# 1 MB, and an aggregation holds 128 groups before it falls back to sorting.
SMALL_ROWS = 8192

# Bytes of keys up to which the list of large groups is broadcast where a join needs it.
BROADCAST_BYTES = 8 * 1024 * 1024


def grouped_medians(
    df: DataFrame, keys, values: Mapping[str, Column], small_rows: int = SMALL_ROWS
) -> DataFrame:
    """``keys``, ``fund_count`` and the exact median of each of ``values``.

    ``values`` are counts of thousandths, not negative; the medians are rounded half up
    to three decimals. Nulls do not take part, and a group without values has the median
    null. With keys, the sizes of the groups are counted at once, by a job that reads the keys
    only; the result is exact whatever rows are added afterwards.
    """
    keys = list(keys)

    def by_counts(rows: DataFrame) -> DataFrame:
        return counted_medians(value_counts(rows, keys, values), keys, list(values))

    if not keys:
        return by_counts(df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))
    is_large = F.col("group_rows") > small_rows
    key_bytes = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + F.lit(16) for k in keys],
    )
    found = sizes.agg(
        F.count_if(is_large).alias("large"),
        F.count_if(~is_large).alias("small"),
        F.sum(F.when(is_large, key_bytes)).alias("large_bytes"),
    ).first()
    if not found.large:
        return collected_medians(df, keys, values)
    if not found.small:
        return by_counts(df)
    large = sizes.filter(is_large).select(*[F.col(k).alias(f"large_{k}") for k in keys])
    if found.large_bytes <= BROADCAST_BYTES:
        large = F.broadcast(large)
    matches = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"large_{k}")) for k in keys]
    )
    return by_counts(df.join(large, matches, "left_semi")).unionByName(
        collected_medians(df.join(large, matches, "left_anti"), keys, values)
    )


def collected_medians(df: DataFrame, keys, values: Mapping[str, Column]) -> DataFrame:
    """The result of :func:`grouped_medians` from the sorted values of each group.

    The values of a row are collected together, so a row costs one element of one list.
    """
    held = [F.coalesce(v.cast("bigint"), F.lit(MISSING)).alias(name) for name, v in values.items()]
    quoted = [F.count(v).cast("int").alias(f"{name}_rows") for name, v in values.items()]
    rows = F.collect_list(F.struct(*held)).alias("rows")
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("fund_count"), rows, *quoted)
    ordered = grouped.select(
        *keys,
        "fund_count",
        *[f"{name}_rows" for name in values],
        *[F.sort_array(F.col("rows")[name]).alias(name) for name in values],
    )
    return ordered.select(*keys, "fund_count", *[_middle_of(name).alias(name) for name in values])


def counted_medians(counted: DataFrame, keys, names) -> DataFrame:
    """The result of :func:`grouped_medians` from rows of the form of :func:`value_counts`."""
    keys = list(keys)
    ranked = rank_values(counted, locate_middle(counted, keys), keys)
    low_and_high = [
        F.min(
            F.when((F.col("measure") == i) & (F.col("reached") >= F.col(rank)), F.col("value"))
        ).alias(f"{name}_{rank}")
        for i, name in enumerate(names)
        for rank in ("low", "high")
    ]
    rows = F.coalesce(F.max("group_rows"), F.lit(0)).alias("fund_count")
    picked = ranked.groupBy(*keys).agg(rows, *low_and_high)
    return picked.select(*keys, "fund_count", *[_middle(name).alias(name) for name in names])


def bucket(value: Column) -> Column:
    """A bucket number that never decreases with the value; missing values come first."""
    return F.coalesce(F.floor(F.log1p(value) * F.lit(float(BUCKETS_PER_E_FOLD))), F.lit(MISSING))


def value_counts(df: DataFrame, keys, values: Mapping[str, Column]) -> DataFrame:
    """``keys``, ``measure`` (the position in ``values``), ``bucket``, ``value``, ``rows``."""
    counted = stacked_counts(df, keys, list(values.values()))
    return counted.select(*keys, "measure", bucket(F.col("value")).alias("bucket"), "value", "rows")


def stacked_counts(df: DataFrame, keys, values: list[Column]) -> DataFrame:
    """``keys``, ``measure`` (the position in ``values``), ``value`` and how many ``rows`` have it."""
    held = [F.coalesce(value.cast("bigint"), F.lit(MISSING).cast("bigint")) for value in values]
    long = df.select(*keys, F.posexplode(F.array(*held)).alias("measure", "value"))
    return long.groupBy(*keys, "measure", "value").agg(F.count(F.lit(1)).alias("rows"))


def locate_middle(counted: DataFrame, keys) -> DataFrame:
    """The buckets that hold the middle ranks ``low`` and ``high`` of a group and measure,
    with the rows ``before`` the bucket and the ``group_rows``."""
    whole = Window.partitionBy(*keys, "measure")
    running = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    missing = F.when(F.col("bucket") == MISSING, F.col("bucket_rows")).otherwise(0)
    return (
        counted.groupBy(*keys, "measure", "bucket")
        .agg(F.sum("rows").alias("bucket_rows"))
        .withColumn("reached", F.sum("bucket_rows").over(running))
        .withColumn("group_rows", F.max("reached").over(whole))
        .withColumn("missing", F.max(missing).over(whole))
        .withColumn("low", F.expr("missing + (group_rows - missing + 1) div 2"))
        .withColumn("high", F.expr("missing + (group_rows - missing) div 2 + 1"))
        .withColumn("before", F.col("reached") - F.col("bucket_rows"))
        .filter((F.col("reached") >= F.col("low")) & (F.col("before") < F.col("high")))
        .select(*keys, "measure", "bucket", "low", "high", "before", "group_rows")
    )


def rank_values(counted: DataFrame, located: DataFrame, keys) -> DataFrame:
    """The values of the middle buckets with ``reached``, the rows of the group up to them.

    All columns are matched null-safe, which also keeps the optimizer from filtering one of
    the two readers of ``counted`` and so from computing it twice.
    """
    shared = [*keys, "measure", "bucket"]
    renamed = located.withColumnsRenamed({c: f"middle_{c}" for c in shared})
    matches = [F.col(c).eqNullSafe(F.col(f"middle_{c}")) for c in shared]
    candidates = counted.join(renamed, reduce(lambda a, b: a & b, matches))
    by_value = Window.partitionBy(*shared).orderBy("value")
    running = F.sum("rows").over(by_value.rowsBetween(Window.unboundedPreceding, 0))
    return candidates.withColumn("reached", F.col("before") + running)


def _middle(name: str) -> Column:
    """Mean of the two middle values, rounded half up; null when the values are missing."""
    half_up = F.expr(f"({name}_low + {name}_high + 1) div 2")
    return F.when(F.col(f"{name}_low") != MISSING, thousandths_to_metric(half_up))


def _middle_of(name: str) -> Column:
    """The mean of the two middle values of a sorted array that starts with the missing ones,
    rounded half up; null when all are missing."""
    rows = f"{name}_rows"
    missing = f"size({name}) - {rows}"
    low = F.get(name, F.expr(f"cast({missing} + ({rows} + 1) div 2 - 1 as int)"))
    high = F.get(name, F.expr(f"cast({missing} + {rows} div 2 as int)"))
    return F.when(F.col(rows) > 0, thousandths_to_metric(F.shiftright(low + high + 1, 1)))
