"""The fund-by-day summary: feeds joined with the disclosed values and the fund types.

By default all joins are inner joins on the fund and the day, so a fund-day appears only when
every chosen vendor quoted it (``coverage="common"``). With ``coverage="any"`` the vendors are
joined from the left: every disclosed fund-day of a classified fund stays, with nulls for the
vendors that lack it, and :func:`presence` tells which those are. No side is broadcast by hint: the small class tables and fund
lists fall under Spark's size threshold, a large one takes a shuffled join instead, and
AQE splits partitions that one hot fund makes too large.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navscore.functions.parsing import percent_number
from navscore.schemas import ALL_VENDORS, VENDORS, summary_columns

# Vendors whose estimates arrive in the same feed as the disclosed values.
IN_TRUTH_FEED = ("jy", "tiantian")


def in_days(days) -> Column:
    """Filter on ``day``: one date, a list of dates, or a ``(first, last)`` tuple."""
    if isinstance(days, tuple):
        return F.col("day").between(F.lit(days[0]), F.lit(days[1]))
    if isinstance(days, list):
        return F.col("day").isin(days)
    return F.col("day") == F.lit(days)


def classify(fund_classes: DataFrame, class_names: DataFrame) -> DataFrame:
    """Fund to type name through the class code."""
    return fund_classes.join(class_names, "class_code").select("fund_code", "type")


# Whether a fund-day needs every vendor, or stays with the vendors it has.
COVERAGES = ("common", "any")


def presence(vendors=ALL_VENDORS) -> Column:
    """The vendors that a row of the summary holds, as a bit mask: bit ``i`` is set if there is
    a value of the vendor at position ``i`` of all vendors, whatever ``vendors`` are looked at."""
    bits = F.lit(0).cast("bigint")
    for position, code in enumerate(ALL_VENDORS):
        if code in vendors:
            held = F.when(F.col(VENDORS[code].nav).isNotNull(), F.lit(1 << position)).otherwise(0)
            bits = bits + held
    return bits


def coverage_counts(summary: DataFrame, keys, vendors=ALL_VENDORS) -> DataFrame:
    """``keys``, ``present`` (see :func:`presence`) and the ``fund_days`` with these vendors."""
    return (
        summary.select(*keys, presence(vendors).alias("present"))
        .groupBy(*keys, "present")
        .agg(F.count(F.lit(1)).alias("fund_days"))
    )


def build_summary(
    truth: DataFrame,
    estimates: Mapping[str, DataFrame],
    fund_types: DataFrame,
    vendors=ALL_VENDORS,
    days=None,
    coverage: str = "common",
) -> DataFrame:
    """Join the feeds into the summary.

    ``estimates`` maps a vendor code to its feed; vendors outside ``vendors`` are not
    read. ``days`` restricts every feed before the joins, so that a stored feed
    partitioned by day is read only in part. ``coverage`` as above.
    """
    if coverage not in COVERAGES:
        raise ValueError(f"unknown coverage {coverage!r}")

    def restricted(feed: DataFrame) -> DataFrame:
        return feed if days is None else feed.filter(in_days(days))

    summary = restricted(truth)
    for code in vendors:
        if code in IN_TRUTH_FEED:
            continue
        vendor = VENDORS[code]
        feed = estimates[code]
        if vendor.has_return and vendor.ret not in feed.columns:
            feed = feed.withColumn(vendor.ret, percent_number(F.col(f"{code}_ratio")))
        quoted = [vendor.nav] + ([vendor.ret] if vendor.has_return else [])
        summary = summary.join(
            restricted(feed).select("fund_code", "day", *quoted),
            ["fund_code", "day"],
            "left" if coverage == "any" else "inner",
        )
    return summary.join(fund_types, "fund_code").select(*summary_columns(vendors))


def restrict_to_list(summary: DataFrame, fund_list: DataFrame, dedupe: bool = True) -> DataFrame:
    """Keep the funds of a list. A code listed twice keeps its rows once, or with
    ``dedupe=False`` repeats them once per mention."""
    codes = fund_list.select("fund_code")
    return summary.join(codes, "fund_code", "left_semi" if dedupe else "inner").select(
        *summary.columns
    )
