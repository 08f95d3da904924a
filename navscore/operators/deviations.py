"""Deviations per vendor, side by side (wide) or one row per vendor (long).

Wide, a row costs one lookup of its group however many vendors there are; it suits one
report, which needs a few aggregates per vendor. Long, every aggregate is written once
with the vendor as a value; it suits all measures at once, which side by side would make
code too large for the JVM to compile. Rows are multiplied inside the scan stage, before
the partial aggregation, so the shuffle carries one partial row per group and vendor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navscore.functions import deviation as D
from navscore.schemas import ALL_VENDORS, VENDORS

DEVIATIONS = ("opposite_row", "abs", "abs_rounded", "rel", "rel_rounded")


def _deviations(est_nav, est_return) -> dict:
    """The deviation columns of one estimate; without a return there is no direction."""
    actual = F.col("report_nav")
    absolute = D.abs_deviation(est_nav, actual)
    columns = {
        "abs": absolute,
        "abs_rounded": D.abs_thousandths(absolute),
        "rel": D.rel_deviation(absolute, actual),
        "rel_rounded": D.rel_thousandths(absolute, actual),
    }
    if est_return is not None:
        columns["opposite_row"] = D.opposite(F.col("report_return"), est_return)
    return columns


def wide_deviations(summary: DataFrame, keys, vendors=ALL_VENDORS, only=DEVIATIONS) -> DataFrame:
    """``keys`` and, per vendor, ``<vendor>_<name>`` for the deviations in ``only``."""
    columns = []
    for code in vendors:
        vendor = VENDORS[code]
        est_return = F.col(vendor.ret) if vendor.has_return else None
        for name, value in _deviations(F.col(vendor.nav), est_return).items():
            if name in only:
                columns.append(value.alias(f"{code}_{name}"))
    return summary.select(*keys, *columns)


def long_deviations(summary: DataFrame, keys, vendors=ALL_VENDORS) -> DataFrame:
    """``keys``, ``vendor`` and the deviations, one row per row of the summary and vendor."""
    quotes = []
    for code in vendors:
        vendor = VENDORS[code]
        ret = F.col(vendor.ret) if vendor.has_return else F.lit(None)
        quotes += [F.lit(code), F.col(vendor.nav).cast("double"), ret.cast("double")]
    stacked = summary.select(
        *keys,
        "report_nav",
        "report_return",
        F.stack(F.lit(len(vendors)), *quotes).alias("vendor", "est_nav", "est_return"),
    )
    values = _deviations(F.col("est_nav"), F.col("est_return"))
    return stacked.select(*keys, "vendor", *[v.alias(name) for name, v in values.items()])


def by_vendor(frame: DataFrame, keys, columns, vendors=ALL_VENDORS) -> DataFrame:
    """Turn one row per group and vendor into one row per group: ``fund_count`` and
    ``<vendor>_<column>`` for each of ``columns``."""
    picked = [
        F.max(F.when(F.col("vendor") == code, F.col(column))).alias(f"{code}_{column}")
        for code in vendors
        for column in columns
    ]
    return frame.groupBy(*keys).agg(F.max("fund_count").alias("fund_count"), *picked)
