"""The reports written one vendor at a time: 43 separate aggregations over the summary.

This is the straightforward form that the one-pass reports replace. It shares no code
with them beyond the column names, so it also serves as a second opinion in the tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

METRIC = "decimal(16,3)"


def _absolute(code):
    return F.abs(F.col(f"{code}_nav") - F.col("report_nav"))


def _relative(code):
    return F.abs((F.col(f"{code}_nav") - F.col("report_nav")) / F.col("report_nav"))


def _joined(summary, keys, vendors, column):
    """One aggregation per vendor, joined on the keys."""
    parts = [
        summary.groupBy(*keys).agg(column(code), F.count(F.lit(1)).alias(f"n_{code}"))
        for code in vendors
    ]
    first = parts[0].withColumnRenamed(f"n_{vendors[0]}", "fund_count")
    rest = [part.drop(f"n_{code}") for code, part in zip(vendors[1:], parts[1:])]
    if keys:
        return reduce(lambda a, b: a.join(b, list(keys)), rest, first)
    rows = [part.withColumn("one", F.lit(1)) for part in (first, *rest)]
    return reduce(lambda a, b: a.join(b, "one"), rows).drop("one")


def _bands(summary, keys, vendors, value, edges, names, cumulative):
    parts = []
    for code in vendors:
        conditions = []
        for i, edge in enumerate(edges):
            condition = value(code) <= F.lit(float(edge))
            if i and not cumulative:
                condition = condition & (value(code) > F.lit(float(edges[i - 1])))
            conditions.append(condition)
        conditions.append(value(code) > F.lit(float(edges[-1])))
        shares = [
            (F.sum(F.when(c, 1).otherwise(0)) / F.count(F.lit(1)) * 100).cast(METRIC).alias(n)
            for c, n in zip(conditions, names)
        ]
        parts.append(summary.groupBy(*keys).agg(F.lit(code).alias("vendor"), *shares))
    return reduce(lambda a, b: a.unionByName(b), parts)


def reports(summary, keys, vendors, abs_edges, rel_edges, band_columns):
    """All eleven reports by name."""
    returning = [v for v in vendors if v != "wind"]
    opposite = {
        v: F.sum(F.when(F.col("report_return") * F.col(f"{v}_return") < 0, 1).otherwise(0))
        for v in returning
    }
    count = F.count(F.lit(1))
    found = {
        "r1_opposite": summary.groupBy(*keys).agg(
            count.alias("fund_count"),
            *[opposite[v].alias(f"{v}_opposite") for v in returning],
            *[
                (opposite[v] / count * 100).cast(METRIC).alias(f"{v}_opposite_pct")
                for v in returning
            ],
        )
    }
    for kind, value, factor, edges, numbers in (
        ("abs", _absolute, 1000, abs_edges, ("r2", "r3", "r4", "r8", "r9")),
        ("rel", _relative, 100, rel_edges, ("r5", "r6", "r7", "r10", "r11")),
    ):

        def rounded(code, value=value, factor=factor):
            return (value(code) * factor).cast(METRIC)

        found[f"{numbers[0]}_{kind}_mean"] = summary.groupBy(*keys).agg(
            count.alias("fund_count"),
            *[
                (F.sum(value(v)) / count * factor).cast(METRIC).alias(f"{v}_{kind}_mean")
                for v in vendors
            ],
        )
        found[f"{numbers[1]}_{kind}_median"] = _joined(
            summary,
            keys,
            vendors,
            lambda v, kind=kind, rounded=rounded: F.median(rounded(v).cast("double"))
            .cast(METRIC)
            .alias(f"{v}_{kind}_median"),
        )
        found[f"{numbers[2]}_{kind}_std"] = _joined(
            summary,
            keys,
            vendors,
            lambda v, kind=kind, rounded=rounded: F.stddev_pop(rounded(v))
            .cast(METRIC)
            .alias(f"{v}_{kind}_std"),
        )
        for number, label, cumulative in (
            (numbers[3], "bands", False),
            (numbers[4], "cumulative", True),
        ):
            found[f"{number}_{kind}_{label}"] = _bands(
                summary, keys, vendors, value, edges, band_columns(edges, cumulative), cumulative
            )
    return found
