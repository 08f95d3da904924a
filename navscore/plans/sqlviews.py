"""The summary and the reports as SQL sees them.

``register`` gives a session views named after a prefix: the summary, and each report for each
grouping (``fund_r2_abs_mean_week``). They are plans, not copies: a query over a view reads
only the columns and days it needs. ``fund_between(first, last)`` is a table function over the
summary, for reports of one's own over a range of days.

Defined cases: registering again replaces; an empty summary gives empty views, a whole-table
report its one row without metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from navscore.operators.measures import ABS_EDGES, REL_EDGES
from navscore.plans.reports import REPORTS, Scope, report
from navscore.schemas import ALL_VENDORS, GROUPINGS


def view_name(prefix: str, name: str, grouping: str) -> str:
    return f"{prefix}_{name}_{grouping}"


def register(
    summary: DataFrame,
    prefix: str = "fund",
    vendors=ALL_VENDORS,
    coverage: str = "common",
    abs_edges=ABS_EDGES,
    rel_edges=REL_EDGES,
    groupings=tuple(GROUPINGS),
    reports=tuple(REPORTS),
) -> list[str]:
    """Register the views and the function in the summary's session; the names of the views."""
    spark: SparkSession = summary.sparkSession
    summary.createOrReplaceTempView(f"{prefix}_summary")
    names = [f"{prefix}_summary"]
    for grouping in groupings:
        scope = Scope(GROUPINGS[grouping], tuple(vendors), abs_edges, rel_edges, coverage)
        for name in reports:
            names.append(view_name(prefix, name, grouping))
            report(name, summary, scope).createOrReplaceTempView(names[-1])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in summary.schema)
    kept = ", ".join(f"s.`{c}`" for c in summary.columns)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_between(first DATE, last DATE) "
        f"RETURNS TABLE ({columns}) RETURN SELECT {kept} FROM {prefix}_summary s "
        f"WHERE s.day BETWEEN {prefix}_between.first AND {prefix}_between.last"
    )
    return names
