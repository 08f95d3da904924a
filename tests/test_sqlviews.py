"""Reports called from SQL against the same reports as DataFrames."""

import pytest

from navscore.plans import sqlviews
from navscore.plans.reports import REPORTS, Scope, report
from navscore.schemas import GROUPINGS
from tests.test_states import DAYS, SCHEMA, plain, summary_rows


@pytest.fixture(scope="module")
def registered(spark):
    summary = spark.createDataFrame(summary_rows(6, 120), SCHEMA)
    names = sqlviews.register(summary, "own", coverage="any")
    return summary, names


@pytest.mark.parametrize("grouping", list(GROUPINGS))
def test_views_equal_the_reports(spark, registered, grouping):
    summary, names = registered
    assert len(names) == 1 + 3 * len(REPORTS)
    for name in ("r2_abs_mean", "r3_abs_median", "r8_abs_bands") if grouping == "day" else REPORTS:
        found = spark.sql(f"SELECT * FROM own_{name}_{grouping}")
        assert plain(found) == plain(report(name, summary, Scope(GROUPINGS[grouping], coverage="any"))), name


def test_table_function_over_days(spark, registered):
    summary, _ = registered
    found = spark.sql("SELECT * FROM own_between(DATE '2021-03-16', DATE '2021-03-17')")
    assert plain(found) == plain(summary.where("day >= '2021-03-16'"))
    counted = spark.sql("SELECT type, count(*) AS n FROM own_between(DATE '2021-03-15', DATE '2021-03-15') GROUP BY type")
    assert sum(r.n for r in counted.collect()) == summary.where(summary.day == DAYS[0]).count()


def test_registering_again_replaces(spark, registered):
    summary, _ = registered
    sqlviews.register(summary.limit(0), "again")
    assert spark.sql("SELECT * FROM again_r2_abs_mean_week").count() == 0
    sqlviews.register(summary, "again", coverage="any", groupings=("week",))
    assert spark.sql("SELECT * FROM again_r2_abs_mean_week").count() == 3
