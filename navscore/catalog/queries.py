"""Every operator and report as a query over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navscore.catalog import feedlines as L
from navscore.catalog import tables as TB
from navscore.operators.summary import (
    build_summary,
    classify,
    coverage_counts,
    in_days,
    restrict_to_list,
)
from navscore.plans import sqlviews, states
from navscore.plans.reports import COMMON_LABELS, REPORTS, Scope, Scores, display, report
from navscore.plans.runs import load_feeds
from navscore.schemas import ALL_VENDORS, GROUPINGS, VENDORS_NO_WIND, summary_columns
from navscore.session import scratch_path, tune
from navscore.sources import feeds, store

# Name part -> (grouping, vendors, restricted to the fund list).
SCOPES = {
    "day": ("day", ALL_VENDORS, False),
    "day_nowind": ("day", VENDORS_NO_WIND, False),
    "day_top": ("day", ALL_VENDORS, True),
    "day_top_nowind": ("day", VENDORS_NO_WIND, True),
    "week": ("week", ALL_VENDORS, False),
    "all": ("all", ALL_VENDORS, False),
}


def scope(name: str) -> Scope:
    grouping, vendors, _ = SCOPES[name]
    return Scope(GROUPINGS[grouping], vendors, TB.TABLE_ABS_EDGES)


def with_double_metrics(frame: DataFrame) -> DataFrame:
    """Decimal metrics as doubles, which compare alike in both engines."""
    return frame.select(
        *[
            F.col(f.name).cast("double") if f.dataType.typeName() == "decimal" else F.col(f.name)
            for f in frame.schema.fields
        ]
    )


def table_summary(spark: SparkSession, sf_dir: str, top: bool = False) -> DataFrame:
    summary = TB.summary_table(tune(spark), sf_dir)
    return restrict_to_list(summary, TB.top_list(spark, sf_dir)) if top else summary


def run_report(name: str, scope_name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = table_summary(spark, sf_dir, top=SCOPES[scope_name][2])
    return with_double_metrics(report(name, summary, scope(scope_name)))


def run_display(name: str, scope_name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = table_summary(spark, sf_dir, top=SCOPES[scope_name][2])
    return display(name, report(name, summary, scope(scope_name)), scope(scope_name))


# --- the summary from its feeds ---------------------------------------------------------


def joined_summary(
    spark: SparkSession, sf_dir: str, vendors=ALL_VENDORS, days=None, chosen=None
) -> DataFrame:
    """The summary of all funds, or of the ``chosen`` ones."""
    fund_types = classify(TB.fund_classes(spark, sf_dir), TB.class_names(spark, sf_dir))
    truth = TB.truth_feed(tune(spark), sf_dir)
    return build_summary(
        truth if chosen is None else restrict_to_list(truth, chosen),
        TB.estimate_feeds(spark, sf_dir),
        fund_types,
        vendors,
        days,
    )


def latest_days(days: DataFrame, count: int):
    """The first and last of the latest ``count`` days, looked up in the table itself."""
    last = days.agg(F.max("day").alias("day"))
    return last.select(F.date_sub("day", count - 1)).scalar(), last.scalar()


def summary_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = TB.quotes(spark, sf_dir).select("day")
    return joined_summary(spark, sf_dir, days=latest_days(days, 1))


def summary_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = TB.quotes(spark, sf_dir).select("day")
    return joined_summary(spark, sf_dir, days=latest_days(days, 7))


def summary_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = TB.with_text_code(TB.top_list(spark, sf_dir).withColumnRenamed("fund_code", "part_key"))
    return joined_summary(spark, sf_dir, chosen=chosen)


def summary_top_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = TB.top_list(spark, sf_dir).select(F.col("fund_code").cast("string"))
    again = (
        TB.table(spark, sf_dir, "part")
        .filter(F.col("p_size") <= 2)
        .select(F.col("p_partkey").cast("string").alias("fund_code"))
    )
    return restrict_to_list(joined_summary(spark, sf_dir), chosen.unionByName(again), dedupe=False)


def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = TB.table(tune(spark), sf_dir, "supplier").select(
        F.col("s_suppkey").alias("fund_code"), F.col("s_nationkey").alias("class_code")
    )
    nations = TB.table(spark, sf_dir, "nation").join(
        TB.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    names = nations.select(
        F.col("n_nationkey").alias("class_code"),
        F.concat_ws("/", "r_name", "n_name").alias("type"),
    )
    return classify(suppliers, names)


def joined_report(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, path = joined_summary(spark, sf_dir), scratch_path(spark, "deviations")
    return with_double_metrics(report(name, summary, scope("week"), path))


# --- fund-days that some vendors lack ---------------------------------------------------


def sparse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of feeds with gaps, with every disclosed fund-day."""
    fund_types = classify(TB.fund_classes(spark, sf_dir), TB.class_names(spark, sf_dir))
    truth = TB.truth_feed(tune(spark), sf_dir)
    return build_summary(truth, TB.sparse_feeds(spark, sf_dir), fund_types, coverage="any")


def any_scope(name: str) -> Scope:
    return replace(scope(name), coverage="any")


def coverage_report(name: str, scope_name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in which each vendor is scored on the fund-days it has."""
    summary, path = sparse_summary(spark, sf_dir), scratch_path(spark, "deviations")
    return with_double_metrics(report(name, summary, any_scope(scope_name), path))


def coverage_full(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report where every vendor has every row: the figures of the default."""
    summary = table_summary(spark, sf_dir)
    found = report(name, summary, any_scope("week"))
    return with_double_metrics(found.drop("rows", *[f"{code}_rows" for code in ALL_VENDORS]))


def coverage_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fund-days per type and set of vendors."""
    return coverage_counts(sparse_summary(spark, sf_dir), GROUPINGS["week"])


# --- reports by SQL ---------------------------------------------------------------------


def sql_report(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report by type, called from SQL."""
    summary = table_summary(spark, sf_dir)
    edges = TB.TABLE_ABS_EDGES
    sqlviews.register(summary, "fund", abs_edges=edges, groupings=("week",), reports=(name,))
    return with_double_metrics(spark.sql(f"SELECT * FROM fund_{name}_week"))


def sql_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest seven days of the summary through the table function."""
    sqlviews.register(table_summary(spark, sf_dir), "fund", groupings=())
    last = TB.quotes(spark, sf_dir).agg(F.max("day")).first()[0]
    columns = ", ".join(summary_columns())
    return spark.sql(
        f"SELECT {columns} FROM fund_between(DATE '{last}' - INTERVAL 6 DAY, DATE '{last}')"
    )


# --- states of days ---------------------------------------------------------------------


def week_report(name: str, scope_: Scope, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the latest seven days from their stored states alone."""
    summary, path = table_summary(spark, sf_dir), scratch_path(spark, "states")
    week = latest_days(TB.quotes(spark, sf_dir).select("day"), 7)
    kinds = (states.state_kind(name),)
    states.write_states(summary.filter(in_days(week)), path, scope_, week, kinds)
    return with_double_metrics(states.state_report(spark, name, path, scope_, week))


def whole_report(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of all days from the states of each."""
    summary, kind = table_summary(spark, sf_dir), states.state_kind(name)
    only = {} if kind == "partials" else {"kinds": (REPORTS[name].kind,)}
    found = states.STATES[kind](summary, scope("all"), **only)
    return with_double_metrics(states.report_of(name, found, scope("all")))


def every_level() -> Scope:
    return replace(scope("day"), keys=states.ALL_LEVELS)


def sketch_errors(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type and vendor whether the sketched median's rank is within the bound, by the
    exact counts of the values below and up to it."""
    week, summary = scope("week"), table_summary(spark, sf_dir)
    found = states.sketched_medians(states.day_sketches(summary, week, (kind,)), week, (kind,))
    pairs = [x for c in ALL_VENDORS for x in (F.lit(c), F.col(f"{c}_{kind}_median"))]
    medians = found.select(
        "type", F.stack(F.lit(len(ALL_VENDORS)), *pairs).alias("vendor", "median")
    ).withColumn("median", (F.col("median") * 1000).cast("bigint"))
    counts = states.day_histograms(summary, week, (kind,))
    rows = F.col("rows")
    ranked = counts.join(medians, ["type", "vendor"]).groupBy("type", "vendor").agg(
        F.sum(rows).alias("rows"),
        F.sum(F.when(F.col("value") < F.col("median"), rows).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("value") <= F.col("median"), rows).otherwise(0)).alias("up_to"),
    )
    within = (F.col("below") <= rows * (0.5 + states.RANK_ERROR)) & (
        F.col("up_to") >= rows * (0.5 - states.RANK_ERROR)
    )
    return ranked.select("type", "vendor", "rows", within.alias("within"))


# --- feeds, sinks and stored runs -------------------------------------------------------

# Feed name -> loader and the lines it is fed.
FEEDS = {
    "truth": (feeds.load_truth, L.truth_lines),
    "hm": (feeds.load_hm, L.hm_lines),
    "hm_pipe": (partial(feeds.load_hm, layout="pipe"), L.hm_pipe_lines),
    "ant": (feeds.load_ant, L.ant_lines),
    "wind": (feeds.load_wind, L.wind_lines),
    "fund_classes": (feeds.load_fund_classes, L.fund_class_lines),
    "class_names": (feeds.load_class_names, L.class_name_lines),
    "top_list": (feeds.load_top_list, L.top_list_lines),
    "summary_text": (feeds.load_summary_text, L.summary_lines),
}


def feed_rows(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    load, lines = FEEDS[name]
    return load(lines(tune(spark), sf_dir)).rows


def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected lines per feed and reason."""
    loaded = {name: load(lines(tune(spark), sf_dir)) for name, (load, lines) in FEEDS.items()}
    return feeds.line_counts(loaded).filter("reject_reason is not null")


def stored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary written by day and read back."""
    path = scratch_path(spark, "summary")
    store.write_summary(table_summary(spark, sf_dir), path)
    return store.read_summary(spark, path, code_type=T.LongType())


def committed_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest seven days from an atomic store: committed with wrong values, of which a
    second commit replaces all but what the first got right."""
    summary = table_summary(spark, sf_dir)
    last = TB.quotes(spark, sf_dir).agg(F.max("day")).first()[0]
    week, late = (last - timedelta(days=6), last), (last - timedelta(days=2), last)
    path = scratch_path(spark, "snapshots")
    rows = summary.filter(in_days(week))
    wrong = F.when(in_days(late), F.lit(0.0)).otherwise(F.col("jy_nav"))
    store.commit_summary(rows.withColumn("jy_nav", wrong), path, week)
    store.commit_summary(summary.filter(in_days(late)), path, late)
    return store.committed_summary(spark, path, week, T.LongType())


def ingested_feed(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed's rows after one write that parts rows and rejected lines."""
    load, lines = FEEDS[name]
    return feeds.ingest(load(lines(tune(spark), sf_dir)), scratch_path(spark, "feed"))[0].rows


def ingested_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected lines per feed and reason, as the writes counted them."""
    counted = []
    for name, (load, lines) in FEEDS.items():
        feed = load(lines(tune(spark), sf_dir))
        _, found = feeds.ingest(feed, scratch_path(spark, "feed"))
        counted += [(name, reason, n) for reason, n in found.items() if reason is not None]
    return spark.createDataFrame(counted, "feed string, reject_reason string, lines long")


def stored_week_report(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly report of the latest seven days, written day by day and read from
    the stored summaries."""
    summary = table_summary(spark, sf_dir)
    week = latest_days(TB.quotes(spark, sf_dir).select("day"), 7)
    path = scratch_path(spark, "summary")
    store.write_summary(summary.filter(in_days(week)), path, week)
    stored = store.read_summary(spark, path, week, T.LongType())
    return with_double_metrics(report(name, store.complete_rows(stored), scope("week")))


def stored_mixed_vendors(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly report of the latest seven days of which the last three were stored
    without wind: only the days that hold every vendor take part."""
    summary = table_summary(spark, sf_dir)
    days = TB.quotes(spark, sf_dir).select("day")
    week, late = latest_days(days, 7), latest_days(days, 3)
    path = scratch_path(spark, "summary")
    store.write_summary(summary.filter(in_days(late)).drop("wind_nav"), path)
    store.write_summary(summary.filter(in_days(week) & ~in_days(late)), path)
    stored = store.read_summary(spark, path, week, T.LongType())
    return with_double_metrics(report(name, store.complete_rows(stored), scope("week")))


def text_report(name: str, scope_name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report from the weekly summary text: lines written to files and read as text."""
    path = scratch_path(spark, "lines")
    L.summary_lines(tune(spark), sf_dir).write.text(path)
    rows = load_feeds(spark, {"summary_text": path})["summary_text"].rows
    deviations = scratch_path(spark, "deviations")
    return with_double_metrics(report(name, rows, scope(scope_name), deviations))


def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as one CSV file with a header, and read back as text."""
    path = scratch_path(spark, "report")
    order = [COMMON_LABELS["fund_count"], COMMON_LABELS["type"]]
    store.write_csv(run_display("r5_rel_mean", "week", spark, sf_dir), path, order)
    return spark.read.option("header", True).csv(path)


def scored_report(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report out of the stored scores that all eleven share."""
    scores = Scores(table_summary(spark, sf_dir), scope("week"), scratch_path(spark, "scores"))
    return with_double_metrics(scores.report(name))


def preview_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty smallest groups of a report."""
    return store.preview(run_report("r2_abs_mean", "day", spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "summary_table": lambda spark, sf_dir: table_summary(spark, sf_dir).select(
            *summary_columns()
        ),
        "summary_join": joined_summary,
        "summary_nowind": partial(joined_summary, vendors=VENDORS_NO_WIND),
        "summary_top": summary_top,
        "summary_top_fanout": summary_top_fanout,
        "summary_latest_day": summary_latest,
        "summary_latest_week": summary_range,
        "dimension_join": dimension_join,
    }
    for name in FEEDS:
        found[f"feed_{name}"] = partial(feed_rows, name)
    found["feed_rejects"] = feed_rejects
    for scope_name in SCOPES:
        for name in REPORTS:
            found[f"{name}_{scope_name}"] = partial(run_report, name, scope_name)
    for name in ("r1_opposite", "r2_abs_mean", "r6_rel_median", "r8_abs_bands"):
        found[f"{name}_joined_week"] = partial(joined_report, name)
    for name in ("r1_opposite", "r5_rel_mean", "r9_abs_cumulative", "r10_rel_bands"):
        found[f"display_{name}_week"] = partial(run_display, name, "week")
    found["display_r8_abs_bands_day"] = partial(run_display, "r8_abs_bands", "day")
    found["store_summary_by_day"] = stored_summary
    found["committed_week"] = committed_week
    for name in ("truth", "ant", "summary_text"):
        found[f"ingested_{name}"] = partial(ingested_feed, name)
    found["ingested_rejects"] = ingested_rejects
    for name in ("r2_abs_mean", "r3_abs_median", "r11_rel_cumulative"):
        found[f"stored_week_{name}"] = partial(stored_week_report, name)
        found[f"scores_week_{name}"] = partial(scored_report, name)
    for name in ("r2_abs_mean", "r9_abs_cumulative"):
        found[f"stored_mixed_vendors_{name[:2]}"] = partial(stored_mixed_vendors, name)
    for scope_name in ("week", "all"):
        for name in REPORTS:
            label = f"text_{scope_name}_{name.split('_')[0]}"
            found[label] = partial(text_report, name, scope_name)
    for name in REPORTS:
        short = name.split("_")[0]
        found[f"coverage_{short}_week"] = partial(coverage_report, name, "week")
        found[f"groupings_{short}"] = partial(week_report, name, every_level())
        found[f"{states.state_kind(name)}_week_{short}"] = partial(week_report, name, scope("week"))
    for name in ("r2_abs_mean", "r3_abs_median", "r9_abs_cumulative"):
        short = name.split("_")[0]
        for scope_name in ("day", "all"):
            found[f"coverage_{short}_{scope_name}"] = partial(coverage_report, name, scope_name)
        found[f"coverage_full_{short}"] = partial(coverage_full, name)
    found["coverage_masks"] = coverage_masks
    for name in REPORTS:
        found[f"sql_{name.split('_')[0]}"] = partial(sql_report, name)
    found["sql_range"] = sql_range
    for name in ("r2_abs_mean", "r4_abs_std", "r5_rel_mean", "r10_rel_bands"):
        found[f"partials_all_{name.split('_')[0]}"] = partial(whole_report, name)
    for name in ("r3_abs_median", "r6_rel_median"):
        found[f"histograms_all_{name.split('_')[0]}"] = partial(whole_report, name)
    for kind in ("abs", "rel"):
        found[f"sketch_errors_{kind}"] = partial(sketch_errors, kind)
    found["csv_report_week"] = csv_report
    found["preview_smallest_groups"] = preview_report
    return found

