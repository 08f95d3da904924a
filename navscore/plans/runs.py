"""The daily, list and weekly runs: feeds to stored summary, stored summary to reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from navscore.operators.summary import build_summary, classify, in_days, restrict_to_list
from navscore.plans import states
from navscore.plans.reports import COMMON_LABELS, REPORTS, Scope, Scores, display
from navscore.schemas import ALL_VENDORS, GROUPINGS
from navscore.sources import feeds, store

LOADERS = {
    "truth": feeds.load_truth,
    "hm": feeds.load_hm,
    "ant": feeds.load_ant,
    "wind": feeds.load_wind,
    "fund_classes": feeds.load_fund_classes,
    "class_names": feeds.load_class_names,
    "top_list": feeds.load_top_list,
    "summary_text": feeds.load_summary_text,
}


def load_feeds(
    spark: SparkSession,
    paths: Mapping[str, str],
    hm_layout: str = "tab",
    encodings: Mapping[str, str] | None = None,
) -> dict[str, feeds.Feed]:
    """Load every feed that has a path; see ``LOADERS`` for the names. ``encodings`` names
    the feeds that are not UTF-8."""
    found = {}
    for name, path in paths.items():
        options = {"layout": hm_layout} if name == "hm" else {}
        encoding = (encodings or {}).get(name, "utf-8")
        found[name] = LOADERS[name](feeds.read_lines(spark, path, encoding), **options)
    return found


def ingest_feeds(
    spark: SparkSession, loaded: Mapping[str, feeds.Feed], work_path: str
) -> dict[str, feeds.Feed]:
    """Write every feed once and read it back from there. Its rejected lines with their reasons
    go to ``rejects``, and the number of rows and of rejected lines by reason (a null reason
    for rows) to ``rejects/lines_by_reason``, both in the work folder."""
    root = work_path.rstrip("/")
    found, counted = {}, []
    for name, feed in loaded.items():
        found[name], lines = feeds.ingest(feed, f"{root}/feeds/{name}")
        counted += [(name, reason, n) for reason, n in lines.items()]
        found[name].rejected.write.mode("overwrite").parquet(f"{root}/rejects/{name}")
    counts = spark.createDataFrame(counted, "feed string, reject_reason string, lines long")
    counts.write.mode("overwrite").parquet(f"{root}/rejects/lines_by_reason")
    return found


def daily_summary(
    loaded: Mapping[str, feeds.Feed], days, vendors=ALL_VENDORS, coverage: str = "common"
) -> DataFrame:
    """The summary of ``days``, restricted to the top list when that feed was loaded."""
    truth = loaded["truth"].rows
    if "top_list" in loaded:
        # before the vendor joins, so that a short list shrinks what they shuffle
        truth = restrict_to_list(truth, loaded["top_list"].rows)
    return build_summary(
        truth,
        {code: loaded[code].rows for code in ("hm", "ant", "wind") if code in loaded},
        classify(loaded["fund_classes"].rows, loaded["class_names"].rows),
        vendors,
        days,
        coverage,
    )


def write_reports(summary: DataFrame, scope: Scope, work_path: str, csv_path: str) -> Scores:
    """Score the summary and write all eleven reports, as people read them, as CSV."""
    scores = Scores(summary, scope, work_path)
    for name in REPORTS:
        _write_report(name, scores.report(name), scope, csv_path)
    return scores


def _write_report(name: str, frame: DataFrame, scope: Scope, csv_path: str) -> None:
    order = [COMMON_LABELS[c] for c in ("fund_count", *scope.keys, "vendor") if c in frame.columns]
    store.write_csv(display(name, frame, scope), f"{csv_path.rstrip('/')}/{name}", order)


def daily_run(
    spark: SparkSession,
    paths: Mapping[str, str],
    days,
    store_path: str,
    work_path: str,
    csv_path: str,
    vendors=ALL_VENDORS,
    hm_layout: str = "tab",
    encodings: Mapping[str, str] | None = None,
    coverage: str = "common",
    states_path: str | None = None,
    atomic: bool = False,
) -> Scores:
    """Load the feeds, store the summary of ``days``, and report by type and day.

    Rejected lines and counts go to ``rejects`` in the work folder. With ``coverage="any"``
    fund-days that some vendors lack are stored and scored on the vendors they have. With a
    ``states_path`` the states of the days are stored there for :func:`states_range_run`. An
    ``atomic`` store is changed by one commit, which a run that breaks down does not reach.
    """
    loaded = ingest_feeds(spark, load_feeds(spark, paths, hm_layout, encodings), work_path)
    summary = daily_summary(loaded, days, vendors, coverage)
    if atomic:
        store.commit_summary(summary, store_path, days)
        stored = store.committed_summary(spark, store_path, days)
    else:
        store.write_summary(summary, store_path, days)
        stored = store.read_summary(spark, store_path, days)
    if coverage == "common":
        stored = store.complete_rows(stored, vendors)
    scope = Scope(GROUPINGS["day"], tuple(vendors), coverage=coverage)
    if states_path is not None:
        states.write_states(stored, states_path, scope, days)
    return write_reports(stored, scope, work_path, csv_path)


def range_run(
    spark: SparkSession,
    store_path: str,
    days,
    work_path: str,
    csv_path: str,
    grouping: str = "week",
    vendors=ALL_VENDORS,
    coverage: str = "common",
    atomic: bool = False,
) -> Scores:
    """Report a range of stored days by type (``week``) or as a whole (``all``).

    Only rows that hold every chosen vendor take part; the days that lack one are written to
    ``incomplete_days`` in the work folder. With ``coverage="any"`` all stored rows take part,
    each vendor on the rows it has.
    """
    read = store.committed_summary if atomic else store.read_summary
    stored = read(spark, store_path, days)
    left_out = store.incomplete_days(stored, vendors)
    left_out.write.mode("overwrite").parquet(f"{work_path.rstrip('/')}/incomplete_days")
    return write_reports(
        store.complete_rows(stored, vendors) if coverage == "common" else stored,
        Scope(GROUPINGS[grouping], tuple(vendors), coverage=coverage),
        work_path,
        csv_path,
    )


def states_range_run(
    spark: SparkSession,
    states_path: str,
    days,
    csv_path: str,
    grouping: str = "week",
    vendors=ALL_VENDORS,
    coverage: str = "common",
    sketched: bool = False,
) -> dict[str, DataFrame]:
    """The reports of :func:`range_run` from the stored states of the days alone; medians are
    exact, or of a stated rank error when ``sketched``."""
    scope = Scope(GROUPINGS[grouping], tuple(vendors), coverage=coverage)
    found = {
        name: states.state_report(spark, name, states_path, scope, days, sketched)
        for name in REPORTS
    }
    for name, frame in found.items():
        _write_report(name, frame, scope, csv_path)
    return found


def text_range_run(
    spark: SparkSession,
    path: str,
    work_path: str,
    csv_path: str,
    days=None,
    grouping: str = "week",
    vendors=ALL_VENDORS,
    encoding: str = "utf-8",
) -> Scores:
    """The reports of :func:`range_run` from the weekly summary text instead of the store."""
    loaded = load_feeds(spark, {"summary_text": path}, encodings={"summary_text": encoding})
    loaded = ingest_feeds(spark, loaded, work_path)
    rows = loaded["summary_text"].rows
    rows = rows if days is None else rows.filter(in_days(days))
    return write_reports(rows, Scope(GROUPINGS[grouping], tuple(vendors)), work_path, csv_path)
