"""The eleven reports, each for any grouping, vendor set and fund scope.

``R1`` opposite direction; ``R2``-``R4`` mean, median and deviation of the absolute
deviation (x 1000); ``R5``-``R7`` the same of the relative deviation (percent);
``R8``-``R11`` shares of the absolute and relative deviation in disjoint and cumulative
bands. A report is a projection of one of two aggregations, the sums and counts or the
medians, so many reports can share one pass over the data: see :class:`Scores`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navscore.functions import deviation as D
from navscore.functions.parsing import percent_text
from navscore.operators.bands import band_columns, band_labels, band_shares
from navscore.operators.deviations import wide_deviations
from navscore.operators.measures import ABS_EDGES, PARTS, REL_EDGES, all_measures, measures
from navscore.operators.median import grouped_medians
from navscore.schemas import ALL_VENDORS, VENDORS

KINDS = ("abs", "rel")


@dataclass(frozen=True)
class Scope:
    """What a report covers: grouping keys, vendors, band edges, and whether rows that lack a
    vendor take part (``coverage="any"``): each vendor is then scored on the rows it has."""

    keys: tuple[str, ...] = ("type", "day")
    vendors: tuple[str, ...] = ALL_VENDORS
    abs_edges: tuple = field(default=ABS_EDGES)
    rel_edges: tuple = field(default=REL_EDGES)
    coverage: str = "common"

    def measures(self, summary: DataFrame, parts=PARTS) -> DataFrame:
        return measures(
            summary, self.keys, self.vendors, self.abs_edges, self.rel_edges, parts, self.coverage
        )

    def all_measures(self, summary: DataFrame) -> DataFrame:
        return all_measures(
            summary, self.keys, self.vendors, self.abs_edges, self.rel_edges, self.coverage
        )

    def rows(self, code: str) -> Column:
        """What a vendor's mean or share is taken over: all rows, or those that hold it."""
        return F.col(f"{code}_rows" if self.coverage == "any" else "fund_count")

    def medians(self, summary: DataFrame, kinds=KINDS, path: str | None = None) -> DataFrame:
        """With keys the rows are read twice. ``path`` is for a summary that is dear to make: its
        rounded deviations are stored there, so that its joins run once."""
        rounded = [f"{kind}_rounded" for kind in kinds]
        deviations = wide_deviations(summary, self.keys, self.vendors, only=rounded)
        if path is not None and self.keys:
            deviations = _stored(deviations, path)
        values = {
            f"{code}_{kind}_median": F.col(f"{code}_{kind}_rounded")
            for code in self.vendors
            for kind in kinds
        }
        return grouped_medians(deviations, self.keys, values)


def _stored(frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _wide(source: DataFrame, scope: Scope, columns) -> DataFrame:
    """Keys, group size and ``columns`` per vendor; smallest groups first, keys break ties."""
    held = [f"{code}_rows" for code in scope.vendors if f"{code}_rows" in source.columns]
    per_vendor = [column for code in scope.vendors for column in columns(code)]
    report = source.select(*scope.keys, "fund_count", *held, *per_vendor)
    return report.orderBy("fund_count", *scope.keys)


def _opposite(measured: DataFrame, scope: Scope) -> DataFrame:
    def columns(code):
        if not VENDORS[code].has_return:
            return []
        rows = F.col(f"{code}_opposite")
        return [rows, D.share_percent(rows, scope.rows(code)).alias(f"{code}_opposite_pct")]

    return _wide(measured, scope, columns)


def _mean(kind: str, mean):
    def build(measured: DataFrame, scope: Scope) -> DataFrame:
        def columns(code):
            value = mean(F.col(f"{code}_{kind}_sum"), scope.rows(code))
            return [value.alias(f"{code}_{kind}_mean")]

        return _wide(measured, scope, columns)

    return build


def _metric(kind: str, what: str, metric):
    def build(source: DataFrame, scope: Scope) -> DataFrame:
        def columns(code):
            name = f"{code}_{kind}_{what}"
            return [metric(F.col(name)).alias(name)]

        return _wide(source, scope, columns)

    return build


def _std(kind: str):
    return _metric(kind, "std", D.std_metric)


def _median(kind: str):
    return _metric(kind, "median", lambda value: value)


def _bands(kind: str, cumulative: bool):
    def build(measured: DataFrame, scope: Scope) -> DataFrame:
        edges = scope.abs_edges if kind == "abs" else scope.rel_edges
        return band_shares(
            measured, scope.keys, edges, kind, cumulative, scope.vendors, scope.coverage
        )

    return build


@dataclass(frozen=True)
class Report:
    """A report: what it reads (a part of the measures, or the medians), how it projects
    it, and its display wording."""

    name: str
    part: str
    build: object
    kind: str = ""
    # Wording of the metric columns behind the vendor label.
    suffixes: tuple[tuple[str, str], ...] = ()
    percent: bool = False
    cumulative: bool | None = None


# The report names and the wording of their columns.
REPORTS = {
    r.name: r
    for r in (
        Report(
            "r1_opposite",
            "opposite",
            _opposite,
            suffixes=(("opposite", "相反个数"), ("opposite_pct", "相反估计占比")),
        ),
        Report(
            "r2_abs_mean",
            "abs_sum",
            _mean("abs", D.abs_mean),
            "abs",
            (("abs_mean", "估值绝对偏差均值"),),
        ),
        Report(
            "r3_abs_median",
            "medians",
            _median("abs"),
            "abs",
            (("abs_median", "估值绝对偏差中值"),),
        ),
        Report(
            "r4_abs_std",
            "abs_std",
            _std("abs"),
            "abs",
            (("abs_std", "估值绝对偏差标准差"),),
        ),
        Report(
            "r5_rel_mean",
            "rel_sum",
            _mean("rel", D.rel_mean),
            "rel",
            (("rel_mean", "估值相对偏差均值"),),
            percent=True,
        ),
        Report(
            "r6_rel_median",
            "medians",
            _median("rel"),
            "rel",
            (("rel_median", "估值相对偏差中值"),),
            percent=True,
        ),
        Report(
            "r7_rel_std",
            "rel_std",
            _std("rel"),
            "rel",
            (("rel_std", "估值相对偏差标准差"),),
            percent=True,
        ),
        Report("r8_abs_bands", "abs_bands", _bands("abs", False), "abs", cumulative=False),
        Report("r9_abs_cumulative", "abs_bands", _bands("abs", True), "abs", cumulative=True),
        Report("r10_rel_bands", "rel_bands", _bands("rel", False), "rel", cumulative=False),
        Report("r11_rel_cumulative", "rel_bands", _bands("rel", True), "rel", cumulative=True),
    )
}

# Wording of the columns that every report shares.
COMMON_LABELS = {"day": "日期", "type": "基金类型", "fund_count": "基金数量", "vendor": "基金名称"}


def report(name: str, summary: DataFrame, scope: Scope, path: str | None = None) -> DataFrame:
    """One report straight from the summary; only what it needs is computed. ``path`` as in
    :meth:`Scope.medians`."""
    spec = REPORTS[name]
    if spec.part == "medians":
        return spec.build(scope.medians(summary, (spec.kind,), path), scope)
    return spec.build(scope.measures(summary, parts=(spec.part,)), scope)


class Scores:
    """Both aggregations of a scope, stored, and every report as a projection of them.

    All eleven reports then cost one pass over the summary for the sums and one for the
    medians, and a lost executor costs no more than the step it was lost in.
    """

    def __init__(self, summary: DataFrame, scope: Scope, path: str):
        self.scope = scope
        folder = path.rstrip("/")
        self.measured = _stored(scope.all_measures(summary), f"{folder}/measures")
        self.middles = _stored(scope.medians(summary), f"{folder}/medians")

    def report(self, name: str) -> DataFrame:
        spec = REPORTS[name]
        return spec.build(self.middles if spec.part == "medians" else self.measured, self.scope)

    def all(self) -> dict[str, DataFrame]:
        return {name: self.report(name) for name in REPORTS}


def display(name: str, frame: DataFrame, scope: Scope) -> DataFrame:
    """The report as people read it: worded columns, vendor labels and percent signs."""
    spec = REPORTS[name]
    columns = [F.col(k).alias(COMMON_LABELS[k]) for k in scope.keys]
    if spec.cumulative is not None:
        relative = spec.kind == "rel"
        edges = scope.rel_edges if relative else scope.abs_edges
        vendor_label = F.coalesce(
            *[F.when(F.col("vendor") == c, F.lit(VENDORS[c].label)) for c in scope.vendors]
        )
        columns.append(vendor_label.alias(COMMON_LABELS["vendor"]))
        for source, label in zip(
            band_columns(edges, spec.cumulative), band_labels(edges, spec.cumulative, relative)
        ):
            columns.append(percent_text(F.col(source)).alias(label))
        return frame.select(*columns)
    columns.append(F.col("fund_count").alias(COMMON_LABELS["fund_count"]))
    for code in scope.vendors:
        for suffix, wording in spec.suffixes:
            source = f"{code}_{suffix}"
            if source in frame.columns:
                value = F.col(source)
                if spec.percent or suffix.endswith("_pct"):
                    value = percent_text(value)
                columns.append(value.alias(VENDORS[code].label + wording))
    return frame.select(*columns)
