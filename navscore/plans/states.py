"""Stored states per day that a range of days is reported from without its summary.

Three states, each one row or a few per type, day and vendor:

* *partials*: exact sums, squares and counts, which add up over days;
* *histograms*: how often each rounded deviation occurs, which add up to exact medians;
* *sketches*: a KLL sketch of the rounded deviations, merged to medians whose rank is off by
  ``RANK_ERROR`` of the rows at most (twice what is stated for ``SKETCH_ITEMS`` items with 99
  percent confidence), for ranges whose histograms are too large. A sketch is some ten KB
  whatever it has seen.

A state carries the version of its meaning and its basis: the band edges, and the vendors and
coverage of the summary it was made from. Reading one that differs raises instead of mixing
them. With the keys ``ALL_LEVELS`` the merged rows by type and day, by type, and as a whole
come from one pass, by grouping sets over the states.

Defined cases: a type that is null is a group of its own; a day without rows has no states; a
vendor that a row lacks counts in ``fund_count`` but not in its ``rows``, sums or values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from navscore.functions.deviation import thousandths_to_metric
from navscore.operators.deviations import wide_deviations
from navscore.operators.measures import finished, partial_measures
from navscore.operators.median import MISSING, bucket, counted_medians, stacked_counts
from navscore.operators.summary import in_days
from navscore.plans.reports import KINDS, REPORTS, Scope
from navscore.schemas import VENDORS
from navscore.sources import store

VERSION = 1
KEYS = ("type", "day")
SKETCH_ITEMS = 1000
RANK_ERROR = 0.01

# The levels that one pass reports, by name, and the keys that ask for all of them.
LEVELS = {"day": ("type", "day"), "week": ("type",), "all": ()}
ALL_LEVELS = ("level", "type", "day")


def basis(scope: Scope) -> str:
    """What a state depends on besides its rows."""
    edges = [",".join(str(edge) for edge in edges) for edges in (scope.abs_edges, scope.rel_edges)]
    return ";".join([*edges, ",".join(scope.vendors), scope.coverage])


def _marked(states: DataFrame, scope: Scope) -> DataFrame:
    return states.withColumns({"version": F.lit(VERSION), "basis": F.lit(basis(scope))})


def checked(states: DataFrame, scope: Scope) -> DataFrame:
    """The states without their marks; a row of another version or basis raises."""
    fits = (F.col("version") == VERSION) & (F.col("basis") == basis(scope))
    wrong = F.concat(F.lit("state of another kind: version "), "version", F.lit(", basis "), "basis")
    kept = F.when(F.coalesce(fits, F.lit(False)), True).otherwise(F.raise_error(wrong).cast("boolean"))
    return states.where(kept).drop("version", "basis")


# --- states of a day --------------------------------------------------------------------


def day_partials(summary: DataFrame, scope: Scope) -> DataFrame:
    """One row per type, day and vendor; see ``partial_measures``."""
    edges = {"abs": scope.abs_edges, "rel": scope.rel_edges}
    return _marked(partial_measures(summary, KEYS, scope.vendors, edges), scope)


def _rounded(summary: DataFrame, vendors, kinds) -> DataFrame:
    """One row per row of the summary, with the rounded deviations side by side: what is sorted
    or shuffled is a row of the summary, not one for each vendor and kind."""
    navs = {VENDORS[code].nav: F.col(VENDORS[code].nav).cast("double") for code in vendors}
    only = [f"{kind}_rounded" for kind in kinds]
    return wide_deviations(summary.withColumns(navs), KEYS, vendors, only)


def _measures(vendors, kinds) -> list[tuple[str, str]]:
    """Vendor and kind of each column of :func:`_rounded`."""
    return [(code, kind) for code in vendors for kind in kinds]


def day_histograms(summary: DataFrame, scope: Scope, kinds=KINDS) -> DataFrame:
    """``rows`` per type, day, vendor, kind and value; a missing value is ``MISSING``."""
    measures = _measures(scope.vendors, kinds)
    values = [F.col(f"{code}_{kind}_rounded") for code, kind in measures]
    counted = stacked_counts(_rounded(summary, scope.vendors, kinds), KEYS, values)
    # Text is looked up behind the aggregation, whose rows hold the number of the measure.
    code, kind = [
        F.element_at(F.array(*[F.lit(name) for name in names]), F.col("measure") + 1)
        for names in zip(*measures)
    ]
    named = counted.select(*KEYS, code.alias("vendor"), kind.alias("kind"), "value", "rows")
    return _marked(named, scope)


def day_sketches(summary: DataFrame, scope: Scope, kinds=KINDS) -> DataFrame:
    """A sketch of the values per type, day, vendor and kind, with the ``rows`` in it."""
    measures = _measures(scope.vendors, kinds)
    aggregates, quoted = [], []
    for code, kind in measures:
        value, rows, sketch = (f"{code}_{kind}_{name}" for name in ("rounded", "rows", "sketch"))
        aggregates += [
            F.count(value).alias(rows),
            F.kll_sketch_agg_bigint(value, SKETCH_ITEMS).alias(sketch),
        ]
        quoted += [F.lit(code), F.lit(kind), F.col(rows), F.col(sketch)]
    fund_count = F.count(F.lit(1)).alias("fund_count")
    grouped = _rounded(summary, scope.vendors, kinds).groupBy(*KEYS).agg(fund_count, *aggregates)
    sketched = grouped.select(
        *KEYS,
        "fund_count",
        F.stack(F.lit(len(measures)), *quoted).alias("vendor", "kind", "rows", "sketch"),
    )
    return _marked(sketched.select(*KEYS, "vendor", "kind", "fund_count", "rows", "sketch"), scope)


STATES = {"partials": day_partials, "histograms": day_histograms, "sketches": day_sketches}


def write_states(summary: DataFrame, path: str, scope: Scope, days=None, kinds=tuple(STATES)) -> None:
    """Store the states of a summary in a folder each, partitioned by day; ``days`` as in
    ``store.write_summary``. Only the days that are written or covered are replaced."""
    for kind in kinds:
        store.write_days(
            STATES[kind](summary, scope), f"{path.rstrip('/')}/{kind}", days, ("type", "vendor")
        )


def read_states(spark: SparkSession, path: str, kind: str, days=None) -> DataFrame:
    """The stored states of a kind; ``days`` prunes the day folders."""
    states = spark.read.parquet(f"{path.rstrip('/')}/{kind}")
    return states if days is None else states.filter(in_days(days))


# --- states of many days ----------------------------------------------------------------


def _merged(states: DataFrame, keys, more, aggregates: dict[str, Column]) -> DataFrame:
    """Group by ``keys`` and ``more``. Keys that start with ``level`` give all of ``LEVELS`` at
    once, where a key outside a row's level is null."""
    named = [value.alias(name) for name, value in aggregates.items()]
    if tuple(keys[:1]) != ("level",):
        return states.groupBy(*keys, *more).agg(*named)
    sets = [[F.col(c) for c in (*level, *more)] for level in LEVELS.values()]
    grouped = states.groupingSets(sets, *[F.col(c) for c in (*keys[1:], *more)])
    level = F.when(F.grouping("day") == 0, "day").when(F.grouping("type") == 0, "week")
    merged = grouped.agg(level.otherwise("all").alias("level"), *named)
    return merged.select(*keys, *more, *aggregates)


def merged_measures(partials: DataFrame, scope: Scope) -> DataFrame:
    """The measures of all days of ``partials``."""
    states = checked(partials, scope)
    names = [c for c in states.columns if c not in (*KEYS, "vendor")]
    sums = {c: F.sum(c).cast(states.schema[c].dataType) for c in names}
    merged = _merged(states, scope.keys, ["vendor"], sums)
    return finished(merged, scope.keys, scope.vendors, scope.coverage)


def _names(scope: Scope, kinds) -> list[str]:
    return [f"{code}_{kind}_median" for code in scope.vendors for kind in kinds]


def merged_medians(histograms: DataFrame, scope: Scope, kinds=KINDS) -> DataFrame:
    """The exact medians of all days of ``histograms``."""
    measure = F.array_position(
        F.array(*[F.lit(name) for name in _names(scope, kinds)]),
        F.concat_ws("_", "vendor", "kind", F.lit("median")),
    )
    wanted = F.col("kind").isin(list(kinds)) & F.col("vendor").isin(list(scope.vendors))
    rows = checked(histograms, scope).where(wanted).withColumn("measure", measure.cast("int") - 1)
    merged = _merged(rows, scope.keys, ["measure", "value"], {"rows": F.sum("rows")})
    held = F.when(F.col("value") != MISSING, F.col("value"))
    counted = merged.select(*scope.keys, "measure", bucket(held).alias("bucket"), "value", "rows")
    return counted_medians(counted, scope.keys, _names(scope, kinds))


def sketched_medians(sketches: DataFrame, scope: Scope, kinds=KINDS) -> DataFrame:
    """``keys``, ``fund_count`` and medians from the sketches of all days, whose rank is off by
    ``RANK_ERROR`` at most; the lower of two middle values, not their mean."""
    merged = _merged(
        checked(sketches, scope).where(F.col("kind").isin(list(kinds))),
        scope.keys,
        ["vendor", "kind"],
        {
            "fund_count": F.sum("fund_count"),
            "rows": F.sum("rows"),
            "sketch": F.kll_merge_agg_bigint("sketch", SKETCH_ITEMS),
        },
    )
    middle = F.when(F.col("rows") > 0, F.kll_sketch_get_quantile_bigint("sketch", F.lit(0.5)))
    medians = merged.withColumn("median", thousandths_to_metric(middle))
    picked = [
        F.max(
            F.when((F.col("vendor") == code) & (F.col("kind") == kind), F.col("median"))
        ).alias(f"{code}_{kind}_median")
        for code in scope.vendors
        for kind in kinds
    ]
    return medians.groupBy(*scope.keys).agg(F.max("fund_count").alias("fund_count"), *picked)


def state_kind(name: str, sketched: bool = False) -> str:
    """The kind of state that a report is made from."""
    if REPORTS[name].part != "medians":
        return "partials"
    return "sketches" if sketched else "histograms"


def report_of(name: str, states: DataFrame, scope: Scope, sketched: bool = False) -> DataFrame:
    """A report from states of its kind."""
    spec = REPORTS[name]
    if spec.part != "medians":
        return spec.build(merged_measures(states, scope), scope)
    medians = sketched_medians if sketched else merged_medians
    return spec.build(medians(states, scope, (spec.kind,)), scope)


def state_report(
    spark: SparkSession, name: str, path: str, scope: Scope, days=None, sketched: bool = False
) -> DataFrame:
    """A report of the stored states of ``days``; nothing but its kind of state is read."""
    states = read_states(spark, path, state_kind(name, sketched), days)
    return report_of(name, states, scope, sketched)
