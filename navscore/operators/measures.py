"""The sums and counts behind the reports, for all vendors in one aggregation.

One scan, no self-join, no union, and partial aggregation before the only shuffle: a hot
type or day costs its own rows on the map side and a handful of partial rows afterwards.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navscore.functions import deviation as D
from navscore.operators.deviations import by_vendor, long_deviations, wide_deviations
from navscore.schemas import ALL_VENDORS, VENDORS

# Band edges of the absolute and the relative deviation.
ABS_EDGES = tuple(Decimal(e) for e in ("0.001", "0.003", "0.005", "0.01", "0.02"))
REL_EDGES = tuple(Decimal(e) for e in ("0.0005", "0.001", "0.003", "0.005", "0.01"))

PARTS = ("opposite", "abs_sum", "abs_std", "abs_bands", "rel_sum", "rel_std", "rel_bands")


def _aggregates(part: str, edges, prefix: str = "") -> list:
    """The aggregates of one part over the deviation columns with ``prefix``."""
    if part == "opposite":
        return [F.count_if(f"{prefix}opposite_row").alias(f"{prefix}opposite")]
    kind, what = part.split("_")
    name = f"{prefix}{kind}"
    if what == "sum":
        total = D.exact_sum if kind == "abs" else D.exact_ratio_sum
        return [total(F.col(name)).alias(f"{name}_sum")]
    if what == "std":
        rounded = F.col(f"{name}_rounded")
        return [
            F.count(rounded).alias(f"{name}_count"),
            D.exact_sum(rounded).alias(f"{name}_total"),
            D.exact_square_sum(rounded).alias(f"{name}_squares"),
        ]
    limits = [D.edge_value(edge, relative=kind == "rel") for edge in edges[kind]]
    value = F.col(name)
    return [
        *[F.count_if(value <= x).alias(f"{name}_le_{i}") for i, x in enumerate(limits)],
        F.count_if(value > limits[-1]).alias(f"{name}_gt"),
    ]


def std_columns(names) -> dict[str, tuple[str, str, str]]:
    """The standard deviations that can be made of columns ``names``; see ``with_std``."""
    found = {}
    for name in names:
        if name.endswith("_squares"):
            stem = name.removesuffix("_squares")
            found[f"{stem}_std"] = (f"{stem}_count", f"{stem}_total", name)
    return found


def measures(
    summary: DataFrame,
    keys,
    vendors=ALL_VENDORS,
    abs_edges=ABS_EDGES,
    rel_edges=REL_EDGES,
    parts=PARTS,
    coverage: str = "common",
) -> DataFrame:
    """One row per group: ``fund_count`` and, per vendor ``v``, the measures of ``parts``.

    ``v_opposite`` counts rows; ``v_abs_sum`` in units and ``v_rel_sum`` in parts of a ratio;
    ``v_abs_std`` and ``v_rel_std`` in whole thousandths; ``v_abs_le_i`` and
    ``v_rel_le_i`` count rows up to edge ``i``, ``v_abs_gt`` and ``v_rel_gt`` the rest. With
    ``coverage="any"``, ``v_rows`` counts the rows that hold the vendor.
    """
    edges = {"abs": abs_edges, "rel": rel_edges}
    aggregates = [F.count(F.lit(1)).alias("fund_count")]
    for code in vendors:
        if coverage == "any":
            aggregates.append(F.count(f"{code}_abs").alias(f"{code}_rows"))
        for part in parts:
            if part != "opposite" or VENDORS[code].has_return:
                aggregates += _aggregates(part, edges, f"{code}_")
    measured = wide_deviations(summary, keys, vendors).groupBy(*keys).agg(*aggregates)
    stds = std_columns(measured.columns)
    return D.with_std(measured, stds) if stds else measured


def partial_measures(summary: DataFrame, keys, vendors=ALL_VENDORS, edges=None) -> DataFrame:
    """One row per group and vendor: ``fund_count``, ``rows`` that hold the vendor, and sums,
    squares and counts that add up over groups."""
    edges = edges or {"abs": ABS_EDGES, "rel": REL_EDGES}
    aggregates = [F.count(F.lit(1)).alias("fund_count"), F.count("abs").alias("rows")]
    for part in PARTS:
        aggregates += _aggregates(part, edges)
    return long_deviations(summary, keys, vendors).groupBy(*keys, "vendor").agg(*aggregates)


def finished(partial: DataFrame, keys, vendors=ALL_VENDORS, coverage: str = "common") -> DataFrame:
    """The rows of :func:`partial_measures` in the form of :func:`measures`."""
    partial = D.with_std(partial, std_columns(partial.columns))
    names = [c for c in partial.columns if c not in (*keys, "vendor", "fund_count")]
    wide = by_vendor(partial, keys, [c for c in names if c != "rows" or coverage == "any"], vendors)
    return wide.drop(*[f"{c}_opposite" for c in vendors if not VENDORS[c].has_return])


def all_measures(
    summary: DataFrame,
    keys,
    vendors=ALL_VENDORS,
    abs_edges=ABS_EDGES,
    rel_edges=REL_EDGES,
    coverage: str = "common",
) -> DataFrame:
    """The result of :func:`measures` with all parts, computed in long form."""
    edges = {"abs": abs_edges, "rel": rel_edges}
    return finished(partial_measures(summary, keys, vendors, edges), keys, vendors, coverage)
