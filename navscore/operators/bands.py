"""Deviation bands: the share of rows per band, one output row per vendor and group.

The bands are read off the cumulative counts of :func:`navscore.operators.measures.measures`.
Disjoint bands are half open ``(low, high]``, so they add up to 100 percent; cumulative
bands count everything up to each edge.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navscore.functions.deviation import share_percent
from navscore.schemas import ALL_VENDORS


def _plain(edge: Decimal) -> str:
    return format(edge.normalize(), "f")


def band_columns(edges, cumulative: bool) -> list[str]:
    """Column names made from the edges: ``le_0p001``, ``gt_0p001_le_0p003``, ``gt_0p02``."""
    texts = [_plain(e).replace(".", "p") for e in edges]
    if cumulative:
        inner = [f"le_{t}" for t in texts]
    else:
        inner = [f"le_{texts[0]}"] + [f"gt_{a}_le_{b}" for a, b in zip(texts, texts[1:])]
    return inner + [f"gt_{texts[-1]}"]


def band_labels(edges, cumulative: bool, percent: bool) -> list[str]:
    """Display labels made from the edges: ``<=0.05%``, ``(0.05%,0.1%]``, ``>1%``."""
    texts = [_plain(e * 100) + "%" if percent else _plain(e) for e in edges]
    if cumulative:
        inner = [f"<={t}" for t in texts]
    else:
        inner = [f"<={texts[0]}"] + [f"({a},{b}]" for a, b in zip(texts, texts[1:])]
    return inner + [f">{texts[-1]}"]


def band_shares(
    measured: DataFrame,
    keys,
    edges,
    kind: str,
    cumulative: bool,
    vendors=ALL_VENDORS,
    coverage: str = "common",
) -> DataFrame:
    """``keys``, ``vendor`` and one percent column per band; ``kind`` is ``abs`` or ``rel``.

    Only the aggregated rows are multiplied by the number of vendors. With ``coverage="any"``
    a share is one of the rows that hold the vendor, whose number stands in ``rows``.
    """
    names = band_columns(edges, cumulative)
    stacked = []
    for code in vendors:
        up_to = [F.col(f"{code}_{kind}_le_{i}") for i in range(len(edges))]
        counts = up_to
        if not cumulative:
            counts = [up_to[0]] + [high - low for low, high in zip(up_to, up_to[1:])]
        counts = counts + [F.col(f"{code}_{kind}_gt")]
        whole = F.col(f"{code}_rows" if coverage == "any" else "fund_count")
        stacked += [F.lit(code), whole, *counts]
    per_vendor = measured.select(
        *keys, F.stack(F.lit(len(vendors)), *stacked).alias("vendor", "rows", *names)
    )
    shares = [share_percent(F.col(name), F.col("rows")).alias(name) for name in names]
    held = ["rows"] if coverage == "any" else []
    return per_vendor.select(*keys, "vendor", *held, *shares)
