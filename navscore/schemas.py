"""Vendors, column types and the column order of the fund-by-day summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Values and returns are doubles; deviations become whole units (see
# ``functions.deviation``), so edges, sums and medians are exact all the same.
VALUE = T.DoubleType()
METRIC = T.DecimalType(16, 3)


@dataclass(frozen=True)
class Vendor:
    """An estimate publisher: its code, display label, and whether it publishes returns."""

    code: str
    label: str
    has_return: bool = True

    @property
    def nav(self) -> str:
        return f"{self.code}_nav"

    @property
    def ret(self) -> str:
        return f"{self.code}_return"


# Vendor codes, display labels and their order in the reports.
VENDORS = {
    v.code: v
    for v in (
        Vendor("ant", "蚂蚁"),
        Vendor("tiantian", "天天"),
        Vendor("jy", "聚源"),
        Vendor("wind", "万得", has_return=False),
        Vendor("hm", "好买"),
    )
}

ALL_VENDORS = tuple(VENDORS)
VENDORS_NO_WIND = tuple(code for code in VENDORS if code != "wind")

# Grouping keys of the daily, weekly and overall reports.
GROUPINGS = {"day": ("type", "day"), "week": ("type",), "all": ()}


def summary_columns(vendors=ALL_VENDORS) -> list[str]:
    """Columns of the summary, in the order of the weekly text file."""
    columns = ["fund_code", "type", "day", "report_nav", "report_return"]
    for code in ("ant", "hm", "jy", "tiantian", "wind"):
        if code in vendors:
            vendor = VENDORS[code]
            columns += [vendor.nav] + ([vendor.ret] if vendor.has_return else [])
    return columns
