"""The driver tables read as fund data.

A line item is the quote of a fund (the part) on its ship day. Values have four decimals,
as funds publish them, and are computed in whole ten-thousandths, so both engines get the
same decimals. The vendors' estimates differ from the disclosed value by small fractions
that depend on discount and tax.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Band edges that suit the size of the absolute deviations in these tables.
TABLE_ABS_EDGES = tuple(Decimal(e) for e in ("1", "3", "5", "10", "20"))

# Whole ten-thousandths (values) and hundredths (returns), per line item.
_NAV = "(200 * cents + qty) div (2 * qty)"
_WHOLE_UNITS = {
    "report_nav": "nav",
    "ant_nav": "(nav * (12957 + 10 * tax)) div 13000",
    "tiantian_nav": "(nav * (17047 - 10 * disc)) div 17000",
    "jy_nav": "(nav * (2300 + tax - disc)) div 2300",
    "hm_nav": "(nav + 5000) div 10000 * 10000",
}
_HUNDREDTHS = {
    "report_return": "disc - 5",
    "ant_return": "tax - 4",
    "tiantian_return": "6 - disc",
    "jy_return": "tax - disc",
    "hm_return": "disc - tax",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(column: str, factor: int) -> Column:
    return F.floor(F.col(column) * F.lit(float(factor)) + F.lit(0.5))


def _scaled(column: Column, parts: int) -> Column:
    return column / F.lit(float(parts))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line item: fund code (the part key), day, all values and returns but wind's."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part_key"),
        F.col("l_shipdate").cast("date").alias("day"),
        _whole("l_extendedprice", 100).alias("cents"),
        _whole("l_quantity", 1).alias("qty"),
        _whole("l_discount", 100).alias("disc"),
        _whole("l_tax", 100).alias("tax"),
    )
    whole = raw.select("part_key", "day", "disc", "tax", F.expr(_NAV).alias("nav"))
    return whole.select(
        "part_key",
        "day",
        *[_scaled(F.expr(e), 10000).alias(n) for n, e in _WHOLE_UNITS.items()],
        *[_scaled(F.expr(e), 100).alias(n) for n, e in _HUNDREDTHS.items()],
    )


def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary, one row per line item; type and wind's value come from the part."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_key"),
        F.col("p_type").alias("type"),
        _scaled(_whole("p_retailprice", 10000), 10000).alias("wind_nav"),
    )
    return quotes(spark, sf_dir).join(parts, "part_key").withColumnRenamed("part_key", "fund_code")


def top_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of chosen funds: parts up to size five."""
    return (
        table(spark, sf_dir, "part")
        .filter(F.col("p_size") <= 5)
        .select(F.col("p_partkey").alias("fund_code"))
    )


def with_text_code(frame: DataFrame) -> DataFrame:
    return frame.withColumn("fund_code", F.col("part_key").cast("string")).drop("part_key")


def truth_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disclosed values with the jy and tiantian estimates, one row per line item."""
    return with_text_code(quotes(spark, sf_dir)).select(
        "fund_code",
        "day",
        "jy_nav",
        "jy_return",
        "report_nav",
        "report_return",
        "tiantian_nav",
        "tiantian_return",
    )


def estimate_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One quote per fund and day for hm, ant and wind. Ant publishes its return as text
    and has no quote for a fund whose line items of the day carry no tax."""
    per_day = with_text_code(quotes(spark, sf_dir)).groupBy("fund_code", "day")
    ant_return = F.max("ant_return")
    ratio = F.concat(
        F.when(ant_return > 0, "+").otherwise(""), F.round(ant_return, 2), F.lit("%")
    )
    return {
        "hm": per_day.agg(F.min("hm_nav").alias("hm_nav"), F.min("hm_return").alias("hm_return")),
        "ant": per_day.agg(
            F.max("ant_nav").alias("ant_nav"), ratio.alias("ant_ratio"), ant_return.alias("best")
        )
        .filter(F.col("best") > F.lit(-0.04))
        .drop("best"),
        "wind": per_day.agg(F.min("report_nav").alias("wind_nav")),
    }


def sparse_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The quotes of :func:`estimate_feeds` that remain when hm leaves out fund-days of low
    returns and wind every third fund."""
    feeds = estimate_feeds(spark, sf_dir)
    third = F.pmod(F.col("fund_code").cast("bigint"), F.lit(3)) == 0
    return feeds | {
        "hm": feeds["hm"].filter(F.col("hm_return") > F.lit(-0.02)),
        "wind": feeds["wind"].filter(~third),
    }


def fund_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("fund_code"),
        F.substring("p_type", 1, 3).alias("class_code"),
    )


def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.substring("p_type", 1, 3).alias("class_code"), F.col("p_type").alias("type"))
        .agg(F.count(F.lit(1)).alias("funds"))
        .select("class_code", "type")
    )
