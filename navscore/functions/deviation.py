"""Deviation of an estimate from the disclosed value, and exact rounding of metrics.

Deviations are counted in whole units of the eighth decimal, held in doubles. Funds
publish at most that many decimals, so the count is exact below 2 ** 53 units: a deviation
on a band edge is on it, and rounding half up is an operation on whole numbers. Digits
behind the eighth decimal are not part of the data and are rounded away; a disclosed value
below half a unit counts as zero. Ratios are summed with twelve decimals.

Sums do not depend on the order of rows: they are sums of longs, put together as decimals
once per group. No value becomes a decimal object by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navscore.schemas import METRIC

UNITS = 10**8

# Ratios are summed in whole parts of this size: twelve decimals.
RATIO_PARTS = 10**12

# Exact totals are whole numbers of up to 38 digits.
WIDE = "decimal(38,0)"


def units(value: Column) -> Column:
    """``abs(value)`` as a count of eighth decimals."""
    return F.rint(F.abs(value) * F.lit(float(UNITS)))


def abs_deviation(estimate: Column, actual: Column) -> Column:
    """``abs(estimate - actual)`` in units."""
    return units(estimate - actual)


def rel_deviation(deviation: Column, actual: Column) -> Column:
    """``deviation / abs(actual)``, both counted in units; null when actual is zero."""
    return F.try_divide(deviation, units(actual))


def opposite(a: Column, b: Column) -> Column:
    """True when one is positive and the other negative; a zero is never opposite."""
    return ((a > 0) & (b < 0)) | ((a < 0) & (b > 0))


def abs_thousandths(deviation: Column) -> Column:
    """Units to deviation x 1000 rounded half up to three decimals, in thousandths."""
    return F.floor((deviation + F.lit(50.0)) / F.lit(100.0))


def rel_thousandths(deviation: Column, actual: Column) -> Column:
    """Units to percent of ``actual`` rounded half up to three decimals, in thousandths."""
    return F.floor(F.try_divide(deviation * F.lit(1e5), units(actual)) + F.lit(0.5))


def thousandths_to_metric(count: Column) -> Column:
    """A count of thousandths back to a metric value."""
    return (count * F.lit(Decimal("0.001"))).cast(METRIC)


def exact_sum(count: Column) -> Column:
    """The sum of whole numbers held in doubles (or longs), exact in any order of rows.

    Two long sums, of the parts above and below 2 ** 24, are put together as a decimal; the
    upper one stays in range for 10 ** 12 rows of deviations up to 10 ** 6.
    """
    whole = count.cast("bigint")
    high, low = F.shiftright(whole, 24), whole.bitwiseAND(F.lit((1 << 24) - 1))
    return F.sum(high).cast(WIDE) * F.lit(1 << 24).cast(WIDE) + F.sum(low).cast(WIDE)


def exact_square_sum(count: Column) -> Column:
    """The sum of squares of whole numbers below 2 ** 47, exact in any order of rows.

    A number is ``a * 2 ** 16 + b``; ``a * a``, ``a * b`` and ``b * b`` are summed in two halves
    each. They stay in range for 2 ** 39 rows of numbers up to 2 ** 40, and for 2 ** 25 rows of
    the largest numbers.
    """
    whole = count.cast("bigint")
    a, b = F.shiftright(whole, 16), whole.bitwiseAND(F.lit((1 << 16) - 1))
    return (
        exact_sum(a * a) * F.lit(1 << 32).cast(WIDE)
        + exact_sum(a * b) * F.lit(1 << 17).cast(WIDE)
        + exact_sum(b * b)
    )


def ratio_parts(ratio: Column) -> Column:
    """A ratio as a whole number of parts of ``RATIO_PARTS``, its scale for sums.

    The whole part and the fraction are converted apart, so large ratios keep theirs.
    """
    whole = F.floor(ratio)
    parts = F.floor((ratio - whole) * F.lit(float(RATIO_PARTS)) + F.lit(0.5))
    return F.struct(whole.alias("whole"), parts.alias("parts"))


def exact_ratio_sum(ratio: Column) -> Column:
    """The sum of ratios in parts of ``RATIO_PARTS``, exact in any order of rows.

    Whole parts and fractions are each summed in two halves: in range for 2 ** 39 rows of ratios
    up to 2 ** 48.
    """
    split = ratio_parts(ratio)
    return (
        exact_sum(split["whole"]) * F.lit(RATIO_PARTS).cast(WIDE)
        + exact_sum(split["parts"])
    )


def with_std(frame: DataFrame, stds: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """``frame`` with population standard deviations of whole numbers, rounded half up.

    ``stds`` maps a new column to the columns that hold its count, total and sum of squares,
    which go. With ``q`` the mean without its fraction, ``r = total - q * count`` and the exact
    ``s = squares - 2 * q * total + q * q * count`` (the squares of what lies above ``q``) the
    deviation is ``sqrt(s / count - (r / count) ** 2)``. A double gives the nearest whole number
    up to one; which of the neighbours is right is decided by comparing
    ``4 * s - (2 * k + 1) ** 2 * count`` with ``4 * r ** 2 / count`` rounded up, as whole numbers.
    All of them fit 38 digits while ``squares`` stays below 2 * 10 ** 37.

    Each step is a projection over the one before, so a value that is used several times is
    computed once per group, and all of it stays in generated code.
    """
    kept = [c for c in frame.columns if c not in {p for parts in stds.values() for p in parts}]

    def wide(number: int) -> Column:
        return F.lit(number).cast(WIDE)

    def quotient(a: Column, b: Column) -> Column:
        return F.floor(F.try_divide(a - a % b, b)).cast(WIDE)

    def step(before: DataFrame, fields: Callable[..., dict[str, Column]], names: str) -> DataFrame:
        columns = []
        for out in stds:
            given = {name: F.col(f"{out}__{name}") for name in names.split()}
            columns += [value.alias(f"{out}__{name}") for name, value in fields(**given).items()]
        return before.select(*kept, *columns)

    def shift(n, total, squares):
        q = quotient(total, n)
        return {"n": n, "total": total, "squares": squares, "q": q}

    def centre(n, total, squares, q):
        return {"n": n, "r": total - q * n, "s": squares - wide(2) * q * total + q * q * n}

    def estimate(n, r, s):
        share = r.cast("double") / n.cast("double")
        variance = F.greatest(s.cast("double") / n.cast("double") - share * share, F.lit(0.0))
        k = F.floor(F.sqrt(variance) + F.lit(0.5)).cast("bigint")
        return {"n": n, "s": s * wide(4), "limit": quotient(wide(4) * r * r + n - wide(1), n), "k": k}

    def decide(n, s, limit, k):
        above, below = (F.lit(2) * k + 1).cast(WIDE), (F.lit(2) * k - 1).cast(WIDE)
        decided = (
            F.when(s - above * above * n >= limit, k + 1)
            .when((k > 0) & (s - below * below * n < limit), k - 1)
            .otherwise(k)
        )
        return {"std": decided}

    first = []
    for out, (count, total, squares) in stds.items():
        n = F.when(F.col(count) > 0, F.col(count)).cast(WIDE)
        parts = {"n": n, "total": F.col(total).cast(WIDE), "squares": F.col(squares).cast(WIDE)}
        first += [value.alias(f"{out}__{name}") for name, value in parts.items()]
    frame = frame.select(*kept, *first)
    frame = step(frame, shift, "n total squares")
    frame = step(frame, centre, "n total squares q")
    frame = step(frame, estimate, "n r s")
    frame = step(frame, decide, "n s limit k")
    return frame.select(*kept, *[F.col(f"{out}__std").alias(out) for out in stds])


def std_metric(thousandths: Column) -> Column:
    """A standard deviation in whole thousandths as a metric."""
    return thousandths_to_metric(thousandths)


def edge_value(edge: Decimal, relative: bool) -> Column:
    """A band edge on the scale of the deviation it is compared with."""
    return F.lit(float(edge if relative else edge * UNITS))


def _half_up(numerator: Column, denominator: Column) -> Column:
    """Quotient of whole numbers, not negative, rounded half up; null when dividing by zero."""
    two = F.lit(2).cast(WIDE)
    halves = F.struct((numerator * two + denominator).alias("a"), (denominator * two).alias("b"))
    quotient = F.transform(F.array(halves), lambda h: F.floor(F.try_divide(h["a"] - h["a"] % h["b"], h["b"])))
    return F.when(denominator > 0, F.get(quotient, F.lit(0)).cast("bigint"))


def abs_mean(total_units: Column, count: Column) -> Column:
    """Mean deviation x 1000, rounded half up to three decimals; null without rows."""
    return thousandths_to_metric(_half_up(total_units, count.cast(WIDE) * F.lit(100).cast(WIDE)))


def rel_mean(total_parts: Column, count: Column) -> Column:
    """Mean ratio in percent, rounded half up to three decimals; null without rows."""
    parts = F.lit(RATIO_PARTS // 10**5).cast(WIDE)
    return thousandths_to_metric(_half_up(total_parts, count.cast(WIDE) * parts))


def share_percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` rounded half up to three decimals, by exact division."""
    return F.try_divide(part.cast("decimal(20,0)") * F.lit(100), whole).cast(METRIC)
