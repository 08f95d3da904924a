"""Fund-days that vendors lack, and the states of days that ranges are reported from."""

import math
import random
from datetime import date
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from navscore.operators.summary import build_summary, coverage_counts, presence
from navscore.plans import runs, states
from navscore.plans.reports import REPORTS, Scope, Scores, report
from navscore.schemas import ALL_VENDORS, VENDORS, summary_columns
from navscore.sources import store
from tests.test_runs import FIRST, SECOND, paths  # noqa: F401

DAYS = [date(2021, 3, d) for d in (15, 16, 17)]
ANY = Scope(("type",), coverage="any")


def summary_rows(seed=1, rows=400, gaps=True):
    rng = random.Random(seed)
    found = []
    for i in range(rows):
        row = [f"{i % 90:06d}", rng.choice(["stock", "bond", None]), rng.choice(DAYS)]
        row += [rng.choice([0.0, 1.0, 1.25, 2.5]), rng.choice([-1.0, 0.0, 0.5])]
        for code in ("ant", "hm", "jy", "tiantian", "wind"):
            lacks = gaps and (rng.random() < 0.3 or code == "wind" and row[1] == "bond")
            row.append(None if lacks else round(row[3] + rng.randint(-30, 30) / 1000, 4))
            if VENDORS[code].has_return:
                row.append(None if lacks else rng.choice([-0.2, 0.0, 0.3]))
        found.append(tuple(row))
    return found


SCHEMA = ", ".join(
    f"{c} {'string' if c in ('fund_code', 'type') else 'date' if c == 'day' else 'double'}"
    for c in summary_columns()
)


@pytest.fixture(scope="module")
def gappy(spark):
    return spark.createDataFrame(summary_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def full(spark):
    return spark.createDataFrame(summary_rows(2, gaps=False), SCHEMA).cache()


def plain(frame):
    """Rows as tuples, in an order that holds with nulls."""
    names = sorted(frame.columns)
    rows = [tuple(r[n] for n in names) for r in frame.collect()]
    return names, sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def half_up(value: Fraction, places=3):
    return Decimal(math.floor(value * 10**places + Fraction(1, 2))).scaleb(-places)


# -- coverage


def test_vendors_are_joined_from_the_left(spark):
    day, other = DAYS[:2]
    truth = spark.createDataFrame(
        [("a", day, 1.0, 0.1), ("b", day, 2.0, 0.1), ("a", other, 1.5, 0.2), ("c", day, 3.0, 0.0)],
        "fund_code string, day date, report_nav double, report_return double",
    ).selectExpr("*", "1.0D as jy_nav", "0.0D as jy_return", "if(fund_code = 'b', null, 1.0D) as tiantian_nav",
                 "0.0D as tiantian_return")
    feeds = {
        "hm": spark.createDataFrame([("a", day, 1.0, 0.0)], "fund_code string, day date, hm_nav double, hm_return double"),
        "ant": spark.createDataFrame([("b", day, 1.0, "+1%")], "fund_code string, day date, ant_nav double, ant_ratio string"),
        "wind": spark.createDataFrame([("a", other, 1.0), ("z", day, 1.0)], "fund_code string, day date, wind_nav double"),
    }
    types = spark.createDataFrame([("a", "stock"), ("b", "bond")], "fund_code string, type string")
    found = build_summary(truth, feeds, types, coverage="any")
    assert found.columns == summary_columns()
    held = {
        (r.fund_code, r.day): {c for i, c in enumerate(ALL_VENDORS) if r.bits >> i & 1}
        for r in found.select("*", presence().alias("bits")).collect()
    }
    assert held == {
        ("a", day): {"jy", "tiantian", "hm"}, ("b", day): {"jy", "ant"}, ("a", other): {"jy", "tiantian", "wind"},
    }
    assert build_summary(truth, feeds, types).count() == 0
    with pytest.raises(ValueError):
        build_summary(truth, feeds, types, coverage="some")
    masks = coverage_counts(found, ("type",)).collect()
    assert sum(r.fund_days for r in masks) == 3 and len(masks) == 3


def test_each_vendor_is_scored_on_its_own_rows(gappy):
    rows = [r for r in summary_rows() if r[1] == "stock"]
    at = {c: i for i, c in enumerate(summary_columns())}
    means = {r["type"]: r for r in report("r2_abs_mean", gappy, ANY).collect()}
    medians = {r["type"]: r for r in report("r3_abs_median", gappy, ANY).collect()}
    opposite = {r["type"]: r for r in report("r1_opposite", gappy, ANY).collect()}
    shares = {(r["type"], r["vendor"]): r for r in report("r8_abs_bands", gappy, ANY).collect()}
    assert means["stock"].fund_count == len(rows)
    for code in ALL_VENDORS:
        own = [r for r in rows if r[at[f"{code}_nav"]] is not None]
        gaps = [abs(Fraction(str(r[at[f"{code}_nav"]])) - Fraction(str(r[at["report_nav"]]))) for r in own]
        assert means["stock"][f"{code}_rows"] == len(own)
        assert means["stock"][f"{code}_abs_mean"] == half_up(sum(gaps) * 1000 / len(own))
        ordered = sorted(half_up(g * 1000) for g in gaps)
        middle = Fraction(ordered[(len(own) - 1) // 2] + ordered[len(own) // 2]) / 2
        assert medians["stock"][f"{code}_abs_median"] == half_up(middle)
        if VENDORS[code].has_return:
            against = sum(1 for r in own if r[at[f"{code}_return"]] * r[at["report_return"]] < 0)
            assert opposite["stock"][f"{code}_opposite"] == against
            assert opposite["stock"][f"{code}_opposite_pct"] == half_up(Fraction(100 * against, len(own)))
        band = shares["stock", code]
        assert band.rows == len(own)
        assert band.le_0p001 == half_up(Fraction(100 * sum(g <= Fraction(1, 1000) for g in gaps), len(own)))


def test_a_vendor_without_rows_has_no_metric(gappy):
    row = {r["type"]: r for r in report("r2_abs_mean", gappy, ANY).collect()}["bond"]
    assert row.wind_rows == 0 and row.wind_abs_mean is None
    row = {r["type"]: r for r in report("r6_rel_median", gappy, ANY).collect()}["bond"]
    assert row.wind_rel_median is None
    bands = {(r["type"], r["vendor"]): r for r in report("r11_rel_cumulative", gappy, ANY).collect()}
    assert bands["bond", "wind"].rows == 0 and bands["bond", "wind"].gt_0p01 is None


@pytest.mark.parametrize("name", list(REPORTS))
def test_full_rows_give_the_figures_of_the_default(full, name):
    default = report(name, full, Scope(("type",)))
    found = report(name, full, ANY)
    assert plain(found.select(*default.columns)) == plain(default)


def test_scores_and_single_reports_agree(gappy, tmp_path):
    scores = Scores(gappy, ANY, str(tmp_path))
    for name in REPORTS:
        assert plain(scores.report(name)) == plain(report(name, gappy, ANY)), name


# -- states


def reference(summary, name, scope, days=None):
    return report(name, summary if days is None else summary.where(F.col("day").isin(days)), scope)


@pytest.mark.parametrize("coverage", ["common", "any"])
def test_a_range_of_states_equals_its_summary(spark, gappy, full, tmp_path, coverage):
    summary = gappy if coverage == "any" else full
    day = Scope(coverage=coverage)
    for one in DAYS:  # day by day, the last one twice
        states.write_states(summary.where(F.col("day") == one), str(tmp_path), day, one)
    states.write_states(summary.where(F.col("day") == DAYS[-1]), str(tmp_path), day, DAYS[-1])
    for keys, days in ((("type",), DAYS[:2]), ((), None), (("type", "day"), (DAYS[1], DAYS[2]))):
        scope = Scope(keys, coverage=coverage)
        within = days if not isinstance(days, tuple) else list(days)
        for name in ("r1_opposite", "r2_abs_mean", "r3_abs_median", "r4_abs_std", "r5_rel_mean",
                     "r6_rel_median", "r7_rel_std", "r8_abs_bands", "r11_rel_cumulative"):
            found = states.state_report(spark, name, str(tmp_path), scope, days)
            assert plain(found) == plain(reference(summary, name, scope, within)), (name, keys)


def test_all_levels_in_one_pass(spark, gappy, tmp_path):
    scope = Scope(states.ALL_LEVELS, coverage="any")
    states.write_states(gappy, str(tmp_path), scope)
    for name in ("r2_abs_mean", "r3_abs_median", "r4_abs_std", "r9_abs_cumulative"):
        found = states.state_report(spark, name, str(tmp_path), scope)
        for level, keys in states.LEVELS.items():
            own = found.where(F.col("level") == level)
            assert own.where(" or ".join(["false", *[f"{k} is not null" for k in ("type", "day") if k not in keys]])).count() == 0
            want = report(name, gappy, Scope(keys, coverage="any"))
            assert plain(own.select(*want.columns)) == plain(want), (name, level)


def test_a_range_reads_states_only(spark, gappy, tmp_path):
    states.write_states(gappy, str(tmp_path), ANY)
    for name, kind in (("r4_abs_std", "partials"), ("r6_rel_median", "histograms")):
        frame = states.state_report(spark, name, str(tmp_path), ANY, DAYS[:2])
        files = {f.split("/day=")[0].rsplit("/", 1)[-1] for f in frame.inputFiles()}
        assert files == {kind} and len(frame.inputFiles()) >= 2
        physical = frame._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [day" in physical  # other days are not read
    every = Scope(states.ALL_LEVELS, coverage="any")
    plan = states.state_report(spark, "r2_abs_mean", str(tmp_path), every)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1 and plan.count("Expand") == 1


def test_other_states_are_refused(spark, gappy, tmp_path):
    states.write_states(gappy, str(tmp_path), ANY)
    other_edges = Scope(("type",), abs_edges=(Decimal(1), Decimal(2)), coverage="any")
    for scope in (other_edges, Scope(("type",)), Scope(("type",), ("jy", "hm"), coverage="any")):
        with pytest.raises(Exception, match="state of another kind"):
            states.state_report(spark, "r2_abs_mean", str(tmp_path), scope).collect()
    newer = states.read_states(spark, str(tmp_path), "partials").withColumn("version", F.lit(2))
    with pytest.raises(Exception, match="state of another kind"):
        states.report_of("r2_abs_mean", newer, ANY).collect()


def test_sketches_keep_their_rank_error(spark):
    rng = random.Random(8)
    rows = []
    for day in DAYS:
        for i in range(9000):
            nav = 1.0 + (rng.randint(0, 3) if rng.random() < 0.4 else rng.randint(0, 10**6)) / 1000
            rows.append((f"{i:06d}", "stock", day, 1.0, 0.0, *[x for c in ("ant", "hm", "jy", "tiantian") for x in (nav, 0.0)], nav))
    summary = spark.createDataFrame(rows, SCHEMA)
    sketches = states.day_sketches(summary, ANY)
    assert max(len(r.sketch) for r in sketches.select("sketch").collect()) < 100_000
    row = states.sketched_medians(sketches, ANY).first()
    values = sorted(round((r[5] - 1) * 10**6) for r in rows)  # thousandths of the deviation x 1000
    found = int(row.jy_abs_median * 1000)
    below = sum(v < found for v in values) / len(values)
    up_to = sum(v <= found for v in values) / len(values)
    assert below <= 0.5 + states.RANK_ERROR and up_to >= 0.5 - states.RANK_ERROR
    assert row.fund_count == len(rows)


def test_empty_states(spark, gappy, tmp_path):
    none = gappy.limit(0)
    for name in ("r2_abs_mean", "r3_abs_median"):
        made = states.STATES[states.state_kind(name)](none, ANY)
        assert states.report_of(name, made, ANY).collect() == []


def test_runs_from_states(spark, paths, tmp_path):  # noqa: F811
    at = {n: str(tmp_path / n) for n in ("store", "states", "w1", "c1", "w2", "c2", "w3", "c3", "c4")}
    everyone = {k: v for k, v in paths.items() if k != "top_list"}
    for i, day in ((1, FIRST), (2, SECOND)):
        runs.daily_run(spark, everyone, day, at["store"], at[f"w{i}"], at[f"c{i}"], states_path=at["states"])
    runs.range_run(spark, at["store"], (FIRST, SECOND), at["w3"], at["c3"])
    found = runs.states_range_run(spark, at["states"], (FIRST, SECOND), at["c4"])
    for name in REPORTS:
        a, b = (spark.read.option("header", True).csv(f"{at[c]}/{name}") for c in ("c3", "c4"))
        assert plain(a) == plain(b), name
    assert set(found) == set(REPORTS)


def test_daily_run_with_gaps(spark, paths, tmp_path):  # noqa: F811
    with open(paths["wind"], "w") as feed:
        feed.write("000001\t1.03\t2021/03/18\n")
    at = [str(tmp_path / n) for n in ("store", "work", "csv", "work2", "csv2")]
    everyone = {k: v for k, v in paths.items() if k != "top_list"}
    runs.daily_run(spark, everyone, [FIRST, SECOND], *at[:3], coverage="any")
    assert store.read_summary(spark, at[0]).count() == 4
    scores = runs.range_run(spark, at[0], (FIRST, SECOND), at[3], at[4], coverage="any")
    row = {r["type"]: r for r in scores.report("r2_abs_mean").collect()}["股票型"]
    assert (row.fund_count, row.wind_rows, row.jy_rows) == (2, 1, 2)


# -- what the states of large tables cost


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kinds", [("abs", "rel"), ("rel",)])
def test_histograms_count_every_row_of_each_vendor(gappy, kinds):
    """One group with a null type, vendors without a value, and one kind alone."""
    expected = {}
    for row in gappy.collect():
        actual = row.report_nav
        for code in ALL_VENDORS:
            given = row[f"{code}_nav"]
            units = None if given is None else round(abs(Fraction(str(given)) - Fraction(str(actual))) * 10**8)
            share = Fraction(units * 10**5, round(actual * 10**8)) if units is not None and actual else None
            values = {
                "abs": None if units is None else (units + 50) // 100,
                "rel": None if share is None else math.floor(share + Fraction(1, 2)),
            }
            for kind in kinds:
                value = states.MISSING if values[kind] is None else values[kind]
                key = (row.type, row.day, code, kind, value)
                expected[key] = expected.get(key, 0) + 1
    found = states.day_histograms(gappy, ANY, kinds)
    assert {tuple(r)[:5]: r.rows for r in found.collect()} == expected


def test_histograms_are_grouped_by_numbers_alone(gappy):
    """The text of vendor and kind is neither hashed nor shuffled, nor made for each row."""
    medians = optimized(states.merged_medians(states.day_histograms(gappy, ANY), ANY))
    grouped = [line for line in medians.splitlines() if "Aggregate [type" in line and "day" in line]
    assert grouped and not any("vendor" in line or "kind" in line for line in grouped)
    assert "posexplode" in medians and "stack(" not in medians  # no object for each value
    filters = [line for line in medians.splitlines() if "Filter" in line]
    assert not any("concat_ws" in line for line in filters)


def test_sketches_read_each_row_of_the_summary_once(gappy):
    """Vendors and kinds are unfolded behind the aggregation, not in front of it."""
    plan = optimized(states.day_sketches(gappy, ANY))
    assert 0 <= plan.index("Generate") < plan.index("Aggregate")
    found = states.day_sketches(gappy, ANY, ("abs",))
    rows = {(r.type, r.day, r.vendor, r.kind): (r.fund_count, r.rows) for r in found.collect()}
    expected = {}
    for row in gappy.collect():
        for code in ALL_VENDORS:
            count, held = expected.get((row.type, row.day, code, "abs"), (0, 0))
            held += row[f"{code}_nav"] is not None
            expected[row.type, row.day, code, "abs"] = count + 1, held
    assert rows == expected
