"""Joins, measures, medians, bands and reports on small frames checked by hand."""

import math
import random
from datetime import date
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from navscore.functions import deviation as D
from navscore.operators import median as M
from navscore.operators.bands import band_columns, band_labels
from navscore.operators.measures import ABS_EDGES, REL_EDGES, all_measures, measures
from navscore.operators.summary import build_summary, classify, restrict_to_list
from navscore.plans import runs
from navscore.plans.reports import REPORTS, Scope, Scores, display, report
from navscore.schemas import ALL_VENDORS, VENDORS_NO_WIND, summary_columns
from navscore.sources import store
from tests import naive

DAY, NEXT = date(2021, 3, 18), date(2021, 3, 19)


def row(code, kind="A", day=DAY, nav=1.0, ret=0.5, ant=1.001, ant_ret=0.1, others=1.0, wind=1.0):
    return (code, kind, day, nav, ret, ant, ant_ret, others, ret, others, -ret, others, 0.0, wind)


def summary_of(spark, rows):
    types = ["string", "string", "date"] + ["double"] * 11
    schema = ", ".join(f"{n} {t}" for n, t in zip(summary_columns(), types))
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def sample(spark):
    rows = []
    for i in range(60):
        nav = 1 + (i * 37 % 50) / 100
        rows.append(
            (
                f"{i:06d}",
                "AB"[i % 2] if i % 7 else "C",
                DAY if i % 3 else NEXT,
                nav,
                (i % 5 - 2) / 10,
                round(nav + (i % 9 - 4) / 1000, 4),
                (i % 3 - 1) / 10,
                round(nav + i / 3000, 4),
                (i % 4 - 2) / 10,
                round(nav - i / 5000, 4),
                (i % 5 - 1) / 10,
                round(nav * 1.003, 4),
                (2 - i % 5) / 10,
                round(nav * (1 + i / 9000), 4),
            )
        )
    return summary_of(spark, rows)


def only(frame):
    (found,) = frame.collect()
    return found


def test_band_edges_are_counted_once(spark):
    deviations = [0.0, 0.001, 0.0011, 0.003, 0.005, 0.01, 0.02, 0.0201]
    rows = [row(str(i), ant=round(1.0995 + d, 4), nav=1.0995) for i, d in enumerate(deviations)]
    scope = Scope(keys=())
    shares = report("r8_abs_bands", summary_of(spark, rows), scope)
    found = only(shares.filter("vendor = 'ant'"))
    assert list(found[1:]) == [Dec("25.000"), Dec("25.000")] + [Dec("12.500")] * 4
    assert sum(found[1:]) == 100
    running = only(
        report("r9_abs_cumulative", summary_of(spark, rows), scope).filter("vendor = 'ant'")
    )
    assert [float(v) for v in running[1:]] == [25.0, 50.0, 62.5, 75.0, 87.5, 12.5]


def test_relative_band_edges(spark):
    rows = [row("a", nav=2.0, ant=2.001), row("b", nav=2.0, ant=2.0012), row("c", nav=0.0)]
    shares = only(
        report("r10_rel_bands", summary_of(spark, rows), Scope(keys=())).filter("vendor = 'ant'")
    )
    # A fund without a value falls in no band and stays in the denominator.
    assert [float(v) for v in shares[1:]] == [33.333, 33.333, 0, 0, 0, 0]


def test_zero_value_gives_null_ratio_and_keeps_its_place(spark):
    rows = [row("a", nav=0.0), row("b", nav=2.0, ant=2.02)]
    summary = summary_of(spark, rows)
    assert only(report("r5_rel_mean", summary, Scope(keys=()))).ant_rel_mean == Dec("0.500")
    assert only(report("r6_rel_median", summary, Scope(keys=()))).ant_rel_median == Dec("1.000")
    alone = summary.filter("fund_code = 'a'")
    assert only(report("r6_rel_median", alone, Scope(keys=()))).ant_rel_median is None


def test_opposite_direction(spark):
    pairs = [(0.5, -0.1), (-0.5, 0.1), (0.0, 0.1), (0.5, 0.0), (0.5, 0.1)]
    rows = [row(str(i), ret=a, ant_ret=b) for i, (a, b) in enumerate(pairs)]
    found = only(report("r1_opposite", summary_of(spark, rows), Scope(keys=())))
    assert (found.ant_opposite, found.ant_opposite_pct) == (2, Dec("40.000"))
    assert "wind_opposite" not in found.asDict()


def test_medians_by_hand(spark):
    rows = [("one", 7), ("two", 4), ("two", 9), ("three", 1), ("three", 3), ("three", 100)]
    rows += [("none", None), ("some", None), ("some", 5), (None, 2), (None, 2), ("zero", 0)]
    frame = spark.createDataFrame(rows, "k string, v bigint")
    medians = M.grouped_medians(frame, ["k"], {"m": F.col("v")})
    assert {r.k: (r.fund_count, r.m) for r in medians.collect()} == {
        "one": (1, Dec("0.007")),
        "two": (2, Dec("0.007")),
        "three": (3, Dec("0.003")),
        "none": (1, None),
        "some": (2, Dec("0.005")),
        None: (2, Dec("0.002")),
        "zero": (1, Dec("0.000")),
    }
    assert only(M.grouped_medians(frame.limit(0), [], {"m": F.col("v")})).fund_count == 0


@pytest.mark.parametrize("keys", [[], ["k"], ["id"]])
def test_medians_of_one_large_and_of_many_groups(spark, keys):
    frame = spark.range(60_000).select(
        "id",
        (F.col("id") % 3 % 2).alias("k"),  # one group holds two thirds of the rows
        F.when(F.col("id") % 3 == 0, F.lit(11)).otherwise(F.xxhash64("id") % 1000).alias("a"),
        F.pow(F.lit(10.0), F.col("id") % 15).cast("bigint").alias("b"),
    )
    frame = frame.withColumn("a", F.abs("a"))
    found = M.grouped_medians(frame, keys, {"a": F.col("a"), "b": F.col("b")})
    half_up = {n: F.floor(F.median(n) + 0.5) / 1000 for n in ("a", "b")}
    plain = frame.groupBy(*keys).agg(F.count("*"), *half_up.values())
    want = sorted(tuple(r) for r in plain.collect())
    assert sorted((*r[:-2], float(r[-2]), float(r[-1])) for r in found.collect()) == want


@pytest.mark.parametrize("bound", [8 * 1024 * 1024, 0])
def test_medians_of_small_and_large_groups_together(spark, monkeypatch, bound):
    monkeypatch.setattr(M, "BROADCAST_BYTES", bound)
    frame = spark.range(4_000).select(
        F.when(F.col("id") < 3_000, F.lit(None)).otherwise(F.col("id") % 40).alias("k"),
        F.when(F.col("id") % 7 > 0, F.xxhash64("id") % 50 + 50).alias("v"),
        F.when(F.col("id") % 40 == 1, F.lit(None)).otherwise(F.col("id") % 9).alias("w"),
    )
    values = {"v": F.col("v"), "w": F.col("w")}
    mixed, collected, counted = (
        sorted(M.grouped_medians(frame, ["k"], values, size).collect(), key=lambda r: r.k or -1)
        for size in (100, 4_000, 0)
    )
    assert mixed == collected == counted and len(mixed) == 41
    assert mixed[0].k is None and mixed[0].fund_count == 3_000
    assert next(r for r in mixed if r.k == 1).w is None


def test_medians_of_small_groups_shuffle_rows_once(spark, sample):
    plan = report("r3_abs_median", sample, Scope())._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("hashpartitioning") == 1


def test_medians_read_the_summary_once(spark, sample, tmp_path):
    path = str(tmp_path / "once")
    sample.write.parquet(path)
    frame = report("r3_abs_median", spark.read.parquet(path), Scope(keys=()))
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_medians_of_a_dear_summary_make_it_once(spark, sample, tmp_path):
    """The counting of groups and the medians both read the stored deviations."""
    joined = sample.join(sample.select("type").distinct(), "type")
    scope, path = Scope(("type",)), str(tmp_path / "deviations")
    for name in ("r3_abs_median", "r6_rel_median"):
        found = report(name, joined, scope, path)
        assert found.inputFiles() and all("/deviations/" in file for file in found.inputFiles())
        assert found.collect() == report(name, joined, scope).collect()


def exact_std(values):
    """Population deviation of whole numbers, rounded half up, in whole numbers."""
    n, total = len(values), sum(values)
    v = n * sum(x * x for x in values) - total * total
    k = math.isqrt(v) // n
    while (2 * k + 1) ** 2 * n * n <= 4 * v:
        k += 1
    return k


def std_parts(x):
    return {"n": F.count(x), "t": D.exact_sum(x), "q": D.exact_square_sum(x)}


def test_sums_and_deviations_against_whole_numbers(spark):
    rng = random.Random(4)
    groups = {
        g: [rng.choice((rng.randint(0, 9), rng.randint(0, 10**8))) for _ in range(rng.randint(1, 9))]
        for g in range(3000)
    }
    groups[-1] = [39325148253, 0, 0, 1]
    frame = spark.createDataFrame(
        [(g, float(x)) for g, values in groups.items() for x in values], "g int, x double"
    )
    x = F.col("x")
    found = frame.groupBy("g").agg(
        D.exact_sum(x).alias("total"),
        D.exact_square_sum(x).alias("squares"),
        *[value.alias(name) for name, value in std_parts(x).items()],
    )
    found = D.with_std(found, {"std": tuple(std_parts(x))})
    for r in found.collect():
        values = groups[r.g]
        assert (int(r.total), int(r.squares)) == (sum(values), sum(v * v for v in values))
        assert r["std"] == exact_std(values)


def test_sums_beyond_the_range_of_one_long(spark):
    rows = 12_000_000  # fractions of almost 10 ** 12 parts fill a long after 9.2 million
    ratio = F.when(F.col("id") < 3, F.lit(2.0**62)).otherwise(F.lit(0.9375))
    found = spark.range(rows).select(D.exact_ratio_sum(ratio).alias("total")).collect()[0]
    assert int(found.total) == 3 * 2**62 * 10**12 + (rows - 3) * 937_500_000_000


def test_deviation_of_large_values(spark):
    values = [(i * 7919 % 100003) * 10**9 + i for i in range(200_000)]
    assert len(values) ** 2 * max(values) ** 2 > 10**38
    x = F.pmod(F.col("id") * 7919, F.lit(100003)) * F.lit(10**9) + F.col("id")
    found = spark.range(len(values)).select(x.cast("double").alias("x")).agg(
        D.exact_square_sum(F.col("x")).alias("squares"),
        *[value.alias(name) for name, value in std_parts(F.col("x")).items()],
    )
    found = D.with_std(found, {"std": tuple(std_parts(F.col("x")))}).collect()[0]
    assert int(found.squares) == sum(v * v for v in values)
    assert found["std"] == exact_std(values)


@pytest.mark.parametrize("keys", [(), ("type",), ("type", "day")])
def test_wide_and_long_measures_agree(sample, keys):
    wide, long = measures(sample, keys), all_measures(sample, keys)
    assert sorted(wide.columns) == sorted(long.columns)
    rows = {tuple(r[k] for k in keys): r.asDict() for r in wide.collect()}
    for found in long.collect():
        expected = rows.pop(tuple(found[k] for k in keys))
        assert found.asDict() == pytest.approx(expected)
    assert not rows


def half_up(numerator, denominator):
    return (2 * numerator + denominator) // (2 * denominator)


def exact_metrics(rows, code):
    """R2 to R7 of one group and vendor in whole numbers, as thousandths."""
    dev = [round(abs(r[f"{code}_nav"] - r["report_nav"]) * 1e8) for r in rows]
    actual = [round(abs(r["report_nav"]) * 1e8) for r in rows]
    parts = [math.floor(d / a) * 10**12 + math.floor((d / a % 1) * 1e12 + 0.5) for d, a in zip(dev, actual)]
    absolute = sorted((d + 50) // 100 for d in dev)
    relative = sorted(math.floor(d * 1e5 / a + 0.5) for d, a in zip(dev, actual))
    n = len(rows)

    def median(values):
        return (values[(n - 1) // 2] + values[n // 2] + 1) // 2

    return {
        "r2_abs_mean": half_up(sum(dev), n * 100),
        "r3_abs_median": median(absolute),
        "r4_abs_std": exact_std(absolute),
        "r5_rel_mean": half_up(sum(parts), n * 10**7),
        "r6_rel_median": median(relative),
        "r7_rel_std": exact_std(relative),
    }


@pytest.mark.parametrize("vendors", [ALL_VENDORS, VENDORS_NO_WIND])
@pytest.mark.parametrize("keys", [(), ("type",), ("type", "day")])
def test_reports_are_exact(spark, sample, tmp_path, keys, vendors):
    # Edges between the values, where the closed and half-open forms agree.
    edges = tuple(Dec(e) for e in ("0.00105", "0.00305", "0.00505", "0.01005", "0.02005"))
    scope = Scope(keys, vendors, edges, edges)
    plain = naive.reports(sample, keys, list(vendors), edges, edges, band_columns)
    groups = {}
    for r in sample.collect():
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    metrics = {g: {v: exact_metrics(rows, v) for v in vendors} for g, rows in groups.items()}
    scores = Scores(sample, scope, str(tmp_path))
    for name in REPORTS:
        if name in metrics[next(iter(groups))][vendors[0]]:
            want = sorted(
                (*g, len(rows), *[Dec(metrics[g][v][name]).scaleb(-3) for v in vendors])
                for g, rows in groups.items()
            )
        else:
            want = sorted(tuple(r) for r in plain[name].collect())
        for frame in (report(name, sample, scope), scores.report(name)):
            rows = frame.select(*plain[name].columns) if name[:2] in ("r1", "r8", "r9") else frame
            assert sorted(tuple(r) for r in rows.collect()) == want, name


def test_cumulative_bands_are_prefix_sums(sample):
    scope = Scope(keys=("type",))
    for disjoint, cumulative in (
        ("r8_abs_bands", "r9_abs_cumulative"),
        ("r10_rel_bands", "r11_rel_cumulative"),
    ):
        running = {(r.type, r.vendor): r for r in report(cumulative, sample, scope).collect()}
        for r in report(disjoint, sample, scope).collect():
            shares, sums = list(r[2:]), list(running[r.type, r.vendor][2:])
            assert abs(sum(shares) - 100) <= Dec("0.003")
            for i in range(5):
                assert abs(sum(shares[: i + 1]) - sums[i]) <= Dec("0.003")
            assert sums[:5] == sorted(sums[:5]) and abs(sums[4] + sums[5] - 100) <= Dec("0.001")


def test_week_of_one_day_equals_the_day(sample):
    one_day = sample.filter(F.col("day") == F.lit(DAY))
    for name in REPORTS:
        weekly = report(name, one_day, Scope(keys=("type",)))
        daily = report(name, one_day, Scope(keys=("type", "day"))).drop("day")
        assert sorted(map(tuple, weekly.collect())) == sorted(map(tuple, daily.collect()))


def test_order_of_rows_does_not_matter(sample):
    shuffled = sample.repartition(13, F.rand(3))
    for name in REPORTS:
        scope = Scope(keys=("type",))
        a, b = (sorted(map(tuple, report(name, s, scope).collect())) for s in (sample, shuffled))
        assert a == b


def test_smallest_groups_come_first(sample):
    counts = [r.fund_count for r in report("r2_abs_mean", sample, Scope()).collect()]
    assert counts == sorted(counts)


def feed_frames(spark):
    truth = spark.createDataFrame(
        [("a", DAY, 1.0), ("a", NEXT, 1.1), ("b", DAY, 2.0), ("c", DAY, 3.0)],
        "fund_code string, day date, report_nav double",
    )
    for name in ("jy_nav", "jy_return", "report_return", "tiantian_nav", "tiantian_return"):
        truth = truth.withColumn(name, F.col("report_nav"))
    keys = truth.select("fund_code", "day")
    estimates = {
        "hm": keys.select("*", F.lit(1.0).alias("hm_nav"), F.lit(0.1).alias("hm_return")),
        "ant": keys.filter("fund_code <> 'b'").select(
            "*", F.lit(1.0).alias("ant_nav"), F.lit('"+1.5%"').alias("ant_ratio")
        ),
        "wind": keys.filter(F.col("day") == F.lit(DAY)).withColumn("wind_nav", F.lit(1.0)),
    }
    classes = spark.createDataFrame(
        [("a", "1"), ("b", "1"), ("c", "9")], "fund_code string, class_code string"
    )
    names = spark.createDataFrame([("1", "stock")], "class_code string, type string")
    return truth, estimates, classify(classes, names)


def test_summary_needs_every_vendor_and_a_type(spark):
    truth, estimates, types = feed_frames(spark)
    full = build_summary(truth, estimates, types)
    assert full.columns == summary_columns()
    assert [(r.fund_code, r.day, r.ant_return) for r in full.collect()] == [("a", DAY, 1.5)]
    nowind = build_summary(truth, {k: estimates[k] for k in ("hm", "ant")}, types, VENDORS_NO_WIND)
    assert sorted(r.day for r in nowind.collect()) == [DAY, NEXT]
    for days, expected in ((NEXT, [NEXT]), ([DAY], [DAY]), ((DAY, NEXT), [DAY, NEXT])):
        part = build_summary(truth, estimates, types, VENDORS_NO_WIND, days)
        assert sorted(r.day for r in part.collect()) == expected


def test_fund_list(spark):
    summary = summary_of(spark, [row("a"), row("b")])
    chosen = spark.createDataFrame([("a",), ("a",)], "fund_code string")
    assert restrict_to_list(summary, chosen).count() == 1
    assert restrict_to_list(summary, chosen, dedupe=False).count() == 2


def test_skewed_join_is_split(spark):
    """One fund holds a third of the rows; the shuffled join cuts its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        code = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997)
        summary = (
            spark.range(0, 60000, numPartitions=12)
            .select(code.cast("string").alias("fund_code"), F.xxhash64("id").alias("x"))
            .withColumn("y", F.sha2(F.col("x").cast("string"), 256))
        )
        chosen = spark.range(997).select(F.col("id").cast("string").alias("fund_code"))
        kept = restrict_to_list(summary, chosen)
        assert len(kept.collect()) == 60000
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_store_replaces_only_the_days_written(spark, tmp_path):
    path = str(tmp_path / "summary")
    store.write_summary(summary_of(spark, [row("a"), row("b", day=NEXT)]), path)
    store.write_summary(summary_of(spark, [row("c")]), path)
    rows = store.read_summary(spark, path).collect()
    assert sorted((r.fund_code, r.day) for r in rows) == [("b", NEXT), ("c", DAY)]
    pruned = store.read_summary(spark, path, days=(NEXT, NEXT))
    assert [r.fund_code for r in pruned.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().toString()


def test_store_with_days_of_different_vendors(spark, tmp_path):
    """Wind is absent on one day; either order of writing gives the same reports."""
    rows = [row("a", wind=1.01), row("b", wind=1.01)]
    with_wind = summary_of(spark, rows)
    without = summary_of(spark, [row("c", day=NEXT), row("d", day=NEXT)]).drop("wind_nav")
    for name, frames in (("x", (with_wind, without)), ("y", (without, with_wind))):
        path = str(tmp_path / name)
        for frame in frames:
            store.write_summary(frame, path)
        stored = store.read_summary(spark, path)
        assert stored.count() == 4
        full = store.complete_rows(stored)
        found = only(report("r2_abs_mean", full, Scope(keys=("type",))))
        assert (found.fund_count, found.wind_abs_mean) == (2, Dec("10.000"))
        bands = report("r9_abs_cumulative", full, Scope(keys=("type",)))
        wind = only(bands.filter("vendor = 'wind'"))
        assert wind[-2] + wind[-1] == 100
        assert [tuple(r) for r in store.incomplete_days(stored).collect()] == [(NEXT, 2)]
        assert store.complete_rows(stored, VENDORS_NO_WIND).count() == 4


def test_rerun_of_a_day_without_rows_empties_it(spark, tmp_path):
    path = str(tmp_path / "summary")
    both = summary_of(spark, [row("a"), row("b", day=NEXT)])
    store.write_summary(both, path, [DAY, NEXT])
    store.write_summary(both.limit(0), path, DAY)
    assert [r.day for r in store.read_summary(spark, path).collect()] == [NEXT]
    store.write_summary(both.filter(F.col("day") == F.lit(DAY)), path, (DAY, NEXT))
    assert [r.day for r in store.read_summary(spark, path).collect()] == [DAY]


def test_csv_sink_with_several_files_keeps_the_order(spark, tmp_path):
    frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("n"))
    path = str(tmp_path / "many")
    store.write_csv(frame, path, ["n"], files=3)
    files = sorted((tmp_path / "many").glob("part-*.csv"))
    lines = [line for f in files for line in f.read_text().splitlines() if line != "n"]
    assert len(files) == 3 and lines == [str(i) for i in range(1000)]


def test_list_is_applied_before_the_vendor_joins(spark, tmp_path):
    truth, estimates, types = feed_frames(spark)
    chosen = spark.createDataFrame([("a",)], "fund_code string")

    class Rows:
        def __init__(self, rows):
            self.rows = rows

    loaded = {"truth": Rows(truth), "top_list": Rows(chosen)}
    loaded |= {code: Rows(frame) for code, frame in estimates.items()}
    loaded["fund_classes"] = Rows(types.select("fund_code", F.lit("1").alias("class_code")))
    loaded["class_names"] = Rows(spark.createDataFrame([("1", "stock")], "class_code string, type string"))
    summary = runs.daily_summary(loaded, DAY)
    assert [r.fund_code for r in summary.collect()] == ["a"]
    plan = summary._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join " in line]
    # printed from the last join down: the semi join stands below all vendor joins
    assert "LeftSemi" in joins[4]


def test_csv_sink_appends_single_files_with_header(spark, sample, tmp_path):
    path = str(tmp_path / "csv")
    frame = report("r2_abs_mean", sample, Scope(keys=("type",)))
    store.write_csv(frame, path)
    store.write_csv(frame, path)
    files = list((tmp_path / "csv").glob("part-*.csv"))
    assert len(files) == 2
    lines = files[0].read_text().splitlines()
    assert lines[0] == ",".join(frame.columns) and len(lines) == 4
    store.write_csv(frame, path, ["fund_count", "type"], mode="overwrite")
    (written,) = (tmp_path / "csv").glob("part-*.csv")
    counts = [int(line.split(",")[1]) for line in written.read_text().splitlines()[1:]]
    assert counts == sorted(counts)
    assert len(store.preview(frame, 2).collect()) == 2


def test_display_wording(sample):
    scope = Scope(keys=("type",))
    means = display("r5_rel_mean", report("r5_rel_mean", sample, scope), scope)
    assert means.columns[:3] == ["基金类型", "基金数量", "蚂蚁估值相对偏差均值"]
    assert means.first()[2].endswith("%")
    bands = display("r10_rel_bands", report("r10_rel_bands", sample, scope), scope)
    assert bands.columns[1:] == ["基金名称", *band_labels(REL_EDGES, False, True)]
    assert band_labels(REL_EDGES, False, True)[:2] == ["<=0.05%", "(0.05%,0.1%]"]
    assert band_labels(ABS_EDGES, True, False)[-2:] == ["<=0.02", ">0.02"]
    assert {r[1] for r in bands.collect()} == {"蚂蚁", "天天", "聚源", "万得", "好买"}


def test_reports_read_only_the_columns_they_need(spark, sample, tmp_path):
    path = str(tmp_path / "summary")
    store.write_summary(sample, path)
    frame = report("r2_abs_mean", store.read_summary(spark, path), Scope(keys=("type",)))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "_return" not in plan.split("Relation")[0]
