"""Text files in, stored summary and CSV reports out."""

from datetime import date

import pytest

from navscore.plans import runs
from navscore.plans.reports import REPORTS
from navscore.sources import store
from tests.test_feeds import truth_line

FIRST, SECOND = date(2021, 3, 18), date(2021, 3, 19)


@pytest.fixture
def paths(write_lines):
    stamps = ("20210318", "20210319")
    codes = ("000001", "000002")
    both = [(c, s) for c in codes for s in stamps]
    slashed = {s: f"{s[:4]}/{s[4:6]}/{s[6:]}" for s in stamps}
    lines = {
        "truth": [truth_line(f0=c + ".OF", f2=s + "15") for c, s in both],
        "hm": [f"{c}\t{s}00\t15:00\t1.002\t-0.3" for c, s in both],
        "ant": [
            f'{c}\tn\td\t1\t{slashed[s]} 15:00\td\t1.004\t"+0.5%"\t"' for c, s in both
        ],
        "wind": [f"{c}\t1.03\t{slashed[s]}" for c, s in both],
        "fund_classes": ['1|"000001"|"3  "', '1|"000002"|"4  "'],
        "class_names": ["3\t股票型", "4\t债券型"],
        "top_list": ["2021-03-04\tA\tM\t000002\tn\t12\t3.5"],
    }
    return {name: write_lines(text, name=f"{name}.txt") for name, text in lines.items()}


def csv_rows(spark, folder, name):
    return spark.read.option("header", True).csv(f"{folder}/{name}").collect()


def test_daily_and_weekly_run(spark, paths, tmp_path):
    at = {n: str(tmp_path / n) for n in ("store", "work", "day", "week", "work2", "all", "work3")}
    everyone = {k: v for k, v in paths.items() if k != "top_list"}
    runs.daily_run(spark, everyone, FIRST, at["store"], at["work"], at["day"])
    runs.daily_run(spark, everyone, SECOND, at["store"], at["work"], at["day"])
    assert store.read_summary(spark, at["store"]).count() == 4
    daily = csv_rows(spark, at["day"], "r2_abs_mean")
    assert [r["蚂蚁估值绝对偏差均值"] for r in daily] == ["4.000"] * 4

    runs.range_run(spark, at["store"], (FIRST, SECOND), at["work2"], at["week"])
    for name in REPORTS:
        assert csv_rows(spark, at["week"], name), name
    weekly = csv_rows(spark, at["week"], "r1_opposite")
    assert [(r["基金数量"], r["好买相反个数"], r["好买相反估计占比"]) for r in weekly] == [
        ("2", "2", "100.000%")
    ] * 2
    runs.range_run(spark, at["store"], [FIRST], at["work3"], at["all"], grouping="all")
    assert len(csv_rows(spark, at["all"], "r11_rel_cumulative")) == 5


def test_list_run_without_wind(spark, paths, tmp_path):
    at = [str(tmp_path / n) for n in ("store", "work", "csv")]
    some = {k: v for k, v in paths.items() if k != "wind"}
    runs.daily_run(spark, some, FIRST, *at, vendors=("ant", "tiantian", "jy", "hm"))
    (row,) = csv_rows(spark, at[2], "r3_abs_median")
    assert row["基金类型"] == "债券型"
    assert not [c for c in row.asDict() if c.startswith("万得")]


def test_every_line_of_a_run_is_a_row_or_a_reject(spark, paths, tmp_path, write_lines):
    bad = ["short", "", truth_line(f5="n/a"), truth_line(f3="")]
    good = [truth_line(f0="000001.OF"), truth_line(f0="000002.OF")]
    some = dict(paths, truth=write_lines(good + bad, name="mixed.txt"))
    at = [str(tmp_path / n) for n in ("store", "work", "csv")]
    runs.daily_run(spark, some, FIRST, *at)
    counts = spark.read.parquet(f"{at[1]}/rejects/lines_by_reason").collect()
    for name, path in some.items():
        with open(path, encoding="utf-8") as file:
            total = len(file.read().splitlines())
        assert sum(r["lines"] for r in counts if r["feed"] == name) == total
    rejected = spark.read.parquet(f"{at[1]}/rejects/truth").collect()
    assert sorted(r["line"] for r in rejected) == sorted(bad)


def test_encoding_of_one_feed(spark, paths, tmp_path, write_lines):
    ant = open(paths["ant"], encoding="utf-8").read().splitlines()
    some = dict(paths, ant=write_lines([x.replace("\tn\t", "\t基金\t") for x in ant], "gbk", "gbk.txt"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        loaded = runs.load_feeds(spark, some, encodings={"ant": "GBK"})
        assert {r.fund_name for r in loaded["ant"].rows.collect()} == {"基金"}
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_weekly_run_from_text_equals_the_run_from_the_store(spark, paths, tmp_path):
    everyone = {k: v for k, v in paths.items() if k != "top_list"}
    at = {n: str(tmp_path / n) for n in ("store", "w1", "d1", "w2", "week", "w3", "text")}
    runs.daily_run(spark, everyone, [FIRST, SECOND], at["store"], at["w1"], at["d1"])
    runs.range_run(spark, at["store"], (FIRST, SECOND), at["w2"], at["week"])
    stored = store.read_summary(spark, at["store"])
    lines = str(tmp_path / "lines")
    stored.selectExpr("concat_ws('\t', *) AS value").write.text(lines)
    runs.text_range_run(spark, lines, at["w3"], at["text"], (FIRST, SECOND))
    for name in REPORTS:
        assert csv_rows(spark, at["text"], name) == csv_rows(spark, at["week"], name), name
    assert spark.read.parquet(f"{at['w2']}/incomplete_days").count() == 0


def test_each_feed_is_read_once(spark, paths, tmp_path):
    """One write reads and parses a feed's text; what follows reads what was written."""
    from navscore.sources import feeds

    with open(paths["hm"], "a") as feed:
        feed.write("bad line\n000003\t2021031800\t15:00\tx\t1\n")
    loaded = runs.load_feeds(spark, paths)
    plan = loaded["hm"].parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    work = str(tmp_path / "work")
    found = runs.ingest_feeds(spark, loaded, work)
    for name, feed in found.items():
        for frame in (feed.rows, feed.rejected):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "text" not in plan.lower() or "FileScan parquet" in plan
            assert all("/work/feeds/" in f for f in frame.inputFiles()), name
        assert sorted(map(str, feed.rows.collect())) == sorted(map(str, loaded[name].rows.collect()))
        assert sorted(map(str, feed.rejected.collect())) == sorted(map(str, loaded[name].rejected.collect()))
    counts = spark.read.parquet(f"{work}/rejects/lines_by_reason")
    want = feeds.line_counts(loaded)
    assert sorted(map(tuple, counts.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r.reject_reason for r in counts.where("feed = 'hm'").collect()} == {None, "field_count", "unreadable_hm_nav"}


def test_runs_with_an_atomic_store(spark, paths, tmp_path, monkeypatch):
    at = [str(tmp_path / n) for n in ("store", "work", "csv")]
    everyone = {k: v for k, v in paths.items() if k != "top_list"}
    runs.daily_run(spark, everyone, [FIRST, SECOND], *at, atomic=True)
    assert store.committed_summary(spark, at[0]).count() == 4

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    monkeypatch.setattr(store.snapshots, "_publish", broken)
    with pytest.raises(RuntimeError):
        runs.daily_run(spark, everyone, SECOND, *at, vendors=("jy",), atomic=True)
    monkeypatch.undo()
    scores = runs.range_run(spark, at[0], (FIRST, SECOND), at[1], at[2], atomic=True)
    assert sum(r.fund_count for r in scores.report("r2_abs_mean").collect()) == 4
