"""Loaders, on small text files with good and spoilt lines."""

from datetime import date

import pytest

from navscore.functions import parsing as P
from navscore.sources import feeds as S


def load(spark, loader, path, **options):
    feed = loader(S.read_lines(spark, path), **options)
    reasons = sorted(r.reject_reason for r in feed.rejected.collect())
    return feed.rows.collect(), reasons


def truth_line(**changes):
    fields = {
        0: "000001.OF",
        1: "股票型",
        2: "2021031815",
        3: "1.01",
        4: "0.5",
        5: "1.0",
        6: "0.4",
        7: "0",
        8: "0.01",
        9: "0.99",
        10: "-0.5",
        11: "1",
        12: "0.01",
    }
    fields.update({int(k[1:]): v for k, v in changes.items()})
    return "\t".join(fields[i] for i in range(13))


def test_truth_feed(spark, write_lines):
    lines = [truth_line()]
    lines += [truth_line(**{f"f{i}": ""}) for i in (3, 4, 5, 6, 9, 10)]
    lines += [
        truth_line(f7="", f8=""),  # empty fields elsewhere are fine
        truth_line(f12=""),  # an empty last field shortens the line
        truth_line(f0="0001"),
        truth_line(f2="20211345"),
        truth_line(f3="abc"),
        truth_line(f5="NaN"),
        truth_line() + "\textra",
        "short\tline",
    ]
    rows, reasons = load(spark, S.load_truth, write_lines(lines))
    assert len(rows) == 2
    first = rows[0].asDict()
    assert first["fund_code"] == "000001"
    assert first["fund_type"] == "股票型"
    assert first["day"] == date(2021, 3, 18)
    assert (first["jy_nav"], first["report_nav"], first["tiantian_return"]) == (1.01, 1.0, -0.5)
    assert reasons == sorted(
        ["empty_field"] * 6
        + ["field_count"] * 3
        + ["unreadable_fund_code", "unreadable_day", "unreadable_jy_nav", "unreadable_report_nav"]
    )


def test_hm_feed_both_layouts(spark, write_lines):
    tab = ["000001\t2021031800\t15:00\t1.02\t0.3", "000001\t20210318\t15:00\t1.02", "a\t\t\t\t"]
    rows, reasons = load(spark, S.load_hm, write_lines(tab))
    assert [tuple(r) for r in rows] == [("000001", date(2021, 3, 18), "15:00", 1.02, 0.3)]
    assert reasons == ["field_count", "field_count"]

    pipe = ['9|"000001"|"20210218"|15:00|1.02|0.3', '9|"000001"|"20210218"|15:00|1.02']
    rows, reasons = load(spark, S.load_hm, write_lines(pipe), layout="pipe")
    assert [tuple(r) for r in rows] == [("000001", date(2021, 2, 18), "15:00", 1.02, 0.3)]
    assert reasons == ["field_count"]
    with pytest.raises(ValueError):
        S.load_hm(S.read_lines(spark, write_lines(tab)), layout="xml")


def test_ant_feed(spark, write_lines):
    def line(ratio, stamp="2021/3/8 9:05"):
        return f'000001\tname\t2021-03-08\t1\t{stamp}\t2021-03-08\t1.5\t{ratio}\t"'

    lines = [line('"+1.23%"'), line("-"), line("-0.40%", "2021/03/08"), "x\ty"]
    rows, reasons = load(spark, S.load_ant, write_lines(lines))
    assert [(r.day, r.ant_nav, r.ant_ratio) for r in rows] == [
        (date(2021, 3, 8), 1.5, '"+1.23%"')
    ]
    assert reasons == ["field_count", "no_estimate", "unreadable_day"]


def test_class_and_name_feeds(spark, write_lines):
    lines = ['1|"000001"|"3  "', '1|"000002"|"12 x"', '1|"000003"|"3"', "1|2"]
    rows, reasons = load(spark, S.load_fund_classes, write_lines(lines))
    assert [tuple(r) for r in rows] == [("000001", "3"), ("000002", "12")]
    assert reasons == ["field_count", "unreadable_class_code"]
    rows, reasons = load(spark, S.load_class_names, write_lines(["3\t股票型\tmore", "4"]))
    assert [tuple(r) for r in rows] == [("3", "股票型")]
    assert reasons == ["unreadable_type"]


def test_wind_and_top_list_feeds(spark, write_lines):
    lines = ["000001\t1.1\t2021/03/18", "000001\t-\t2021/03/18", "000001\t1.1\t18.03.2021"]
    rows, reasons = load(spark, S.load_wind, write_lines(lines))
    assert [tuple(r) for r in rows] == [("000001", 1.1, date(2021, 3, 18))]
    assert reasons == ["no_estimate", "unreadable_day"]
    line = "2021-03-04\tA\tM\t000001\tname\t12\t3.5"
    rows, _ = load(spark, S.load_top_list, write_lines([line]))
    assert tuple(rows[0]) == tuple(line.split("\t"))


def test_weekly_text(spark, write_lines):
    line = "\t".join(["000001", "股票型", "2021-03-18"] + [str(i / 10) for i in range(1, 12)])
    rows, reasons = load(spark, S.load_summary_text, write_lines([line, "000001\tx\t2021-03-18"]))
    assert rows[0].day == date(2021, 3, 18) and rows[0].wind_nav == 1.1
    assert reasons == ["unreadable_report_nav"]


def test_reject_counts(spark, write_lines):
    feed = S.load_wind(S.read_lines(spark, write_lines(["a", "b", "1\t-\t2021/03/18"])))
    counts = {r.reject_reason: r.lines for r in feed.reject_counts().collect()}
    assert counts == {"field_count": 2, "no_estimate": 1}


def test_other_encoding(spark, write_lines):
    path = write_lines(["A\tcafé | \"x", ""], encoding="latin-1")
    rows = S.load_class_names(S.read_lines(spark, path, encoding="ISO-8859-1")).rows.collect()
    assert [tuple(r) for r in rows] == [("A", 'café | "x')]


def test_percent_number(spark):
    texts = ["+1.23%", "-0.40%", '"+1.23%"', "2", "x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in frame.select(P.percent_number(frame.t)).collect()]
    assert found == [1.23, -0.4, 1.23, 2.0, None]


def test_no_line_is_lost_in_any_encoding(spark, tmp_path):
    lines = ["股票型", "", "a\u0001b", " 债券 ", "last"]
    path = tmp_path / "gbk.txt"
    path.write_bytes("\n".join(lines).encode("gbk"))
    with pytest.raises(ValueError, match="javaCharsets"):
        S.read_lines(spark, str(path), "GBK")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        got = [r.value for r in S.read_lines(spark, str(path), "GBK").collect()]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert got == lines
    (tmp_path / "latin.txt").write_bytes("é\n\nx\u0001y".encode("latin-1"))
    read = S.read_lines(spark, str(tmp_path / "latin.txt"), "latin-1")
    assert [r.value for r in read.collect()] == ["é", "", "x\u0001y"]
    with pytest.raises(ValueError, match="UTF-16"):
        S.read_lines(spark, str(path), "UTF-16LE")
