"""Loaders of the delimited text feeds.

Every loader takes the lines of a feed (a DataFrame with one string column ``value``)
and returns a :class:`Feed`: the rows that parse, and the lines that do not, each with
the first reason found. A bad line never stops the job and never disappears silently.
Each loader is one projection, so parsing stays in generated code next to the scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from navscore.functions import parsing as P
from navscore.schemas import VALUE, VENDORS, summary_columns

# Fixed values of the feeds: the mark for no estimate, and the length of a fund code. The
# arities and positions in the loaders below are fixed in the same way.
NO_VALUE = "-"
CODE_LENGTH = 6


@dataclass(frozen=True)
class Feed:
    """A parsed feed: ``parsed`` holds the columns, the line and the reject reason, which is one
    of ``reasons``."""

    parsed: DataFrame
    columns: tuple[str, ...]
    reasons: tuple[str, ...] = ()

    @property
    def rows(self) -> DataFrame:
        return self.parsed.filter(F.col("reject_reason").isNull()).select(*self.columns)

    @property
    def rejected(self) -> DataFrame:
        return self.parsed.filter(F.col("reject_reason").isNotNull()).select(
            "reject_reason", "line"
        )

    def reject_counts(self) -> DataFrame:
        return self.rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("lines"))


def line_counts(loaded: Mapping[str, Feed]) -> DataFrame:
    """``feed``, ``reject_reason`` (null for rows) and ``lines``, of all feeds in one
    aggregation."""
    tagged = [
        feed.parsed.select(F.lit(name).alias("feed"), "reject_reason")
        for name, feed in loaded.items()
    ]
    lines = reduce(lambda a, b: a.unionByName(b), tagged)
    return lines.groupBy("feed", "reject_reason").agg(F.count(F.lit(1)).alias("lines"))


def ingest(feed: Feed, path: str) -> tuple[Feed, dict[str | None, int]]:
    """The feed written to ``path`` and read back, and its lines by reject reason (None for
    rows). Lines are read and parsed once: rows and rejected lines part into two folders of
    one write, which also counts them. Only rejected rows keep their line."""
    spark = feed.parsed.sparkSession
    counts = Observation()
    reason = F.col("reject_reason")
    parted = feed.parsed.withColumns(
        {"line": F.when(reason.isNotNull(), F.col("line")), "accepted": reason.isNull()}
    )
    labels = {f"reason_{i}": label for i, label in enumerate(feed.reasons)}
    watched = parted.observe(
        counts,
        F.count_if(reason.isNull()).alias("rows"),
        *[F.count_if(reason == label).alias(name) for name, label in labels.items()],
    )
    watched.write.mode("overwrite").partitionBy("accepted").parquet(path)
    found = counts.get
    lines = {None: found["rows"]} | {label: found[name] for name, label in labels.items()}
    stored = spark.read.schema(parted.schema).parquet(path)
    return IngestedFeed(stored, feed.columns, feed.reasons), {k: n for k, n in lines.items() if n}


@dataclass(frozen=True)
class IngestedFeed(Feed):
    """A feed that was written by :func:`ingest`: rows and rejected lines are folders."""

    @property
    def rows(self) -> DataFrame:
        return self.parsed.filter("accepted").select(*self.columns)

    @property
    def rejected(self) -> DataFrame:
        return self.parsed.filter("not accepted").select("reject_reason", "line")


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """The lines of text files, every one of them, in any encoding that extends ASCII.

    The text reader splits on the bytes of a line end, which such encodings (GBK, Latin-1)
    share, and keeps all other bytes; the lines are decoded afterwards. Spark decodes
    encodings outside its own short list only with ``spark.sql.legacy.javaCharsets`` set to
    true, which this loader requires for them. UTF-16 and UTF-32 are refused, as their line
    ends are other bytes.
    """
    name = encoding.lower().replace("-", "").replace("_", "")
    lines = spark.read.text(path)
    if name == "utf8":
        return lines
    if name.startswith(("utf16", "utf32")):
        raise ValueError(f"{encoding} cannot be split into lines before it is decoded")
    own = name in ("usascii", "ascii", "iso88591", "latin1")
    if not own and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise ValueError(f"{encoding} needs the setting spark.sql.legacy.javaCharsets=true")
    charset = {"ascii": "US-ASCII", "latin1": "ISO-8859-1"}.get(name, encoding)
    return lines.select(F.decode(F.col("value").cast("binary"), charset).alias("value"))


def _feed(
    lines: DataFrame,
    separator: str,
    arity: int | None,
    columns: dict[str, Column],
    rejects: list[tuple[str, Column]],
) -> Feed:
    """Parse ``lines``: ``columns`` and ``rejects`` are written over the array ``fields``.

    The wrong number of fields is the first reason; a column that parses to null without
    an earlier reason makes the reason ``unreadable_<column>``.
    """
    split = lines.select(
        F.col("value").alias("line"), P.split_fields(F.col("value"), separator).alias("fields")
    )
    # The columns come out of a generator so that they are parsed once: a filter on the
    # reason stays above it, and would otherwise repeat the parsing for every check.
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    parsed = split.select("line", "fields", F.inline(F.array(row)))
    numbers = {f.name for f in parsed.schema.fields if f.dataType == VALUE}
    checks = [] if arity is None else [("field_count", F.size("fields") != arity)]
    checks += rejects
    checks += [(f"unreadable_{name}", P.unusable(name, name in numbers)) for name in columns]
    reason = F.coalesce(*[F.when(bad, F.lit(label)) for label, bad in checks])
    return Feed(
        parsed.select("line", *columns, reason.alias("reject_reason")),
        tuple(columns),
        tuple(label for label, _ in checks),
    )


def _at(position: int) -> Column:
    """Field by position; null when the line is too short."""
    return F.get(F.col("fields"), F.lit(position))


def _code(text: Column, start: int = 1) -> Column:
    """A fund code by position; null when the text is too short to hold one."""
    return F.when(
        F.length(text) >= start - 1 + CODE_LENGTH, F.substring(text, start, CODE_LENGTH)
    )


def load_truth(lines: DataFrame) -> Feed:
    """t0: disclosed values with the jy and tiantian estimates; 13 tab-separated fields."""
    # Positions that must not be empty.
    required = (3, 4, 5, 6, 9, 10)
    empty = F.lit(False)
    for position in required:
        empty = empty | (_at(position) == "")
    return _feed(
        lines,
        "\t",
        13,
        {
            "fund_code": _code(_at(0)),
            "fund_type": _at(1),
            "day": P.day_compact(_at(2)),
            "jy_nav": P.number(_at(3)),
            "jy_return": P.number(_at(4)),
            "report_nav": P.number(_at(5)),
            "report_return": P.number(_at(6)),
            "jy_sign_error": _at(7),
            "jy_deviation": _at(8),
            "tiantian_nav": P.number(_at(9)),
            "tiantian_return": P.number(_at(10)),
            "tiantian_sign_error": _at(11),
            "tiantian_deviation": _at(12),
        },
        [("empty_field", empty)],
    )


def load_hm(lines: DataFrame, layout: str = "tab") -> Feed:
    """t1: hm estimates. ``tab`` has 5 fields; the older ``pipe`` layout has 6, with the
    code and day behind an opening quote and one leading field that is not used."""
    if layout == "tab":
        first, code_start, separator, arity = 0, 1, "\t", 5
        day_text = _at(1)
    elif layout == "pipe":
        first, code_start, separator, arity = 1, 2, "|", 6
        day_text = F.substring(_at(2), 2, 8)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return _feed(
        lines,
        separator,
        arity,
        {
            "fund_code": _code(_at(first), code_start),
            "day": P.day_compact(day_text),
            "quote_time": _at(first + 2),
            "hm_nav": P.number(_at(first + 3)),
            "hm_return": P.number(_at(first + 4)),
        },
        [],
    )


def load_ant(lines: DataFrame) -> Feed:
    """t2: ant estimates; 9 tab-separated fields. The return stays text such as ``+1.23%``
    until the summary is built; ``-`` there means that no estimate was published."""
    return _feed(
        lines,
        "\t",
        9,
        {
            "fund_code": _at(0),
            "fund_name": _at(1),
            "trading_day": _at(2),
            "total_return": _at(3),
            "day": P.day_of_timestamp(_at(4)),
            "estimate_date": _at(5),
            "ant_nav": P.number(_at(6)),
            "ant_ratio": _at(7),
        },
        [("no_estimate", _at(7) == NO_VALUE)],
    )


def load_fund_classes(lines: DataFrame) -> Feed:
    """t3: fund to class code; 3 pipe-separated fields, quotes stripped by position. The
    class is the first word of up to three characters behind the opening quote."""
    class_text = F.when(F.length(_at(2)) >= 4, F.substring(_at(2), 2, 3))
    return _feed(
        lines,
        "|",
        3,
        {
            "fund_code": _code(_at(1), 2),
            "class_code": F.get(F.split(class_text, " "), F.lit(0)),
        },
        [],
    )


def load_class_names(lines: DataFrame) -> Feed:
    """t4: class code to type name; at least two tab-separated fields."""
    return _feed(lines, "\t", None, {"class_code": _at(0), "type": _at(1)}, [])


def load_wind(lines: DataFrame) -> Feed:
    """t100: wind estimates, values only; 3 tab-separated fields, ``-`` for no estimate."""
    return _feed(
        lines,
        "\t",
        3,
        {"fund_code": _at(0), "wind_nav": P.number(_at(1)), "day": P.day_slashed(_at(2))},
        [("no_estimate", _at(1) == NO_VALUE)],
    )


def load_top_list(lines: DataFrame) -> Feed:
    """t101: the list of most-held funds; 7 tab-separated texts."""
    names = (
        "list_date",
        "asset_class",
        "merchant_code",
        "fund_code",
        "fund_name",
        "users_held",
        "amount",
    )
    return _feed(lines, "\t", None, {name: _at(i) for i, name in enumerate(names)}, [])


def load_summary_text(lines: DataFrame) -> Feed:
    """The weekly file: the 14 summary columns as tab-separated text."""
    columns = {}
    for position, name in enumerate(summary_columns(tuple(VENDORS))):
        text = _at(position)
        if name in ("fund_code", "type"):
            columns[name] = text
        elif name == "day":
            columns[name] = P.day_dashed(text)
        else:
            columns[name] = P.number(text)
    return _feed(lines, "\t", None, columns, [])
