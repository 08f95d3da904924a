"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document and leaves one bit in ``failed`` next to the
measurements it used. A policy is a versioned mask of bits: applying one, or asking what a
rule alone costs (ablation), is bitwise arithmetic over the ledger and never reads a text
again. Only built-in expressions are used, one document at a time, without a shuffle.

Defined cases: a null text counts as empty and has no words; empty texts fail
``few_words``; repeated rows are judged alike, one row each; columns of the input with
clashing names are not carried along, the ledger has the columns of ``LEDGER``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navscore.llm.common import let, text_of, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_capitals",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
)
LEDGER = ("doc_id", *MEASURES, "failed")

# Condition under which a document fails the rule; the position in the list is its bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("capitals", "10 * n_capitals > 3 * word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

# Versions are added, never changed: a stored verdict names the version it came from.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"],
    "v2": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["word_length"] | BIT["capitals"],
}
LATEST = "v2"


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the document.

    Windows are sorted within the row, so equal ones are neighbours.
    """

    def positions(windows: Column) -> Column:
        repeated = F.filter(
            windows,
            lambda w, i: (F.get(windows, i - 1)["w"] == w["w"])
            | (F.get(windows, i + 1)["w"] == w["w"]),
        )
        return F.flatten(
            F.transform(repeated, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2))
        )

    windows = F.when(
        F.size(words) >= 3,
        F.sort_array(
            F.transform(
                F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(1))),
                lambda first, i: F.struct(
                    F.concat_ws(" ", first, F.get(words, i + 1), F.get(words, i + 2)).alias("w"),
                    i.alias("i"),
                ),
            )
        ),
    ).otherwise(F.array().cast("array<struct<w:string,i:int>>"))
    return F.size(F.array_distinct(let(windows, positions)))


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: the measurements and the bits of the rules it fails."""
    text = text_of()
    measured = (
        docs.select("doc_id", text.alias("t"))
        .select("doc_id", "t", words_of(F.col("t")).alias("w"), _lines(F.col("t")).alias("l"))
        .select(
            "doc_id",
            F.size("w").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            _removed(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
            _removed(F.col("t"), CAPITALS).cast("long").alias("n_capitals"),
            F.size("l").cast("long").alias("n_lines"),
            (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
            _repeated(F.col("w")).cast("long").alias("n_repeat_words"),
        )
    )
    failed = F.lit(0).cast("long")
    for name, condition in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(condition), BIT[name]).otherwise(0))
    return measured.withColumn("failed", failed)


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def verdict(policy: str = LATEST, failed: Column | None = None) -> Column:
    """Whether a document passes every rule of the policy."""
    bits = F.col("failed") if failed is None else failed
    return bits.bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """Per rule of the policy: documents it fails, and those no other rule of it fails.

    The ledger is reduced to counts per bit pattern first (at most ``2 ** len(RULES)``
    rows), so any number of policies costs one small aggregation.
    """
    mask = POLICIES[policy]
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    chosen = [(name, BIT[name]) for name, _ in RULES if BIT[name] & mask]
    rules = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in chosen])
    )
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0))
            .alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0))
            .alias("n_failed_alone"),
        )
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Ledger, base verdict and the latest policy over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = ledger(docs)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        verdict(LATEST).alias("kept"),
        F.col("failed").alias("failed_bits"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), p AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), c AS (
  SELECT r, count(DISTINCT i + k) AS n FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), m AS (
  SELECT w.r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    len(regexp_extract_all(t, '[A-Z]')) AS n_capitals,
    len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c ON w.r = c.r
), f AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_capitals > 3 * word_chars THEN 32 ELSE 0 END AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed_bits % 4) > 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM f
"""
