"""Benchmark decontamination by a broadcast hash set of test n-grams.

Texts are normalised (A-Z to lower case, words are runs of letters, digits and non-ASCII
characters). Every benchmark item gives its windows of ten words; an item of fewer words is
one window. The windows are a hash set under their rarest word in the benchmark (the longest
of equals), which each task holds while it scans the words of its documents: at a word that is
such a key, the window around it is compared word by word before it counts.

The set is broadcast in parts of ``BROADCAST_BYTES`` at most, measured first; a benchmark that
needs several parts costs a scan of the documents for each. Only verified hits leave a task;
they are merged per distinct text, so a passage in a third of all documents adds one
row for each document and window and never gathers documents.

Defined cases: a null or wordless text has no words and is clean; very long texts are scanned
whole; items without words give no window; repeated documents and items count as rows; a null
``doc_id`` or ``item_id`` is kept (a null item is left out of the digest's list but counts);
an empty table of documents gives no rows, an empty benchmark no hits; other columns, whatever
they are called, are carried by the functions that return documents (``mark`` gives its own
columns precedence) and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navscore.llm.common import ascii_lower, fresh, let, text_of

SIZE = 10
BROADCAST_BYTES = 64 << 20
ITEM_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), ITEM_BREAK), "")


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct windows of the items with the items they occur in: win, n, items, their key
    ``word`` and its place ``off`` in the window."""
    words = benchmark.select("item_id", item_words(text_of()).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    windows = words.select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win")
    )
    distinct = windows.groupBy("win").agg(F.collect_set("item_id").alias("items"))
    uses = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    places = distinct.select("win", F.posexplode("win").alias("off", "word")).join(uses, "word")
    keys = places.groupBy("win").agg(
        F.min(F.struct("uses", -F.length("word").alias("length"), "off", "word")).alias("key")
    )
    return distinct.join(keys, "win").select(
        "win", F.size("win").alias("n"), "items", F.col("key.off"), F.col("key.word")
    )


def parts_of(windows: DataFrame) -> int:
    """The number of parts in which the windows are broadcast."""
    held = F.octet_length(F.array_join("win", "")) + 16 * F.col("n") + 8 * F.size("items") + 64
    size = windows.agg(F.sum(held)).first()[0] or 0
    return max(1, -(-size // BROADCAST_BYTES))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Per distinct (doc_id, text) with a hit: doc_id, text_key, positions, items.

    ``positions`` are the zero-based numbers of the words inside any occurrence.
    """
    windows = benchmark_windows(benchmark, size)
    parts = parts_of(windows)
    words = docs.select(
        "doc_id", F.xxhash64(text_of()).alias("text_key"), item_words(text_of()).alias("w")
    ).select("*", F.posexplode("w").alias("at", "token"))
    found = None
    for part in range(parts):
        own = windows.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == part)
        start = F.col("at") - F.col("off")
        same = F.when(start >= 0, F.slice("w", start + 1, F.col("n")) == F.col("win"))
        scanned = words.join(F.broadcast(own), (F.col("token") == F.col("word")) & same).select(
            "doc_id", "text_key", start.alias("p"), "n", "items"
        )
        found = scanned if found is None else found.unionByName(scanned)
    return found.groupBy("doc_id", "text_key").agg(
        F.array_distinct(
            F.flatten(
                F.transform(
                    F.collect_set(F.struct("p", "n")),
                    lambda s: F.sequence(s["p"], s["p"] + s["n"] - 1),
                )
            )
        ).alias("positions"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def _with_hits(docs: DataFrame, found: DataFrame, columns: dict, how: str) -> DataFrame:
    """``docs`` joined with ``columns`` of the rows of :func:`hits`."""
    doc, key = (fresh([*docs.columns, *columns], name) for name in ("hit_doc", "hit_key"))
    found = found.select(
        F.col("doc_id").alias(doc),
        F.col("text_key").alias(key),
        *[value.alias(name) for name, value in columns.items()],
    )
    same = docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(text_of()) == F.col(key))
    return docs.join(found, same, how).drop(doc, key)


def mark(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with ``hit_positions`` and ``hit_items`` (empty arrays when clean)."""
    docs = docs.drop("hit_positions", "hit_items")
    given = {"hit_positions": F.col("positions"), "hit_items": F.col("items")}
    marked = _with_hits(docs, hits(docs, benchmark, size), given, "left")
    return marked.withColumns(
        {name: F.coalesce(name, F.array().cast(marked.schema[name].dataType)) for name in given}
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents without any hit, with the columns of ``docs``."""
    return _with_hits(docs, hits(docs, benchmark, size), {}, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with the hit words cut from ``text``; what stands between words stays."""
    marked = mark(docs, benchmark, size)
    text = text_of()
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

    def cut(words: Column) -> Column:
        gaps = F.split(text, word)
        kept = F.transform(
            gaps,
            lambda gap, i: F.concat(
                gap,
                F.when(F.array_contains("hit_positions", i), "").otherwise(
                    F.coalesce(F.get(words, i), F.lit(""))
                ),
            ),
        )
        return F.array_join(kept, "")

    words = F.regexp_extract_all(text, F.lit(f"({word})"), 1)
    cleaned = F.when(F.size("hit_positions") > 0, let(words, cut)).otherwise(F.col("text"))
    return marked.select(*[cleaned.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    given = {
        "hit": F.size("positions").cast("long"),
        "item_count": F.size("items").cast("long"),
        "digest": F.sha2(F.array_join(ids, ","), 256),
    }
    # the texts are counted before the join, which then moves none of them
    counted = docs.select(
        "doc_id",
        F.xxhash64(text_of()).alias("text_key"),
        F.size(item_words(text_of())).cast("long").alias("n_words"),
    )
    found = hits(docs, benchmark).select(
        F.col("doc_id").alias("hit_doc"),
        F.col("text_key").alias("hit_key"),
        *[value.alias(name) for name, value in given.items()],
    )
    none = F.lit(0).cast("long")
    return counted.join(
        found,
        F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_key")),
        "left",
    ).select(
        "doc_id",
        "n_words",
        F.coalesce("hit", none).alias("n_hit"),
        F.coalesce("item_count", none).alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g,
    least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw))
), h AS (
  SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
    sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)))
      AS items_sha256
  FROM h GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
