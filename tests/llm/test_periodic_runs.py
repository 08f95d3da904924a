"""Runs of words against brute force, and the query's rows on small tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from navscore.llm import periodic_runs as P

BREAK = re.compile("[\x20\x09-\x0d]+")


def plain_words(text):
    return [word for word in BREAK.split(text or "") if word]


def plain_lyndon(codes):
    """Longest Lyndon word at each position, by comparing suffixes."""
    n = len(codes)
    found = []
    for i in range(n):
        end = next((j for j in range(i + 1, n) if codes[j:] < codes[i:]), n)
        found.append(end - i)
    return found


def plain_runs(words, least=P.LEAST, times=P.TIMES):
    """Every stretch with a smallest period, straight from the definition."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            if end > i and length >= max(least, times * q):
                stretch = words[i : i + length]
                if not any(
                    all(stretch[k] == stretch[k + d] for k in range(length - d)) for d in range(1, q)
                ):
                    found.append((i, length, q))
            i = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = plain_words(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
        n,
    )


@given(st.lists(st.integers(0, 2), max_size=60))
@settings(max_examples=300, deadline=None)
def test_lyndon_lengths(codes):
    assert P.lyndon_lengths(codes) == plain_lyndon(codes)
    opposite = [-code for code in codes]
    assert P.lyndon_lengths(opposite) == plain_lyndon(opposite)


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 12)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_runs_of_made_repetitions(parts):
    words = [b"%d" % code for unit, copies in parts for code in unit * copies]
    want = plain_runs(words)
    assert [tuple(r) for r in P.runs_of([words])[0].tolist()] == want
    found = P.document_runs([[], words, words, [b"x"] * 5])
    for d in (1, 2):
        assert [tuple(r) for r in found.get(d, P.np.empty((0, 3))).tolist()] == want
    assert 0 not in found and 3 not in found


def test_runs_of_other_bounds():
    rng = random.Random(5)
    for _ in range(60):
        words = [b"%d" % rng.randrange(2) for _ in range(rng.randrange(120))]
        for least, times in ((6, 3), (10, 4), (24, 3)):
            found = P.document_runs([words], least, times).get(0)
            rows = [] if found is None else [tuple(r) for r in found.tolist()]
            assert rows == plain_runs(words, least, times)
    with pytest.raises(ValueError):
        P.find_runs(None, times=2)


def test_gram_size_is_safe():
    for least, times in ((24, 3), (6, 3), (10, 4), (1, 3)):
        size = P.gram_size(least, times)
        for q in range(1, 60):
            assert max(least, times * q) >= 2 * q + size - 1


def test_long_repetition_in_linear_time():
    words = [b"%d" % (i % 5000) for i in range(200_000)]
    found = P.document_runs([words])
    assert found[0].tolist() == [[0, 200_000, 5000]]
    assert P.document_runs([[b"a"] * 100_000])[0].tolist() == [[0, 100_000, 1]]


def test_query_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(plain_row(r.doc_id, r.text) for r in docs.where("length(text) < 9000").collect())
    rows = P.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    short = {row[0] for row in want}
    assert sorted(tuple(r) for r in rows if r.doc_id in short) == want
    assert len(rows) == docs.count()
    assert sum(r.n_runs for r in rows) > 0


CASES = [
    (1, None, "x"),
    (2, "", "x"),
    (3, " \t\n\x0b\x0c\r ", None),
    (4, "a b " * 30 + "c", "x"),
    (4, "a b " * 30 + "c", "x"),
    (5, "a\xa0b\x1cc " * 30, "x"),  # other white space belongs to words
    (None, "one two three", "x"),
    (6, "y " * 24, "x"),
    (7, "y " * 23, "x"),
    (8, ("p q " * 15) + ("r " * 30) + ("s t " * 15) + "u " + "s t " * 15, "x"),
    (9, "lone", "x"),
    (32, "w x y z " * 40, "x"),
]


def test_edge_cases(spark, tmp_path):
    schema = "doc_id long, text string, runs string"
    frame = spark.createDataFrame(CASES, schema).withColumn("best", F.lit(1))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    rows = P.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted((plain_row(d, t) for d, t, _ in CASES), key=key)


def test_columns_are_carried_and_outputs_win(spark):
    rows = P.find_runs(spark.createDataFrame(CASES, "doc_id long, text string, runs string"))
    assert rows.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    found = {r.doc_id: r for r in rows.collect()}
    assert found[4].collapsed == "a b c" and found[4].runs[0].length == 60
    assert found[1].text is None and found[1].n_words == 0 and found[1].collapsed == ""


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.op13_periodic_runs(spark, str(tmp_path)).collect() == []


def test_long_text(spark, tmp_path):
    text = " ".join(str(i) for i in range(60_000)) + " " + "k l m " * 20_000
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    row = P.op13_periodic_runs(spark, str(tmp_path)).collect()[0]
    assert (row.start, row.length, row.period, row.n_runs) == (60_000, 60_000, 3, 1)
