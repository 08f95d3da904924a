import random
import re
from hashlib import sha256

import pytest

import __spark_entry__ as entry
from navscore.llm import decontaminate as D
from navscore.llm import quality_rules as R
from navscore.llm import queries
from tests import compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert compare.difference(spark, compare.connect(SF_DIR), SF_DIR, name) is None


def test_registered(spark):
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


# -- rules


def plain_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(hit),
    )


TEXTS = [
    None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "x x x x x", "l\nl\n\n \nl", "é ü é ü é ü",
    "a\x0bb\x0cc\rd", "日本 語", "# | <b>", " lead and trail ",
]


def test_measures_against_plain_python(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices("abcd", k=rng.randint(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame(
        [(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int"
    )
    got = {r.doc_id: r for r in R.ledger(docs).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words
        ) == plain_measures(text)


def test_long_text_nulls_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(100_000)) + " w1 w2 w3"
    docs = spark.createDataFrame([(None, long), (1, None), (1, None)], "doc_id long, text string")
    rows = R.ledger(docs).collect()
    assert sorted(r.n_repeat_words for r in rows) == [0, 0, 6]
    assert R.ledger(docs.limit(0)).collect() == []


def test_policies_and_ablations(spark):
    rows = spark.createDataFrame([(b,) for b in (0, 1, 1, 2, 3, 4, 32)], "failed long")
    assert rows.where(R.verdict("base")).count() == 3
    assert rows.where(R.verdict("v2")).count() == 1
    found = {r.rule: (r.n_failed, r.n_failed_alone) for r in R.ablations(rows, "base").collect()}
    assert found == {"few_words": (3, 2), "repeated_words": (2, 1)}


# -- decontamination


def plain_hits(text, items):
    def words(t):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), 10)
        for j in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), found


ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog and then some more words follow"),
    (2, "Short item"), (3, ""), (4, None), (5, "one"), (10, "short ITEM"),
    (11, "a b c d e f g h i j"), (11, "a b c d e f g h i j"), (None, "nobody knows this one item"),
]
DOCS = [
    (1, "The quick-brown fox, jumps over the lazy dog AND then some"), (2, None), (3, ""),
    (4, "a short item and a short item"), (5, "a b c d e f g h i j k"), (5, "a b c d e f g h i j k"),
    (None, "one"), (7, "a b c d e f g h i"), (8, "nobody knows this one item"), (9, "x1 é one2"),
]


@pytest.fixture
def small(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, items string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("bound", [400, 1 << 26])
def test_hits_against_plain_python(small, monkeypatch, bound):
    monkeypatch.setattr(D, "BROADCAST_BYTES", bound)
    docs, items = small
    got = {(r.doc_id, r.text): r for r in D.mark(docs, items).collect()}
    for doc_id, text in DOCS:
        _, n_hit, found = plain_hits(text, ITEMS)
        r = got[doc_id, text]
        assert len(r.hit_positions) == n_hit
        assert set(r.hit_items) == found - {None}


def test_parts_are_bounded_in_bytes(small, monkeypatch):
    windows = D.benchmark_windows(small[1])
    assert D.parts_of(windows) == 1
    monkeypatch.setattr(D, "BROADCAST_BYTES", 400)
    assert D.parts_of(windows) > 3


def test_columns_with_names_of_helpers(small):
    docs, items = small
    docs = docs.selectExpr("*", "1 as hit_doc", "2 as HIT_KEY", "3 as hit_items", "4 as w")
    marked = D.mark(docs, items)
    assert marked.columns == [*[c for c in docs.columns if c != "hit_items"], "hit_positions", "hit_items"]
    assert {(r.hit_doc, r.HIT_KEY, r.w) for r in marked.collect()} == {(1, 2, 4)}
    kept = D.drop_documents(docs, items)
    assert kept.columns == docs.columns and {r.hit_items for r in kept.collect()} == {3}


def test_documents_and_spans_removed(small):
    docs, items = small
    kept = D.drop_documents(docs, items).collect()
    assert len(D.mark(docs, items).collect()) == len(DOCS)
    clean = [d for d in DOCS if plain_hits(d[1], ITEMS)[1] == 0]
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted((d, t or "") for d, t in clean)
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, items).collect()}
    assert cut[4] == "a   and a  "
    assert cut[9] == "x1 é one2" and cut[2] is None


def test_empty_tables(small):
    docs, items = small
    assert D.mark(docs.limit(0), items).collect() == []
    assert D.drop_documents(docs, items.limit(0)).count() == len(DOCS)


def test_digest_of_items(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in D.op4_decontamination(spark, str(tmp_path)).collect()}
    assert got[4].items_sha256 == sha256(b"10,2").hexdigest()
    assert got[3].items_sha256 == sha256(b"").hexdigest()
    assert (got[4].n_words, got[4].n_hit, got[4].n_items, got[4].contaminated) == (7, 4, 2, True)
