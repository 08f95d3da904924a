"""The channel against brute force, made disguises, held-out accuracy and edge cases."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from navscore.llm import toxicity_channel as X

WORDS = ["blorkish", "snarfy", "grubbles"]
CLEAN = "the river and a stone was under old bridge while seven people walked home slowly".split()


def made(seed, documents=240):
    """Documents and labels: toxic ones hold an insult, or in part its disguised form."""
    rng = random.Random(seed)
    rows = []
    for d in range(documents):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(6, 40))]
        toxic = d % 5 == 1
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(WORDS))
        rows.append((d, " ".join(words), int(toxic)))
    return rows


DISGUISES = {
    "bl0rkish": "blorkish",
    "bl0rk1sh": "blorkish",
    "bloooorkish": "blorkish",
    "b.l.o.r.k.i.s.h": "blorkish",
    "sn4rfy": "snarfy",
    "$narfy": "snarfy",
    "grubbl3s": "grubbles",
    "gruuubbles": "grubbles",
    "the": "the",
    "12.5": "12.5",
    "1999": "1999",
}


def tables(spark, rows, path):
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, toxicity string")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return docs, labels


@pytest.fixture(scope="module")
def channel(spark):
    docs = spark.createDataFrame([(t,) for _, t, _ in made(1)], "text string")
    return X.train_channel(docs)


def test_source_model_counts_every_trigram(spark, channel):
    texts = [t for _, t, _ in made(1)]
    assert set(channel.alphabet) == {c for t in texts for c in t if c.isalpha()}
    counts = np.zeros((X.CODES,) * 3)
    for text in texts:
        codes = [channel.codes.get(c, 0) for c in text] + [0]
        first = second = 0
        for code in codes:
            if (first, second, code) != (0, 0, 0):
                counts[first, second, code] += 1
            first, second = (second, code) if code else (0, 0)
    assert np.allclose(channel.costs, X.costs_of(counts))


def plain_best(channel, unit):
    """The cheapest of all readings, one by one."""
    best = None
    for choice in itertools.product(*channel.lattice(unit)):
        state, total = 0, 0.0
        for reading, price in choice:
            state, cost = channel.after(state, reading)
            total += price + cost
        total += channel.after(state, " ")[1] if state else 0.0
        if best is None or total < best - 1e-9:
            best = total
    return best


@given(st.text(alphabet="ab1o0s$!. ", min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_viterbi_finds_the_cheapest_reading(channel, unit):
    got = channel.decode(unit)
    costs = []
    for choice in itertools.product(*channel.lattice(unit)):
        if "".join(r for r, _ in choice) == got:
            state, total = 0, 0.0
            for reading, price in choice:
                state, cost = channel.after(state, reading)
                total += price + cost
            costs.append(total + (channel.after(state, " ")[1] if state else 0.0))
    assert min(costs) == pytest.approx(plain_best(channel, unit))


def test_disguises_are_read(channel):
    for written, meant in DISGUISES.items():
        assert channel.read(written) == meant
    assert channel.unspaced("a S N A R F Y day") == "a snarfy day"
    assert channel.unspaced("a a a a") == "a a a a"


def test_restore_keeps_columns(spark, channel):
    rows = spark.createDataFrame(
        [(1, "Some BL0RKISH\tday", "old"), (2, None, "old"), (3, "", "old")],
        "id int, text string, restored string",
    )
    got = X.restore(rows, channel)
    assert got.columns == ["id", "text", "restored"]
    assert {r.id: r.restored for r in got.collect()} == {1: "some blorkish\tday", 2: None, 3: ""}


def test_made_tables(spark, tmp_path):
    rows = made(2, 600)
    disguised = [
        (1000 + i, f"walked home {w} while people walked", 1) for i, w in enumerate(DISGUISES) if i < 8
    ]
    docs, labels = tables(spark, rows + [(d, t, 1) for d, t, _ in disguised], str(tmp_path))
    got = {r.doc_id: r for r in X.op11_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(disguised)
    for d, _, toxic in rows + disguised:
        assert got[d].predicted == toxic and (got[d].score >= 0.5) == (toxic == 1)
    held = {d for d, r in got.items() if r.held_out}
    assert held == {r.doc_id for r in docs.where(X.fold(F.col("doc_id"), 5) == 0).collect()}


def test_labels_of_held_out_documents_have_no_effect(spark, tmp_path):
    rows = made(3)
    docs, labels = tables(spark, rows, str(tmp_path / "a"))
    turned = F.when(X.fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    (tmp_path / "b").mkdir()
    docs.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    labels.withColumn("toxic", turned).write.parquet(str(tmp_path / "b" / "labels.parquet"))
    a = sorted(map(tuple, X.op11_toxicity(spark, str(tmp_path / "a")).collect()))
    assert a == sorted(map(tuple, X.op11_toxicity(spark, str(tmp_path / "b")).collect()))


def test_copies_do_not_make_words_suspicious(spark, tmp_path):
    rows = made(4) + [(5000 + i, "purple lantern tells a snarfy story", 1) for i in range(60)]
    docs, labels = tables(spark, rows, str(tmp_path))
    lexicon = X.train(docs, labels, X.train_channel(docs))
    assert "=snarfy" in lexicon
    assert not {"=purple", "=lantern", "=story", "^purp"} & set(lexicon)
    assert not any(name.startswith("^gru") for name in lexicon)  # one word is no beginning


def test_unlikely_is_no_looser_than_the_exact_tail():
    from math import comb, log

    for t in range(0, 14):
        for f in range(0, 14):
            for rate in (0.1, 0.3):
                n = t + f
                tail = sum(comb(n, k) * rate**k * (1 - rate) ** (n - k) for k in range(t, n + 1))
                if X.unlikely(np.array([t]), np.array([f]), rate, 1000)[0]:
                    assert log(max(tail, 1e-300)) <= log(X.CHANCE / 1000) + 1e-9


def test_edge_cases(spark, tmp_path):
    rows = made(5)
    edge = [(9001, None, None), (9002, "", 0), (9003, " \n ", 1), (None, "snarfy", 1), (9004, "snarfy" * 9000, 0)]
    edge += [(9005, "a 1 " * 20000 + "snarfy", None), (9005, "a 1 " * 20000 + "snarfy", None), (9006, "x1" * 9000, 2)]
    docs, labels = tables(spark, rows + edge, str(tmp_path))
    got = X.op11_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(edge)
    by = {r.doc_id: r for r in got}
    for d in (9001, 9002, 9003):
        assert by[d].score == pytest.approx(X.BASE) and by[d].predicted == 0
    assert by[9005].predicted == 1 and by[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in got)


def test_without_labels_and_rows(spark, tmp_path):
    rows = [(1, "some snarfy text", 0)]
    tables(spark, rows, str(tmp_path / "a"))
    assert [r.score for r in X.op11_toxicity(spark, str(tmp_path / "a")).collect()] == [pytest.approx(X.BASE)]
    tables(spark, [], str(tmp_path / "b"))
    assert X.op11_toxicity(spark, str(tmp_path / "b")).collect() == []


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    got = X.op11_toxicity(spark, path).where("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in got if r.toxic == 1]
    assert len(toxic) > 50
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    clean = [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
