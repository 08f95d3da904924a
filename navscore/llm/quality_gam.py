"""Quality classifier: generalised additive model with pairwise interactions.

The score of a text is the sum of one table lookup per feature and one per chosen pair of
features, through the logistic function. Tables are learnt by cyclic boosting: feature after
feature, round after round, a shallow tree is fitted to the current gradient on that
feature's bins and added to its table. Pairs with the largest remaining gain are boosted the
same way on a coarse grid. Scoring is a search for the bin and an addition per table, for
all texts of a batch at once.

Training uses a bounded sample of labelled documents, about ``SAMPLE`` of each label chosen
by a hash of the id; the driver receives their features only. Scoring maps over whole texts
without a shuffle.

Defined cases: null and empty texts are scored on zero features; without labels every score
is 0.5; a repeated ``doc_id`` gives one training
row, with the lower label where they differ; repeated documents are scored alike;
a null ``doc_id`` has no label; very long texts are scored whole; an empty table gives no rows;
``score`` keeps every column of its input but one named like its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from navscore.llm.common import byte_slices, fold, labelled_sample

SAMPLE = 4000
THRESHOLD = 0.7
BINS = 32
GRID = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.1
LEAST = 8  # rows on each side of a cut

FEATURES = (
    "log_words",
    "word_length",
    "distinct_words",
    "top_word",
    "repeated_pairs",
    "repeated_lines",
    "line_words",
    "capitals",
    "symbols",
    "exclamations",
    "other_marks",
    "digits",
    "spaces",
    "non_ascii",
)
_CLASS = np.zeros((256, 7))
for _c in range(256):
    _CLASS[_c] = (
        65 <= _c <= 90,
        chr(_c) in "#*$%&|<>",
        _c == 33,
        chr(_c) in "\"'()+-/:;=?@[\\]^_`{}~",
        48 <= _c <= 57,
        _c in (9, 10, 11, 12, 13, 32),
        _c >= 128,
    )


def features(text: str | None) -> np.ndarray:
    """The features of a whole text."""
    data = (text or "").encode()
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / max(len(data), 1)
    words = data.split()
    n = len(words)
    if not n:
        return np.r_[np.zeros(7), shares]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    lines = [line for line in data.split(b"\n") if line.strip()]
    return np.r_[
        np.log1p(n),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values()) / n,
        1 - pairs / (n - 1) if n > 1 else 0,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        shares,
    ]


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)  # per feature, bin borders
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1
        )

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if not self.edges:
            return total
        at = self.bins(x)
        for k, table in enumerate(self.tables):
            total += table[at[:, k]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[at[:, a] * GRID // BINS, at[:, b] * GRID // BINS]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def _cuts(g: np.ndarray, h: np.ndarray, n: np.ndarray, cuts: int = 2) -> np.ndarray:
    """Value per bin of a tree with ``cuts`` splits, grown on sums over the bins."""
    segments = [(0, len(g))]

    def gain(low: int, high: int) -> tuple[float, int]:
        left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
        left_n = np.cumsum(n[low:high])[:-1]
        right_g, right_h = g[low:high].sum() - left_g, h[low:high].sum() - left_h
        right_n = n[low:high].sum() - left_n
        if not len(left_g):
            return 0.0, low
        value = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
        value -= (left_g + right_g) ** 2 / (left_h + right_h + 1)
        value[(left_n < LEAST) | (right_n < LEAST)] = 0
        best = int(value.argmax())
        return float(value[best]), low + best + 1

    for _ in range(cuts):
        (best, at), k = max((gain(*s), k) for k, s in enumerate(segments))
        if best <= 1e-9:
            break
        low, high = segments.pop(k)
        segments += [(low, at), (at, high)]
    out = np.zeros(len(g))
    for low, high in segments:
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of a grid into four by one border in each direction: gain and values."""
    best, values = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(GRID - 1):
        for j in range(GRID - 1):
            parts = []
            for table in (cg, ch):
                a, rows, columns, total = table[i, j], table[i, -1], table[-1, j], table[-1, -1]
                parts.append(np.array([a, rows - a, columns - a, total - rows - columns + a]))
            value = (parts[0] ** 2 / (parts[1] + 1)).sum() - parts[0].sum() ** 2 / (parts[1].sum() + 1)
            if value > best:
                leaf = parts[0] / (parts[1] + 1)
                best, values = value, np.zeros_like(g)
                values[: i + 1, : j + 1], values[: i + 1, j + 1 :] = leaf[0], leaf[1]
                values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf[2], leaf[3]
    return best, values


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Cyclic boosting of tables, then of tables for the pairs with the largest gain."""
    model = Model()
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    model.intercept = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return model
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, k], quantiles)) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = model.bins(x)
    raw = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return weight * (y - p), weight * p * (1 - p)

    counts = [np.bincount(at[:, k], minlength=len(t)) for k, t in enumerate(model.tables)]
    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _cuts(
                np.bincount(at[:, k], g, len(table)), np.bincount(at[:, k], h, len(table)), counts[k]
            )
            table += step
            raw += step[at[:, k]]

    def grid(a: int, b: int, values: np.ndarray) -> np.ndarray:
        cell = (at[:, a] * GRID // BINS) * GRID + at[:, b] * GRID // BINS
        return np.bincount(cell, values, GRID * GRID).reshape(GRID, GRID)

    g, h = slopes()
    gains = sorted(
        (
            (_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b)
            for a in range(x.shape[1])
            for b in range(a)
        ),
        reverse=True,
    )
    model.pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((GRID, GRID)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            table += step
            raw += step[at[:, a] * GRID // BINS, at[:, b] * GRID // BINS]
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from a bounded sample of ``labels`` (``doc_id``, ``quality``)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality")
    )
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = labelled_sample(known, "quality", sample, F.col("doc_id"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.list_(pa.float64()))],
                ["doc_id", "quality", "x"],
            )

    # the sample is bounded by its parameter, so it may be sent to every task
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
        .mapInArrow(measure, "doc_id long, quality int, x array<double>")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
        .orderBy("doc_id").collect()
    )
    if not rows:
        return Model()
    x = np.array([r["x"] for r in rows])
    y = np.array([r["quality"] for r in rows], dtype=float)
    # back to the shares of the labels in the whole table
    weight = np.ones(len(y))
    for value in (0, 1):
        if (y == value).any():
            weight[y == value] = sizes[value] / (y == value).sum()
    return fit(x, y, weight / weight.mean())


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with the column ``name``; an input column of that name gives way."""
    docs = docs.drop(name)
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in byte_slices(batch, where):
                texts = rows.column(where).to_pylist()
                x = np.array(list(map(features, texts))).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(model.score(x), pa.float64())],
                    [*rows.schema.names, name],
                )

    return docs.mapInArrow(run, docs.select("*").schema.add(name, DoubleType()))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from the folds that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
