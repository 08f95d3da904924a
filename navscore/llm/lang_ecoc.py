"""Language identification with error-correcting output codes.

Each language has a codeword of bits. One binary classifier per bit, over hashed byte
n-grams of the letters of a text, says how strongly the text is on the bit's side. Decoding
adds for every language the loss of each bit of its codeword, weighted by how reliable the
bit was in training, and takes the smallest sum; when the runner-up is close, the text is
flagged as ambiguous.

Training uses a bounded sample: at most about ``SAMPLE`` labelled documents, the same number
for each language, chosen by a hash of the id over the whole table. Their n-gram counts are
made on the executors; the driver fits the bits. Scoring maps over whole texts without a
shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0; with no
labelled row everything is ``und``; a single language is predicted for all; null labels are
never used; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navscore.llm.common import fold, labelled_sample, text_of

SAMPLE = 2000
SLOTS = 4096
STEPS = 60
AMBIGUOUS = 0.5  # difference in weighted loss below which two languages are close
UNDETERMINED = "und"
PART = 1 << 20  # bytes of a text that are hashed together

_LETTER = regex.compile(r"\p{L}")  # letters only: no fractions, circled or Roman numbers
_FOLD = bytes(
    c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 4-grams of bytes; length one."""
    data = b" " + text.lower().encode().translate(_FOLD) + b" "
    counts = np.zeros(SLOTS)
    for start in range(0, len(data), PART):
        part = np.frombuffer(data[start : start + PART + 3], np.uint8).astype(np.uint32)
        gram = part
        for size in range(1, 4):
            gram = (gram[:-1] << np.uint32(8)) | part[size:]
            mixed = gram * np.uint32(2654435761) + np.uint32(size)
            counts += np.bincount((mixed >> np.uint32(7)) % SLOTS, minlength=SLOTS)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 per language: every split for few languages, chosen ones for many."""
    if languages <= 5:
        splits = itertools.product((1, -1), repeat=languages - 1)
        return np.array([(1, *s) for s in splits if -1 in s]).T.reshape(languages, -1)
    rng = np.random.default_rng(17)
    bits = int(np.ceil(10 * np.log2(languages)))
    best, widest = None, -1
    for _ in range(200):
        code = rng.choice((1, -1), size=(languages, bits))
        apart = (bits - code @ code.T) // 2 + np.eye(languages, dtype=int) * bits
        useful = (np.abs(code.sum(axis=0)) < languages).all()
        if useful and apart.min() > widest:
            best, widest = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # (SLOTS + 1) x bits, the last row is the intercept
    trust: np.ndarray  # weight of each bit

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights[:-1] + self.weights[-1]
        per_bit = np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust
        return per_bit.sum(axis=2)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, score, and whether another language is close."""
        losses = self.losses(x)
        share = np.exp(losses.min(axis=1, keepdims=True) - losses)
        best = losses.argmin(axis=1)
        score = share.max(axis=1) / share.sum(axis=1)
        if losses.shape[1] == 1:
            return best, score, np.zeros(len(best), bool)
        two = np.partition(losses, 1, axis=1)
        return best, score, two[:, 1] - two[:, 0] < AMBIGUOUS


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Regularised logistic regression for each bit of the code."""
    languages = sorted(set(labels))
    code = codewords(len(languages)) if len(languages) > 1 else np.ones((1, 1))
    target = code[[languages.index(name) for name in labels]].astype(np.float32)
    share = np.array([labels.count(name) for name in languages]) / len(labels)
    cost = 1 / (share[[languages.index(name) for name in labels]] * len(languages))
    cost = cost.astype(np.float32)
    weights = np.zeros((SLOTS + 1, code.shape[1]), np.float32)
    speed = np.zeros_like(weights)
    wide = np.c_[x, np.ones(len(x))].astype(np.float32)
    for _ in range(STEPS if len(languages) > 1 else 0):
        ahead = weights + 0.9 * speed
        slope = -target / (1 + np.exp(np.clip(target * (wide @ ahead), -50, 50)))
        step = wide.T @ (slope * cost[:, None]) / len(x) + 1e-5 * ahead
        speed = 0.9 * speed - 4.0 * step
        weights = weights + speed
    right = ((wide @ weights) * target > 0).mean(axis=0)
    trust = np.clip(right - 0.5, 0.01, None)
    return Model(languages, code, weights, trust / trust.sum() * len(trust))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model of the languages of a bounded, hashed sample of ``docs`` (``text``, ``lang``)."""
    rows = docs.where("lang is not null").select("doc_id", "lang", "text")
    kinds = rows.select("lang").distinct().count()
    if not kinds:
        return None
    order = F.xxhash64("doc_id", "text")
    chosen = labelled_sample(rows, "lang", max(1, sample // kinds), order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = features(batch.column("text")[row].as_py() or "").astype(np.float32)
                if found.any():
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("lang").slice(row, 1), pa.array([found.tobytes()])], ["lang", "x"]
                    )

    # repeated rows of the sample are one; after that its size is bounded
    found = chosen.select("lang", "text").mapInArrow(count, "lang string, x binary")
    got = found.distinct().orderBy("lang", "x").collect()
    if not got:
        return None
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in got])
    return fit(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)``, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t")
            names, scores, close = [], [], []
            for low in range(0, len(texts), 256):
                some = texts[low : low + 256].to_pylist()
                spoken = [bool(model and _LETTER.search(t)) for t in some]
                said = [t for t, yes in zip(some, spoken) if yes]
                found = iter(())
                if said:
                    best, score, near = model.predict(np.array([features(t) for t in said]))
                    found = zip([model.languages[k] for k in best], score.tolist(), near.tolist())
                for yes in spoken:
                    name, score, near = next(found) if yes else (UNDETERMINED, 0.0, True)
                    names.append(name)
                    scores.append(score)
                    close.append(near)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(close, pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")
    ).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the folds that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held_out))
    return predict(docs, model).withColumn("held_out", held_out)
