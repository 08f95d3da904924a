"""Runs of periodic words, found from Lyndon roots, and texts without the repetitions.

A run is a stretch of words with a smallest period, repeated at least ``TIMES`` times and at
least ``LEAST`` words long, that no neighbouring word extends. Every run holds a Lyndon word
of its period's length that is the longest Lyndon word at its start, under one order of the
words or under the opposite one. So the longest Lyndon words of all positions under both
orders, extended to either side as far as words at that distance agree, give every run.

*Lyndon lengths.* The first phase of Baier's suffix sorter groups positions by their longest
Lyndon word: groups go from the highest to the lowest; each member of a group hands the
group's word to the nearest earlier position in a lower group, which moves to a new group
right above its old one. When all groups are done a position's group holds the length of its
longest Lyndon word, without any suffix being sorted. The phase runs once for either order.

*Extension.* Blocks of 1, 2, 4 ... words get names, equal for equal blocks; the longest common
extension of two positions is read from the names, for all positions of all texts at once.

*Scope.* Inside a run each string of ``gram_size`` words occurs again one period away. A
stretch in which each such string (by a hash, so equal strings are never missed) occurs twice
in its text, long enough for a run, is analysed; the rest of a text cannot hold a run, and no
run reaches beyond its stretch.

Each text is analysed in the task that reads it; there is no shuffle, so a lost executor costs
its own tasks. Memory follows the longest single text (some hundred bytes a word of its
repetitive stretches); short texts share slices of about two megabytes.

Defined cases: a null or wordless text has no runs and collapses to an empty text; very long
texts are analysed whole; runs that share words are all reported, ties for the strongest run go
to the smallest start, then period; repeated rows give equal results; a null ``doc_id`` is
kept; an empty table gives no rows; other columns are carried by ``find_runs``, where an input
column named like an output gives way, and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navscore.llm.common import byte_slices, table, text_of, words_of

LEAST = 24
TIMES = 3
_ODD = np.uint64(0x9E3779B97F4A7C15)

RUN = T.ArrayType(
    T.StructType(
        [T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")]
    ),
    False,
)
OUTPUTS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", RUN),
        T.StructField("collapsed", T.StringType()),
    ]
)


def lyndon_lengths(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position (Baier's phase one)."""
    ranks = {code: rank for rank, code in enumerate(sorted(set(codes)))}
    group = [ranks[code] for code in codes]
    members: list[list[int]] = [[] for _ in ranks]
    for position, rank in enumerate(group):
        members[rank].append(position)
    length = [1] * len(ranks)
    below = list(range(-1, len(ranks) - 1))
    above = list(range(1, len(ranks) + 1))
    above[-1:] = [-1]
    # node p + 1 stands for position p; a node leads to the nearest open node at or before it
    leads = list(range(len(codes) + 1))
    current = len(ranks) - 1
    while current >= 0:
        inside = [p for p in members[current] if group[p] == current]
        for p in inside:
            leads[p + 1] = p
        receivers: dict[int, int] = {}
        for p in inside:
            node = p
            while leads[node] != node:
                leads[node] = leads[leads[node]]
                node = leads[node]
            if node:
                receivers[node - 1] = receivers.get(node - 1, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, copies in receivers.items():
            moves.setdefault((group[p], copies), []).append(p)
        highest: dict[int, int] = {}
        for (old, copies), moved in sorted(moves.items()):  # more copies rank higher
            under, new = highest.get(old, old), len(length)
            highest[old], upper = new, above[under]
            length.append(length[old] + copies * length[current])
            members.append(moved)
            below.append(under)
            above.append(upper)
            above[under] = new
            below[upper] = new
            for p in moved:
                group[p] = new
        current = below[current]
    return [length[g] for g in group]


class Blocks:
    """Names of all blocks of 1, 2, 4 ... words, for common extensions of many positions."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.names = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
        size = 1
        while 2 * size <= longest:
            last = self.names[-1]
            both = last[:-size] * (int(last.max()) + 1) + last[size:]
            self.names.append(np.unique(both, return_inverse=True)[1])
            size *= 2

    def _agree(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        names = self.names[level]
        inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < len(names))
        return inside & (names[np.where(inside, a, 0)] == names[np.where(inside, b, 0)])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from ``a`` and ``b`` on."""
        done = np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.names))):
            done += self._agree(level, a + done, b + done).astype(np.int64) << level
        return done

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words up to and with ``a`` and ``b``."""
        done = np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.names))):
            back = done + (1 << level) - 1
            done += self._agree(level, a - back, b - back).astype(np.int64) << level
        return done


def runs_of(stretches: list[list], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The runs of each list of words as rows (start, length, period), by start, then period."""
    if not stretches:
        return []
    names: dict = {}
    codes, roots, where = [], [], []
    at = 0
    for number, words in enumerate(stretches):
        own = [names.setdefault(word, len(names)) for word in words]
        for signed in (own, [-code for code in own]):
            found = np.array(lyndon_lengths(signed), np.int64)
            fits = np.flatnonzero(found * times <= len(own))
            roots.append(np.c_[fits + at, found[fits], np.full(len(fits), number)])
        codes.append(np.array(own + [-1 - number], np.int64))  # an end of its own
        where.append(at)
        at += len(own) + 1
    start, period, number = np.unique(np.concatenate(roots), axis=0).T
    blocks = Blocks(np.concatenate(codes), max(map(len, stretches)))
    after = blocks.forward(start, start + period)
    before = blocks.backward(start - 1, start + period - 1)
    length = before + period + after
    long = length >= np.maximum(least, times * period)
    rows = np.unique(
        np.c_[number, start - before - np.array(where)[number], length, period][long], axis=0
    )
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(stretches) + 1))
    return [rows[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:])]


def gram_size(least: int, times: int) -> int:
    """Words of the longest string that, inside any run, occurs again one period away."""
    return 1 + min(max(least - 2 * q, (times - 2) * q) for q in range(1, least + 1))


def repetitive(
    documents: list[list[bytes]], least: int = LEAST, times: int = TIMES
) -> list[tuple[int, int, int]]:
    """Stretches (document, begin, end) that may hold runs."""
    sizes = np.array([len(words) for words in documents], np.int64)
    size = gram_size(least, times)
    count = int(sizes.sum()) - size + 1
    if count <= 0:
        return []
    hashes = np.fromiter(
        (hash(word) for words in documents for word in words), np.int64, int(sizes.sum())
    ).view(np.uint64)
    grams = np.zeros(count, np.uint64)
    for shift in range(size):
        grams = grams * _ODD + hashes[shift : shift + count]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(owner[:count] == owner[size - 1 :])
    keys = (grams[whole] ^ (grams[whole] >> np.uint64(32))) * _ODD + owner[whole].astype(np.uint64)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    marked = whole[np.isin(keys, twice)]
    head = np.flatnonzero(np.r_[True, np.diff(marked) > 1])
    tail = np.r_[head[1:], len(marked)] - 1
    begin, end = marked[head], marked[tail] + size
    long = end - begin >= least
    first = np.cumsum(sizes) - sizes
    document = owner[begin[long]]
    return list(
        zip(
            document.tolist(),
            (begin[long] - first[document]).tolist(),
            (end[long] - first[document]).tolist(),
        )
    )


def document_runs(
    documents: list[list[bytes]], least: int = LEAST, times: int = TIMES
) -> dict[int, np.ndarray]:
    """The runs of each document that has any, in word numbers of the document."""
    stretches = repetitive(documents, least, times)
    found: dict[int, list[np.ndarray]] = {}
    parts = runs_of([documents[d][a:b] for d, a, b in stretches], least, times)
    for (document, begin, _), rows in zip(stretches, parts):
        if len(rows):
            found.setdefault(document, []).append(rows + np.array([begin, 0, 0]))
    return {document: np.concatenate(rows) for document, rows in found.items()}


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds behind its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and the ``collapsed`` text of its column ``text``."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not supported")
    kept = [name for name in docs.columns if name not in OUTPUTS.fieldNames()]
    where = kept.index("text")
    run_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in byte_slices(batch, where):
                # a split of bytes is at ASCII white space, which is what separates words
                words = [
                    text.encode().split() if text else [] for text in rows.column(where).to_pylist()
                ]
                found = document_runs(words, least, times)
                spans = [found[d].tolist() if d in found else [] for d in range(len(words))]
                texts = [
                    b" ".join(collapse(w, found[d]) if d in found else w).decode()
                    for d, w in enumerate(words)
                ]
                runs = [
                    [{"start": s, "length": n, "period": q} for s, n, q in rows] for rows in spans
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array(runs, run_type),
                        pa.array(texts, pa.string()),
                    ],
                    [*kept, *OUTPUTS.fieldNames()],
                )

    schema = T.StructType([docs.schema[name] for name in kept] + list(OUTPUTS))
    return docs.select(*kept).mapInArrow(solve, schema)


def with_repetitions(doc_id: Column, text: Column) -> Column:
    """The text, repeated from some word on in a tenth of all documents (the query's rule)."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.transform(
            words,
            lambda word, i: F.when(i < a, word).otherwise(
                F.get(words, (a + (i - a) % p).cast("int"))
            ),
        )

    # the array is named once for the row; a wordless text has no word to repeat
    whole = F.array_join(F.flatten(F.transform(F.array(words_of(text)), repeated)), " ")
    return F.when(h % 10 == 0, whole).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, its strongest run, and the text without repetitions."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        with_repetitions(F.col("doc_id"), text_of()).alias("text"),
    )
    # more copies first: length / period compared as whole part and rest, both exact
    strength = F.array_sort(
        "runs",
        lambda a, b: F.coalesce(
            F.nullif(
                F.signum(
                    b["length"] * a["period"] - a["length"] * b["period"]
                ).cast("int"),
                F.lit(0),
            ),
            F.nullif(F.signum(a["start"] - b["start"]).cast("int"), F.lit(0)),
            F.signum(a["period"] - b["period"]).cast("int"),
        ),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    found = find_runs(docs).select("*", F.get(strength, F.lit(0)).alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(
            F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256
        ).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
