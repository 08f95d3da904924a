"""Toxicity of texts whose words may be disguised: a noisy channel, then a lexicon.

*Source model.* A character trigram model of lower-case words, from counts over all documents:
one pass counts characters, whose most frequent letters become the alphabet, a second one the
trigrams over that alphabet. Tasks send sums per trigram; the model has ``CODES ** 3`` numbers
whatever the corpus holds.

*Channel.* A token that is not plain letters becomes a lattice. Each written character stands
for itself or, at a cost, for letters that look alike; three or more equal letters stand for
themselves, for two or for one; separators inside a row of single characters (``i.d.i.o.t``,
``i d i o t``) stand for themselves or for nothing. Viterbi decoding under the source model
finds the cheapest reading. A token of plain letters has one path only and is its own reading.

*Score.* Words and beginnings of words of the restored texts form a lexicon. From a bounded
sample of labelled documents (``SAMPLE`` of each label) come the expressions that are more
frequent in toxic ones; all labelled documents then decide which of them hold. A document
counts once for an expression, with the words around its first occurrence; in toxic documents
equal surroundings count once, so copies of a text do not make its words suspicious. An
expression stays if chance explains its counts with a probability below ``CHANCE`` for the whole
lexicon; a beginning must also be shared by ``SEVERAL`` different words of toxic documents.
A document's score joins the odds of its distinct toxic words; without any it is ``BASE``.

Scoring maps over whole texts without a shuffle. The readings of tokens are kept in a memo of
bounded bytes, emptied when full.

Defined cases: null and empty texts score ``BASE``; without toxic labels the lexicon is empty
and every text scores ``BASE``; a repeated ``doc_id`` in the labels counts once, with the lower
label where they differ; labels other than 0 and 1 and null ids are left out; ties between
readings go to the one that is listed first, the text as written; repeated rows score alike;
very long texts and tokens are read whole, in time linear in their length; an empty table gives
no rows; other columns are carried by ``restore`` and ``score``, where an input column named
like the output gives way.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navscore.llm.common import byte_slices, fold, labelled_sample, table, text_of
from navscore.llm.phrase_tries import bitmap, bits_of

SAMPLE = 2000  # labelled documents of each label that propose expressions
CANDIDATES = 100_000  # the most frequent proposals that are tested on all labelled documents
LEAST = 4
SEVERAL = 3
CHANCE = 0.1
THRESHOLD = 0.5
BASE = 0.02
PRIOR = 2.0

CODES = 64  # boundary, other letters, and the most frequent letters
BOUNDARY, OTHER = 0, 1
WEIGHTS = (0.7, 0.2, 0.09)  # of trigrams, bigrams and single characters

# Costs of the channel in nats.
LOOKS_ALIKE = 2.0
REPEATED = 1.0
SEPARATED = 0.5
SYMBOL = 6.0  # of any character but a letter or space inside a unit

#: What characters are written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l",
}
SEPARATORS = " .-_*~'"
_PUNCTUATION = ".,;:?\"'()[]{}<>*-_~"
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_LETTERED = re.compile(rf"[^\W_](?:[{re.escape(SEPARATORS)}]+[^\W_]){{2,}}\Z")
_RUNS = re.compile(r"(.)\1*", re.DOTALL)
_TRIPLE = re.compile(r"(.)\1\1", re.DOTALL)
_WORDS = re.compile(r"[^\W\d_]+")

PREFIXES = range(3, 9)
WHOLE = 64  # longer words are known by their beginnings only
MEMO_BYTES = 64 << 20


@dataclass
class Channel:
    """The alphabet and the cost of each trigram; without them letters cost the same."""

    alphabet: str = ""
    costs: np.ndarray = field(default_factory=lambda: np.full(CODES**3, math.log(CODES)))

    def __post_init__(self) -> None:
        self.codes = {c: i + 2 for i, c in enumerate(self.alphabet)}
        self._cost: list[float] = []

    def lattice(self, unit: str) -> list[list[tuple[str, float]]]:
        """The readings of each written character or run of them, with their costs."""
        lettered = _LETTERED.match(unit) is not None
        found = []
        for run in _RUNS.finditer(unit):
            char, size = run.group(1), run.end() - run.start()
            readings = [(char * size, 0.0)]
            if lettered and char in SEPARATORS:
                readings.append(("", SEPARATED))
            elif size > 2 and char.isalpha():
                readings += [(char * 2, REPEATED), (char, REPEATED)]
            elif char in LEET:
                if size == 1:
                    readings += [(letter, LOOKS_ALIKE) for letter in LEET[char]]
                else:
                    readings += [(letter, LOOKS_ALIKE + REPEATED) for letter in LEET[char]]
                    if size == 2:
                        readings += [(letter * 2, 2 * LOOKS_ALIKE) for letter in LEET[char]]
            found.append(readings)
        return found

    def after(self, state: int, reading: str) -> tuple[int, float]:
        """State and cost behind a reading; a state is two codes, a boundary clears it."""
        if not self._cost:
            self._cost = self.costs.tolist()
        cost = 0.0
        for char in reading:
            if char.isalpha():
                code = self.codes.get(char, OTHER)
                cost += self._cost[state * CODES + code]
                state = state % CODES * CODES + code
            else:
                cost += (char != " ") * SYMBOL + (self._cost[state * CODES] if state else 0.0)
                state = 0
        return state, cost

    def decode(self, unit: str) -> str:
        """The cheapest reading of a unit, by Viterbi."""
        open_: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for readings in self.lattice(unit):
            best: dict[int, tuple[float, tuple]] = {}
            for state, (spent, path) in open_.items():
                for reading, price in readings:
                    to, cost = self.after(state, reading)
                    total = spent + price + cost
                    if to not in best or total < best[to][0]:
                        best[to] = (total, (path, reading))
            open_ = best
        ends = [
            (spent + (self._cost[state * CODES] if state else 0.0), path)
            for state, (spent, path) in open_.items()
        ]
        path = min(ends, key=lambda end: end[0])[1]
        parts = []
        while path:
            path, reading = path
            parts.append(reading)
        return "".join(reversed(parts))

    def read(self, token: str) -> str:
        """The reading of a token without white space, in lower case."""
        if token.isalpha() and not _TRIPLE.search(token):
            return token
        inner = token.strip(_PUNCTUATION)
        if inner.isalpha() and not _TRIPLE.search(inner):
            return token
        head = token.find(inner) if inner else 0
        if not any(c.isalpha() for c in inner):
            return token
        return token[:head] + self.decode(inner) + token[head + len(inner) :]

    def unspaced(self, text: str) -> str:
        """The text in lower case with rows of single characters read as units."""
        return _SPACED.sub(lambda row: self.decode(row.group().replace("\t", " ")), text.lower())

    def tokens(self, text: str) -> list[str]:
        """The tokens of ``unspaced(text)``."""
        found = text.lower().split()
        single = np.fromiter(map(len, found), np.int64, len(found)) == 1
        if (single[:-2] & single[1:-1] & single[2:]).any():
            return self.unspaced(text).split()
        return found


class Reader:
    """Readings of tokens by a channel, each taken through ``use`` once and remembered."""

    def __init__(self, channel: Channel, use):
        self.channel, self.use = channel, use
        self.known: dict[str, object] = {}
        self.size = 0

    def of(self, token: str):
        found = self.known.get(token)
        if found is None:
            found = self.use(self.channel.read(token))
            if len(token) <= 256:
                self.size += 2 * len(token) + 200
                if self.size > MEMO_BYTES:
                    self.known, self.size = {}, 2 * len(token) + 200
                self.known[token] = found
        return found


class Sieve:
    """Tokens that may hold one of some expressions; the others are remembered and skipped."""

    def __init__(self, channel: Channel, names) -> None:
        self.channel = channel
        # an expression shorter than the shortest beginning is a whole word
        self.heads = {name[1 : 1 + PREFIXES[0]] for name in names}
        self.clean: set[str] = set()
        self.size = 0

    def of(self, tokens: list[str]) -> list[str]:
        """The tokens, each once, in the order of the alphabet."""
        found = []
        for token in sorted(set(tokens) - self.clean):
            if any(w[: PREFIXES[0]] in self.heads for w in _letters(self.channel.read(token))):
                found.append(token)
            elif len(token) <= 256:
                self.size += 2 * len(token) + 100
                if self.size > MEMO_BYTES:
                    self.clean, self.size = set(), 2 * len(token) + 100
                self.clean.add(token)
        return found


def _letters(text: str) -> tuple[str, ...]:
    return tuple(_WORDS.findall(text))


def _points(texts: list[str]) -> np.ndarray:
    """Code points of texts in lower case, a space between two texts."""
    joined = "\n".join(texts).lower().encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32)


def _sums(values: np.ndarray, name: str) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int64()), pa.array(values[at], pa.int64())], [name, "n"]
    )


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[list[str]]:
    for rows in byte_slices(batch, column):
        yield [text or "" for text in rows.column(column).to_pylist()]


def train_channel(docs: DataFrame) -> Channel:
    """The source model of all texts of ``docs``."""
    texts = docs.select(text_of().alias("t"))

    def characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(0x110000, np.int64)
        for batch in batches:
            for some in _texts(batch, 0):
                found = np.bincount(_points(some))
                totals[: len(found)] += found
        yield _sums(totals, "point")

    counted = texts.mapInArrow(characters, "point long, n long")
    counted = counted.groupBy("point").agg(F.sum("n").alias("n")).where("point > 64")
    # letters only, found among the few hundred most frequent characters
    common = counted.orderBy(F.desc("n"), "point").limit(8 * CODES).collect()
    letters = [chr(r["point"]) for r in common if chr(r["point"]).isalpha()]
    alphabet = "".join(letters[: CODES - 2])

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.zeros(0x110000, np.uint8)
        codes[[i for i in range(0x110000) if chr(i).isalpha()]] = OTHER
        codes[[ord(c) for c in alphabet]] = np.arange(len(alphabet)) + 2
        totals = np.zeros(CODES**3, np.int64)
        for batch in batches:
            for some in _texts(batch, 0):
                third = np.r_[codes[_points(some)], BOUNDARY].astype(np.int32)
                second = np.r_[BOUNDARY, third[:-1]].astype(np.int32)
                first = np.where(second == BOUNDARY, BOUNDARY, np.r_[0, second[:-1]])
                totals += np.bincount((first * CODES + second) * CODES + third, minlength=CODES**3)
        totals[0] = 0  # boundary after boundary
        yield _sums(totals, "gram")

    counted = texts.mapInArrow(trigrams, "gram long, n long")
    rows = counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()  # at most CODES ** 3
    counts = np.zeros(CODES**3)
    for row in rows:
        counts[row["gram"]] = row["n"]
    return Channel(alphabet, costs_of(counts.reshape(CODES, CODES, CODES)))


def costs_of(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of trigrams, mixed with bigrams, characters and a floor."""

    def shares(n: np.ndarray) -> np.ndarray:
        return n / np.maximum(n.sum(-1, keepdims=True), 1)

    three, two, one = shares(counts), shares(counts.sum(0)), shares(counts.sum((0, 1)))
    mixed = WEIGHTS[0] * three + WEIGHTS[1] * two[None] + WEIGHTS[2] * one[None, None]
    return -np.log(mixed + (1 - sum(WEIGHTS)) / CODES).ravel()


def _added(docs: DataFrame, name: str, kind: T.DataType, compute) -> DataFrame:
    """``docs`` with a column computed from the texts of a slice."""
    kept = [column for column in docs.columns if column != name]
    where = kept.index("text")
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in batches:
            for rows in byte_slices(batch, where):
                values = pa.array([work(t) for t in rows.column(where).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*rows.columns, values], [*kept, name])

    schema = T.StructType([docs.schema[column] for column in kept] + [T.StructField(name, kind)])
    return docs.select(*kept).mapInArrow(run, schema)


def restore(docs: DataFrame, channel: Channel) -> DataFrame:
    """``docs`` with the column ``restored``: the text in lower case as it is meant."""

    def compute():
        reader = Reader(channel, str)
        pattern = re.compile(r"\S+")
        return lambda text: (
            None if text is None else pattern.sub(lambda t: reader.of(t.group()), channel.unspaced(text))
        )

    return _added(docs, "restored", T.StringType(), compute)


def expressions(word: str) -> list[str]:
    """What a word may be known by: itself and its beginnings."""
    found = [f"={word}"] if len(word) <= WHOLE else []
    return found + [f"^{word[:size]}" for size in PREFIXES if size <= len(word)]


def _occurrences(channel: Channel, wanted):
    """For each document its wanted expressions with a hash of the words around the first
    occurrence; ``wanted`` None takes all."""

    def of(word: str) -> list[str]:
        every = expressions(word)
        return every if wanted is None else [e for e in every if e in wanted]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(channel, _letters)
        sieve = None if wanted is None else Sieve(channel, wanted)
        known: dict[str, list[str]] = {}
        for batch in batches:
            for rows in byte_slices(batch, 1, 1 << 20):
                number, names, around, forms = [], [], [], []
                for row, text in enumerate(rows.column(1).to_pylist()):
                    tokens = channel.tokens(text)
                    if sieve is not None and not sieve.of(tokens):
                        continue
                    words = [w for t in tokens for w in reader.of(t)]
                    first: dict[str, int] = {}
                    for i, word in enumerate(words):
                        if word not in first:
                            first[word] = i
                    seen: set[str] = set()
                    if len(known) > 200_000:
                        known = {}
                    for word, i in first.items():
                        if word not in known:
                            known[word] = of(word)
                        for name in known[word]:
                            if name not in seen:
                                seen.add(name)
                                near = " ".join(words[max(i - 1, 0) : i + 2])
                                number.append(row)
                                names.append(name)
                                forms.append(xxhash.xxh64_intdigest(word.encode()) >> 1)
                                around.append(xxhash.xxh64_intdigest(near.encode()) >> 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(number, pa.int64())),
                        pa.array(names, pa.string()),
                        pa.array(forms, pa.int64()),
                        pa.array(around, pa.int64()),
                    ],
                    ["doc_id", "name", "word", "around"],
                )

    return find


def _tally(rows: DataFrame) -> DataFrame:
    """Per expression: different surroundings in toxic documents, other documents, and
    different words of toxic documents."""
    apart = rows.groupBy("name", "word", "around").agg(
        F.max("toxic").alias("t"), F.sum(F.lit(1) - F.col("toxic")).alias("f")
    )
    words = apart.groupBy("name", "word").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    return words.groupBy("name").agg(
        F.sum("t").alias("t"), F.sum("f").alias("f"), F.count_if(F.col("t") > 0).alias("words")
    )


def unlikely(t: np.ndarray, f: np.ndarray, rate: float, tests: int) -> np.ndarray:
    """Whether so many toxic of ``t + f`` documents come by chance with a probability below
    ``CHANCE`` in all ``tests`` together (Chernoff's bound)."""
    share = t / np.maximum(t + f, 1)
    rest = 1 - share
    apart = share * np.log(np.maximum(share, 1e-12) / rate) + rest * np.log(
        np.maximum(rest, 1e-12) / (1 - rate)
    )
    return (share > rate) & ((t + f) * apart >= math.log(max(tests, 1) / CHANCE))


def train(docs: DataFrame, labels: DataFrame, channel: Channel, sample: int = SAMPLE) -> dict[str, float]:
    """The toxic expressions and the chance that a document with one of them is toxic."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(
        F.min("toxic").cast("long").alias("toxic")
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return {}
    rate = sizes[1] / (sizes[0] + sizes[1])
    chosen = labelled_sample(known, "toxic", sample, F.col("doc_id"))
    texts = docs.where("doc_id is not null").select("doc_id", text_of().alias("t"))
    schema = T.StructType([texts.schema["doc_id"]]).add("name", "string").add("word", "long").add("around", "long")

    def found(rows: DataFrame, wanted) -> DataFrame:
        return rows.mapInArrow(_occurrences(channel, wanted), schema)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            kept = batch.filter(pa.array(bits_of(ids.value, codes)))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], ["doc_id", "t"])

    # the sample is bounded by its parameter, so its ids may be sent to every task
    proposed = found(texts.join(F.broadcast(chosen.select("doc_id")), "doc_id"), None)
    tally = _tally(proposed.join(F.broadcast(chosen), "doc_id"))
    tests = tally.where("t > 0").count()
    proposals = (
        tally.where((F.col("t") >= LEAST) & (F.col("t") > 3 * F.col("f")))
        .orderBy(F.desc("t"), "name").limit(CANDIDATES).select("name").collect()
    )
    wanted = {row["name"] for row in proposals}
    if not wanted:
        return {}
    # a bitmap of bounded size keeps most documents without a label from being read; the join
    # with the labels decides
    code = F.xxhash64("doc_id").alias("g")
    ids = docs.sparkSession.sparkContext.broadcast(bitmap(known.select(code)))
    near = texts.select("doc_id", "t", code).mapInArrow(labelled, texts.schema)
    tally = _tally(found(near, wanted).join(known, "doc_id"))
    whole = F.col("name").startswith("=") | (F.col("words") >= SEVERAL)
    rows = tally.where(whole).orderBy("name").collect()
    t, f = (np.array([row[name] for row in rows], float) for name in ("t", "f"))
    chance = (t + PRIOR * rate) / (t + f + PRIOR)
    stays = unlikely(t, f, rate, tests) & (chance >= THRESHOLD)
    return {row["name"]: float(p) for row, p, stay in zip(rows, chance, stays) if stay}


def score(docs: DataFrame, channel: Channel, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` with the column ``toxicity``."""

    def strong(text: str) -> tuple:
        found = []
        for word in _WORDS.findall(text):
            best = max((lexicon.get(name, 0.0) for name in expressions(word)), default=0.0)
            if best:
                found.append((word, best))
        return tuple(found)

    def compute():
        reader, sieve = Reader(channel, strong), Sieve(channel, lexicon)

        def of(text: str | None) -> float:
            words: dict[str, float] = {}
            for token in sieve.of(channel.tokens(text or "")):
                words.update(reader.of(token))
            return 1 - (1 - BASE) * math.prod(1 - words[word] for word in sorted(words))

        return of

    return _added(docs, "toxicity", T.DoubleType(), compute)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document, learnt from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    channel = train_channel(docs)
    lexicon = train(docs, labels.where(fold(F.col("doc_id"), 5) != 0), channel)
    return score(docs, channel, lexicon).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
