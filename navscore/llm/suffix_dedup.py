"""Removal of long repeated strings by prefix-free parsing.

Every byte covered by a string of ``length`` units that also starts anywhere else is removed.
A unit is a byte (``BYTES``, strings of 400) or a word between ASCII white space, by a 64-bit
hash (``WORDS``, strings of 50); the rest is alike for both.

*Parse.* A rolling hash runs over each text. A window of ``length`` units is triggered by the
smallest hash among its first ``reach`` positions, which depends on the window's units
alone, so equal windows have equal triggers at equal distances. Consecutive window starts
with one trigger form a phrase; a phrase is about ``reach / 2`` starts long, and the corpus
becomes a parse of ``units / (reach / 2)`` rows.

*Dictionary.* A phrase is known by the digest of its context (all units its windows cover)
and filed under its core: the digest of the units that every window of it shares to the
right of the trigger. A phrase without a partner under that second digest cannot repeat. Contexts that
occur twice repeat as a whole, whatever their number: one dictionary entry stands for all
copies, so highly repetitive text costs one row per phrase and no comparison.

*Suffixes.* What is left are entries that share their right part but differ somewhere, at
the edges of repeats. One representative of each is cut into cells of ``cell`` window
starts, counted from the trigger, and the cells are filed in the same way, under the units
that all windows of a cell share. Only for cells that are still open every single window (a
suffix of a dictionary phrase followed by the parse) is put next to its equals at depth
``length``. Order beyond that depth, or between different windows, has no influence on the
result, so windows are grouped by a 128-bit digest instead of building global suffix
arrays, which would pass whole suffixes between tasks.

Counts combine on the map side and joins are sort-merge joins whose large partitions can be
split, so a passage in a third of all documents neither meets in one task nor forms pairs.
Rows refer to a text by two hashes of it: documents with equal texts count each, and share
the result.

Defined cases: a null text is empty; texts shorter than ``length`` units never match; very
long texts are parsed in overlapping segments; repeated rows are copies of each other; a null
``doc_id`` is kept; an empty table gives no rows; other columns, whatever they are called, are
carried by ``dedup`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navscore.llm.common import byte_slices, fresh, release, stored, text_of

LENGTH = 400
REACH = 128
GRAM = 8
SEGMENT = 1 << 21  # bytes of units that are parsed together
MARKS = 4096  # marks of a text that are worked on together


@dataclass(frozen=True)
class Windows:
    """Which strings count as repeated: ``length`` units of ``unit`` bytes, a hash of ``gram``
    units at each position, triggers within ``reach`` positions and cells of ``cell`` starts."""

    length: int
    reach: int
    gram: int
    cell: int
    unit: int
    least_bytes: int  # no shorter text holds a window

    def units(self, text: bytes) -> bytes:
        if self.unit == 1:
            return text
        codes = [xxhash.xxh3_64_intdigest(word) for word in text.split()]
        return np.array(codes, "<u8").tobytes()

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A hash of the ``gram`` units at each position."""
        if self.unit == 1:
            grams = np.empty(len(data) - self.gram + 1, dtype="<u8")
            for shift in range(self.gram):
                part = data[shift : shift + (len(grams) - shift + self.gram - 1) // 8 * 8]
                grams[shift :: self.gram] = part.view("<u8")
        else:
            codes = data.view("<u8")
            grams = codes[: len(codes) - self.gram + 1].copy()
            for shift in range(1, self.gram):
                grams = grams * _ODD + codes[shift : len(codes) - self.gram + 1 + shift]
        grams = grams * _ODD
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        return grams


def triggers(data: np.ndarray, w: Windows | None = None) -> np.ndarray:
    """For each position that of the smallest hash within reach (rightmost of equals)."""
    w = w or BYTES
    low = np.uint64(0xFFFFFFFF)
    least = w.hashes(data)
    size = len(least)
    least &= ~low
    least |= np.arange(size, 0, -1, dtype=np.uint64)
    step = 1
    while step < w.reach:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return size - (least & low).astype(np.int64)


_ODD = np.uint64(0x9E3779B97F4A7C15)
BYTES = Windows(length=LENGTH, reach=REACH, gram=GRAM, cell=16, unit=1, least_bytes=LENGTH)
WORDS = Windows(length=50, reach=32, gram=2, cell=4, unit=8, least_bytes=99)

_PARSE = (
    "k1 long, k2 long, first int, starts int, trigger int, unit int, copies int, "
    "core long, context long"
)
_WINDOWS = "k1 long, k2 long, first int, d1 long, d2 long"


def _segments(
    texts: list[bytes], w: Windows
) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of several texts or of a part of a long one.

    A part is (text number, offset in the text, begin and end in the buffer), in units; the
    parts of a text overlap so that each window lies whole in one of them.
    """
    buffer, parts, size, most = [], [], 0, SEGMENT // w.unit
    for number, text in enumerate(texts):
        for offset in range(0, max(len(text) // w.unit - w.length + 1, 0), most):
            piece = text[offset * w.unit : (offset + most + w.length - 1) * w.unit]
            units = len(piece) // w.unit
            if buffer and size + units > most + w.length:
                yield b"".join(buffer), parts
                buffer, parts, size = [], [], 0
            parts.append((number, offset, size, size + units))
            buffer.append(piece)
            size += units
    if buffer:
        yield b"".join(buffer), parts


def phrases(texts: list[bytes], w: Windows) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts as units, the columns (text number, first start, starts, trigger, starts of one
    copy, copies, digest of the right part, digest of the context)."""
    right, u = w.length - w.reach + 1, w.unit
    digest = xxhash.xxh3_64_intdigest
    for data, parts in _segments(texts, w):
        found = triggers(np.frombuffer(data, np.uint8), w)
        number, offset, begin, end = np.array(parts).T
        windows = end - begin - w.length + 1
        at = np.repeat(begin, windows) + (
            np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        )
        trigger = found[at]
        head = np.flatnonzero(
            np.r_[True, (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)]
        )
        starts = np.diff(np.r_[head, len(at)])
        first, trigger = at[head], trigger[head]
        ends = ((first + starts + w.length - 1) * u).tolist()
        context = np.array(
            [digest(data[a:b]) for a, b in zip((first * u).tolist(), ends)], np.uint64
        )
        ends = ((trigger + right) * u).tolist()
        shared = np.array(
            [digest(data[a:b], 1) for a, b in zip((trigger * u).tolist(), ends)], np.uint64
        )
        part = np.searchsorted(begin, first, side="right") - 1
        # neighbours with one context (runs of a short period) are one row
        run = np.flatnonzero(
            np.r_[True, (context[1:] != context[:-1]) | (part[1:] != part[:-1])]
        )
        yield (
            number[part[run]],
            (first - begin[part] + offset[part])[run],
            np.add.reduceat(starts, run),
            (trigger - begin[part] + offset[part])[run],
            starts[run],
            np.diff(np.r_[run, len(first)]),
            shared[run].view(np.int64),
            context[run].view(np.int64),
        )


def _rows(names: str, given: pa.RecordBatch, number, columns) -> pa.RecordBatch:
    """A batch of ``columns`` behind the document that each row belongs to."""
    at = pa.array(number)
    arrays = [given.column("k1").take(at), given.column("k2").take(at)]
    fields = [field.split() for field in names.split(", ")]
    for (_, kind), column in zip(fields[2:], columns):
        arrays.append(pa.array(column, pa.int32() if kind == "int" else pa.int64()))
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _parse(w: Windows):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in byte_slices(batch, 2, 1 << 23):
                texts = [w.units(t) for t in rows.column("t").cast(pa.binary()).to_pylist()]
                for number, *columns in phrases(texts, w):
                    yield _rows(_PARSE, rows, number, columns)

    return parse


def _marked(
    batch: pa.RecordBatch, w: Windows
) -> Iterator[tuple[pa.RecordBatch, bytes, list[np.ndarray]]]:
    """Each document of a batch with its units and some thousand of its marks at a time."""
    for row in range(batch.num_rows):
        text = w.units(batch.column("t")[row].as_py().encode())
        marks = batch.column("marks")[row].values
        for low in range(0, len(marks), MARKS):
            some = marks.slice(low, MARKS)
            yield batch.slice(row, 1), text, [
                some.field(name).to_numpy() for name in ("first", "unit", "trigger")
            ]


def _cells(w: Windows):
    """The marked phrases cut into cells, counted from their trigger."""
    digest, u = xxhash.xxh3_64_intdigest, w.unit

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for given, text, (first, unit, trigger) in _marked(batch, w):
                nearest = (trigger - first - unit + 1) // w.cell
                count = (trigger - first) // w.cell - nearest + 1
                phrase = np.repeat(np.arange(len(first)), count)
                cell = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                # last start of a whole cell
                end = trigger[phrase].astype(np.int64) - (nearest[phrase] + cell) * w.cell
                begin = end - w.cell + 1
                low = np.maximum(begin, first[phrase])
                high = np.minimum(end, first[phrase] + unit[phrase] - 1)
                core = [
                    digest(text[a:b], 1)
                    for a, b in zip((end * u).tolist(), ((begin + w.length) * u).tolist())
                ]
                whole = [
                    digest(text[a:b])
                    for a, b in zip((low * u).tolist(), ((high + w.length) * u).tolist())
                ]
                size = high - low + 1
                yield _rows(
                    _PARSE,
                    given,
                    np.zeros(len(low), np.int32),
                    [
                        low,
                        size,
                        low,
                        size,
                        np.ones(len(low), np.int32),
                        np.array(core, np.uint64).view(np.int64),
                        np.array(whole, np.uint64).view(np.int64),
                    ],
                )

    return cut


def _windows(w: Windows):
    """Digest of every window of the marked cells."""
    digest, u = xxhash.xxh3_128_digest, w.unit

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for given, text, (first, unit, _) in _marked(batch, w):
                at = np.repeat(first, unit) + (
                    np.arange(unit.sum()) - np.repeat(np.cumsum(unit) - unit, unit)
                )
                found = [digest(text[a : a + w.length * u]) for a in (at * u).tolist()]
                both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield _rows(
                    _WINDOWS, given, np.zeros(len(at), np.int32), [at, both[:, 0], both[:, 1]]
                )

    return list_


KEY = ["k1", "k2"]


def _keys(text) -> list:
    """Two hashes of a text; documents with the same text share everything here."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def _resolve(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """What repeats as a whole, and what is open: representatives of entries that share their
    core with another entry, as marks per document."""
    shared = rows.groupBy("core").agg(F.sum("copies").alias("n")).where("n > 1").select("core")
    filed = stored(rows.join(shared, "core"), label)
    release(rows.sparkSession)
    entries = stored(
        filed.groupBy("core", "context").agg(
            F.sum("copies").alias("n"),
            F.min(F.struct(*KEY, "first", "unit", "trigger")).alias("entry"),
        ),
        f"{label}-entries",
    )
    whole = filed.join(entries.where("n > 1").select("core", "context"), ["core", "context"])
    mixed = entries.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    marks = entries.join(mixed.select("core"), "core").select("entry.*")
    return (
        whole.select(*KEY, "first", "starts"),
        marks.groupBy(*KEY).agg(
            F.collect_list(F.struct("first", "unit", "trigger")).alias("marks")
        ),
    )


def repeats(docs: DataFrame, w: Windows = BYTES) -> DataFrame:
    """``(k1, k2, spans)`` per text: runs of window starts that repeat, as (first, starts)."""
    spark = docs.sparkSession
    rows = docs.select(text_of().alias("t")).where(F.octet_length("t") >= w.least_bytes)
    rows = rows.select(*_keys(F.col("t")), "t")
    # copies are merged on the map side, so a text in a third of all rows moves once per task
    texts = rows.groupBy(*KEY).agg(F.first("t").alias("t"))
    phrases_, marks = _resolve(rows.mapInArrow(_parse(w), _PARSE), "phrases")
    cells = stored(texts.join(marks, KEY).mapInArrow(_cells(w), _PARSE), "cells")
    release(spark)
    cells_, marks = _resolve(cells, "cells-filed")
    windows = stored(texts.join(marks, KEY).mapInArrow(_windows(w), _WINDOWS), "windows")
    release(spark)
    twice = windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    single = windows.join(twice.select("d1", "d2"), ["d1", "d2"]).select(
        *KEY, "first", F.lit(1).alias("starts")
    )
    # copies of a text list the same runs
    found = phrases_.unionByName(cells_).unionByName(single)
    spans = found.groupBy(*KEY).agg(F.collect_set(F.struct("first", "starts")).alias("spans"))
    spans = stored(spans, "spans")
    release(spark)
    return spans


def cover(first: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of units (begin, end) that the windows from these starts cover."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order].astype(np.int64), (first + starts + length - 1)[order].astype(np.int64)
    end = np.maximum.accumulate(end)
    head = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    return begin[head], end[np.r_[head[1:] - 1, len(end) - 1]]


def covered(text: bytes, spans, w: Windows) -> list[tuple[int, int]]:
    """The bytes (begin, end) of a text that ``spans`` cover; words go with the white space
    behind them."""
    if spans is None or not len(spans):
        return []
    begin, end = cover(spans.field("first").to_numpy(), spans.field("starts").to_numpy(), w.length)
    if w.unit > 1:
        white = np.isin(np.frombuffer(b" " + text, np.uint8), _WHITE)
        words = np.r_[np.flatnonzero(white[:-1] & ~white[1:]), len(text)]
        begin, end = words[begin], words[end]
    return list(zip(begin.tolist(), end.tolist()))


_WHITE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in gone:
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts)


def dedup(docs: DataFrame, w: Windows = BYTES) -> DataFrame:
    """``docs`` with the repeated strings cut from ``text`` (``n_chars`` follows where it exists).

    A cut inside a character drops what is left of it. Every document stays, if need be
    with an empty text.
    """
    where, columns = docs.columns.index("text"), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(where), batch.column(len(columns))):
                own = (text.as_py() or "").encode()
                gone = covered(own, spans.values, w)
                texts.append(_kept(own, gone).decode("utf-8", "ignore") if gone else text.as_py())
            arrays = batch.columns[: len(columns)]
            arrays[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    names = [fresh(columns, name) for name in (*KEY, "spans")]
    keyed = docs.withColumns(dict(zip(names, _keys(text_of()))))
    joined = keyed.join(repeats(docs, w).toDF(*names), names[:2], "left").select(
        *[keyed[c] for c in columns], names[2]
    )
    result = joined.mapInArrow(cut, docs.schema)
    if "n_chars" in columns:
        result = result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return result


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        columns = (batch.column(name) for name in ("t", "spans", "word_spans"))
        for text, spans, word_spans in zip(*columns):
            text = text.as_py().encode()
            gone = covered(text, spans.values, BYTES)
            words = sum(b - a for a, b in covered(text, word_spans.values, WORDS))
            removed = sum(b - a for a, b in gone)
            out.append((len(text), removed, len(gone), sha256(_kept(text, gone)).hexdigest(), words))
        size, removed, runs, digest, words = zip(*out) if out else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(size, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()),
                pa.array(digest, pa.string()),
                pa.array(words, pa.int64()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"],
        )


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What the repeated 400-byte strings leave of every document, and how many of its bytes
    lie in passages of 50 words that also occur elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    rows = rows.select("doc_id", "t", *_keys(F.col("t")))
    passages = repeats(docs, WORDS).withColumnRenamed("spans", "word_spans")
    rows = rows.join(repeats(docs).join(passages, KEY, "full"), KEY, "left")
    return rows.select("doc_id", "t", "spans", "word_spans").mapInArrow(
        _digest,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "n_passage_bytes long",
    )
