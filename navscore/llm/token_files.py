"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters.

Documents are range-partitioned and sorted by ``doc_id`` before they are encoded, so each
file holds a contiguous range and the files follow one another. ORC stores the ids as
run-length encoded integers, keeps minima and maxima per row group and a Bloom filter on
``doc_id``, so a lookup reads the stripes that can hold the document and stripes are read in
parallel. A row also keeps where its ids start within its file; the start within the corpus
is that plus the totals of the files before, one number per file.

Defined cases: null and empty texts consist of the end id; equal ``doc_id`` values follow
one another in the order of a hash of their texts; a null ``doc_id`` comes first; an empty
table writes no ids and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navscore.llm.chunks import Recent, starts
from navscore.llm.common import byte_slices, scratch, text_of
from navscore.llm.token_count import PATTERN, byte_symbols

END = 2
MEMO = 160 << 20  # bytes of pieces and ids that a worker remembers
BATCH = 10_000  # pre-tokens for the library at a time
# Pre-tokens whose kind no version of Unicode changes.
_SINGLE = r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-/:-@\[-`{-~]+)"
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
# Settings of the ORC writer.
LAYOUT = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
    "compression": "zstd",
}


class Encoder:
    """Ids of whole texts by the tokenizers library; equal parts of texts are encoded once.

    Texts are cut by their bytes (``chunks.starts``) and equal parts are found for a slice of
    texts at a time. A new part is cut into the pre-tokens of the library's pattern, and the
    new pre-tokens go to the library's model many at a time, written in its symbols for bytes
    and parted by spaces, which are none of them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        added = self.library.get_added_tokens_decoder().values()
        self.specials = [token.content for token in added]
        self.split = regex.compile(PATTERN).findall
        self.single = re.compile(_SINGLE).fullmatch
        self.symbols = np.array([ord(s) for s in byte_symbols()], "<u4")
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.widths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.inner = Recent(self._parts, MEMO)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        data = [token.encode() for token in tokens]
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        codes = np.insert(self.symbols[np.frombuffer(b"".join(data), np.uint8)], ends[:-1], 32)
        ids = self.words.encode_batch_fast([codes.tobytes().decode("utf-32-le")])[0].ids
        ids = np.array(ids, "<u4")
        stops = np.searchsorted(np.cumsum(self.widths[ids]), ends, side="right")
        return _cut(ids, stops)

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of new parts."""
        found = {}
        joined = "\0".join(parts)
        if any(special in joined for special in self.specials):
            whole = [p for p in parts if any(special in p for special in self.specials)]
            found.update(zip(whole, self._whole(whole)))
        fresh = [p for p in parts if self.single(p) and p not in found]
        alone = set(fresh)
        cuts = {p: self.split(p) for p in parts if p not in alone and p not in found}
        for token in {token for tokens in cuts.values() for token in tokens} - alone:
            ids = self.inner.get(token)
            if ids is None:
                fresh.append(token)
            else:
                found[token] = ids
        for k in range(0, len(fresh), BATCH):
            some = fresh[k : k + BATCH]
            found.update(zip(some, self._tokens(some)))
        for part, tokens in cuts.items():
            if part not in found:
                found[part] = b"".join(map(found.__getitem__, tokens))
        return list(map(found.__getitem__, parts))

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the parts start; a text with a special token, next to which white space is
        cut differently, is one part."""
        first = starts(data, offsets)
        text = data.tobytes()
        within = set()
        for special in map(str.encode, self.specials):
            at = text.find(special)
            while at >= 0:
                within.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = text.find(special, at + 1)
        if not within:
            return first
        owner = np.searchsorted(offsets, first, side="right") - 1
        return first[~np.isin(owner, list(within)) | (first == offsets[owner])]

    def arrays(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids; each text is followed by ``end``."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        first = self._starts(data, offsets)
        places = pa.py_buffer(np.r_[first, len(data)].astype(np.int64))
        buffers = [None, places, pa.py_buffer(data)]
        coded = pa.Array.from_buffers(pa.large_string(), len(first), buffers).dictionary_encode()
        found = self.inner.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        found.append(np.array([end], "<u4").tobytes())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        parts = np.searchsorted(first, offsets)  # before each text
        order = np.insert(coded.indices.to_numpy().astype(np.int64), parts[1:], len(found) - 1)
        lengths = sizes[order]
        ends = np.cumsum(lengths)
        shift = (np.cumsum(sizes) - sizes)[order] - (ends - lengths)
        values = ids[np.repeat(shift, lengths) + np.arange(len(shift) and ends[-1])]
        stops = ends[parts[1:] + np.arange(len(texts))]
        return np.diff(stops, prepend=0), values

    def slice(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        lengths, ids = self.arrays(pa.array(texts, pa.large_string()), END)
        return [found[:-4] for found in _cut(ids, np.cumsum(lengths))]


def _cut(ids: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """Little-endian ids up to each stop."""
    data, stops = ids.tobytes(), (4 * stops).tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def write(docs: DataFrame, vocabulary: str, path: str, end: int = END) -> None:
    """Encode ``docs`` and write the files."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        library = encoder(vocabulary)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in byte_slices(batch, 1):
                lengths, ids = library.arrays(rows.column("t"), end)
                ends = np.cumsum(lengths)
                values = pa.array(ids.view("<i4"))
                offsets = pa.array(np.r_[0, ends].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(np.full(len(lengths), part, np.int32)),
                        pa.array(start + ends - lengths),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(offsets, values),
                    ],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("t"),
        F.xxhash64(text_of()).alias("tie"),
    )
    (
        keyed.repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "t")
        .mapInArrow(encode, SCHEMA)
        .write.options(**LAYOUT)
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents with ``start``, the number of ids before them in the corpus."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of a few ids; other stripes are skipped by their metadata."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select(
        "doc_id", "n_tokens", "ids"
    )


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        data = memoryview(values).cast("B")
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """Write the ids of all documents and describe every document from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "token-files")
    write(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return read(spark, path).mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
