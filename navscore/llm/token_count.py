"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens that a slice of documents needs are held as one array of symbols. In every
step each sequence applies its lowest-ranked pair at all its places at once, so a step is a
few array operations for all sequences together; a sequence without a mergeable pair leaves
with the number of symbols it has left. Only counts are kept, never token lists.

Documents are mapped one batch at a time, without a shuffle. Defined cases: null and empty
texts have no tokens; strings of special tokens inside a text count as one token each, as
the tokenizers library does by default; very long texts are cut at safe spaces; repeated
rows count each; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navscore.llm.chunks import Memo, segments, spaced
from navscore.llm.common import byte_slices, text_of

LIMIT = 1024

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [names[b] for b in range(256)]


class PairTable:
    """Ranks of pairs of symbols, and the symbol each rank makes."""

    def __init__(self, pairs: list[tuple[int, int, int]], made: list[int], width: int):
        """``pairs`` are (left, right, rank); ``made`` is by rank."""
        table = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        keys = table[:, 0] * width + table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.width = keys[order], table[order, 2], width
        self.made, self.never = np.array(made, np.int64), len(made)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def merge(self, symbol: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of symbols left of each sequence and its first one; none is empty."""
        counts, firsts = lengths.copy(), np.zeros(len(lengths), np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        last = np.r_[owner[1:] != owner[:-1], np.ones(min(len(owner), 1), bool)]
        rank = np.full(len(symbol), self.never)
        inner = np.flatnonzero(~last)
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = np.minimum.reduceat(rank, starts)
            open_ = lowest < self.never
            done = starts[~open_]
            counts[owner[done]], firsts[owner[done]] = sizes[~open_], symbol[done]
            stays = np.repeat(open_, sizes)
            symbol, owner, last, rank = symbol[stays], owner[stays], last[stays], rank[stays]
            if not len(symbol):
                break
            place = np.flatnonzero(rank == np.repeat(lowest[open_], sizes[open_]))
            # equal neighbours ("aaa"): in a run of overlapping pairs every second one merges
            run = np.flatnonzero(np.r_[True, np.diff(place) > 1])
            offset = np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))
            place = place[offset % 2 == 0]
            symbol[place] = self.made[rank[place]]
            last[place] = last[place + 1]
            stays = np.ones(len(symbol), bool)
            stays[place + 1] = False
            dirty = np.zeros(len(symbol), bool)
            dirty[place] = True
            before = place[place > 0] - 1
            # the symbol before may itself be merged away: mark the one that now stands there
            dirty[np.where(stays[before], before, before - 1)] = True
            symbol, owner, last, rank, dirty = (
                x[stays] for x in (symbol, owner, last, rank, dirty)
            )
            rank[last] = self.never
            again = np.flatnonzero(dirty & ~last)
            rank[again] = self.rank(symbol[again], symbol[again + 1])
        return counts, firsts


class RankMerger:
    """Counts the symbols that byte-pair merging leaves of each of many byte strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.of_byte = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        self.table = PairTable(
            [(vocab[a], vocab[b], rank) for rank, (a, b) in enumerate(merges)],
            [vocab[a + b] for a, b in merges],
            max(vocab.values()) + 1,
        )
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile(PATTERN).findall

    def counts(self, items: list[bytes]) -> np.ndarray:
        """Symbols left of each item; items are not empty."""
        lengths = np.fromiter(map(len, items), np.int64, len(items))
        symbols = self.of_byte[np.frombuffer(b"".join(items), np.uint8)]
        return self.table.merge(symbols, lengths)[0]

    def pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece, a piece being cut into pre-tokens first."""
        owner, found = [], []
        for i, piece in enumerate(pieces):
            for token in self.split(piece):
                owner.append(i)
                found.append(token.encode())
        distinct = list(dict.fromkeys(found))
        of = dict(zip(distinct, self.counts(distinct).tolist()))
        each = np.fromiter(map(of.__getitem__, found), np.int64, len(found))
        return np.bincount(np.array(owner, np.int64), each, len(pieces)).astype(int).tolist()


class TokenCounter:
    def __init__(self, path: str):
        self.merger = RankMerger(path)
        self.inner = Memo(lambda new: self.merger.pieces([" " + p for p in new]))
        self.first = Memo(self.merger.pieces)
        specials = sorted(self.merger.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    def _parts(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and their number."""
        if self.special is None or not self.special.search(text):
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def slice(self, texts: list[str]) -> list[int]:
        totals, owner, firsts, rests = [], [], [], []
        for i, text in enumerate(texts):
            parts, specials = self._parts(text)
            totals.append(specials)
            for part in parts:
                for segment in segments(part):
                    pieces = spaced(segment)
                    owner.append(i)
                    firsts.append(pieces[:1] if pieces[0] else [])
                    rests.append(pieces[1:])
        for found in (self.first.of(firsts), self.inner.of(rests)):
            for i, counts in zip(owner, found):
                totals[i] += sum(counts)
        return totals


@cache
def counter(path: str) -> TokenCounter:
    """One counter for each worker process and vocabulary."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)``, one row per document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(vocabulary)
        for batch in batches:
            for rows in byte_slices(batch, 1):
                texts = rows.column("t")
                sizes = pc.binary_length(texts).cast(pa.int64())
                found = pa.array(tokens.slice(texts.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), sizes, found], ["doc_id", "n_bytes", "n_tokens"]
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t")
    ).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.withColumn("over_limit", F.col("n_tokens") > LIMIT)
