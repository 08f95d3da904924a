"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The transducer is compiled from the model file. The normaliser escapes spaces and adds the
one in front. The piece transducer is a trie: reading the characters of a piece emits it. A
character that no piece holds goes through the byte fallback, which emits its UTF-8 bytes.
Composing an input with it gives a lattice over the input's positions; the best
segmentation is the shortest path in the tropical semiring, where weights add along a path
and the smaller path wins.

In a byte-pair model the order of merges decides, not a sum of scores. That order is a
constraint on neighbours: a path is the model's segmentation exactly when merging each two
neighbouring pieces from their characters gives those two pieces back. So an arc weighs
nothing after a piece it may follow and infinity after any other, and one path is finite.
A unigram model weighs each arc with the negative score of its piece instead.

No piece holds an escaped space behind another character, so an input can be cut in front of
every run of spaces, and equal cuts share their result in a bounded memo.

Defined cases: null and empty texts have no pieces and decode to the empty string; the
escape character itself in a text decodes to a space, as in the library; repeated rows are
encoded alike; very long texts are encoded whole, and a very long word takes a step of Python for
each of its characters; an empty table gives no rows; an input column named like an output gives
way, other columns are carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType

from navscore.llm.chunks import Memo
from navscore.llm.common import byte_slices
from navscore.llm.token_count import PairTable

ESCAPE = "▁"
PAIRS = 500_000  # remembered neighbours; emptied when full
ROWS = 256  # documents that are decoded together

_CUTS = re.compile(f"{ESCAPE}+[^{ESCAPE}]*")


class PairFilter:
    """Which piece may follow which: answers for arrays of pairs, computed once per pair."""

    def __init__(self, solve, size: int = PAIRS):
        self.solve, self.size = solve, size
        self.keys, self.allowed = np.zeros(0, np.int64), np.zeros(0, bool)
        self.recent, self.recent_allowed = self.keys, self.allowed

    def _find(self, keys, allowed, wanted) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return keys[at] == wanted, allowed[at]

    def _merge(self, keys, allowed, new, new_allowed) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys := np.r_[keys, new], kind="stable")
        return keys[order], np.r_[allowed, new_allowed][order]

    def of(self, wanted: np.ndarray) -> np.ndarray:
        known, answer = self._find(self.keys, self.allowed, wanted)
        for _ in range(2):
            rest = np.flatnonzero(~known)
            if not len(rest):
                break
            found, value = self._find(self.recent, self.recent_allowed, wanted[rest])
            answer[rest[found]], known[rest[found]] = value[found], True
            new = np.unique(wanted[rest[~found]])
            if not len(new):
                break
            solved = self.solve(new)
            self.recent, self.recent_allowed = self._merge(
                self.recent, self.recent_allowed, new, solved
            )
        if len(self.recent) > 1 << 14:
            if len(self.keys) > self.size:
                self.keys, self.allowed = self.keys[:0], self.allowed[:0]
            self.keys, self.allowed = self._merge(
                self.keys, self.allowed, self.recent, self.recent_allowed
            )
            self.recent, self.recent_allowed = self.keys[:0], self.allowed[:0]
        return answer


class PieceOutput:
    """What each id adds to a decoded text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.output = [t.replace(ESCAPE, " ").encode() for t in self.text]
        self.byte_ids: dict[int, int] = {}
        self.special: set[int] = set()
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                byte = int(piece[1:-1], 16)
                self.byte_ids[byte], self.output[i] = i, bytes([byte])
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.output[i] = b""
            else:
                continue
            self.special.add(i)
        self.score = [model.get_score(i) for i in range(len(self.text))]
        self.unknown = model.unk_id()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put in front goes again."""
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class PieceTransducer(PieceOutput):
    """The transducer compiled from a model file; ``kind`` is ``bpe`` or ``unigram``."""

    def __init__(self, path: str, kind: str = "bpe"):
        super().__init__(path)
        self.kind = kind
        self.id = {t: i for i, t in enumerate(self.text) if i not in self.special}
        if not all(c in self.id for piece in self.id for c in piece):
            raise ValueError("a character of a piece is no piece itself")
        self._compile()
        self.memo = Memo(lambda new: self._packed([ESCAPE + p for p in new]))

    def _compile(self) -> None:
        """The trie as arrays: sorted (state, character) keys, next states, emitted pieces."""
        alphabet = {c: k + 1 for k, c in enumerate(sorted({c for p in self.id for c in p}))}
        self.character = np.zeros(0x110000, np.int32)  # 0: in no piece
        for c, k in alphabet.items():
            self.character[ord(c)] = k
        self.width = len(alphabet) + 1
        arcs: dict[int, int] = {}
        emits = [-1]
        for piece, i in self.id.items():
            state = 0
            for c in piece:
                key = state * self.width + alphabet[c]
                if key not in arcs:
                    arcs[key] = len(emits)
                    emits.append(-1)
                state = arcs[key]
            emits[state] = i
        self.arc = np.array(sorted(arcs), np.int64)
        self.next = np.array([arcs[k] for k in self.arc.tolist()], np.int64)
        self.emit = np.array(emits, np.int64)
        # ids beyond the vocabulary: the start of a text, and a character of the fallback
        self.start, self.raw = len(self.text), len(self.text) + 1
        self.states = len(self.text) + 2
        self.pairs = PairFilter(self._follows)
        self.weight = np.array([*(-x for x in self.score), 0.0, 1e6])
        # merging, the better score first: which two pieces make which
        best = sorted(self.id.values(), key=lambda i: -self.score[i])
        merges = [
            (self.id[t[:k]], self.id[t[k:]], rank)
            for rank, t in enumerate(self.text[i] for i in best)
            for k in range(1, len(t))
            if t[:k] in self.id and t[k:] in self.id
        ]
        self.merges = PairTable(merges, best, self.states)

    def _follows(self, keys: np.ndarray) -> np.ndarray:
        """Whether merging keeps two neighbours apart and whole (or the second one whole,
        where nothing that could merge stands before it)."""
        left, right = np.divmod(keys, self.states)
        texts = [
            (self.text[a] if a < self.start else "") + self.text[b]
            for a, b in zip(left.tolist(), right.tolist())
        ]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        symbols = np.fromiter(map(self.id.__getitem__, "".join(texts)), np.int64, lengths.sum())
        counts, firsts = self.merges.merge(symbols, lengths)
        alone = left >= self.start
        return (counts == np.where(alone, 1, 2)) & (firsts == np.where(alone, right, left))

    def fallback(self, character: str) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in character.encode()]

    def shortest(self, texts: list[str]) -> list[bytes]:
        """Ids on the shortest path through the lattice of each escaped text, little-endian.

        The texts are composed with the transducer together, one start position after the
        other; ``last`` and ``back`` hold the last piece and where it starts.
        """
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        longest = int(lengths.max())
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        chars = np.zeros((len(texts), longest), np.int64)
        chars[np.arange(longest) < lengths[:, None]] = self.character[points]
        cost = np.full((len(texts), longest + 1), np.inf)
        last = np.full((len(texts), longest + 1), self.start)
        back = np.zeros((len(texts), longest + 1), np.int64)
        cost[:, 0] = 0
        for begin in range(longest):
            rows = np.flatnonzero((lengths > begin) & (cost[:, begin] < np.inf))
            raw = rows[chars[rows, begin] == 0]
            self._relax(cost, last, back, raw, begin, begin + 1, np.full(len(raw), self.raw))
            state = np.zeros(len(rows), np.int64)
            for end in range(begin + 1, longest + 1):
                key = state * self.width + chars[rows, end - 1]
                at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
                on = self.arc[at] == key
                rows, state = rows[on], self.next[at[on]]
                if not len(rows):
                    break
                piece = self.emit[state]
                full = piece >= 0
                self._relax(cost, last, back, rows[full], begin, end, piece[full])
                on = lengths[rows] > end
                rows, state = rows[on], state[on]
        return self._paths(texts, lengths, last, back)

    def _relax(self, cost, last, back, rows, begin, end, piece) -> None:
        """Arcs that emit ``piece`` between two positions of some rows."""
        if not len(rows):
            return
        weight = cost[rows, begin]
        if self.kind == "bpe":
            checked = piece < self.start
            allowed = np.ones(len(rows), bool)
            pair = last[rows[checked], begin] * self.states + piece[checked]
            allowed[checked] = self.pairs.of(pair)
            weight = np.where(allowed, weight, np.inf)
        else:
            weight = weight + self.weight[piece]
        better = weight < cost[rows, end]
        rows = rows[better]
        cost[rows, end], last[rows, end], back[rows, end] = weight[better], piece[better], begin

    def _paths(self, texts, lengths, last, back) -> list[bytes]:
        """The pieces on the way back from the end of each text, in order."""
        rows, at, steps = np.arange(len(texts)), lengths.copy(), []
        while len(rows):
            piece = last[rows, at]
            at = back[rows, at]
            steps.append((rows, piece, at))
            on = at > 0
            rows, at = rows[on], at[on]
        rows, piece, at = (np.concatenate([s[k] for s in steps]) for k in range(3))
        order = np.lexsort((at, rows))
        rows, piece, at = rows[order], piece[order], at[order]
        data = piece.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(rows, minlength=len(texts)))
        ids = [data[4 * a : 4 * b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
        for row in np.unique(rows[piece == self.raw]).tolist():
            low, high = int(ends[row - 1]) if row else 0, int(ends[row])
            path = []
            for k in range(low, high):
                character = texts[row][at[k]]
                path += self.fallback(character) if piece[k] == self.raw else [int(piece[k])]
            ids[row] = np.array(path, "<u4").tobytes()
        return ids

    def _packed(self, texts: list[str]) -> list[bytes]:
        """Ids of cuts, those of like length together."""
        out: list[bytes] = [b""] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        low = 0
        while low < len(order):
            high = low + 1
            width = len(texts[order[low]]) + 8
            while high < len(order) and len(texts[order[high]]) <= width and (high - low) < 1 << 14:
                high += 1
            for i, ids in zip(order[low:high], self.shortest([texts[i] for i in order[low:high]])):
                out[i] = ids
            low = high
        return out

    def _pieces(self, text: str) -> list[str]:
        """Cuts of a text without the escaped space each starts with."""
        if "  " in text or ESCAPE in text or text[:1] == " " or text[-1:] == " ":
            return [c[1:] for c in _CUTS.findall(ESCAPE + text.replace(" ", ESCAPE))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        cut = [self._pieces(t) if t else [] for t in texts]
        return [b"".join(ids) for ids in self.memo.of(cut)]


@cache
def transducer(path: str, kind: str = "bpe") -> PieceTransducer:
    """One transducer for each worker process and model."""
    return PieceTransducer(path, kind)


@cache
def outputs(path: str) -> PieceOutput:
    """One decoder for each worker process and model."""
    return PieceOutput(path)


Batches = Iterator[pa.RecordBatch]


def _encoder(docs: DataFrame, model: str, kind: str) -> Callable[[Batches], Batches]:
    where = docs.columns.index("text")

    def run(batches: Batches) -> Batches:
        fst = transducer(model, kind)
        for batch in batches:
            for given in byte_slices(batch, where):
                ids = fst.encode([t or "" for t in given.column(where).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(
                    pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))
                )
                yield pa.RecordBatch.from_arrays(
                    [*given.columns, lists], [*batch.schema.names, "piece_ids"]
                )

    return run


def _decoder(model: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        pieces = outputs(model)
        for batch in batches:
            where = batch.schema.get_field_index("piece_ids")
            for low in range(0, batch.num_rows, ROWS):
                rows = batch.slice(low, ROWS)
                values, offsets = _values(rows.column(where))
                texts = [pieces.decode(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, "decoded"]
                )

    return run


def encode(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """``docs`` with ``piece_ids array<int>``; an input column of that name gives way."""
    docs = docs.drop("piece_ids")
    schema = docs.select("*").schema.add("piece_ids", ArrayType(IntegerType()))
    return docs.mapInArrow(_encoder(docs, model, kind), schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of its ``piece_ids``; an input column of that name
    gives way."""
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decoder(model), rows.select("*").schema.add("decoded", StringType()))


def encode_and_decode(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """Both in one pass, so a task needs one Python worker."""
    docs = docs.drop("piece_ids", "decoded")
    there, back = _encoder(docs, model, kind), _decoder(model)
    schema = docs.select("*").schema.add("piece_ids", ArrayType(IntegerType()))
    return docs.mapInArrow(lambda batches: back(there(batches)), schema.add("decoded", StringType()))


def _values(lists: pa.ListArray) -> tuple[np.ndarray, list[int]]:
    """The ids of all lists and the offsets between which each list's are; null is empty."""
    return lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().tolist()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets = _values(batch.column(batch.schema.get_field_index("piece_ids")))
        data = memoryview(values.astype("<u4", copy=False)).cast("B")
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
        digests, same = [], []
        for text, decoded in zip(batch.column("text"), batch.column("decoded")):
            decoded = decoded.as_py()
            digests.append(sha256(decoded.encode()).hexdigest())
            same.append(decoded == (text.as_py() or "").replace(ESCAPE, " "))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets).astype(np.int64)),
                pa.array(sums, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(same, pa.bool_()),
            ],
            ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"],
        )


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of the ids and of the decoded text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    there, back = _encoder(docs, model, "bpe"), _decoder(model)
    return docs.mapInArrow(
        lambda batches: _digests(back(there(batches))),
        "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean",
    )
