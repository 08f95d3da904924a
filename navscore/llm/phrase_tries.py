"""Collocations per language, counted with double-array tries of candidate phrases.

*Candidates.* Phrases are found level by level. A phrase of k words is looked at only where both
of its parts of k - 1 words may be frequent, so nothing frequent is lost. Tasks count 64-bit
hashes of such phrases, the counts are summed over the corpus by a shuffle that combines on
the map side, and hashes counted ``LEAST`` times or more go into a bitmap for the next level.
Equal hashes of different phrases only let more candidates through. A bitmap has ``2 ** BITS``
bits whatever the corpus holds. A last scan reads the window of every word start: the longest
phrase from there on that the bitmaps let through. Equal windows are added up over the corpus.
Whatever candidate starts at a word is the start of its window, so the windows stand for the
texts from here on, and the candidates are the surviving hashes among their phrases.

*Tries.* The candidates and all their parts are dealt out by ranges, and neighbouring ranges are
put together to shards of about ``SHARD_BYTES`` of phrases; the task that holds a shard builds
its trie (or several, if one range alone is larger) over the bytes of language, words and
closing space. Nodes with several children get a block of their own,
nodes with one child fill the gaps. Each window goes to the shards whose ranges may hold a start
of it, mostly one. The task of a shard advances the states of all windows of a batch together, a
byte a level, drops those without a transition and adds the windows' times to the keys of the
accepting states. Only these counts decide what is frequent.

*Scores.* Parts are joined to their counts, the weakest cut of each phrase is kept, phrases
that a longer candidate explains are dropped, and the best of each language are ranked: first
within salted parts of the language, then among the leaders of all parts. Products are
decimals of 38 digits, exact for counts below 4 * 10 ** 15.

The driver handles one bitmap (16 MB) at a time, and the first phrase and some sizes of each
shard; tries go from task to task. A corpus with more candidates needs more shards, and no
more scans of the texts. Every step is written to the shared scratch folder, so a lost executor
costs the step it was lost in.

Defined cases: a null text is empty and a null language is ``und``; a language without a
candidate has no row; very long texts and very long words are read whole, in chunks of words;
ties in score and count are ranked by the phrase; repeated rows count each; an empty table
gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navscore.llm.common import byte_slices, release, stored, table, text_of

LEAST = 10
LONGEST = 3
TOP = 2000
EXPLAINED = 50  # per cent of a phrase's count that a longer candidate must reach
BITS = 27
SHARD_BYTES = 6 << 20
SLICE = 2 << 20
CHUNK = 1 << 16  # words that are hashed or advanced together
SALTS = 32

#: The marks that end a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_EDGE = 0xFF  # no byte of UTF-8: stands between pieces
_CLEAN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + PIECE_ENDS,
    b"abcdefghijklmnopqrstuvwxyz " + bytes([_EDGE]) * len(PIECE_ENDS),
)
_BASE = 0x9E3779B97F4A7C15
_BYTE_CODES = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)


class Words:
    """The words of some texts in one buffer, each followed by one space; pieces are parted
    by a word of its own that is the byte ``_EDGE``."""

    def __init__(self, texts: list[bytes]):
        edge = b" %c " % _EDGE
        joined = edge.join(texts).translate(_CLEAN).replace(b"%c" % _EDGE, edge)
        data = np.frombuffer(b" " + joined + edge, np.uint8)
        blank = data == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        self.bytes = data[keep]
        self.ends = np.flatnonzero(self.bytes == 32)
        self.starts = np.r_[0, self.ends[:-1] + 1]
        self.real = self.bytes[self.starts] != _EDGE


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """64-bit hashes of the phrases of up to ``size`` words, a chunk of words at a time."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, 1 << 21)
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def words(self, words: Words, first: int, last: int, salt: int) -> np.ndarray:
        begin, end = int(words.starts[first]), int(words.ends[last - 1])
        self._powers(end - begin + 1)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(_BYTE_CODES[words.bytes[begin:end]] * self.powers[: end - begin], out=sums[1:])
        starts, ends = words.starts[first:last] - begin, words.ends[first:last] - begin
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts] + np.uint64(salt))

    def phrases(
        self, words: Words, size: int, salt: int, known: list[np.ndarray]
    ) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
        """For each chunk its first word and, for phrases of 1, 2 ... ``size`` words that start
        in it, their hashes and whether they lie in a piece and hold only parts in ``known``."""
        total = len(words.starts)
        for first in range(0, total, CHUNK):
            last = min(first + CHUNK, total)
            to = min(last + size - 1, total)
            one = self.words(words, first, to, salt)
            hashes, open_ = [one], [words.real[first:to].copy()]
            for k in range(2, size + 1):
                before = hashes[-1]
                may = open_[-1] & bits_of(known[k - 2], before) if len(known) > k - 2 else open_[-1]
                count = max(len(before) - 1, 0)
                hashes.append(_mix(before[:count] * np.uint64(_BASE) + one[k - 1 : k - 1 + count]))
                open_.append(may[:count] & may[1 : 1 + count])
            inside = last - first
            yield first, [h[:inside] for h in hashes], [o[:inside] for o in open_]


def bits_of(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, Words]]:
    for rows in byte_slices(batch, 1, SLICE):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            yield lang, Words(own)


def _salt(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def _hash_counts(size: int, known):
    """Counts of the hashes of open phrases of ``size`` words, per slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, maps = Hasher(), [b.value for b in known]
        for batch in batches:
            for lang, words in _by_language(batch):
                for _, hashes, open_ in hasher.phrases(words, size, _salt(lang), maps):
                    found, times = np.unique(hashes[-1][open_[-1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.view(np.int64)), pa.array(times, pa.int64())], ["g", "n"]
                    )

    return count


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.Array]:
    """The stretches of ``data`` as strings, about ``SLICE`` bytes at a time; a longer one stands
    alone."""
    sizes = ends - starts
    stops = np.cumsum(sizes)
    row = 0
    while row < len(stops):
        done = stops[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(stops, done + SLICE, side="right")))
        if to == row + 1:
            taken = data[starts[row] : ends[row]]
        else:
            shifts = np.repeat(starts[row:to] - (stops[row:to] - sizes[row:to] - done), sizes[row:to])
            taken = data[shifts + np.arange(len(shifts))]
        offsets = np.r_[0, stops[row:to] - done].astype(np.int32)
        yield pa.StringArray.from_buffers(to - row, pa.py_buffer(offsets), pa.py_buffer(taken))
        row = to


def _windows(longest: int, known):
    """Language, words and times of the windows of a slice: for each word the longest phrase from
    there on whose hash and whose parts' hashes are in the bitmaps. One row without a phrase has
    the words in all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, maps = Hasher(), [b.value for b in known]

        def rows(lang: str, phrases: pa.Array, times: pa.Array) -> pa.RecordBatch:
            langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(times), np.int32)))
            return pa.RecordBatch.from_arrays([langs, phrases, times], ["lang", "phrase", "n"])

        for batch in batches:
            for lang, words in _by_language(batch):
                total = pa.array([int(words.real.sum())], pa.int64())
                yield rows(lang, pa.array([None], pa.string()), total)
                for first, hashes, open_ in hasher.phrases(words, longest, _salt(lang), maps):
                    size = np.zeros(len(hashes[0]), np.int64)
                    for k in range(1, longest + 1):
                        size[np.flatnonzero(open_[k - 1] & bits_of(maps[k - 1], hashes[k - 1]))] = k
                    at = np.flatnonzero(size)
                    starts, ends = words.starts[first + at], words.ends[first + at + size[at] - 1]
                    for phrases in _strings(words.bytes, starts, ends):
                        counted = phrases.value_counts()
                        yield rows(lang, counted.field("values"), counted.field("counts"))

    return read


def _phrase_texts(longest: int, known):
    """Language, words and hash of the phrases of two words and more whose hash is in its
    bitmap; a phrase may come several times."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, maps = Hasher(), [b.value for b in known]
        for batch in batches:
            for lang, words in _by_language(batch):
                data = words.bytes.tobytes()
                for first, hashes, open_ in hasher.phrases(words, longest, _salt(lang), maps):
                    found: dict[bytes, int] = {}
                    for k in range(2, longest + 1):
                        at = np.flatnonzero(open_[k - 1] & bits_of(maps[k - 1], hashes[k - 1]))
                        starts = words.starts[first + at].tolist()
                        ends = words.ends[first + at + k - 1].tolist()
                        codes = hashes[k - 1][at].view(np.int64).tolist()
                        found.update((data[a:b], g) for a, b, g in zip(starts, ends, codes))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(found), pa.string()),
                            pa.array([p.decode() for p in found], pa.string()),
                            pa.array(list(found.values()), pa.int64()),
                        ],
                        ["lang", "phrase", "g"],
                    )

    return read


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The leading bits of the hashes in ``g`` as a bitmap of ``2 ** BITS`` bits."""
    at = F.shiftrightunsigned("g", 64 - BITS) + 1  # Spark's buckets count from one
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    whole = np.zeros(1 << (BITS - 3), np.uint8)
    for bucket, bits in rows.collect():  # at most 2 ** (BITS - 15) rows of 4 KB
        whole[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return whole


def candidates(texts: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (lang, phrase): every phrase of 2 to ``longest`` words that may occur ``least``
    times in its language, and all contiguous parts of it. And ``(lang, phrase, n)``, the windows
    of all word starts with their times; without a phrase, the words in all."""
    spark = texts.sparkSession
    known, levels = [], []
    for size in range(1, longest + 1):
        counted = texts.mapInArrow(_hash_counts(size, known), "g long, n long")
        frequent = counted.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        levels.append(stored(frequent.select("g"), f"phrases-{size}"))
        known.append(spark.sparkContext.broadcast(bitmap(levels[-1])))
        release(spark)
    windows = texts.mapInArrow(_windows(longest, known), "lang string, phrase string, n long")
    windows = stored(windows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "windows")
    release(spark)
    read = windows.where("phrase is not null").select("lang", F.col("phrase").alias("t"))
    read = read.mapInArrow(_phrase_texts(longest, known), "lang string, phrase string, g long")
    survivors = levels[1]
    for level in levels[2:]:
        survivors = survivors.unionByName(level)
    read = read.distinct().join(survivors.distinct(), "g", "left_semi").select("lang", "phrase")
    words = F.split("phrase", " ")
    last = F.size(words) - 1
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.transform(
                F.sequence(i, last), lambda j: F.array_join(F.slice(words, i + 1, j - i + 1), " ")
            ),
        )
    )
    found = stored(read.select("lang", F.explode(parts).alias("phrase")).distinct(), "phrases")
    for sent in known:
        sent.destroy()
    release(spark)
    return found, windows


class Trie:
    """A double array over bytes: a state's child for code c is at ``base[state] + c`` if
    ``check`` there names the state. ``accept`` holds the number of the key that ends there."""

    FIELDS = ("codes", "base", "check", "accept")

    def __init__(self, codes, base, check, accept):
        self.codes, self.base, self.check, self.accept = codes, base, check, accept

    @classmethod
    def build(cls, keys: list[bytes]) -> Trie:
        """The trie of sorted, distinct keys."""
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        data = np.frombuffer(b"".join(keys), np.uint8)
        first = np.cumsum(sizes) - sizes
        common = _common(data, first, sizes)
        uses = np.bincount(data, minlength=256)
        codes = np.zeros(256, np.int32)  # frequent bytes get low codes; zero: no transition
        order = np.argsort(-uses, kind="stable")
        used = int((uses > 0).sum())
        codes[order[:used]] = np.arange(1, used + 1)
        # nodes by depth; parents never decrease, as keys are sorted
        node = np.zeros(len(keys), np.int64)
        parents, symbols, made = [], [], 1
        for depth in range(1, int(sizes.max()) + 1):
            reach = np.flatnonzero(sizes >= depth)
            new = common[reach] < depth
            head = reach[new]
            parents.append(node[head])
            symbols.append(codes[data[first[head] + depth - 1]])
            node[reach] = made + np.cumsum(new) - 1
            made += len(head)
        parent, symbol = np.concatenate(parents), np.concatenate(symbols).astype(np.int64)
        slot = _pack(parent, symbol, used)
        size = int(slot.max()) + used + 2
        base = np.zeros(size, np.int32)
        check = np.full(size, -1, np.int32)
        accept = np.full(size, -1, np.int32)
        base[slot[parent]] = slot[1:] - symbol
        check[slot[1:]] = slot[parent]
        accept[slot[node]] = np.arange(len(keys))
        return cls(codes, base, check, accept)

    def parts(self) -> list[bytes]:
        return [getattr(self, name).tobytes() for name in self.FIELDS]

    @classmethod
    def of(cls, parts: list[bytes]) -> Trie:
        return cls(*[np.frombuffer(part, np.int32) for part in parts])

    def walk(self, key: bytes) -> int:
        """The state behind ``key``, or -1."""
        state = 0
        for byte in key:
            after = int(self.base[state]) + int(self.codes[byte])
            if not self.codes[byte] or self.check[after] != state:
                return -1
            state = after
        return state

    def hits(self, data: np.ndarray, at: np.ndarray, state: int) -> Iterator[np.ndarray]:
        """Numbers of the keys that are read from each position on, a byte of all a level."""
        for numbers, _ in self.hits_from(data, at, state):
            yield numbers

    def hits_from(
        self, data: np.ndarray, at: np.ndarray, state: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``hits``, with the index in ``at`` of the position that each key was read from."""
        states, of = np.full(len(at), state, np.int32), np.arange(len(at))
        while len(at):
            after = self.base[states] + self.codes[data[at]]
            on = np.flatnonzero(self.check[after] == states)
            at, states, of = at[on] + 1, after[on], of[on]
            ended = self.accept[states]
            hit = np.flatnonzero(ended >= 0)
            yield ended[hit], of[hit]


def _common(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common start of each key and the key before it."""
    common = np.zeros(len(first), np.int64)
    alike, depth = np.arange(1, len(first)), 0
    while len(alike):
        alike = alike[np.minimum(sizes[alike], sizes[alike - 1]) > depth]
        alike = alike[data[first[alike] + depth] == data[first[alike - 1] + depth]]
        depth += 1
        common[alike] = depth
    return common


def _pack(parent: np.ndarray, symbol: np.ndarray, used: int) -> np.ndarray:
    """A slot for each node. The root is at zero, and slots keep a distance of ``used`` from it
    so that no base is negative."""
    head = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
    children = np.diff(np.r_[head, len(parent)])
    low, high = np.minimum.reduceat(symbol, head), np.maximum.reduceat(symbol, head)
    several = children > 1
    span = np.where(several, high - low + 1, 0)
    begin = np.cumsum(span) - span
    slot = np.repeat(begin - low, children) + symbol
    taken = np.zeros(int(span.sum()) + int((~several).sum()), bool)
    within = np.repeat(several, children)
    taken[slot[within]] = True
    slot[~within] = np.flatnonzero(~taken)[: int((~several).sum())]
    return np.r_[0, slot + used + 1]


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tries of the shards of a partition, whose rows are sorted by shard: a row for each
    phrase with its number in the trie, and one row with the trie."""

    def build(name: str, rows: list[tuple[str, str]]) -> pa.RecordBatch:
        keyed = sorted((f"{lang}\n{phrase} ".encode(), lang, phrase) for lang, phrase in rows)
        trie = Trie.build([key for key, _, _ in keyed])
        count = len(keyed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (count + 1), pa.string()),
                pa.array([*range(count), None], pa.int32()),
                pa.array([lang for _, lang, _ in keyed] + [None], pa.string()),
                pa.array([phrase for _, _, phrase in keyed] + [None], pa.string()),
                pa.array([None] * count + [trie.parts()], pa.list_(pa.binary())),
            ],
            ["trie", "at", "lang", "phrase", "parts"],
        )

    rows, size, shard, sequence = [], 0, None, 0
    for batch in batches:
        for own, lang, phrase in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if rows and (own != shard or size >= 2 * SHARD_BYTES):
                yield build(f"{shard}-{sequence}", rows)
                rows, size, sequence = [], 0, sequence + 1
            shard = own
            rows.append((lang, phrase))
            size += len(phrase.encode()) + 2
    if rows:
        yield build(f"{shard}-{sequence}", rows)


def tries(phrases: DataFrame) -> DataFrame:
    """The phrases with the name of their trie and their number in it, and the tries."""
    spark = phrases.sparkSession
    size = phrases.agg(F.sum(F.octet_length("phrase") + 2)).first()[0] or 0
    ranges = stored(
        phrases.repartitionByRange(max(1, -(-4 * size // SHARD_BYTES)), "lang", "phrase")
        .select("lang", "phrase", F.spark_partition_id().alias("part")),
        "phrase-ranges",
    )
    # one row for each range, four or so to a shard
    sizes = ranges.groupBy("part").agg(F.sum(F.octet_length("phrase") + 2).alias("size")).collect()
    shards, filled = [], 0
    for part, own in sorted(tuple(row) for row in sizes):
        shards.append((part, filled // SHARD_BYTES))
        filled += own
    if not shards:
        return spark.createDataFrame([], TRIES)
    named = spark.createDataFrame(shards, "part int, shard long")
    rows = ranges.join(named, "part").select("shard", "lang", "phrase")
    rows = rows.repartition(shards[-1][1] + 1, "shard").sortWithinPartitions("shard")
    return stored(rows.mapInArrow(_tries, TRIES), "tries")


TRIES = "trie string, at int, lang string, phrase string, parts array<binary>"


def _dealt(numbers: list[int], bounds: list[tuple[str, str]]):
    """The windows with the shards whose ranges hold them or phrases that they start with.
    ``bounds`` has the first language and phrase of each shard, in order."""

    def shards_of(lang: str, phrase: str) -> Iterator[int]:
        last = bisect_right(bounds, (lang, phrase))
        if not last:
            return
        yield numbers[last - 1]
        end = phrase.find(" ")
        while end >= 0:
            own = bisect_right(bounds, (lang, phrase[:end]))
            if own == last:  # what is longer lies between the two
                return
            if own:
                yield numbers[own - 1]
            end = phrase.find(" ", end + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shards = [], []
            for row, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2)))):
                for shard in dict.fromkeys(shards_of(*key)):
                    rows.append(row)
                    shards.append(shard)
            dealt = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), *dealt.columns], ["shard", *batch.schema.names]
            )

    return deal


def _trie_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each key of the tries of a partition occurs in the windows dealt to its shard.
    Rows are sorted by shard, a shard's tries before its windows."""
    own: dict[str, tuple[Trie, np.ndarray]] = {}
    shard = None

    def counted() -> Iterator[pa.RecordBatch]:
        for name, (_, totals) in own.items():
            at = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(at), pa.string()),
                    pa.array(at, pa.int32()),
                    pa.array(totals[at], pa.int64()),
                ],
                ["trie", "at", "f"],
            )

    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for first, last in zip(cuts, cuts[1:]):
            if first == last:
                continue
            if shards[first] != shard:
                yield from counted()
                own, shard = {}, shards[first]
            rows = batch.slice(first, last - first)
            names = rows.column("trie")
            built = len(rows) - names.null_count
            for row in range(built):
                trie = Trie.of([rows.column(part)[row].as_py() for part in Trie.FIELDS])
                own[names[row].as_py()] = trie, np.zeros(int(trie.accept.max()) + 1, np.int64)
            for some in byte_slices(rows.slice(built), rows.schema.get_field_index("phrase"), SLICE):
                lang, phrase = (some.column(name).cast(pa.binary()) for name in ("lang", "phrase"))
                keys = pc.binary_join_element_wise(lang, phrase, b"\n")
                # no key holds the edge, so none is read on into the next window
                keys = pc.binary_join_element_wise(keys, bytes([_EDGE]), b" ")
                at = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset :][: len(keys)]
                data = np.frombuffer(keys.buffers()[2], np.uint8)
                times = some.column("n").to_numpy()
                for trie, totals in own.values():
                    for numbers, of in trie.hits_from(data, at, 0):
                        np.add.at(totals, numbers, times[of])
    yield from counted()


def phrase_counts(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, f)`` of every phrase of 2 to ``longest`` words that occurs ``least`` times
    and of all its parts (and of some rarer phrases), and ``(lang, n)``, the words in all."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("t")
    )
    phrases, windows = candidates(texts, least, longest)
    words = windows.where("phrase is null").select("lang", "n")
    built = tries(phrases)
    shard = F.substring_index("trie", "-", 1).cast("long")
    # one row for each SHARD_BYTES of candidates; phrases and tries stay distributed
    firsts = built.where("at is not null").groupBy(shard.alias("shard"))
    firsts = firsts.agg(F.min(F.struct("lang", "phrase")).alias("first"))
    bounds = sorted((tuple(first), number) for number, first in firsts.collect())
    if not bounds:
        return spark.createDataFrame([], "lang string, phrase string, f long"), words
    dealt = windows.where("phrase is not null").mapInArrow(
        _dealt([number for _, number in bounds], [first for first, _ in bounds]),
        "shard long, lang string, phrase string, n long",
    )
    # a column for each part: Spark takes the size of a list column again with every row of a batch
    parts = [F.col("parts")[i].alias(part) for i, part in enumerate(Trie.FIELDS)]
    rows = built.where("parts is not null").select(shard.alias("shard"), "trie", *parts)
    rows = rows.unionByName(dealt, allowMissingColumns=True)
    rows = rows.repartition(4 * len(bounds), "shard")  # so that few tasks get several shards
    rows = rows.sortWithinPartitions("shard", F.col("trie").isNull())
    sums = rows.mapInArrow(_trie_counts, "trie string, at int, f long")
    counted = built.where("at is not null").join(sums, ["trie", "at"])
    return stored(counted.select("lang", "phrase", "f"), "phrase-counts"), words


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)); at most a million, as a part is never rarer."""
    wide = "decimal(38,0)"
    return F.call_function(
        "div",
        F.lit(1_000_000).cast(wide) * a.cast(wide) * a.cast(wide),
        left.cast(wide) * right.cast(wide),
    )


def collocations(
    docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, words = phrase_counts(docs, least, longest)
    parts = F.split("phrase", " ")
    phrases = counts.where(F.col("f") >= least).select(
        "lang", "phrase", F.col("f").alias("a"), parts.alias("w"), F.size(parts).alias("k")
    ).where("k > 1")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "cut",
        F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        known = counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(known, ["lang", side])
    weakest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest.alias("best"))
    # the most frequent longer candidate around each phrase
    size = F.col("k")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda m: F.transform(
                F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")
            ),
        )
    )
    around = (
        phrases.where("k > 2")
        .select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    left = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(EXPLAINED) * F.col("a"))
    )
    left = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    leaders = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        leaders = leaders.withColumn("rank", ranked).where(F.col("rank") <= top)
    return leaders.join(words, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        "l",
        "r",
        "n",
        F.col("score").cast("long").alias("score"),
    )


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) as piece
  from documents
),
words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
),
spans as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words
),
grams as (
  select lang, 1 as k, w[i] as phrase from spans
  union all
  select lang, 2, w[i] || ' ' || w[i + 1] from spans where i + 1 <= len(w)
  union all
  select lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from spans where i + 2 <= len(w)
),
f as (select lang, k, phrase, count(*) as f from grams group by all),
n as (select lang, sum(len(w)) as n from words group by lang),
c as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10
),
cuts as (
  select lang, k, phrase, a, 1 as cut, w[1] as lhs,
    case when k = 2 then w[2] else w[2] || ' ' || w[3] end as rhs from c
  union all
  select lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] from c where k = 3
),
scored as (
  select cuts.*, fl.f as l, fr.f as r,
    (1000000::hugeint * a * a) // (fl.f::hugeint * fr.f) as score
  from cuts
  join f fl on fl.lang = cuts.lang and fl.phrase = lhs
  join f fr on fr.lang = cuts.lang and fr.phrase = rhs
),
weakest as (
  select * from scored
  qualify row_number() over (partition by lang, phrase order by score, cut) = 1
),
around as (
  select lang, phrase, max(a) as longer from (
    select lang, w[1] || ' ' || w[2] as phrase, a from c where k = 3
    union all
    select lang, w[2] || ' ' || w[3], a from c where k = 3
  ) group by all
),
ranked as (
  select s.lang, s.phrase, s.a, s.l, s.r, s.score,
    row_number() over (partition by s.lang
      order by s.score desc, s.a desc, encode(s.phrase) asc) as rank
  from weakest s left join around using (lang, phrase)
  where longer is null or 100 * longer < 50 * s.a
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r,
  n.n::bigint as n, score::bigint as score
from ranked join n using (lang)
where rank <= 2000
"""
