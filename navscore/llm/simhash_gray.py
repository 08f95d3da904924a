"""SimHash near-duplicates found with a Gray-order hierarchical index.

A fingerprint has a bit for each bit that is set in over half the hashes of the document's
three-word shingles. Equal fingerprints are one node (aggregated before anything else), so
copies cost nothing. Two different fingerprints within two bits agree on one of three blocks
of bits; each block deals the fingerprints to groups that agree on it. A group above
``GROUP`` members is split again by three blocks of its remaining bits, which loses no pair
for the same reason, until at most ``FREE_BITS`` remain free, so no group can hold more than
``2 ** FREE_BITS`` fingerprints however the input is skewed.

Inside a group the fingerprints are sorted by Gray rank. Upper nodes of the index keep the
bits all their members share; a pair of nodes is dropped with everything below it as soon as
the shared bits of both differ in more than two places. A group sends out one row per linked
member (its local representative), never its pairs. Representatives are connected over the
whole corpus by ``components``.

Defined cases: null and wordless texts have fingerprint zero and link like any other; texts
of one or two words are one shingle; repeated rows are kept, each with its component; very long
texts are hashed in segments; a null ``doc_id`` stays a row and never names a component unless
all of it are null; an empty table gives no rows; ``keep_one`` carries all columns, whatever
they are called, the other functions none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navscore.llm.common import byte_slices, fresh, stored, text_of
from navscore.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
GROUP = 1024
FREE_BITS = 20
FAN_OUT = 8
SEGMENT = 1 << 20

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_WHITE = b" \t\n\x0b\x0c\r"


def _segments(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists that stay small for very long texts."""
    start = 0
    while start < len(text):
        end = min(start + SEGMENT, len(text))
        while end < len(text) and text[end] not in _WHITE:
            end += 1
        yield text[start:end].split()
        start = end


def fingerprint(text: bytes | None) -> int:
    """SimHash of a UTF-8 text; unsigned."""
    ones = np.zeros((8, 8), dtype=np.int64)
    total, kept = 0, []
    digest = xxhash.xxh64_intdigest
    for words in _segments((text or b"").lower()):
        words = kept + words
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-SHINGLE] + 1)).tolist()
            hashes = np.array(
                [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())],
                dtype="<u8",
            )
            slots = hashes.view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int32) * 256
            ones += np.bincount(slots.ravel(), minlength=2048).reshape(8, 256) @ _BITS
            total += len(hashes)
            words = words[-(SHINGLE - 1) :]
        kept = words
    if not total:
        return digest(b" ".join(kept), SEED) if kept else 0
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in byte_slices(batch, 3):
            texts = rows.column("t").cast(pa.binary()).to_pylist()
            found = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:3], pa.array(found.view(np.int64))], ["doc_id", "k1", "k2", "fp"]
            )


KEY = ["k1", "k2"]


def _row_keys() -> list:
    """Two hashes of id and text, never null: rows that share them are repeated rows."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return [F.xxhash64(name, text_of()), F.xxhash64(text_of(), name)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, k1, k2, fp)``, one row per document; ``fp`` holds the bits as a signed long."""
    k1, k2 = _row_keys()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text_of().alias("t")
    ).mapInArrow(_fingerprints, "doc_id long, k1 long, k2 long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def blocks(mask: int) -> list[int]:
    """The bits that ``mask`` leaves free, as three masks that each also hold ``mask``."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [len(free) * k // 3 for k in range(4)]
    return [mask | sum(1 << i for i in free[cut[k] : cut[k + 1]]) for k in range(3)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def links(codes: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within a group whose codes differ in at most two bits.

    ``codes`` are in Gray order within each group and groups are contiguous. Pairs come in
    slabs. Nodes of all groups are walked together, level by level from the roots.
    """
    firsts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[firsts, len(codes)])
    local = np.arange(len(codes)) - np.repeat(firsts, sizes)
    # starts[k]: positions (in level k - 1) where the nodes of level k start
    shared, pattern, starts = [np.full(len(codes), ~np.uint64(0))], [codes], []
    group, index = np.repeat(np.arange(len(sizes)), sizes), local
    every, none = codes, codes
    while len(group) > len(sizes):
        parent = index // FAN_OUT
        start = np.flatnonzero(
            np.r_[True, (group[1:] != group[:-1]) | (parent[1:] != parent[:-1])]
        )
        every, none = np.bitwise_and.reduceat(every, start), np.bitwise_or.reduceat(none, start)
        group, index = group[start], parent[start]
        starts.append(np.r_[start, len(shared[-1])])
        shared.append(~(every ^ none))
        pattern.append(every)
    roots = np.arange(len(group))
    stack = [(len(starts), roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            apart = a != b
            yield a[apart], b[apart]
            continue
        if len(a) > 1 << 14:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        start = starts[level - 1]
        step = np.arange(FAN_OUT)
        left = (start[a][:, None, None] + step[None, :, None]).repeat(FAN_OUT, axis=2)
        right = (start[b][:, None, None] + step[None, None, :]).repeat(FAN_OUT, axis=1)
        real = (left < start[a + 1][:, None, None]) & (right < start[b + 1][:, None, None])
        real &= left <= right
        left, right = left[real], right[real]
        mask, code = shared[level - 1], pattern[level - 1]
        near = (
            _popcount((code[left] ^ code[right]) & mask[left] & mask[right]) <= DISTANCE
        )
        stack.append((level - 1, left[near], right[near]))


def representatives(codes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each position the first position it is connected to within its group."""
    label = np.arange(len(codes))
    for a, b in links(codes, groups):
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
            while True:
                higher = label[label]
                if (higher == label).all():
                    break
                label = higher
    return label


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, key) in, linked members with their representative out."""

    def solve(mask, key, fp):
        codes = fp.view(np.uint64)
        group = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        order = np.lexsort((gray_rank(codes), group))
        codes, group = codes[order], group[order]
        label = representatives(codes, group)
        linked = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays(
            [pa.array(codes[linked].view(np.int64)), pa.array(codes[label[linked]].view(np.int64))],
            ["a", "b"],
        )

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [
            np.concatenate((old, batch.column(i).to_numpy(zero_copy_only=False)))
            for i, old in enumerate(held)
        ]
        mask, key = held[0], held[1]
        whole = np.flatnonzero((mask != mask[-1]) | (key != key[-1])) if len(mask) else mask
        if len(whole):
            cut = whole[-1] + 1
            yield solve(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield solve(*held)


def near_pairs(codes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect what links within two bits; ``codes`` has distinct ``fp``."""

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        mask = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
        return rows.select("fp", mask.alias("mask")).select(
            "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
        )

    masks, rows, small = blocks(0), codes, None
    while True:
        last = 64 - min(bin(m).count("1") for m in masks) <= FREE_BITS
        rows = dealt(rows, masks) if small is None else rows
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = stored(rows.join(sizes, ["mask", "key"]), "groups")
        fits = sized if last else sized.where(F.col("n") <= GROUP)
        fits = fits.select("mask", "key", "fp")
        small = fits if small is None else small.unionByName(fits)
        large = sized.where(F.col("n") > GROUP)
        if last or large.isEmpty():
            break
        finer = {m: blocks(m) for m in masks}
        parts = [
            dealt(large.where(F.col("mask") == F.lit(_signed(m))), below)
            for m, below in finer.items()
        ]
        masks = [m for below in finer.values() for m in below]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = rows.distinct()  # two coarse masks may share a finer one
    return (
        small.repartition("mask", "key").sortWithinPartitions("mask", "key")
        .mapInArrow(_spanning, "a long, b long")
    )


def _components(docs: DataFrame) -> DataFrame:
    """The fingerprint rows with ``root`` and ``component_id``."""
    rows = stored(fingerprints(docs), "fingerprints")
    codes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "codes")
    roots = components(near_pairs(codes.select("fp"))).withColumnRenamed("node", "fp")
    named = codes.join(roots, "fp", "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    lowest = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    ids = named.join(lowest, "root").select("fp", "root", "component_id")
    return rows.join(ids, "fp", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per document."""
    return _components(docs).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of ``docs``.

    It is the one that names the component; among several rows with that id (or, in a
    component without any id, among all) the one whose text has the smallest hash. Of rows
    with one id and text one stays, with the values of one of them.
    """
    winners = (
        _components(docs).where("doc_id <=> component_id")
        .groupBy("root").agg(F.min(F.struct(*KEY)).alias("key")).select("key.*")
    )
    names = [fresh(docs.columns, name) for name in KEY]
    # repeated rows combine on the map side, before any of them is moved
    rows = docs.withColumns(dict(zip(names, _row_keys()))).dropDuplicates(names)
    return rows.join(winners.toDF(*names), names, "left_semi").select(*docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
