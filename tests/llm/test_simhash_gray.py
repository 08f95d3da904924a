import numpy as np
import pytest
import xxhash

from navscore.llm import simhash_gray as S
from navscore.llm.components import components

SF_DIR = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest id reachable over links of at most two bits, by comparing everything."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return [low.get(find(i)) for i in range(len(rows))]


def check(docs):
    given = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = sorted(
        ((d, f, c) for (d, f), c in zip(given, plain_components(given))), key=str
    )
    got = sorted(
        ((r.doc_id, r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(docs).collect()),
        key=str,
    )
    assert got == want


def test_whole_table(spark):
    check(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [
        (1, "One two", "x"), (2, "ONE  two", "x"), (3, None, "x"), (4, "", "x"), (5, " \n", "x"),
        (None, "one two", None), (7, long, "x"), (8, long + " tail", "x"), (8, long, "x"),
        (9, "É x y z", "x"), (None, "alone here indeed", "x"), (1, "One two", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    check(docs)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == []


@pytest.mark.parametrize("group", [4, 1024])
def test_index_finds_every_link(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    noisy = np.concatenate([base] + [
        base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)
    ])
    codes = sorted({int(c) - (1 << 64) if int(c) >> 63 else int(c) for c in noisy})
    frame = spark.createDataFrame([(c,) for c in codes], "fp long")
    found = {r.node: r.root for r in components(S.near_pairs(frame)).collect()}
    plain = plain_components([(i, c % (1 << 64)) for i, c in enumerate(codes)])
    classes = {}
    for c, p in zip(codes, plain):
        classes.setdefault(p, set()).add(found.get(c, c))
    assert all(len(roots) == 1 for roots in classes.values())
    assert len({min(r) for r in classes.values()}) == len(classes)


def test_blocks_cover_all_bits_and_bound_groups():
    masks = [0]
    for _ in range(3):
        finer = [S.blocks(m) for m in masks]
        for m, below in zip(masks, finer):
            assert below[0] | below[1] | below[2] == (1 << 64) - 1
            assert below[0] & below[1] == below[0] & below[2] == below[1] & below[2] == m
        masks = [m for below in finer for m in below]
    assert 64 - min(bin(m).count("1") for m in masks) <= S.FREE_BITS
