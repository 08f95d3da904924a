import random
import re
from collections import Counter
from hashlib import sha256

import pytest

from navscore.llm import suffix_dedup as S

SF_DIR = "/root/testdata/sf0.001"


def plain(texts):
    """(bytes, removed, runs, digest of the rest) of each text, comparing every window."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + S.LENGTH] for d in data for i in range(len(d) - S.LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - S.LENGTH + 1):
            if seen[d[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), runs, sha256(kept).hexdigest()))
    return out


def check(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    given = docs.select("doc_id", "text").collect()
    texts = [r.text for r in given]
    words = plain_words(texts)
    want = sorted(
        (
            (r.doc_id, *x, len((r.text or "").encode()) - len(kept.encode()))
            for r, x, kept in zip(given, plain(texts), words)
        ),
        key=str,
    )
    got = sorted((tuple(r) for r in S.op8_suffix_dedup(spark, str(path)).collect()), key=str)
    assert got == want
    kept = S.dedup(docs).select("doc_id", "text").collect()
    assert sorted((r.doc_id, (r.text or "")) for r in kept if r.doc_id is not None) == sorted(
        (r.doc_id, _cut(r.text, w)) for r, w in zip(given, plain_bytes([r.text for r in given]))
        if r.doc_id is not None
    )
    kept = S.dedup(docs, S.WORDS).select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text or "") for r in kept if r.doc_id is not None) == sorted(
        (r.doc_id, w) for r, w in zip(given, words) if r.doc_id is not None
    )


def plain_words(texts, length=50):
    """Each text without the words, and the white space behind them, of every string of
    ``length`` words that occurs more than once."""
    spans = [[m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", (t or "").encode())] for t in texts]
    words = [[(t or "").encode()[a:b] for a, b in own] for t, own in zip(texts, spans)]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for text, own, w in zip(texts, spans, words):
        data = (text or "").encode()
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        cuts = [a for a, _ in own] + [len(data)]
        kept = data[: cuts[0]] + b"".join(data[cuts[i] : cuts[i + 1]] for i in range(len(w)) if not gone[i])
        out.append(kept.decode())
    return out


def plain_bytes(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + S.LENGTH] for d in data for i in range(len(d) - S.LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - S.LENGTH + 1):
            if seen[d[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
        out.append(bytes(b for b, g in zip(d, gone) if not g))
    return out


def _cut(text, kept):
    return kept.decode("utf-8", "ignore")


def test_whole_table(spark, tmp_path):
    check(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), tmp_path)


@pytest.mark.parametrize("segment", [1 << 21, 700])
def test_planted_repeats(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)  # seen by workers forked from here only
    rng = random.Random(segment)

    def prose(n):
        return "".join(rng.choices("abcdefgh éü\n", k=n))

    shared, block = prose(900), prose(399)
    rows = []
    for i in range(40):
        rows.append((i, prose(rng.randint(0, 500)) + shared + prose(rng.randint(0, 500)), "x"))
    near = prose(3000)
    for i in range(20):
        at = rng.randint(0, 2999)
        rows.append((100 + i, near[:at] + rng.choice("XYZ") + near[at + 1 :], "x"))
    twice = prose(450)
    rows += [
        (200, "a" * 3000, "x"), (201, "ab" * 900, "x"), (202, "a" * 400, "x"), (203, "b" * 400, "x"),
        (204, block + prose(300), "x"), (205, prose(300) + block, "x"), (206, None, "x"),
        (207, "", None), (None, prose(600), "x"), (None, twice + prose(99) + twice, "x"),
        (208, shared[:399], "x"), (209, shared[:400], "x"), (210, near, "x"), (210, near, "x"),
        (211, (prose(37) + "é") * 1 + "xyz" * 500, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    check(spark, docs, tmp_path)


def test_passages_of_words(spark, tmp_path):
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(n))

    short = prose(50)  # fewer than 400 bytes, and yet a passage
    assert len(short.encode()) < 400
    rows = [(i, prose(rng.randint(0, 90)) + "\n" + short + " \t" + prose(rng.randint(0, 90))) for i in range(30)]
    rows += [(100 + i, prose(30) + f" alone{i} " + short[: short.rindex(" ")]) for i in range(5)]  # 49 words
    rows += [(200, "x " * 300), (201, "  y " * 49), (202, None), (203, " \n "), (None, short), (204, short), (204, short)]
    again = prose(400)
    for i in range(12):
        words = again.split()
        words[rng.randrange(400)] = "changed"
        rows.append((300 + i, "\u2003".join([prose(3), " ".join(words)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, docs, tmp_path)
    assert S.dedup(docs, S.WORDS).where("doc_id = 5").first().text != rows[5][1]
    assert S.dedup(docs, S.WORDS).where("doc_id = 101").first().text == rows[31][1]


def test_columns_with_names_of_helpers(spark):
    text = "some words that are long enough to be found twice " * 9
    docs = spark.createDataFrame(
        [(1, text, 5, "s", 7), (2, text, 6, "t", 8), (3, "short", 7, None, 9)],
        "doc_id long, text string, K1 int, spans string, t int",
    )
    rows = sorted(tuple(r) for r in S.dedup(docs, S.WORDS).collect())
    assert rows == [(1, "", 5, "s", 7), (2, "", 6, "t", 8), (3, "short", 7, None, 9)]


def test_empty_table(spark, tmp_path):
    check(spark, spark.createDataFrame([], "doc_id long, text string, spans string"), tmp_path)


def test_n_chars_follows_and_columns_stay(spark):
    text = "some words that are long enough to be found twice " * 9
    docs = spark.createDataFrame(
        [(1, text, "en", 5), (2, text, "en", 5), (3, "short", None, 5)],
        "doc_id long, text string, lang string, n_chars long",
    )
    rows = sorted(tuple(r) for r in S.dedup(docs).collect())
    assert rows == [(1, "", "en", 0), (2, "", "en", 0), (3, "short", None, 5)]


def test_triggers_depend_on_the_window_alone():
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    found = S.triggers(data)
    assert len(found) == 3000 - S.GRAM - S.REACH + 2
    other = S.triggers(np.concatenate([rng.integers(97, 101, 77).astype(np.uint8), data]))
    assert (other[77:] - 77 == found).all()
    assert ((found >= np.arange(len(found))) & (found < np.arange(len(found)) + S.REACH)).all()
