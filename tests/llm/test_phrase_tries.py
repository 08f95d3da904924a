"""Collocations against plain counting, tries against dictionaries, and edge cases."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from navscore.llm import phrase_tries as P
from tests import compare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield [w for w in re.split("[\x20\x09]+", piece) if w]


def plain(rows, top=P.TOP, least=10, longest=3):
    """The contract, straight from its words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in plain_pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for (lang, *w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, *w[i : i + k])
                longer[part] = max(longer[part], a)
    out = []
    for (lang, *w), a in candidates.items():
        score, _, left, right = min(
            (10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]])
            for k in range(1, len(w))
        )
        if 100 * longer[lang, *w] < 50 * a:
            out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out.sort()
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


KEYS = st.sets(st.binary(min_size=1, max_size=12).map(lambda k: k.replace(b"\xff", b"")).filter(bool), min_size=1, max_size=60)


@given(KEYS, st.lists(st.binary(max_size=8), max_size=10))
@settings(max_examples=200, deadline=None)
def test_trie_holds_its_keys(keys, others):
    keys = sorted(keys)
    trie = P.Trie.of(P.Trie.build(keys).parts())
    for number, key in enumerate(keys):
        assert trie.accept[trie.walk(key)] == number
    for other in others:
        state = trie.walk(other)
        prefix = not other or any(key.startswith(other) for key in keys)
        assert (state >= 0) == prefix
        assert prefix is False or trie.accept[state] == (keys.index(other) if other in keys else -1)
    data = b"".join(others) + b"".join(keys) + b"\xff"
    found = Counter()
    for hits in trie.hits(P.np.frombuffer(data, P.np.uint8), P.np.arange(len(data)), 0):
        found.update(hits.tolist())
    assert found == Counter(
        {i: c for i, key in enumerate(keys) if (c := sum(data.startswith(key, a) for a in range(len(data))))}
    )


@given(st.lists(st.text(alphabet="aB \t\n.,ä \x1c", max_size=30), max_size=5))
@settings(max_examples=200, deadline=None)
def test_words_of_a_buffer(texts):
    words = P.Words([t.encode() for t in texts])
    data = words.bytes.tobytes()
    got = [data[a:b] for a, b, real in zip(words.starts, words.ends, words.real) if real]
    assert got == [w.encode() for t in texts for piece in plain_pieces(t) for w in piece]


def test_whole_table_against_plain_counting(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.lang, r.text) for r in docs.collect()])
    assert rows_of(P.op12_collocations(spark, "/root/testdata/sf0.001")) == want
    assert len(want) > 100


def test_query_matches_its_sql(spark):
    duck = compare.connect("/root/testdata/sf0.001")
    assert compare.difference(spark, duck, "/root/testdata/sf0.001", "op12_collocations") is None


CASES = [
    ("en", "The quick fox. " * 12, 1),
    ("en", "the quick fox the quick fox " * 3, 1),
    (None, "a b " * 20, 1),
    ("und", "a b, c " * 20, 1),
    ("fr", None, 1),
    ("fr", "", 1),
    ("de", "ä ß x \x00 y! " * 15, 1),
    ("de", "ä ß x \x00 y! " * 15, 1),
    ("x\ny", "p q " * 11, 1),
    ("ties", "m n. o p. " * 10, 1),
]


def cases(spark):
    return spark.createDataFrame(CASES, "lang string, text string, phrase int")


def test_edge_cases(spark):
    want = plain([(lang, text) for lang, text, _ in CASES])
    assert rows_of(P.collocations(cases(spark))) == want
    assert {row[0] for row in want} == {"en", "und", "de", "x\ny", "ties"}


def test_small_chunks_shards_and_longer_phrases(spark, monkeypatch):
    monkeypatch.setattr(P, "SALTS", 3)
    rows = [(lang, text) for lang, text, _ in CASES]
    got = P.collocations(cases(spark), top=4, least=4, longest=4)
    assert rows_of(got) == plain(rows, 4, 4, 4)
    with pytest.raises(ValueError):
        P.phrase_counts(cases(spark), longest=1)


def test_many_shards_give_the_same_counts(spark, monkeypatch):
    rows = [(lang, text) for lang, text, _ in CASES]
    monkeypatch.setattr(P, "SHARD_BYTES", 40)
    counts, words = P.phrase_counts(cases(spark), least=4, longest=3)
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in plain_pieces(text):
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    got = {(r.lang, r.phrase): r.f for r in counts.collect()}
    assert all(f[key] == count for key, count in got.items())
    assert {key for key, count in f.items() if count >= 4 and " " in key[1]} <= set(got)
    assert {r.lang: r.n for r in words.collect()} == {k: v for k, v in n.items()} | {"fr": 0}


def test_tries_and_texts_do_not_pass_the_driver_for_each_shard(spark, monkeypatch):
    sent = []
    context = type(spark.sparkContext)
    before = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value) or before(self, value))
    monkeypatch.setattr(P, "SHARD_BYTES", 40)
    scans = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    rows = [(lang, f"{text} " * 2) for lang, text, _ in CASES]
    docs = spark.createDataFrame(rows, "lang string, text string").mapInArrow(read, "lang string, text string")
    counts, words = P.phrase_counts(docs, least=4, longest=3)
    found = {(r.lang, r.phrase): r.f for r in counts.collect()}
    words = words.collect()
    assert sum(len(f"{lang}{phrase}") for lang, phrase in found) > 4 * 40  # several shards
    # a bitmap for each length of phrase, and a scan for each and one for the windows
    assert [len(value) for value in sent] == [1 << (P.BITS - 3)] * 3
    assert scans.value == 4 * len(rows)
    assert {r.lang for r in words} == {"und" if lang is None else lang for lang, _ in rows}
    assert found["en", "quick fox"] == 36 and found["und", "a b"] == 2 * 20 + 2 * 20


def test_windows_are_dealt_to_all_shards_of_their_starts():
    bounds = [("en", "a"), ("en", "a b"), ("en", "a b c d"), ("en", "b"), ("fr", "a b")]
    rows = [("de", "x"), ("en", "a"), ("en", "a b c e"), ("en", "a c"), ("en", "zz a"), ("fr", "a b")]
    batch = P.pa.table({"lang": [r[0] for r in rows], "phrase": [r[1] for r in rows], "n": [*range(6)]})
    (got,) = P._dealt([3, 4, 6, 7, 9], bounds)(batch.to_batches())
    dealt = {}
    for row in got.to_pylist():
        dealt.setdefault(row["n"], []).append(row["shard"])
    assert {n: sorted(shards) for n, shards in dealt.items()} == {
        1: [3],
        2: [3, 4, 6],
        3: [3, 6],
        4: [7],
        5: [7, 9],
    }


def test_stretches_as_strings(monkeypatch):
    data = P.np.frombuffer("ab c ä defghi jk ".encode(), P.np.uint8)
    starts = P.np.array([0, 5, 8, 0, 3, 15])
    ends = P.np.array([2, 7, 14, 4, 4, 17])
    for size in (1, 4, 100):
        monkeypatch.setattr(P, "SLICE", size)
        got = [text for part in P._strings(data, starts, ends) for text in part.to_pylist()]
        assert got == [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert [*P._strings(data, starts[:0], ends[:0])] == []


def test_tries_are_cut_to_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_BYTES", 64)
    phrases = [("en", f"w{i}") for i in range(40)] + [("de", "ä ö")]
    built = P.tries(spark.createDataFrame(phrases, "lang string, phrase string")).collect()
    found, names = [], set()
    for row in built:
        if row.parts is not None:
            trie = P.Trie.of(row.parts)
            own = [r for r in built if r.trie == row.trie and r.parts is None]
            for r in own:
                assert trie.accept[trie.walk(f"{r.lang}\n{r.phrase} ".encode())] == r.at
                found.append((r.lang, r.phrase))
            names.add(row.trie)
    assert sorted(found) == sorted(phrases) and 2 <= len(names) <= 6


def test_chunks_do_not_change_hashes(monkeypatch):
    words = P.Words([("one two, three four five " * 40).encode()])
    whole = next(P.Hasher().phrases(words, 3, 5, []))
    monkeypatch.setattr(P, "CHUNK", 7)
    parts = list(P.Hasher().phrases(words, 3, 5, []))
    for k in range(3):
        assert P.np.concatenate([p[1][k] for p in parts]).tolist() == whole[1][k].tolist()
        assert P.np.concatenate([p[2][k] for p in parts]).tolist() == whole[2][k].tolist()


def test_long_words_and_texts(spark):
    text = ("x" * 300_000 + " y ") * 12
    got = rows_of(P.collocations(spark.createDataFrame([("en", text)], "lang string, text string")))
    assert got == plain([("en", text)])


def test_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
