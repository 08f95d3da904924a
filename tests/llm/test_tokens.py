import random
import zlib
from sys import getsizeof

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from navscore.llm import chunks, token_count, token_files
from navscore.llm.chunks import ENTRY, Memo
from navscore.llm.common import scratch

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "\n \n b", "x\n \ny", "x  y", "it's  we'll",
    "x<|endoftext|>y", "x  <|endoftext|> y", "\n <|endoftext|>", "<|endoftext|><|endoftext|>",
    "aaaaaaaaaaaaaaaaaaaaaaaaa", "!!!!!!!!!!!!!!!!!!!", "日本語テキスト 漢字", "é è\tñ", "\x1c a \x1d",
    "1234 56789 00", "　 x 　　 y", "👩‍👩‍👧‍👦 family", "word " * 300, "\x00\x01",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    letters = "ab the'snt é日!1\n\t  "
    made = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000)]
    return ODD + made


def test_counts_equal_the_library(library, texts):
    counter = token_count.TokenCounter(PATH)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.slice(texts) == want


def test_cut_into_segments_and_full_memo(library, texts, monkeypatch):
    monkeypatch.setattr(chunks, "SEGMENT", 7)
    counter = token_count.TokenCounter(PATH)
    counter.inner.size = 50
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [n for k in range(0, len(texts), 20) for n in counter.slice(texts[k : k + 20])] == want
    encoder = token_files.Encoder(PATH)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.slice(texts)] == want


def test_token_count_table(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.token_counts(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    found = library.encode_batch([r.text for r in rows], add_special_tokens=False)
    assert got == {r.doc_id: (len(r.text.encode()), len(e.ids)) for r, e in zip(rows, found)}


def plain_files(rows, library):
    start, out = 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        out.append((doc_id, start, len(ids), crc))
        start += len(ids)
    return out


def test_token_files_table(spark, library):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in token_files.op5_token_files(spark, SF_DIR).collect())
    assert got == plain_files(sorted(rows, key=lambda r: r.doc_id), library)


def test_edge_cases(spark, library):
    long = "many words here " * 200_000
    rows = [(5, None, 1), (3, "", 1), (None, "null id", 1), (9, long, 1), (4, "b", 2), (4, "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    path = scratch(spark, "test-files")
    token_files.write(docs, PATH, path)
    got = token_files.read(spark, path).select("doc_id", "start", "ids").collect()
    got = [(r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert sorted(got, key=lambda r: r[1]) == plain_files([r[:2] for r in order], library)
    found = token_files.lookup(spark, path, [4, 9]).collect()
    assert sorted(r.doc_id for r in found) == [4, 4, 9]
    counts = token_count.token_counts(docs, PATH).collect()
    assert sorted(r.n_tokens for r in counts) == sorted(
        len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows
    )


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_count.token_counts(docs, PATH).collect() == []
    path = scratch(spark, "test-files")
    token_files.write(docs, PATH, path)
    assert token_files.read(spark, path).collect() == []


def test_memo_is_bounded_in_bytes():
    calls = []

    def solve(pieces):
        calls.append(sorted(pieces))
        return [p.upper().encode() for p in pieces]

    memo = Memo(solve, 2000)
    assert memo.of([["a", "b", "a"], [], ["b"]]) == [[b"A", b"B", b"A"], [], [b"B"]]
    assert memo.of([["a"]]) == [[b"A"]] and calls == [["a", "b"]]
    long = "x" * 1000
    assert memo.of([[long, "a"]]) == [[long.upper().encode(), b"A"]]
    assert long not in memo.known and "a" in memo.known
    for i in range(50):
        assert memo.of([[f"n{i}", "a"]]) == [[f"N{i}".encode(), b"A"]]
        assert memo.held <= 2000 and "a" in memo.known
    many = [f"m{i}" for i in range(100)]
    assert memo.of([many]) == [[m.upper().encode() for m in many]] and memo.held <= 2000
    assert memo.held == sum(
        getsizeof(k) + getsizeof(v) + ENTRY for k, v in memo.known.items()
    )


def test_texts_without_spaces(spark, library):
    rows = [(i, chr(0x4E00 + i % 7) * 900 + chr(0x5000 + i)) for i in range(40)] + [(99, "z" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_count.token_counts(docs, PATH).collect()} == want


def test_parts_give_the_pre_tokens_of_their_text(library, texts):
    cut = library.pre_tokenizer.pre_tokenize_str
    wide = random.Random(5)
    alphabet = list("ab's.,9 \n\t") + ["ß", "日", "”", " ", "　", " ", "\x85", "\x1c", "²"]
    made = ["".join(wide.choices(alphabet, k=wide.randint(0, 40))) for _ in range(3000)]
    for text in [*texts, *made]:
        data = text.encode()
        places = chunks.starts(np.frombuffer(data, np.uint8), np.array([0, len(data)])).tolist()
        parts = [data[a:b].decode() for a, b in zip(places, [*places[1:], len(data)])]
        assert [t for part in parts for t, _ in cut(part)] == [t for t, _ in cut(text)]
    data = np.frombuffer("To be, or not".encode(), np.uint8)
    assert chunks.starts(data, np.array([0, 2, 2, 13])).tolist() == [0, 2, 5, 6, 9]


def test_library_takes_new_pre_tokens_once_and_together(library, monkeypatch):
    encoder = token_files.Encoder(PATH)
    calls, plain = [], encoder._tokens
    monkeypatch.setattr(encoder, "_tokens", lambda tokens: calls.append(tokens) or plain(tokens))
    words = [f"{a}{b}q{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "rstuvwxyz"]
    texts = ["".join(f" {word}{mark}" for word in words) for mark in ("", ",", "!?", "\n", "'s")]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.slice(texts)] == want
    assert [len(tokens) for tokens in calls] == [len(words) + 4]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.slice(texts[::-1])] == want[::-1]
    assert len(calls) == 1
    assert encoder.slice([]) == [] and encoder.slice(["", ""]) == [b"", b""]


def test_recent_keeps_what_was_wanted_lately():
    solved = []

    def solve(pieces):
        solved.extend(pieces)
        return [p.upper().encode() for p in pieces]

    recent = chunks.Recent(solve, 4000)
    common = [f"c{i}" for i in range(4)]
    for i in range(200):
        pieces = [common[i % 4], f"n{i}", "x" * 1000]
        assert recent.of(pieces) == [p.upper().encode() for p in pieces]
        assert recent.held <= 2000 and len(recent.older) + len(recent.newer) < 25
    assert [solved.count(c) for c in common] == [1] * 4 and "x" * 1000 not in recent.newer
    many = [f"m{i}" for i in range(100)]
    assert recent.of(many) == [m.upper().encode() for m in many] and recent.held <= 2000
