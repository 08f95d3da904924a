import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from navscore.llm import piece_fst

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def fst():
    return piece_fst.PieceTransducer(PATH)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_equal_to_the_library_and_back(fst, library):
    rng = random.Random(1)
    letters = "ab the'snt é日!1\n\t  ▁aaa"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000)]
    texts += ["", " ", "  ", "a" * 50, " a ", "<0x41>", "</s>", "👩‍👩‍👧‍👦", " " * 40 + "x", "\x00"]
    got = [ids(x) for x in fst.encode(texts)]
    assert got == library.encode(texts)
    assert [fst.decode(i) for i in got] == library.decode(got)
    assert [fst.decode(i) for i in got] == [t.replace("▁", " ") for t in texts]


def test_small_memo_and_long_text(library, monkeypatch):
    small = piece_fst.PieceTransducer(PATH)
    small.memo.size = 3
    text = "some words repeat and some do not " * 20_000 + "x" * 3000
    assert ids(small.encode([text])[0]) == library.encode(text)


def test_whole_table(spark, library):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in piece_fst.op9_sentencepiece(spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want = library.encode(text)
        assert got[doc_id].n_pieces == len(want)
        assert got[doc_id].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert got[doc_id].decoded_sha256 == sha256(library.decode(want).encode()).hexdigest()
        assert got[doc_id].round_trip


def test_columns_nulls_and_repeats(spark, library):
    docs = spark.createDataFrame(
        [(1, None, "x"), (None, "", "y"), (2, "a b", None), (2, "a b", None)],
        "doc_id long, text string, decoded_by string",
    )
    rows = piece_fst.decode(piece_fst.encode(docs, PATH), PATH).collect()
    assert sorted(len(r.piece_ids) for r in rows) == [0, 0, 2, 2]
    assert sorted(r.decoded for r in rows) == ["", "", "a b", "a b"]
    assert {r.decoded_by for r in rows} == {"x", "y", None}


def test_empty_table_and_clashing_column(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert piece_fst.encode(docs, PATH).collect() == []
    one = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, piece_ids string")
    row = piece_fst.encode_and_decode(one, PATH).first()
    assert row.decoded == "a b" and len(row.piece_ids) == 2
