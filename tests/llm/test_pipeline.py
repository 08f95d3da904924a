import public_tokenizers
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from navscore.llm import quality_gam
from tests.llm.test_rules_and_decontamination import plain_hits
from tests.llm.test_simhash_gray import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import plain_words

SF_DIR = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(map(tuple, frame.select("doc_id", "text").collect()))


def test_every_stage_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality_gam.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    given = rows_of(docs)
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]

    def quality(rows):
        x = [quality_gam.features(t) for _, t in rows]
        return [r for r, s in zip(rows, model.score(quality_gam.np.array(x))) if s >= 0.7]

    def near(rows):
        names = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
        return [r for r, name in zip(rows, names) if r[0] == name]

    def repeats(rows):
        return [(d, kept) for (d, _), kept in zip(rows, plain_words([t for _, t in rows]))]

    def clean(rows):
        return [r for r in rows if plain_hits(r[1], benchmark)[1] == 0]

    plain = [quality, near, repeats, clean]
    for (name, stage), expected in zip(pipeline.STAGES, plain):
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        want = sorted(expected(given))
        assert rows_of(out) == want, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        given = want
    last = pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    assert sorted((r.doc_id, r.text) for r in last) == given
    assert {r.doc_id: r.piece_ids for r in last} == {d: library.encode(t) for d, t in given}


def test_run_gives_the_rows_of_the_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    want = sorted(map(tuple, docs.select("doc_id", "text", "n_chars").collect()))
    run = entry.queries()["pipeline"](spark, SF_DIR)
    assert sorted(map(tuple, run.select("doc_id", "text", "n_chars").collect())) == want


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_and_columns_pass_every_stage(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    columns = docs.columns
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    odd = [(9000, None, None, "x", 0), (9001, "", "en", None, 0), (None, "a text without id", "en", "x", 17)]
    odd += [(9002, long, "en", "x", len(long))] + [rows[0], rows[0], rows[1]]
    extra = [(*r, i, "s", i, None) for i, r in enumerate(rows + odd)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality_score int, spans string, k1 int, piece_ids string"
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    given = spark.createDataFrame(extra, schema)
    given.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, given, str(tmp_path))
        assert kept.columns == given.columns, name
        found = kept.count()
        if name == "near_duplicates":  # repeated rows, at least, are one
            assert found < len(extra)
        elif name == "repeated_text":  # every row stays, if need be with an empty text
            assert found == len(extra)
    last = pipeline.pieces(spark, given, str(tmp_path)).collect()
    assert len(last) == len(extra)
    by = {r.doc_id: r for r in last}
    assert by[9000].text == "" and by[9001].piece_ids == [] and by[9002].text == long
    assert len(pipeline.run(spark, str(tmp_path)).collect()) > 0
