"""The registered keys of this package over the smallest tables, and the pipeline's stages."""

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("key, table", [("op2_itq_near_dup", "embeddings"), ("op3_source_mix", "documents"), ("op4_quality_nbsvm", "documents"),
                                        ("op5_simhash", "documents"), ("op6_quality_lines", "documents"), ("op7_language_mixture", "documents"),
                                        ("op8_html_density", "pages"), ("op9_byte_bpe", "documents"), ("op10_minimax_shards", "documents")])
def test_one_row_for_each_input_row(spark, key, table):
    key_col = {"embeddings": "vec_id", "pages": "page_id"}.get(table, "doc_id")
    got = queries.QUERIES[key](spark, SF)
    ids = sorted(r[0] for r in got.select(key_col).collect())
    assert ids == sorted(r[0] for r in queries.table(spark, SF, table).select(key_col).collect())


def test_pipeline_stages(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    extra = spark.createDataFrame([(10 ** 6, None), (10 ** 6 + 1, "12 34 !! 5"), (10 ** 6 + 2, "")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True).withColumn("_key", F.lit(1)).withColumn("_mix_copies", F.lit(2))
    before = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert out.count() == docs.count()
            break
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name != "mixing sources":
            assert out.exceptAll(docs).count() == 0
            assert out.count() > 0.4 * docs.count()
        if k == 0:
            assert out.where("doc_id >= 1000000").count() == 0 and docs.count() - out.count() == 3
        docs = out


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and set(got.columns) >= {"doc_id", "n_tokens", "ids_sha256"}


@pytest.fixture
def no_labels(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(queries, "table", lambda s, d, name: none)


def test_stages_on_an_empty_table(spark, no_labels):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, _key int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_stages_without_labels_and_with_repeated_rows(spark, no_labels):
    texts = [" ".join(f"word{(i * 7 + j * j) % 53}" for j in range(60)) + "." for i in range(6)]
    rows = [(i, t, None, "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], None, "s", 1), (9, texts[1], None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    language, quality, near, mix, bpe = [stage for _, stage in corpus_pipeline.STAGES]
    assert language(spark, docs, SF).count() == len(rows) and quality(spark, docs, SF).count() == len(rows)
    kept = near(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    assert mix(spark, kept, SF).columns == docs.columns and bpe(spark, kept, SF).count() == 6


def test_language_stage_rejects_what_no_known_language_explains(spark):
    """Shares of languages sum to 1 in every text; a text that is mostly in none of them goes all the same."""
    rng = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi", "ren", "to"], "bb": ["schu", "ber", "ein", "gt", "wo"]}

    def words(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    def noise(n):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))
    clean = [(i, words(lang, 120), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    stay = [(200, words("aa", 60) + " " + words("bb", 60), None), (201, words("bb", 120) + " " + noise(20), None), (202, words("aa", 1), None)]
    go = [(300, noise(150), None), (301, base64.b64encode(rng.randbytes(1500)).decode(), None), (302, words("aa", 30) + " " + noise(150), None),
          (303, " ".join("".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(6)) for _ in range(150)), None), (304, "12 !!", None)]
    docs = spark.createDataFrame(clean + stay + go, "doc_id long, text string, lang string")
    got = corpus_pipeline.language_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, _, _ in clean + stay]
