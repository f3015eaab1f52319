"""The learnt queries on held-out rows, the encoder on all texts, and the pipeline's stages."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.queries import QUERIES, default_vocabulary

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, least", [
    ("op2_toxicity", "toxic", 0.92), ("op3_quality", "quality", 0.93)])
def test_held_out_labels(spark, name, label, least):
    found = QUERIES[name](spark, FOLDER)
    assert found.count() == found.select("doc_id").distinct().count() == 1000
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    both = found.join(labels, "doc_id").where("held_out")
    assert both.select(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least


def test_held_out_languages(spark):
    found = QUERIES["op5_language_id"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    both = found.join(docs, "doc_id").where("held_out")
    assert both.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_encoding_of_all_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer.from_file(default_vocabulary())
    texts = {r["doc_id"]: r["text"] or "" for r in
             spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    found = QUERIES["op1_bpe"](spark, FOLDER).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = model.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, before = docs.columns, docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / str(n)))
        after = spark.read.parquet(str(tmp_path / str(n)))
        assert after.columns[:5] == columns and 0 < after.count() <= before.count()
        if n == 0:
            kept = after.join(labels, "doc_id").groupBy("toxic").count().collect()
            kept = {r["toxic"]: r["count"] for r in kept}
            assert kept.get(1, 0) < 0.25 * labels.where("toxic = 1").count()
            assert kept[0] > 0.98 * labels.where("toxic = 0").count()
        if n == 1:
            found = QUERIES["op10_minhash_near_dedup"](spark, FOLDER).where("kept")
            assert after.join(found, "doc_id", "left_anti").count() < 30
        assert after.where("n_chars != char_length(text)").count() == 0
        before = after
    assert before.where("NOT round_trip OR n_tokens != size(ids)").count() == 0


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    schema = ("doc_id long, text string, lang string, source string, n_chars int, row string, kept string, "
              "ids string, N_TOKENS string, round_trip string, decoded string")
    long = " ".join(f"w{i % 500}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, "a b"), (None, "a b"), (4, long), (4, long), (5, long), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", None, None, "r", "k", "i", "n", "t", "d") for i, t in rows], schema)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "q q")], "item_id long, text string")
    for name, size in (("odd", 7), ("empty", 0)):
        folder = str(tmp_path / name)
        for table, rows_ in (("documents", docs), ("labels", labels), ("benchmark", bench)):
            (rows_ if size else rows_.limit(0)).write.parquet(f"{folder}/{table}.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert found.count() == size
        assert found.columns == [*docs.columns, "ids_", "n_tokens_", "round_trip_"]
        assert found.where("ids = 'i' AND round_trip = 't' AND round_trip_").count() == size
