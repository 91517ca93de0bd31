"""The corpus pipeline: every stage against brute force or its operator, whole texts, odd rows, empty tables."""

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeline.llm import language_bloom, queries, tokens, toxicity_fm
from tests.llm.conftest import ODD
from tests.llm.test_search_and_rules import brute_classes
from tests.llm.test_tokens import check_pieces


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = queries.toxicity_model(docs, sf)
    left = docs.join(toxicity_fm.score(docs.select("doc_id", "text"), m, out="tox").where("tox < 0.5").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    lm = queries.language_model(left)
    fine = {r["doc_id"] for r in language_bloom.predict(left.select("doc_id", "text"), lm).where("lang_pred <> 'und' and score >= 0.3").collect()}
    texts = [(r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] in fine]
    classes = brute_classes(texts, corpus_pipeline.SIMILARITY)
    kept = [(i, t) for i, t in texts if classes[i][1] == i]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in kept}
    check_pieces(rows, kept, Tokenizer.from_file(tokens.default_vocabulary()), 2048)


def folder(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_rows(spark, odd, tmp_path):
    """Nulls in any column, clashing names, repeats: texts without a letter go with the language stage, copies but one with the
    near duplicates; the row without an id stays."""
    docs = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("source", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(3, 0, 1), (4, None, None), (None, 1, 1), (3, 0, 1)], "doc_id long, toxic int, quality int")
    sf = folder(spark, tmp_path, docs, labels)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
    model = queries.language_model(docs)
    fine = {r["doc_id"] for r in language_bloom.predict(docs, model).where("lang_pred <> 'und' and score >= 0.3").collect()}
    texts = dict(ODD)
    kept = [(i, texts[i]) for i in fine if i != 6]  # 6 is a copy of 5
    assert {0, 1, 2, 12}.isdisjoint(fine) and {5, 6} <= fine
    rows = corpus_pipeline.run(spark, sf).collect()
    check_pieces(rows, kept, Tokenizer.from_file(tokens.default_vocabulary()), 2048)
    assert {r["doc_id"] for r in rows} == {i for i, _ in kept}


def test_empty_table(spark, none, tmp_path):
    docs = none.withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, docs, labels)).count() == 0
