"""The pipeline's near-duplicate stage against brute force at its own similarity, 0.8."""

import random

import corpus_pipeline
from tests.llm.test_search_and_rules import brute_classes


def brute_kept(docs, percent):
    """Ids that are the smallest of their class, all pairs compared."""
    return {i for i, (_, root) in brute_classes(docs, percent).items() if i == root}


def edited_pairs():
    """Pairs of 100 words: two edits leave 86 of 106 shingles shared (0.811), three 81 of 111 (0.73)."""
    r = random.Random(7)
    docs = []
    for n in range(12):
        base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(100)]
        copy = list(base)
        for at in (20, 60, 80)[: 2 + n % 2]:
            copy[at] = f"edit{at}"
        docs += [" ".join(base), " ".join(copy)]
    return list(enumerate(docs))


def test_stage_links_at_80(spark, sf):
    docs = edited_pairs()
    found = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf).collect()}
    assert found == brute_kept(docs, 80) and len(found) == 18 and len(brute_kept(docs, 85)) == 24


def test_stage_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()}
    assert found == brute_kept(texts, 80) != brute_kept(texts, 85)
