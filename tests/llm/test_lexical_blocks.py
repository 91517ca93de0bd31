"""Ranked lexical search against plain Python over all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeline.llm import lexical_blocks

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items):
    """Rows (item_id, rank, doc_id, score)."""
    counted = [(d, Counter(t)) for d, t in ((d, terms(text)) for d, text in docs) if t]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    texts, out = {}, set()
    for item, text in items:
        if text is not None:
            texts[item] = min(texts.get(item, text), text)
    for item, text in texts.items():
        found = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0 and d is not None:
                found.append((-score, d))
        out |= {(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:20], 1)}
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()}


@pytest.fixture
def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["Élan", "straße", "日本", "don't"]
    topics = [rng.sample(vocabulary, 30) for _ in range(12)]
    docs = [(i, " ".join(rng.choices(rng.choice(topics) + vocabulary[:20], k=rng.randrange(1, 80)))) for i in range(900)]
    items = [(i, " ".join(rng.choices(rng.choice(topics), k=rng.randrange(1, 25)))) for i in range(40)]
    return docs + docs[:30] + [(None, "w1 w2 w3")], items


@pytest.mark.parametrize(("cells", "at_once"), [(12_000_000, 1000), (1, 7)])
def test_same_as_all_scores(spark, corpus, monkeypatch, cells, at_once):
    monkeypatch.setattr(lexical_blocks, "SHARD_CELLS", cells)
    monkeypatch.setattr(lexical_blocks, "ITEMS_AT_ONCE", at_once)
    docs, items = corpus
    found = lexical_blocks.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(found) == by_hand(docs, items)


def test_blocks_are_skipped_and_bounds_hold(corpus):
    import numpy as np

    docs, items = corpus
    names = sorted({t for _, text in docs for t in terms(text)})
    place = {t: i for i, t in enumerate(names)}
    impacts = np.zeros((len(docs), len(names)), dtype=np.int32)
    for row, (_, text) in enumerate(docs):
        for t, tf in Counter(terms(text)).items():
            impacts[row, place[t]] = (1_000_000_000 * tf) // (1000 * tf + 1200)
    sets = [{"terms": np.array(sorted({place[t] for t in terms(text)})), "weights": None} for _, text in items]
    weights = np.full(len(names), 1000)
    for s in sets:
        s["weights"] = np.full(len(s["terms"]), 1000.0)
    shard = lexical_blocks.Shard(np.arange(len(docs)), impacts, lexical_blocks.columns_of(sets, len(names)), weights)
    shut = total = 0
    for s in sets:
        scores, _ = shard.search(s, (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
        for t in s["terms"]:
            held, starts, summaries = shard.list_of(t)
            bounds = summaries[:, np.searchsorted(shard.columns[t], s["terms"])] @ s["weights"]
            own = impacts[np.ix_(held, s["terms"])] @ s["weights"]
            assert sorted(held) == np.flatnonzero(impacts[:, t]).tolist() and (np.repeat(bounds, np.diff(starts)) >= own).all()
            shut, total = shut + (bounds < scores[-1]).sum(), total + len(bounds)
    assert shut > total / 10


def test_odd_rows(spark, odd, none):
    items = [(1, "word"), (1, "words here"), (2, None), (3, " .,; "), (None, "The same text"), (4, "Straße 日本語"), (5, "x" * 5000), (6, "1234 it's")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("taken")).withColumn("doc_id", F.lit("taken"))
    docs = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(50).cast("long"), "text": F.repeat(F.lit("long words "), 300_000)}))
    assert rows_of(lexical_blocks.search(docs, frame)) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert rows_of(lexical_blocks.search(none, frame)) == set() and rows_of(lexical_blocks.search(odd, frame.limit(0))) == set()
    assert lexical_blocks.search(none, frame).columns == ["item_id", "rank", "doc_id", "score"]
