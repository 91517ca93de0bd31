"""The n-gram Jaccard join against all pairs in plain Python: edited copies around the threshold, lists of both kinds, odd rows."""

import itertools
import random

import pytest

from lakeline.llm import set_relation_join as join


def grams(text, size):
    w = bytes(text or "", "utf-8").lower().split()
    return set(zip(*(w[k:] for k in range(size)))) if len(w) >= size else {tuple(w)} - {()}


def by_hand(docs, percent=90, size=3):
    sets = {}
    for doc, text in docs:
        if doc is not None:
            sets[doc] = grams(text, size)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations([d for d in sets if sets[d]], 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted(((d, len(grams(t, size)), None if d is None else find(d)) for d, t in docs), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[f"e{rng.randrange(10**6)}"], [], [out[at], f"e{rng.randrange(10**6)}"], [f"common{rng.randrange(3)}"]])
    return out


def corpus(seed, n=500):
    """Groups of copies with few and many edits, chains of edits, one line in most texts, and texts apart."""
    rng = random.Random(seed)
    line = "the same line stands at the begin of nearly every text".split()
    bases = [[f"b{k}w{i}" for i in range(rng.choice([6, 30, 100, 160]))] for k in range(6)]
    docs, chain = [], [f"c{i}" for i in range(120)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            own = edited(rng, rng.choice(bases), rng.choice([0, 1, 1, 2, 3, 4, 6, 9]))
        elif kind < 0.75:
            own = chain = edited(rng, chain, 1)
        else:
            own = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 60))]
        docs.append((i, " ".join((line if rng.random() < 0.7 else []) + own)))
    rng.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("seed", "short", "counters", "percent", "size"), [(1, 48, 1 << 21, 90, 3), (2, 1, 50, 90, 3), (3, 4, 1, 80, 2)])
def test_same_as_all_pairs(spark, monkeypatch, seed, short, counters, percent, size):
    monkeypatch.setattr(join, "SHORT_LIST", short)
    monkeypatch.setattr(join, "LIST", short)
    monkeypatch.setattr(join, "COUNTERS", counters)
    docs = corpus(seed)
    assert rows_of(join.classes(frame(spark, docs), percent, size)) == by_hand(docs, percent, size)


def test_leaders_don_t_decide(spark, monkeypatch):
    """With a single MinHash value most sets find no leader, and all links come from the lists."""
    monkeypatch.setattr(join, "KEYS", 1)
    monkeypatch.setattr(join, "ROUNDS", 1)
    docs = corpus(4, 300)
    assert rows_of(join.classes(frame(spark, docs))) == by_hand(docs)


def test_a_group_gives_few_pairs(spark):
    """Copies of one text with several edits each: what lists give is far from all pairs of the group."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(edited(rng, base, rng.randrange(1, 8)))) for i in range(400)]
    df = frame(spark, docs)
    nodes = join.sketches(df, 3, "doc_id", "text").groupBy("digest").agg({"doc_id": "min"}).count()
    followers = join.followers_of(df, join.sketches(df, 3, "doc_id", "text").selectExpr("doc_id node", "mins"), 3, "doc_id", "text")
    star = spark.createDataFrame([], "node long, linked long")
    entries, _ = join.difference_entries(followers, star, 90)
    assert followers.count() > 0.9 * nodes
    assert join.candidates(entries, 380).count() < 0.1 * nodes * nodes / 2


def test_odd_rows(spark, odd, none):
    long = [(60, "long words " * 200_000), (61, "long words " * 200_001), (62, "Same Words Here"), (63, "same words here"), (63, "same words here")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(long, "doc_id long, text string"))
    want = by_hand([tuple(r) for r in docs.collect()])
    assert rows_of(join.classes(docs)) == want
    found = join.classes(odd)
    assert found.columns == ["doc_id", "n_shingles", "component_id"] and found.count() == odd.count()
    assert join.classes(none).count() == 0
