"""Exact top-k, line rules and near duplicates against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeline.llm import line_rules, near_dup, queries, topk_nra
from tests.compare import duck_rows, spark_rows
from tests.llm.conftest import ODD

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert spark_rows(queries.queries()[name](spark, sf)) == duck_rows(SQL[name], sf)


def brute_top(rows, k, every, scale=64):
    fit = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in fit:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fit if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_topk_with_odd_rows(spark, seed, monkeypatch):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(r.normal(0, 0.3, 6), 1)]) for i in range(260)]  # many ties
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan")] * 6), (360, [float("inf")] + [0.0] * 5), (None, [0.0] * 6), (380, [1.0, 2.0]), (381, [3.0, 1.0]), (400, [0.0] * 6), (420, [])]
    rows += [(i, [1.0] * 6) for i in range(500, 560)]
    monkeypatch.setattr(topk_nra, "CANDIDATES", 100)
    monkeypatch.setattr(topk_nra, "QUERIES", 7)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = sorted(tuple(x) for x in topk_nra.top_k(df, k=5).collect())
    assert found == brute_top([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], 5, 20)
    assert topk_nra.top_k(df.limit(0)).count() == 0
    for name in ("v", "dim", "qb", "cb", "rank", "score", "query_id", "x"):
        df = df.withColumn(name, F.lit("taken"))
    assert sorted(tuple(x) for x in topk_nra.top_k(df, k=5).collect()) == found


def test_bounds_hold_and_meet():
    r = np.random.default_rng(4)
    v, q = r.integers(-30, 30, (50, 8)).astype(float), r.integers(-30, 30, (5, 8)).astype(float)
    lists, score = topk_nra.Lists(v), q @ v.T
    for depth in (1, 10, 40, 50):
        lower, upper = lists.bounds(depth, np.arange(50), np.maximum(q, 0), np.minimum(q, 0))
        assert (lower <= score).all() and (score <= upper).all()
    assert (lower == upper).all()
    # what is not read is not known
    known = lists.known(7, True, np.full(8, -99.0))
    assert ((known == -99).sum(axis=0) == 43).all() and (np.sort(known, axis=0)[-7:] == np.sort(v, axis=0)[-7:]).all()


def test_queries_stop_when_outsiders_cannot_qualify():
    """Candidates in clusters: a query reads only until the others' bounds are below its own; what it keeps holds its best."""
    r = np.random.default_rng(6)
    v = np.concatenate([r.integers(-3, 4, (900, 6)), r.integers(40, 60, (100, 6))]).astype(float)
    q = np.concatenate([r.integers(1, 30, (5, 6)), r.integers(-30, 30, (5, 6))]).astype(float)
    open_ = np.ones((10, 1000), dtype=bool)
    open_[0, 950] = False
    stopped = topk_nra.read(topk_nra.Lists(v), q, open_, 5)
    assert (stopped[:5] < 1000).all() and (open_[:5].sum(axis=1) <= 100).all() and not open_[0, 950]
    for i, score in enumerate(q @ v.T):
        score[950] = -np.inf if i == 0 else score[950]
        assert set(np.argsort(-score, kind="stable")[:5]) <= set(np.flatnonzero(open_[i])) or len(set(score)) < 1000
        assert sorted(score[open_[i]])[-5:] == sorted(score)[-5:]
    assert topk_nra.depths(8) == [4, 6, 7, 8] and topk_nra.depths(0) == []


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat = len(inside)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, len(words) < 50 or 100 * repeat > 50 * len(words)


def test_line_rules_base(spark, odd, none):
    r = random.Random(2)
    pool = ["a", "b", "c", "d|", "#e", "f.", "\n", "\n\n", "é", "\t"]
    texts = [(100 + i, " ".join(r.choice(pool) for _ in range(r.randrange(200)))) for i in range(60)]
    texts += [(200, " ".join(r.choice(pool) + str(i) for i in range(30_000))), (201, "One line that is said again.\n" * 5000)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    found = {x["doc_id"]: tuple(x)[1:7] for x in line_rules.judge(df).collect()}
    assert found == {i: brute_base(t) for i, t in [*ODD, *texts]}
    assert line_rules.judge(none).count() == 0
    # columns of names that the rules use
    assert {x["doc_id"]: tuple(x)[1:7] for x in line_rules.judge(odd).collect()} == {i: brute_base(t) for i, t in ODD}


def test_line_rules_verdict(spark):
    # twelve lines without a repeated three-word window, so that the base counts pass
    good = "\n".join(" ".join(f"{w}{i}" for w in "Line has some plain words that say a number and end".split()) + "." for i in range(12))
    menu = "\n".join(f"Home{i} | About{i} |{i} Shop{i} |{i} Help{i} |{i} More{i}" for i in range(60))
    rows = {x["doc_id"]: x for x in line_rules.judge(spark.createDataFrame([(1, good), (2, good + "\n" + menu[:100]), (3, menu), (4, good + "\nAll rights reserved."), (5, menu + "\n" + good)], "doc_id long, text string")).collect()}
    assert rows[1]["kept"] and rows[1]["n_bad_lines"] == 0 and rows[2]["kept"] and rows[2]["n_bad_lines"] > 0 and not rows[3]["kept"]
    assert rows[4]["kept"] and rows[4]["n_bad_lines"] == 1 and not rows[5]["kept"]
    assert line_rules.cleaned(spark.createDataFrame([(1, "Keep me.\nA | B | C | D\n\nAnd me.")], "doc_id long, text string")).first()["text"] == "Keep me.\n\nAnd me."


def shingles(text):
    w = [x.decode() for x in (text or "").encode().lower().split()] if text else []
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(docs, percent=85):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_corpus(seed, chain=True):
    """Groups of copies with edits, chains whose ends are far apart, and texts by themselves."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs = []
    for _ in range(8):
        base = [word() for _ in range(r.randrange(30, 150))]
        for _ in range(r.randrange(1, 12)):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    for _ in range(4 if chain else 0):
        now = [word() for _ in range(120)]
        for _ in range(10):
            now = list(now)
            now[r.randrange(len(now))] = word()
            now[r.randrange(len(now))] = word()
            docs.append(" ".join(now))
    docs += [" ".join(word() for _ in range(r.randrange(1, 90))) for _ in range(30)]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates(spark, seed, monkeypatch):
    docs = near_corpus(seed) + [(9000, None), (9001, ""), (9002, "Tiny one"), (9003, "tiny  ONE"), (9004, "É one"), (9005, "é one")]
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = near_dup.classes(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_classes(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_odd_rows(spark, odd, none):
    rows = near_dup.classes(odd).collect()
    assert len(rows) == len(ODD)
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[6] == 5 and found[None] is None and all(found[i] == i for i in found if i not in (6, None))
    assert near_dup.classes(none).count() == 0
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    twice = spark.createDataFrame([(1, "the same row stands here twice"), (1, "the same row stands here twice")], "doc_id long, text string")
    assert [r["kept"] for r in near_dup.classes(twice).collect()] == [True, True]


def test_near_duplicates_beyond_a_slice(spark):
    """Texts of over 4 MB, whose cells are full: two that share most of their shingles, and one that doesn't."""
    r = random.Random(1)
    base = [f"word{r.randrange(10**9)}" for _ in range(330_000)]
    docs = [(1, " ".join(base)), (2, " ".join(base[:320_000])), (3, " ".join(base[200_000:])), (4, "a short text of six words")]
    rows = near_dup.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()
    assert {x["doc_id"]: x["component_id"] for x in rows} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {x["doc_id"]: x["n_shingles"] for x in rows} == {1: 329_996, 2: 319_996, 3: 129_996, 4: 2}


def test_signatures_within_radius_share_a_key():
    """Pigeonhole: any two signatures that differ in RADIUS values meet in a bucket."""
    r = np.random.default_rng(5)
    for _ in range(50):
        a = r.integers(0, 1 << 16, near_dup.COMPONENTS)
        b = a.copy()
        b[r.choice(near_dup.COMPONENTS, near_dup.RADIUS, replace=False)] += 1
        same = (a == b).reshape(near_dup.CHUNKS, near_dup.PER_CHUNK).sum(axis=1)
        assert same.max() >= near_dup.PER_CHUNK - near_dup.RADIUS // near_dup.CHUNKS


def test_bounds_on_common_shingles():
    """Neither bound is below the true common part, also where cells are full."""
    r = np.random.default_rng(8)
    sets = [set(r.integers(0, 1 << 62, n).tolist()) for n in (1, 40, 300)]
    base = r.integers(0, 1 << 62, 60_000).tolist()
    sets += [set(base[:a]) | set(base[b:c]) for a, b, c in ((100, 0, 0), (90, 95, 110), (40_000, 0, 0), (39_000, 41_000, 60_000), (50, 200, 220))]
    seen = {}
    for s in sets:
        for x in s:
            seen[x] = seen.get(x, 0) + 1
    cells = np.array([np.minimum(np.bincount([x % near_dup.CELLS for x in s], minlength=near_dup.CELLS), 255) for s in sets], dtype=np.uint8)
    side = {"n": np.array([len(s) for s in sets]), "own": np.array([sum(seen[x] == 1 for x in s) for s in sets]), "cells": cells}
    i, j = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    most = near_dup.most_common(side, side, i, j)
    for a, b, bound in zip(i.tolist(), j.tolist(), most.tolist(), strict=True):
        if a != b:
            assert bound >= len(sets[a] & sets[b])
    assert most[(i == 3) & (j == 7)][0] < 100  # near to the 70 that they share


def test_sketch_counts_cells():
    size, _, _, cells = near_dup.sketch(pa.array(["a b c d e f g h", None, "A B C D E F G H", "one"], pa.string()))
    assert size.tolist() == [4, 0, 4, 1] == cells.sum(axis=1).tolist() and (cells[0] == cells[2]).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hot_bucket_is_shuffled_in_proportion(spark):
    """A bucket of some thousand copies in one component and a few members of others: blocks are bounded, few rows are copied, all near pairs are found."""
    rng = np.random.default_rng(8)
    base, n, other = rng.integers(0, 1 << 16, near_dup.COMPONENTS), 5000, 20
    rows = []
    for node in range(n + other):
        signature = base.copy()
        signature[rng.choice(near_dup.COMPONENTS - 4, 3 if node < n else 12, replace=False)] = rng.integers(0, 1 << 16, 1)
        rows.append((node, 0 if node < n else n + node % 4, signature.astype("<u2").tobytes()))
    labels = spark.createDataFrame(rows, "node long, component long, signature binary")
    key = int(base[-4]) << 32 | int(base[-3]) << 16 | int(base[-2])
    key = key << 5 | near_dup.COMPONENTS - 1
    blocks = near_dup.mixed_blocks(labels.select(F.lit(key).alias("key"), "node"), labels)
    sizes = blocks.select(F.size("rows").alias("n"), "most").collect()
    assert sum(r["n"] for r in sizes) == n + other and max(r["n"] for r in sizes) <= near_dup.BLOCK
    left, right = near_dup.dealt(blocks)
    assert left.agg(F.sum(F.size("rows1"))).first()[0] == n + other and right.agg(F.sum(F.size("rows2"))).first()[0] <= other * (1 + n // (near_dup.BLOCK * near_dup.TASK_BLOCKS) + 1)
    matrix = np.stack([np.frombuffer(r[2], dtype="<u2") for r in rows])
    first = near_dup.first_key(matrix[:n], np.broadcast_to(matrix[n], (n, near_dup.COMPONENTS)))
    want = set()
    for one in range(n, n + other):
        close = (matrix != matrix[one]).sum(axis=1) <= near_dup.RADIUS
        close &= np.array([r[1] for r in rows]) != rows[one][1]
        close &= near_dup.first_key(matrix, np.broadcast_to(matrix[one], matrix.shape)) == near_dup.COMPONENTS - 1
        want |= {one, *np.flatnonzero(close).tolist()} if close.any() else set()
    assert {r["node"] for r in near_dup.active_nodes(blocks).collect()} == want and len(first) == n
