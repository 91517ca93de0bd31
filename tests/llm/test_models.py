"""Toxicity, quality and language: held-out accuracy, brute force, odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lakeline.llm import common, language_bloom, pair_index_bpe, quality_pu, queries, toxicity_fm
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"))
    good = label == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def labelled(spark, df, name):
    rows = df.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", name).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def check_held_out(spark, df):
    rows = df.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in docs.select("doc_id").collect())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    return rows


def test_toxicity_query(spark):
    df = queries.op1_toxicity(spark, SF)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in check_held_out(spark, df))
    score, _, label = labelled(spark, df, "toxic")
    assert auc(score, label) > 0.75  # some 300 labelled rows to learn from


def pure_pair(n=2000):
    """Rows whose label is whether two terms are both there or both not; a third term is always there, 300 are noise."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, n), rng.integers(0, 2, n)
    noise = rng.integers(0, 2, (n, 300))
    row = np.concatenate([np.flatnonzero(a), np.flatnonzero(b), np.arange(n), np.nonzero(noise)[0]])
    bucket = np.concatenate([np.full(a.sum(), 5), np.full(b.sum(), 9), np.full(n, 11), 100 + np.nonzero(noise)[1]])
    return (a == b).astype(int), row, bucket


def test_toxicity_learns_pairs():
    """Two terms that are toxic only together: neither stands out alone, the query's own settings find the pair and learn it."""
    label, row, bucket = pure_pair()
    m = toxicity_fm.learn(label, row, bucket)
    assert (m.slot >= 0).nonzero()[0].tolist() == [5, 9]
    keep = m.slot[bucket] >= 0
    p = toxicity_fm.sigmoid(toxicity_fm.machine(m, len(label), row[keep], m.slot[bucket[keep]]))
    assert ((p >= 0.5) == label).mean() > 0.95
    flat = toxicity_fm.Model(m.slot, m.bias, m.weight, m.factor * 0)
    p = toxicity_fm.sigmoid(toxicity_fm.machine(flat, len(label), row[keep], m.slot[bucket[keep]]))
    assert ((p >= 0.5) == label).mean() < 0.8  # without the factors it can't


def test_pair_scores_against_loops():
    rng = np.random.default_rng(5)
    x = rng.random((400, 12)) < rng.random(12)
    toxic = (x[:, 0] & x[:, 3]) | (rng.random(400) < 0.1)
    row, column = np.nonzero(x)
    found = toxicity_fm.pair_scores(400, toxic, row, column, 12)
    rate = [toxic[x[:, i]].mean() if x[:, i].any() else 0 for i in range(12)]
    for i in range(12):
        best = 0
        for j in range(12):
            both = (x[:, i] & x[:, j]).sum()
            if i != j and both >= toxicity_fm.PAIR_ROWS:
                e = min(max(both * (rate[i] + rate[j] - toxic.mean()), 0.01 * both), 0.99 * both)
                best = max(best, abs((x[:, i] & x[:, j] & toxic).sum() - e) / np.sqrt(max(e * (1 - e / both), 1e-9)))
        assert np.isclose(found[i], best, rtol=1e-3)


def brute_terms(text):
    """Hashed words (runs of letters, lower case) and their first four and five letters."""
    out = set()
    for word in regex.findall(r"\p{L}+", (text or "").lower()):
        out.add(zlib.crc32(word.encode(), 1) % toxicity_fm.BUCKETS)
        for n in (4, 5):
            if len(word) >= n:
                out.add(zlib.crc32(word[:n].encode(), n) % toxicity_fm.BUCKETS)
    return out


def random_texts(seed, n=80):
    r = random.Random(seed)
    parts = ["a", "b", "the", "word", "Straße", "é", "Ünder", "x1y", "don't", " ", "  ", "\n", "\t", ".", "!", "|", "#", "12", "日本", "\U0001f600", "A.B", "\n\n", "same", "same"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(n)] + [None, "", " "]


def test_terms_against_plain_python():
    texts = random_texts(1)
    row, bucket = toxicity_fm.term_pairs(pa.array(texts, pa.string()))
    found = {i: set() for i in range(len(texts))}
    for i, b in zip(row.tolist(), bucket.tolist(), strict=True):
        assert b not in found[i], "a term counts once"
        found[i].add(b)
    assert found == {i: brute_terms(t) for i, t in enumerate(texts)}


def test_toxicity_query_against_brute_force(spark):
    """The query's scores from its model, terms and sums by plain loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = queries.toxicity_model(docs, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in queries.op1_toxicity(spark, SF).collect():
        at = [m.slot[b] for b in sorted(brute_terms(texts[r["doc_id"]])) if m.slot[b] >= 0]
        pairs = (m.factor[at].sum(axis=0) ** 2 - (m.factor[at] ** 2).sum(axis=0)).sum() / 2
        assert np.isclose(r["score"], 1 / (1 + np.exp(-(m.bias + m.weight[at].sum() + pairs))), atol=1e-6)


def test_machine_is_the_formula():
    rng = np.random.default_rng(1)
    m = toxicity_fm.Model(np.zeros(1), 0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    row, term = np.array([0, 0, 0, 1]), np.array([0, 2, 4, 3])
    pairs = sum(m.factor[i] @ m.factor[j] for i, j in ((0, 2), (0, 4), (2, 4)))
    assert np.allclose(toxicity_fm.machine(m, 3, row, term), [0.3 + m.weight[[0, 2, 4]].sum() + pairs, 0.3 + m.weight[3], 0.3])


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    m = toxicity_fm.fit(odd, labels)
    rows = toxicity_fm.score(odd, m, out="tox").collect()
    assert len(rows) == len(ODD) and all(0 <= r["tox"] <= 1 for r in rows)
    same = {r["tox"] for r in rows if r["doc_id"] in (5, 6)}
    assert len(same) == 1 and {r["tox"] for r in rows if r["doc_id"] in (0, 1, 2)} == {toxicity_fm.sigmoid(np.array([m.bias]))[0]}
    assert toxicity_fm.score(none, toxicity_fm.fit(none, labels), out="tox").count() == 0
    assert toxicity_fm.reject(odd, toxicity_fm.fit(odd, labels.limit(0))).columns == odd.columns


def test_quality_query(spark):
    df = queries.op3_quality(spark, SF)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in check_held_out(spark, df))
    score, predicted, label = labelled(spark, df, "quality")
    assert auc(score, label) > 0.97 and (predicted == label).mean() > 0.93
    assert (predicted[label == 1] == 1).mean() > 0.97


def test_prior_and_risk():
    rng = np.random.default_rng(3)
    good = rng.normal(2, 1, (3000, 15))
    other = np.concatenate([rng.normal(2, 1, (2100, 15)), rng.normal(-2, 1, (900, 15))])
    m = quality_pu.learn(good, other)
    assert abs(m.prior - 0.7) < 0.05
    p = quality_pu.apply(m, other)
    assert (p[:2100] >= 0.3).mean() > 0.98 and (p[2100:] < 0.3).mean() > 0.95


def brute_measures(text):
    """The fifteen measures of a text by plain Python."""
    raw = (text or "").encode()
    w, lines = raw.split(), (text or "").split("\n")
    n = len(w)
    per_word, per_byte = 1 / max(n, 1), 1 / max(len(raw), 1)
    root = lambda chars: np.sqrt(sum(b in chars.encode() for b in raw) * per_byte)
    return {
        "log_words": np.log1p(n) / 4, "word_chars": min(sum(map(len, w)) * per_word, 60) / 5, "distinct": len(set(w)) * per_word, "repeat_next": sum(a == b for a, b in zip(w, w[1:])) * per_word,
        "upper": root("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "symbol": root("#*$%&<>{}[]\\^~_=+@/"), "bang": root("!?"), "bar": root("|"), "digit": root("0123456789"), "stop": root("."), "comma": root(",;:"),
        "line_words": np.log1p(n / len(lines)), "dup_lines": 1 - len(set(lines)) / len(lines), "top_word": max([w.count(x) for x in set(w)], default=0) * per_word, "wide": np.sqrt(sum(b >= 0xC0 for b in raw) * per_byte),
    }


def test_measures_against_plain_python():
    texts = random_texts(2)
    for found, text in zip(quality_pu.measures(pa.array(texts, pa.string())), texts, strict=True):
        plain = brute_measures(text)
        assert np.allclose(found, [plain[k] for k in quality_pu.MEASURES]), text


def test_quality_query_against_brute_force(spark):
    """The query's scores from its model and the measures by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{SF}/labels.parquet").where(common.remainder(5) != 0).where("quality = 1").select("doc_id")
    m = quality_pu.fit(docs, good)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op3_quality(spark, SF).collect():
        plain = brute_measures(texts[r["doc_id"]])
        x = (np.array([plain[k] for k in quality_pu.MEASURES]) - m.centre) / m.scale
        assert np.isclose(r["score"], quality_pu.sigmoid(np.tanh(x @ m.layers[0] + m.layers[1]) @ m.layers[2] + m.layers[3][0]), atol=1e-3)


def test_quality_odd_rows(spark, odd, none):
    good = spark.createDataFrame([(4,), (5,), (6,), (None,), (4,)], "doc_id long")
    m = quality_pu.fit(odd, good)
    rows = quality_pu.score(odd, m, out="q").collect()
    assert len(rows) == len(ODD) and all(0 <= r["q"] <= 1 for r in rows)
    assert len({r["q"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert quality_pu.score(none, m, out="q").count() == 0
    assert {r["q"] for r in quality_pu.score(odd, quality_pu.fit(odd, good.limit(0)), out="q").collect()} == {0.0}


def test_language_query(spark):
    rows = queries.op9_language(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {r["doc_id"] for r in rows if r["held_out"]} == {r["doc_id"] for r in held}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.99


def brute_grams(text):
    """Every letter of the lower-cased text with what is beside it, an edge where that is no letter."""
    t = (text or "").lower()
    side = lambda i: ord(t[i]) if 0 <= i < len(t) and t[i].isalpha() else language_bloom.EDGE
    return [(side(i - 1) << 42) | (ord(t[i]) << 21) | side(i + 1) for i in range(len(t)) if t[i].isalpha()]


def test_language_filter_holds_its_ngrams(spark):
    """Every n-gram is found for its languages; others at about the predicted rate."""
    rng = np.random.default_rng(2)
    grams = {f"l{i:02}": rng.integers(1 << 60, size=300) for i in range(70)}
    m = language_bloom.build(spark.createDataFrame([(k, int(g), bool(g % 3)) for k, v in grams.items() for g in v], "lang string, gram long, strong boolean"))
    filters = language_bloom.Filters(m)
    assert m.languages == sorted(grams) and m.width() == 3
    for i, name in enumerate(m.languages):
        hits = filters.hits(grams[name])
        assert hits[0, :, i].all() and (hits[1, :, i] >= (grams[name] % 3 > 0)).all()
    assert m.false.max() < 1e-3 and filters.hits(rng.integers(1 << 60, size=20_000)).mean() < 1e-3


@pytest.mark.parametrize("n", [2_000, 40_000])
def test_false_positives_don_t_grow_with_the_corpus(spark, monkeypatch, n):
    """Two languages without a common n-gram, segments of a small forced size and few of them held: as many false positives at any number."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(language_bloom, "SEGMENT", 1 << 12)
    rows = spark.range(2 * n).select(F.when(F.col("id") < n, "a").otherwise("b").alias("lang"), F.xxhash64("id").alias("gram"), F.lit(True).alias("strong"))
    m = language_bloom.build(rows)
    grams = {r["lang"]: r["g"] for r in rows.groupBy("lang").agg(F.collect_list("gram").alias("g")).collect()}
    filters = language_bloom.Filters(m, 5 * (8 << 12))
    assert m.segments == -(-2 * n * language_bloom.ROOM // (1 << 12))
    for i, name in enumerate("ab"):
        hits = filters.hits(np.array(grams[name]))
        assert hits[:, :, i].all() and hits[0, :, 1 - i].mean() < 0.01 and abs(hits[0, :, 1 - i].mean() - m.false[0, 1 - i]) < 0.002
    assert len(filters.held) <= 5


def test_language_model_and_query_against_brute_force(spark):
    """Counts, membership and predictions by plain Python, the filters replaced by sets (so at their false positives' distance)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = {}
    for r in docs:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts.setdefault(r["lang"], Counter()).update(brute_grams(r["text"]))
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    best = Counter()
    for c in rate.values():
        for g, x in c.items():
            best[g] = max(best[g], x)
    strong = {k: {g for g, x in c.items() if x >= language_bloom.RIVAL * best[g]} for k, c in rate.items()}
    train = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").where(common.remainder(4) != 2)
    found = {}
    for r in language_bloom.members(language_bloom.gram_counts(train, "text", "lang")).collect():
        found.setdefault(r["lang"], {})[r["gram"]] = r["strong"]
    assert found == {k: {g: g in strong[k] for g in c} for k, c in rate.items()}, "every counted n-gram is in all its languages"
    texts = {r["doc_id"]: r["text"] for r in docs}
    for r in queries.op9_language(spark, SF).collect():
        grams = brute_grams(texts[r["doc_id"]])
        weight = lambda g, k: 1 if g in strong[k] else language_bloom.WEAK * (g in rate[k])
        share = {k: sum(weight(g, k) for g in grams) / max(1, len(grams)) for k in sorted(rate)}
        if not grams:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:
            assert share[r["lang_pred"]] > max(share.values()) - 0.01 and abs(r["score"] - share[r["lang_pred"]]) < 0.01


def test_results_replace_columns_of_their_name(spark, odd):
    """`odd` has columns score and ids: the results take their place, and all others stay."""
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 0)], "doc_id long, toxic int")
    m = language_bloom.fit(odd.withColumn("lang", F.lit("xx")))
    kinds = [
        (toxicity_fm.score(odd, toxicity_fm.fit(odd, labels)), {"score": "double"}),
        (quality_pu.score(odd, quality_pu.fit(odd, labels.select("doc_id"))), {"score": "double"}),
        (language_bloom.predict(odd.withColumn("LANG_pred", F.lit(1)), m), {"lang_pred": "string", "score": "double"}),
        (pair_index_bpe.with_ids(odd), {"ids": "array<int>"}),
    ]
    for df, new in kinds:
        assert sorted(df.columns) == sorted({*odd.columns, *new})
        assert {k: v for k, v in df.dtypes if k in new} == new and df.select(*new).count() == len(ODD)
    with pytest.raises(ValueError):
        toxicity_fm.score(odd, toxicity_fm.fit(odd, labels), out="Text")


def test_texts_beyond_a_slice(spark):
    """Texts of over 4 MB stand alone in a slice, and are scored whole."""
    long = "plain words of some length here. " * 150_000
    df = spark.createDataFrame([(1, "plain words"), (2, long), (3, "plain words"), (4, long + "hateful"), (5, "")], "doc_id long, text string").coalesce(1)
    m = toxicity_fm.Model(np.full(toxicity_fm.BUCKETS, -1, dtype=np.int32), -2.0, np.array([5.0]), np.zeros((1, 8)))
    m.slot[zlib.crc32(b"hateful", 1) % toxicity_fm.BUCKETS] = 0
    assert [round(r["score"], 3) for r in toxicity_fm.score(df, m).orderBy("doc_id").collect()] == [0.119, 0.119, 0.119, 0.953, 0.119]
    lm = language_bloom.fit(df.withColumn("lang", F.lit("en")))
    assert [r["lang_pred"] for r in language_bloom.predict(df, lm).orderBy("doc_id").collect()] == ["en"] * 4 + ["und"]
    q = quality_pu.score(df, quality_pu.fit(df, df.select("doc_id").limit(2))).orderBy("doc_id").collect()
    assert len(q) == 5 and q[0]["score"] == q[2]["score"]


def test_language_odd_rows(spark, odd, none):
    train = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") < 9, "yy"))
    m = language_bloom.fit(train.where("lang is not null"))
    rows = {r["doc_id"]: (r["lp"], r["ls"]) for r in language_bloom.predict(odd, m, lang_out="lp", score_out="ls").collect()}
    assert all(rows[i] == ("und", 0.0) for i in (0, 1, 2, 12)) and rows[5] == rows[6]
    # three of the four n-grams of `word` are at far higher rates in xx, whose text 8 says `words` 4000 times
    assert rows[3][0] == "xx"
    assert all(0 <= s <= 1 for _, s in rows.values())
    empty = language_bloom.fit(train.limit(0))
    assert {r["lp"] for r in language_bloom.predict(odd, empty, lang_out="lp", score_out="ls").collect()} == {"und"}
    assert language_bloom.predict(none, m, lang_out="lp", score_out="ls").count() == 0
    kept = language_bloom.reject(odd, m)
    assert kept.columns == odd.columns and kept.count() <= len(ODD) - 4


def test_fitting_takes_one_row_of_an_id(spark, monkeypatch):
    """A sampled id that most rows share brings one text to the driver, and the partitions' order doesn't matter."""
    rows = [(i, f"word{i} and more {'bad ' * (i % 2)}") for i in range(40)] + [(7, f"text {i}") for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity_fm, "learn", lambda y, row, bucket: seen.append((y.tolist(), row.tolist(), bucket.tolist())))
    monkeypatch.setattr(quality_pu, "learn", lambda good, other: seen.append((good.tolist(), other.tolist())))
    for order in (docs.coalesce(1), docs.orderBy(F.desc("text")).repartition(7)):
        toxicity_fm.fit(order, labels)
        quality_pu.fit(order, labels.where("toxic = 0"))
    assert seen[:2] == seen[2:] and seen[0][0] == [i % 2 for i in range(40)]
    assert (len(seen[1][0]), len(seen[1][1])) == (20, 40)
