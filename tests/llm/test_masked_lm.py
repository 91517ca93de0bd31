"""The masked language model: vocabulary, shares and scores against plain Python, training with the query's own setting."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lakeline.llm import masked_lm, queries
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.01"


def plain_vocabulary(mass=5.0):
    """A vocabulary in which every entry has about the same mass."""
    return masked_lm.Vocabulary(np.arange(masked_lm.OWN), np.arange(masked_lm.OWN), np.full(masked_lm.ENTRIES, mass), np.ones(masked_lm.ENTRIES))


def random_weights(seed):
    return np.random.default_rng(seed).normal(0, 0.3, len(masked_lm.start_weights(plain_vocabulary()))).astype(np.float32)


def chances(weights, entries, p):
    """The chances of all entries at a place, by plain loops."""
    vectors, bias, classes, class_bias, inner, inner_bias = masked_lm.parts(weights)
    h = np.tanh(bias + sum(vectors[s][:, entries[p + d]] for s, d in enumerate(masked_lm.SIDE)))
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    of_class = soft(classes @ h + class_bias)
    return np.concatenate([of_class[c] * soft(inner[c] @ h + inner_bias[c]) for c in range(masked_lm.CLASSES)])


def test_formula_and_sum():
    """Every word's log-chance as plain loops have it; the chances of all entries add up to one."""
    weights = random_weights(0)
    entries, places = masked_lm.flat_texts(pa.array([np.array([5, 7, 5, 4200], dtype="<u2").tobytes(), b""], pa.binary()))
    assert entries.tolist() == [0, 0, 5, 7, 5, 4200, 0, 0, 0, 0, 0, 0] and places.tolist() == [2, 3, 4, 5]
    found = masked_lm.log_chances(weights, entries, places)
    for i, p in enumerate(places):
        plain = chances(weights, entries, p)
        assert len(plain) == masked_lm.ENTRIES - 1 and math.isclose(plain.sum(), 1, rel_tol=1e-4)
        assert math.isclose(found[i], math.log(plain[entries[p] - 1]), rel_tol=1e-3)


def test_gradient_is_that_of_the_loss():
    """The first AdaGrad step goes against the sign of the loss's numeric slope."""
    weights = random_weights(3).astype(np.float64)
    entries = np.array([0, 0, 5, 4200, 70, 5, 0, 0])
    places = np.arange(2, 6)
    moved, squares = weights.astype(np.float32), np.full(len(weights), 1e-8, dtype=np.float32)
    masked_lm.steps(moved, squares, entries, places)
    loss = lambda w: -masked_lm.log_chances(w, entries, places).sum()
    changed = np.flatnonzero(np.abs(moved - weights) > 0.02)
    picked = np.random.default_rng(1).choice(changed, 60, replace=False)
    for i in picked:
        up, down = weights.copy(), weights.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        slope = loss(up) - loss(down)
        assert abs(slope) < 1e-8 or np.sign(slope) == -np.sign(moved[i] - weights[i])


def brute_scores(docs):
    """Untrained: an entry's share of the corpus, and the word's share in its entry by the other documents' counts."""
    texts = {i: (t or "").encode().split() for i, t in docs}
    h = lambda w: np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64)
    counts = Counter(h(w) for ws in texts.values() for w in ws)
    own = [x for x, _ in sorted(counts.items(), key=lambda r: (-r[1], r[0]))[: masked_lm.OWN]]
    entry = {x: 1 + i for i, x in enumerate(own)} | {x: int(1 + masked_lm.OWN + x % masked_lm.SHARED) for x in counts if x not in set(own)}
    mass, kinds = Counter(), Counter()
    for x, n in counts.items():
        mass[entry[x]] += n
        kinds[entry[x]] += 1
    total = sum(mass.values()) + masked_lm.PRIOR * (masked_lm.ENTRIES - 1)
    out = {}
    for i, ws in texts.items():
        here, score = Counter(h(w) for w in ws), 0.0
        for x, n in here.items():
            e = entry[x]
            score += n * math.log((mass[e] + masked_lm.PRIOR) / total)
            if e > masked_lm.OWN:
                score += n * math.log((counts[x] - n + masked_lm.PRIOR) / (mass[e] + masked_lm.PRIOR * kinds[e]))
        out[i] = (len(ws), score)
    return out


def test_counts_and_shares_against_plain_python(spark):
    """8000 kinds of words, so that about half share entries; untrained, the score follows from the counts alone."""
    r = random.Random(4)
    kinds = [f"k{i}é" for i in range(8000)]
    docs = [(i, None if i == 7 else " ".join(r.choices(kinds, k=r.randrange(0, 300)))) for i in range(120)]
    docs += [(500 + i, t) for i, t in docs[:20]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in masked_lm.score(df, rounds=0).collect()}
    for i, (n, score) in brute_scores(docs).items():
        assert rows[i]["n_words"] == n and math.isclose(rows[i]["log_likelihood"], score, rel_tol=1e-3, abs_tol=1e-6)


def test_every_word_is_a_target(spark):
    """Each word stands once: as a target it moves its own weights in its class; once these are there, as a neighbour its vectors."""
    entries = np.arange(1, 1 + masked_lm.OWN, dtype="<u2")
    df = spark.createDataFrame([(0, 0, bytearray(entries.tobytes()))], "key long, doc_id long, entries binary")
    v = plain_vocabulary()
    before, after = (masked_lm.parts(w) for w in (masked_lm.start_weights(v), masked_lm.trained(df, v, rounds=2)))
    assert (before[4] != after[4]).any(axis=2).ravel()[entries - 1].all()
    beside = (before[0] != after[0]).any(axis=1)
    assert beside[masked_lm.SIDE.index(-1), entries[:-1]].all() and beside[masked_lm.SIDE.index(1), entries[1:]].all()


def test_query_setting_learns_order(spark):
    """Words in the order of the corpus are likelier than the same words shuffled, with the query's own rounds."""
    rng = np.random.default_rng(6)
    names = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(names[(s + k) % 40] for s in rng.integers(0, 40, n) for k in range(8))
    docs = [(i, text(60)) for i in range(60)]
    mixed = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in docs[:10]]
    df = spark.createDataFrame(docs + mixed, "doc_id long, text string").repartition(2)
    rows = {r["doc_id"]: r["per_word"] for r in masked_lm.score(df).collect()}
    assert all(rows[i] > rows[1000 + i] + 0.3 for i in range(10))


def slow_training(texts, v):
    """The weights after one round by plain loops over words: texts in order, as (leg, entries), one partition."""
    weights = masked_lm.start_weights(v).astype(np.float64)
    for leg in range(masked_lm.LEGS):
        squares, seen = np.full(len(weights), 1e-8), 0
        own = [e for at, e in texts if at == leg]
        words = [(e, i) for e in own for i in range(len(e))]
        while seen < len(words):
            batch = words[seen : seen + min(masked_lm.STEP_WORDS, max(masked_lm.FIRST_WORDS, seen // 8))]
            seen += len(batch)
            vectors, bias, classes, class_bias, inner, inner_bias = masked_lm.parts(weights)
            slopes = np.zeros(len(weights))
            g_vectors, g_bias, g_classes, g_class_bias, g_inner, g_inner_bias = masked_lm.parts(slopes)
            for e, i in batch:
                beside = [e[i + d] if 0 <= i + d < len(e) else 0 for d in masked_lm.SIDE]
                h = np.tanh(bias + sum(vectors[s][:, x] for s, x in enumerate(beside)))
                c, k = divmod(e[i] - 1, masked_lm.IN_CLASS)
                outer, within = (np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in (classes @ h + class_bias, inner[c] @ h + inner_bias[c]))
                outer[c] -= 1
                within[k] -= 1
                back = (classes.T @ outer + inner[c].T @ within) * (1 - h * h)
                for s, x in enumerate(beside):
                    g_vectors[s][:, x] += back
                g_bias += back
                g_classes += np.outer(outer, h)
                g_class_bias += outer
                g_inner[c] += np.outer(within, h)
                g_inner_bias[c] += within
            slopes /= len(batch)
            squares += slopes**2
            weights -= masked_lm.RATE * slopes / (np.sqrt(squares) + 1e-6)
    return weights


def test_trained_query_against_plain_loops(spark):
    """The whole query on a small corpus: training by loops over words, then each word's chance, then shares by counts."""
    r = np.random.default_rng(5)
    names = [f"w{int(x)}" for x in r.integers(0, 60, 400)]
    docs = [(i, " ".join(names[a : a + 25])) for i, a in enumerate(range(0, 400, 25))]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    texts, v, share = masked_lm.prepared(df)
    coded = [(x["leg"], np.frombuffer(x["entries"], dtype="<u2").astype(int)) for x in texts.selectExpr(f"pmod(xxhash64(key), {masked_lm.LEGS}) as leg", "entries", "key").orderBy("key").collect()]
    assert texts.rdd.getNumPartitions() == 1 and {leg for leg, _ in coded} == set(range(masked_lm.LEGS))
    weights = slow_training(coded, v)
    assert np.abs(masked_lm.trained(texts, v) - weights).max() < 2e-3 and np.abs(weights - masked_lm.start_weights(v)).max() > 0.1
    found = {x["doc_id"]: x["log_likelihood"] for x in masked_lm.score(df).collect()}
    extra = {x["doc_id"]: x["share"] for x in texts.join(share, "key", "left").collect()}
    for (doc, _), (_, e) in zip(docs, coded):
        flat, places = np.concatenate([[0, 0], e, [0, 0]]), np.arange(2, 2 + len(e))
        value = sum(math.log(chances(weights, flat, p)[e[p - 2] - 1]) for p in places)
        assert math.isclose(found[doc], value + (extra[doc] or 0), abs_tol=0.05)


def test_held_out_gain(spark):
    """On texts that it wasn't trained on the network is clearly likelier than the words' shares of the corpus."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts, v, share = masked_lm.prepared(docs)
    held = texts.where("doc_id % 5 = 0")
    mean = lambda w: masked_lm.scored(held, w, share).selectExpr("sum(log_likelihood) / sum(n_words)").first()[0]
    assert mean(masked_lm.trained(texts.where("doc_id % 5 <> 0"), v)) > mean(masked_lm.start_weights(v)) + 0.1


def test_query(spark):
    rows = queries.op7_masked_lm(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["n_words"] for r in rows} == {i: len(t.encode().split()) for i, t in docs.items()}
    assert all(math.isclose(r["per_word"] * r["n_words"], r["log_likelihood"], rel_tol=1e-9) for r in rows)


def test_odd_rows(spark, odd, none):
    rows = {r["doc_id"]: r for r in masked_lm.score(odd).collect()}
    assert len(rows) == len(ODD) and all(rows[i]["log_likelihood"] == 0 and rows[i]["n_words"] == 0 for i in (0, 1, 2))
    assert rows[5]["log_likelihood"] == pytest.approx(rows[6]["log_likelihood"]) and rows[3]["log_likelihood"] < 0
    assert masked_lm.score(none).count() == 0


def test_text_beyond_a_slice(spark):
    """A text of over 4 MB is a slice of its own; slices change no counts."""
    docs = [(0, "a b c"), (1, "d e " * 1_200_000), (2, "a b c"), (3, "f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r["log_likelihood"] for r in masked_lm.score(df, rounds=0).collect()}
    assert all(math.isclose(rows[i], score, rel_tol=1e-3) for i, (_, score) in brute_scores(docs).items())
