"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words (runs of letters) and their first four and five letters, each hashed; a term
counts once. The machine scores sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>) over the terms present, so that
it learns which terms weigh more together. Of the hashed terms it keeps those whose presence goes with the label clearly,
by themselves or together with one other term, so that two terms which are toxic only as a pair come in as well. It is
fitted on a bounded sample of labelled rows, and applied to every whole text.

Null and empty texts have no terms and score sigmoid(w0); very long texts are scored whole, a term counting once; repeated
rows score alike; of an id's texts it learns from one; duplicate labels of an id count as toxic if one does; without labelled rows, or with labels of one kind,
the machine is a constant (sigmoid(-2), or sigmoid(2) if all are toxic); an empty table gives no rows; a column that has
the name of the result is replaced, other columns don't matter.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import append_columns, bounded_sample, fresh, owners, strings, words

#: Labelled rows that the machine is fitted on, at most (those whose id's hash is smallest).
FIT_ROWS = 8_000
#: Buckets of the term hash, a power of two.
BUCKETS = 1 << 20
#: Hashed terms that the machine keeps for themselves, at most, and its factors' width.
TERMS, FACTORS = 1024, 8
#: Least standard score of a term that is kept for itself.
LEAST_Z = 4
#: Terms whose pairs are counted (those whose presence varies most in the sample), least standard score of a pair whose terms are kept, least rows that have both.
PAIR_TERMS, LEAST_PAIR_Z, PAIR_ROWS = 2048, 10, 8
#: Most that a term's weight begins with.
ODDS = 3
#: Toxic rows weigh so many times the others in fitting.
TOXIC_WEIGHT = 3


@dataclass
class Model:
    slot: np.ndarray  # by bucket: the term's place in the machine, -1 for the others
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def hashed(terms: pa.Array, kind: int) -> np.ndarray:
    found = terms.dictionary_encode()
    codes = np.fromiter((zlib.crc32(t.encode(), kind) for t in strings(found.dictionary)), dtype=np.int64, count=len(found.dictionary))
    return (codes & (BUCKETS - 1)).astype(np.int32)[found.indices.to_numpy(zero_copy_only=False)] if len(codes) else np.zeros(0, dtype=np.int32)


def term_pairs(texts: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) for each distinct term of each text; with keep, only buckets that it maps to 0 or more, as mapped."""
    distinct, codes, offsets = words(pc.utf8_lower(pc.fill_null(texts, "")))
    parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(distinct, r"[^\p{L}]+", " ")))
    word, flat = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False), pc.list_flatten(parts)
    size = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
    of_word, buckets = [word[size > 0]], [hashed(flat, 1)[size > 0]]
    for n in (4, 5):
        longer = size >= n
        of_word.append(word[longer])
        buckets.append(hashed(pc.utf8_slice_codeunits(flat.filter(pa.array(longer)), 0, n), n))
    of_word, buckets = np.concatenate(of_word), np.concatenate(buckets)
    if keep is not None:
        buckets = keep[buckets]
        of_word, buckets = of_word[buckets >= 0], buckets[buckets >= 0]
    order = np.argsort(of_word, kind="stable")
    of_word, buckets = of_word[order], buckets[order]
    begins = np.searchsorted(of_word, np.arange(len(distinct) + 1))
    count = np.diff(begins)
    busy = count[codes] > 0
    row, codes = owners(offsets)[busy], codes[busy]
    each = count[codes]
    ends = np.cumsum(each)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[:-1][codes] - (ends - each), each)
    pairs = np.unique(np.repeat(row, each).astype(np.int64) << 32 | buckets[at])
    return pairs >> 32, pairs & 0xFFFFFFFF


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def machine(model: Model, rows: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The machine's value for each of so many rows of present terms."""
    value = model.bias + np.bincount(row, model.weight[term], minlength=rows)
    for v in model.factor.T:
        value += 0.5 * (np.bincount(row, v[term], minlength=rows) ** 2 - np.bincount(row, v[term] ** 2, minlength=rows))
    return value


def pair_scores(n: int, toxic: np.ndarray, row: np.ndarray, column: np.ndarray, columns: int) -> np.ndarray:
    """For each of so many terms, how far (in standard scores) the toxic rows that it has together with another term are from
    what both terms' own rates let expect, for the other term where that is most."""
    x = np.zeros((n, columns), dtype=np.float32)
    x[row, column] = 1
    marked = x[toxic]
    rate = marked.sum(axis=0) / np.maximum(x.sum(axis=0), 1)
    best = np.zeros(columns)
    for at in range(0, columns, 256):
        part = slice(at, at + 256)
        both, found = x[:, part].T @ x, marked[:, part].T @ marked
        expected = np.clip(both * (rate[part, None] + rate - toxic.mean()), 0.01 * both, 0.99 * both)
        spread = np.sqrt(np.maximum(expected * (1 - expected / np.maximum(both, 1)), 1e-9))
        z = np.where(both >= PAIR_ROWS, np.abs(found - expected) / spread, 0)
        z[np.arange(len(z)), at + np.arange(len(z))] = 0
        best[part] = z.max(axis=1)
    return best


def chosen_terms(toxic: np.ndarray, row: np.ndarray, bucket: np.ndarray, inside: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The buckets that the machine keeps: clear for themselves, or in a pair. inside, total: rows of each, toxic and all."""
    n = len(toxic)
    expected = total * toxic.mean()
    spread = np.sqrt(np.maximum(expected * (1 - toxic.mean()) * (1 - total / n), 1e-9))
    clear = np.where((total >= 4) & (total < n), np.abs(inside - expected) / spread, 0)
    alone = np.argsort(-clear, kind="stable")[:TERMS]
    alone = alone[clear[alone] > LEAST_Z]
    varied = total * (n - total)
    paired = np.argsort(-varied, kind="stable")[:PAIR_TERMS]
    paired = paired[varied[paired] > 0]
    place = np.full(BUCKETS, -1)
    place[paired] = np.arange(len(paired))
    known = place[bucket] >= 0
    paired = paired[pair_scores(n, toxic, row[known], place[bucket[known]], len(paired)) > LEAST_PAIR_Z]
    return np.concatenate([alone, np.setdiff1d(paired, alone)])


def learn(labels: np.ndarray, row: np.ndarray, bucket: np.ndarray, seed: int = 7, steps: int = 3000) -> Model:
    """Fits the machine to rows of present buckets."""
    n, toxic = len(labels), labels.astype(bool)
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    if not n or toxic.all() or not toxic.any():
        return Model(slot, 2.0 if n and toxic.all() else -2.0, np.zeros(1), np.zeros((1, FACTORS)))
    inside = np.bincount(bucket[toxic[row]], minlength=BUCKETS).astype(float)
    total = np.bincount(bucket, minlength=BUCKETS).astype(float)
    chosen = chosen_terms(toxic, row, bucket, inside, total)
    slot[chosen] = np.arange(len(chosen))
    x = np.zeros((n, max(1, len(chosen))), dtype=np.float32)
    known = slot[bucket] >= 0
    x[row[known], slot[bucket[known]]] = 1
    rng = np.random.default_rng(seed)
    odds = np.log((inside[chosen] + 0.5) / (toxic.sum() + 1)) - np.log((total[chosen] - inside[chosen] + 0.5) / (n - toxic.sum() + 1))
    weight = np.zeros(x.shape[1], dtype=np.float32)
    weight[: len(chosen)] = np.clip(odds, -ODDS, ODDS)  # weights begin at the terms' own odds
    factor = rng.normal(0, 0.02, (x.shape[1], FACTORS)).astype(np.float32)
    bias, step = np.float32(np.log(toxic.mean() / (1 - toxic.mean()))), 0
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weight, factor)]
    y = toxic.astype(np.float32)
    while step < steps:
        order = rng.permutation(n)
        for at in range(0, n, 256):
            step += 1
            part = order[at : at + 256]
            xb = x[part]
            sums = xb @ factor
            value = bias + xb @ weight + 0.5 * ((sums**2).sum(1) - (xb @ (factor**2)).sum(1))
            error = (sigmoid(value) - y[part]) * np.where(y[part] > 0, TOXIC_WEIGHT, 1) / len(part)
            bias -= np.float32(0.1 * error.sum())
            slopes = (xb.T @ error + 1e-5 * weight, xb.T @ (error[:, None] * sums) - (xb.T @ error)[:, None] * factor + 1e-4 * factor)
            for p, g, (m, s) in zip((weight, factor), slopes, state, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                p -= np.float32(0.02) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Model(slot, float(bias), weight.astype(float), factor.astype(float))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """labels: the rows to learn from, at most FIT_ROWS of them."""
    chosen = bounded_sample(labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")), FIT_ROWS, "_id")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")

    def start():
        def of(values: pa.Array) -> list[pa.Array]:
            row, bucket = term_pairs(values)
            ends = np.searchsorted(row, np.arange(len(values) + 1)) * 4
            return [pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(bucket.astype("<i4"))])]

        return of

    # an id gives one row, however many texts have it, and rows come in order of their ids
    rows = append_columns(texts, "_text", {"_terms": "binary"}, start).groupBy("_id").agg(F.max("_label").alias("_label"), F.min("_terms").alias("_terms")).toArrow().sort_by("_id")
    terms = [np.frombuffer(t.as_buffer(), dtype="<i4") for t in rows["_terms"]]
    row = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    return learn(np.array(rows["_label"].to_pylist(), dtype=np.int64), row, np.concatenate(terms) if terms else np.zeros(0, dtype=np.int32))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of every text, in place of a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def of(texts: pa.Array) -> list[pa.Array]:
            row, term = term_pairs(texts, shared.value.slot)
            return [pa.array(sigmoid(machine(shared.value, len(texts), row, term)), pa.float64())]

        return of

    return append_columns(docs, text_col, {out: "double"}, start)


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without those that score threshold or more."""
    out = fresh(docs, "_toxicity")
    return score(docs, model, out=out).where(F.col(out) < threshold).drop(out)
