"""Quality by positive-unlabelled learning.

Trusted positives (rows labelled good) and unlabelled texts of the corpus train a small network on measures of a text's
form. The share of good texts among the unlabelled, the class prior, is estimated first: the least ratio of unlabelled
to positive mass above a threshold of a plain positive-against-unlabelled score. The network then minimises the
non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). Labels of bad rows are
never used. Both samples are bounded; the score is given to every whole text.

Null and empty texts have zero measures and get a score too; very long texts are measured whole; repeated rows score
alike; of an id's texts it learns from one; duplicate labels of an id count as good if one does; without positives every score is 0; an empty table gives no
rows; a column that has the result's name is replaced, other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import append_columns, bounded_sample, owners, sums, text_bytes, words

#: Positives and unlabelled texts that the network is fitted on, at most (those whose id's hash is smallest).
FIT_ROWS = 12_000
HIDDEN = 16
#: Shares of the positives below the thresholds at which the class prior is read: few, as the least of many is too low.
PRIOR_AT = (0.0, 0.02, 0.05, 0.1, 0.2)
MEASURES = ("log_words", "word_chars", "distinct", "repeat_next", "upper", "symbol", "bang", "bar", "digit", "stop", "comma", "line_words", "dup_lines", "top_word", "wide")


def byte_classes() -> dict[str, np.ndarray]:
    def of(chars: str) -> np.ndarray:
        out = np.zeros(256, dtype=bool)
        out[list(chars.encode())] = True
        return out

    upper = np.zeros(256, dtype=bool)
    upper[65:91] = True
    digit = np.zeros(256, dtype=bool)
    digit[48:58] = True
    wide = np.zeros(256, dtype=bool)
    wide[0xC0:] = True
    return {"upper": upper, "symbol": of("#*$%&<>{}[]\\^~_=+@/"), "bang": of("!?"), "bar": of("|"), "digit": digit, "stop": of("."), "comma": of(",;:"), "wide": wide, "line": of("\n")}


def measures(texts: pa.Array) -> np.ndarray:
    """The measures of each text, a row each."""
    distinct, codes, offsets = words(texts)
    data, ends = text_bytes(texts)
    n = np.diff(offsets).astype(float)
    rows = len(n)
    size = np.diff(ends).astype(float)
    count = {k: sums(c[data].view(np.int8), ends).astype(float) for k, c in byte_classes().items()}
    letters = sums(pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes], offsets).astype(float)
    row = owners(offsets)
    pair, uses = np.unique(row.astype(np.int64) * max(1, len(distinct)) + codes, return_counts=True)
    pair_row = pair // max(1, len(distinct))
    kinds = np.bincount(pair_row, minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, pair_row, uses)
    same = np.zeros(len(codes), dtype=np.int64)
    same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    line_row, flat = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False), pc.list_flatten(lines).dictionary_encode()
    line_kinds = np.bincount(np.unique(line_row.astype(np.int64) * max(1, len(flat.dictionary)) + flat.indices.to_numpy(zero_copy_only=False)) // max(1, len(flat.dictionary)), minlength=rows)
    n_lines = count["line"] + 1
    per_word, per_byte = 1 / np.maximum(n, 1), 1 / np.maximum(size, 1)
    found = {
        "log_words": np.log1p(n) / 4, "word_chars": np.minimum(letters * per_word, 60) / 5, "distinct": kinds * per_word, "repeat_next": sums(same, offsets) * per_word,
        "line_words": np.log1p(n / n_lines), "dup_lines": 1 - line_kinds / n_lines, "top_word": most * per_word,
    }
    found |= {k: np.sqrt(count[k] * per_byte) for k in ("upper", "symbol", "bang", "bar", "digit", "stop", "comma", "wide")}
    return np.stack([found[k] for k in MEASURES], axis=1)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3][0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def back(layers: list[np.ndarray], x: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
    inner = slope[:, None] * layers[2] * (1 - hidden**2)
    return [x.T @ inner, inner.sum(0), hidden.T @ slope, np.array([slope.sum()])]


def train(good: np.ndarray, other: np.ndarray, prior: float | None, seed: int = 5, steps: int = 1200) -> list[np.ndarray]:
    """The network for log-loss. With a prior, by the non-negative risk; without, positives against unlabelled."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 0.3, (good.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    state, step = [[np.zeros_like(p), np.zeros_like(p)] for p in layers], 0
    batches = max(1, len(other) // 512)
    while step < steps:
        for gi, oi in zip(np.array_split(rng.permutation(len(good)), batches), np.array_split(rng.permutation(len(other)), batches), strict=True):
            step += 1
            if not len(gi) or not len(oi):
                continue
            hg, vg = forward(layers, good[gi])
            ho, vo = forward(layers, other[oi])
            pg, po = sigmoid(vg), sigmoid(vo)
            if prior is None:
                slopes = [a + b for a, b in zip(back(layers, good[gi], hg, (pg - 1) / len(gi)), back(layers, other[oi], ho, po / len(oi)), strict=True)]
            else:
                negative = np.mean(-np.log(1 - po + 1e-9)) - prior * np.mean(-np.log(1 - pg + 1e-9))
                from_other = [a - b for a, b in zip(back(layers, other[oi], ho, po / len(oi)), back(layers, good[gi], hg, prior * pg / len(gi)), strict=True)]
                if negative >= 0:
                    slopes = [a + b for a, b in zip(from_other, back(layers, good[gi], hg, prior * (pg - 1) / len(gi)), strict=True)]
                else:  # the negative part went below zero: step back up
                    slopes = [-a for a in from_other]
            for p, g, (m, s) in zip(layers, slopes, state, strict=True):
                g = g + 1e-4 * p
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return layers


def class_prior(good: np.ndarray, other: np.ndarray) -> float:
    """The share of good texts among the others: least ratio of their mass above a threshold that most positives pass."""
    if not len(good) or not len(other):
        return 0.5
    ratios = [(other >= t).mean() / (good >= t).mean() for t in np.quantile(good, PRIOR_AT)]
    return float(np.clip(min(ratios), 0.02, 0.98))


def learn(good: np.ndarray, other: np.ndarray) -> Model:
    both = np.concatenate([good, other])
    if not len(good) or not len(other):
        return Model(np.zeros(len(MEASURES)), np.ones(len(MEASURES)), [], 0.0)
    centre, scale = both.mean(0), both.std(0) + 0.05
    good, other = np.clip((good - centre) / scale, -8, 8), np.clip((other - centre) / scale, -8, 8)
    # the prior is read from rows that the plain score was not trained on
    layers = train(good[::2], other[::2], None, steps=400)
    prior = class_prior(forward(layers, good[1::2])[1], forward(layers, other[1::2])[1]) if min(len(good), len(other)) > 3 else 0.5
    return Model(centre, scale, train(good, other, prior), prior)


def apply(model: Model, x: np.ndarray) -> np.ndarray:
    return sigmoid(forward(model.layers, np.clip((x - model.centre) / model.scale, -8, 8))[1]) if model.layers else np.zeros(len(x))


def fit(docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """good_ids: ids of trusted positives. Unlabelled texts are drawn from all of docs."""
    good = bounded_sample(good_ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct(), FIT_ROWS, "_id").withColumn("_good", F.lit(True))
    other = bounded_sample(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct(), FIT_ROWS, "_id").withColumn("_good", F.lit(False))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(good.unionByName(other)), "_id").select("_good", "_id", "_text")

    def start():
        return lambda values: [pa.FixedSizeListArray.from_arrays(pa.array(measures(values).ravel()), len(MEASURES)).cast(pa.list_(pa.float64()))]

    # an id gives one row, however many texts have it, and rows come in order of their ids
    rows = append_columns(texts, "_text", {"_measures": "array<double>"}, start).groupBy("_good", "_id").agg(F.min("_measures").alias("_measures")).toArrow().sort_by([("_good", "ascending"), ("_id", "ascending")])
    x = np.array(rows["_measures"].to_pylist(), dtype=float).reshape(-1, len(MEASURES))
    which = np.array(rows["_good"].to_pylist(), dtype=bool)
    return learn(x[which], x[~which])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score (0 to 1, the chance that it is good) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        return lambda texts: [pa.array(apply(shared.value, measures(texts)), pa.float64())]

    return append_columns(docs, text_col, {out: "double"}, start)
