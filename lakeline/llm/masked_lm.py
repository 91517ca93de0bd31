"""Masked pseudo-likelihood of texts.

A bidirectional window network predicts every word from the two words on either side. Words are counted over the whole
corpus: the commonest `OWN` have an entry of their own (a documented bound of the network's size), all others share
`SHARED` entries by hash. The network gives the chance of an entry's class and of the entry in its class, both from the
same hidden values, so that every entry is predicted from the context. Which word of a shared entry it is follows from
its count in the other documents, (n - own + PRIOR) / (mass + PRIOR * kinds), where `own` is what the document itself
counts, and mass and kinds are the shared entry's occurrences and distinct words. These counts have a row for each
document and word; they are summed up by a shuffle and never held whole. The sum of a text's log-chances is its score; so
every word is scored given all its neighbours, itself left out.

Training is synchronous: a round goes over every word of all texts, in `LEGS` parts of the texts. In each part every
partition of the corpus takes gradient steps from the same weights on every word of its texts of that part, and the
partitions' weights are averaged, weighted by their words, by a shuffle in pieces. What is gathered, counts of words and a row of weights for each partition,
grows with the corpus; the weights themselves have one size.

Words are told apart by a 64-bit hash. Texts are cut into words once, in slices of about 4 MB; a longer text is a slice of
its own. Null and empty texts have no words and score 0; a single word is predicted from edge marks; repeated rows
score alike; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import binary_array, slices, strings, sums, words, written

#: Words with an entry of their own, shared entries, classes of entries; entry 0 marks a text's edges.
OWN, SHARED, CLASSES = 4096, 256, 64
ENTRIES, IN_CLASS = 1 + OWN + SHARED, (OWN + SHARED) // CLASSES
WIDTH, SIDE = 16, (-2, -1, 1, 2)
#: Rounds over all words, and the parts of a round after each of which weights are averaged (a text is in one of them).
ROUNDS, LEGS = 1, 4
#: Words in a gradient step, at first and at most (a step has an eighth of the words before it), and AdaGrad's rate.
FIRST_WORDS, STEP_WORDS, RATE = 512, 16384, 0.15
#: What is added to the count of every word of a shared entry.
PRIOR = 0.1
#: Weights in one piece of the averaging, and partitions summed in one group.
PIECE, GROUP = 1 << 14, 64


@dataclass
class Vocabulary:
    own: np.ndarray  # hashes of the words with an own entry, ascending
    rank: np.ndarray  # their places by count, from 0
    mass: np.ndarray  # of an entry: occurrences
    kinds: np.ndarray  # of an entry: distinct words

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        """The words' entries."""
        shared = (1 + OWN + hashes % SHARED).astype(np.uint16)
        if not len(self.own):
            return shared
        at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
        return np.where(self.own[at] == hashes, 1 + self.rank[at], shared).astype(np.uint16)


def cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per slice: a number for its first text, the texts' ids, their numbers of words (32 bits each), all words as
    numbers (32 bits) of the slice's distinct words, and those words' hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, longs = TaskContext.get().partitionId() << 40, pa.list_(pa.int64())
        for batch in batches:
            for piece in slices(batch, 1):
                distinct, codes, offsets = words(piece.column(1))
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in strings(distinct.cast(pa.binary()))), dtype=np.uint64, count=len(distinct)).view(np.int64)
                codes = codes.astype("<i4") if len(codes) else np.zeros(0, dtype="<i4")
                lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (piece.column(0), pa.array(hashes), pa.array(np.bincount(codes, minlength=len(distinct))))]
                raw = [pa.array([x.tobytes()], pa.binary()) for x in (np.diff(offsets).astype("<i4"), codes)]
                yield pa.RecordBatch.from_arrays([pa.array([first]), lists[0].cast(longs), *raw, lists[1].cast(longs), lists[2].cast(longs)], names=["first", "ids", "sizes", "codes", "hashes", "counts"])
                first += len(piece)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "first long, ids array<long>, sizes binary, codes binary, hashes array<long>, counts array<long>")


def word_rows(pieces: DataFrame) -> DataFrame:
    """Rows (h, n): the distinct words of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), batch.column(1).flatten()], names=["h", "n"])

    return pieces.select("hashes", "counts").mapInArrow(run, "h long, n long")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: (h, n) of all words. At most OWN + SHARED rows come to the driver."""
    top = counts.orderBy(F.desc("n"), "h").limit(OWN).toArrow()
    own = top["h"].to_numpy()
    mass, kinds = np.zeros(ENTRIES), np.zeros(ENTRIES)
    mass[1 : 1 + len(own)], kinds[1 : 1 + len(own)] = top["n"].to_numpy(), 1
    least = counts.sparkSession.createDataFrame([(int(h),) for h in own], "h long")
    rest = counts.join(F.broadcast(least), "h", "left_anti").groupBy(F.pmod("h", F.lit(SHARED)).alias("b")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).toArrow()
    at = 1 + OWN + rest["b"].to_numpy().astype(np.int64)
    mass[at], kinds[at] = rest["n"].to_numpy(), rest["kinds"].to_numpy()
    order = np.argsort(own)
    return Vocabulary(own[order], order, mass, kinds)


def coded(pieces: DataFrame, v: Vocabulary) -> DataFrame:
    """Rows (key, doc_id, entries) of all texts: a number of its own, and 16 bits for each word's entry."""
    shared = pieces.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, sizes, codes, hashes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                entries = shared.value.entries(hashes.values.to_numpy())[np.frombuffer(codes, dtype="<i4")].astype("<u2")
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, dtype="<i4"), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(ids))), ids.values, binary_array(entries.view(np.uint8), ends * 2)], names=["key", "doc_id", "entries"])

    return pieces.select("first", "ids", "sizes", "codes", "hashes").mapInArrow(run, "key long, doc_id long, entries binary")


def shares(pieces: DataFrame, counts: DataFrame, v: Vocabulary) -> DataFrame:
    """Rows (key, share): the sum of the log-shares that a text's words have of their shared entries, by the other texts' counts.

    Words with an entry of their own are left out before the shuffle; a word that many texts have is spread over tasks by the join with the counts.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(v.own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sizes, codes, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                h, code, sizes = hashes.values.to_numpy(), np.frombuffer(codes, dtype="<i4"), np.frombuffer(sizes, dtype="<i4")
                rare = ~np.isin(h, shared.value)[code]
                pair, n = np.unique(np.repeat(np.arange(len(sizes)), sizes)[rare] * max(1, len(h)) + code[rare], return_counts=True)
                text, word = np.divmod(pair, max(1, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(first + text), pa.array(h[word]), pa.array(n.astype(np.int64))], names=["key", "h", "n"])

    rows = pieces.select("first", "sizes", "codes", "hashes").mapInArrow(run, "key long, h long, n long")
    room = F.element_at(F.lit((v.mass + PRIOR * v.kinds)[1 + OWN :].tolist()), (F.pmod("h", F.lit(SHARED)) + 1).cast("int"))
    elsewhere = F.col("total") - F.col("n")
    return rows.join(counts.withColumnRenamed("n", "total"), "h").withColumn("share", F.col("n") * F.log((elsewhere + PRIOR) / room)).groupBy("key").agg(F.sum("share").alias("share"))


def start_weights(v: Vocabulary) -> np.ndarray:
    """All weights in one row: a vector per entry and side, hidden biases, classes, entries in their classes.

    The biases begin at the counts, so that without training an entry's chance is its share of the corpus.
    """
    rng = np.random.default_rng(11)
    mass = (v.mass[1:] + PRIOR).reshape(CLASSES, IN_CLASS)
    of_class = mass.sum(axis=1)
    vectors, none = rng.normal(0, 0.1, len(SIDE) * ENTRIES * WIDTH), lambda n: np.zeros(n * WIDTH)
    return np.concatenate([vectors, none(1), none(CLASSES), np.log(of_class / of_class.sum()), none(CLASSES * IN_CLASS), np.log(mass / of_class[:, None]).ravel()]).astype(np.float32)


def parts(weights: np.ndarray) -> list[np.ndarray]:
    """Vectors, hidden biases, classes, class biases, entries by class, their biases: views of one row of weights."""
    shapes = ((len(SIDE), WIDTH, ENTRIES), (WIDTH,), (CLASSES, WIDTH), (CLASSES,), (CLASSES, IN_CLASS, WIDTH), (CLASSES, IN_CLASS))
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [weights[e - int(np.prod(s)) : e].reshape(s) for s, e in zip(shapes, ends, strict=True)]


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all texts with two edge marks around each, and the words' places."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype="<u2")
    sizes = np.array([len(x) // 2 for x in column.to_pylist()] if len(column) else [], dtype=np.int64)
    places = np.arange(len(raw)) + 2 + 4 * np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(len(raw) + 4 * len(sizes), dtype=np.int64)
    out[places] = raw
    return out, places


def softmax(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of values turned, in place, into the exponentials of their distances from the largest, and these columns' sums."""
    value -= value.max(axis=0)
    np.exp(value, out=value)
    return value, value.sum(axis=0)


def forward(weights: np.ndarray, entries: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Of places whose targets are in order of their classes: hidden values, (class, from, to) of the places, and the values
    of all classes and of the entries in the target's class, before the softmax; a column per place."""
    vectors, bias, classes, class_bias, inner, inner_bias = parts(weights)
    hidden = vectors[0].take(entries[at + SIDE[0]], axis=1)
    for side in range(1, len(SIDE)):
        hidden += vectors[side].take(entries[at + SIDE[side]], axis=1)
    hidden += bias[:, None]
    np.tanh(hidden, out=hidden)
    bounds = np.searchsorted((entries[at] - 1) // IN_CLASS, np.arange(CLASSES + 1)).tolist()
    runs = [(c, a, b) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
    within = np.empty((IN_CLASS, len(at)), dtype=np.float32)
    for c, a, b in runs:
        within[:, a:b] = inner[c] @ hidden[:, a:b] + inner_bias[c][:, None]
    return hidden, runs, classes @ hidden + class_bias[:, None], within


def by_class(entries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order of places by their targets' classes."""
    return np.argsort(((entries[at] - 1) // IN_CLASS).astype(np.uint8), kind="stable")


def steps(weights: np.ndarray, squares: np.ndarray, entries: np.ndarray, places: np.ndarray, seen: int = 0, rate: float = RATE) -> None:
    """Gradient steps (with AdaGrad) on the words at places, after so many seen, weights changed in place."""
    vectors, _, classes, _, inner, inner_bias = own = parts(weights)
    held = parts(squares)
    end = 0
    while end < len(places):
        begin, end = end, end + min(STEP_WORDS, max(FIRST_WORDS, (seen + end) // 8))
        at = places[begin:end]
        at = at[by_class(entries, at)]
        column, target = np.arange(len(at)), entries[at] - 1
        hidden, runs, slope, within = forward(weights, entries, at)
        for value in (slope, within):
            value /= softmax(value)[1]
        slope[target // IN_CLASS, column] -= 1
        within[target % IN_CLASS, column] -= 1
        back = classes.T @ slope
        g_inner, g_inner_bias = np.zeros_like(inner), np.zeros_like(inner_bias)
        for c, a, b in runs:
            back[:, a:b] += inner[c].T @ within[:, a:b]
            g_inner[c], g_inner_bias[c] = within[:, a:b] @ hidden[:, a:b].T, within[:, a:b].sum(axis=1)
        g_classes = slope @ hidden.T
        back *= 1 - hidden * hidden
        g_vectors = np.empty_like(vectors)
        for side, distance in enumerate(SIDE):
            beside = entries[at + distance]
            for k in range(WIDTH):
                g_vectors[side, k] = np.bincount(beside, back[k], minlength=ENTRIES)
        for p, s, g in zip(own, held, (g_vectors, back.sum(axis=1), g_classes, slope.sum(axis=1), g_inner, g_inner_bias), strict=True):
            g /= np.float32(len(at))
            s += g * g
            g /= np.sqrt(s) + np.float32(1e-6)
            g *= np.float32(rate)
            p -= g


def trained(texts: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The weights after so many rounds over texts (key, entries, ..)."""
    weights = start_weights(v)
    context = texts.sparkSession.sparkContext
    for leg in range(rounds * LEGS):
        shared = context.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, seen = shared.value.copy(), 0
            squares = np.full(len(own), 1e-8, dtype=np.float32)
            for batch in batches:
                for piece in slices(batch, 0):
                    entries, places = flat_texts(piece.column(0))
                    steps(own, squares, entries, places, seen)
                    seen += len(places)
            if seen:
                cut = [own[i : i + PIECE] for i in range(0, len(own), PIECE)]
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_pydict({"piece": pa.array(range(len(cut)), pa.int32()), "part": pa.array([part] * len(cut), pa.int32()), "n": pa.array([float(seen)] * len(cut)), "w": pa.array([(c * np.float32(seen)).tobytes() for c in cut], pa.binary())})

        def add(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(w, dtype=np.float32).astype(np.float64) for w in rows["w"].to_pylist())
            return pa.table({"piece": rows["piece"][:1], "part": pa.array([rows["part"][0].as_py() // GROUP], pa.int32()), "n": pa.array([sum(rows["n"].to_pylist())]), "w": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        kind = "piece int, part int, n double, w binary"
        total = texts.where(F.pmod(F.xxhash64("key"), F.lit(LEGS)) == leg % LEGS).select("entries").mapInArrow(run, kind)
        left = texts.rdd.getNumPartitions()
        while left > 1:  # groups of groups, until each piece has one row
            total = total.groupBy("piece", F.floor(F.col("part") / GROUP)).applyInArrow(add, kind)
            left = -(-left // GROUP)
        rows = total.orderBy("piece").toArrow()
        if rows.num_rows:
            weights = np.concatenate([np.frombuffer(w, dtype=np.float32) / np.float32(n) for w, n in zip(rows["w"].to_pylist(), rows["n"].to_pylist(), strict=True)])
    return weights


def log_chances(weights: np.ndarray, entries: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The log-chance of the entry at every place."""
    out = np.zeros(len(places))
    for begin in range(0, len(places), STEP_WORDS):
        at = places[begin : begin + STEP_WORDS]
        order = by_class(entries, at)
        at = at[order]
        _, _, *values = forward(weights, entries, at)
        column, target = np.arange(len(at)), entries[at] - 1
        for value, place in zip(values, (target // IN_CLASS, target % IN_CLASS), strict=True):
            value, total = softmax(value)
            out[begin + order] += np.log(np.maximum(value[place, column], 1e-30) / total)
    return out


def networked(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """Rows (key, doc_id, n_words, entries_value): the sum of the log-chances of a text's entries."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2):
                entries, places = flat_texts(piece.column(2))
                n = np.array([len(x) // 2 for x in piece.column(2).to_pylist()], dtype=np.int64)
                value = sums(log_chances(shared.value, entries, places), np.concatenate([[0], np.cumsum(n)]))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(n), pa.array(value, pa.float64())], names=["key", "doc_id", "n_words", "entries_value"])

    return texts.select("key", "doc_id", "entries").mapInArrow(run, "key long, doc_id long, n_words long, entries_value double")


def scored(texts: DataFrame, weights: np.ndarray, share: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, log_likelihood, per_word) of texts (key, doc_id, entries) and their shares (key, share)."""
    both = networked(texts, weights).join(share, "key", "left").withColumn("log_likelihood", F.col("entries_value") + F.coalesce("share", F.lit(0.0)))
    return both.select("doc_id", "n_words", "log_likelihood", (F.col("log_likelihood") / F.greatest("n_words", F.lit(1))).alias("per_word"))


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Vocabulary, DataFrame]:
    """The coded texts (key, doc_id, entries), the vocabulary, and the texts' shares (key, share)."""
    pieces = written(cut(docs, id_col, text_col), "pieces")
    counts = written(word_rows(pieces).groupBy("h").agg(F.sum("n").alias("n")), "counts")
    v = vocabulary(counts)
    return written(coded(pieces, v), "coded"), v, shares(pieces, counts, v)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Trains on docs and scores each of them: rows (doc_id, n_words, log_likelihood, per_word)."""
    texts, v, share = prepared(docs, id_col, text_col)
    return scored(texts, trained(texts, v, rounds), share)
