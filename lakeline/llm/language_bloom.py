"""Language identification by n-gram filters that answer for all languages at once.

Of every language's training texts the letter n-grams (three characters of a lower-cased word with an edge mark on
either side) are counted over the whole corpus. Every counted n-gram is in the filters of all languages that have it. The filters
are bit-sliced: one table of slots, each slot a bitmask of languages, so that the masks at an n-gram's slots, combined
with AND, name all languages that contain it. A second plane of bits names those that have it at `RIVAL` of its highest rate
in any language (uses per n-gram of the language) or more: a hit there counts 1, one in the first plane alone `WEAK`, so that what
texts in another language bring in counts little.

The table has `ROOM` slots per counted n-gram, whatever their number, so false positives don't grow with the corpus. It is cut into
segments of `SEGMENT` slots; an n-gram's slots are all in the segment that its hash names. Spark sets a segment's bits where its n-grams meet, and
stores it in the shared folder; nothing of it passes the driver. A task reads the segments that its texts ask for and holds `HELD` bytes of
them. A text's hits per language are counted, freed of the false positives that the filters' fill predicts, and the language with most of
them wins, ties to the name that sorts first.

Null texts, and texts without a letter, get `und` and score 0; very long texts count whole; the score is the winner's
corrected share of the text's n-grams; without training rows every text is `und`; repeated rows are predicted alike; an
empty table gives no rows; columns that have the results' names are replaced, other columns don't matter.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm.common import append_columns, fresh, owners, shared_dir, slices, store, strings, sums, words, written

#: Least part of an n-gram's highest rate in any language from which a hit counts whole, and what a hit below counts.
RIVAL, WEAK = 0.1, 0.1
#: Slots per counted n-gram, slots of a segment (a power of two), slots per n-gram.
ROOM, SEGMENT, HASHES = 16, 1 << 16, 3
#: Bytes of segments that a task holds.
HELD = 256 << 20
UNKNOWN = "und"
EDGE = 1  # a code below every letter's


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


LETTER = letter_table()


def gram_keys(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, n-gram key) for every n-gram of the distinct words; other characters than letters part words."""
    chars = np.frombuffer("\0".join(strings(distinct)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(chars):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = np.cumsum(chars == 0)
    letter = LETTER[chars]
    code = np.where(letter, chars, EDGE)
    left, right = np.full(len(code), EDGE), np.full(len(code), EDGE)
    left[1:] = code[:-1]
    right[:-1] = code[1:]
    return word[letter], (left << 42 | code << 21 | right)[letter]


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well mixed 64-bit hashes of keys."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def places(keys: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each key in its segment of so many."""
    return [(mixed(keys, seed) & np.uint64(slots - 1)).astype(np.int64) for seed in range(1, HASHES + 1)]


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(keys, 0) % np.uint64(segments)).astype(np.int64)


@dataclass
class Model:
    """languages, the folder of the segments, their number and slots, and of both planes each language's share of false positives."""

    languages: list[str]
    folder: str
    segments: int
    slots: int
    false: np.ndarray

    def width(self) -> int:
        """64-bit words of a slot: a bit for each plane and language."""
        return max(1, -(-2 * len(self.languages) // 64))


class Filters:
    """A model's segments as a task uses them: read when they are asked for, the ones used last are held."""

    def __init__(self, model: Model, most: int = HELD):
        self.model, self.most, self.held = model, most, OrderedDict()

    def segment(self, number: int) -> np.ndarray:
        """The masks (slot by word) of a segment; one without an n-gram isn't stored."""
        if number not in self.held:
            files, folder = store(self.model.folder)
            path = f"{folder}/segment={number}"
            found = np.zeros((self.model.slots, self.model.width()), dtype=np.uint64)
            if files.get_file_info(path).type.name == "Directory":
                raw = dataset.dataset(path, filesystem=files, format="parquet").to_table(columns=["masks"]).column(0)
                found = np.frombuffer(raw[0].as_buffer(), dtype=np.uint64).reshape(self.model.slots, -1)
            while self.held and (len(self.held) + 1) * found.nbytes > self.most:
                self.held.popitem(last=False)
            self.held[number] = found
        self.held.move_to_end(number)
        return self.held[number]

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each key the planes and languages that have it, as bits."""
        out = np.zeros((len(keys), self.model.width()), dtype=np.uint64)
        where, slots = segment_of(keys, self.model.segments), places(keys, self.model.slots)
        order = np.argsort(where, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            if len(group):
                table = self.segment(int(where[group[0]]))
                out[group] = np.bitwise_and.reduce([table[at[group]] for at in slots])
        return out

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """(plane, key, language): which of the keys each language has, and has at a rate that counts whole."""
        n = len(self.model.languages)
        bits = np.unpackbits(self.masks(keys).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        return bits[:, : 2 * n].reshape(-1, 2, n).transpose(1, 0, 2)


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Rows (lang, gram, n) over all texts whose language is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 0):
                names = piece.column(1).dictionary_encode()
                distinct, codes, offsets = words(pc.utf8_lower(pc.fill_null(piece.column(0), "")))
                word, key = gram_keys(distinct)
                keys, index = np.unique(key, return_inverse=True)
                lang = names.indices.to_numpy(zero_copy_only=False)[owners(offsets)]
                for i, name in enumerate(names.dictionary.to_pylist()):
                    uses = np.bincount(codes[lang == i], minlength=len(distinct))
                    count = np.bincount(index, uses[word], minlength=len(keys)).astype(np.int64)
                    seen = count > 0
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * int(seen.sum()), pa.string()), "gram": pa.array(keys[seen], pa.int64()), "n": pa.array(count[seen], pa.int64())})

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def members(counts: DataFrame) -> DataFrame:
    """Rows (lang, gram, strong): which n-gram is in which languages, and whether at a rate that counts whole there."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    return rates.select("lang", "gram", (F.col("rate") >= RIVAL * best).alias("strong"))


def build(grams: DataFrame) -> Model:
    """The filters of all languages from rows (lang, gram, strong), segment by segment."""
    spark = grams.sparkSession
    languages = sorted(r[0] for r in grams.select("lang").distinct().collect())
    slots = SEGMENT
    segments = max(1, -(-ROOM * grams.select("gram").distinct().count() // slots))
    number, n = {name: i for i, name in enumerate(languages)}, len(languages)
    model = Model(languages, f"{shared_dir(spark)}/filters", segments, slots, np.zeros((2, n)))
    width = model.width()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            keys, strong = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            where = segment_of(keys, segments)
            for at in places(keys, slots):
                for bit, own in ((lang, np.ones(len(lang), dtype=bool)), (lang + n, strong)):
                    mask = (np.uint64(1) << (bit % 64).astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (where, at, bit // 64, mask)], names=["segment", "slot", "part", "mask"])

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        masks = np.zeros((slots, width), dtype=np.uint64)
        masks[rows["slot"].to_numpy(), rows["part"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
        filled = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : 2 * n].mean(axis=0)
        return pa.table({"segment": pa.array([key[0].as_py()]), "masks": pa.array([masks.tobytes()], pa.binary()), "filled": pa.array([filled.tolist()], pa.list_(pa.float64()))})

    bits = grams.mapInArrow(place, "segment long, slot long, part long, mask long").groupBy("segment", "slot", "part").agg(F.bit_or("mask").alias("mask"))
    # a segment has no more rows than slots and words
    built = bits.groupBy("segment").applyInArrow(join, "segment long, masks binary, filled array<double>")
    built.write.partitionBy("segment").parquet(model.folder)
    if n:
        filled = spark.read.schema("filled array<double>").parquet(model.folder).select(F.posexplode("filled").alias("bit", "share"))
        # a row for each plane and language
        sums = {r["bit"]: r["rate"] for r in filled.groupBy("bit").agg((F.sum(F.col("share") ** HASHES) / segments).alias("rate")).collect()}
        model.false = np.array([sums.get(i, 0.0) for i in range(2 * n)]).reshape(2, n)
    return model


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """docs: the training rows, whose language is not null."""
    return build(written(members(gram_counts(docs, text_col, lang_col)), "grams"))


def predict_texts(filters: Filters, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's winner (-1: none) and score."""
    n, false = len(filters.model.languages), filters.model.false
    if not n:
        return np.full(len(texts), -1), np.zeros(len(texts))
    distinct, codes, offsets = words(pc.utf8_lower(pc.fill_null(texts, "")))
    word, key = gram_keys(distinct)
    keys, index = np.unique(key, return_inverse=True)
    hits = filters.hits(keys)
    of_word = np.stack([np.bincount(word, plane[index, i], minlength=len(distinct)) for plane in hits for i in range(n)] + [np.bincount(word, minlength=len(distinct)).astype(float)], axis=1)
    total = sums(of_word[codes], offsets)
    grams, planes = total[:, -1], total[:, :-1].reshape(-1, 2, n)
    true = (planes - grams[:, None, None] * false) / np.maximum(1 - false, 1e-9)
    counted = WEAK * true[:, 0] + (1 - WEAK) * true[:, 1]
    best = np.argmax(counted, axis=1)
    share = np.clip(counted[np.arange(len(best)), best] / np.maximum(grams, 1), 0, 1)
    return np.where(grams > 0, best, -1), np.where(grams > 0, share, 0.0)


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with the predicted language and its score."""

    def start():
        filters, names = Filters(model), pa.array([*model.languages, UNKNOWN], pa.string())

        def of(texts: pa.Array) -> list[pa.Array]:
            best, share = predict_texts(filters, texts)
            return [names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(share, pa.float64())]

        return of

    return append_columns(docs, text_col, {lang_out: "string", score_out: "double"}, start)


def reject(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """docs without those of unknown language, or whose language has under the least share of their n-grams."""
    lang, score = fresh(docs, "_lang_pred"), fresh(docs, "_lang_score")
    return predict(docs, model, lang_out=lang, score_out=score).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
