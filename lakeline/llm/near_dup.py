"""Near-duplicate documents by b-bit MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct five-word shingles. Its signature has `COMPONENTS` MinHash values of 16 bits; two
documents whose sets have Jaccard similarity s differ in each value with a chance of about 1 - s. All pairs whose
signatures differ in at most `RADIUS` values are found: the signature is split into `CHUNKS` chunks, so that of RADIUS
errors one chunk has at most RADIUS // CHUNKS = 1, and that one error is enumerated by leaving each value of the chunk out
in turn. Documents that share such a key meet in a bucket. A pair differs in more than RADIUS of the values with a chance
(binomial) of about 1 in 290,000 at the similarity 0.85, op10's lowest that links, and of about 1 in 7,000 at 0.8, the
pipeline's.

Equal sets are first folded into their smallest id. In a bucket every member is compared with one: the member that shares
the most keys with others, which in a group of edited copies is close to all. Most groups are connected by that. What
remains, members of one bucket that are not yet connected, is compared in blocks, only between different components. For
those that still have a near signature there, two exact bounds say how much two sets can share: a document's shingles that
no other such document has are in no common part, and of the shingles that fall into one of `CELLS` cells by their hash two
sets share at most the smaller number. Most pairs that are not similar enough go by these bounds alone. A pair counts as a link when the
whole shingle sets, made anew from the texts, have the similarity; so the classes are those of all links within the
radius, and no bucket, group or class is capped or collected.

Null and empty texts have an empty set and are linked with nothing; texts of one to four words have one shingle, all
their words; very long texts have their whole set; repeated rows with one id are one document (equal texts), a null id stays out of all links and is its own
class (null); an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm.common import slices, strings, words, written

SHINGLE = 5
COMPONENTS, CHUNKS, RADIUS = 32, 8, 15
PER_CHUNK = COMPONENTS // CHUNKS
#: Members of a bucket in one block of the comparison that follows, and blocks that one task compares with all others of the bucket.
BLOCK, TASK_BLOCKS = 128, 8
#: Cells that a set's shingles are counted in (a byte each; a set with a fuller cell goes by its other bound).
CELLS = 128
#: Ids (8 bytes each) that may be broadcast to pick their texts; beyond, the join is left to Spark.
BROADCAST_IDS = 1_000_000
#: Multipliers of the shingle hash, odd 64-bit numbers.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit hashes."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def component_seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, COMPONENTS, dtype=np.uint64)


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of each text's shingles, and len + 1 offsets into them."""
    distinct, codes, offsets = words(texts, lower_ascii=True)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in strings(distinct.cast(pa.binary()))), dtype=np.uint64, count=len(distinct))
    h = own[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    n = np.diff(offsets)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], count)
    size = np.repeat(np.minimum(n, SHINGLE), count)
    out = size.astype(np.uint64) * FACTORS[0]
    for k in range(SHINGLE):
        inside = size > k
        out[inside] = mixed(out[inside] ^ h[at[inside] + k]) * FACTORS[k]
    return out, ends


def sketch(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Each text's set size, a digest of its set, its signature (16-bit values), and its shingles per cell (bytes)."""
    hashes, ends = shingle_hashes(texts)
    a, b = component_seeds()
    n = len(ends) - 1
    size, digest, signature, cells = np.zeros(n, dtype=np.int64), [b""] * n, np.zeros((n, COMPONENTS), dtype="<u2"), np.zeros((n, CELLS), dtype=np.uint8)
    for i in range(n):
        own = np.unique(hashes[ends[i] : ends[i + 1]])
        size[i] = len(own)
        if len(own):
            digest[i] = xxhash.xxh3_128_digest(own.tobytes())
            least = np.full(COMPONENTS, np.iinfo(np.uint64).max, dtype=np.uint64)
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                least = np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
            signature[i] = (mixed(least) >> np.uint64(48)).astype("<u2")
            cells[i] = np.minimum(np.bincount((own % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255)
    return size, digest, signature, cells


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n_shingles, digest, signature, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                size, digest, *rest = sketch(piece.column(1))
                raw = [pa.array([row.tobytes() for row in x], pa.binary()) for x in rest]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), *raw], names=["doc_id", "n_shingles", "digest", "signature", "cells"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary, cells binary")


def keys(nodes: DataFrame) -> DataFrame:
    """Rows (key, node, signature): for each chunk, its values but one, with the chunk's and the left-out value's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u2").reshape(-1, CHUNKS, PER_CHUNK).astype(np.int64)
            out = np.empty((len(values), CHUNKS, PER_CHUNK), dtype=np.int64)
            for gap in range(PER_CHUNK):
                key = np.zeros(values.shape[:2], dtype=np.int64)
                for k in range(PER_CHUNK):
                    if k != gap:
                        key = key << 16 | values[:, :, k]
                out[:, :, gap] = key << 5 | (np.arange(CHUNKS) * PER_CHUNK + gap)
            row = np.repeat(np.arange(len(values)), COMPONENTS)
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel()), batch.column(0).take(pa.array(row))], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def near(a: str, b: str) -> F.Column:
    """Whether two signatures (binary) differ in at most RADIUS values."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def of(x, y):
        import pandas as pd

        one, two = (np.frombuffer(b"".join(s), dtype="<u2").reshape(-1, COMPONENTS) for s in (x, y))
        return pd.Series((one != two).sum(axis=1) <= RADIUS)

    return of(a, b)


def picked(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the documents with these ids; rows that share an id are one document."""
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    small = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if small else ids, "id").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of pairs (a, b), those whose whole shingle sets have at least that similarity."""

    def grams(text: bytes) -> set:
        w = text.split()
        return set(zip(*(w[k:] for k in range(SHINGLE)))) if len(w) >= SHINGLE else {tuple(w)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_text, held = None, set()
        for batch in batches:
            linked = []
            # bytes, so that words are parted at the six ASCII white spaces and only A-Z is lowered
            for one, two in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if one != held_text:
                    held_text, held = one, grams(one.lower())
                other = grams(two.lower())
                common = len(held & other)
                linked.append(100 * common >= percent * (len(held) + len(other) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    ends = [pairs.select(F.col(side).alias("id")).distinct() for side in ("a", "b")]
    ids = written(ends[0].unionByName(ends[1]).distinct(), "ids")
    needed = written(picked(docs, ids, id_col, text_col), "texts")
    one = needed.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = needed.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for all ends of edges (a, b): component is the smallest node reachable.

    Large-star and small-star in turn, until the edges are stars; each round's edges are written out. Rounds grow with the logarithm of the nodes.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "edges")
        # settled: every node has one target, and no target has one
        rows, distinct = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if rows == distinct and not edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").take(1):
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with their component, themselves if found has none."""
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def first_key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The place (chunk and left-out value) of the first key that two signatures share: there their pair counts, in other buckets not."""
    same = (one == two).reshape(-1, CHUNKS, PER_CHUNK)
    return (same.sum(axis=2, keepdims=True) - same == PER_CHUNK - 1).reshape(-1, COMPONENTS).argmax(axis=1)


def mixed_blocks(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets that hold several components, in blocks of bounded size, members in order of their components.

    `most` marks the blocks of the bucket's largest component. A component of more than a block is dealt to groups by its members, others go to groups
    whole, before blocks are numbered; so no group holds much more than a block.
    """
    members = buckets.join(labels, "node")
    parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("own"))
    mixed_keys = parts.groupBy("key").agg(F.sum("own").alias("size"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("own", "component")).alias("top")).where("parts > 1")
    told = parts.join(mixed_keys, "key").select("key", "component", "own", "size", (F.col("component") == F.col("top.component")).alias("most"))
    alone = F.xxhash64("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / BLOCK)))
    salt = F.when(F.col("own") > BLOCK, alone).otherwise(F.pmod(F.xxhash64("component"), F.ceil(F.col("size") / BLOCK)))
    spread = members.join(told, ["key", "component"]).withColumn("salt", salt)
    ordered = spread.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("key", "most", "salt").orderBy("component", "node")) - 1) / BLOCK))
    return ordered.groupBy("key", "most", "salt", "part").agg(F.first("size").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.sort_array(F.collect_list(F.struct("node", "component", "signature"))).alias("rows"))


def dealt(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks as both sides of the comparison, by key and group."""
    # the blocks of a large bucket are dealt to several tasks on the one side; on the other those that are not of its largest
    # component go to all of these: of two members of different components one is not in the largest
    groups = F.ceil(F.col("size") / (BLOCK * TASK_BLOCKS))
    left = blocks.select("key", F.pmod(F.xxhash64("salt", "part"), groups).alias("group"), F.col("most").alias("m1"), F.col("salt").alias("s1"), F.col("part").alias("p1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("rows").alias("rows1"))
    right = blocks.where(~F.col("most")).select("key", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"), F.col("salt").alias("s2"), F.col("part").alias("p2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("rows").alias("rows2"))
    return left, right


def unlike(blocks: DataFrame, pick, kind: str) -> DataFrame:
    """Compares each two blocks of a bucket that don't hold one same component; pick gives rows from their near members.

    pick(columns of the one block, of the other, places of near pairs in both) returns rows (as a matrix) of schema kind.
    Each pair is taken up in one bucket, that of its first key. A task gives a row once per batch; rows of a single column,
    which are no more than its members, once altogether.
    """
    names = [part.split()[0] for part in kind.split(",")]
    extra = [c for c in blocks.schema["rows"].dataType.elementType.names if c not in ("node", "component", "signature")]
    left, right = dealt(blocks)
    each_two = F.expr("(m1 or s1 < s2 or (s1 = s2 and p1 <= p2)) and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)")
    tasks = left.join(right, ["key", "group"]).where(each_two).select("key", "rows1", "rows2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows) -> dict:
            matrix = lambda c, kind, width: np.frombuffer(b"".join(rows.field(c).to_pylist()), dtype=kind).reshape(-1, width)
            plain = {c: rows.field(c).to_numpy() for c in ("node", "component", *extra) if c != "cells"}
            return plain | {"signature": matrix("signature", "<u2", COMPONENTS)} | ({"cells": matrix("cells", np.uint8, CELLS)} if "cells" in extra else {})

        seen = np.zeros((0, 1), dtype=np.int64)
        for batch in batches:
            found = []
            for key, one, two in zip(batch.column(0).to_numpy(), batch.column(1), batch.column(2), strict=True):
                x, y = of(one.values), of(two.values)
                differ = np.zeros((len(x["node"]), len(y["node"])), dtype=np.int8)
                for k in range(COMPONENTS):
                    differ += x["signature"][:, k][:, None] != y["signature"][:, k][None, :]
                i, j = np.nonzero((differ <= RADIUS) & (x["component"][:, None] != y["component"][None, :]))
                first = first_key(x["signature"][i], y["signature"][j]) == key % COMPONENTS
                if first.any():
                    found.append(pick(x, y, i[first], j[first]))
            if found:
                rows = np.unique(np.concatenate(found), axis=0)
                if len(names) == 1:
                    rows = np.setdiff1d(rows, seen).reshape(-1, 1)
                    seen = np.union1d(seen, rows).reshape(-1, 1)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, c], pa.int64()) for c in range(len(names))], names=names)

    return tasks.mapInArrow(run, kind)


def active_nodes(blocks: DataFrame) -> DataFrame:
    """Members that have a near one of another component: each once."""
    def pick(x: dict, y: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([x["node"][i], y["node"][j]])).reshape(-1, 1)

    return unlike(blocks, pick, "node long").distinct()


def own_shingles(active: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, own): how many of a document's shingles no other active document has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                hashes, ends = shingle_hashes(piece.column(1))
                own = [np.unique(hashes[a:b]) for a, b in zip(ends, ends[1:])]
                row = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), pa.array(np.concatenate(own).view(np.int64))], names=["node", "shingle"])

    rows = picked(docs, active.select(F.col("node").alias("id")), id_col, text_col).select("id", "text").mapInArrow(run, "node long, shingle long")
    # one row per shingle: how many have it, and one that does
    counts = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    return counts.where("node = other").groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def most_common(x: dict, y: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For members i of x and j of y, a number that their sets' common part is not above."""
    most = np.minimum((x["n"] - x["own"])[i], (y["n"] - y["own"])[j])
    exact = (x["cells"].max(axis=1)[i] < 255) | (y["cells"].max(axis=1)[j] < 255)  # one of two bounds a cell, if one is not full
    by_cell = np.concatenate([np.minimum(x["cells"][i[at : at + 4096]], y["cells"][j[at : at + 4096]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), 4096)])
    return np.where(exact, np.minimum(most, by_cell), most)


def cross_pairs(blocks: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Distinct near pairs (a, b) of different components whose sets may have the similarity.

    sizes: (node, n, own, cells).
    """
    member = blocks.select("key", "most", "salt", "part", "size", "lo", "hi", F.explode("rows").alias("r")).select("key", "most", "salt", "part", "size", "lo", "hi", "r.*").join(sizes, "node")
    rebuilt = member.groupBy("key", "most", "salt", "part").agg(F.first("size").alias("size"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("node", "component", "signature", "n", "own", "cells"))).alias("rows"))

    def pick(x: dict, y: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = most_common(x, y, i, j)
        may = 100 * most >= percent * (x["n"][i] + y["n"][j] - most)
        one, two = x["node"][i[may]], y["node"][j[may]]
        return np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1)

    return unlike(rebuilt, pick, "a long, b long").distinct()


def classes(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of docs."""
    sketched = written(sketches(docs, id_col, text_col), "sketches")
    filled = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # a digest's documents fold into their smallest id; the signature follows from the set
    folded = written(filled.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("cells").alias("cells"), F.max("n_shingles").alias("n")), "folded")
    nodes = folded.select("node", "signature")
    keyed = keys(nodes)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(keyed.join(shared, "key"), "buckets")
    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = written(buckets.select("key", "node").join(weight, "node"), "weighed")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("p")).select("key", (-F.col("p.node")).alias("pivot"), F.col("p.weight").alias("weight"))
    tips = nodes.select(F.col("node").alias("pivot"), F.col("signature").alias("pivot_signature"))
    edges = weighed.select("key", "node").join(pivots, "key").where("node <> pivot").select("pivot", "weight", "node").distinct()
    stars = edges.join(nodes, "node").join(tips, "pivot").where(near("signature", "pivot_signature"))
    first = written(stars.groupBy("node").agg(F.max_by("pivot", F.struct("weight", "pivot")).alias("pivot")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "first")
    links = written(confirmed(first, docs, percent, id_col, text_col), "links")
    found = written(components(links), "components")
    blocks = written(mixed_blocks(buckets.select("key", "node"), labelled(nodes, found)), "blocks")
    active = written(active_nodes(blocks), "active")
    own = own_shingles(active, docs, id_col, text_col)
    sizes = written(active.join(folded.select("node", "n", "cells"), "node").join(own, "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).cast("long").alias("own"), "cells"), "sizes")
    rest = written(cross_pairs(blocks, sizes, percent).join(first, ["a", "b"], "left_anti"), "rest")
    if rest.take(1):
        more = confirmed(rest, docs, percent, id_col, text_col)
        found = written(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")
    member = folded.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    joined = sketched.join(member, "digest", "left")
    alone = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", alone.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents whose class has one with a smaller id."""
    gone = classes(docs, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
