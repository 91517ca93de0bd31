"""Exact Jaccard join of n-gram sets that skips by relations between sets.

Equal sets are folded first. Then two relations save work:

*Relations within lists.* Every set indexes its prefix, the first tokens in one global order of which any similar set must have
one. Rare tokens come first: what repeats inside a slice of the corpus is counted in a table of fixed size by the tokens' hash, tokens are
ordered by the binary logarithm of their count there, and by hash. An index list is in order of set size and token
position and cut into blocks of equal size and position. What two entries' sizes and positions let their sets share at most is
the same for two whole blocks, so blocks are skipped as wholes; of what stays, entries are compared by 64-bit parities of their
sets, which bound the difference of two sets from below.

*Relations between sets.* Sets that share a MinHash value with a heavier set, and differ from it in at most half as many tokens as
that has, become its followers: (leader, tokens it lacks, tokens it has more). What a follower shares with any other follower is derived
from the leader's answer: |y & z| = |r| - |lacks y| - |lacks z| + |lacks y & lacks z| + |more y & more z|. Two followers of which not both
are linked to the leader can only be similar if their differences have a token in common; so the differences are joined as small sets of their own, by the
same lists, prefixes (in order of their exact counts) and blocks, with the derived bound. Whole sets of one leader are never compared with each other.

Candidates of the lists must pass a second bound: of the tokens in one cell of their hashes two sets share at most the smaller number.
What is left of both joins is confirmed exactly, on differences or on whole token sets. Tokens are 64-bit hashes; two texts'
sets are taken for another by a collision with a chance of about 1e-13 a pair. Leaders, parities and the order of tokens only
save work: results don't depend on them. No list, group or class is capped; followers' long lists are cut in parts, one list of whole sets' prefixes is
held by one task (what all texts share comes last in the order, and so is in few prefixes).

Null and empty texts have an empty set and link with nothing; texts with fewer words than an n-gram have one token, all their
words; very long texts have their whole set; rows that share an id are one document (equal texts), those without an id are a class of their
own (null); an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import slices, strings, words, written
from lakeline.llm.near_dup import components, labelled, mixed, picked

#: MinHash values that leaders are found by, and rounds of finding them.
KEYS, ROUNDS = 8, 2
#: Counters of repeated tokens (a byte each, which every task holds); tokens that share one are taken for equally frequent.
COUNTERS = 1 << 21
#: Cells that a set's tokens are counted in (a byte each), for a bound on what two sets share.
CELLS = 256
#: Entries of followers' lists that one task takes; the lists of a large group are cut.
LIST = 50_000
#: Entries of a list that are compared one by one; longer lists go block by block.
SHORT_LIST = 48
#: Multipliers of the token hash, odd 64-bit numbers.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def token_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' n-grams of so many words (all words, if fewer), and len + 1 offsets into them."""
    distinct, codes, offsets = words(texts, lower_ascii=True)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in strings(distinct.cast(pa.binary()))), dtype=np.uint64, count=len(distinct))
    h = own[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], count)
    length = np.repeat(np.minimum(n, size), count)
    out = length.astype(np.uint64) * FACTORS[0]
    for k in range(size):
        inside = length > k
        out[inside] = mixed(out[inside] ^ h[at[inside] + k]) * FACTORS[k % len(FACTORS)]
    return out, ends


def token_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    hashes, ends = token_hashes(texts, size)
    return [np.unique(hashes[a:b]) for a, b in zip(ends, ends[1:])]


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n_shingles, digest, mins, cells, often): a set's size, digest, MinHash values and tokens by cell; a slice's first row has
    counters of the tokens that repeat in it."""
    rng = np.random.default_rng(20170801)
    a, b = rng.integers(0, 1 << 63, KEYS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, KEYS, dtype=np.uint64)
    counters = COUNTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                sets = token_sets(piece.column(1), size)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets]
                mins = [[int(v) for v in (mixed(np.array([(s * p + q).min() for p, q in zip(a, b)])) >> np.uint64(1)).astype(np.int64)] if len(s) else [] for s in sets]
                cells = [np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes() for s in sets]
                tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
                sums = np.bincount(counter(tokens[counts > 1], counters), counts[counts > 1])
                at = np.flatnonzero(sums)
                often = [[{"counter": int(c), "n": int(k)} for c, k in zip(at, sums[at])]] + [None] * (len(sets) - 1)
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.struct([("counter", pa.int64()), ("n", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([piece.column(0), *[pa.array(x, k) for x, k in zip((n, digests, mins, cells, often), kinds)]], names=["doc_id", "n_shingles", "digest", "mins", "cells", "often"])

    spec = "doc_id long, n_shingles long, digest binary, mins array<long>, cells binary, often array<struct<counter: long, n: long>>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, spec)


def counter(tokens: np.ndarray, counters: int) -> np.ndarray:
    return (tokens % np.uint64(counters)).astype(np.int64)


def frequencies(sketched: DataFrame) -> np.ndarray:
    """For each counter the binary logarithm of the repeated tokens counted there (0: none), a byte each."""
    rows = sketched.select(F.explode("often").alias("o")).groupBy("o.counter").agg(F.sum("o.n").alias("n")).select(F.col("counter").cast("int"), F.ceil(F.log2(F.col("n") + 1)).cast("byte").alias("level")).toArrow()
    table = np.zeros(COUNTERS, dtype=np.uint8)
    table[rows["counter"].to_numpy()] = rows["level"].to_numpy()
    return table


def leaders(nodes: DataFrame) -> DataFrame:
    """Edges (node, leader): nodes whose heaviest neighbour in a MinHash bucket is no one's follower. nodes: (node, mins)."""
    keyed = nodes.select("node", F.posexplode("mins").alias("at", "value")).select("node", F.xxhash64("at", "value").alias("key"))
    # stored by themselves, so that Spark can split the joins' hot keys
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    buckets = written(keyed.join(shared, "key"), "buckets")
    weight = buckets.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = written(buckets.select("key", "node").join(weight, "node"), "weighed")
    rank = F.struct("weight", (-F.col("node")).alias("back"))
    heaviest = written(weighed.groupBy("key").agg(F.max(rank).alias("best")), "heaviest")
    choice = weighed.select("key", "node").join(heaviest, "key").groupBy("node").agg((-F.max("best")["back"]).alias("leader"))
    chosen = written(choice, "choice")
    roots = chosen.where("node = leader").select(F.col("node").alias("leader"))
    return chosen.where("node <> leader").join(roots, "leader", "left_semi")


def sets_of(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, tokens) of the documents with these ids (a column id): the sorted 64-bit tokens as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([s.tobytes() for s in token_sets(piece.column(1), size)], pa.binary())], names=["node", "tokens"])

    return picked(docs, ids, id_col, text_col).select("id", "text").mapInArrow(run, "node long, tokens binary")


def held_sets(raw: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in raw.to_pylist()]


def differences(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Of edges (node, leader) those that make a follower: (node, leader, n, n_leader, lacks, more), the last two arrays of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, leader, own, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), held_sets(batch.column(2)), held_sets(batch.column(3))):
                lacks, more = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
                if 2 * (len(lacks) + len(more)) <= len(other):
                    rows.append((node, leader, len(own), len(other), lacks.view(np.int64).tolist(), more.view(np.int64).tolist()))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["node", "leader", "n", "n_leader", "lacks", "more"])

    own = sets.select("node", F.col("tokens").alias("own"))
    other = sets.select(F.col("node").alias("leader"), F.col("tokens").alias("other"))
    joined = edges.join(own, "node").join(other, "leader").select("node", "leader", "own", "other")
    return joined.mapInArrow(run, "node long, leader long, n long, n_leader long, lacks array<long>, more array<long>")


def near_entries(run: dict, factor: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of a list's entries may be of similar sets, if this token is the first that they share."""
    n, pos, need = run["n"], run["pos"], run["need"]
    most = np.minimum(np.minimum(n[i] - pos[i], n[j] - pos[j]), (n[i] + n[j] - pos[i] - pos[j]) >> 1)
    may = factor * most >= need[i] + need[j]
    may &= (run["node"][i] != run["node"][j]) & (run["group"][i] != run["group"][j]) & (run["linked"][i] != run["linked"][j])
    i, j, at = i[may], j[may], np.flatnonzero(may)
    apart = np.bitwise_count((run["parity"][i] ^ run["parity"][j]).view(np.uint64)).astype(np.int64)
    kept = np.zeros(len(may), dtype=bool)
    kept[at[factor * ((n[i] + n[j] - apart) >> 1) >= need[i] + need[j]]] = True
    return kept


def list_pairs(run: dict, factor: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in one list, in order of size and position, whose sets may be similar."""
    n, pos, need = run["n"], run["pos"], run["need"]
    starts = np.flatnonzero((np.diff(n, prepend=-1) != 0) | (np.diff(pos, prepend=-1) != 0))
    ends, least = np.append(starts[1:], len(n)), np.minimum.reduceat(need, starts)
    size, place = n[starts], pos[starts]
    for b, (start, end) in enumerate(zip(starts, ends)):
        # blocks from this one on that sizes and positions let share enough
        most = np.minimum(np.minimum(size[b] - place[b], size[b:] - place[b:]), (size[b] + size[b:] - place[b] - place[b:]) >> 1)
        for at in np.flatnonzero(factor * most >= least[b] + least[b:]) + b:
            width = ends[at] - starts[at]
            for first in range(start, end, max(1, (1 << 20) // width)):
                own = np.arange(first, min(end, first + max(1, (1 << 20) // width)))
                i, j = np.repeat(own, width), np.tile(np.arange(starts[at], ends[at]), len(own))
                kept = near_entries(run, factor, i, j) & (i < j)
                if kept.any():
                    yield i[kept], j[kept]


ENTRY = ["token", "n", "pos", "need", "node", "group", "linked", "parity"]


def candidates(entries: DataFrame, factor: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes whose sets may share enough: factor * common >= need a + need b.

    entries: (token, n, pos, need, node, group, linked, parity), n a set's size, pos the token's place in its order; nodes of
    one group or one linked class are not paired. Every token of a set up to the last that a partner could first share must be there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def pairs(rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            starts = np.flatnonzero(np.diff(rows["token"], prepend=rows["token"][0] - 1))
            length = np.diff(np.append(starts, len(rows["token"])))
            place = np.arange(len(rows["token"])) - np.repeat(starts, length)
            left = np.where(np.repeat(length, length) <= SHORT_LIST, np.repeat(length, length) - place - 1, 0)
            for step in range(1, min(SHORT_LIST, int(length.max()))):
                i = np.flatnonzero(left >= step)
                kept = near_entries(rows, factor, i, i + step)
                yield rows["node"][i[kept]], rows["node"][i[kept] + step]
            for at in np.flatnonzero(length > SHORT_LIST):
                own = {c: v[starts[at] : starts[at] + length[at]] for c, v in rows.items()}
                for i, j in list_pairs(own, factor):
                    yield own["node"][i], own["node"][j]

        def of(rows: dict) -> Iterator[pa.RecordBatch]:
            found = [np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1) for x, y in pairs(rows) if len(x)]
            if found:
                a, b = np.unique(np.concatenate(found), axis=0).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(k).to_numpy() for k, c in enumerate(ENTRY)}
            # the last list may go on in the next batch
            last = int(np.searchsorted(rows["token"], rows["token"][-1]))
            if last or (held and held[-1]["token"][-1] != rows["token"][-1]):
                held.append({c: v[:last] for c, v in rows.items()})
                yield from of({c: np.concatenate([h[c] for h in held]) for c in ENTRY})
                held = []
            held.append({c: v[last:] for c, v in rows.items()})
        if held:
            yield from of({c: np.concatenate([h[c] for h in held]) for c in ENTRY})

    ordered = entries.select(*ENTRY).repartition("token").sortWithinPartitions("token", "n", "pos")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def difference_entries(followers: DataFrame, star: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries of the followers' differences, and (node, leader, keys, need) with all their keys."""
    key = lambda side: lambda x: F.xxhash64("leader", F.lit(side), x)
    keyed = written(followers.select("node", "leader", "n", "n_leader", F.size("lacks").alias("m"), F.size("more").alias("p"), F.explode(F.concat(F.transform("lacks", key(0)), F.transform("more", key(1)))).alias("key")), "keyed")
    counted = keyed.join(written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("df")), "counts"), "key")
    total = 100 + percent
    need = (2 * percent * F.col("n") + 2 * total * F.col("m") - total * F.col("n_leader")).alias("need")
    sets = counted.groupBy("node", "leader", "n", "n_leader", "m", "p").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"), F.expr("bit_xor(shiftleft(1L, int(pmod(key, 64))))").alias("parity"))
    led = star.select(F.col("node").alias("leader"), F.col("linked").alias("led"))
    sets = written(sets.join(star, "node", "left").join(led, "leader", "left").select("node", "leader", F.coalesce("linked", "node").alias("linked"), F.coalesce("linked", "node").eqNullSafe(F.col("led")).alias("with_leader"), (F.col("m") + F.col("p")).cast("long").alias("d"), need.cast("long"), "n_leader", "keys", "parity"), "differences")
    # the least that a partner's differences must share with these
    least = F.greatest(F.lit(1), F.ceil((F.col("need") - (100 - percent) * F.col("n_leader")) / 200))
    prefix = F.slice("keys", 1, F.greatest(F.lit(0), F.col("d") - least + 1).cast("int"))
    entries = sets.select("node", "linked", "with_leader", "need", "parity", F.col("d").alias("n"), F.posexplode(prefix).alias("pos", "k")).where("k.df > 1")
    # a long list is cut: sets that are linked to the leader, and so never paired, go to one part each, others to all parts
    parts = F.ceil(F.col("k.df") / LIST)
    part = F.when(F.col("with_leader"), F.array(F.pmod(F.xxhash64("node"), parts))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
    dealt = entries.withColumn("part", F.explode(part))
    return dealt.select(F.xxhash64("k.key", "part").alias("token"), "n", F.col("pos").cast("long").alias("pos"), "need", "node", F.col("node").alias("group"), "linked", "parity"), sets


def derived_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs of followers of one leader those whose common part, derived from the leader's, is large enough."""
    keys = F.transform("keys", lambda k: k["key"])
    one = sets.select(F.col("node").alias("a"), keys.alias("keys_a"), F.col("need").alias("need_a"))
    two = sets.select(F.col("node").alias("b"), keys.alias("keys_b"), F.col("need").alias("need_b"))
    common = F.size(F.array_intersect("keys_a", "keys_b"))
    return pairs.join(one, "a").join(two, "b").where(2 * (100 + percent) * common >= F.col("need_a") + F.col("need_b")).select("a", "b")


def prefix_entries(docs: DataFrame, nodes: DataFrame, levels: np.ndarray, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """Entries of whole sets' prefixes. nodes: (node, group, linked)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                n, prefixes, parities = [], [], []
                for s in token_sets(piece.column(1), size):
                    first = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    prefixes.append(s[np.argsort(shared.value[counter(s, len(shared.value))], kind="stable")[:first]].view(np.int64))
                    parities.append(np.packbits(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=64).astype(np.uint8) & 1).view(np.int64)[0])
                    n.append(len(s))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes)))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), lists, pa.array(parities, pa.int64())], names=["node", "n", "prefix", "parity"])

    found = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "node long, n long, prefix array<long>, parity long")
    rows = found.dropDuplicates(["node"]).join(nodes, "node")
    entries = rows.select("node", "n", "group", "linked", "parity", F.posexplode("prefix").alias("pos", "token"))
    return entries.withColumns({"pos": F.col("pos").cast("long"), "need": 2 * percent * F.col("n")})


def plausible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose tokens by cell let their sets share enough. sizes: (node, n, cells). A full cell of both sides bounds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, CELLS) for k in (3, 5))
            n, m = (batch.column(k).to_numpy() for k in (2, 4))
            least = np.minimum(one, two)
            most = np.where(least.max(axis=1, initial=0) == 255, np.minimum(n, m), least.sum(axis=1, dtype=np.int64))
            keep = pa.array((100 + percent) * most >= percent * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    one = sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("cells").alias("cells_a"))
    two = sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("cells").alias("cells_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "cells_a", "n_b", "cells_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """Of pairs (a, b) those whose whole token sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, two in zip(held_sets(batch.column(2)), held_sets(batch.column(3))):
                common = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(100 * common >= percent * (len(one) + len(two) - common))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = written(sets_of(docs, ids, size, id_col, text_col), "sets")
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def similar(common: Column, n: Column, other: Column, percent: int) -> Column:
    return 100 * common >= percent * (n + other - common)


def followers_of(docs: DataFrame, nodes: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """All followers (see differences); what finds no leader in one round may find one among what is left."""
    found, left = None, nodes
    for _ in range(ROUNDS):
        edges = written(leaders(left), "edges")
        ids = written(edges.select(F.explode(F.array("node", "leader")).alias("id")).distinct(), "ids")
        new = written(differences(edges, written(sets_of(docs, ids, size, id_col, text_col), "sets")), "followers")
        found = new if found is None else found.unionByName(new)
        # leaders that followers hang on stay leaders: only nodes that are neither take part again, with the leaders
        left = left.join(new, "node", "left_anti")
    # a leader of the first round that follows another in a later one keeps its own followers
    return found


def classes(docs: DataFrame, percent: int = 90, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of docs."""
    sketched = written(sketches(docs, size, id_col, text_col), "sketches")
    filled = sketched.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    folded = written(filled.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("mins").alias("mins"), F.first("cells").alias("cells"), F.max("n_shingles").alias("n")), "folded")
    nodes = folded.select("node", "mins")
    followers = followers_of(docs, nodes, size, id_col, text_col)
    stars = followers.where(similar(F.col("n_leader") - F.size("lacks"), F.col("n"), F.col("n_leader"), percent)).select(F.col("node").alias("a"), F.col("leader").alias("b"))
    first = written(components(stars), "stars")
    star = first.withColumnRenamed("component", "linked")
    entries, sets = difference_entries(followers, star, percent)
    derived = derived_links(written(candidates(entries, 2 * (100 + percent)), "pairs"), sets, percent)
    second = written(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(derived)), "derived")
    groups = labelled(labelled(nodes.select("node"), second).withColumnRenamed("component", "linked"), followers.select("node", F.col("leader").alias("component"))).withColumnRenamed("component", "group")
    found = candidates(prefix_entries(docs, groups, frequencies(sketched), percent, size, id_col, text_col), 2 * (100 + percent))
    likely = written(plausible(found, folded.select("node", "n", "cells"), percent), "candidates")
    links = confirmed(likely, docs, percent, size, id_col, text_col)
    last = written(components(second.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "components")
    member = folded.select("digest", "node").join(last, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    joined = sketched.join(member, "digest", "left")
    known = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", known.alias("component_id"))
