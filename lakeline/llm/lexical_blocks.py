"""Exact ranked lexical search over posting lists cut into geometric blocks.

A document's score for an item is the sum, over the item's terms with their repeats, of w * u: the term's weight in the corpus
and its impact in the document, both whole numbers. Documents are worked on in shards that fit in memory. In a shard every term of
the items has a list of the documents that hold it, and each list is clustered by the documents' similarity (the projections of
their impact vectors) into blocks of about `BLOCK` documents. A block's summary is the coordinatewise maximum of its documents'
impacts, over the terms of all items that use the list. An item goes through its terms' lists, the most promising one first:
the product with a summary bounds the scores in the block from above, and a block is skipped only if that bound is below the
score of the 20th document so far (which is carried from shard to shard of a task). A list, and all after it, is left out when the largest impacts of the
terms not yet gone through can't reach that score. What is not skipped is scored in whole vectors, so the results are exact.

The products run in doubles, which hold these whole numbers exactly (below 2^53: weights up to 10^5, impacts below 10^6, some
10^4 terms in an item). Items are taken `ITEMS_AT_ONCE` at a time, each such set against all documents; a set's terms are
held by every task.

Defined cases: null and empty texts and texts without a term score nothing and count in no figure; documents without an id
count in the corpus's figures and are never returned; documents that share an id are ranked each for itself; of items that share an id (or have none) the
least text counts, an item without a term has no rows; equal scores go by the smaller doc_id; very long texts count whole; empty
tables give no rows; other columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm.common import slices, strings, words, written

#: Results of an item, documents in a block, dimensions of the projections that blocks are clustered by.
TOP, BLOCK, DIMENSIONS = 20, 32, 16
#: Items of one pass over the documents, and impacts (4 bytes each) of a shard.
ITEMS_AT_ONCE, SHARD_CELLS = 1000, 12_000_000
#: Documents of a task that searches.
TASK_DOCS = 8192
#: Groups that an item's results from all tasks are ranked in before they are ranked altogether.
MERGES = 64


def between_terms(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to no term: all of ASCII but letters and digits."""
    letter = ((data | np.uint8(0x20)) - np.uint8(97) < 26) & (data < 128)
    return ~(letter | (data - np.uint8(48) < 10) | (data >= 128))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As common.words, for terms."""
    return words(texts, lower_ascii=True, outside=between_terms)


def postings(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n, terms, tfs) of documents with a term: how many, and which of the vocabulary how often."""
    place = {term: i for i, term in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                distinct, codes, offsets = terms_of(piece.column(1))
                ids = np.fromiter((place.get(w, -1) for w in strings(distinct.cast(pa.binary()))), dtype=np.int64, count=len(distinct))[codes]
                n = np.diff(offsets)
                row = np.repeat(np.arange(len(n)), n)
                pairs, tfs = np.unique((row * len(place) + ids)[ids >= 0], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(len(n) + 1) * len(place))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (pairs % max(1, len(place)), tfs)]
                found = pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield found.filter(pa.array(n > 0))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def columns_of(items: list[dict], n: int) -> list[np.ndarray]:
    """For each term the terms of all items that hold it: what its list's summaries are about."""
    users: list[list[np.ndarray]] = [[] for _ in range(n)]
    for item in items:
        for term in item["terms"].tolist():
            users[term].append(item["terms"])
    return [np.unique(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.int64) for lists in users]


class Shard:
    """The documents of a shard, and for every term its clustered list with summaries."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray, columns: list[np.ndarray], weights: np.ndarray):
        self.ids, self.impacts, self.columns = ids, impacts, columns
        rng = np.random.default_rng(12)
        points = (impacts * weights.astype(np.float32)) @ rng.standard_normal((impacts.shape[1], DIMENSIONS), dtype=np.float32)
        self.points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, tuple] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that hold a term in order of blocks, offsets of the blocks, and their summaries."""
        if term not in self.lists:
            docs = np.flatnonzero(self.impacts[:, term])
            n = -(-len(docs) // BLOCK)
            if n > 1:
                centers = docs[np.arange(n) * len(docs) // n]
                nearest = (self.points[docs] @ self.points[centers].T).argmax(axis=1)
                order = np.argsort(nearest, kind="stable")
                docs, nearest = docs[order], nearest[order]
                starts = np.flatnonzero(np.diff(nearest, prepend=-1))
            else:
                starts = np.zeros(min(1, len(docs)), dtype=np.int64)
            columns = self.columns[term]
            held = self.impacts[np.ix_(docs, columns)]
            summaries = np.maximum.reduceat(held, starts, axis=0) if len(docs) else np.zeros((0, len(columns)), dtype=np.int32)
            self.lists[term] = docs, np.append(starts, len(docs)), summaries.astype(np.float64)
        return self.lists[term]

    def search(self, item: dict, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """An item's best (scores, ids), given those before this shard."""
        scores, ids = best
        terms, weights = item["terms"], item["weights"]
        most = weights * self.impacts[:, terms].max(axis=0, initial=0)
        order = np.argsort(-most, kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)
        seen = np.zeros(len(self.ids), dtype=bool)
        for k, at in enumerate(order):
            # from here on documents hold none of the terms before
            least = max(1, scores[TOP - 1]) if len(scores) == TOP else 1
            if rest[k] < least:
                break
            docs, starts, summaries = self.list_of(terms[at])
            bounds = summaries[:, np.searchsorted(self.columns[terms[at]], terms)] @ weights
            open_blocks = np.repeat(bounds >= least, np.diff(starts))
            new = docs[open_blocks & ~seen[docs]]
            if len(new):
                seen[new] = True
                own = self.impacts[np.ix_(new, terms)].astype(np.float64) @ weights
                scores, ids = np.append(scores, own[own > 0].astype(np.int64)), np.append(ids, self.ids[new[own > 0]])
                first = np.lexsort((ids, -scores))[:TOP]
                scores, ids = scores[first], ids[first]
        return scores, ids


def best_of(found: DataFrame, items: list[dict], weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Rows (item, doc_id, score): each task's best documents of each item."""
    shard_docs = max(64, SHARD_CELLS // max(1, len(weights)))

    def shards(batches: Iterator[pa.RecordBatch], columns: list[np.ndarray]) -> Iterator[Shard]:
        held: list[tuple] = []

        def made() -> Shard:
            ids, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            counts, terms, tfs = (np.concatenate([h[k] for h in held]).astype(np.int64) for k in (2, 3, 4))
            row = np.repeat(np.arange(len(ids)), counts)
            length = 100 - 25 + (25 * n * n_docs) // n_terms
            impacts = np.zeros((len(ids), len(weights)), dtype=np.int32)
            impacts[row, terms] = (1_000_000_000 * tfs) // (1000 * tfs + 12 * length[row])
            held.clear()
            return Shard(ids, impacts, columns, weights)

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, shard_docs):
                part = batch.slice(at, shard_docs)
                if size + part.num_rows > shard_docs:
                    yield made()
                    size = 0
                terms, tfs = part.column(2), part.column(3)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
                size += part.num_rows
        if size:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(items)
        for shard in shards(batches, columns_of(items, len(weights))):
            best = [shard.search(item, before) for item, before in zip(items, best)]
        place = np.repeat(np.arange(len(items)), [len(s) for s, _ in best])
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *[pa.array(np.concatenate([b[k] for b in best]), pa.int64()) for k in (1, 0)]], names=["item", "doc_id", "score"])

    return found.where("doc_id is not null").mapInArrow(run, "item int, doc_id long, score long")


def ranked(df: DataFrame, keys: list) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def search_set(docs: DataFrame, texts: list[str], id_col: str, text_col: str) -> DataFrame:
    """Rows (item, rank, doc_id, score) for a set of items, which are named by their place in it."""
    distinct, codes, offsets = terms_of(pa.array(texts, pa.string()))
    vocabulary = strings(distinct.cast(pa.binary()))
    found = written(postings(docs, vocabulary, id_col, text_col), "postings")
    n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # no more rows than the set has terms
    df = dict(found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect())
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], dtype=np.int64)
    items = []
    for a, b in zip(offsets, offsets[1:]):
        counts = Counter(codes[a:b].tolist())
        terms = np.array(sorted(counts), dtype=np.int64)
        items.append({"terms": terms, "weights": (weights[terms] * np.array([counts[t] for t in terms.tolist()], dtype=np.int64)).astype(np.float64)})
    # postings are small beside what is done with them: tasks are cut by documents, not by bytes
    dealt = found.repartition(max(1, -(-n_docs // TASK_DOCS)))
    rows = best_of(dealt, items, weights, n_docs, n_terms)
    merged = ranked(rows, ["item", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))]).drop("rank")
    return ranked(merged, ["item"])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): every item's best documents."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    named = items.groupBy(F.col(item_col).alias("item_id")).agg(F.min(item_text).alias("text"))
    results = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").withColumn("item_id", F.lit(None).cast(kind))
    block: list[tuple] = []

    def of(rows: list[tuple]) -> DataFrame:
        ids = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {kind.simpleString()}")
        return search_set(docs, [r[1] or "" for r in rows], id_col, text_col).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")

    for row in named.orderBy("item_id").toLocalIterator():
        block.append(tuple(row))
        if len(block) == ITEMS_AT_ONCE:
            results, block = results.unionByName(of(block)), []
    return results.unionByName(of(block)) if block else results


#: The same rows in SQL.
ORACLE = r"""
with terms as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t, row_number() over () as d from documents where text is not null),
docs as (select d, doc_id, len(t)::bigint as n, t from terms where len(t) > 0),
whole as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from docs),
tf as (select d, term, count(*)::bigint as tf from (select d, unnest(t) as term from docs) group by all),
df as (select term, count(*) as df from tf group by term),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from df, whole),
named as (select item_id, min(text) as text from benchmark group by item_id),
items as (select item_id, term, count(*)::bigint as q from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from named where text is not null) group by all),
scored as (select item_id, d, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::bigint as score
  from items join w using (term) join tf using (term) join docs using (d), whole where doc_id is not null group by all)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scored where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
"""
