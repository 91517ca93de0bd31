"""BPE encoding by an index of pair occurrences.

The distinct pieces of a batch of texts stand in one chain of byte symbols. An index maps each mergeable pair to all its
positions in the chain; ranks are applied in ascending order, each to all its positions at once, and the pairs that a
merge makes are added to the lists of their ranks. A pair made by a merge has a later rank than that merge, so every
rank is taken up once. Decoding looks up the ids' bytes and replaces what is no UTF-8.

Null and empty texts have no ids; special tokens' strings become their ids, as the tokenizers library has it; a very
long text forms a batch of its own; repeated rows get equal ids each; where two pairs could be merged, the lower rank goes
first and, of one rank, the place further left; an empty table gives no rows; with_ids replaces a column that has the
result's name, digests ignores columns other than id and text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm import tokens
from lakeline.llm.common import append_columns, binary_array

NONE = np.iinfo(np.int32).max


class PairTable:
    """Rank and result of each mergeable pair."""

    def __init__(self, path: str):
        v = tokens.vocabulary(path)
        keys = v.merges[:, 0] << 32 | v.merges[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = v.merges[:, 2].astype(np.int32)
        self.twin = v.merges[:, 0] == v.merges[:, 1]
        self.of_byte = np.array([v.ids[bytes([b])] for b in range(256)], dtype=np.int32)
        # pairs of single bytes, nearly all lookups at the start, have a table of their own
        single = np.full(v.size, -1, dtype=np.int64)
        single[self.of_byte] = np.arange(256)
        self.single = single
        self.direct = np.full(65536, NONE, dtype=np.int32)
        a, b = single[v.merges[:, 0]], single[v.merges[:, 1]]
        both = (a >= 0) & (b >= 0)
        self.direct[(a[both] << 8) + b[both]] = np.flatnonzero(both)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


@functools.lru_cache(maxsize=2)
def pair_table(path: str) -> PairTable:
    return PairTable(path)


def grouped(ranks: np.ndarray, positions: np.ndarray):
    """(rank, positions) for each distinct rank."""
    order = np.argsort(ranks, kind="stable")
    ranks, positions = ranks[order], positions[order]
    cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
    return [(int(ranks[a]), positions[a:b]) for a, b in zip(cuts, cuts[1:])]


def merge_all(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces (their bytes, len + 1 offsets): number of ids of each piece, and all ids."""
    table, n = pair_table(path), len(data)
    symbol = table.of_byte[data]
    after = np.arange(1, n + 2, dtype=np.int32)  # the next symbol's place in the same piece, n if there is none
    ends = offsets[1:][np.diff(offsets) > 0]
    after[ends - 1] = n
    before = np.arange(-1, n, dtype=np.int32)
    before[offsets[:-1][np.diff(offsets) > 0]] = -1
    current = np.full(n + 1, NONE, dtype=np.int32)  # rank of the pair that begins here
    paired = np.flatnonzero(after[:n] < n)
    current[paired] = table.direct[(data[paired].astype(np.int64) << 8) + data[paired + 1]]
    paired = paired[current[paired] != NONE]
    index: dict[int, list[np.ndarray]] = {rank: [at] for rank, at in grouped(current[paired], paired)} if len(paired) else {}
    active = list(index)
    heapq.heapify(active)
    alive = np.ones(n, dtype=bool)
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[current[at] == rank]
        if not len(at):
            continue
        if table.twin[rank] and len(at) > 1:
            # in a run of overlapping pairs, every other one from its left end is merged
            head = np.ones(len(at), dtype=bool)
            head[1:] = after[at[:-1]] != at[1:]
            begin = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
        gone = after[at]
        symbol[at] = table.made[rank]
        alive[gone] = False
        current[gone] = NONE
        beyond = after[gone]
        after[at] = beyond
        inner = beyond < n
        before[beyond[inner]] = at[inner]
        ahead = before[at]
        changed = np.concatenate([at, ahead[ahead >= 0]])
        if len(lists) > 1 or len(at) > 1:
            changed = np.unique(changed)
        follow = after[changed]
        has = follow < n
        current[changed[~has]] = NONE
        changed, follow = changed[has], follow[has]
        if not len(changed):
            continue
        now = table.rank(symbol[changed], symbol[follow])
        current[changed] = now
        live = now != NONE
        if live.any():
            for r, places in grouped(now[live], changed[live]):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(active, r)
    kept = np.concatenate([[0], np.cumsum(alive, dtype=np.int64)])
    return np.diff(kept[offsets]), symbol[alive]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other (null: none), and len + 1 offsets into them."""
    v = tokens.vocabulary(path)
    units, codes, offsets = v.units(texts)
    cut = [[u] if u in v.special else v.pattern.findall(u) for u in units]
    coded = pa.array([p for pieces in cut for p in pieces], pa.string()).dictionary_encode()
    pieces = coded.dictionary
    data = np.frombuffer(pieces.buffers()[2], dtype=np.uint8) if len(pieces) and pieces.buffers()[2] else np.zeros(0, dtype=np.uint8)
    ends = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[: len(pieces) + 1].astype(np.int64) if len(pieces) else np.zeros(1, dtype=np.int64)
    lengths, flat = merge_all(data[: ends[-1]], ends, path)
    if v.special and len(pieces):
        flat, lengths = with_special(pieces, lengths, flat, v.special)
    # ids of the distinct pieces to the distinct units, then to the texts
    unit_offsets = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
    unit_ids, unit_ends = tokens.spread(lengths, flat, coded.indices.to_numpy(zero_copy_only=False), unit_offsets)
    return tokens.spread(np.diff(unit_ends), unit_ids, codes, offsets)


def with_special(pieces: pa.Array, lengths: np.ndarray, flat: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Puts the one id of a special token in place of its string's ids."""
    found = [(i, special[p]) for i, p in zip(np.flatnonzero(pc.is_in(pieces, pa.array(list(special))).to_numpy(zero_copy_only=False)).tolist(), pieces.filter(pc.is_in(pieces, pa.array(list(special)))).to_pylist())]
    if not found:
        return flat, lengths
    parts = np.split(flat, np.cumsum(lengths)[:-1])
    for i, code in found:
        parts[i] = np.array([code], dtype=flat.dtype)
    return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


def joined(values: pa.Array, ids: np.ndarray, offsets: np.ndarray, between: str | bytes) -> pa.Array:
    """For each text, the values of its ids joined."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(ids)))
    return pc.binary_join(lists, between)


@functools.lru_cache(maxsize=2)
def tables(path: str) -> tuple[pa.Array, pa.Array]:
    pieces = tokens.vocabulary(path).pieces
    return pa.array([str(i).encode() for i in range(len(pieces))], pa.binary()), pa.array(pieces, pa.binary())


def decode(ids: np.ndarray, offsets: np.ndarray, path: str) -> list[str]:
    """The texts of ids."""
    return [t.decode("utf-8", errors="replace") for t in joined(tables(path)[1], ids, offsets, b"").to_pylist()]


def with_ids(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with their ids (array of int)."""
    path = vocabulary or tokens.default_vocabulary()

    def start():
        def of(texts: pa.Array) -> list[pa.Array]:
            ids, offsets = encode(texts, path)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

        return of

    return append_columns(docs, text_col, {out: "array<int>"}, start)


def digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded again."""
    path = vocabulary or tokens.default_vocabulary()

    def start():
        def of(texts: pa.Array) -> list[pa.Array]:
            ids, offsets = encode(texts, path)
            digits = joined(tables(path)[0], ids, offsets, b",")
            raw = joined(tables(path)[1], ids, offsets, b"")
            return [
                pa.array(np.diff(offsets), pa.int64()),
                pa.array([hashlib.sha256(d.as_buffer()).hexdigest() for d in digits], pa.string()),
                pa.array([hashlib.sha256(d.as_py().decode("utf-8", errors="replace").encode()).hexdigest() for d in raw], pa.string()),
            ]

        return of

    rows = append_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, start)
    return rows.drop("text")
