"""Packing by concatenating and cutting.

The documents' ids stand one after the other, in the order in which the scan's partitions hold them, and are cut every
`length` ids. Two passes: the first encodes a partition and notes each document's offset in it; the partitions' totals,
one number a partition, are summed up to global offsets; the second cuts every document at the windows' boundaries.
Only the last sequence is padded.

Null and empty texts give the end id alone; repeated rows and ids are packed once each; a text longer than a sequence
runs through several; a very long text is encoded by itself, and only its ids (4 bytes each) are held at one time; null
ids are kept; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm import tokens
from lakeline.llm.common import binary_array, slices, written

#: Partition totals (16 bytes each) that may be broadcast; beyond, the join is left to Spark.
BROADCAST_TOTALS = 1_000_000


def encoded(docs: DataFrame, vocabulary: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """Per document its ids with the end id (unsigned 16 or 32 bits), its partition and the ids before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype("<u2" if tokens.vocabulary(vocabulary).size <= 1 << 16 else "<u4")
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, 1):
                ids, offsets = tokens.with_end(*tokens.encode(piece.column(1), vocabulary), end)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(offsets) - 1, part), pa.int32()), pa.array(before + offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int64()), binary_array(ids.astype(kind).view(np.uint8), offsets * kind.itemsize)],
                    names=["doc_id", "part", "before", "doc_tokens", "ids"],
                )
                before += int(offsets[-1])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, part int, before long, doc_tokens long, ids binary")


def cut(at_ids: DataFrame, length: int) -> DataFrame:
    """at_ids: doc_id, at (the ids before the document in all), doc_tokens, ids. A row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(i).to_numpy() for i in (1, 2))
            first, last = at // length, (at + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(at)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin, stop = np.maximum(at[row], sequence * length), np.minimum((at + n)[row], (sequence + 1) * length)
            start, size = begin - at[row], stop - begin
            crcs = np.empty(len(row), dtype=np.int64)
            raw, now = np.zeros(0, dtype="<u4"), -1
            for i, (r, s, k) in enumerate(zip(row.tolist(), start.tolist(), size.tolist(), strict=True)):
                if r != now:
                    data, now = batch.column(3)[r].as_buffer(), r
                    raw = np.frombuffer(data, dtype="<u2" if len(data) == 2 * n[r] else "<u4").astype("<u4")
                crcs[i] = zlib.crc32(raw[s : s + k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, size, crcs, n[row], sequence, begin - sequence * length))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return at_ids.select("doc_id", "at", "doc_tokens", "ids").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece of a document in a sequence."""
    ids = written(encoded(docs, vocabulary or tokens.default_vocabulary(), end, id_col, text_col), "ids")
    totals = ids.groupBy("part").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("total"))
    # one row per partition of the scan, so this window over all of them stays small
    bases = written(totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")).alias("base")), "bases")
    small = bases.count() <= BROADCAST_TOTALS
    joined = ids.join(F.broadcast(bases) if small else bases, "part")
    return cut(joined.withColumn("at", F.col("base") + F.col("before")), length)
