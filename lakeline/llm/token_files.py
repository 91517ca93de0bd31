"""Token files: ids in ascending document order, Simple-8b words with per-block offsets.

A file (little-endian): the magic `LKS8B1\\0\\0`, five longs (documents, blocks, words, block size, 0), then the documents'
ids (long), whether an id is null (byte, padded to 8), their numbers of ids (long), the blocks' first words (long, one
more than blocks) and the words. A document's blocks follow each other; it has ceil(ids / block size) of them, so any
document or block is found without decoding what is before it.

Documents are encoded where they are read, only their words are shuffled, by ranges of the id, and every range becomes
files of bounded size. Rows without an id, and rows of an id that takes more than a range, are dealt to several ranges by
their tokens' checksum. A file has its final name only when it is complete, and equal content each time a task runs.

Null and empty texts give the end id alone; null ids come first; rows with equal ids are ordered by their tokens' checksum
and number; very long texts are blocks like others, and their document is in one file; an empty table gives no file and no
rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeline.llm import simple8b, tokens
from lakeline.llm.common import binary_array, shared_dir, slices, store

MAGIC = b"LKS8B1\0\0"
#: Bytes of words after which a file ends.
FILE_BYTES = 8 << 20
#: Bytes of text for one range of ids, as long as there are no more than so many ranges; beyond, ranges grow and their sorts spill.
RANGE_BYTES, MOST_SPANS = 24 << 20, 10_000
#: Files whose offsets may be broadcast; beyond, the join is left to Spark.
BROADCAST_FILES = 1_000_000


def span_count(text_bytes: int, rows: int) -> int:
    return max(1, min(MOST_SPANS, -(-(text_bytes + rows) // RANGE_BYTES)))


def spans_of(ids: pa.Array, crcs: np.ndarray, cuts: np.ndarray, null_spans: int) -> np.ndarray:
    """The range of each row: those of null ids first. An id that is a cut several times has as many ranges of its own."""
    known, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    lower, upper = np.searchsorted(cuts, value, side="left"), np.searchsorted(cuts, value, side="right")
    share = lambda parts: (crcs * parts) >> 32
    return np.where(known, null_spans + np.where(lower < upper, lower + 1 + share(upper - lower), upper), share(null_spans))


def packed(docs: DataFrame, bounds: list[int], null_spans: int, vocabulary: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: the range of its id, number and checksum of its ids, its blocks' numbers of words and the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(bounds, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, 1):
                ids, offsets = tokens.with_end(*tokens.encode(piece.column(1), vocabulary), end)
                sizes = np.diff(offsets)
                per_doc = -(-sizes // simple8b.BLOCK)
                first = np.concatenate([[0], np.cumsum(per_doc)])
                inner = np.arange(first[-1]) - np.repeat(first[:-1], per_doc)
                blocks = np.append(np.repeat(offsets[:-1], per_doc) + inner * simple8b.BLOCK, offsets[-1])
                words, ends = simple8b.encode(ids, blocks)
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                doc_ids = piece.column(0)
                found = spans_of(doc_ids, np.array(crcs, dtype=np.int64), cuts, null_spans)
                counts = np.diff(ends).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(found, pa.int32()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), binary_array(counts.view(np.uint8), first * 2), binary_array(words.astype("<u8").view(np.uint8), ends[first] * 8)],
                    names=["doc_id", "span", "n", "crc", "counts", "words"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, span int, n long, crc long, counts binary, words binary")


def file_bytes(rows: list[tuple]) -> bytes:
    """rows: (doc_id or None, n, counts, words)."""
    counts = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u2").astype(np.int64)
    payload = b"".join(r[3] for r in rows)
    null = np.array([r[0] is None for r in rows], dtype=np.uint8)
    head = np.array([len(rows), len(counts), len(payload) // 8, simple8b.BLOCK, 0], dtype="<i8")
    parts = [MAGIC, head, np.array([r[0] or 0 for r in rows], dtype="<i8"), np.pad(null, (0, -len(null) % 8)), np.array([r[1] for r in rows], dtype="<i8"), np.concatenate([[0], np.cumsum(counts)]).astype("<i8"), payload]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


def read_file(content) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A file's document ids, which are null, their numbers of ids, and all ids."""
    if bytes(content[:8]) != MAGIC:
        raise ValueError("this is no token file")
    n, blocks, n_words, _, _ = np.frombuffer(content, dtype="<i8", count=5, offset=8).tolist()
    at = 48
    doc_ids = np.frombuffer(content, dtype="<i8", count=n, offset=at)
    null = np.frombuffer(content, dtype=np.uint8, count=n, offset=at + 8 * n).astype(bool)
    at += 8 * n + n + -n % 8
    sizes = np.frombuffer(content, dtype="<i8", count=n, offset=at)
    words = np.frombuffer(content, dtype="<u8", count=n_words, offset=at + 8 * n + 8 * (blocks + 1))
    return doc_ids, null, sizes, simple8b.decode(words.astype(np.uint64))


def publish(files, temporary: str, name: str) -> None:
    """Gives a complete file its final name; one that another run of the task has named already has the same content and stays."""
    from pyarrow import fs

    try:
        files.move(temporary, name)
    except OSError:
        if files.get_file_info(name).type != fs.FileType.File:
            raise
        files.delete_file(temporary)


def write(docs: DataFrame, target: str, vocabulary: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as token files below target and returns their list: (span, seq, docs, tokens, bytes, name), itself written to target/manifest."""
    spark = docs.sparkSession
    ids = F.col(id_col).cast("long")
    size, n, no_id = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(ids.isNull(), F.coalesce(F.octet_length(text_col), F.lit(0)) + 1)), F.lit(0))).first()
    spans, null_spans = span_count(size, n), span_count(no_id, 0) if no_id else 0
    # a cut per range, with repeats: an id that is several cuts is spread over as many ranges
    bounds = [int(b) for b in docs.select(ids.alias("doc_id")).approxQuantile("doc_id", [i / spans for i in range(1, spans)], 0.1 / spans)] if spans > 1 else []
    rows = packed(docs, sorted(bounds), null_spans, vocabulary or tokens.default_vocabulary(), end, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(f"{target}/files")
        held: list[tuple] = []
        now, seq, weight = -1, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, weight, seq
            content, name = file_bytes(held), f"{now:08d}-{seq:06d}.s8b"
            temporary = f"{folder}/{name}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(temporary) as out:
                out.write(content)
            publish(files, temporary, f"{folder}/{name}")
            result = pa.RecordBatch.from_pydict({"span": pa.array([now], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": pa.array([len(held)], pa.int64()), "tokens": pa.array([sum(r[1] for r in held)], pa.int64()), "bytes": pa.array([len(content)], pa.int64()), "name": pa.array([name])})
            held, weight, seq = [], 0, seq + 1
            return result

        for batch in batches:
            for span, doc_id, n, counts, words in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (span != now or weight >= FILE_BYTES):
                    yield flush()
                if span != now:
                    now, seq = span, 0
                held.append((doc_id, n, counts, words))
                weight += len(words)
        if held:
            yield flush()

    files, folder = store(f"{target}/files")
    files.create_dir(folder, recursive=True)
    sorted_rows = rows.repartitionById(null_spans + len(bounds) + 1, F.col("span")).sortWithinPartitions("span", F.asc_nulls_first("doc_id"), "crc", "n")
    listed = sorted_rows.select("span", "doc_id", "n", "counts", "words").mapInArrow(run, "span int, seq int, docs long, tokens long, bytes long, name string")
    listed.write.parquet(f"{target}/manifest")
    return spark.read.schema(listed.schema).parquet(f"{target}/manifest")


def read(spark: SparkSession, target: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) from the token files below target; start counts the ids of all documents before."""
    listed = spark.read.parquet(f"{target}/manifest")
    # one row per file, so this window over all of them stays small
    bases = listed.select("name", (F.sum("tokens").over(Window.orderBy("span", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, null, sizes, ids = read_file(content.as_buffer().to_pybytes())
                wide, ends = ids.astype("<u4"), np.cumsum(sizes)
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                name = unquote(path.rsplit("/", 1)[-1])
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=null), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array([name] * len(sizes), pa.string())], names=["doc_id", "before", "n_tokens", "ids_crc32", "name"])

    docs = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(f"{target}/files").select("path", "content").mapInArrow(run, "doc_id long, before long, n_tokens long, ids_crc32 long, name string")
    small = listed.count() <= BROADCAST_FILES
    return docs.join(F.broadcast(bases) if small else bases, "name").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes docs to token files in the shared folder and reads them back."""
    target = f"{shared_dir(docs.sparkSession)}/tokens"
    write(docs, target, **options)
    return read(docs.sparkSession, target)
