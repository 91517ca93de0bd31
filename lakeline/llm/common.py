"""What the operators share: the shared folder, tables cut from their lineage, and word splitting on Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeline.session import scratch, stored

#: Text bytes that a task holds decoded at one time; longer batches are cut, a longer text stands alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    return scratch(spark, "").rstrip("/")


def store(target: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(target)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: the lineage ends there, and lost executors cost no recomputation."""
    return stored(df, name)


def remainder(n: int, column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(F.col(column).cast("string")) % n


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until df has no such column (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def append_columns(df: DataFrame, text: str, fields: dict[str, str], start: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """df with more columns, computed from its text column batch by batch; start() runs once a task and gives the function of a batch.

    Columns of df that have a new column's name (case is ignored) are replaced; the text column itself can't be.
    """
    taken = {name.lower() for name in fields}
    if text.lower() in taken:
        raise ValueError(f"the text column {text} can't be replaced")
    df = df.drop(*[c for c in df.columns if c.lower() in taken])
    schema = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in fields.items())).fields])
    out_names = [*df.columns, *fields]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for batch in batches:
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, *of(part.column(at))], names=out_names)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about limit bytes of text."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        base = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and len + 1 offsets into them; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes separate words: space and \\t \\n \\v \\f \\r."""
    return (data == 0x20) | (data - np.uint8(0x09) < 5)


def strings(array: pa.Array) -> list:
    """The array's values as Python objects."""
    return array.to_numpy(zero_copy_only=False).tolist()


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow binary (or string) array over data, cut at offsets."""
    return pa.Array.from_buffers(kind or pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def words(texts: pa.Array, lower_ascii: bool = False, outside: Callable[[np.ndarray], np.ndarray] = is_space) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of texts: the distinct ones (strings), each occurrence's index among them,
    and len + 1 offsets of the texts' occurrences. outside: which bytes are in no word, if not these."""
    data, offsets = text_bytes(texts)
    if lower_ascii and len(data):
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~outside(data)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    kept = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
    ends = np.append(kept[starts[1:]], kept[-1]) if len(starts) else np.zeros(0, dtype=np.int64)
    coded = binary_array(data[inside], np.concatenate([[0], ends]), pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary, codes, np.searchsorted(starts, offsets)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between each two offsets (zero where they are equal)."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=kind), np.cumsum(values, axis=0, dtype=kind)])
    return total[offsets[1:]] - total[offsets[:-1]]


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each occurrence, the row that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def bounded_sample(df: DataFrame, rows: int, column: str = "doc_id") -> DataFrame:
    """At most so many rows, always the same ones: those whose id's hash is smallest."""
    return df.orderBy(F.xxhash64(column), column).limit(rows)
