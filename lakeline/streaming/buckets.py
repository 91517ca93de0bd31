"""Change batches into a plain Parquet table in folders by key bucket, safe to replay.

A ledger beside the table has the ids of batches that are in it. A batch's new buckets are staged whole, then put in place
by Spark's dynamic partition overwrite, then listed in the ledger. A batch that is in the ledger is passed over; one that was
staged whole is put in place again, with the same rows; one that was not is staged anew. So a batch may run twice, or be cut off anywhere.
One writer at a time; a reader who comes while buckets are put in place may see some of a batch's buckets and not others.

A batch rewrites the buckets that it touches, so their number decides what it costs: as many as make a bucket a few files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lakeline.operators import merge
from lakeline.sources import files
from lakeline.streaming import jobs

BUCKETS = 64


def state_schema(batch: StructType, keys: list[str], values: list[str], seq: str) -> StructType:
    """The stored columns: keys, values, sequence number, operation's order, tombstone, bucket."""
    own = [batch[c] for c in (*keys, *values)]
    return StructType([*own, *StructType.fromDDL(f"_seq {batch[seq].dataType.simpleString()}, _op int, _deleted boolean, _bucket int").fields])


def ledger_entry(path: str, stream: str, number: int) -> str:
    return f"{path}/ledger/stream={stream}/batch={number}"


def is_applied(spark: SparkSession, path: str, stream: str, number: int) -> bool:
    return files.exists(spark, f"{ledger_entry(path, stream, number)}/_SUCCESS")


def stage(batch: DataFrame, path: str, target: str, keys: list[str], values: list[str], seq: str, buckets: int) -> None:
    """Writes the touched buckets as they will be: of each key the row of the largest sequence number, at a tie of the later operation."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    new = batch.select(*keys, *values, F.col(seq).alias("_seq"), merge.op_order(F.col("op")).alias("_op"), (F.col("op") == "d").alias("_deleted"), bucket)
    order = [F.col("_seq"), F.col("_op")]
    newest = merge.latest(new, [*keys, "_bucket"], order)
    if files.exists(spark, f"{path}/rows"):
        # no more numbers than there are buckets
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]
        stored = read_state(spark, path, state_schema(batch.schema, keys, values, seq)).where(F.col("_bucket").isin(touched))
        newest = merge.latest(stored.unionByName(newest), [*keys, "_bucket"], order)
    newest.hint("rebalance", F.col("_bucket")).write.mode("overwrite").option("compression", "zstd").partitionBy("_bucket").parquet(target)


def apply_batch(batch: DataFrame, number: int, path: str, keys: list[str], values: list[str], seq: str = "seq", stream: str = "changes", buckets: int = BUCKETS) -> bool:
    """Puts a batch of changes (keys, values, op, seq) into the table below path; False if it was there."""
    spark = batch.sparkSession
    if is_applied(spark, path, stream, number):
        return False
    staged = f"{path}/staged/stream={stream}/batch={number}"
    if not files.exists(spark, f"{staged}/_SUCCESS"):
        stage(batch, path, staged, keys, values, seq, buckets)
    put_in_place(spark, staged, path, state_schema(batch.schema, keys, values, seq))
    enter(spark, path, stream, number)
    files.remove(spark, staged)
    return True


def put_in_place(spark: SparkSession, staged: str, path: str, schema: StructType) -> None:
    rows = spark.read.schema(schema).parquet(staged)
    rows.hint("rebalance", F.col("_bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("_bucket").parquet(f"{path}/rows")


def enter(spark: SparkSession, path: str, stream: str, number: int) -> None:
    spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(ledger_entry(path, stream, number))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows (stream, batch, at) of all batches in the table."""
    return spark.read.schema("at timestamp, stream string, batch long").parquet(f"{path}/ledger")


def read_state(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/rows")


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table without deleted keys; schema as state_schema gives it."""
    rows = read_state(spark, path, schema) if files.exists(spark, f"{path}/rows") else spark.createDataFrame([], schema)
    return rows.where(~F.col("_deleted")).drop("_seq", "_op", "_deleted", "_bucket")


def apply_changes(stream: DataFrame, path: str, keys: list[str], values: list[str], checkpoint: str, seq: str = "seq", start: DataFrame | None = None, name: str = "changes", buckets: int = BUCKETS, seconds: int | None = jobs.COMMIT_SECONDS) -> StreamingQuery:
    """Keeps the table below path from a change stream. start: (table_name, start_scn); changes before it are left out. name
    tells streams of different checkpoints apart in the ledger."""
    handle: Callable = lambda batch, number: apply_batch(batch, number, path, keys, values, seq, name, buckets)
    return jobs.each_batch(stream if start is None else jobs.from_start(stream, start, seq), handle, checkpoint, seconds)
