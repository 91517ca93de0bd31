"""Structured Streaming jobs: change streams into tables, JSON loads, rollups, de-duplication, lag."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeline.operators.filters import route
from lakeline.session import small, stored
from lakeline.sources import files

#: Load limits of a micro-batch stream.
LOAD_SECONDS, LOAD_ROWS, LOAD_BYTES = 10, 300_000, 200 << 20
#: Commit interval of a change stream.
COMMIT_SECONDS = 30
#: Records that a record-limited trigger admits at most.
TRIGGER_RECORDS = 100


def trigger(seconds: int | None) -> dict:
    """The trigger's options: a processing time, or everything that is there and then an end."""
    return {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}


def json_source(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None, line_bytes: int | None = None) -> DataFrame:
    """JSON lines as a stream: the lines' text, parsed with the schema; lines that don't parse are dropped.

    A micro-batch takes so many files, or else LOAD_BYTES; where a line's usual size is known, not more than LOAD_ROWS lines.
    """
    reader = spark.readStream.schema("value string").format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", min(LOAD_BYTES, LOAD_ROWS * line_bytes) if line_bytes else LOAD_BYTES)
    parsed = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return reader.load(path).select(parsed.alias("r")).where("r is not null and r._broken is null").select("r.*").drop("_broken")


def table_source(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def load(stream: DataFrame, path: str, checkpoint: str, seconds: int | None = LOAD_SECONDS) -> StreamingQuery:
    """Appends a stream to a Parquet table; with seconds None it ends when all that is there is loaded."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger(seconds)).start()
    if seconds is None:
        query.awaitTermination()
    return query


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = COMMIT_SECONDS) -> StreamingQuery:
    """Hands each micro-batch and its number to a function; the query that is returned can be awaited and stopped."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger(seconds)).start()
    if seconds is None:
        query.awaitTermination()
    return query


def from_start(changes: DataFrame, start: DataFrame, seq: str = "seq") -> DataFrame:
    """Changes (a stream or not) of the tables that have a sync point, from that on. start: (table_name, start_scn)."""
    return changes.join(small(start.select("table_name", "start_scn")), "table_name").where(F.col(seq) >= F.col("start_scn")).drop("start_scn")


def schema_changes(stream: DataFrame) -> DataFrame:
    """A stream of schemas (subject, seq, columns: a list of name and type) as a stream of their changes: rows (subject, seq, name, change,
    old_type, new_type) where a version differs from the last one of its subject.

    The last version of each subject is the stream's keyed state. A subject's first version is only remembered; a version that
    is not above the last one (it comes late, or again) gives nothing; a column of a null type counts as absent.
    """
    def follow(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        seq, held = (state.get[0], dict(zip(state.get[1], state.get[2]))) if state.exists else (None, None)
        versions = {int(s): c for frame in frames for s, c in zip(frame["seq"], frame["columns"])}
        rows = []
        for number, columns in sorted(versions.items()):
            if seq is not None and number <= seq:
                continue
            new = {c["name"]: c["type"] for c in columns if c["type"] is not None}
            for name in sorted({*new, *held} if held is not None else ()):
                old_type, new_type = held.get(name), new.get(name)
                if old_type != new_type:
                    rows.append((key[0], number, name, "add" if old_type is None else "remove" if new_type is None else "modify", old_type, new_type))
            seq, held = number, new
        if seq is not None:
            state.update((seq, list(held), list(held.values())))
        yield pd.DataFrame(rows, columns=["subject", "seq", "name", "change", "old_type", "new_type"])

    known = stream.where("seq is not null and columns is not null").select("subject", F.col("seq").cast("long").alias("seq"), "columns")
    out = "subject string, seq long, name string, change string, old_type string, new_type string"
    return known.groupBy("subject").applyInPandasWithState(follow, out, "seq long, names array<string>, types array<string>", "append", "NoTimeout")


def record_limited(stream: DataFrame, spool: str, checkpoint: str, records: int = TRIGGER_RECORDS) -> DataFrame:
    """What a stream has so far, as a stream whose micro-batches hold at most so many records.

    The records go to a spool in files of at most so many, each once; a micro-batch takes one file. Both sides go on from their
    checkpoints, so a restart neither loses nor repeats records; call it again for what has come since.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").option("path", spool).option("maxRecordsPerFile", records).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return table_source(spark, spool, stream.schema, files_per_batch=1)


def in_records(batch: DataFrame, records: int = TRIGGER_RECORDS) -> DataFrame:
    """A micro-batch with `trigger`, the number of a group of at most so many records: what a record-limited trigger is fired with.

    Each task counts its own records, so nothing is shuffled and all groups of a micro-batch are worked on at once, however many
    they are. record_limited gives groups one after the other, a micro-batch each, for what can't take more than one at a time.
    """
    # the number of a task, and of a record inside it
    task, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = batch.withColumn("_id", F.monotonically_increasing_id())
    return numbered.withColumn("trigger", F.shiftleft(task, 33) + F.floor(at / records)).drop("_id")


def dual_write(batch: DataFrame, number: int, ledger: str, sinks: dict[str, Callable[[DataFrame, int], None]]) -> list[str]:
    """Hands a batch, evaluated once, to every sink that doesn't have it yet, and enters it in the ledger of each; returns those names.

    Where a sink fails, those before it have the batch and are passed over when it runs again. A sink that is cut off between
    its write and the entry gets the batch once more, under the same number: it must replace what it has of it (see batch_folder).
    """
    spark, written = batch.sparkSession, []
    left = [name for name in sinks if not files.exists(spark, f"{ledger}/sink={name}/batch={number}/_SUCCESS")]
    once = stored(batch, "batch") if left else batch
    for name in left:
        sinks[name](once, number)
        spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{ledger}/sink={name}/batch={number}")
        written.append(name)
    return written


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each batch in a folder of its own, which the batch's next write replaces."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def fan_out(stream: DataFrame, source: str, path: str, checkpoint: str, seconds: int | None = COMMIT_SECONDS) -> StreamingQuery:
    """One stream to many tables: each batch is written once, in a folder per route."""
    def handle(batch: DataFrame, number: int) -> None:
        batch.withColumn("route", route(F.col(source))).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route", "batch").parquet(path)

    return each_batch(stream, handle, checkpoint, seconds)


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events per hour and type; an hour is given out once the watermark has passed it. Rows of hours already given out are
    left out; Spark counts them in its progress (see dropped_late)."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n_events", "total")


def dropped_late(query: StreamingQuery) -> int:
    """Rows (after partial aggregation) that came behind the watermark, over the progress that the query still keeps."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def deduplicated(stream: DataFrame, keys: list[str], late: str = "60 days") -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def lag(ends: DataFrame, commits: DataFrame) -> DataFrame:
    """Messages not yet read, per group and topic: last offset less committed offset, over partitions."""
    last = ends.groupBy("topic", "partition").agg(F.max("offset").alias("last"))
    joined = commits.join(last, ["topic", "partition"])
    return joined.groupBy("group_id", "topic").agg(F.sum(F.greatest(F.col("last") - F.col("committed"), F.lit(0))).cast("long").alias("lag"))


def stalled(apps: DataFrame, now: F.Column) -> DataFrame:
    """Applications that run without cores for a minute, or wait for ten: with reason and age in seconds."""
    age = F.unix_timestamp(now) - F.unix_timestamp("started")
    reason = F.when((F.col("state") == "RUNNING") & (F.col("cores") == 0) & (age >= 60), "no_cores").when((F.col("state") == "WAITING") & (age >= 600), "waiting")
    return apps.withColumn("reason", reason).withColumn("age_s", age).where("reason is not null")
