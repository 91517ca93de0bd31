"""History queries: events written in batches of 2500 ids, each an update of its user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeline.operators import audits, history
from lakeline.plans.registry import query
from lakeline.plans.retail import money, t
from lakeline.session import scratch
from lakeline.sources import tables

ROWS = "(select user_id, event_id // 2500 as snap_batch, max(event_id) as last_event, max(ts) as snap_timestamp from events group by all)"


def rows(spark: SparkSession, d: str) -> DataFrame:
    batch = F.floor(F.col("event_id") / 2500).alias("snap_batch")
    return t(spark, d, "events").groupBy("user_id", batch).agg(F.max("event_id").alias("last_event"), F.max("ts").alias("snap_timestamp"))


def at_version(v: int) -> str:
    return f"select user_id, snap_batch, last_event from {ROWS} where snap_batch <= {v} qualify row_number() over (partition by user_id order by snap_batch desc) = 1"


@query(at_version(1))
def as_of_version(spark: SparkSession, d: str) -> DataFrame:
    return history.as_of_version(rows(spark, d), ["user_id"], 1).select("user_id", "snap_batch", "last_event")


@query(f"select user_id, snap_batch, last_event from {ROWS} where snap_timestamp <= timestamp '2024-01-15' qualify row_number() over (partition by user_id order by snap_timestamp desc) = 1")
def as_of_time(spark: SparkSession, d: str) -> DataFrame:
    return history.as_of_time(rows(spark, d), ["user_id"], F.lit("2024-01-15").cast("timestamp_ntz")).select("user_id", "snap_batch", "last_event")


@query(f"select user_id, (select max(snap_batch) + 1 from {ROWS}) as snap_batch, last_event from ({at_version(1)})")
def rollback_version(spark: SparkSession, d: str) -> DataFrame:
    """A new head batch that restores the state of batch 1."""
    return history.rollback(rows(spark, d), ["user_id"], 1).select("user_id", "snap_batch", "last_event")


@query(f"""with r as {ROWS}, b as (select snap_batch, count(*) as added, row_number() over (order by snap_batch) as place from r group by snap_batch),
p as (select user_id, place from r join b using (snap_batch)),
c as (select place, count(*) filter (new) as new_keys, count(*) filter (not new) as deleted from (
  select n.place, true as new from p n where not exists (select 1 from p o where o.user_id = n.user_id and o.place = n.place - 1)
  union all select o.place + 1, false from p o where not exists (select 1 from p n where n.user_id = o.user_id and n.place = o.place + 1)) group by place)
select snap_batch, added, (sum(added) over (order by snap_batch))::bigint as total, added - coalesce(lag(added) over (order by snap_batch), 0) as delta, coalesce(new_keys, 0) as new_keys, coalesce(deleted, 0) as deleted from b left join c using (place)""")
def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    return history.snapshots(rows(spark, d), ["user_id"])


@query(f"select distinct snap_batch from {ROWS} order by snap_batch desc limit 5")
def snapshot_retention(spark: SparkSession, d: str) -> DataFrame:
    return history.retained(rows(spark, d), 5)


def laid_out(spark: SparkSession, d: str, rows: int) -> DataFrame:
    """Orders in folders by status and priority, each folder's rows in files of at most so many rows."""
    o, path = t(spark, d, "orders"), scratch(spark, "parted")
    keys = ["o_orderstatus", "o_orderpriority"]
    o.repartition(*keys).write.option("maxRecordsPerFile", rows).partitionBy(*keys).parquet(path)
    return spark.read.schema(o.schema).parquet(path)


@query("select sum(ceil(n / 500.0))::bigint as n_files, sum(n)::bigint as n_rows, true as sizes_fit from (select count(*) as n from orders group by o_orderstatus, o_orderpriority)")
def file_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes themselves are beyond SQL: they are positive and in order."""
    audit = history.file_audit(history.file_stats(laid_out(spark, d, 500)))
    return audit.select("n_files", "n_rows", ((F.col("min_mb") > 0) & (F.col("min_mb") <= F.col("avg_mb")) & (F.col("avg_mb") <= F.col("max_mb"))).alias("sizes_fit"))


@query("select o_orderstatus, o_orderpriority, count(*) as n_rows, ceil(count(*) / 200.0)::bigint as n_files, true as has_bytes from orders group by all")
def partition_stats(spark: SparkSession, d: str) -> DataFrame:
    found = history.partition_stats(laid_out(spark, d, 200), ["o_orderstatus", "o_orderpriority"])
    return found.select("o_orderstatus", "o_orderpriority", "n_rows", "n_files", (F.col("n_bytes") > 0).alias("has_bytes"))


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def compact_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Compacted and sorted; that both sides hold the same rows is made sure of by their fingerprints."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return history.compact(o, ["o_custkey", "o_orderkey"], scratch(spark, "compacted"))


@query("select date_trunc('hour', ts) as ts_hour, count(*) as n_rows, sum(value::decimal(18,2))::double as total from events group by all")
def layout_change(spark: SparkSession, d: str) -> DataFrame:
    """Events in folders by day, rewritten in folders by hour: half of the days first, as if it had been cut off there, then what is left."""
    events, by_day, target = t(spark, d, "events"), scratch(spark, "by_day"), scratch(spark, "by_hour")
    tables.write_partitioned(events, [], by_day, columns={"day": F.to_date("ts")})
    stored = spark.read.schema(StructType([*events.schema.fields, *StructType.fromDDL("day date").fields])).parquet(by_day)
    for part in (stored.where(F.dayofmonth("day") % 2 == 0), stored):
        history.change_layout(part, "day", ["hours(ts)"], target)
    back = spark.read.schema(StructType([*events.schema.fields, *StructType.fromDDL("day date, ts_hour timestamp_ntz").fields])).parquet(f"{target}/rows")
    return back.groupBy("ts_hour").agg(F.count(F.lit(1)).alias("n_rows"), money("value").alias("total"))


#: Ranges of order numbers that a copy has committed, overlapping, repeated and beyond the end; and the whole range of each table.
COMMITTED = "select o_orderpriority as table_name, o_orderkey as start, o_orderkey + o_custkey % 400 as stop from orders where o_orderkey % 17 = 0 or o_orderkey % 34 = 0"
WANTED = "select o_orderpriority as table_name, min(o_orderkey) + 50 as start, max(o_orderkey) + 1 as stop from orders group by 1"
GAPS = f"""with c as (select distinct * from ({COMMITTED}) where start < stop), w as ({WANTED}),
e as (select table_name, w.start as p from w union select table_name, c.stop from c join w using (table_name) where c.stop > w.start and c.stop < w.stop),
f as (select e.table_name, e.p, w.stop as last from e join w using (table_name) where not exists (select 1 from c where c.table_name = e.table_name and c.start <= e.p and c.stop > e.p))
select f.table_name, f.p as start, least(min(coalesce(c.start, f.last)), any_value(f.last)) as stop from f left join c on c.table_name = f.table_name and c.start > f.p group by f.table_name, f.p"""


def copy_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What the ledger leaves of each table's range."""
    o = t(spark, d, "orders")
    named = F.col("o_orderpriority").alias("table_name")
    ranges = o.where("o_orderkey % 17 = 0").select(named, F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 400).alias("stop"))
    committed = ranges.unionByName(ranges.where("start % 34 = 0"))
    wanted = o.groupBy(named).agg((F.min("o_orderkey") + 50).alias("start"), (F.max("o_orderkey") + 1).alias("stop"))
    return history.range_gaps(wanted, committed, ["table_name"])


@query(GAPS)
def resume_ranges(spark: SparkSession, d: str) -> DataFrame:
    return copy_ranges(spark, d)


@query(f"select o.o_orderkey, o.o_orderpriority as table_name from orders o join ({GAPS}) g on g.table_name = o.o_orderpriority and o.o_orderkey >= g.start and o.o_orderkey < g.stop")
def resume_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a resumed copy still has to bring."""
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("table_name"))
    return history.in_ranges(o, copy_ranges(spark, d), ["table_name"], "o_orderkey").select("o_orderkey", "table_name")


@query("""select o_orderpriority, count(*) as source_rows, count(*) filter (o_orderkey % 500 <> 0 or o_orderpriority <> '5-LOW') as target_rows,
count(*) filter (o_orderkey % 500 = 0 and o_orderpriority = '5-LOW' or o_orderkey % 700 = 0 and o_orderpriority in ('1-URGENT', '5-LOW')) = 0 as same_rows from orders group by o_orderpriority""")
def reconcile_rows(spark: SparkSession, d: str) -> DataFrame:
    """A copy that lacks rows of one group and has others of the same number in another: counts find the one, fingerprints both."""
    o = t(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    moved = (F.col("o_orderkey") % 700 == 0) & (F.col("o_orderpriority") == "1-URGENT")
    copy = o.where("o_orderkey % 500 <> 0 or o_orderpriority <> '5-LOW'")
    copy = copy.withColumn("o_totalprice", F.when(moved | ((F.col("o_orderkey") % 700 == 0) & (F.col("o_orderpriority") == "5-LOW")), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return audits.reconcile_rows(o, copy, ["o_orderpriority"])
