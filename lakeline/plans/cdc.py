"""Change data capture: change logs derived from orders, merged in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.operators import filters, merge, schema, series
from lakeline.plans.registry import query
from lakeline.plans.retail import t
from lakeline.session import scratch, stored
from lakeline.streaming import buckets, jobs

#: Up to three changes per order: created, updated where the key is divisible by 3, deleted where by 10.
LOG = """(select o_orderkey as k, o_orderpriority as table_name, 'c' as op, o_orderkey * 10 + 1 as seq, o_totalprice as total from orders
union all select o_orderkey, o_orderpriority, 'u', o_orderkey * 10 + 2, o_totalprice + 1 from orders where o_orderkey % 3 = 0
union all select o_orderkey, o_orderpriority, 'd', o_orderkey * 10 + 3, o_totalprice from orders where o_orderkey % 10 = 0)"""
LAST = f"(select * from {LOG} qualify row_number() over (partition by k order by seq desc) = 1)"


def change_log(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    kinds = F.array(F.lit(1), F.when(F.col("o_orderkey") % 3 == 0, 2), F.when(F.col("o_orderkey") % 10 == 0, 3))
    rows = o.withColumn("n", F.explode(F.array_compact(kinds)))
    return rows.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("table_name"), F.element_at(F.array(F.lit("c"), F.lit("u"), F.lit("d")), F.col("n")).alias("op"), (F.col("o_orderkey") * 10 + F.col("n")).alias("seq"), F.when(F.col("n") == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("total"))


def merged(log: DataFrame) -> DataFrame:
    return merge.live(merge.apply_changes(merge.empty_target(log, ["k"], ["total"], "seq"), log, ["k"], "seq"))


@query(f"select k, op, seq, total from {LAST}")
def cdc_latest(spark: SparkSession, d: str) -> DataFrame:
    return merge.latest(change_log(spark, d), ["k"], [F.col("seq")]).select("k", "op", "seq", "total")


def streamed(df: DataFrame, name: str, parts: int | None = None) -> tuple[DataFrame, str]:
    """df as a stream of its files in two micro-batches or more (of one file: one), and a checkpoint for its query."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    parts = parts or max(4, spark.sparkContext.defaultParallelism)
    df.repartition(parts).write.parquet(path)
    return jobs.table_source(spark, path, df.schema, files_per_batch=-(-parts // 2)), scratch(spark, "offsets")


@query(f"select k, total from {LAST} where op <> 'd'")
def cdc_apply(spark: SparkSession, d: str) -> DataFrame:
    """The change log as a stream into a table in folders by key bucket; its last batch comes once more, and changes nothing."""
    log, path = change_log(spark, d), scratch(spark, "table")
    stream, checkpoint = streamed(log, "log")
    query = buckets.apply_changes(stream, path, ["k"], ["total"], checkpoint, buckets=16, seconds=None)
    for number in [p["batchId"] for p in query.recentProgress[-1:]]:
        buckets.apply_batch(log.limit(0), number, path, ["k"], ["total"], buckets=16)
    return buckets.read(spark, path, buckets.state_schema(log.schema, ["k"], ["total"], "seq"))


@query("select lower(regexp_extract('SHOP.' || case when o_orderkey % 2 = 0 then 'ORDERS' else 'ORDER_ITEMS' end, '([A-Z_]+)$', 1)) as route, count(*) as n_rows from orders group by 1")
def cdc_fanout(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "SHOP.ORDERS").otherwise("SHOP.ORDER_ITEMS").alias("source_table"))
    target = scratch(spark, "routes")
    stream, checkpoint = streamed(rows, "mixed")
    jobs.fan_out(stream, "source_table", target, checkpoint, seconds=None)
    return spark.read.schema("o_orderkey long, source_table string, route string, batch int").parquet(target).groupBy("route").agg(F.count(F.lit(1)).alias("n_rows"))


#: Per priority the lowest order number at or after a time.
SYNC = "select o_orderpriority as table_name, min(o_orderkey) as scn from orders where o_orderdate >= timestamp '1998-01-01' + interval (length(o_orderpriority)) day group by 1"


def sync_points(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("table_name"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("scn"))
    points = o.select("table_name").distinct().withColumn("at", (F.lit("1998-01-01").cast("timestamp") + F.make_interval(days=F.length("table_name"))).cast("timestamp_ntz")).withColumn("name", F.col("table_name"))
    return series.asof_forward(points, o, ["table_name"], "at", "ts", "scn").select("table_name", "scn")


@query(SYNC)
def sync_point_asof(spark: SparkSession, d: str) -> DataFrame:
    return sync_points(spark, d)


@query(f"select table_name, count(*) as n_changes, min(seq) as first_seq from {LOG} join ({SYNC}) using (table_name) where seq >= scn * 10 group by table_name")
def cdc_from_sync_point(spark: SparkSession, d: str) -> DataFrame:
    """The change log as a stream, from each table's sync point on."""
    points = sync_points(spark, d).select("table_name", (F.col("scn") * 10).alias("start_scn"))
    log = change_log(spark, d)
    stream, checkpoint = streamed(log, "log")
    target = scratch(spark, "accepted")
    jobs.load(jobs.from_start(stream, points), target, checkpoint, seconds=None)
    accepted = spark.read.schema(log.schema).parquet(target)
    return accepted.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_changes"), F.min("seq").alias("first_seq"))


@query(f"select k, total from {LAST} where op <> 'd'")
def cdc_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """A copy of the state at one change number, and the changes from a lower one on, give the final state."""
    log = change_log(spark, d)
    cut = F.lit(log.agg(F.floor(F.max("seq") / 2)).first()[0])
    copy = merge.apply_changes(merge.empty_target(log, ["k"], ["total"], "seq"), log.where(F.col("seq") <= cut), ["k"], "seq")
    return merge.live(merge.apply_changes(copy, log.where(F.col("seq") >= cut - 5_000), ["k"], "seq"))


@query(f"select k, total from {LAST} where op <> 'd'")
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A table, merged with later changes and freed of deleted keys."""
    log = change_log(spark, d)
    rows = lambda op: log.where(F.col("op") == op).select("k", "total")
    return merge.delete_keys(merge.merge_upsert(rows("c"), rows("u"), ["k"]), rows("d"), ["k"])


@query(f"select k::varchar as key, total as value from {LAST} where op <> 'd'")
def compact_log(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d).select(F.col("k").cast("string").alias("key"), "seq", F.when(F.col("op") != "d", F.col("total")).alias("value"))
    return merge.compact_log(log, ["key"], [F.col("seq")], "value").select("key", "value")


@query("select o_orderkey, o_totalprice from orders where not coalesce(o_totalprice < 100000 and o_orderstatus = 'F', false)")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return merge.delete_where(o, (F.col("o_totalprice") < 100000) & (F.col("o_orderstatus") == "F")).drop("o_orderstatus")


@query("select o_orderkey, case when o_orderstatus = 'O' then 'P' else o_orderstatus end as o_orderstatus, case when o_orderstatus = 'O' then o_totalprice + 5 else o_totalprice end as o_totalprice from orders")
def update_where(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return merge.update_where(o, F.col("o_orderstatus") == "O", {"o_orderstatus": F.lit("P"), "o_totalprice": F.col("o_totalprice") + 5})


@query("select distinct lower(regexp_extract('DB.SALES.' || upper(event_type), '([A-Z_]+)$', 1)) as route, event_type from events")
def route_topic(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(filters.route(F.concat(F.lit("DB.SALES."), F.upper("event_type"))).alias("route"), "event_type").distinct()


@query("select event_id, case when event_id % 4 = 1 then 'create table x' else 'ALTER TABLE ' || event_type || ' ADD c' || (event_id % 9) end as ddl, event_type as table_name from events where event_id % 4 not in (0, 1) and event_id % 5 <> 0")
def ddl_events(spark: SparkSession, d: str) -> DataFrame:
    four = F.col("event_id") % 4
    rows = t(spark, d, "events").select("event_id", F.when(four == 1, "create table x").when(four != 0, F.concat(F.lit("ALTER TABLE "), "event_type", F.lit(" ADD c"), (F.col("event_id") % 9).cast("string"))).alias("ddl"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("table_name"))
    return filters.ddl_events(rows)


#: Two versions of a schema per order status: columns named by the priorities that occur before and after a day.
VERSIONS = "select o_orderstatus as subject, o_orderpriority as name, case when {} then 'int' else 'bigint' end as type from orders where {} group by 1, 2"
OLD_SQL = VERSIONS.format("max(o_orderkey) % 2 = 0", "o_orderdate < timestamp '1995-01-20'")
NEW_SQL = VERSIONS.format("max(o_orderkey) % 3 = 0", "o_orderdate >= timestamp '2001-07-01'")
DIFF_SQL = f"""select subject, name, case when a.type is null then 'add' when b.type is null then 'remove' else 'modify' end as change, a.type as old_type, b.type as new_type
from ({OLD_SQL}) a full join ({NEW_SQL}) b using (subject, name) where a.type is distinct from b.type"""


def schema_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    def of(condition: F.Column, n: int) -> DataFrame:
        rows = t(spark, d, "orders").where(condition).groupBy(F.col("o_orderstatus").alias("subject"), F.col("o_orderpriority").alias("name")).agg(F.max("o_orderkey").alias("m"))
        return rows.select("subject", "name", F.when(F.col("m") % n == 0, "int").otherwise("bigint").alias("type"))

    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return of(F.col("o_orderdate") < at("1995-01-20"), 2), of(F.col("o_orderdate") >= at("2001-07-01"), 3)


@query(DIFF_SQL)
def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    return schema.difference(*schema_versions(spark, d), ["subject"])


@query(f"""with d as ({DIFF_SQL}) select subject, count(*) as n_changes, count(*) filter (change = 'add' and name not like '1%' or change = 'modify' and not (old_type = 'int' and new_type = 'bigint')) as n_breaking,
count(*) filter (change = 'add' and name not like '1%' or change = 'modify' and not (old_type = 'int' and new_type = 'bigint')) = 0 as compatible from d group by subject""")
def schema_compat(spark: SparkSession, d: str) -> DataFrame:
    old, new = schema_versions(spark, d)
    defaults = new.where(F.col("name").startswith("1")).select("subject", "name")
    return schema.compatible(schema.difference(old, new, ["subject"]), defaults, ["subject"])


#: Schemas of three tables by quarter: a priority is a column where the largest order number isn't divisible by 3.
SCHEMAS = """(select o_orderstatus as subject, year(o_orderdate) * 4 + quarter(o_orderdate) as seq, o_orderpriority as name, case when max(o_orderkey) % 2 = 0 then 'int' else 'bigint' end as type
from orders group by all having max(o_orderkey) % 3 <> 0)"""
SCHEMA_CHANGES = f"""with s as {SCHEMAS}, v as (select subject, seq, lag(seq) over (partition by subject order by seq) as before from (select distinct subject, seq from s)),
n as (select v.subject, v.seq, name, type from v join s using (subject, seq) where before is not null),
o as (select v.subject, v.seq, name, type from v join s on s.subject = v.subject and s.seq = v.before)
select subject, seq::bigint as seq, name, case when o.type is null then 'add' when n.type is null then 'remove' else 'modify' end as change, o.type as old_type, n.type as new_type
from o full join n using (subject, seq, name) where o.type is distinct from n.type"""


@query(SCHEMA_CHANGES)
def schema_changes(spark: SparkSession, d: str) -> DataFrame:
    """One stream of three tables' schemas, which arrives in three parts: the last schema of each table is kept between them."""
    o = t(spark, d, "orders")
    seq = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long")
    columns = o.groupBy(F.col("o_orderstatus").alias("subject"), seq.alias("seq"), F.col("o_orderpriority").alias("name")).agg(F.max("o_orderkey").alias("m")).where("m % 3 <> 0")
    typed = F.struct("name", F.when(F.col("m") % 2 == 0, "int").otherwise("bigint").alias("type"))
    versions = stored(columns.groupBy("subject", "seq").agg(F.sort_array(F.collect_list(typed)).alias("columns")), "versions")
    first, last = versions.agg(F.min("seq"), F.max("seq")).first()
    path, target, offsets = scratch(spark, "schemas"), scratch(spark, "changes"), scratch(spark, "offsets")
    changes = None
    for part in range(3):
        third = F.floor((F.col("seq") - F.lit(first)) * 3 / F.lit((last or 0) - (first or 0) + 1)) == part
        versions.where(third).write.mode("append").parquet(path)
        changes = jobs.schema_changes(jobs.table_source(spark, path, versions.schema, files_per_batch=100_000))
        jobs.load(changes, target, offsets, seconds=None)
    return spark.read.schema(changes.schema).parquet(target)


@query("select o_orderkey as order_key, o_totalprice::decimal(20,2)::double as o_totalprice, o_orderkey::bigint as wide, null::varchar as note from orders")
def schema_evolve(spark: SparkSession, d: str) -> DataFrame:
    """A table that was loaded under two versions of its schema: the changes between come from a stream of several tables' schemas,
    older rows go through them when they are read, and a column is renamed."""
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), F.col("o_orderkey").cast("int").alias("wide"), "o_orderstatus")
    first = o.drop("o_orderstatus").withColumns({"wide": F.col("wide").cast("bigint"), "note": F.lit(None).cast("string")})
    second = first.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(20,2)"))
    ddl = spark.createDataFrame([(name, n, df.dtypes) for name in ("orders", "other") for n, df in enumerate((o, first, first, second))], "subject string, seq long, columns array<struct<name: string, type: string>>")
    stream, checkpoint = streamed(ddl.coalesce(1), "ddl", 1)
    target = scratch(spark, "changes")
    changes = jobs.schema_changes(stream)
    jobs.load(changes, target, checkpoint, seconds=None)
    own = schema.changes_of(spark.read.schema(changes.schema).parquet(target).where("subject = 'orders'"))
    parts = [(0, stored(o.where("o_orderkey % 2 = 0"), "v0")), (3, stored(second.where("o_orderkey % 2 = 1"), "v3"))]
    found = schema.evolve(schema.evolved(parts, own), [("rename", "o_totalprice", "price")])
    return found.select(F.col("o_orderkey").alias("order_key"), F.col("price").cast("double").alias("o_totalprice"), "wide", "note")


@query("select o_orderpriority as table_name, min(o_orderkey) as scn, (count(*) filter (o_orderdate >= timestamp '2001-07-25') > 0) as ready from orders group by 1")
def watermark_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which tables have a sync point, and so may start to stream."""
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("table_name"), "o_orderkey", "o_orderdate")
    tables = o.groupBy("table_name").agg(F.min("o_orderkey").alias("scn"))
    points = o.where(F.col("o_orderdate") >= F.lit("2001-07-25").cast("timestamp_ntz")).select("table_name")
    have = tables.join(points, "table_name", "left_semi").withColumn("ready", F.lit(True))
    return have.unionByName(tables.join(points, "table_name", "left_anti").withColumn("ready", F.lit(False)))


@query("""select o_orderpriority as table_name, max(o_orderdate) as extraction_ts, count(*) as rows_copied, case when max(o_orderkey) % 2 = 0 then null else min(o_orderkey) end as start_scn from orders group by 1""")
def watermark_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("table_name")).agg(F.max("o_orderdate").alias("extraction_ts"), F.count(F.lit(1)).alias("rows_copied"), F.min("o_orderkey").alias("start_scn"), F.max("o_orderkey").alias("m"))
    old = rows.drop("m")
    return merge.upsert_reset(old, rows.where("m % 2 = 0").drop("m"), ["table_name"], ["start_scn"])
