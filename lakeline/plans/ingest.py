"""Ingest queries: discovery, filters, verdicts, batches, layout, resume, control tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeline.functions.types import cast_to
from lakeline.operators import audits, filters, history, schema
from lakeline.plans.registry import query
from lakeline.plans.retail import money, t
from lakeline.session import scratch
from lakeline.sources import messages, tables

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
COUNTS = " union all ".join(f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in NAMES)
#: An inventory of the tables: a row takes 1 MB, every table with a row count divisible by 7 is a view.
INVENTORY = f"(select upper(table_name) as table_name, n_rows * 1048576 as active_bytes, case when n_rows % 7 = 0 then 'VIEW' else 'BASE TABLE' end as table_type from ({COUNTS}))"
SIZED = f"(select lower(table_name) as table_name, active_bytes / 1073741824.0::double as size_gb from {INVENTORY})"
CAP_GB = 2.0


def counts(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for n in NAMES:
        one = t(spark, d, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        found = one if found is None else found.unionByName(one)
    return found


def inventory(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d).select(F.upper("table_name").alias("table_name"), (F.col("n_rows") * 1048576).alias("active_bytes"), F.when(F.col("n_rows") % 7 == 0, "VIEW").otherwise("BASE TABLE").alias("table_type"))


def sized(spark: SparkSession, d: str) -> DataFrame:
    rows = inventory(spark, d)
    return tables.table_sizes(rows.select(F.lower("table_name").alias("table_name")), rows)


def named(spark: SparkSession, d: str, condition: F.Column) -> DataFrame:
    return counts(spark, d).where(condition).select("table_name")


@query("select n_nationkey, n_name, n_regionkey from nation")
def scan_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query(COUNTS)
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts(spark, d)


@query(f"select lower(table_name) as table_name from {INVENTORY} where table_type = 'BASE TABLE' order by 1")
def discover_tables(spark: SparkSession, d: str) -> DataFrame:
    return tables.discover_tables(inventory(spark, d))


@query(f"select * from {SIZED}")
def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sized(spark, d)


@query(f"""select coalesce(table_name, 'total') as table_name, sum(n_rows)::bigint as n_rows, true as has_bytes, true as adds_up from ({COUNTS}) group by rollup (table_name)""")
def stored_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the stored tables by their files, each and in total; the sizes themselves are beyond SQL: they are positive and add up."""
    sizes = tables.stored_sizes(spark, {n: f"{d}/{n}.parquet" for n in NAMES})
    whole = sizes.where("table_name is null").select(F.col("n_bytes").alias("all_bytes"))
    parts = sizes.where("table_name is not null").agg(F.sum("n_bytes").alias("sum_bytes"))
    rows = counts(spark, d).rollup("table_name").agg(F.sum("n_rows").alias("n_rows"))
    name = F.coalesce("table_name", F.lit("total")).alias("table_name")
    joined = rows.select(name, "n_rows").join(sizes.select(name, "n_bytes"), "table_name").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(parts))
    return joined.select("table_name", "n_rows", (F.col("n_bytes") > 0).alias("has_bytes"), (F.col("all_bytes") == F.col("sum_bytes")).alias("adds_up"))


@query(f"select * from {SIZED} where table_name not like 's%' and table_name not in ('events') and size_gb <= {CAP_GB}")
def table_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_tables(sized(spark, d), named(spark, d, ~F.col("table_name").startswith("s")), named(spark, d, F.col("table_name") == "events"), CAP_GB)


@query(f"""select table_name, size_gb, case when table_name like 's%' then 'SKIP (not in include list)' when table_name = 'events' then 'SKIP (excluded)' when size_gb > {CAP_GB} then 'SKIP (size)' else 'COPY' end as verdict from {SIZED}""")
def table_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return filters.verdicts(sized(spark, d), named(spark, d, ~F.col("table_name").startswith("s")), named(spark, d, F.col("table_name") == "events"), CAP_GB)


@query("select distinct event_type as table_name from events")
def missing_tables(spark: SparkSession, d: str) -> DataFrame:
    requested = t(spark, d, "events").select(F.col("event_type").alias("table_name")).distinct().unionByName(named(spark, d, F.col("n_rows") > 10))
    return filters.missing(requested, counts(spark, d).select("table_name"))


@query("select o_orderkey, row_number() over (order by o_orderkey) - 1 as row_no, (row_number() over (order by o_orderkey) - 1) // 4000 as batch_no from orders")
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    return tables.batches(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 4000)


@query("select date_trunc('hour', ts) as ts_hour, (event_id % 4)::int as event_id_bucket, count(*) as n_rows, sum(value::decimal(18,2))::double as total from events group by all")
def partition_layout(spark: SparkSession, d: str) -> DataFrame:
    """Written in folders by day and bucket, read back with the derived column in the filter's place."""
    events, path = t(spark, d, "events"), scratch(spark, "laid_out")
    tables.write_partitioned(events, ["days(ts)", "bucket(4, event_id)"], path)
    back = spark.read.schema(StructType([*events.schema.fields, *StructType.fromDDL("ts_day timestamp_ntz, event_id_bucket int").fields])).parquet(path)
    hour = tables.partition_columns(["hours(ts)"])["ts_hour"]
    return back.groupBy(hour.alias("ts_hour"), "event_id_bucket").agg(F.count(F.lit(1)).alias("n_rows"), money("value").alias("total"))


@query("select p_partkey, p_name as name, p_size as size, null::double as weight from part")
def align_schema(spark: SparkSession, d: str) -> DataFrame:
    target = StructType.fromDDL("p_partkey bigint, name string, size int, weight double")
    return schema.align(t(spark, d, "part").withColumnsRenamed({"p_name": "name", "p_size": "size"}), target)


@query("""select o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) as bigint) as level, try_cast(o_orderpriority as bigint) as bad, o_totalprice::decimal(12,1)::double as price, o_orderdate::date as order_day from orders""")
def type_cast(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("level"), F.col("o_orderpriority").alias("bad"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("order_day"))
    cast = cast_to(o, {"level": "INTEGER", "bad": "BIGINT", "price": "NUMBER(12,1)", "order_day": "DATE"})
    return cast.withColumn("price", F.col("price").cast("double"))


@query("select o_orderkey, o_custkey, o_totalprice, o_orderpriority from orders where o_orderkey % 2 = 0 union all select o_orderkey, o_custkey, o_totalprice, null from orders where o_orderkey % 2 = 1")
def insert_select(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return tables.insert_select(spark, o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1").drop("o_orderpriority"))


@query("select o_orderkey, o_totalprice from orders where not (o_orderkey % 3 = 0 or o_orderdate < timestamp '1997-01-01')")
def resume_plan(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    done = o.where((F.col("o_orderkey") % 3 == 0) | (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey")
    return history.still_missing(o, done, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""select o_orderpriority, count(*) as source_rows, count(*) filter (o_orderkey % 500 <> 0 or o_orderpriority <> '5-LOW') as target_rows, count(*) as logged_rows, count(*) filter (o_orderkey % 500 <> 0 or o_orderpriority <> '5-LOW') = count(*) as matches from orders group by o_orderpriority""")
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    logged = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("logged_rows"))
    return audits.reconcile(o, o.where("o_orderkey % 500 <> 0 or o_orderpriority <> '5-LOW'"), logged, "o_orderpriority")


@query(f"""select count(*) filter (n_rows % 3 = 0) as n_ok, count(*) filter (n_rows % 3 = 1) as n_failed, count(*) filter (n_rows % 3 = 2) as n_skipped, sum(case when n_rows % 3 = 0 then n_rows else 0 end)::bigint as total_rows,
case when count(*) filter (n_rows % 3 = 1) = 0 then 'success' when count(*) filter (n_rows % 3 = 0) > 0 then 'partial' else 'failed' end as status from ({COUNTS})""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("n_rows") % 3
    ok, failed = F.count_if(third == 0), F.count_if(third == 1)
    return counts(spark, d).agg(ok.alias("n_ok"), failed.alias("n_failed"), F.count_if(third == 2).alias("n_skipped"), F.sum(F.when(third == 0, F.col("n_rows")).otherwise(0)).alias("total_rows"), F.when(failed == 0, "success").when(ok > 0, "partial").otherwise("failed").alias("status"))


KINDS = "case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' when 'DATE' then 'date' else lower(column_type) end"


@query(" union all ".join(f"select '{n}' as table_name, column_name, {KINDS} as data_type from (describe {n})" for n in ("orders", "lineitem", "events")))
def schema_probe(spark: SparkSession, d: str) -> DataFrame:
    """Columns and types of stored tables, of which no row is read."""
    found = [(n, f.name, f.dataType.simpleString()) for n in ("orders", "lineitem", "events") for f in tables.probe_schema(tables.read_table(spark, d, n)).fields]
    return spark.createDataFrame(found, "table_name string, column_name string, data_type string")


@query("select o_orderkey, o_totalprice, case when o_orderkey % 2 = 1 then o_orderpriority end as note from orders")
def append_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to one table, of which the second has a column more."""
    o, path = t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("note")), scratch(spark, "grown")
    tables.append(o.where("o_orderkey % 2 = 0").drop("note"), path)
    tables.append(o.where("o_orderkey % 2 = 1"), path)
    return tables.read_merged(spark, path).select("o_orderkey", "o_totalprice", "note")


@query("select l_orderkey, l_linenumber, l_quantity, true as in_files from lineitem")
def sized_write(spark: SparkSession, d: str) -> DataFrame:
    """Written in files of about 256 MB; how many there are is beyond SQL: no more than the bytes ask for, and one."""
    rows, path = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), scratch(spark, "sized")
    tables.write_sized(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    files = history.file_stats(back).agg((F.count(F.lit(1)) <= F.ceil(F.coalesce(F.sum("file_bytes"), F.lit(0)) / tables.FILE_BYTES) + 1).alias("in_files"))
    return back.crossJoin(F.broadcast(files))


@query("""select 'customers' as topic, c_custkey::varchar as key, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' as value from customer""")
def keyed_messages(spark: SparkSession, d: str) -> DataFrame:
    return messages.as_messages(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "customers")


@query("select n_nationkey, n_name, n_regionkey from nation")
def seed_table(spark: SparkSession, d: str) -> DataFrame:
    """A static table from a CSV file with a header."""
    n, path = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), scratch(spark, "seed")
    n.write.option("header", "true").csv(path)
    return tables.seed(spark, path, n.schema)


@query("select o_orderpriority, count(*) as n_orders from orders group by o_orderpriority")
def registered_view(spark: SparkSession, d: str) -> DataFrame:
    """A stored table under a view's name, asked in SQL."""
    tables.register(t(spark, d, "orders"), "lakeline_orders")
    return spark.sql("select o_orderpriority, count(*) as n_orders from lakeline_orders group by o_orderpriority")


@query("select o_orderkey, (o_orderkey // 4000) * 1099511627776 + o_orderkey % 4000 as snap_id, o_orderdate as snap_timestamp from orders")
def audit_columns(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return tables.with_audit(o, F.floor(F.col("o_orderkey") / 4000), F.col("o_orderkey") % 4000, F.col("o_orderdate")).drop("o_orderdate")


@query("select least(count(*), 1000)::bigint as n_rows, true as of_table from orders")
def capped_result(spark: SparkSession, d: str) -> DataFrame:
    """An ad-hoc result is cut at 1000 rows; which ones is open, but they are the table's."""
    o = t(spark, d, "orders").select("o_orderkey")
    few = tables.capped(o)
    found = few.join(F.broadcast(o.agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))), F.col("o_orderkey").between(F.col("lo"), F.col("hi")), "left")
    return found.agg(F.count(F.lit(1)).alias("n_rows"), (F.count("lo") == F.count(F.lit(1))).alias("of_table"))
