"""Incremental models, audits and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.operators import audits, models
from lakeline.plans.events import HOURLY, hour
from lakeline.plans.registry import query
from lakeline.plans.retail import money, t
from lakeline.session import scratch


def hourly_model(rows: DataFrame) -> DataFrame:
    return rows.groupBy(hour().alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), money("value").alias("total"))


def model_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hour timestamp_ntz, event_type string, n_events long, total double, model_day date").parquet(path).drop("model_day")


@query(HOURLY.replace("from events", "from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'"))
def model_time_range(spark: SparkSession, d: str) -> DataFrame:
    """A range, then a part of it again: the same rows stand once."""
    events, path = t(spark, d, "events"), scratch(spark, "model")
    for start, stop in (("2024-01-05", "2024-01-20"), ("2024-01-08", "2024-01-10")):
        models.run_time_range(hourly_model, events, "ts", start, stop, path, lambda r: F.to_date("hour"))
    return model_table(spark, path)


@query(HOURLY.replace("from events", "from events where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-12'"))
def model_backfill(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "model")
    models.backfill(hourly_model, t(spark, d, "events"), "ts", [("2024-01-03", "2024-01-06"), ("2024-01-06", "2024-01-09"), ("2024-01-08", "2024-01-12")], path, lambda r: F.to_date("hour"))
    return model_table(spark, path)


@query(HOURLY)
def model_full(spark: SparkSession, d: str) -> DataFrame:
    """Built from a part of the events and then from all: the whole table is replaced."""
    events, path = t(spark, d, "events"), scratch(spark, "model")
    for rows in (events.where("event_id % 2 = 0"), events):
        models.run_full(hourly_model(rows), path)
    return spark.read.schema("hour timestamp_ntz, event_type string, n_events long, total double").parquet(path)


@query("select user_id, max(event_id) as event_id, arg_max(value, event_id) as value from events group by user_id")
def model_unique_key(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("user_id", "event_id", "value")
    middle = e.agg((F.max("event_id") / 2).alias("_m"))
    early = e.join(F.broadcast(middle), F.col("event_id") <= F.col("_m")).drop("_m")
    first = models.run_unique_key(e.limit(0), early, ["user_id"], [F.col("event_id")])
    return models.run_unique_key(first, e, ["user_id"], [F.col("event_id")])


@query("""select o_orderkey, case when o_orderkey % 11 = 0 then 'removed' when o_orderkey % 13 = 0 then 'added' else 'changed' end as change from orders
where (o_orderkey % 11 = 0) <> (o_orderkey % 13 = 0) or (o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 and o_orderkey % 7 = 0)""")
def table_diff(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    old = o.where("o_orderkey % 13 <> 0")
    new = o.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return audits.table_diff(old, new, ["o_orderkey"])


@query("""select unnest(['user_id','value','k']) as column_name, unnest([count(*) filter (user_id is null), count(*) filter (value is null), count(*) filter (case when event_id % 9 = 0 then null else event_id end is null)]) as n_null from events""")
def audit_not_null(spark: SparkSession, d: str) -> DataFrame:
    return audits.not_null(t(spark, d, "events").withColumn("k", F.when(F.col("event_id") % 9 != 0, F.col("event_id"))), ["user_id", "value", "k"])


@query("""select unnest(['l_quantity','l_discount','l_tax']) as column_name, unnest([count(*) filter (l_quantity < 1 or l_quantity > 40), count(*) filter (l_discount > 0.05), count(*) filter (l_tax < 0.02)]) as n_bad from lineitem""")
def audit_range(spark: SparkSession, d: str) -> DataFrame:
    return audits.accepted_range(t(spark, d, "lineitem"), {"l_quantity": (1, 40), "l_discount": (None, 0.05), "l_tax": (0.02, None)})


@query("select sum(c)::bigint as n_rows, count(*) as n_keys, count(*) filter (c > 1) as n_duplicated from (select count(*) as c from lineitem group by l_orderkey, l_linenumber)")
def audit_unique(spark: SparkSession, d: str) -> DataFrame:
    return audits.uniqueness(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select l_orderkey, l_partkey, l_linenumber from lineitem where l_partkey not in (select p_partkey from part where p_size < 40)")
def audit_fk(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return audits.orphans(lines, t(spark, d, "part").where("p_size < 40"), "l_partkey", "p_partkey").select("l_orderkey", "l_partkey", "l_linenumber")
