"""Metric-series queries over events: the metric is the event's type, the label its user's last digit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.operators import series
from lakeline.plans.registry import query
from lakeline.plans.retail import money, t
from lakeline.session import scratch

SAMPLES = "(select event_type as metric, (user_id % 10)::int as u, ts, event_id, value from events)"
#: A counter that restarts where the id is divisible by 97.
COUNTER = "(select event_type as metric, (user_id % 10)::int as u, ts, event_id, case when event_id % 97 = 0 then 1.0 else event_id::double end as value from events)"


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return e.select(F.col("event_type").alias("metric"), F.create_map(F.lit("user"), (F.col("user_id") % 10).cast("string")).alias("labels"), (F.col("user_id") % 10).cast("int").alias("u"), "ts", "event_id", "value")


@query(f"select metric, u, max(ts) as ts, arg_max(value, (ts, event_id)) as value from {SAMPLES} where ts <= timestamp '2024-01-20' group by all")
def metric_instant(spark: SparkSession, d: str) -> DataFrame:
    return series.instant(samples(spark, d), F.lit("2024-01-20").cast("timestamp_ntz"), ["metric", "u"], ["event_id"])


@query(f"select metric, u, count(*) as n from {SAMPLES} where metric = 'click' and regexp_full_match(u::varchar, '[2-5]') group by all")
def metric_filter(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where((F.col("metric") == "click") & F.col("labels")["user"].rlike("^(?:[2-5])$"))
    return s.groupBy("metric", "u").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select metric, u, sum(d::decimal(28,4))::double as increase, sum(d::decimal(28,4))::double / (30 * 86400) as rate from
(select metric, u, case when b is null then 0 when value < b then value else value - b end as d from (select *, lag(value) over (partition by metric, u order by ts, event_id) as b from {COUNTER})) group by all""")
def metric_rate(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("value", F.when(F.col("event_id") % 97 == 0, 1.0).otherwise(F.col("event_id").cast("double")))
    return series.increase(s, ["metric", "u"], ["ts", "event_id"], [], F.to_date("ts")).withColumn("rate", F.col("increase") / (30 * 86400))


@query(f"""with s as (select metric, u, date_diff('second', timestamp '2024-01-01', date_trunc('second', ts))::hugeint as x, (value::decimal(18,2) * 100)::bigint::hugeint as y from {SAMPLES} where value is not null),
f as (select metric, u, count(*)::hugeint as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy, max(x) as last_x from s group by all),
p as (select metric, u, (sy::double + (n * sxy - sx * sy)::double / nullif((n * sxx - sx * sx)::double, 0) * (n * (last_x + 86400) - sx)::double) / n::double / 100 as predicted from f)
select metric, u, round(predicted, 6) as predicted, predicted < 0 as alert from p""")
def metric_predict(spark: SparkSession, d: str) -> DataFrame:
    """A line through each series, read a day ahead."""
    x = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    return series.predict(samples(spark, d), ["metric", "u"], x, 86400).select("metric", "u", F.round("predicted", 6).alias("predicted"), (F.col("predicted") < 0).alias("alert"))


@query(f"""with g as (select metric, u, unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-29', interval 6 hour)) as ts from (select distinct metric, u from {SAMPLES}))
select g.metric, g.u, g.ts, s.value from g asof join (select metric, u, ts, arg_max(value, event_id) as value from {SAMPLES} group by all) s on g.metric = s.metric and g.u = s.u and g.ts >= s.ts""")
def metric_range(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).groupBy("metric", "u", "ts").agg(F.max_by("value", "event_id").alias("value"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return series.on_grid(s, at("2024-01-02"), at("2024-01-29"), 6 * 3600, ["metric", "u"]).select("metric", "u", "ts", "value")


@query(f"select u, sum(value::decimal(18,2))::double / 1000 as thousands from {SAMPLES} group by u")
def metric_sum_by(spark: SparkSession, d: str) -> DataFrame:
    key = series.label_key()
    return samples(spark, d).groupBy(key.alias("k"), "u").agg((money("value") / 1000).alias("thousands")).select("u", "thousands")


@query(f"""select u, c.v / nullif(a.v, 0) as ratio from (select u, sum(value::decimal(18,2))::double as v from {SAMPLES} where metric = 'click' group by u) c join (select u, sum(value::decimal(18,2))::double as v from {SAMPLES} group by u) a using (u)""")
def metric_ratio(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("k", series.label_key())
    total = lambda df: df.groupBy("k").agg(money("value").alias("value"))
    return series.ratio(total(s.where("metric = 'click'")), total(s), ["k"]).select(F.col("k")[0]["value"].cast("int").alias("u"), "ratio")


@query(f"select distinct metric, u::varchar as label from {SAMPLES}")
def metric_labels(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("metric", F.col("labels")["user"].alias("label")).distinct()


@query(f"""select metric as alertname, u as namespace, count(*) as n_alerts, case when max(value) > 400 then 'critical' when max(value) > 100 then 'warning' else 'info' end as severity from {SAMPLES} where value > 20 group by all""")
def alert_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).where("value > 20").groupBy(F.col("metric").alias("alertname"), F.col("u").alias("namespace"))
    return rows.agg(F.count(F.lit(1)).alias("n_alerts"), F.when(F.max("value") > 400, "critical").when(F.max("value") > 100, "warning").otherwise("info").alias("severity"))


@query(f"select u, ts, 'events:value:sum' as metric, sum(value::decimal(28,4))::double * 1000 as value from {SAMPLES} group by u, ts")
def metric_record(spark: SparkSession, d: str) -> DataFrame:
    """Sums by label, stored as a metric of their own."""
    return series.record(samples(spark, d), ["u"], "events:value:sum", scratch(spark, "recorded"), 1000.0).select("u", "ts", "metric", "value")
