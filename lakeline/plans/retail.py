"""Retail queries: look-ups, joins, aggregations, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.operators import filters
from lakeline.plans.registry import query

AS_OF = "2001-08-02"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c: F.Column | str, scale: int = 2) -> F.Column:
    """A sum that doesn't depend on the order of its terms."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")).cast("double")


def day(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def line_total() -> F.Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def stock_delta() -> F.Column:
    return F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(-F.col("l_quantity"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey = 100")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").where("o_orderkey = 100").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("""select o_orderstatus, count(*) as n_orders, sum(o_totalprice::decimal(18,2))::double as revenue, sum(o_totalprice::decimal(18,2))::double / count(*) as avg_total, max(o_orderdate) as last_order
from orders where o_orderdate >= timestamp '2001-08-02' - interval 90 day group by o_orderstatus""")
def orders_by_status_recent(spark: SparkSession, d: str) -> DataFrame:
    recent = t(spark, d, "orders").where(F.col("o_orderdate") >= day("2001-05-04"))
    return recent.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), money("o_totalprice").alias("revenue"), (money("o_totalprice") / F.count(F.lit(1))).alias("avg_total"), F.max("o_orderdate").alias("last_order"))


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus in ('F','O') and o_totalprice between 300000 and 450000 and o_orderpriority = '1-URGENT' order by o_totalprice desc, o_orderkey limit 100")
def high_value_orders(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(300000, 450000) & (F.col("o_orderpriority") == "1-URGENT")
    return t(spark, d, "orders").where(c).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select doc_id, lang, n_chars from documents join labels using (doc_id) where regexp_matches(text, '(idiot|license)', 'i') and quality >= 1")
def text_regex_filter(spark: SparkSession, d: str) -> DataFrame:
    good = t(spark, d, "labels").where("quality >= 1").select("doc_id")
    return t(spark, d, "documents").where(F.col("text").rlike("(?i)(idiot|license)")).join(good, "doc_id").select("doc_id", "lang", "n_chars")


@query("select c_custkey, c_name from customer where c_name ilike '%0005%'")
def name_substring(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").where(F.col("c_name").ilike("%0005%")).select("c_custkey", "c_name")


@query("select doc_id, source, n_chars from documents where lang = 'en' and n_chars between 500 and 2000 and source = 'src1' order by n_chars desc, doc_id limit 100")
def doc_bool_search(spark: SparkSession, d: str) -> DataFrame:
    c = (F.col("lang") == "en") & F.col("n_chars").between(500, 2000) & (F.col("source") == "src1")
    return filters.search(t(spark, d, "documents").select("doc_id", "source", "n_chars", "lang"), c, [F.desc("n_chars"), F.asc("doc_id")], 500).drop("lang")


@query("""select l_orderkey, o_orderdate, p_name, l_quantity, l_extendedprice * (1 - l_discount) as line_total
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""")
def order_detail(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = t(spark, d, "lineitem")
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return lines.join(orders, "l_orderkey").join(part, "l_partkey").select("l_orderkey", "o_orderdate", "p_name", "l_quantity", line_total().alias("line_total"))


@query("""select c_custkey, c_name || ' <' || c_mktsegment || '>' as label, count(*) as n_orders, sum(o_totalprice::decimal(18,2))::double as lifetime
from customer join orders on c_custkey = o_custkey group by all""")
def customer_lifetime(spark: SparkSession, d: str) -> DataFrame:
    sums = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), money("o_totalprice").alias("lifetime"))
    return t(spark, d, "customer").join(sums, "c_custkey").select("c_custkey", F.concat("c_name", F.lit(" <"), "c_mktsegment", F.lit(">")).alias("label"), "n_orders", "lifetime")


@query("""select p_partkey, coalesce(sum(case when l_returnflag = 'R' then l_quantity else -l_quantity end::decimal(18,2)), 0)::double as net, count(l_partkey) as n_moves
from part left join lineitem on p_partkey = l_partkey and p_size < 40 group by p_partkey""")
def stock_position(spark: SparkSession, d: str) -> DataFrame:
    """Parts of size 40 or more are kept elsewhere: they have a row and no moves."""
    moves = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("_key")).agg(money(stock_delta()).alias("net"), F.count(F.lit(1)).alias("n_moves"))
    return t(spark, d, "part").select("p_partkey", "p_size").join(moves, (F.col("p_partkey") == F.col("_key")) & (F.col("p_size") < 40), "left").select("p_partkey", F.coalesce("net", F.lit(0.0)).alias("net"), F.coalesce("n_moves", F.lit(0)).cast("long").alias("n_moves"))


@query("""select c_custkey, max(o_orderdate) as last_order, date_diff('day', max(o_orderdate)::date, date '2001-08-02') as days_dormant
from customer left join (select * from orders where o_orderdate >= timestamp '2001-01-01') on c_custkey = o_custkey
group by c_custkey having max(o_orderdate) is null or date_diff('day', max(o_orderdate)::date, date '2001-08-02') > 120""")
def dormant_customers(spark: SparkSession, d: str) -> DataFrame:
    last = t(spark, d, "orders").where(F.col("o_orderdate") >= day("2001-01-01")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"))
    joined = t(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left").withColumn("days_dormant", F.datediff(F.lit(AS_OF).cast("date"), F.col("last_order").cast("date")).cast("long"))
    return joined.where("last_order is null or days_dormant > 120").orderBy(F.asc_nulls_first("last_order"), "c_custkey")


@query("""select c_mktsegment, event_type, count(*) as n_events from events join customer on user_id = c_custkey group by all""")
def federated_join(spark: SparkSession, d: str) -> DataFrame:
    per_user = t(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per_user.join(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").groupBy("c_mktsegment", "event_type").agg(F.sum("n").alias("n_events"))


@query("""select c_custkey, count(o_orderkey) as n_orders, coalesce(sum(o_totalprice::decimal(18,2)), 0)::double as total, max(o_totalprice) as largest
from customer left join orders on c_custkey = o_custkey group by c_custkey""")
def lookup_array(spark: SparkSession, d: str) -> DataFrame:
    # an array per customer: bounded by one customer's orders
    arrays = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))).alias("orders"))
    zero = F.lit(0).cast("decimal(18,2)")
    total = F.aggregate(F.col("orders.price"), zero, lambda a, x: (a + x).cast("decimal(18,2)"))
    joined = t(spark, d, "customer").select("c_custkey").join(arrays, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce(F.size("orders"), F.lit(0)).cast("long").alias("n_orders"), F.coalesce(total, zero).cast("double").alias("total"), F.array_max("orders.price").cast("double").alias("largest"))


TOP = "select l_partkey as p_partkey, sum((l_extendedprice * (1 - l_discount))::decimal(18,4))::double as revenue from lineitem group by l_partkey order by revenue desc, p_partkey limit 10"


def best_parts(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    sums = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(money(line_total(), 4).alias("revenue"))
    return sums.orderBy(F.desc("revenue"), "p_partkey").limit(n)


@query(f"select p_partkey, p_name, split_part(p_type, ' ', 1) as first_word, revenue from ({TOP}) join part using (p_partkey)")
def topk_then_lookup(spark: SparkSession, d: str) -> DataFrame:
    best = best_parts(spark, d)  # ten rows, so the other side need not be shuffled
    return t(spark, d, "part").join(F.broadcast(best), "p_partkey").select("p_partkey", "p_name", F.element_at(F.split("p_type", " "), 1).alias("first_word"), "revenue")


@query(TOP)
def top_products(spark: SparkSession, d: str) -> DataFrame:
    return best_parts(spark, d)


REVIEWS = "(select event_id as review_id, user_id as p_partkey, event_id % 5 + 1 as rating, value as helpful from events)"


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("event_id").alias("review_id"), F.col("user_id").alias("p_partkey"), (F.col("event_id") % 5 + 1).alias("rating"), F.col("value").alias("helpful"))


@query(f"select p_brand, count(*) as n_reviews, sum(rating)::double / count(*) as avg_rating, count(*) filter (rating >= 4) * 100.0::double / count(*) as pct_good from {REVIEWS} join part using (p_partkey) group by p_brand")
def rating_by_category(spark: SparkSession, d: str) -> DataFrame:
    joined = reviews(spark, d).join(t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    n = F.count(F.lit(1))
    return joined.groupBy("p_brand").agg(n.alias("n_reviews"), (F.sum("rating").cast("double") / n).alias("avg_rating"), (F.count_if(F.col("rating") >= 4) * F.lit(100.0) / n).alias("pct_good"))


@query(f"select p_partkey, count(*) as n_reviews, count(*) filter (rating = 5) as n_five, sum(rating)::double / count(*) as avg_rating from {REVIEWS} group by p_partkey having count(*) >= 30 order by avg_rating desc, n_reviews desc, p_partkey")
def product_reviews(spark: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1))
    counts = reviews(spark, d).groupBy("p_partkey").agg(n.alias("n_reviews"), F.count_if(F.col("rating") == 5).alias("n_five"), (F.sum("rating").cast("double") / n).alias("avg_rating"))
    return counts.where("n_reviews >= 30").orderBy(F.desc("avg_rating"), F.desc("n_reviews"), "p_partkey")


@query("""select l_suppkey, sum(case when l_returnflag = 'R' then l_quantity else 0 end::decimal(18,2))::double as qty_in, sum(case when l_returnflag <> 'R' then l_quantity else 0 end::decimal(18,2))::double as qty_out, count(*) as n_moves
from lineitem where l_shipdate >= timestamp '2000-01-01' group by l_suppkey""")
def warehouse_activity(spark: SparkSession, d: str) -> DataFrame:
    back = F.col("l_returnflag") == "R"
    rows = t(spark, d, "lineitem").where(F.col("l_shipdate") >= day("2000-01-01"))
    return rows.groupBy("l_suppkey").agg(money(F.when(back, F.col("l_quantity")).otherwise(0.0)).alias("qty_in"), money(F.when(~back, F.col("l_quantity")).otherwise(0.0)).alias("qty_out"), F.count(F.lit(1)).alias("n_moves"))


@query("""select c_mktsegment, count(distinct c_custkey) as n_customers, count(*) as n_orders, sum(o_totalprice::decimal(18,2))::double / count(*) as avg_order
from customer join orders on c_custkey = o_custkey group by c_mktsegment""")
def tier_summary(spark: SparkSession, d: str) -> DataFrame:
    per = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    joined = t(spark, d, "customer").select("c_custkey", "c_mktsegment").join(per, "c_custkey")
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_customers"), F.sum("n").alias("n_orders"), (F.sum("s").cast("double") / F.sum("n")).alias("avg_order"))


@query("select c_mktsegment, count(*) as n_customers, count(distinct c_nationkey) as n_nations from customer group by c_mktsegment")
def tier_distribution(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_customers"), F.size(F.collect_set("c_nationkey")).cast("long").alias("n_nations"))


@query("""select l_partkey, sum(case when l_returnflag = 'R' then q else 0 end)::double as q_r, sum(case when l_returnflag = 'A' then q else 0 end)::double as q_a, sum(case when l_returnflag = 'N' then q else 0 end)::double as q_n, sum(q)::double as q_all
from (select l_partkey, l_returnflag, sum(l_quantity::decimal(18,2)) as q from lineitem group by all) group by l_partkey order by q_all, l_partkey limit 20""")
def inventory_two_level(spark: SparkSession, d: str) -> DataFrame:
    first = t(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    of = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("q")).otherwise(0)).cast("double")
    return first.groupBy("l_partkey").agg(of("R").alias("q_r"), of("A").alias("q_a"), of("N").alias("q_n"), F.sum("q").cast("double").alias("q_all")).orderBy("q_all", "l_partkey").limit(20)


@query("select count(*) as n_orders, sum(o_totalprice::decimal(18,2))::double as total, min(o_orderdate) as first_order, max(o_orderdate) as last_order from orders")
def global_stats(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_orders"), money("o_totalprice").alias("total"), F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))


@query("select r_name, string_agg(n_name, ',' order by n_nationkey) as nations from region join nation on r_regionkey = n_regionkey group by r_name")
def listagg_ordered(spark: SparkSession, d: str) -> DataFrame:
    nations = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    return t(spark, d, "region").join(nations, "r_regionkey").select("r_name", F.array_join("n.n_name", ",").alias("nations"))


@query(f"select rating, count(*) as n_reviews, sum(helpful::decimal(18,2))::double / count(*) as avg_helpful from {REVIEWS} group by rating")
def rating_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).groupBy("rating").agg(F.count(F.lit(1)).alias("n_reviews"), (money("helpful") / F.count(F.lit(1))).alias("avg_helpful"))


@query("""select o_custkey, p_brand, sum((l_extendedprice * (1 - l_discount))::decimal(18,4))::double as spend
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by all""")
def spend_by_category(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return t(spark, d, "lineitem").join(orders, "l_orderkey").join(part, "l_partkey").groupBy("o_custkey", "p_brand").agg(money(line_total(), 4).alias("spend"))


@query("select p_name, count(l_orderkey) as n_orders from part left join (select * from lineitem where l_quantity >= 45) on p_partkey = l_partkey group by p_name")
def product_order_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = t(spark, d, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("l_orderkey").alias("n"))
    return t(spark, d, "part").select("p_partkey", "p_name").join(counts, "p_partkey", "left").groupBy("p_name").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_orders"))


@query("select count(*) filter (event_type = 'click') as n_hits, count(*) as n_all, count(*) filter (event_type = 'click')::double / nullif(count(*), 0) as ratio from events")
def hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    hits, n = F.count_if(F.col("event_type") == "click"), F.count(F.lit(1))
    return t(spark, d, "events").agg(hits.alias("n_hits"), n.alias("n_all"), (hits.cast("double") / F.nullif(n, F.lit(0))).alias("ratio"))


@query("select o_orderstatus as state, count(*) as n from orders group by o_orderstatus")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, sum(v)::double as total, sum(n) as n from (select user_id, value::decimal(18,2) as v, 1 as n from events where event_id % 2 = 0 union all select user_id, value::decimal(18,2), 1 from events where event_id % 2 = 1) group by user_id")
def aggregate_key_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").select("user_id", F.col("value").cast("decimal(18,2)").alias("v"), F.lit(1).alias("n"), "event_id")
    part = lambda i: rows.where(F.col("event_id") % 2 == i).groupBy("user_id").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return part(0).unionByName(part(1)).groupBy("user_id").agg(F.sum("v").cast("double").alias("total"), F.sum("n").alias("n"))


@query("""select o_orderkey, lpad(o_orderkey::varchar, 9, '0') as padded, rpad(o_orderstatus, 3, '-') as padded_right, upper(o_orderpriority) as up, lower(o_orderpriority) as low, split_part(o_orderpriority, '-', 2) as word, regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') as letters,
o_orderkey % 7 as m, abs(o_totalprice - 200000) as dist, coalesce(nullif(o_orderstatus, 'F'), 'done') as status, case when o_totalprice > 250000 then 'high' else 'low' end as size_class, sha256(o_orderkey::varchar || '|' || o_orderstatus) as digest, date_diff('day', o_orderdate::date, date '2001-08-02') as age from orders""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return t(spark, d, "orders").select(
        "o_orderkey", F.lpad(key, 9, "0").alias("padded"), F.rpad("o_orderstatus", 3, "-").alias("padded_right"), F.upper("o_orderpriority").alias("up"), F.lower("o_orderpriority").alias("low"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("word"),
        F.regexp_replace("o_orderpriority", "[^A-Z]", "").alias("letters"), (F.col("o_orderkey") % 7).alias("m"), F.abs(F.col("o_totalprice") - 200000).alias("dist"), F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("done")).alias("status"),
        F.when(F.col("o_totalprice") > 250000, "high").otherwise("low").alias("size_class"), F.sha2(F.concat_ws("|", key, "o_orderstatus"), 256).alias("digest"), F.datediff(F.lit(AS_OF).cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("age"),
    )
