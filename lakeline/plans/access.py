"""Access-control queries: users are customers, roles nations, services regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.operators import access, filters, schema
from lakeline.plans.registry import query
from lakeline.plans.retail import t
from lakeline.session import small

AT = "2024-03-01"
#: Permissions by remainder of supplier key; a role holds what its nation's suppliers stand for, on the nation's service.
PERMS = ("READ", "WRITE", "ADMIN", "CREATE", "DROP", "ALTER")
ROLE_PERMS = "(select distinct s_nationkey as role_id, (s_suppkey % 5)::int as service_id, ['READ','WRITE','ADMIN','CREATE','DROP','ALTER'][(s_suppkey % 6 + 1)::int] as permission from supplier)"
BINDINGS = """(select c_custkey as binding_id, c_custkey as user_id, c_nationkey as role_id, case when c_custkey % 4 <> 0 then (c_custkey % 5)::int end as service_id, case when c_custkey % 7 <> 0 then timestamp '2024-01-01' + interval (c_custkey % 7) month end as expires_at from customer
union all select c_custkey + 10000000, c_custkey, (c_nationkey + 1) % 25, (c_custkey % 3)::int, null from customer where c_custkey % 2 = 0)"""
EFFECTIVE = f"(select user_id, p.service_id, permission, min(binding_id) as binding_id from {BINDINGS} b join {ROLE_PERMS} p using (role_id) where (b.service_id is null or b.service_id = p.service_id) and (expires_at is null or expires_at > timestamp '{AT}') group by all)"


def role_perms(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, PERMS)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return t(spark, d, "supplier").select(F.col("s_nationkey").alias("role_id"), (F.col("s_suppkey") % 5).cast("int").alias("service_id"), name.alias("permission")).distinct()


def bindings(spark: SparkSession, d: str) -> DataFrame:
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    expiry = F.when(k % 7 != 0, (F.lit("2024-01-01").cast("timestamp") + F.make_interval(months=(k % 7).cast("int"))).cast("timestamp_ntz"))
    first = c.select(k.alias("binding_id"), k.alias("user_id"), F.col("c_nationkey").alias("role_id"), F.when(k % 4 != 0, (k % 5).cast("int")).alias("service_id"), expiry.alias("expires_at"))
    second = c.where(k % 2 == 0).select((k + 10_000_000).alias("binding_id"), k.alias("user_id"), ((F.col("c_nationkey") + 1) % 25).alias("role_id"), (k % 3).cast("int").alias("service_id"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    return first.unionByName(second)


def effective(spark: SparkSession, d: str) -> DataFrame:
    return access.effective(bindings(spark, d), role_perms(spark, d), F.lit(AT).cast("timestamp_ntz"))


@query(f"select * from {EFFECTIVE}")
def effective_perms(spark: SparkSession, d: str) -> DataFrame:
    return effective(spark, d)


PRINTS = f"(select user_id, service_id, sha256(string_agg(distinct permission, ',' order by permission)) as fingerprint, count(distinct permission) as n_perms from {EFFECTIVE} group by all)"


@query(f"select * from {PRINTS}")
def perm_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return access.fingerprint(effective(spark, d), ["user_id", "service_id"])


@query(f"""select user_id, service_id, case when service_id not in (select r_regionkey from region where r_regionkey < 4) then 'error' when user_id % 3 = 0 then 'skipped' else 'would_apply' end as status,
case when service_id < 4 and user_id % 3 <> 0 then n_perms else 0 end as n_apply from {PRINTS}""")
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    wanted = access.fingerprint(effective(spark, d), ["user_id", "service_id"])
    state = wanted.where("user_id % 3 = 0").select("user_id", "service_id", "fingerprint").unionByName(wanted.where("user_id % 3 = 1").select("user_id", "service_id", F.lit("old").alias("fingerprint")))
    adapters = t(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("service_id"))
    return access.sync_plan(wanted, state, adapters, ["user_id", "service_id"])


BOUND = """select user_id, role_id, case when user_id not in (select c_custkey from customer) then 'user_not_found' when exists (select 1 from customer where c_custkey = r.user_id and (c_nationkey = r.role_id)) then 'already_exists' else 'bound' end as result
from (select distinct o_custkey * (case when o_orderkey % 50 = 0 then 1000000 else 1 end) as user_id, (o_orderkey % 25)::int as role_id from orders) r"""


@query(BOUND)
def bulk_bind(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    requests = t(spark, d, "orders").select((F.col("o_custkey") * F.when(key % 50 == 0, 1_000_000).otherwise(1)).alias("user_id"), (key % 25).cast("int").alias("role_id")).distinct()
    c = t(spark, d, "customer")
    return access.bulk_bind(requests, c.select(F.col("c_custkey").alias("user_id")), c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role_id")))


@query(f"select role_id, result, count(*) as n from ({BOUND}) group by rollup (role_id, result)")
def bulk_bind_totals(spark: SparkSession, d: str) -> DataFrame:
    return access.bind_totals(bulk_bind(spark, d))


WIDE = ", ".join(f"bool_or(permission = '{p}') as can_{p.lower()}" for p in PERMS)


@query(f"select user_id, {WIDE} from {EFFECTIVE} group by user_id")
def allowlist_pivot(spark: SparkSession, d: str) -> DataFrame:
    return access.allow_list(effective(spark, d), list(PERMS))


@query(f"""select user_id, service_id, string_agg(distinct case permission when 'READ' then 'Select_priv' when 'WRITE' then 'Load_priv' when 'CREATE' then 'Create_priv' when 'ALTER' then 'Create_priv' when 'DROP' then 'Drop_priv' end, ',' order by case permission when 'READ' then 'Select_priv' when 'WRITE' then 'Load_priv' when 'CREATE' then 'Create_priv' when 'ALTER' then 'Create_priv' when 'DROP' then 'Drop_priv' end) as privileges
from {EFFECTIVE} where permission <> 'ADMIN' group by all""")
def grant_rollup(spark: SparkSession, d: str) -> DataFrame:
    pairs = [("READ", "Select_priv"), ("WRITE", "Load_priv"), ("CREATE", "Create_priv"), ("ALTER", "Create_priv"), ("DROP", "Drop_priv")]
    return access.grants(effective(spark, d), spark.createDataFrame(pairs, "permission string, privilege string"), "service_id")


@query(f"""select distinct user_id, service_id, operation from (select user_id, service_id, unnest(case permission when 'READ' then ['READ','DESCRIBE'] when 'WRITE' then ['WRITE','DESCRIBE'] when 'ADMIN' then ['ALTER','CREATE','DELETE'] else [] end) as operation from {EFFECTIVE})""")
def acl_expand(spark: SparkSession, d: str) -> DataFrame:
    return access.rules(effective(spark, d).drop("binding_id"), {"READ": ["READ", "DESCRIBE"], "WRITE": ["WRITE", "DESCRIBE"], "ADMIN": ["ALTER", "CREATE", "DELETE"]})


@query("select distinct lower(event_type) || '_' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') as role_name from events join part on user_id = p_partkey")
def role_names(spark: SparkSession, d: str) -> DataFrame:
    joined = t(spark, d, "events").select("event_type", F.col("user_id").alias("p_partkey")).distinct().join(t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return joined.select(access.role_name(F.col("event_type"), F.col("p_brand")).alias("role_name")).distinct()


@query(f"select role_id, service_id, string_agg(permission, ',' order by permission) as permissions, count(*) as n_perms from {ROLE_PERMS} group by all")
def role_nested(spark: SparkSession, d: str) -> DataFrame:
    return role_perms(spark, d).groupBy("role_id", "service_id").agg(F.array_join(F.array_sort(F.collect_list("permission")), ",").alias("permissions"), F.count(F.lit(1)).alias("n_perms"))


@query(f"select n_nationkey as role_id, count(permission) as n_perms from nation left join {ROLE_PERMS} on role_id = n_nationkey group by n_nationkey")
def role_perm_counts(spark: SparkSession, d: str) -> DataFrame:
    roles = t(spark, d, "nation").select(F.col("n_nationkey").alias("role_id"))
    return roles.join(role_perms(spark, d), "role_id", "left").groupBy("role_id").agg(F.count("permission").alias("n_perms"))


@query(f"select n_nationkey as role_id, r_regionkey as service_id from nation, region where n_nationkey % 5 <= r_regionkey except select role_id, service_id from {ROLE_PERMS} where permission = 'READ'")
def missing_perms(spark: SparkSession, d: str) -> DataFrame:
    # roles by services: both are dimension tables of tens of rows
    wanted = t(spark, d, "nation").select(F.col("n_nationkey").alias("role_id")).join(F.broadcast(t(spark, d, "region").select(F.col("r_regionkey").alias("service_id"))), F.col("role_id") % 5 <= F.col("service_id"))
    return wanted.join(role_perms(spark, d).where("permission = 'READ'"), ["role_id", "service_id"], "left_anti").distinct()


@query("select c_custkey as user_id, r_regionkey as service_id from customer, region where c_acctbal > 0 and (c_custkey + r_regionkey) % 2 = 0")
def user_service_grid(spark: SparkSession, d: str) -> DataFrame:
    # every user by the services: a dimension table of five rows
    services = F.broadcast(t(spark, d, "region").select(F.col("r_regionkey").alias("service_id")))
    return t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")).join(services, (F.col("user_id") + F.col("service_id")) % 2 == 0)


@query("""select distinct scope, p_name from (select distinct case when p_partkey % 2 = 0 then substr(p_name, 1, 6) || '*' else p_name end as scope from part) s join part p on
case when scope like '%*' then starts_with(p_name, rtrim(scope, '*')) else p_name = scope end""")
def scope_match(spark: SparkSession, d: str) -> DataFrame:
    part = t(spark, d, "part").select("p_partkey", "p_name")
    scopes = part.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.substring("p_name", 1, 6), F.lit("*"))).otherwise(F.col("p_name")).alias("scope")).distinct()
    # prefixes of one length meet on that prefix, names on themselves: two equi-joins in place of a theta join
    wild, exact = scopes.where(F.col("scope").endswith("*")), scopes.where(~F.col("scope").endswith("*"))
    keyed = wild.withColumn("prefix", F.expr("rtrim('*', scope)")).withColumn("n", F.length("prefix"))
    lengths = keyed.select("n").distinct()
    names = part.select("p_name").distinct().join(small(lengths), F.length("p_name") >= F.col("n")).withColumn("prefix", F.expr("substring(p_name, 1, n)"))
    by_prefix = keyed.join(names, ["prefix", "n"]).select("scope", "p_name")
    by_name = exact.join(part.select("p_name").distinct(), F.col("scope") == F.col("p_name")).select("scope", "p_name")
    return by_prefix.unionByName(by_name).where(filters.scope_matches(F.col("scope"), F.col("p_name"))).distinct()


@query("""select slug, split_part(slug, ':', 1) as service, split_part(slug, ':', 2) as permission from (select distinct case when event_id % 3 = 0 then event_type when event_id % 3 = 1 then event_type || ':' else event_type || ':P' || (event_id % 5) end as slug from events) where slug like '%_:_%'""")
def perm_slug(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("event_id") % 3
    slug = F.when(third == 0, F.col("event_type")).when(third == 1, F.concat("event_type", F.lit(":"))).otherwise(F.concat("event_type", F.lit(":P"), (F.col("event_id") % 5).cast("string")))
    return filters.split_slug(t(spark, d, "events").select(slug.alias("slug")).distinct(), "slug")


@query("select c_custkey, c_name, c_mktsegment from customer")
def governed_select(spark: SparkSession, d: str) -> DataFrame:
    return schema.governed_select(t(spark, d, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"], ["c_custkey", "c_name", "c_mktsegment"])


@query("select event_id, ts, user_id as actor, event_type as action from events where event_type = 'click' and ts >= timestamp '2024-01-10' order by ts desc, event_id limit 100 offset 50")
def audit_page(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("actor"), F.col("event_type").alias("action"))
    c = (F.col("action") == "click") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return filters.page(rows, c, [F.desc("ts"), F.asc("event_id")], 100, 50)
