"""Access control as tables: effective permissions, fingerprints, drift, grants, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.session import few, small

#: About so many permissions, before repeats are taken out, are worked on by one task at a time.
ROWS_AT_ONCE = 500_000


def effective(bindings: DataFrame, role_perms: DataFrame, at: Column) -> DataFrame:
    """Rows (user_id, service_id, permission, binding_id): what each user may do per service.

    bindings: (binding_id, user_id, role_id, service_id or null for all, expires_at or null); role_perms: (role_id,
    service_id, permission). An expired binding counts for nothing; of several the smallest binding id stands.
    """
    valid = bindings.where(F.col("expires_at").isNull() | (F.col("expires_at") > at)).select("binding_id", "user_id", "role_id", F.col("service_id").alias("bound"))
    meets = F.col("bound").isNull() | (F.col("bound") == F.col("service_id"))
    # what the bindings grow to: a number per role and service
    groups = valid.groupBy("role_id", "bound").agg(F.count(F.lit(1)).alias("_n"))
    fit = few(role_perms)
    perms = F.broadcast(role_perms) if fit else role_perms
    grown = groups.join(perms, "role_id").where(meets).agg(F.sum("_n")).first()[0] or 0
    tasks = -(-grown // ROWS_AT_ONCE) or 1
    # rows of one user stay together in what follows
    if fit:
        # users are dealt out before their bindings grow, so the grown rows aren't shuffled
        joined = valid.repartition(tasks, "user_id").join(perms, "role_id").where(meets)
    else:
        # the join deals bindings out by role, so users are dealt out after it
        joined = valid.join(perms, "role_id").where(meets).repartition(tasks, "user_id")
    return joined.groupBy("user_id", "service_id", "permission").agg(F.min("binding_id").alias("binding_id"))


def fingerprint(perms: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of each key's sorted permissions, joined by commas."""
    return perms.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("permission")), ","), 256).alias("fingerprint"), F.count_distinct("permission").alias("n_perms"))


def sync_plan(wanted: DataFrame, state: DataFrame, adapters: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: skipped where the stored fingerprint is equal, else how many permissions would be applied; an error without an adapter."""
    joined = wanted.join(state.select(*keys, F.col("fingerprint").alias("stored")), keys, "left").join(adapters.select("service_id", F.lit(True).alias("has_adapter")), "service_id", "left")
    status = F.when(F.col("has_adapter").isNull(), "error").when(F.col("stored") == F.col("fingerprint"), "skipped").otherwise("would_apply")
    return joined.select(*keys, status.alias("status"), F.when(status == "would_apply", F.col("n_perms")).otherwise(0).cast("long").alias("n_apply"))


def bulk_bind(requests: DataFrame, users: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each requested (user_id, role_id): user_not_found, already_exists or bound."""
    joined = requests.join(users.select("user_id", F.lit(True).alias("_u")), "user_id", "left").join(bindings.select("user_id", "role_id", F.lit(True).alias("_b")).distinct(), ["user_id", "role_id"], "left")
    return joined.select("user_id", "role_id", F.when(F.col("_u").isNull(), "user_not_found").when(F.col("_b").isNotNull(), "already_exists").otherwise("bound").alias("result"))


def bind_totals(results: DataFrame) -> DataFrame:
    """Rows (role_id, result, n) of bulk_bind's results, with totals by role (result null) and over all (both null)."""
    return results.groupBy("role_id", "result").agg(F.count(F.lit(1)).alias("_n")).rollup("role_id", "result").agg(F.sum("_n").alias("n"))


def allow_list(perms: DataFrame, names: list[str]) -> DataFrame:
    """One boolean per permission and user; users with none of them are left out."""
    wide = perms.groupBy("user_id").agg(*[F.max(F.col("permission") == n).alias(f"can_{n.lower()}") for n in names])
    return wide.where(F.greatest(*[F.col(f"can_{n.lower()}").cast("int") for n in names]) == 1)


def grants(perms: DataFrame, mapping: DataFrame, resource: str) -> DataFrame:
    """Per user and resource the engine's privileges, sorted and joined; permissions without one are dropped."""
    return perms.join(small(mapping), "permission").groupBy("user_id", resource).agg(F.array_join(F.array_sort(F.collect_set("privilege")), ",").alias("privileges"))


def rules(perms: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Each permission's rules (operations on a resource), without repeats."""
    found = F.array().cast("array<string>")
    for name, ops in mapping.items():
        found = F.when(F.col("permission") == name, F.array(*map(F.lit, ops))).otherwise(found)
    return perms.withColumn("operation", F.explode(found)).drop("permission").dropDuplicates()


def role_name(permission: Column, resource: Column) -> Column:
    """A name of lower-case letters, digits and underscores."""
    return F.concat(F.lower(permission), F.lit("_"), F.regexp_replace(F.lower(resource), "[^a-z0-9]+", "_"))
