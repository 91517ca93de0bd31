"""Data-quality audits, reconciliation and differences between tables. One pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column_name, n_null)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns])).alias("r")).select("r.*")


def accepted_range(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Rows (column_name, n_bad): values outside [low, high]; None leaves a side open."""
    def bad(c: str, low, high):
        out = F.lit(False)
        if low is not None:
            out = out | (F.col(c) < low)
        return out | (F.col(c) > high) if high is not None else out

    counts = df.agg(*[F.count_if(bad(c, *r)).alias(c) for c, r in ranges.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_bad")) for c in ranges])).alias("r")).select("r.*")


def duplicates(df: DataFrame, grain: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def uniqueness(df: DataFrame, grain: list[str]) -> DataFrame:
    """One row (n_rows, n_keys, n_duplicated)."""
    keys = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("c"))
    return keys.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("c") > 1).alias("n_duplicated"))


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Child rows whose foreign key is not null and has no parent."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def reconcile(source: DataFrame, target: DataFrame, logged: DataFrame, by: str) -> DataFrame:
    """Rows (by, source_rows, target_rows, logged_rows, matches)."""
    counts = source.groupBy(by).agg(F.count(F.lit(1)).alias("source_rows")).join(target.groupBy(by).agg(F.count(F.lit(1)).alias("target_rows")), by, "full_outer").join(logged, by, "full_outer")
    filled = counts.select(by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("source_rows", "target_rows", "logged_rows")])
    return filled.withColumn("matches", (F.col("source_rows") == F.col("target_rows")) & (F.col("target_rows") == F.col("logged_rows")))


def fingerprint(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A fingerprint of the rows (of each group) that doesn't depend on their order: (.. by, n_rows, sum_1, sum_2).

    The sums of two 64-bit hashes of all columns, as whole numbers: a changed, lost or doubled row changes them but for a chance of about 2^-128.
    """
    columns = sorted(columns or df.columns)
    # a null moves no hash on by itself, so which ones are null is hashed too
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    hashes = [F.sum(F.xxhash64(F.lit(salt), nulls, *columns).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"sum_{salt}") for salt in (1, 2)]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_rows"), *hashes)


def same_rows(one: DataFrame, two: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often, by their fingerprints."""
    columns = one.columns
    return fingerprint(one, columns=columns).first() == fingerprint(two, columns=columns).first()


def reconcile_rows(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Rows (.. by, source_rows, target_rows, same_rows): of each group whether both sides hold the same rows. by may be null."""
    columns = source.columns
    one = fingerprint(source, by, columns).select(*by, F.struct("n_rows", "sum_1", "sum_2").alias("_f"), F.lit(1).alias("_side"))
    two = fingerprint(target, by, columns).select(*by, F.struct("n_rows", "sum_1", "sum_2").alias("_f"), F.lit(2).alias("_side"))
    side = lambda n: F.max(F.when(F.col("_side") == n, F.col("_f")))
    both = one.unionByName(two).groupBy(*by).agg(side(1).alias("_s"), side(2).alias("_t"))
    rows = lambda c: F.coalesce(F.col(c)["n_rows"], F.lit(0)).cast("long")
    return both.select(*by, rows("_s").alias("source_rows"), rows("_t").alias("target_rows"), F.col("_s").eqNullSafe(F.col("_t")).alias("same_rows"))


def table_diff(old: DataFrame, new: DataFrame, grain: list[str]) -> DataFrame:
    """Rows (.. grain, change) for keys added, removed or changed; rows are compared value by value, nulls as equal."""
    rest = [c for c in old.columns if c not in grain]
    both = old.select(*grain, F.struct(*rest).alias("o")).join(new.select(*grain, F.struct(*rest).alias("n")), grain, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*grain, "change")
