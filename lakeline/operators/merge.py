"""Keyed tables from changes: upsert, delete, replay-safe merge."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of changes with one sequence number, the later operation wins.
OP_ORDER = {"r": 0, "c": 1, "u": 2, "d": 3}


def op_order(op: Column) -> Column:
    found = F.lit(-1)
    for name, n in OP_ORDER.items():
        found = F.when(op == name, n).otherwise(found)
    return found


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the one whose order is largest. Aggregated on the map side, so a hot key costs no more than others."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def merge_upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes replace the target's rows of equal keys (null equals null), or are added. changes must have one row per key."""
    return null_safe(target, changes, keys, "left_anti").unionByName(changes.select(*target.columns))


def upsert_reset(target: DataFrame, changes: DataFrame, keys: list[str], reset: list[str]) -> DataFrame:
    """merge_upsert for which the columns in reset become null on every changed row."""
    types = dict(target.dtypes)
    return merge_upsert(target, changes.withColumns({c: F.lit(None).cast(types[c]) for c in reset}), keys)


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], seq: str = "_seq", op: str = "op") -> DataFrame:
    """target: keys, values, _seq, _deleted; changes: the same values with seq and op.

    The larger sequence number wins, at a tie the later operation; deletes leave a tombstone, so that older changes which
    arrive late or twice don't bring a row back. Applying the same changes again changes nothing.
    """
    values = [c for c in target.columns if c not in (*keys, "_seq", "_deleted")]
    new = changes.select(*keys, *values, F.col(seq).alias("_seq"), (F.col(op) == "d").alias("_deleted"), op_order(F.col(op)).alias("_o"))
    old = target.withColumn("_o", F.lit(9))
    return latest(old.unionByName(new), keys, [F.col("_seq"), F.col("_o")]).drop("_o")


def empty_target(changes: DataFrame, keys: list[str], values: list[str], seq: str = "_seq") -> DataFrame:
    return changes.limit(0).select(*keys, *values, F.col(seq).alias("_seq"), F.lit(False).alias("_deleted"))


def live(target: DataFrame) -> DataFrame:
    """The rows of a merged table that are not deleted."""
    return target.where(~F.col("_deleted")).drop("_seq", "_deleted")


def compact_log(log: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Latest value per key; a null value deletes the key."""
    return latest(log, keys, order).where(F.col(value).isNotNull())


def delete_keys(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The target without the rows of these keys (null equals null)."""
    return null_safe(target, keys, on, "left_anti")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (a null condition deletes nothing)."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def null_safe(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A semi or anti join on keys of which null equals null."""
    named = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return rows.join(named, functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), how)
