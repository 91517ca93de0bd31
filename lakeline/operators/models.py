"""Incremental models over stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.operators.merge import latest, merge_upsert


def run_full(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def run_time_range(model: Callable[[DataFrame], DataFrame], source: DataFrame, ts: str, start: str, stop: str, path: str, day: Callable[[DataFrame], Column]) -> None:
    """Rebuilds the days from start to stop (not included) of a model's table and leaves the others as they are.

    model turns the source rows of the range into result rows; day gives a result row's date. Running it again replaces
    the same days by the same rows.
    """
    rows = source.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(stop).cast("timestamp_ntz")))
    result = model(rows)
    result.withColumn("model_day", day(result)).hint("rebalance", F.col("model_day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_day").parquet(path)


def backfill(model: Callable[[DataFrame], DataFrame], source: DataFrame, ts: str, ranges: list[tuple[str, str]], path: str, day: Callable[[DataFrame], Column]) -> None:
    """Ranges one after the other; neighbouring ones are joined into one job."""
    joined: list[list[str]] = []
    for start, stop in sorted(ranges):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], stop)
        else:
            joined.append([start, stop])
    for start, stop in joined:
        run_time_range(model, source, ts, start, stop, path, day)


def run_unique_key(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The target with the newest of rows per key merged in."""
    return merge_upsert(target, latest(rows, keys, order), keys)
