"""Approximate distinct counts from stored HyperLogLog sketches, which are merged without reading rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of a sketch's size (about 12 KB), and its relative standard error.
LG_K, ERROR = 14, 0.0083


def write(rows: DataFrame, by: list[Column], value: str, path: str) -> None:
    """Stores a sketch of the distinct values for each group; nulls don't count."""
    rows.groupBy(*by).agg(F.hll_sketch_agg(value, LG_K).alias("sketch")).write.mode("append").parquet(path)


def merged(sketches: DataFrame, by: list[Column]) -> DataFrame:
    """Rows (.. by, estimate): the number of distinct values of larger groups, such as days of hours."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
