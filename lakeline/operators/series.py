"""Metric samples (metric, labels, ts, value): instant and range vectors, rates, prediction, ratios; as-of joins."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_key(labels: str = "labels") -> Column:
    """A map of labels as something that can be compared and grouped by: its sorted entries."""
    return F.array_sort(F.map_entries(F.col(labels)))


def instant(samples: DataFrame, at: Column, series: list[str], order: list[str] | None = None) -> DataFrame:
    """Last sample up to a time, per series; of samples of one time the last by order (columns), or the largest value."""
    last = F.max_by("value", F.struct("ts", *(order or ["value"])))
    return samples.where(F.col("ts") <= at).groupBy(*series).agg(F.max("ts").alias("ts"), last.alias("value"))


def before_blocks(rows: DataFrame, series: list[str], order: list[str], value: str) -> DataFrame:
    """Rows (.. series, _block, _carried): the last value of a series before each of its blocks, nulls passed over.

    Only one row per series and block is in this window, whatever the number of samples.
    """
    ends = rows.groupBy(*series, "_block").agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(*series).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*series, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))


def null_safe(one: DataFrame, two: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of which null equals null; the left side's columns stay."""
    named = two.withColumnsRenamed({c: f"_on{i}" for i, c in enumerate(on)})
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)])
    return one.join(named, same, how).drop(*[f"_on{i}" for i in range(len(on))])


def with_carried(rows: DataFrame, series: list[str], carried: DataFrame) -> DataFrame:
    """rows with `_carried`; a missing label is a label like others."""
    return null_safe(rows, carried, [*series, "_block"])


def on_grid(samples: DataFrame, start: Column, stop: Column, step_seconds: int, series: list[str]) -> DataFrame:
    """For each series and step the last value at or before it (none before a series begins).

    A series is worked on in blocks of a day; the value before a block is carried over.
    """
    grid = samples.select(*series).distinct().withColumn("ts", F.explode(F.sequence(start, stop, F.make_dt_interval(secs=F.lit(step_seconds)))))
    both = samples.where(F.col("ts") <= stop).select(*series, "ts", "value", F.lit(0).alias("_g")).unionByName(grid.select(*series, "ts", F.lit(None).cast("double").alias("value"), F.lit(1).alias("_g")))
    both = both.withColumn("_block", F.to_date("ts"))
    # samples come before a step of the same time
    seen = Window.partitionBy(*series, "_block").orderBy("ts", "_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("value", F.last("value", ignorenulls=True).over(seen)).where("_g = 1")
    filled = with_carried(inside, series, before_blocks(both, series, ["ts"], "value"))
    return filled.withColumn("value", F.coalesce("value", "_carried")).where("value is not null").drop("_g", "_block", "_carried")


def increase(samples: DataFrame, series: list[str], order: list[str], period: list[Column], block: Column | None = None) -> DataFrame:
    """Counter increase per series and period: differences of neighbours, a fall counts as a restart from zero; null values are left out.

    block: a column that rises with the order (such as the day) and cuts a series into pieces that are worked on side by
    side; the value before a piece is carried over.
    """
    rows = samples.where("value is not null").withColumn("_block", block if block is not None else F.lit(0))
    inner = rows.withColumn("_lag", F.lag("value").over(Window.partitionBy(*series, "_block").orderBy(*order)))
    before = F.coalesce("_lag", "_carried")
    delta = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    both = with_carried(inner, series, before_blocks(rows, series, order, "value"))
    return both.withColumn("_d", delta).groupBy(*series, *period).agg(F.sum(F.col("_d").cast("decimal(28,4)")).cast("double").alias("increase"))


def predict(samples: DataFrame, series: list[str], seconds: Column, ahead: int, scale: int = 2) -> DataFrame:
    """Least-squares line through a series' samples, read `ahead` seconds after its last one.

    seconds are whole, values count to so many decimals: all sums are exact, so their order doesn't matter.
    """
    exact = lambda c: F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)")
    rows = samples.where("value is not null").withColumns({"_x": seconds.cast("long"), "_y": (F.col("value").cast(f"decimal(18,{scale})") * 10**scale).cast("long")})
    sums = rows.groupBy(*series).agg(F.count(F.lit(1)).cast("decimal(18,0)").alias("n"), exact(F.col("_x")).alias("sx"), exact(F.col("_y")).alias("sy"), exact(F.col("_x") * F.col("_x")).alias("sxx"), exact(F.col("_x") * F.col("_y")).alias("sxy"), F.max("_x").alias("last_x"))
    slope = F.expr("cast(n * sxy - sx * sy as double)") / F.nullif(F.expr("cast(n * sxx - sx * sx as double)"), F.lit(0.0))
    distance = (F.col("n") * (F.col("last_x") + ahead).cast("decimal(18,0)") - F.col("sx")).cast("double")
    return sums.withColumn("predicted", (F.col("sy").cast("double") + slope * distance) / F.col("n").cast("double") / 10**scale).drop("sx", "sy", "sxx", "sxy")


def ratio(top: DataFrame, bottom: DataFrame, on: list[str]) -> DataFrame:
    """Quotient of two vectors, joined on all labels (null equals null); null where the lower one is zero."""
    return null_safe(top.select(*on, F.col("value").alias("_t")), bottom.select(*on, F.col("value").alias("_b")), on).select(*on, (F.col("_t") / F.nullif(F.col("_b"), F.lit(0.0))).alias("ratio"))


#: Points that are held as lists beside every log row; more of them are found by sorting, with the same result.
FEW_POINTS = 64


def asof_forward(points: DataFrame, log: DataFrame, by: list[str], at: str, ts: str, number: str, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each point the lowest number of the log whose time is at or after the point's; points that are there twice are found twice.

    The lowest number at or after a time may have a later time than another: it is the least over all that follows. Few
    points (they are counted) stand as one sorted list per key beside each log row, which counts to the last point that it is not
    before; so least numbers are taken by point before any shuffle, and then over the points that follow. With more points
    all are sorted together by key and time, in blocks of a key's times (days, of numbers 86,400, or what `block` makes of a time: it
    must rise with it), so that a key with most of the log is no single task. Points without a key or time find nothing.
    """
    extra = [c for c in points.columns if c not in by]
    dated = points.schema[at].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
    block = block or (F.to_date if dated else lambda c: F.floor(c / 86_400))
    if points.limit(FEW_POINTS + 1).count() > FEW_POINTS:
        return asof_sorted(points, log, by, at, ts, number, extra, block)
    lists = points.groupBy(*by).agg(F.array_sort(F.collect_set(at)).alias("_at"))
    reached = log.select(*by, F.col(ts).alias("_t"), F.col(number).cast("long").alias("_n")).join(F.broadcast(lists), by)
    place = F.size(F.filter("_at", lambda x: x <= F.col("_t")))
    least = reached.withColumn("_place", place).where("_place > 0").groupBy(*by, "_place").agg(F.min("_n").alias("_n"))
    # no more rows than distinct points
    following = least.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_place", "_n"))).alias("_least"))
    held = points.join(F.broadcast(lists), by, "left").join(F.broadcast(following), by, "left").withColumn("_place", F.array_position("_at", F.col(at)))
    after = F.array_min(F.transform(F.filter("_least", lambda x: x["_place"] >= F.col("_place")), lambda x: x["_n"]))
    return held.select(*by, *extra, after.alias(number))


def asof_sorted(points: DataFrame, log: DataFrame, by: list[str], at: str, ts: str, number: str, extra: list[str], block: Callable[[Column], Column]) -> DataFrame:
    """asof_forward for many points: a running minimum from a block's last time to its first, and the least of the blocks after it."""
    p = points.select(*by, F.col(at).alias("_t"), F.lit(None).cast("long").alias("_n"), F.struct(*extra).alias("_p"))
    timed = log.select(*by, F.col(ts).alias("_t"), F.col(number).cast("long").alias("_n")).dropna(subset=[*by, "_t"])
    rows = p.unionByName(timed, allowMissingColumns=True).withColumn("_block", block(F.col("_t")))
    # a point comes after the log rows of its time
    falling = Window.partitionBy(*by, "_block").orderBy(F.desc("_t"), F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and block, whatever the number of log rows
    after = rows.groupBy(*by, "_block").agg(F.min("_n").alias("_least")).select(*by, "_block", F.min("_least").over(later).alias("_after"))
    found = rows.withColumn("_m", F.min("_n").over(falling)).where("_p is not null").join(after, [*by, "_block"], "left")
    return found.select(*by, *[F.col("_p")[c].alias(c) for c in extra], F.least("_m", "_after").alias(number))


def record(samples: DataFrame, labels: list[str], name: str, path: str, scale: float = 1.0) -> DataFrame:
    """A recording rule: the sums by labels and time, stored as samples of a new metric, each day's by itself (again: replaced)."""
    rows = samples.groupBy(*labels, "ts").agg((F.sum(F.col("value").cast("decimal(28,4)")).cast("double") * scale).alias("value")).withColumns({"metric": F.lit(name), "day": F.to_date("ts")})
    rows.hint("rebalance", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return samples.sparkSession.read.schema(rows.schema).parquet(path)
