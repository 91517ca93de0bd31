"""Fingerprints, histories, ranges, layouts, sizes, sketches, dual writes and record-limited streams."""

import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeline.operators import access, audits, history, series, sketches
from lakeline.session import scratch
from lakeline.sources import messages, tables
from lakeline.streaming import jobs


def test_fingerprint_sees_changed_lost_and_doubled_rows(spark):
    rows = [(i, f"v{i % 7}", None if i % 5 == 0 else i / 3) for i in range(200)]
    of = lambda r: spark.createDataFrame(r, "a long, b string, c double")
    assert audits.same_rows(of(rows), of(rows[::-1]).repartition(5))
    assert audits.same_rows(of([]), of([]))
    for other in ([*rows[:-1], (199, "v3", 1.0)], rows[:-1], [*rows, rows[3]], [*rows[1:], rows[5]], [(0, "v0", 0.0), *rows[1:]]):
        assert not audits.same_rows(of(rows), of(other))
    # a value that moves to another column
    assert not audits.same_rows(spark.createDataFrame([(1, None)], "a long, b long"), spark.createDataFrame([(None, 1)], "a long, b long"))
    found = audits.reconcile_rows(of(rows), of(rows[:-1]), ["b"]).collect()
    assert {r["b"]: r["same_rows"] for r in found} == {f"v{k}": k != 199 % 7 for k in range(7)}


def test_compaction_with_other_rows_is_an_error(spark, monkeypatch):
    path = scratch(spark, "rows")
    spark.range(100).write.parquet(path)
    stored = spark.read.parquet(path)
    assert history.compact(stored, ["id"], scratch(spark, "compacted")).count() == 100
    monkeypatch.setattr(history, "compacted", lambda df, *_: df.withColumn("id", F.when(F.col("id") == 7, 8).otherwise(F.col("id"))))
    with pytest.raises(RuntimeError, match="compacted"):
        history.compact(stored, ["id"], scratch(spark, "compacted"))


def test_compaction_sorts_in_small_runs(spark, monkeypatch):
    """Tasks sort no more than a part of a file; files are as large as asked for and in order all the same."""
    path = scratch(spark, "rows")
    rows = spark.range(0, 200_000, 1, 6).select(F.when(F.col("id") % 11 != 0, F.xxhash64("id") % 5000).alias("k"), "id", F.xxhash64("id").alias("x"))
    rows.write.parquet(path)
    stored = spark.read.parquet(path)
    total = stored.select("_metadata.file_size", "_metadata.file_name").distinct().agg(F.sum("file_size")).first()[0]
    for file_bytes, run_rows in ((total // 3, 2_000_000), (10 * total, 15_000)):
        monkeypatch.setattr(history, "RUN_ROWS", run_rows)
        runs = history.compacted(stored, ["k", "id"], file_bytes).groupBy(F.spark_partition_id()).count().collect()
        assert len(runs) >= 12 and max(r["count"] for r in runs) < 40_000
        after = history.compact(stored, ["k", "id"], scratch(spark, "compacted"), file_bytes, at_once=2)
        found = after.select("k", "id", "_metadata.file_name", "_metadata.file_size", "_metadata.row_index").toPandas().sort_values(["file_name", "row_index"])
        ends = []
        for _, f in found.groupby("file_name"):
            keys = [(-(1 << 63) if k != k else int(k), i) for k, i in zip(f["k"], f["id"])]
            assert keys == sorted(keys) and f["file_size"].max() < 1.4 * file_bytes
            ends.append((keys[0], keys[-1]))
        ends.sort()
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
        assert len(ends) == (1 if file_bytes > total else -(-found.groupby("file_name")["file_size"].first().sum() // file_bytes))


def test_compaction_of_nothing(spark):
    path = scratch(spark, "rows")
    spark.range(0).write.parquet(path)
    after = history.compact(spark.read.parquet(path), ["id"], scratch(spark, "compacted"))
    assert after.count() == 0 and after.columns == ["id"]


def test_snapshots_count_new_and_deleted_keys(spark):
    r = random.Random(3)
    states = {b: {k for k in [None, *range(30)] if r.random() < 0.6} for b in (1, 2, 5, 6, 9)}
    rows = [(k, b) for b, keys in states.items() for k in keys] + [(3, 5), (3, 5)]
    found = {x["snap_batch"]: x for x in history.snapshots(spark.createDataFrame(rows, "k long, snap_batch long"), ["k"]).collect()}
    before = set()
    for b, keys in states.items():
        now = keys | ({3} if b == 5 else set())
        assert (found[b]["new_keys"], found[b]["deleted"]) == (len(now - before), len(before - now))
        before = now
    assert sum(x["added"] for x in found.values()) == len(rows) and found[9]["total"] == len(rows)


def test_gaps_of_committed_ranges(spark):
    r = random.Random(5)
    ranges = [(t, a, a + r.randrange(-2, 9)) for t in "ab" for a in (r.randrange(-10, 80) for _ in range(12))] + [("c", 0, 100), ("a", None, 5), ("z", 1, 2)]
    wanted = [("a", 0, 60), ("b", 5, 50), ("c", 10, 20), ("d", 3, 6), ("e", 4, 4)]
    frame = lambda rows: spark.createDataFrame(rows, "t string, start long, stop long")
    gaps = history.range_gaps(frame(wanted), frame(ranges + ranges[:5]), ["t"])
    left = {(t, x) for t, a, b in wanted for x in range(a, b)} - {(t, x) for t, a, b in ranges if a is not None for x in range(a, b)}
    found = [(g["t"], x) for g in gaps.collect() for x in range(g["start"], g["stop"])]
    assert set(found) == left and len(found) == len(left)
    # neighbouring gaps would have been one
    assert gaps.count() == sum((t, x - 1) not in left for t, x in left)
    rows = spark.createDataFrame([(t, x) for t in "abcde" for x in range(100)], "t string, x long")
    assert {tuple(q) for q in history.in_ranges(rows, gaps, ["t"], "x").select("t", "x").collect()} == left


def laid_out(spark, n=400):
    path = scratch(spark, "by_day")
    rows = spark.range(n).select("id", F.when(F.col("id") % 10 != 0, F.timestamp_seconds(1_700_000_000 + F.col("id") * 1900)).cast("timestamp_ntz").alias("ts"))
    tables.write_partitioned(rows, [], path, columns={"day": F.to_date("ts")})
    return spark.read.schema(StructType([*rows.schema.fields, *StructType.fromDDL("day date").fields])).parquet(path)


def test_layout_change_goes_on_after_it_was_cut_off(spark, monkeypatch):
    source, path = laid_out(spark), scratch(spark, "by_hour")
    days = source.select("day").distinct().count()
    done, partitions = [], tables.partition_columns

    def create(self, rows, *args):
        if len(done) == 2 and "day" in str(args):
            raise RuntimeError("cut off")
        done.append(rows)
        return made(self, rows, *args)

    made = type(spark).createDataFrame
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", create)
        with pytest.raises(RuntimeError, match="cut off"):
            history.change_layout(source, "day", ["hours(ts)"], path, at_once=2)
    # the third job's rows are there, but not listed: they are replaced
    assert history.change_layout(source, "day", ["hours(ts)"], path, at_once=2) == days - 4
    assert history.change_layout(source, "day", ["hours(ts)"], path) == 0
    back = spark.read.schema(StructType([*source.schema.fields, *StructType.fromDDL("ts_hour timestamp_ntz").fields])).parquet(f"{path}/rows")
    assert audits.same_rows(source, back.select(*source.columns))
    assert back.where("not (ts_hour <=> date_trunc('hour', ts))").count() == 0 and partitions is tables.partition_columns


def test_sizes_are_those_of_the_files(spark, tmp_path):
    for name, n in (("one", 10), ("two", 5000)):
        spark.range(n).repartition(3).write.parquet(f"{tmp_path}/{name}")
    on_disk = {name: [os.path.getsize(f"{tmp_path}/{name}/{f}") for f in os.listdir(f"{tmp_path}/{name}") if f.endswith(".parquet") and not f.startswith(".")] for name in ("one", "two")}
    found = {r["table_name"]: r for r in tables.stored_sizes(spark, {n: f"file://{tmp_path}/{n}" for n in on_disk}).collect()}
    for name, sizes in on_disk.items():
        assert (found[name]["n_files"], found[name]["n_bytes"]) == (len(sizes), sum(sizes))
    assert found[None]["n_bytes"] == sum(map(sum, on_disk.values()))


def test_sketches_of_hours_merge_to_days(spark):
    rows = spark.range(30_000).select((F.col("id") % 48).alias("hour"), (F.col("id") * 7919 % 9_001).alias("user"))
    path = scratch(spark, "sketches")
    sketches.write(rows.unionByName(spark.createDataFrame([(0, None)], "hour long, user long")), [F.col("hour")], "user", path)
    found = {r["day"]: r["estimate"] for r in sketches.merged(spark.read.parquet(path), [F.floor(F.col("hour") / 24).alias("day")]).collect()}
    for day in (0, 1):
        exact = len({i * 7919 % 9_001 for i in range(30_000) if i % 48 // 24 == day})
        assert abs(found[day] - exact) <= 4 * sketches.ERROR * exact


def test_dual_write_passes_over_sinks_that_have_the_batch(spark):
    path, ledger, base = scratch(spark, "rows"), scratch(spark, "ledger"), scratch(spark, "sinks")
    spark.range(40).repartition(4).write.parquet(path)
    calls, failures = [], [1, 2]

    def sink(name):
        def write(batch, number):
            calls.append((name, number))
            if name == "second" and number in failures:
                failures.remove(number)
                raise RuntimeError("the sink can't be reached")
            jobs.batch_folder(f"{base}/{name}")(batch, number)

        return write

    sinks, offsets = {n: sink(n) for n in ("first", "second")}, scratch(spark, "offsets")
    run = lambda: jobs.each_batch(jobs.table_source(spark, path, "id long", 1), lambda b, n: jobs.dual_write(b, n, ledger, sinks), offsets, seconds=None)
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            run()
    run()
    for name in sinks:
        assert sorted(r["id"] for r in spark.read.schema("id long").parquet(f"{base}/{name}").collect()) == list(range(40))
    assert [c for c in calls if c[0] == "first"] == [("first", n) for n in range(4)]
    assert [c[1] for c in calls if c[0] == "second"] == [0, 1, 1, 2, 2, 3]
    assert jobs.dual_write(spark.range(5), 3, ledger, sinks) == []


def test_micro_batches_hold_so_many_records(spark):
    """Files of any size in two loads: no batch is above the limit, every record comes once."""
    path, spool, offsets, out = (scratch(spark, n) for n in ("lines", "spool", "offsets", "out"))
    sizes, seen = [], []

    def handle(batch, number):
        ids = [r["id"] for r in batch.collect()]
        sizes.append(len(ids))
        seen.extend(ids)

    for low, high in ((0, 95), (95, 130)):
        spark.range(low, high).repartition(2).write.mode("append").json(path)
        source = jobs.json_source(spark, path, "id long", files_per_batch=10)
        jobs.each_batch(jobs.record_limited(source, spool, offsets, 20), handle, out, seconds=None)
    assert sorted(seen) == list(range(130)) and max(sizes) <= 20 and len(sizes) >= 7


def test_ranges_are_met_in_cells_not_by_key_alone(spark):
    """Ranges far longer than others, side by side, around 0, at the ends of the type, empty, null; keys null; rows that repeat."""
    top = 2**63 - 1
    spans = [("a", -(2**63), -1000), ("a", -40, -39), ("a", -39, -1), ("a", 0, 1), ("a", 5, 5), ("a", 9, 3), ("a", None, 4), ("a", 100, 1_000_000), ("a", top - 7, top)]
    spans += [("b", 2 * x, 2 * x + 1) for x in range(500)] + [("b", 10_000, 2_000_000_000), (None, 0, 9)]
    points = [("a", x) for x in (-(2**63), -1001, -1000, -41, -40, -39, -2, -1, 0, 0, 1, 3, 5, 99, 100, 65_536, 999_999, 1_000_000, top - 8, top - 7, top - 1, top, None)]
    points += [("b", x) for x in (*range(-3, 1010), 9_999, 10_000, 123_456_789, 1_999_999_999, 2_000_000_000)] + [(None, 3), ("c", 3)]
    want = sorted((k, x) for k, x in points for q, low, high in spans if k is not None and k == q and x is not None and low is not None and low <= x < high)
    rows, ranges = spark.createDataFrame(points, "t string, x long"), spark.createDataFrame(spans, "t string, start long, stop long")
    found = history.in_ranges(rows, ranges, ["t"], "x")
    assert sorted(tuple(r) for r in found.select("t", "x").collect()) == want and found.columns == ["t", "x"]
    assert "_cell" in found._jdf.queryExecution().optimizedPlan().toString()
    # a time, an int against longs, and a type without cells
    for kind in ("timestamp", "double"):
        cast = lambda df, *names: df.withColumns({c: (F.timestamp_seconds(c) if kind == "timestamp" else F.col(c).cast(kind)) for c in names})
        few = history.in_ranges(cast(rows.where("t = 'b'").withColumn("n", F.col("x")), "x"), cast(ranges.where("t = 'b'"), "start", "stop"), ["t"], "x")
        assert sorted((r["t"], r["n"]) for r in few.collect()) == [w for w in want if w[0] == "b"]
    ints = history.in_ranges(rows.where("t = 'b'").withColumn("x", F.col("x").cast("int")), ranges, ["t"], "x")
    assert sorted(tuple(r) for r in ints.select("t", "x").collect()) == [w for w in want if w[0] == "b"]
    assert history.in_ranges(rows, ranges.limit(0), ["t"], "x").collect() == []


def test_groups_of_records_share_a_micro_batch(spark):
    """Groups hold so many records at most, each record once, and a micro-batch holds many of them."""
    path, out, done = scratch(spark, "lines"), scratch(spark, "out"), []
    spark.range(1000).repartition(3).write.json(path)

    def handle(batch, number):
        jobs.in_records(batch, 20).write.parquet(f"{out}/batch={number}")
        done.append(number)

    jobs.each_batch(jobs.json_source(spark, path, "id long"), handle, scratch(spark, "offsets"), seconds=None)
    rows = [tuple(r) for r in spark.read.schema("id long, trigger long, batch long").parquet(out).collect()]
    sizes = [sum(1 for r in rows if r[1:] == g) for g in {r[1:] for r in rows}]
    assert sorted(r[0] for r in rows) == list(range(1000)) and max(sizes) <= 20 and 50 <= len(sizes) <= 53
    assert done == [0]


def test_the_record_trigger_is_no_micro_batch_per_group(spark, sf, monkeypatch):
    from lakeline.plans import events

    numbers, each = [], jobs.each_batch
    monkeypatch.setattr(jobs, "each_batch", lambda stream, handle, *rest, **named: each(stream, lambda batch, number: (numbers.append(number), handle(batch, number)), *rest, **named))
    found = events.stream_record_trigger(spark, sf)
    assert found.where("fits").count() == spark.read.parquet(f"{sf}/events.parquet").count() > 100
    # sf0.001 has a few groups of 100 records, and too few bytes for a second micro-batch
    assert numbers == [0]


def test_null_labels_are_labels(spark):
    rows = [("m", None, 1, 5.0), ("m", None, 2, 8.0), ("m", "x", 1, 1.0), ("m", "x", 2, 4.0)]
    s = spark.createDataFrame(rows, "metric string, label string, n long, value double")
    found = {r["label"]: r["increase"] for r in series.increase(s, ["metric", "label"], ["n"], [], F.col("n")).collect()}
    assert found == {None: 3.0, "x": 3.0}
    timed = s.withColumn("ts", F.timestamp_seconds(F.col("n") * 60))
    grid = series.on_grid(timed, F.timestamp_seconds(F.lit(60)), F.timestamp_seconds(F.lit(180)), 60, ["metric", "label"])
    assert grid.where("label is null").count() == 3 and grid.where("label = 'x'").count() == 3
    half = series.ratio(timed.groupBy("label").agg(F.sum("value").alias("value")), timed.groupBy("label").agg((F.sum("value") * 2).alias("value")), ["label"])
    assert {r["label"]: r["ratio"] for r in half.collect()} == {None: 0.5, "x": 0.5}


@pytest.mark.parametrize("few", [1, 64])
def test_repeated_points_stay(spark, monkeypatch, few):
    monkeypatch.setattr(series, "FEW_POINTS", few)
    points = spark.createDataFrame([("a", 5, 1), ("a", 5, 1), ("a", 50, 2), (None, 5, 3), ("a", None, 4), ("b", 1, 5)], "name string, at long, x long")
    log = spark.createDataFrame([("a", 4, 1), ("a", 6, 9), ("a", 7, 3), (None, 9, 2), ("a", None, 0)], "name string, ts long, scn long")
    found = sorted(map(str, (tuple(r) for r in series.asof_forward(points, log, ["name"], "at", "ts", "scn").select("name", "at", "x", "scn").collect())))
    assert found == sorted(map(str, [("a", 5, 1, 3), ("a", 5, 1, 3), ("a", 50, 2, None), (None, 5, 3, None), ("a", None, 4, None), ("b", 1, 5, None)]))


def test_bulk_files_have_two_lines_a_row(spark):
    path = scratch(spark, "bulk")
    messages.write_bulk(spark.createDataFrame([(1, "a\nb"), (2, 'c"')], "id long, note string").coalesce(1), "notes", "id", path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines == ['{"index":{"_index":"notes","_id":"1"}}', '{"id":1,"note":"a\\nb"}', '{"index":{"_index":"notes","_id":"2"}}', '{"id":2,"note":"c\\""}']


def test_totals_of_bindings(spark):
    results = spark.createDataFrame([(1, 1, "bound"), (2, 1, "bound"), (3, 1, "user_not_found"), (3, 2, "already_exists")], "user_id long, role_id long, result string")
    found = {(r["role_id"], r["result"]): r["n"] for r in access.bind_totals(results).collect()}
    assert found == {(1, "bound"): 2, (1, "user_not_found"): 1, (1, None): 3, (2, "already_exists"): 1, (2, None): 1, (None, None): 4}
