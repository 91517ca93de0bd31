"""Keyed merges: order, ties, replays and splits don't change the result."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeline.operators import merge, schema
from lakeline.session import scratch
from lakeline.sources import files
from lakeline.streaming import buckets, jobs

SCHEMA = "k long, v long, op string, seq long"


def final(rows):
    """Brute force: the last change per key by (seq, c < u < d)."""
    best = {}
    for k, v, op, seq in rows:
        at = (seq, merge.OP_ORDER[op])
        if k not in best or at > best[k][0]:
            best[k] = (at, v, op)
    return sorted((k, v) for k, (_, v, op) in best.items() if op != "d")


def log(n, seed):
    r = random.Random(seed)
    return [(r.randrange(12), i, r.choice("cuud"), s) for i, s in enumerate(r.sample(range(10 * n), n))]


def applied(spark, target, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    if target is None:
        target = merge.empty_target(df, ["k"], ["v"], "seq")
    return merge.apply_changes(target, df, ["k"], "seq")


def values(df):
    return sorted(tuple(r) for r in merge.live(df).select("k", "v").collect())


def test_any_split_and_replay(spark):
    rows = log(60, 1)
    for parts in (1, 2, 4):
        target = None
        cut = [rows[i::parts] for i in range(parts)]
        for part in [*cut, cut[0]]:  # the first part comes again at the end
            target = applied(spark, target, part)
        assert values(target) == final(rows)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.sampled_from("cud"), st.integers(0, 1000)), min_size=1, max_size=12, unique_by=lambda r: (r[0], r[3])), cut=st.integers(0, 1000))
def test_copy_plus_stream_is_the_source(spark, rows, cut):
    copy = applied(spark, None, [r for r in rows if r[3] <= cut]) if any(r[3] <= cut for r in rows) else None
    rest = [r for r in rows if r[3] >= cut - 100]
    found = applied(spark, copy, rest) if rest else copy
    assert values(found) == final(rows)


def test_late_change_does_not_revive(spark):
    target = applied(spark, None, [(1, 5, "c", 1), (1, 6, "d", 9)])
    assert values(applied(spark, target, [(1, 7, "u", 3)])) == []
    assert values(applied(spark, target, [(1, 8, "c", 10)])) == [(1, 8)]


def test_delete_where_keeps_null_conditions(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "k long, v long")
    assert sorted(r[0] for r in merge.delete_where(df, F.col("v") > 10).collect()) == [1, 2]


LOG = SCHEMA + ", table_name string"


def by_stream(spark, rows, path, start=None, parts=4, name="changes"):
    log = scratch(spark, "log")
    spark.createDataFrame(rows, LOG).repartition(parts).write.parquet(log)
    return buckets.apply_changes(jobs.table_source(spark, log, LOG, files_per_batch=1), path, ["k"], ["v"], scratch(spark, "offsets"), start=start, name=name, buckets=8, seconds=None)


def kept(spark, path):
    schema = buckets.state_schema(StructType.fromDDL(LOG), ["k"], ["v"], "seq")
    return sorted(tuple(r) for r in buckets.read(spark, path, schema).select("k", "v").collect())


def test_bucket_table_by_stream(spark):
    rows, path = log(80, 3), scratch(spark, "table")
    assert kept(spark, path) == []
    query = by_stream(spark, [(*r, "t") for r in rows], path)
    assert kept(spark, path) == final(rows) and not query.isActive
    assert {(r["stream"], r["batch"]) for r in buckets.ledger(spark, path).collect()} == {("changes", n) for n in range(4)}
    # all of it again from another checkpoint, in other batches: late and repeated changes do no harm
    by_stream(spark, [(*r, "t") for r in rows], path, parts=3, name="again")
    assert kept(spark, path) == final(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t") for r in rows], LOG)


def test_a_batch_runs_twice_or_is_cut_off(spark, monkeypatch):
    """Cut off while it is staged, between staging and swap, in the swap and before the ledger: afterwards the batch stands once."""
    rows, path = log(60, 4), scratch(spark, "table")
    one, two = rows[:30], rows[30:]
    assert buckets.apply_batch(frame(spark, one), 0, path, ["k"], ["v"], buckets=4)
    assert not buckets.apply_batch(frame(spark, two), 0, path, ["k"], ["v"], buckets=4)
    assert kept(spark, path) == final(one)

    def cut(*_):
        raise RuntimeError("cut off")

    def half(spark, staged, path, schema):
        put(spark, staged, path, schema)
        cut()

    put = buckets.put_in_place
    for place, broken, after in (("put_in_place", cut, one), ("put_in_place", half, rows), ("enter", cut, rows)):
        with monkeypatch.context() as m:
            m.setattr(buckets, place, broken)
            with pytest.raises(RuntimeError, match="cut off"):
                buckets.apply_batch(frame(spark, two), 1, path, ["k"], ["v"], buckets=4)
        assert kept(spark, path) == final(after) and not buckets.is_applied(spark, path, "changes", 1)
    # a batch that is staged whole is put in place as it was staged, whatever the stream gives now
    assert buckets.apply_batch(frame(spark, []), 1, path, ["k"], ["v"], buckets=4)
    assert kept(spark, path) == final(rows) and buckets.is_applied(spark, path, "changes", 1)
    # files of a staging that was cut off have no _SUCCESS, and are replaced
    frame(spark, [(77, 1, "c", 1)]).write.parquet(f"{path}/staged/stream=changes/batch=2/_bucket=0")
    files.remove(spark, f"{path}/staged/stream=changes/batch=2/_bucket=0/_SUCCESS")
    assert buckets.apply_batch(frame(spark, rows[:3]), 2, path, ["k"], ["v"], buckets=4)
    assert kept(spark, path) == final(rows)


def test_bucket_table_with_null_keys_and_ties(spark):
    path = scratch(spark, "table")
    rows = [(None, 1, "c", 1), (None, 2, "u", 2), (5, 1, "c", 7), (5, 2, "d", 7), (6, 3, "r", 1), (6, 4, "u", 1)]
    for number, row in enumerate(reversed(rows)):
        buckets.apply_batch(frame(spark, [row]), number, path, ["k"], ["v"], buckets=2)
    schema = buckets.state_schema(StructType.fromDDL(LOG), ["k"], ["v"], "seq")
    assert sorted(map(str, (tuple(r) for r in buckets.read(spark, path, schema).collect()))) == ["(6, 4)", "(None, 2)"]


def test_only_touched_buckets_are_rewritten(spark):
    path = scratch(spark, "table")
    buckets.apply_batch(frame(spark, [(k, k, "c", 1) for k in range(64)]), 0, path, ["k"], ["v"], buckets=16)
    held = lambda: {r["p"]: r["b"] for r in spark.read.parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("p"), F.col("_bucket").alias("b")).distinct().collect()}
    before = held()
    buckets.apply_batch(frame(spark, [(3, 9, "u", 2)]), 1, path, ["k"], ["v"], buckets=16)
    after = held()
    assert len({before[f] for f in before if f not in after}) == 1 and kept(spark, path) == sorted((k, 9 if k == 3 else k) for k in range(64))


def test_stream_from_sync_point(spark):
    """Only changes from each table's point on are applied; tables without one don't start."""
    r = random.Random(9)
    rows = [(r.randrange(30), i, r.choice("cuud"), s, r.choice("ab_")) for i, s in enumerate(r.sample(range(900), 90))]
    rows = [(k * 3 + "ab_".index(t), *rest, t) for k, *rest, t in rows]
    start = spark.createDataFrame([("a", 300), ("b", 500)], "table_name string, start_scn long")
    later = [x[:4] for x in rows if x[4] != "_" and x[3] >= {"a": 300, "b": 500}[x[4]]]
    path = scratch(spark, "table")
    by_stream(spark, rows, path, start)
    assert kept(spark, path) == final(later)


VERSIONS = "subject string, seq long, columns array<struct<name: string, type: string>>"


def test_schema_stream_of_several_tables(spark):
    """Random schemas of three tables in several batches, with repeats and late ones, against neighbouring versions by hand."""
    r, path, target, offsets = random.Random(6), scratch(spark, "schemas"), scratch(spark, "changes"), scratch(spark, "offsets")
    columns = lambda: [(c, r.choice(["int", "bigint", None])) for c in "abcdef" if r.random() < 0.7]
    batches = [[(s, at * 10 + i, columns()) for s in ("one", "two", "three") for i in range(r.randrange(4))] for at in range(4)]
    batches[2] += [batches[1][0], ("two", 0, [("late", "int")]), (None, 5, [("x", "int")]), (None, 6, []), ("one", None, []), ("one", 99, None)]
    for rows in batches:
        spark.createDataFrame(rows, VERSIONS).write.mode("append").parquet(path)
        changes = jobs.schema_changes(jobs.table_source(spark, path, VERSIONS, files_per_batch=1000))
        jobs.load(changes, target, offsets, seconds=None)
    want, last = [], {}
    for rows in batches:
        for s, seq, cols in sorted((x for x in rows if x[1] is not None and x[2] is not None), key=lambda x: x[1]):
            old, new = last.get(s, (-1, None))[1], {c: k for c, k in cols if k}
            if seq <= last.get(s, (-1, None))[0]:
                continue
            if old is not None:
                want += [(s, seq, c, "add" if c not in old else "remove" if c not in new else "modify", old.get(c), new.get(c)) for c in {*old, *new} if old.get(c) != new.get(c)]
            last[s] = (seq, new)
    assert sorted(map(str, (tuple(x) for x in spark.read.parquet(target).collect()))) == sorted(map(str, want)) and len(want) > 20


def test_parts_of_several_schema_versions(spark):
    """Older parts go through later changes when they are read; a change that would lose values is an error."""
    rows = spark.createDataFrame([("t", 1, "note", "add", None, "string"), ("t", 1, "v", "modify", "int", "bigint"), ("t", 2, "old", "remove", "string", None)], "subject string, seq long, name string, change string, old_type string, new_type string")
    changes = schema.changes_of(rows)
    parts = [(0, spark.createDataFrame([(1, 1, "a")], "k long, v int, old string")), (1, spark.createDataFrame([(2, 1 << 40, "b", "n")], "k long, v long, old string, note string")), (2, spark.createDataFrame([(3, 3, "m")], "k long, v long, note string"))]
    found = schema.evolved(parts, changes)
    assert sorted(tuple(r) for r in found.select("k", "v", "note").collect()) == [(1, 1, None), (2, 1 << 40, "n"), (3, 3, "m")] and set(found.columns) == {"k", "v", "note"}
    with pytest.raises(ValueError, match="without loss"):
        schema.evolved(parts[1:2], [(3, [("widen", "v", "int")])])


def test_a_stream_can_be_awaited_and_stopped(spark):
    """With an interval the caller gets the running query; a batch is applied at once and then every so many seconds."""
    rows, path, log_path = log(20, 8), scratch(spark, "table"), scratch(spark, "log")
    frame(spark, rows[:10]).write.parquet(log_path)
    query = buckets.apply_changes(jobs.table_source(spark, log_path, LOG, 100), path, ["k"], ["v"], scratch(spark, "offsets"), buckets=4, seconds=1)
    try:
        query.processAllAvailable()
        assert query.isActive and kept(spark, path) == final(rows[:10])
        frame(spark, rows[10:]).write.mode("append").parquet(log_path)
        query.processAllAvailable()
        assert kept(spark, path) == final(rows)
    finally:
        query.stop()
    assert not query.isActive


def test_merge_with_null_keys_can_be_repeated(spark):
    df = spark.createDataFrame([(None, 1), (2, 2)], "k long, v long")
    assert sorted(map(str, (tuple(r) for r in merge.merge_upsert(df, df, ["k"]).collect()))) == ["(2, 2)", "(None, 1)"]


def test_upsert_reset(spark):
    target = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v long, scn long")
    changed = spark.createDataFrame([("b", 3, 99), ("c", 4, 99)], "k string, v long, scn long")
    found = merge.upsert_reset(target, changed, ["k"], ["scn"])
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 10), ("b", 3, None), ("c", 4, None)]
