"""Batches, layout, audit columns, schemas, types, filters, messages."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeline.functions.types import cast_to, map_record_type, map_type
from lakeline.operators import access, audits, filters, history, models, schema, series
from lakeline.session import application_dir, clear, scratch, small, stored
from lakeline.sources import messages, tables
from lakeline.streaming import jobs


def test_batches_are_exact_with_ties(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("k"), "id")
    rows = tables.batches(df, "k", 150).collect()
    assert sorted(r["row_no"] for r in rows) == list(range(1000))
    assert [r["k"] for r in sorted(rows, key=lambda r: r["row_no"])] == sorted(r["k"] for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["batch_no"]] = sizes.get(r["batch_no"], 0) + 1
    assert sizes == {0: 150, 1: 150, 2: 150, 3: 150, 4: 150, 5: 150, 6: 100}


def test_batches_of_nothing(spark):
    assert tables.batches(spark.range(0), "id", 10).count() == 0


def test_audit_columns(spark):
    df = tables.with_audit(spark.range(3).withColumn("b", F.lit(2)), F.col("b"), F.col("id"), F.lit("2024-01-01").cast("timestamp"))
    assert [r["snap_id"] for r in df.collect()] == [(2 << 40) + i for i in range(3)]
    assert tables.with_audit(df, F.col("b"), F.col("id")).columns == df.columns


def test_partition_transforms(spark):
    with pytest.raises(ValueError):
        tables.partition_columns(["minutes(ts)"])
    assert set(tables.partition_columns(["hours(ts)", "bucket(4, id)", "truncate(3, name)", "identity(x)", "years(ts)"])) == {"ts_hour", "id_bucket", "name_trunc", "x_identity", "ts_year"}


def test_append_with_more_columns(spark):
    path = scratch(spark, "grown")
    tables.append(spark.range(2), path)
    tables.append(spark.range(2, 3).withColumn("note", F.lit("x")), path)
    assert sorted((r["id"], r["note"]) for r in tables.read_merged(spark, path).collect()) == [(0, None), (1, None), (2, "x")]


def test_align(spark):
    target = StructType.fromDDL("a bigint, b string, c double")
    found = schema.align(spark.createDataFrame([(1, 2)], "a int, extra int"), target)
    assert found.schema == target and tuple(found.first()) == (1, None, None)


def test_evolve_refuses_narrowing(spark):
    with pytest.raises(ValueError):
        schema.evolve(spark.range(1), [("widen", "id", "int")])
    with pytest.raises(ValueError):
        schema.evolve(spark.range(1), [("explode", "id")])


def test_governed_select(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert schema.governed_select(df, ["a"], ["a"]).columns == ["a"]
    for columns in (["b"], ["*"]):
        with pytest.raises(PermissionError):
            schema.governed_select(df, ["a"], columns)


@pytest.mark.parametrize(("name", "family", "found"), [("NUMBER(10,2)", "warehouse", "decimal(10,2)"), ("NUMBER", "database", "decimal(38,10)"), ("NUMBER(5)", "warehouse", "decimal(5,0)"), ("VARIANT", "warehouse", "string"), ("DATE", "database", "timestamp"), ("GEOGRAPHY", "warehouse", "string"), ("TIMESTAMP_TZ(9)", "warehouse", "timestamp"), ("SMALLINT", "database", "smallint"), ("BOOLEAN", "database", "boolean"), ("DECIMAL(10,2)", "database", "decimal(10,2)"), ("numeric(5, 1)", "database", "decimal(5,1)"), ("NCHAR(3)", "database", "string")])
def test_map_type(name, family, found):
    assert map_type(name, family) == found


def test_map_record_type():
    assert map_record_type(["null", "long"]) == "bigint"
    assert map_record_type({"type": "long", "logicalType": "timestamp-micros"}) == "timestamp"
    assert map_record_type({"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 3}) == "decimal(9,3)"
    assert map_record_type({"type": "int", "logicalType": "date"}) == "date"


def test_cast_gives_null_for_misfits(spark):
    df = cast_to(spark.createDataFrame([("1",), ("x",), (None,)], "a string"), {"a": "INTEGER"})
    assert [r[0] for r in df.collect()] == [1, None, None]


def test_filters_and_verdicts(spark):
    sized = spark.createDataFrame([("a", 1.0), ("b", 9.0), ("c", 0.0), ("d", 0.5)], "table_name string, size_gb double")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "table_name string")
    assert sorted(r[0] for r in filters.filter_tables(sized, names("a", "b", "c"), names("c"), 3.0).collect()) == ["a"]
    assert sorted(r[0] for r in filters.filter_tables(sized, None, names("c"), 0).collect()) == ["a", "b", "d"]
    found = {r["table_name"]: r["verdict"] for r in filters.verdicts(sized, names("a", "b", "c"), names("c", "b"), 3.0).collect()}
    assert found == {"a": "COPY", "b": "SKIP (excluded)", "c": "SKIP (excluded)", "d": "SKIP (not in include list)"}


def test_slugs_and_pages(spark):
    df = spark.createDataFrame([("a:R",), ("b",), (":R",), ("c:",), ("d:R:S",), (None,)], "slug string")
    assert sorted((r["service"], r["permission"]) for r in filters.split_slug(df, "slug").collect()) == [("a", "R"), ("d", "R:S")]
    with pytest.raises(ValueError):
        filters.page(df, F.lit(True), [F.col("slug")], limit=1001)


def test_audits_of_nothing(spark):
    empty = spark.createDataFrame([], "a int")
    assert audits.not_null(empty, ["a"]).first()["n_null"] == 0
    assert tuple(audits.uniqueness(empty, ["a"]).first()) == (0, 0, 0)


def test_table_diff_takes_nulls_as_equal(spark):
    old = spark.createDataFrame([(1, None), (2, 2), (3, 3)], "k int, v int")
    new = spark.createDataFrame([(1, None), (2, None), (4, 4)], "k int, v int")
    assert {r["k"]: r["change"] for r in audits.table_diff(old, new, ["k"]).collect()} == {2: "changed", 3: "removed", 4: "added"}


def test_orphans_ignore_null_keys(spark):
    child = spark.createDataFrame([(1,), (None,), (9,)], "f int")
    assert [r[0] for r in audits.orphans(child, spark.createDataFrame([(1,)], "k int"), "f", "k").collect()] == [9]


def test_counter_restart_and_grid(spark):
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 5, 2, 4])], "metric string, n int, value double")
    assert series.increase(s, ["metric"], ["n"], []).first()["increase"] == 4 + 2 + 2
    g = spark.createDataFrame([("a", "2024-01-01 00:00:30", 1.0), ("a", "2024-01-01 00:02:00", 2.0)], "metric string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    at = lambda x: F.lit(x).cast("timestamp")
    found = series.on_grid(g, at("2024-01-01 00:00:00"), at("2024-01-01 00:03:00"), 60, ["metric"]).orderBy("ts").collect()
    assert [r["value"] for r in found] == [1.0, 2.0, 2.0]


def test_asof_forward(spark):
    log = spark.createDataFrame([("t", 1, 10), ("t", 5, 7), ("t", 5, 6), ("u", 2, 1)], "name string, ts int, scn long")
    points = spark.createDataFrame([("t", 0), ("t", 2), ("t", 5), ("t", 6), ("u", 3)], "name string, at int").withColumn("p", F.col("at"))
    found = {(r["name"], r["p"]): r["scn"] for r in series.asof_forward(points, log, ["name"], "at", "ts", "scn").collect()}
    assert found == {("t", 0): 6, ("t", 2): 6, ("t", 5): 6, ("t", 6): None, ("u", 3): None}


def test_resume_by_key_not_by_count(spark):
    source, target = spark.range(10), spark.createDataFrame([(i,) for i in (0, 3, 9)], "id long")
    assert sorted(r[0] for r in history.still_missing(source, target, ["id"]).collect()) == [1, 2, 4, 5, 6, 7, 8]


def test_effective_permissions(spark):
    at = "2024-02-01"
    b = spark.createDataFrame([(1, 7, 1, None, None), (2, 7, 1, 5, None), (3, 8, 1, 6, "2024-01-01"), (4, 9, 1, 6, "2024-03-01")], "binding_id int, user_id int, role_id int, service_id int, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    p = spark.createDataFrame([(1, 5, "READ"), (1, 6, "READ")], "role_id int, service_id int, permission string")
    found = sorted(tuple(r) for r in access.effective(b, p, F.lit(at).cast("timestamp")).collect())
    assert found == [(7, 5, "READ", 1), (7, 6, "READ", 1), (9, 6, "READ", 4)]


def test_messages(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, "oops"), (3, None)], "id int, props string")
    assert [r["k"] for r in messages.project_json(df, "props", {"k": "int"}).orderBy("id").collect()] == [5, None, None]
    assert messages.as_messages(df, "id", "t").orderBy("key").first()["value"].startswith('{"id":1')
    assert messages.synthetic_events(spark, 100).agg(F.count_distinct("event_id")).first()[0] == 100
    shop = messages.synthetic_shop(spark, 40)
    assert {k: v.count() for k, v in shop.items()} == {"customers": 40, "products": 10, "orders": 60, "order_items": 140, "product_reviews": 40, "inventory_events": 60}


def test_batches_keep_columns_of_any_name(spark):
    df = spark.range(100).withColumns({"_part": F.lit("p"), "_at": F.lit("a"), "_before": F.lit("b")})
    rows = tables.batches(df, "id", 30)
    assert rows.columns == [*df.columns, "row_no", "batch_no"] and all(r["row_no"] == r["id"] and r["_at"] == "a" for r in rows.collect())


def test_bucket_of_any_type(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (-3, "b", None), (None, None, 2.5), (9, "12", 0.5)], "i long, s string, d double")
    own = tables.partition_columns(["bucket(4, i)", "bucket(4, s)", "bucket(3, d)"])
    rows = df.select(*[c.alias(k) for k, c in own.items()]).collect()
    assert [r["i_bucket"] for r in rows] == [1, 1, 0, 1]
    assert rows[2]["s_bucket"] == 0 and rows[1]["d_bucket"] == 0 and all(0 <= r["s_bucket"] < 4 and 0 <= r["d_bucket"] < 3 for r in rows)


def test_instant_takes_the_last_of_ties(spark):
    s = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 5, 2, 0.5), ("a", 6, 3, 9.0)], "m string, ts int, n int, value double")
    for df in (s, s.orderBy(F.desc("n"))):
        assert series.instant(df, F.lit(5), ["m"], ["n"]).first()["value"] == 0.5
        assert series.instant(df, F.lit(5), ["m"]).first()["value"] == 1.0
    rows = spark.createDataFrame([(1, 0, 10, "t"), (1, 1, 11, "t")], "k int, snap_batch int, v int, snap_timestamp string")
    assert history.as_of_time(rows, ["k"], F.lit("t")).first()["v"] == 11


def test_asof_against_brute_force(spark, monkeypatch):
    """Ties, times past the end, repeated points, null keys and times, by lists and by sorting in one block and in several."""
    import random

    r = random.Random(1)
    log = [(r.choice("tuv"), r.randrange(50), r.randrange(1000)) for _ in range(300)] + [("t", None, -5), (None, 30, -7)]
    points = [(r.choice("tuvw"), r.randrange(60), i % 7) for i in range(60)] + [("t", None, 1), (None, 3, 2)]
    expected = {(n, p, x, min((s for m, t, s in log if m == n is not None and p is not None and t is not None and t >= p), default=None)) for n, p, x in points}
    df, rows = spark.createDataFrame(points, "name string, at int, x int"), spark.createDataFrame(log, "name string, ts int, scn long")
    found = lambda block=None: {tuple(q) for q in series.asof_forward(df, rows, ["name"], "at", "ts", "scn", block).select("name", "at", "x", "scn").collect()}
    assert found() == expected
    monkeypatch.setattr(series, "FEW_POINTS", 5)
    assert found() == expected and found(lambda c: F.floor(c / 7)) == expected
    day = lambda c: F.timestamp_seconds(F.col(c) * 7200)
    dated = series.asof_forward(df.withColumn("at", day("at")), rows.withColumn("ts", day("ts")), ["name"], "at", "ts", "scn")
    assert {(q["name"], q["x"], q["scn"]) for q in dated.collect()} == {(n, x, s) for n, _, x, s in expected}


def test_blocks_carry_values_over(spark):
    """A series cut by days gives what it gives in one piece, with days without samples and null values."""
    import datetime
    import random

    r = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [("ab"[i % 2], start + datetime.timedelta(hours=r.randrange(24 * 9) if i % 3 else 5), i, None if i % 11 == 0 else float(r.randrange(100))) for i in range(120)]
    df = spark.createDataFrame(rows, "m string, ts timestamp, n int, value double")
    total = lambda block: {x["m"]: x["increase"] for x in series.increase(df, ["m"], ["ts", "n"], [], block).collect()}
    brute = {}
    for m in "ab":
        values = [v for _, _, _, v in sorted((x for x in rows if x[0] == m and x[3] is not None), key=lambda x: x[1:3])]
        brute[m] = sum(b if b < a else b - a for a, b in zip(values, values[1:]))
    assert total(None) == total(F.to_date("ts")) == brute
    once = df.where("n % 3 <> 0").dropDuplicates(["m", "ts"])
    kept = [tuple(x) for x in once.where("value is not null").collect()]
    found = {(x["m"], x["ts"]): x["value"] for x in series.on_grid(once, F.lit(start), F.lit(start + datetime.timedelta(days=10)), 7 * 3600, ["m"]).collect()}
    for step in range(35):
        at = start + datetime.timedelta(hours=7 * step)
        for m in "ab":
            before = [(x[1], x[3]) for x in kept if x[0] == m and x[1] <= at]
            if at <= start + datetime.timedelta(days=10):
                assert found.get((m, at)) == (max(before)[1] if before else None)


def test_prediction_is_the_least_squares_line(spark):
    import numpy as np

    x, y = [0, 60, 120, 400], [10.25, 8.5, 9.0, 1.75]
    s = spark.createDataFrame([("a", i, v) for i, v in zip(x, y)] + [("b", 5, 1.0)], "m string, ts int, value double")
    found = {r["m"]: r["predicted"] for r in series.predict(s, ["m"], F.col("ts"), 100).collect()}
    slope, base = np.polyfit(x, y, 1)
    assert abs(found["a"] - (base + slope * 500)) < 1e-9 and found["b"] is None


def test_recording_again_replaces_days(spark):
    path = scratch(spark, "recorded")
    s = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:00", 2.0), ("b", "2024-01-02 00:00:00", 4.0)], "u string, t string, value double").withColumn("ts", F.col("t").cast("timestamp"))
    for _ in range(2):
        rows = series.record(s, ["u"], "sum", path, 10)
    assert sorted((r["u"], r["value"], r["metric"]) for r in rows.collect()) == [("a", 30.0, "sum"), ("b", 40.0, "sum")]


def test_malformed_json_lines_are_dropped(spark):
    path = scratch(spark, "lines")
    spark.createDataFrame([('{"a": 1}',), ("oops",), ("",), ('{"a": "x"}',), ('{"a": 2, "b": 3}',), ("{}",)], "value string").write.text(path)
    target = scratch(spark, "loaded")
    jobs.load(jobs.json_source(spark, path, "a int", line_bytes=10), target, scratch(spark, "offsets"), seconds=None)
    assert sorted(str(r["a"]) for r in spark.read.parquet(target).collect()) == ["1", "2", "None"]


def test_late_rows_of_the_hourly_stream(spark):
    """Four micro-batches: a row behind the watermark is left out and counted, one within it is taken."""
    path, target, offsets = scratch(spark, "events"), scratch(spark, "hours"), scratch(spark, "offsets")
    for rows in ([("2024-01-01 00:10:00", 1.0), ("2024-01-01 06:00:00", 1.0)], [("2024-01-01 06:10:00", 1.0)], [("2024-01-01 00:20:00", 5.0), ("2024-01-01 05:30:00", 2.0)], [("2024-01-01 12:00:00", 1.0)]):
        df = spark.createDataFrame(rows, "t string, value double").select(F.col("t").cast("timestamp_ntz").alias("ts"), F.lit("x").alias("event_type"), "value")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.hourly(jobs.table_source(spark, path, "ts timestamp_ntz, event_type string, value double", files_per_batch=1))
    query = jobs.load(stream, target, offsets, seconds=None)
    found = {r["hour"].hour: (r["n_events"], float(r["total"])) for r in spark.read.parquet(target).collect()}
    assert found == {0: (1, 1.0), 5: (1, 2.0), 6: (2, 2.0)} and jobs.dropped_late(query) == 1


def test_duplicates_beyond_the_horizon_come_again(spark):
    path, target, offsets = scratch(spark, "events"), scratch(spark, "once"), scratch(spark, "offsets")
    for n, t in ((1, "00:00"), (1, "00:30"), (2, "09:00"), (3, "09:10"), (1, "10:00"), (1, "10:10")):
        spark.createDataFrame([(n, f"2024-01-01 {t}:00")], "event_id long, t string").select("event_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.deduplicated(jobs.table_source(spark, path, "event_id long, ts timestamp"), ["event_id"], "1 hour")
    jobs.load(stream, target, offsets, seconds=None)
    assert sorted((r["event_id"], r["ts"].hour) for r in spark.read.parquet(target).collect()) == [(1, 0), (1, 10), (2, 9), (3, 9)]


def test_topics_roles_and_sinks(spark):
    df = spark.createDataFrame([("__offsets",), ("orders",), (None,)], "name string")
    assert [r[0] for r in filters.visible(df, "name").collect()] == ["orders"]
    path, seen = scratch(spark, "control"), []
    tables.dual_write(spark.range(1).withColumn("at", F.expr("uuid()")), path, lambda row: seen.extend(row.collect()))
    assert [r["at"] for r in spark.read.parquet(path).collect()] == [r["at"] for r in seen]


def test_sized_and_seeded_tables(spark, tmp_path):
    path = scratch(spark, "sized")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    tables.write_sized(spark.range(200_000).repartition(20), path, 128 << 20)
    assert spark.read.parquet(path).count() == 200_000 and history.file_stats(spark.read.parquet(path)).count() == 1
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    assert history.files_for(spark.read.parquet(path), 1000) > 1
    (tmp_path / "seed.csv").write_text("a,b\n1,x\n2,\n")
    seed = tables.seed(spark, str(tmp_path / "seed.csv"), "a int, b string")
    assert sorted(tuple(r) for r in seed.collect()) == [(1, "x"), (2, None)]
    tables.register(seed, "seed_view")
    assert spark.table("seed_view").count() == 2 and tables.probe_schema(seed) == seed.schema
    assert tables.capped(spark.range(5000)).count() == 1000
    models.run_full(seed, f"{path}-full")
    models.run_full(seed, f"{path}-full")
    assert spark.read.parquet(f"{path}-full").count() == 2


def test_sized_files_are_as_many_as_their_bytes_ask_for(spark):
    """Neither the number of cores nor the size of shuffled rows counts, and rows stay beside each other."""
    rows = spark.range(0, 3_000_000, 1, 12).withColumn("x", F.xxhash64("id"))
    for file_bytes in (256 << 20, 4 << 20):
        path = scratch(spark, "sized")
        tables.write_sized(rows, path, file_bytes)
        back = spark.read.parquet(path)
        sizes = [r["file_bytes"] for r in history.file_stats(back).collect()]
        assert len(sizes) == max(1, round(sum(sizes) / file_bytes)) and max(sizes) < 1.5 * file_bytes
        assert back.agg(F.count("id"), F.count_distinct("id"), F.min("id"), F.max("id")).first() == (3_000_000, 3_000_000, 0, 2_999_999)


def grown_bindings(spark):
    """40 users with a binding each to a role of 50 permissions."""
    b = spark.range(40).select(F.col("id").alias("binding_id"), F.col("id").alias("user_id"), F.lit(1).cast("long").alias("role_id"), F.lit(None).cast("long").alias("service_id"), F.lit(None).cast("timestamp").alias("expires_at"))
    p = spark.range(50).select(F.lit(1).cast("long").alias("role_id"), (F.col("id") % 10).alias("service_id"), F.element_at(F.array(*map(F.lit, ["READ", "WRITE", "ADMIN", "DROP", "LIST"])), (F.col("id") / 10 + 1).cast("int")).alias("permission"))
    return access.effective(b.unionByName(b.withColumn("binding_id", F.col("binding_id") + 100)), p, F.lit("2024-01-01").cast("timestamp"))


def shares(df):
    """Rows of each task of the result."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_permissions_are_worked_on_so_many_at_once(spark, monkeypatch):
    """As the bindings grow tasks become more, not larger; grown rows aren't shuffled."""
    for most, tasks in ((100_000, 1), (200, 20)):
        monkeypatch.setattr(access, "ROWS_AT_ONCE", most)
        found = grown_bindings(spark)
        assert found.select("user_id", "service_id", "permission").distinct().count() == found.count() == 2000
        assert found.agg(F.min("binding_id"), F.max("binding_id")).first() == (0, 39)
        assert found._jdf.queryExecution().toRdd().getNumPartitions() == tasks
        assert max(shares(found)) <= (2000 if tasks == 1 else 500)


def test_rules_are_worked_on_so_many_at_once(spark, monkeypatch):
    monkeypatch.setattr(access, "ROWS_AT_ONCE", 200)
    found = access.rules(grown_bindings(spark).drop("binding_id"), {"READ": ["READ", "DESCRIBE"], "WRITE": ["WRITE", "DESCRIBE"]})
    assert found._jdf.queryExecution().toRdd().getNumPartitions() == 20
    assert found.count() == found.distinct().count() == 40 * 10 * 3 and max(shares(found)) <= 300


def test_grants_are_worked_on_so_many_at_once(spark, monkeypatch):
    monkeypatch.setattr(access, "ROWS_AT_ONCE", 200)
    names = spark.createDataFrame([("READ", "Select_priv"), ("WRITE", "Load_priv"), ("DROP", "Drop_priv")], "permission string, privilege string")
    found = access.grants(grown_bindings(spark), names, "service_id")
    assert found._jdf.queryExecution().toRdd().getNumPartitions() == 20
    assert found.count() == 400 and found.where("privileges = 'Drop_priv,Load_priv,Select_priv'").count() == 400 and max(shares(found)) <= 100


def many_role_perms(spark):
    """2000 users with a binding each to one of 11,000 roles, which have ten permissions each: more rows than are sent to every task."""
    b = spark.range(2000).select(F.col("id").alias("binding_id"), F.col("id").alias("user_id"), (F.col("id") * 5).alias("role_id"), F.lit(None).cast("long").alias("service_id"), F.lit(None).cast("timestamp").alias("expires_at"))
    p = spark.range(110_000).select((F.col("id") % 11_000).alias("role_id"), ((F.col("id") / 11_000).cast("int") % 2).alias("service_id"), F.element_at(F.array(*map(F.lit, ["READ", "WRITE", "ADMIN", "DROP", "LIST"])), (F.col("id") / 22_000 + 1).cast("int")).alias("permission"))
    return access.effective(b.unionByName(b.withColumn("binding_id", F.col("binding_id") + 10_000)), p, F.lit("2024-01-01").cast("timestamp"))


def tasks_of(spark, df):
    """Tasks of the result where Spark sends no table to every task by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        return df._jdf.queryExecution().toRdd().getNumPartitions()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rules_of_many_role_permissions_are_worked_on_so_many_at_once(spark, monkeypatch):
    """Tasks are as many as the grown rows ask for (40,000), not as the join by role leaves."""
    monkeypatch.setattr(access, "ROWS_AT_ONCE", 2000)
    found = access.rules(many_role_perms(spark).drop("binding_id"), {"READ": ["READ", "DESCRIBE"], "WRITE": ["WRITE", "DESCRIBE"]})
    assert tasks_of(spark, found) == 20
    assert found.count() == found.distinct().count() == 2000 * 2 * 3 and max(shares(found)) <= 1200


def test_grants_of_many_role_permissions_are_worked_on_so_many_at_once(spark, monkeypatch):
    monkeypatch.setattr(access, "ROWS_AT_ONCE", 2000)
    names = spark.createDataFrame([("READ", "Select_priv"), ("WRITE", "Load_priv"), ("DROP", "Drop_priv")], "permission string, privilege string")
    found = access.grants(many_role_perms(spark), names, "service_id")
    assert tasks_of(spark, found) == 20
    assert found.count() == 4000 and found.where("privileges = 'Drop_priv,Load_priv,Select_priv'").count() == 4000 and max(shares(found)) <= 400


def test_catalog_helpers(spark):
    tables.ensure_namespace(spark, "shop")
    tables.drop_table(spark, "shop.items")
    spark.range(3).write.saveAsTable("shop.items")
    assert tables.table_exists(spark, "shop.items") and tables.list_tables(spark, "shop") == ["items"]
    assert tables.describe(spark, "shop.items").first()["col_name"] == "id"
    tables.drop_table(spark, "shop.items")
    assert not tables.table_exists(spark, "shop.items")


def test_topic_calls():
    """What the topic connector, whose jar is not here, is asked for."""
    from unittest.mock import MagicMock

    spark = MagicMock()
    messages.read_topic(spark, "host:1", "changes")
    spark.readStream.format().options.assert_called_with(**{"kafka.bootstrap.servers": "host:1", "subscribe": "changes", "startingOffsets": "earliest"})
    rows = MagicMock()
    messages.produce(rows, "host:1")
    rows.write.format.assert_called_with("kafka")


def test_a_cluster_needs_a_shared_folder():
    from unittest.mock import MagicMock

    spark = MagicMock()
    spark.conf.get.return_value = None
    spark.sparkContext.getCheckpointDir.return_value = None
    spark.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        scratch(spark, "x")


def test_clear_removes_only_this_application(spark, tmp_path):
    from unittest.mock import patch

    with patch("lakeline.session.application_dir", lambda spark: f"file://{tmp_path}/own"):
        kept = stored(spark.range(3), "rows")
        assert kept.count() == 3 and len(list(tmp_path.rglob("*.parquet"))) > 0
        (tmp_path / "other").mkdir()
        clear(spark)
        clear(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]
    assert scratch(spark, "x").startswith(application_dir(spark) + "/") and spark.sparkContext.applicationId in application_dir(spark)


def test_small_is_counted(spark):
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small(spark.range(10), 10)).lower() and "broadcast" not in plan(small(spark.range(11), 10)).lower()
