"""Reads and writes of a real database: the one that Spark brings, in the memory of the local session."""

import itertools

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lakeline.operators import audits, history
from lakeline.session import scratch
from lakeline.sources import tables
from lakeline.streaming import jobs

NUMBERS = itertools.count()


@pytest.fixture
def url(spark):
    """A new database with a table of 1000 accounts, a few without a key."""
    found = f"jdbc:derby:memory:lakeline{next(NUMBERS)};create=true"
    rows = spark.range(1000).select(F.when(F.col("id") % 100 != 99, F.col("id") * 3 + 7).alias("ID"), F.concat(F.lit("name "), F.col("id") % 13).alias("NAME"), (F.col("id") / 4).alias("AMOUNT"))
    # the database takes names that are not quoted for upper case
    rows.write.option("createTableColumnTypes", "NAME varchar(40)").jdbc(found, "accounts")
    return found


def test_the_database_runs_the_query(spark, url):
    found = tables.read_query(spark, url, "select name, count(*) as n from accounts where amount >= 100 group by name")
    assert {r["NAME"]: r["N"] for r in found.collect()} == {f"name {k}": sum(i % 13 == k for i in range(400, 1000)) for k in range(13)}
    assert [f.name for f in tables.probe_schema(found).fields] == ["NAME", "N"]


def test_ranges_bring_every_row_once(spark, url):
    assert tables.key_range(spark, url, "accounts", "id") == (7, 998 * 3 + 7)
    for parts in (1, 7):
        rows = tables.read_split(spark, url, "accounts", "id", parts)
        assert rows.rdd.getNumPartitions() == parts
        assert sorted(r["AMOUNT"] for r in rows.collect()) == [i / 4 for i in range(1000)]
    # bounds only part the ranges: rows beyond them come too
    assert tables.read_jdbc(spark, url, "accounts", "id", 500, 900, 5).count() == 1000
    tables.execute(spark, url, "delete from accounts")
    assert tables.key_range(spark, url, "accounts", "id") is None and tables.read_split(spark, url, "accounts", "id", 4).count() == 0


def test_a_copy_that_was_cut_off_is_resumed(spark, url):
    """A database table into the lake, range by range, with a ledger; then what the ledger leaves; both sides' fingerprints are equal."""
    path, source = scratch(spark, "copy"), tables.read_split(spark, url, "accounts", "id", 4).where("id is not null")
    kind = "name string, start long, stop long"
    wanted = spark.createDataFrame([("accounts", 7, 998 * 3 + 8)], kind)
    ledger = [("accounts", 0, 900), ("accounts", 600, 1500), ("accounts", 2500, 2600)]
    tables.append(source.where("id < 1500 or id between 2500 and 2599"), path)
    gaps = history.range_gaps(wanted, spark.createDataFrame(ledger, kind), ["name"])
    assert sorted((g["start"], g["stop"]) for g in gaps.collect()) == [(1500, 2500), (2600, 998 * 3 + 8)]
    rest = history.in_ranges(source.withColumnRenamed("name", "who").withColumn("name", F.lit("accounts")), gaps, ["name"], "id")
    tables.append(rest.drop("name").withColumnRenamed("who", "name").select(*source.columns), path)
    assert audits.same_rows(source, spark.read.schema(source.schema).parquet(path))


def test_lake_and_database_get_each_batch_once(spark, url):
    """Dual write of a stream into a folder and a table of the database, which can't be reached at first and is cut off once after its write."""
    path, ledger, lake, offsets = (scratch(spark, n) for n in ("rows", "ledger", "lake", "offsets"))
    spark.range(30).withColumn("note", F.lit("x")).repartition(3).write.parquet(path)
    tables.execute(spark, url, "create table control (id bigint, note varchar(10), batch bigint)")
    write, faults = tables.database_sink(url, "control", "BATCH"), ["before", "after"]

    def shaky(batch, number):
        if faults[:1] == ["before"]:
            faults.pop(0)
            raise RuntimeError("the database can't be reached")
        write(batch.toDF("ID", "NOTE"), number)
        if faults:
            faults.pop(0)
            raise RuntimeError("cut off before the ledger")

    sinks = {"lake": jobs.batch_folder(lake), "database": shaky}
    run = lambda: jobs.each_batch(jobs.table_source(spark, path, "id long, note string", 1), lambda b, n: jobs.dual_write(b, n, ledger, sinks), offsets, seconds=None)
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            run()
    run()
    in_lake = spark.read.schema("id long, note string, batch long").parquet(lake)
    in_database = tables.read_jdbc(spark, url, "control", "id", 0, 30, 2)
    assert sorted(tuple(r) for r in in_lake.collect()) == sorted(tuple(r) for r in in_database.select("id", "note", "batch").collect()) and in_lake.count() == 30


def test_lake_joins_database(spark, url):
    orders = spark.range(3000).select((F.col("id") % 1500 * 3 + 7).alias("account"), F.lit(1).alias("n"))
    joined = orders.join(tables.read_split(spark, url, "accounts", "id", 3), F.col("account") == F.col("id")).groupBy("name").agg(F.sum("n").alias("n"))
    assert {r["name"]: r["n"] for r in joined.collect()} == {f"name {k}": 2 * sum(i % 13 == k and i % 100 != 99 for i in range(1000)) for k in range(13)}


def test_a_transaction_that_fails_changes_nothing(spark, url):
    with pytest.raises(Exception, match="NOTHERE"):
        tables.execute(spark, url, "delete from accounts", "delete from nothere")
    assert tables.read_query(spark, url, "select count(*) as n from accounts").first()[0] == 1000
