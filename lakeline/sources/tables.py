"""Reading, discovering, numbering and writing tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeline.session import scratch, small, stored

#: Target size of a written file.
FILE_BYTES = 256 << 20


def table_path(base: str, namespace: str, name: str) -> str:
    return f"{base.rstrip('/')}/{namespace.lower()}/{name.lower()}"


def read_table(spark: SparkSession, base: str, name: str, namespace: str | None = None) -> DataFrame:
    """A table below a base folder; with a namespace, of the two-level layout base/namespace/table."""
    return spark.read.parquet(table_path(base, namespace, name) if namespace else f"{base}/{name}.parquet")


def read_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query that the source database runs itself (its driver's jar must be present)."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **properties: str) -> DataFrame:
    """A database table in parallel ranges of one column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def key_range(spark: SparkSession, url: str, table: str, column: str, **options: str) -> tuple[int, int] | None:
    """The least and largest value of a database table's column, which the database itself finds; None for a table without any."""
    low, high = read_query(spark, url, f"select min({column}) as low, max({column}) as high from {table}", **options).first()
    return None if low is None else (int(low), int(high))


def read_split(spark: SparkSession, url: str, table: str, column: str, parts: int, **properties: str) -> DataFrame:
    """A database table in parallel ranges between its column's ends; rows without a value come with the first range. New rows beyond the ends come too."""
    ends = key_range(spark, url, table, column, **properties) or (0, 0)
    return read_jdbc(spark, url, table, column, ends[0], ends[1] + 1, parts, **properties)


def execute(spark: SparkSession, url: str, *statements: str) -> int:
    """Statements in one transaction of a database, from the driver; returns how many rows they changed."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        changed = sum(statement.executeUpdate(s) for s in statements)
        connection.commit()
        return changed
    finally:
        connection.rollback()
        connection.close()


def database_sink(url: str, table: str, column: str = "batch", **properties: str) -> Callable[[DataFrame, int], None]:
    """A sink for numbered batches: rows go to a database table with the batch's number in a column; what the table has of that batch is replaced."""

    def write(batch: DataFrame, number: int) -> None:
        execute(batch.sparkSession, url, f"delete from {table} where {column} = {int(number)}")
        batch.withColumn(column, F.lit(int(number)).cast("long")).write.jdbc(url, table, mode="append", properties=properties)

    return write


def probe_schema(df: DataFrame) -> StructType:
    return df.limit(0).schema


def discover_tables(inventory: DataFrame) -> DataFrame:
    """inventory: (table_name, table_type, ..). Names of base tables in lower case, sorted."""
    return inventory.where(F.col("table_type") == "BASE TABLE").select(F.lower("table_name").alias("table_name")).distinct().orderBy("table_name")


def table_sizes(tables: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each table's size in GB from inventory (table_name, active_bytes); 0 where it is missing."""
    gb = inventory.groupBy(F.lower("table_name").alias("table_name")).agg((F.sum("active_bytes") / F.lit(1 << 30)).alias("gb"))
    return tables.join(gb, "table_name", "left").select("table_name", F.coalesce("gb", F.lit(0.0)).alias("size_gb"))


def stored_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows (table_name, n_files, n_bytes, size_gb) of stored tables (name: path) and, with a null name, of all together.

    Sizes come from the listing of the files; none is opened.
    """
    found = None
    for name, path in paths.items():
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        one = listed.select(F.lit(name).alias("table_name"), F.col("length"))
        found = one if found is None else found.unionByName(one)
    sums = found.rollup("table_name").agg(F.count("length").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
    return sums.withColumn("size_gb", F.col("n_bytes") / F.lit(1 << 30))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with row_no (from 0, in the key's order) and batch_no = row_no // size.

    Rows are range-partitioned and numbered inside partitions; only one count per partition is summed up. The numbered
    partitions are stored first, so that counts and rows are those of one evaluation.
    """
    places = {"_lakeline_part": F.spark_partition_id(), "_lakeline_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    ordered = stored(df.repartitionByRange(key).sortWithinPartitions(key).withColumns(places), "ordered")
    counts = ordered.groupBy("_lakeline_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_lakeline_part", (F.sum("_n").over(Window.orderBy("_lakeline_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_lakeline_before"))
    numbered = ordered.join(small(before), "_lakeline_part").withColumn("row_no", F.coalesce("_lakeline_before", F.lit(0)) + F.col("_lakeline_at"))
    return numbered.withColumn("batch_no", F.floor(F.col("row_no") / size)).drop(*places, "_lakeline_before")


def with_audit(df: DataFrame, batch: F.Column, row: F.Column, as_of: F.Column | None = None) -> DataFrame:
    """Adds snap_id, unique over all batches, and snap_timestamp, each only where it is absent."""
    if "snap_id" not in df.columns:
        df = df.withColumn("snap_id", batch.cast("long") * F.lit(1 << 40) + row.cast("long"))
    if "snap_timestamp" not in df.columns:
        df = df.withColumn("snap_timestamp", as_of if as_of is not None else F.current_timestamp())
    return df


def bucket(column: str, n: int) -> F.Column:
    whole = F.typeof(F.col(column)).isin("tinyint", "smallint", "int", "bigint")
    number = F.when(whole, F.col(column).cast("string").try_cast("bigint")).otherwise(F.xxhash64(column))
    return F.when(F.col(column).isNull(), 0).otherwise(F.pmod(number, F.lit(n))).cast("int")


def partition_columns(spec: list[str]) -> dict[str, F.Column]:
    """Columns for transforms such as `hours(ts)`, `bucket(4, id)`, `truncate(8, name)`, `identity(x)`; an unknown one is a ValueError.

    A bucket is a whole number, or the hash of a value of another type, modulo the number; nulls are bucket 0.
    """
    found = {}
    for text in spec:
        m = re.fullmatch(r"\s*(\w+)\(\s*(?:(\d+)\s*,\s*)?(\w+)\s*\)\s*", text)
        kind, n, column = m.groups() if m else (text, None, None)
        units = {"hours": "hour", "days": "day", "months": "month", "years": "year"}
        if kind in units and column:
            found[f"{column}_{units[kind]}"] = F.date_trunc(units[kind], F.col(column)).cast("timestamp_ntz")
        elif kind == "identity" and column:
            found[f"{column}_identity"] = F.col(column)
        elif kind == "bucket" and n:
            found[f"{column}_bucket"] = bucket(column, int(n))
        elif kind == "truncate" and n:
            found[f"{column}_trunc"] = F.substring(F.col(column).cast("string"), 1, int(n))
        else:
            raise ValueError(f"unknown partition transform: {text}")
    return found


def write_partitioned(df: DataFrame, spec: list[str], path: str, mode: str = "append", columns: dict[str, F.Column] | None = None) -> None:
    """Writes Parquet in folders by the transforms; rows of one folder are brought together first."""
    own = columns or partition_columns(spec)
    df.withColumns(own).hint("rebalance", *[F.col(c) for c in own]).write.mode(mode).partitionBy(*own).parquet(path)


def write_sized(df: DataFrame, path: str, file_bytes: int = FILE_BYTES, mode: str = "append") -> None:
    """Writes Parquet in files of about file_bytes: as many as the bytes ask for that the rows took when they were stored on the way.

    The stored rows are read in splits of a sixteenth of a file, which are put together without a shuffle, so that rows stay beside
    those they were stored with and compress as well as before. The size of the splits is set in a session of its own.
    """
    spark, once = df.sparkSession.newSession(), scratch(df.sparkSession, "sized")
    split = max(1, file_bytes // 16)
    df.write.option("parquet.block.size", split).parquet(once)
    for key, value in {"maxPartitionBytes": split, "openCostInBytes": 0, "minPartitionNum": 1}.items():
        spark.conf.set(f"spark.sql.files.{key}", str(value))
    total = stored_sizes(spark, {"once": once}).where("table_name is null").first()["n_bytes"]
    spark.read.schema(df.schema).parquet(once).coalesce(max(1, round(total / file_bytes))).write.mode(mode).parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A table whose appended files may have more columns than the first ones."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def insert_select(spark: SparkSession, target: DataFrame, rows: DataFrame) -> DataFrame:
    """The target with rows after it, matched by name, missing columns null."""
    return target.unionByName(rows, allowMissingColumns=True)


def seed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def register(df: DataFrame, view: str) -> None:
    df.createOrReplaceTempView(view)


def dual_write(row: DataFrame, path: str, also) -> None:
    """Writes a control row to the lake and hands the same row, evaluated once, to a second sink."""
    once = stored(row, "control")
    once.write.mode("append").parquet(path)
    also(once)


def ensure_namespace(spark: SparkSession, namespace: str) -> None:
    quoted = namespace.replace("`", "``")
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS `{quoted}`")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", {"name": name})


def describe(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql("DESCRIBE IDENTIFIER(:name)", {"name": name})


def list_tables(spark: SparkSession, namespace: str) -> list[str]:
    """The namespace's tables; a session's temporary views are in no namespace."""
    return sorted(t.name for t in spark.catalog.listTables(namespace) if not t.isTemporary)


def capped(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The feature of ad-hoc results: no more than so many rows."""
    return df.limit(rows)
