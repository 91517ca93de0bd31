"""Messages and documents: topics, JSON lines, bulk files, synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A change topic as a stream, from its start (needs the Kafka connector's jar)."""
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}).load()


def as_messages(df: DataFrame, key: str, topic: str) -> DataFrame:
    """Rows (topic, key, value): the row as JSON, keyed."""
    return df.select(F.lit(topic).alias("topic"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def produce(messages: DataFrame, servers: str) -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def peek(messages: DataFrame, n: int = 10) -> DataFrame:
    """The first n messages by partition and offset."""
    return messages.orderBy("partition", "offset").limit(n)


def bulk_lines(df: DataFrame, index: str, id_col: str) -> DataFrame:
    """For each row the two lines of a bulk document file: action, then document."""
    action = F.concat(F.lit('{"index":{"_index":"'), F.lit(index), F.lit('","_id":"'), F.col(id_col).cast("string"), F.lit('"}}'))
    return df.select(F.col(id_col), F.concat_ws("\n", action, F.to_json(F.struct(*df.columns))).alias("value"))


def write_bulk(df: DataFrame, index: str, id_col: str, path: str) -> None:
    """Bulk document files: text, two lines a row, an action and its document one after the other."""
    bulk_lines(df, index, id_col).select("value").write.text(path)


def project_json(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """df with fields of a JSON text column: {name: type}."""
    schema = ", ".join(f"`{k}` {v}" for k, v in fields.items())
    parsed = F.from_json(F.col(column), schema)
    return df.withColumns({name: parsed[name] for name in fields})


def synthetic_events(spark: SparkSession, rows: int = 200_000, hours: int = 48, start: str = "2024-06-01 00:00:00") -> DataFrame:
    """Events derived from the row number on the executors: the same rows each time."""
    # fixed values: sources and event types
    h = lambda salt: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(1_000_003))
    one_of = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (h(salt) % len(values) + 1).cast("int"))
    return spark.range(rows).select(
        F.col("id").alias("event_id"), one_of(1, ["web", "mobile_ios", "mobile_android", "api"]).alias("source"), one_of(2, ["click", "purchase", "view", "add_to_cart", "checkout"]).alias("event_type"),
        (h(3) % 50_000 + 1).alias("user_id"), (0.99 + (h(4) % 49_900) / 100).alias("amount"), (F.lit(start).cast("timestamp") + F.make_interval(secs=h(5) % (hours * 3600))).cast("timestamp").alias("ts"),
        F.to_json(F.struct(h(6).alias("session"), F.lit(1).alias("v"))).alias("payload"),
    )


def synthetic_shop(spark: SparkSession, customers: int = 2_000_000) -> dict[str, DataFrame]:
    """Customers, products, orders, order_items, product_reviews and inventory_events in the proportions of a web shop."""
    sizes = {"customers": customers, "products": customers // 4, "orders": customers * 3 // 2, "order_items": customers * 7 // 2, "product_reviews": customers, "inventory_events": customers * 3 // 2}
    h = lambda salt, n: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(max(1, n))).cast("long")
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (h(salt, len(values)) + 1).cast("int"))
    day = lambda salt, n: F.date_sub(F.lit("2024-12-31").cast("date"), h(salt, n).cast("int")).cast("timestamp")
    base = {name: spark.range(1, n + 1) for name, n in sizes.items()}
    # fixed values: tiers, states of orders, kinds of inventory events
    return {
        "customers": base["customers"].select(F.col("id").alias("customer_id"), F.concat(F.lit("user"), F.col("id"), F.lit("@example.com")).alias("email"), pick(1, ["STANDARD", "SILVER", "GOLD", "PLATINUM"]).alias("tier"), F.when(F.col("id") % 50 == 0, "N").otherwise("Y").alias("is_active"), day(2, 1000).alias("created_at")),
        "products": base["products"].select(F.col("id").alias("product_id"), F.concat(F.lit("SKU-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("sku"), F.concat(F.lit("cat"), h(3, 10)).alias("category"), (h(4, 50_000) / 100 + 1).alias("unit_price"), h(5, 1000).cast("int").alias("stock_qty")),
        "orders": base["orders"].select(F.col("id").alias("order_id"), (h(6, customers) + 1).alias("customer_id"), pick(7, ["PENDING", "CONFIRMED", "SHIPPED", "DELIVERED", "CANCELLED", "RETURNED"]).alias("status"), (h(8, 100_000) / 100).alias("total_amount"), day(9, 730).alias("order_date")),
        "order_items": base["order_items"].select(F.col("id").alias("item_id"), (h(10, sizes["orders"]) + 1).alias("order_id"), (h(11, sizes["products"]) + 1).alias("product_id"), (h(12, 9) + 1).cast("int").alias("quantity"), (h(13, 50_000) / 100 + 1).alias("unit_price"), h(14, 31).cast("int").alias("discount_pct")),
        "product_reviews": base["product_reviews"].select(F.col("id").alias("review_id"), (h(15, sizes["products"]) + 1).alias("product_id"), (h(16, customers) + 1).alias("customer_id"), (h(17, 5) + 1).cast("int").alias("rating"), h(18, 1000).cast("int").alias("helpful_cnt")),
        "inventory_events": base["inventory_events"].select(F.col("id").alias("event_id"), (h(19, sizes["products"]) + 1).alias("product_id"), pick(20, ["RECEIPT", "SALE", "ADJUSTMENT", "RETURN", "TRANSFER", "WRITE_OFF"]).alias("event_type"), (h(21, 200) - 100).cast("int").alias("delta_qty"), (h(22, 50) + 1).cast("int").alias("warehouse_id"), day(23, 365).alias("event_at")),
    }
