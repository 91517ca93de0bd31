"""Schemas as data: alignment, differences, evolution, compatibility, granted columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Type changes that keep every value.
WIDER = {("int", "bigint"), ("int", "float"), ("int", "double"), ("bigint", "float"), ("bigint", "double"), ("float", "double"), ("smallint", "int"), ("smallint", "bigint"), ("tinyint", "int"), ("date", "timestamp")}


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly the schema's columns, in its order and types; missing ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def difference(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """old, new: (.. keys, name, type). Rows (.. keys, name, change, old_type, new_type) where they differ."""
    on = [*(keys or []), "name"]
    both = old.select(*on, F.col("type").alias("old_type")).join(new.select(*on, F.col("type").alias("new_type")), on, "full_outer")
    change = F.when(F.col("old_type").isNull(), "add").when(F.col("new_type").isNull(), "remove").when(F.col("old_type") != F.col("new_type"), "modify")
    return both.withColumn("change", change).where("change is not null").select(*on, "change", "old_type", "new_type")


def compatible(diff: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """Per key whether readers of the new version can read the old one: additions need a default, types may only widen."""
    wide = F.lit(False)
    for a, b in sorted(WIDER):
        wide = wide | ((F.col("old_type") == a) & (F.col("new_type") == b))
    judged = diff.join(defaults.select(*keys, "name", F.lit(True).alias("has_default")), [*keys, "name"], "left")
    bad = F.when(F.col("change") == "add", F.coalesce("has_default", F.lit(False)) == F.lit(False)).when(F.col("change") == "modify", ~wide).otherwise(F.lit(False))
    return judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_changes"), F.count_if(bad).alias("n_breaking")).withColumn("compatible", F.col("n_breaking") == 0)


def evolve(df: DataFrame, changes: list[tuple]) -> DataFrame:
    """changes: ("add", name, type), ("drop", name), ("widen", name, type), ("rename", name, new name). A repeated add is no error; a narrowing is."""
    for kind, name, *rest in changes:
        types = dict(df.dtypes)
        if kind == "add":
            df = df if name in types else df.withColumn(name, F.lit(None).cast(rest[0]))
        elif kind == "drop":
            df = df.drop(name)
        elif kind == "rename":
            df = df.withColumnRenamed(name, rest[0])
        elif kind == "widen":
            grows = types[name].startswith("decimal") and rest[0].startswith("decimal")
            if types[name] != rest[0] and (types[name], rest[0]) not in WIDER and not grows:
                raise ValueError(f"{name}: {types[name]} can't become {rest[0]} without loss")
            df = df.withColumn(name, F.col(name).cast(rest[0]))
        else:
            raise ValueError(f"unknown change: {kind}")
    return df


def changes_of(rows: DataFrame) -> list[tuple[int, list[tuple]]]:
    """Change rows of one subject (seq, name, change, old_type, new_type), a few per schema version, as (seq, changes for evolve) in order of seq."""
    kinds = {"add": "add", "remove": "drop", "modify": "widen"}
    found: dict[int, list[tuple]] = {}
    for r in rows.orderBy("seq", "name").collect():
        found.setdefault(r["seq"], []).append((kinds[r["change"]], r["name"], *([] if r["change"] == "remove" else [r["new_type"]])))
    return sorted(found.items())


def evolved(parts: list[tuple[int, DataFrame]], changes: list[tuple[int, list[tuple]]]) -> DataFrame:
    """One table of parts that were written under schema versions (seq, rows): each part goes through the changes after its own
    version when it is read, so no stored row is rewritten."""
    whole = None
    for seq, part in parts:
        for at, own in changes:
            part = evolve(part, own) if at > seq else part
        whole = part if whole is None else whole.unionByName(part)
    return whole


def governed_select(df: DataFrame, granted: list[str], columns: list[str]) -> DataFrame:
    """Selects columns if all are granted; `*` only if every column is."""
    wanted = df.columns if columns == ["*"] else columns
    denied = sorted(set(wanted) - set(granted))
    if denied:
        raise PermissionError(f"no grant on {', '.join(denied)}")
    return df.select(*wanted)
