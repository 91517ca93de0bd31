"""Type names of source systems, and the Spark types they are stored as."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base type name to Spark type, by source family. `decimal` takes the name's arguments.
WAREHOUSE = {
    "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "NCHAR": "string", "STRING": "string", "VARIANT": "string", "OBJECT": "string", "ARRAY": "string", "BINARY": "string", "TIME": "string",
    "NUMBER": "decimal", "NUMERIC": "decimal", "DECIMAL": "decimal", "INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint", "BYTEINT": "tinyint",
    "FLOAT": "float", "FLOAT4": "float", "REAL": "float", "FLOAT8": "double", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date",
    "DATETIME": "timestamp", "TIMESTAMP": "timestamp", "TIMESTAMP_LTZ": "timestamp", "TIMESTAMP_NTZ": "timestamp", "TIMESTAMP_TZ": "timestamp",
}
DATABASE = {
    "NUMBER": "decimal", "DECIMAL": "decimal", "NUMERIC": "decimal", "INTEGER": "bigint", "SMALLINT": "smallint", "FLOAT": "double", "BINARY_DOUBLE": "double", "BINARY_FLOAT": "float",
    "BOOLEAN": "boolean", "DATE": "timestamp", "TIMESTAMP": "timestamp", "CLOB": "string", "VARCHAR2": "string", "VARCHAR": "string", "CHAR": "string", "NCHAR": "string", "NVARCHAR2": "string",
}
RECORD = {"int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "bytes": "binary", "string": "string", "timestamp-millis": "timestamp", "timestamp-micros": "timestamp", "date": "date"}


def map_type(name: str, family: str = "warehouse") -> str:
    """The Spark type for a source type's name; string for an unknown one."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?.*", name)
    base, precision, scale = m.groups() if m else ("", None, None)
    found = {"warehouse": WAREHOUSE, "database": DATABASE}[family].get(base.upper(), "string")
    if found == "decimal":
        return f"decimal({precision},{scale or 0})" if precision else "decimal(38,10)"
    return found


def map_record_type(kind) -> str:
    """The Spark type for a record schema's type: a name, a union (its first branch that is not null) or a logical type."""
    if isinstance(kind, list):
        return map_record_type(next((k for k in kind if k != "null"), "string"))
    if isinstance(kind, dict):
        logical = kind.get("logicalType")
        if logical == "decimal":
            return f"decimal({kind.get('precision', 38)},{kind.get('scale', 10)})"
        return RECORD.get(logical) or map_record_type(kind.get("type", "string"))
    return RECORD.get(kind, "string")


def cast_to(df: DataFrame, types: dict[str, str], family: str = "warehouse") -> DataFrame:
    """Casts columns to their source types' Spark types; a value that doesn't fit becomes null."""
    return df.withColumns({c: F.col(c).try_cast(map_type(t, family)) for c, t in types.items()})


def iso_utc(ts: Column) -> Column:
    """A timestamp as text: T between date and time, six digits, Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
