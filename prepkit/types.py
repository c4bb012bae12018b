"""Column roles: one typed predicate per role, decided on the driver from ``df.schema``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Accepted names of the type conversion and the Spark types they stand for.
CAST_TARGETS = {
    "int": "bigint",
    "int64": "bigint",
    "int32": "int",
    "int16": "smallint",
    "float": "double",
    "float64": "double",
    "float32": "float",
    "str": "string",
    "string": "string",
    "utf8": "string",
    "bool": "boolean",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
}

_ATOMIC = (
    T.NumericType,
    T.StringType,
    T.BooleanType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_integer(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.IntegralType)


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def is_atomic(data_type: T.DataType) -> bool:
    """Types whose values survive a cast to string and back."""
    return isinstance(data_type, _ATOMIC)


def has_map(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.MapType):
        return True
    if isinstance(data_type, T.ArrayType):
        return has_map(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return any(has_map(f.dataType) for f in data_type.fields)
    return False


def role(data_type: T.DataType) -> str:
    """``numeric``, ``text`` or ``other``."""
    if is_numeric(data_type):
        return "numeric"
    return "text" if is_text(data_type) else "other"


def columns_where(df: DataFrame, predicate) -> list[str]:
    return [f.name for f in df.schema.fields if predicate(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_where(df, is_numeric)


def text_columns(df: DataFrame) -> list[str]:
    return columns_where(df, is_text)


def roles(df: DataFrame) -> dict[str, str]:
    return {f.name: role(f.dataType) for f in df.schema.fields}
