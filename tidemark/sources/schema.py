"""Column properties, type limits and checks of written rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that a Parquet fragment cannot hold.
UNSTORABLE = (T.NullType, T.CalendarIntervalType)


def _column(schema: T.StructType, name: str) -> T.DataType:
    if name not in schema.names:
        raise ValueError(f"property for an unknown column {name}")
    return schema[name].dataType


def check_properties(schema: T.StructType, properties: dict[str, str]) -> None:
    """Refuse bad column properties; unknown suffixes are left alone.

    ``<col>.arrow.fixed-size-list.size``, ``<col>.arrow.float16`` and
    ``<col>.arrow.fixed-size-binary.byte-width`` describe how a column is stored.
    """
    for f in schema:
        if isinstance(f.dataType, UNSTORABLE):
            raise ValueError(f"{f.name}: {f.dataType.simpleString()} cannot be stored")
    for key, value in properties.items():
        column, _, rest = key.partition(".arrow.")
        if not rest:
            continue
        if rest == "fixed-size-list.size":
            kind = _column(schema, column)
            if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
                raise ValueError(f"{column} must be an array of float or double")
            if not str(value).isdigit() or int(value) < 1:
                raise ValueError(f"bad size {value}")
        elif rest == "float16":
            if str(value).lower() == "true" and f"{column}.arrow.fixed-size-list.size" not in properties:
                raise ValueError(f"{column}: float16 needs a fixed size")
        elif rest == "fixed-size-binary.byte-width":
            if not isinstance(_column(schema, column), T.BinaryType):
                raise ValueError(f"{column} must be binary")
            if not str(value).isdigit() or not 1 <= int(value) < 2**31:
                raise ValueError(f"bad width {value}")


def check_rows(df: DataFrame, schema: T.StructType, properties: dict[str, str]) -> DataFrame:
    """Rows as the table's columns (by name, or by position for unnamed VALUES columns), checked as they are written."""
    if len(df.columns) != len(schema.names):
        raise ValueError(f"{len(df.columns)} columns for a table of {len(schema.names)}")
    if all(c.startswith("col") and c[3:].isdigit() for c in df.columns):
        df = df.toDF(*schema.names)
    if missing := set(schema.names) - set(df.columns):
        raise ValueError(f"missing columns {sorted(missing)}")
    out = []
    for f in schema:
        value = F.col(f"`{f.name}`").cast(f.dataType) if df.schema[f.name].dataType != f.dataType else F.col(f"`{f.name}`")
        size = properties.get(f"{f.name}.arrow.fixed-size-list.size")
        width = properties.get(f"{f.name}.arrow.fixed-size-binary.byte-width")
        if size:
            value = F.when(value.isNull() | (F.size(value) == int(size)), value).otherwise(F.raise_error(F.lit(f"{f.name}: not {size} values")).cast(f.dataType))
        if width:
            value = F.when(value.isNull() | (F.octet_length(value) == int(width)), value).otherwise(F.raise_error(F.lit(f"{f.name}: not {width} bytes")).cast(f.dataType))
        if not f.nullable and df.schema[f.name].nullable:
            value = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{f.name} must not be null")).cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(*out)
