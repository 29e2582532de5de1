"""Content of any shape to text: values only, in order, joined by a space."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(column: Column, kind: T.DataType) -> Column:
    """Text of a typed column, built from its type when the plan is made. Null is empty;
    keys are never read; whole numbers have no decimal point."""
    if isinstance(kind, T.StringType):
        text = column
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        text = F.when(whole, column.cast("bigint").cast("string")).otherwise(column.cast("string"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat_ws(" ", F.transform(column, lambda x: flatten(x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        text = F.concat_ws(" ", F.transform(F.map_values(column), lambda x: flatten(x, kind.valueType)))
    elif isinstance(kind, T.StructType):
        text = F.concat_ws(" ", *(flatten(column.getField(f.name), f.dataType) for f in kind.fields))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(""))


def flatten_value(value) -> str:
    """Text of a parsed JSON value. As in JavaScript, keys that are array indexes come first."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    if isinstance(value, list):
        return " ".join(map(flatten_value, value))
    if isinstance(value, dict):
        index = sorted((k for k in value if k.isdigit() and str(int(k)) == k), key=int)
        return " ".join(flatten_value(value[k]) for k in [*index, *(k for k in value if k not in set(index))])
    return str(value)


def _flattened(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else flatten_value(json.loads(x)))


def flatten_json(column: Column) -> Column:
    """Text of raw JSON; null stays null. For content without a schema, where Spark's own
    JSON types would lose the order of keys and mix up strings and objects."""
    return F.pandas_udf(_flattened, T.StringType())(column)
