"""Merge functions over values of a fixed schema, as column expressions.

A null field of a struct means that the key is absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def remove(existing: Column, new: Column) -> Column:
    """No value, whatever there was."""
    return F.lit(None)


def replace(existing: Column, new: Column) -> Column:
    return new


def top_level_merge(existing: Column, new: Column, kind: DataType) -> Column:
    """Union of two maps' keys, the new one's values winning; not recursive."""
    if isinstance(kind, StructType):
        both = F.struct(*[F.coalesce(new[f.name], existing[f.name]).alias(f.name) for f in kind.fields])
    elif isinstance(kind, MapType):
        both = F.map_zip_with(existing, new, lambda k, a, b: F.coalesce(b, a))
    else:
        raise TypeError(f"top_level_merge needs map values on both sides, not {kind.simpleString()}")
    return F.when(existing.isNull(), new).when(new.isNull(), F.lit(None)).otherwise(both)


def deep_merge(existing: Column, new: Column, kind: DataType) -> Column:
    """Recursive merge: maps by key, arrays by index, other values replaced; a null on one side yields the other."""
    if isinstance(kind, StructType):
        both = F.struct(*[deep_merge(existing[f.name], new[f.name], f.dataType).alias(f.name) for f in kind.fields])
    elif isinstance(kind, MapType):
        both = F.map_zip_with(existing, new, lambda k, a, b: deep_merge(a, b, kind.valueType))
    elif isinstance(kind, ArrayType):
        both = F.zip_with(existing, new, lambda a, b: deep_merge(a, b, kind.elementType))
    else:
        return F.coalesce(new, existing)
    return F.when(existing.isNull(), new).when(new.isNull(), existing).otherwise(both)
