"""Structured extraction: the fields of JSON texts by a declared schema, and their merge over windows of a document.

A schema maps a field's name to "string", "number", "integer", "boolean", "array" (of texts), or to a schema of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE = ("true", "yes", "1")


def _field(doc: Column, path: str, kind: str) -> Column:
    """The value at path, as its declared kind; null where it is missing or can't be read as that kind."""
    text = F.try_variant_get(doc, path, "string")
    if kind == "boolean":
        return F.lower(F.trim(text)).isin(*TRUE)
    if kind == "number":
        return F.trim(text).try_cast("double")
    if kind == "integer":  # numbers are cut off, texts must be whole numbers
        inner = F.try_variant_get(doc, path, "variant")
        return F.when(F.schema_of_variant(inner) == "STRING", F.trim(text).try_cast("bigint")).otherwise(F.try_variant_get(doc, path, "double").try_cast("bigint"))
    if kind == "array":
        return F.filter(F.try_variant_get(doc, path, "array<string>"), lambda x: x.isNotNull())
    if kind == "string":
        return text
    raise ValueError(f"unknown kind of field: {kind}")


def _path(path: str, name: str) -> str:
    if "'" in name or "]" in name:
        raise ValueError(f"not allowed in a field's name: {name}")
    return f"{path}['{name}']"


def _struct(doc: Column, schema: dict, path: str = "$") -> list[Column]:
    out = []
    for name, kind in schema.items():
        at = _path(path, name)
        if isinstance(kind, dict):
            value = F.struct(*_struct(doc, kind, at))
        else:
            value = _field(doc, at, kind)
            value = F.coalesce(value, F.array().cast("array<string>")) if kind == "array" else value
        out.append(value.alias(name))
    return out


def validate(rows: DataFrame, schema: dict, data: str = "data") -> DataFrame:
    """rows with the column `fields`: the declared fields of the JSON text in `data`.

    Undeclared fields are dropped. Lists that are missing or no lists are empty; texts that are no JSON have all fields
    null (lists empty). Null items of lists are dropped.
    """
    return rows.withColumn("fields", F.struct(*_struct(F.try_parse_json(F.col(data)), schema)))


def _merged(doc: Column, order: str, schema: dict, path: str = "$") -> list[Column]:
    out = []
    for name, kind in schema.items():
        at = _path(path, name)
        if isinstance(kind, dict):
            value = F.struct(*_merged(doc, order, kind, at))
        else:
            v = _field(doc, at, kind)
            seen = F.when(v.isNotNull(), F.struct(F.col(order).alias("o"), v.alias("v")))
            value = F.flatten(F.transform(F.array_sort(F.collect_list(seen)), lambda x: x["v"])) if kind == "array" else F.max(seen)["v"]
        out.append(value.alias(name))
    return out


def merge(windows: DataFrame, schema: dict, key: str = "doc_id", order: str = "win", data: str = "data") -> DataFrame:
    """(key, fields): one document's windows merged in order.

    Nulls change nothing, the last scalar wins, lists are appended, objects are merged field by field. Of windows that
    are equal in order, the greatest value counts as the last. Scalars are combined before the shuffle.
    """
    return windows.groupBy(key).agg(F.struct(*_merged(F.try_parse_json(F.col(data)), order, schema)).alias("fields"))
