"""Column functions that read ids and numbers out of a model's answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def selected_ids(answer: Column) -> Column:
    """The node ids that an answer lists, in order.

    A JSON list, or the list in a JSON object's node_ids, is taken as it is, repeats included. In other texts, ids with a
    document (d0:0001) are looked for, then plain ones of four digits; each stays once. Null answers have none.
    """
    doc = F.try_parse_json(answer)
    listed = F.coalesce(F.try_variant_get(doc, "$", "array<string>"), F.try_variant_get(doc, "$.node_ids", "array<string>"))
    found = lambda p: F.array_distinct(F.regexp_extract_all(answer, F.lit(p), F.lit(1)))
    full = found(r"\b(d\d+:\d{4})\b")
    return F.coalesce(listed, F.when(F.size(full) > 0, full), found(r"\b(\d{4})\b"), F.array().cast("array<string>"))


def page_tag(text: Column) -> Column:
    """7 of `<physical_index_7>`; null where there is no such number."""
    return F.regexp_extract(text, r"physical_index_(\d+)", 1).try_cast("bigint")


def valid_index(index: Column, pages: Column, start: int = 1) -> Column:
    """The index where a document of so many pages, counted from start, has it; else null."""
    return F.when(index <= pages + (start - 1), index)
