"""Values that pass between the blocks of a workflow: references in templates, and mappings onto inputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

# Fixed value: a reference has a dot; its first part may have blanks and hyphens.
_REF = re.compile(r"<([\w -]+\.[\w.]+)>")


def resolve(rows: DataFrame, ref: str) -> Column | None:
    """The column or nested field that a dotted reference names, or None where rows have no such one."""
    schema, out = rows.schema, None
    for part in ref.split("."):
        if not isinstance(schema, StructType) or part not in schema.names:
            return None
        out = rows[f"`{part}`"] if out is None else out.getField(part)
        schema = schema[part].dataType
    return out if not isinstance(schema, StructType) else F.to_json(out)


def template(rows: DataFrame, source: str) -> Column:
    """source with every <block.reference> replaced; unknown ones and those without a dot stay as written.

    Nulls read None, truth values True and False.
    """
    parts, end = [], 0
    for m in _REF.finditer(source):
        value = resolve(rows, m[1])
        if value is None:
            continue
        text = value.cast("string")
        if isinstance(rows.select(value).schema[0].dataType, BooleanType):
            text = F.initcap(text)
        parts += [F.lit(source[end : m.start()]), F.coalesce(text, F.lit("None"))]
        end = m.end()
    return F.concat(*parts, F.lit(source[end:]))


def resolved(rows: DataFrame, value: object) -> Column:
    """A nested value of dicts, lists and texts with its references filled.

    A text that is one reference alone becomes the column itself, of its type; dicts become structs, lists arrays (of JSON
    texts where their entries differ in type), and all else a literal.
    """
    if isinstance(value, str):
        m = _REF.fullmatch(value)
        whole = resolve(rows, m[1]) if m else None
        return whole if whole is not None else template(rows, value)
    if isinstance(value, dict):
        return F.struct(*[resolved(rows, v).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        parts = [resolved(rows, v) for v in value]
        kinds = {rows.select(x).schema[0].dataType.simpleString() for x in parts}
        return F.array(*parts) if len(kinds) <= 1 else F.array(*[F.to_json(F.struct(x.alias("v"))) for x in parts])
    return F.lit(value)


def map_inputs(rows: DataFrame, mappings: list[tuple[str, str]]) -> DataFrame:
    """rows with the targets of mappings (reference, target) filled.

    A target that has a text keeps it. Several references for one target are joined by line feeds; those that are
    missing or null are left out, and with none left the target stays. A reference that is no field of its block is
    looked up in the block's field `output`.
    """
    sources: dict[str, list[Column]] = {}
    for ref, target in mappings:
        block, _, field = ref.partition(".")
        value = resolve(rows, ref)
        value = resolve(rows, f"{block}.output.{field}") if value is None and field else value
        if value is not None:
            sources.setdefault(target, []).append(value.cast("string"))
    out = rows
    for target, values in sources.items():
        new = F.when(F.greatest(*[v.isNotNull() for v in values], F.lit(False)), F.concat_ws("\n", *values))
        own = rows[f"`{target}`"].cast("string") if target in rows.columns else F.lit(None).cast("string")
        out = out.withColumn(target, F.when(F.trim(own) != "", own).otherwise(F.coalesce(new, own)))
    return out
