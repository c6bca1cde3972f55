"""Workflow graphs over rows: every row is one execution, every block a column with what it put out."""

from __future__ import annotations

import functools
import graphlib
import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Block:
    """make: from the rows, with the columns of the blocks before, to this block's output; a condition's is its route."""

    id: str
    make: Callable[[DataFrame], Column]
    enabled: bool = True


@dataclass(frozen=True)
class Edge:
    """From block to block; with a condition, only for rows where the source's output is that text."""

    source: str
    target: str
    condition: str | None = None


def order(blocks: Sequence[Block], edges: Sequence[Edge]) -> list[str]:
    """Ids in topological order, first come, first served; a cycle raises ValueError, an unknown block KeyError."""
    graph = graphlib.TopologicalSorter({b.id: () for b in blocks})
    known = {b.id for b in blocks}
    for e in edges:
        if {e.source, e.target} - known:
            raise KeyError(f"no such block: {e}")
        graph.add(e.target, e.source)
    graph.prepare()
    out = list(graph.get_ready())
    for name in out:  # grows as blocks become ready
        graph.done(name)
        out += graph.get_ready()
    return out


def execute(rows: DataFrame, blocks: Sequence[Block], edges: Sequence[Edge]) -> DataFrame:
    """rows with one column per block, named by its id, in topological order.

    A block runs for a row where it is enabled and has no edge into it, or where any such edge holds: its source put
    something out, and the edge's condition, if any, is that output as text. Where a block doesn't run, or fails in a way
    that gives null, its column is null, and so it has put out nothing. Blocks are expressions, so Catalyst plans the whole
    graph as projections of one pass.
    """
    if clash := {b.id for b in blocks} & set(rows.columns):
        raise ValueError(f"columns named like blocks: {sorted(clash)}")
    by, out = {b.id: b for b in blocks}, rows
    for name in order(blocks, edges):
        into = [e for e in edges if e.target == name]
        holds = [out[f"`{e.source}`"].isNotNull() if e.condition is None else F.coalesce(out[f"`{e.source}`"].cast("string") == e.condition, F.lit(False)) for e in into]
        runs = F.lit(by[name].enabled) if not holds else F.lit(by[name].enabled) & functools.reduce(operator.or_, holds)
        out = out.withColumn(name, F.when(runs, by[name].make(out)))
    return out


def events(done: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """The blocks that put something out, one row each: key, block_id and seq, the place among those of the row, from 1."""
    ran = F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), F.lit(n)) for n in names]))
    return done.select(key, F.posexplode(ran).alias("seq", "block_id")).select(key, "block_id", (F.col("seq") + 1).cast("bigint").alias("seq"))
