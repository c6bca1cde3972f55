"""Section trees as rows: headers, parents, ranges of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def headers(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): line_num (from 1), level and title of each ATX header outside fenced code."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    run = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.sum(F.when(F.col("line").startswith("```"), 1).otherwise(0)).over(run) % 2 == 0
    out = lines.withColumn("open", open_).where(F.col("open") & F.col("line").rlike(r"^#{1,6}\s+\S"))
    return out.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_num"), F.length(F.regexp_extract("line", "^(#+)", 1)).cast("bigint").alias("level"), F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1).alias("title"))


def section_text(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with the text from their header up to the next header of any level."""
    after = F.lead("line_num").over(Window.partitionBy("doc_id").orderBy("line_num"))
    d = nodes.withColumn("after", after).join(docs.select("doc_id", F.split("text", "\n").alias("lines")), "doc_id")
    n = F.coalesce("after", F.size("lines") + 1) - F.col("line_num")
    return d.select(*nodes.columns, F.regexp_replace(F.array_join(F.slice("lines", F.col("line_num").cast("int"), n.cast("int")), "\n"), r"^\s+|\s+$", "").alias("text"))


def node_ids(nodes: DataFrame) -> DataFrame:
    """nodes with pre-order numbers of four digits at least, from 0000."""
    n = (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_num")) - 1).cast("string")
    return nodes.withColumn("node_id", F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n))


def parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_line: the nearest header before with a smaller level. Levels are 6 at most: one running maximum each."""
    run = Window.partitionBy("doc_id").orderBy("line_num").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("line_num"))).over(run).alias(f"_{k}") for k in range(1, 6)]
    d = nodes.select("*", *last)
    above = F.greatest(F.lit(-1), *[F.when(F.col("level") > k, F.col(f"_{k}")) for k in range(1, 6)])
    return d.withColumn("parent_line", F.when(above > 0, above)).select(*nodes.columns, "parent_line")


def with_depth(nodes: DataFrame) -> DataFrame:
    """nodes with depth: the number of headers that are open above each, 5 at most. Levels may be skipped."""
    run = Window.partitionBy("doc_id").orderBy("line_num").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("line_num"))).over(run) for k in range(1, 6)}
    d = nodes.select("*", *[c.alias(f"_{k}") for k, c in last.items()])
    depth = F.lit(0)
    for k in range(1, 6):  # a header is still open if none of a smaller level has come after it
        closed = F.greatest(F.lit(-1), F.lit(-1), *[F.col(f"_{j}") for j in range(1, k)])
        depth = depth + F.when((F.col("level") > k) & (F.col(f"_{k}") > closed), 1).otherwise(0)
    return d.withColumn("depth", depth.cast("bigint")).select(*nodes.columns, "depth")


def add_offset(items: DataFrame, offsets: DataFrame) -> DataFrame:
    """items (doc_id, ..., page, physical_index) and offsets (doc_id, offset), one a document: known pages become indices.

    Where there is no offset, or no page, the item stays as it is.
    """
    d = items.join(offsets.select("doc_id", F.col("offset").alias("_o")), "doc_id", "left")
    moved = F.col("page").isNotNull() & F.col("_o").isNotNull()
    index = F.when(moved, F.col("page") + F.col("_o")).otherwise(F.col("physical_index"))
    return d.withColumns({"physical_index": index, "page": F.when(~moved, F.col("page"))}).select(*items.columns)


def toc_accuracy(items: DataFrame, pages: str) -> DataFrame:
    """items (doc_id, ord, physical_index, answer, <pages>): the share of answers `yes` among items with an index.

    It is 0 where no item has an index, or where the last that has one lies before the middle of the document.
    """
    known = F.col("physical_index").isNotNull()
    d = items.groupBy("doc_id").agg(F.max_by("physical_index", F.when(known, F.col("ord"))).alias("_last"), F.max(pages).alias("_n"), F.avg(F.when(known, F.coalesce(F.col("answer") == "yes", F.lit(False)).cast("int"))).alias("_share"))
    return d.select("doc_id", F.when(F.col("_last") >= F.col("_n") / 2, F.col("_share")).otherwise(F.lit(0.0)).alias("accuracy"))


def leaves(nodes: DataFrame) -> DataFrame:
    """nodes (with parent_line) that are no node's parent."""
    inner = nodes.where("parent_line IS NOT NULL").select("doc_id", F.col("parent_line").alias("line_num")).distinct()
    return nodes.join(inner, ["doc_id", "line_num"], "left_anti")


def subtree_sums(nodes: DataFrame, value: str) -> DataFrame:
    """nodes with the sum of `value` over their subtrees; each node's value goes to its ancestors, 6 at most."""
    run = Window.partitionBy("doc_id").orderBy("line_num").rowsBetween(Window.unboundedPreceding, 0)
    d = nodes.select("*", *[F.max(F.when(F.col("level") == k, F.col("line_num"))).over(run).alias(f"_{k}") for k in range(1, 7)])
    for k in range(2, 7):  # a header closes those of its level and below it
        above = F.greatest(F.lit(-1), *[F.col(f"_{j}") for j in range(1, k)])
        d = d.withColumn(f"_{k}", F.when(F.col(f"_{k}") > above, F.col(f"_{k}")))
    up = d.select("doc_id", value, F.explode(F.array_compact(F.array(*[F.col(f"_{k}") for k in range(1, 7)]))).alias("line_num"))
    return nodes.join(up.groupBy("doc_id", "line_num").agg(F.sum(value).alias("total")), ["doc_id", "line_num"])


def thin(nodes: list[tuple[int, int, str]], least: int, count) -> list[tuple[int, int, str]]:
    """Nodes (level, tokens of the subtree, text) in order, with subtrees of fewer than `least` tokens merged into their top.

    From the last node to the first: a node below `least` takes the texts of what is left of its subtree, and its tokens
    are then counted anew by count(text).
    """
    kept: list[tuple[int, int, str]] = []  # what is left behind the node, the nearest last
    for level, tokens, text in reversed(nodes):
        if tokens < least:
            own = []
            while kept and kept[-1][0] > level:
                own.append(kept.pop()[2])
            for more in (x for x in own if x.strip()):
                text += ("\n\n" if text and not text.endswith("\n") else "") + more
            if any(x.strip() for x in own):
                tokens = count(text)
        kept.append((level, tokens, text))
    return kept[::-1]


def thinned(nodes: DataFrame, least: int) -> DataFrame:
    """nodes (doc_id, line_num, level, text, tokens): thin() for each document; tokens are counted by white space.

    A document's nodes meet in one row; documents are independent of each other.
    """
    d = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_num", "level", "tokens", F.coalesce("text", F.lit("")).alias("text")))).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], [[], [], [], []]
            for i, n in enumerate(batch.column(1)):
                n = n.as_py()
                left = thin([(_Level(x["level"], x["line_num"]), x["tokens"], x["text"]) for x in n], least, lambda t: len(t.split()))
                for level, tokens, text in left:
                    at.append(i)
                    for c, x in zip(cols, (level.line, int(level), tokens, text), strict=True):
                        c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "line_num", "level", "tokens", "text"])

    return d.mapInArrow(run, f"doc_id {dict(nodes.dtypes)['doc_id']}, line_num bigint, level bigint, tokens bigint, text string")


class _Level(int):
    """A level that knows its line."""

    def __new__(cls, level: int, line: int):
        out = super().__new__(cls, level)
        out.line = line
        return out


def page_ranges(items: DataFrame, last: str) -> DataFrame:
    """items (doc_id, ord, physical_index, appear_start, <last>) with end_index: up to the next item's page, or the one before."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    after = F.lead("physical_index").over(w) - F.when(F.lead("appear_start").over(w) == "yes", 1).otherwise(0)
    return items.withColumn("end_index", F.coalesce(after, F.col(last)))


def range_text(ranges: DataFrame, pages: DataFrame, glue: str = "") -> DataFrame:
    """ranges (doc_id, ord, a, b) with the text of pages a to b: ranges are unrolled, so the join is an equi-join."""
    r = ranges.withColumn("page", F.explode(F.when(F.col("a") <= F.col("b"), F.sequence("a", "b"))))
    j = r.join(pages, ["doc_id", "page"]).groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return j.select("doc_id", "ord", F.array_join(F.transform("p", lambda x: x["text"]), glue).alias("text"))


def page_offset(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, pos, page, physical): the most frequent physical - page; ties go to the first seen."""
    d = pairs.groupBy("doc_id", (F.col("physical") - F.col("page")).alias("diff")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return d.groupBy("doc_id").agg(F.max_by("diff", F.struct("n", -F.col("first"))).alias("offset"))


def title_pairs(toc: DataFrame, found: DataFrame, start: int) -> DataFrame:
    return toc.join(found.where(F.col("physical") >= start), ["doc_id", "title"])


def known_bounds(items: DataFrame, value: str) -> DataFrame:
    """items (doc_id, ord, value): the nearest known value before and after each."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return items.withColumn("before", before).withColumn("after", after)


def islands(flags: DataFrame, gap: int = 3) -> DataFrame:
    """flags (doc_id, page, flag): runs of flagged pages, with up to `gap` pages between neighbours."""
    w = Window.partitionBy("doc_id").orderBy("page")
    d = flags.where("flag").withColumn("new", F.coalesce(F.col("page") - F.lag("page").over(w) > gap, F.lit(True)).cast("int"))
    d = d.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("doc_id", "island").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.count(F.lit(1)).alias("n"))


def code_parents(items: DataFrame) -> DataFrame:
    """items (doc_id, ord, structure) with parent_ord: the latest item before whose code is one part shorter; null for roots."""
    parent = F.when(F.col("structure").contains("."), F.regexp_replace("structure", r"\.[^.]*$", ""))
    above = items.groupBy("doc_id", "structure").agg(F.array_sort(F.collect_set("ord")).alias("_at")).select("doc_id", F.col("structure").alias("_up"), "_at")
    d = items.withColumn("_up", parent).join(above, ["doc_id", "_up"], "left")
    return d.select(*items.columns, F.array_max(F.filter("_at", lambda x: x < F.col("ord"))).alias("parent_ord"))


def with_preface(items: DataFrame) -> DataFrame:
    """items (doc_id, ord, structure, title, physical_index) and, where the first starts after page 1, a preface before it."""
    first = items.groupBy("doc_id").agg(F.min_by("physical_index", "ord").alias("p"), F.min("ord").alias("ord")).where("p > 1")
    return items.unionByName(first.select("doc_id", (F.col("ord") - 1).cast(items.schema["ord"].dataType).alias("ord"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).cast(items.schema["physical_index"].dataType).alias("physical_index")))
