"""What answers of models carry: usage, thinking, reasoning, calls of tools, and the nodes that they select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(answer: Column, zeros: bool = False) -> Column:
    """Token counts of a JSON usage record, by either of its two namings: a struct, null where a count is missing.

    zeros: the three main counts are then 0. Null and broken records have no counts.
    """
    doc = F.try_parse_json(answer)

    def first(*paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(doc, f"$.{p}", "bigint") for p in paths])

    main = {"prompt_tokens": first("prompt_tokens", "input_tokens"), "completion_tokens": first("completion_tokens", "output_tokens"), "total_tokens": first("total_tokens")}
    if zeros:
        main = {k: F.coalesce(v, F.lit(0)) for k, v in main.items()}
    main["reasoning_tokens"] = first("completion_tokens_details.reasoning_tokens", "output_tokens_details.reasoning_tokens")
    main["cached_tokens"] = first("prompt_tokens_details.cached_tokens", "input_tokens_details.cached_tokens")
    return F.struct(*[v.alias(k) for k, v in main.items()])


def _full(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def _joined(c: str) -> Column:
    """Texts of a group in the order of seq; nulls are empty. Equal seq are ordered by text, so reruns agree."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce(c, F.lit("")).alias("x")))), lambda p: p["x"]), "")


def _at(c: str, last: bool) -> Column:
    """The first or last text of a group that isn't empty."""
    return (F.max_by if last else F.min_by)(c, F.when(_full(c).isNotNull(), F.struct("seq", c)))


def thinking_blocks(deltas: DataFrame) -> DataFrame:
    """deltas (run_id, seq, index, type, thinking, signature): one row per run and index; a null index is 0.

    Thinking is joined; the last signature and type that aren't empty stay, `thinking` where no type is given.
    """
    d = deltas.withColumn("index", F.coalesce("index", F.lit(0)))
    return d.groupBy("run_id", "index").agg(F.coalesce(_at("type", True), F.lit("thinking")).alias("type"), _joined("thinking").alias("thinking"), _at("signature", True).alias("signature"))


def tool_calls(deltas: DataFrame) -> DataFrame:
    """deltas (run_id, seq, index, id, name, arguments): the call of each run and index, and whether its arguments are whole.

    The first id and name that aren't empty stay; without an id it is call_<index>. Arguments are joined ({} for none);
    `whole` is false where they aren't JSON, so that a truncated call keeps its parts.
    """
    d = deltas.withColumn("index", F.coalesce("index", F.lit(0)))
    out = d.groupBy("run_id", "index").agg(_at("id", False).alias("id"), F.coalesce(_at("name", False), F.lit("")).alias("name"), _joined("arguments").alias("arguments"))
    own = F.coalesce("id", F.concat(F.lit("call_"), F.col("index").cast("string")))
    return out.withColumns({"id": own, "arguments": F.coalesce(_full("arguments"), F.lit("{}"))}).withColumn("whole", F.try_parse_json("arguments").isNotNull())


def reasoning(thought: Column, other: Column, content: Column) -> Column:
    """The reasoning of a delta: either field, else what <think> tags hold, else what follows THOUGHT:. Null for none."""
    full = lambda c: F.when(c != "", c)
    tagged = F.when(content.rlike("(?s)<think>.*?</think>"), F.regexp_extract(content, "(?s)<think>(.*?)</think>", 1))
    said = F.when(content.startswith("THOUGHT:"), F.regexp_replace(F.substr(content, F.lit(9)), r"^\s+|\s+$", ""))
    return F.coalesce(full(thought), full(other), tagged, said)


# The order of kinds of tools in a prompt.
TOOL_ORDER = {"BuiltinTool": 0, "KnowledgeSearchTool": 1, "CustomTool": 2, "McpTool": 3, "DelegateTool": 4}


def tool_ranks(tools: DataFrame) -> DataFrame:
    """tools (agent_id, kind, name) with their place from 0 in the agent's prompt: by kind (unknown ones last), then by name."""
    kind = F.lit(99)
    for name, k in TOOL_ORDER.items():
        kind = F.when(F.col("kind") == name, k).otherwise(kind)
    w = Window.partitionBy("agent_id").orderBy(kind, F.encode("name", "UTF-8"))
    return tools.withColumn("place", (F.row_number().over(w) - 1).cast("bigint"))


def selected_nodes(picked: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """picked (query_id, pos, id) and nodes (doc, node_id, title): the nodes that an answer selects.

    id: d<doc>:<node_id>, or a node_id alone, which is then sought in document 0. Of the ids that any document has, the
    first `most` count; rank is the place among them, so that what isn't found leaves a gap. Repeated rows of nodes count
    once. The join is on document and node, so nodes stay where they are.
    """
    own = nodes.groupBy(F.col("doc").cast("bigint").alias("doc"), "node_id").agg(F.min("title").alias("title"))
    named = F.col("id").contains(":")
    p = picked.withColumn("doc", F.when(named, F.regexp_extract("id", r"^d([0-9]+):", 1).try_cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    p = p.withColumn("node_id", F.when(named, F.regexp_extract("id", "^[^:]*:(.*)$", 1)).otherwise(F.col("id")))
    anywhere = own.select("node_id").distinct()
    plain = p.where(~named).join(anywhere, "node_id", "left_semi").select(*p.columns)
    known = p.where(named).join(own, ["doc", "node_id"], "left_semi").select(*p.columns).unionByName(plain)
    w = Window.partitionBy("query_id").orderBy("pos")
    ranked = known.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint")).where(F.col("rank") < most)
    return ranked.join(own, ["doc", "node_id"]).select("query_id", "rank", "doc", "node_id", "title")


def selected_documents(picked: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """picked (query_id, pos, id), docs (doc), queries (query_id): the documents that an answer names as d<doc>.

    Ids that no document has are dropped; a query that is left with none searches all documents, marked by a null pos and
    doc instead of a row for each.
    """
    p = picked.withColumn("doc", F.regexp_extract("id", r"^d([0-9]+)", 1).try_cast("bigint"))
    some = p.join(docs.select(F.col("doc").cast("bigint").alias("doc")).distinct(), "doc", "left_semi").select("query_id", "pos", "doc")
    return queries.select("query_id").distinct().join(some, "query_id", "left")
