"""Registered queries on what answers carry, on workflow graphs and on more of the section trees."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import graph as G
from ..operators import text as T
from ..operators import tree as E
from .documents import _HEAD, _ITEMS, docs, items, nodes
from .retrieval import t


def ev(s, d):
    return t(s, d, "events").select("event_id", "user_id", F.coalesce("event_type", F.lit("")).alias("event_type"))


def _pick(n, *values):
    """The n-th of the values, from 0."""
    return F.element_at(F.array(*values), (n + 1).cast("int"))


def usage(s, d):
    k = F.col("event_id")
    chat = F.to_json(F.struct(k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"), (k * 3).alias("total_tokens"), F.struct((k % 9).alias("reasoning_tokens")).alias("completion_tokens_details")))
    other = F.to_json(F.struct(k.alias("input_tokens"), F.col("user_id").alias("output_tokens"), F.struct((k % 7).alias("cached_tokens")).alias("input_tokens_details")))
    e = ev(s, d).select("event_id", _pick(k % 4, chat, other, F.lit("no record"), F.lit(None)).alias("u"))
    return e.select("event_id", A.usage(F.col("u")).alias("a"), A.usage(F.col("u"), zeros=True).alias("z")).select("event_id", "a.*", F.col("z.prompt_tokens").alias("prompt_or_0"), F.col("z.total_tokens").alias("total_or_0"))


def thinking(s, d):
    k = F.col("event_id")
    e = ev(s, d).select(F.col("user_id").alias("run_id"), k.alias("seq"), F.when(k % 3 > 0, k % 3).alias("index"), F.when(k % 5 == 0, "redacted").otherwise("").alias("type"), F.when(k % 4 > 0, F.col("event_type")).alias("thinking"), F.when(k % 7 == 0, F.concat(F.lit("s"), k.cast("string"))).alias("signature"))
    return A.thinking_blocks(e).select("run_id", "index", "type", F.md5("thinking").alias("h"), "signature")


def calls(s, d):
    k, first = F.col("event_id"), F.col("seq") == 0
    e = ev(s, d).select("event_id", "event_type", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    arguments = F.when(k % 5 == 0, "").when(first, '{"a": ').when(k % 3 > 0, "1}")
    e = e.select(k.alias("run_id"), "seq", F.lit(None).cast("bigint").alias("index"), F.when(~first & (k % 2 == 0), F.concat(F.lit("c"), k.cast("string"))).alias("id"), F.when(first, F.col("event_type")).otherwise("later").alias("name"), arguments.alias("arguments"))
    return A.tool_calls(e)


def reasoning(s, d):
    k, kind = F.col("event_id"), F.col("event_type")
    content = _pick(k % 4, F.concat(F.lit("a<think>"), kind, F.lit("</think>b")), F.concat(F.lit("THOUGHT: "), kind, F.lit(" ")), F.lit("<think>open"), kind)
    return ev(s, d).select("event_id", A.reasoning(F.when(k % 5 == 0, "r").otherwise(""), F.when(k % 7 == 0, "o"), content).alias("reasoning"))


def tool_order(s, d):
    kind = _pick(F.col("p_partkey") % 6, *map(F.lit, [*A.TOOL_ORDER, "Other"]))
    return A.tool_ranks(t(s, d, "part").select(F.col("p_size").alias("agent_id"), kind.alias("kind"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name")))


def _lines(s, d):
    return t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("bigint").alias("pos")).agg(F.min("l_partkey").alias("p"))


def _four(c):
    return F.lpad(c.cast("string"), 4, "0")


def select_nodes(s, d):
    p = F.col("p")
    picked = _lines(s, d).select("query_id", "pos", F.when(F.col("pos") % 2 == 0, _four(p % 30)).otherwise(F.concat(F.lit("d"), (p % 3).cast("string"), F.lit(":"), _four(p % 25))).alias("id"))
    n = t(s, d, "nation").select((F.col("n_nationkey") % 2).alias("doc"), _four(F.col("n_nationkey")).alias("node_id"), F.col("n_name").alias("title"))
    return A.selected_nodes(picked, n, 3)


def select_documents(s, d):
    picked = _lines(s, d).select("query_id", "pos", F.concat(F.lit("d"), (F.col("p") % 90).cast("string")).alias("id"))
    return A.selected_documents(picked, t(s, d, "nation").select(F.col("n_nationkey").alias("doc")), t(s, d, "orders").select(F.col("o_orderkey").alias("query_id")))


#: A check, a branch for either answer, one that fails for some rows, one that is off and one behind it, and the end.
BLOCKS = [
    G.Block("end", lambda r: F.concat_ws("+", r["big"], r["small"])),
    G.Block("check", lambda r: F.when(r["o_totalprice"] > 150000, "true").otherwise("false")),
    G.Block("big", lambda r: F.concat(F.lit("big "), r["o_orderstatus"])),
    G.Block("small", lambda r: F.when(r["o_custkey"] % 3 > 0, F.lit("small"))),
    G.Block("off", lambda r: F.lit("x"), enabled=False),
    G.Block("behind", lambda r: F.lit("y")),
]
EDGES = [G.Edge("check", "big", "true"), G.Edge("check", "small", "false"), G.Edge("big", "end"), G.Edge("small", "end"), G.Edge("off", "behind")]


def run(s, d):
    o = t(s, d, "orders").groupBy("o_orderkey").agg(F.min("o_totalprice").alias("o_totalprice"), F.min("o_orderstatus").alias("o_orderstatus"), F.min("o_custkey").alias("o_custkey"))
    return G.execute(o, BLOCKS, EDGES)


def moved(s, d):
    i = items(s, d).select("doc_id", "ord", F.when(F.col("ord") % 3 > 0, F.col("ord")).alias("page"), F.when(F.col("ord") % 3 == 0, F.col("physical_index")).alias("physical_index"))
    return E.add_offset(i, t(s, d, "orders").where("o_orderkey % 2 = 0").groupBy(F.col("o_orderkey").alias("doc_id")).agg((F.min("o_custkey") % 10).alias("offset")))


def accuracy(s, d):
    i = items(s, d).select("doc_id", "ord", F.when(F.col("physical_index") % 4 > 0, F.col("physical_index")).alias("physical_index"), F.col("appear_start").alias("answer"), F.lit(60).alias("pages"))
    return E.toc_accuracy(i, "pages").select("doc_id", F.round("accuracy", 6).alias("accuracy"))


def leaders(s, d):
    line = F.concat("p_name", F.repeat(F.lit("."), (F.col("p_size") % 9).cast("int")), F.lit(" x "), F.repeat(F.lit(". "), (F.col("p_size") % 8).cast("int")), F.lit(". end"))
    return t(s, d, "part").select("p_partkey", X.dot_leaders(line).alias("line"))


QUERIES = {
    "agt_usage_extract": usage,
    "str_thinking_blocks": thinking,
    "str_tool_calls": calls,
    "str_reasoning": reasoning,
    "agt_tool_order": tool_order,
    "ret_select_nodes": select_nodes,
    "ret_select_documents": select_documents,
    "wfl_dag_execute": lambda s, d: run(s, d).select("o_orderkey", *G.order(BLOCKS, EDGES)),
    "wfl_dag_events": lambda s, d: G.events(run(s, d), "o_orderkey", G.order(BLOCKS, EDGES)),
    "tre_depth": lambda s, d: E.with_depth(nodes(s, d)).select("doc_id", "line_num", "depth"),
    "tre_add_offset": moved,
    "tre_toc_accuracy": accuracy,
    "tre_dot_leaders": leaders,
    "tre_labelled_pages": lambda s, d: t(s, d, "conversations").select("conv_id", "turn", F.md5(X.labelled_page(F.col("turn") + 1, F.coalesce("text", F.lit("")))).alias("h")),
    "txt_fixed_token_chunks": lambda s, d: T.fixed_token_chunks(docs(s, d), 100, 10).select("doc_id", "chunk", "start_char", "end_char", F.md5("text").alias("h")),
}
_L = "(SELECT l_orderkey AS query_id, l_linenumber::BIGINT AS pos, min(l_partkey) AS p FROM lineitem GROUP BY ALL)"
_O = "(SELECT o_orderkey, min(o_totalprice) AS o_totalprice, min(o_orderstatus) AS o_orderstatus, min(o_custkey) AS o_custkey FROM orders GROUP BY ALL)"
_RUN = f"""(SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'true' ELSE 'false' END AS "check", CASE WHEN o_totalprice > 150000 THEN 'big ' || o_orderstatus END AS big, CASE WHEN NOT o_totalprice > 150000 AND o_custkey % 3 > 0 THEN 'small' END AS small FROM {_O})"""
ORACLES = {
    "agt_usage_extract": """SELECT event_id, CASE WHEN m < 2 THEN event_id END AS prompt_tokens, CASE m WHEN 0 THEN 2 * event_id WHEN 1 THEN user_id END AS completion_tokens, CASE WHEN m = 0 THEN 3 * event_id END AS total_tokens,
CASE WHEN m = 0 THEN event_id % 9 END AS reasoning_tokens, CASE WHEN m = 1 THEN event_id % 7 END AS cached_tokens, CASE WHEN m < 2 THEN event_id ELSE 0 END AS prompt_or_0, CASE WHEN m = 0 THEN 3 * event_id ELSE 0 END AS total_or_0 FROM (SELECT *, event_id % 4 AS m FROM events)""",
    "str_thinking_blocks": "SELECT user_id AS run_id, event_id % 3 AS \"index\", CASE WHEN bool_or(event_id % 5 = 0) THEN 'redacted' ELSE 'thinking' END AS type, md5(string_agg(CASE WHEN event_id % 4 > 0 THEN coalesce(event_type, '') ELSE '' END, '' ORDER BY event_id)) AS h, arg_max('s' || event_id, event_id) FILTER (WHERE event_id % 7 = 0) AS signature FROM events GROUP BY user_id, event_id % 3",
    "str_tool_calls": """SELECT event_id AS run_id, 0::BIGINT AS "index", CASE WHEN event_id % 2 = 0 THEN 'c' || event_id ELSE 'call_0' END AS id, CASE WHEN coalesce(event_type, '') = '' THEN 'later' ELSE event_type END AS name,
CASE WHEN event_id % 5 = 0 THEN '{}' WHEN event_id % 3 > 0 THEN '{"a": 1}' ELSE '{"a": ' END AS arguments, event_id % 5 = 0 OR event_id % 3 > 0 AS whole FROM events""",
    "str_reasoning": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'r' WHEN event_id % 7 = 0 THEN 'o' WHEN event_id % 4 < 2 THEN coalesce(event_type, '') END AS reasoning FROM events",
    "agt_tool_order": "SELECT p_size AS agent_id, kind, name, row_number() OVER (PARTITION BY p_size ORDER BY k, name) - 1 AS place FROM (SELECT p_size, p_partkey % 6 AS k, ['BuiltinTool', 'KnowledgeSearchTool', 'CustomTool', 'McpTool', 'DelegateTool', 'Other'][p_partkey % 6 + 1] AS kind, p_name || '#' || p_partkey AS name FROM part)",
    "ret_select_nodes": f"""WITH n AS (SELECT n_nationkey % 2 AS doc, lpad(n_nationkey::VARCHAR, 4, '0') AS node_id, n_name AS title FROM nation),
p AS (SELECT query_id, pos, CASE WHEN pos % 2 = 0 THEN 0 ELSE p % 3 END AS doc, lpad((CASE WHEN pos % 2 = 0 THEN p % 30 ELSE p % 25 END)::VARCHAR, 4, '0') AS node_id FROM {_L}),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS rank FROM p WHERE EXISTS (SELECT 1 FROM n WHERE n.node_id = p.node_id AND (p.pos % 2 = 0 OR n.doc = p.doc)))
SELECT query_id, rank, doc::BIGINT AS doc, node_id, title FROM k JOIN n USING (doc, node_id) WHERE rank < 3""",
    "ret_select_documents": f"SELECT q.query_id, p.pos, p.doc FROM (SELECT DISTINCT o_orderkey AS query_id FROM orders) q LEFT JOIN (SELECT query_id, pos, p % 90 AS doc FROM {_L} WHERE p % 90 IN (SELECT n_nationkey FROM nation)) p USING (query_id)",
    "wfl_dag_execute": f"SELECT o_orderkey, \"check\", NULL::VARCHAR AS off, big, small, NULL::VARCHAR AS behind, coalesce(big, small) AS \"end\" FROM {_RUN}",
    "wfl_dag_events": f"SELECT o_orderkey, block_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY i) AS seq FROM (SELECT o_orderkey, 'check' AS block_id, 0 AS i FROM {_RUN} UNION ALL SELECT o_orderkey, CASE WHEN big IS NULL THEN 'small' ELSE 'big' END, 1 FROM {_RUN} WHERE coalesce(big, small) IS NOT NULL UNION ALL SELECT o_orderkey, 'end', 2 FROM {_RUN} WHERE coalesce(big, small) IS NOT NULL)",
    "tre_depth": f"WITH RECURSIVE {_HEAD}, r AS (SELECT doc_id, line_num, 0::BIGINT AS depth FROM hp WHERE parent_line IS NULL UNION ALL SELECT hp.doc_id, hp.line_num, r.depth + 1 FROM r JOIN hp ON hp.doc_id = r.doc_id AND hp.parent_line = r.line_num) SELECT * FROM r",
    "tre_add_offset": f"SELECT doc_id, ord, CASE WHEN ord % 3 > 0 AND o IS NULL THEN ord END AS page, CASE WHEN ord % 3 = 0 THEN physical_index ELSE ord + o END AS physical_index FROM ({_ITEMS}) LEFT JOIN (SELECT o_orderkey AS doc_id, min(o_custkey) % 10 AS o FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL) USING (doc_id)",
    "tre_toc_accuracy": f"SELECT doc_id, CASE WHEN arg_max(physical_index, ord) FILTER (WHERE physical_index % 4 > 0) >= 30 THEN round(avg((appear_start = 'yes')::INT) FILTER (WHERE physical_index % 4 > 0), 6) ELSE 0.0 END::DOUBLE AS accuracy FROM ({_ITEMS}) GROUP BY doc_id",
    "tre_dot_leaders": "SELECT p_partkey, regexp_replace(regexp_replace(p_name || repeat('.', p_size::INT % 9) || ' x ' || repeat('. ', p_size::INT % 8) || '. end', '\\.{5,}', ': ', 'g'), '(?:\\. ){5,}\\.?', ': ', 'g') AS line FROM part",
    "tre_labelled_pages": "SELECT conv_id, turn, md5('<physical_index_' || (turn + 1) || '>' || chr(10) || coalesce(text, '') || chr(10) || '<physical_index_' || (turn + 1) || '>' || chr(10)) AS h FROM conversations",
}
