"""Registered queries on tables of contents and on the ids that answers select."""

from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import tree as E
from .retrieval import t


def codes(s, d):
    l = t(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n = F.col("l_linenumber")
    code = F.when(n % 3 == 1, (F.floor((n - 1) / 3) + 1).cast("string")).otherwise(F.concat((F.floor((n - 1) / 3) + 1).cast("string"), F.lit("."), ((n - 1) % 3).cast("string")))
    return l.select(F.col("l_orderkey").alias("doc_id"), n.cast("bigint").alias("ord"), code.alias("structure"))


def prefaced(s, d):
    p = t(s, d, "part").select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("structure"), F.col("p_type").alias("title"), (F.col("p_partkey") % 3).alias("physical_index"))
    return E.with_preface(p)


def selected(s, d):
    e, k = t(s, d, "events"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"node_ids": ["'), k, F.lit('", "x"]}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("see d1:"), k, F.lit(" and 2024, d1:"), k)).otherwise(F.concat(F.lit("in "), k, F.lit(" or "), k))
    return e.select("event_id", F.array_join(P.selected_ids(answer), ",").alias("ids"))


def indices(s, d):
    e = t(s, d, "events")
    index = P.page_tag(F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("<physical_index_"), F.col("event_id").cast("string"), F.lit(">"))).otherwise("none"))
    return e.select("event_id", P.valid_index(index, F.lit(500)).alias("page"))


QUERIES = {"tre_code_parents": lambda s, d: E.code_parents(codes(s, d)).select("doc_id", "ord", "parent_ord"), "tre_preface": prefaced, "ret_node_ids_parse": selected, "tre_valid_index": indices}
ORACLES = {
    "tre_code_parents": "SELECT DISTINCT l_orderkey AS doc_id, l_linenumber::BIGINT AS ord, CASE WHEN (l_linenumber - 1) % 3 > 0 THEN (CASE WHEN EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber - (a.l_linenumber - 1) % 3) THEN l_linenumber - (l_linenumber - 1) % 3 END)::BIGINT END AS parent_ord FROM lineitem a",
    "tre_preface": "WITH i AS (SELECT p_size AS doc_id, p_partkey AS ord, p_brand AS structure, p_type AS title, p_partkey % 3 AS physical_index FROM part) SELECT * FROM i UNION ALL SELECT doc_id, min(ord) - 1, '0', 'Preface', 1 FROM i GROUP BY doc_id HAVING arg_min(physical_index, ord) > 1",
    "ret_node_ids_parse": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN k || ',x' WHEN 1 THEN 'd1:' || k ELSE k END AS ids FROM (SELECT event_id, lpad((event_id % 10000)::VARCHAR, 4, '0') AS k FROM events)",
    "tre_valid_index": "SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id <= 500 THEN event_id END AS page FROM events",
}
