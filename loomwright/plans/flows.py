"""Registered queries on structured extraction, workflow values and streams."""

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import flow as W
from ..streaming import fold
from .retrieval import t

SCHEMA = {"name": "string", "revenue": "number", "tags": "array", "addr": {"city": "string", "zip": "integer"}}
KINDS = {"title": "string", "revenue": "number", "page_count": "integer", "is_public": "boolean"}


def merged(s, d):
    c = t(s, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    odd = F.when(F.col("turn") % 2 == 1, F.col("turn"))
    data = F.struct(F.col("role").alias("name"), odd.alias("revenue"), F.array("role").alias("tags"), F.struct(F.when(F.col("turn") == 0, F.col("role")).alias("city"), F.col("turn").alias("zip")).alias("addr"))
    out = X.merge(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("win"), F.to_json(data).alias("data")), SCHEMA)
    return out.select("doc_id", "fields.name", "fields.revenue", F.array_join("fields.tags", ",").alias("tags"), "fields.addr.city", "fields.addr.zip")


def validated(s, d):
    e = t(s, d, "events")
    flag = F.element_at(F.array(*map(F.lit, ("yes", "No", "TRUE"))), (F.col("event_id") % 3 + 1).cast("int"))
    data = F.to_json(F.struct(F.col("event_type").alias("title"), F.concat(F.lit(" "), F.col("event_id").cast("string")).alias("revenue"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("x").alias("page_count"), flag.alias("is_public"), F.lit(1).alias("other")))
    return X.validate(e.select("event_id", data.alias("data")), KINDS).select("event_id", "fields.*")


def orders(s, d):
    o = t(s, d, "orders")
    return o.select("o_orderkey", F.struct(F.struct("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("pri")).alias("output"), F.col("o_custkey").alias("cust")).alias("step"), F.when(F.col("o_orderkey") % 5 == 0, "own").otherwise("").alias("prompt"))


def answers(s, d):
    # a pattern, as a stream can't start from the name of a single file
    e = s.readStream.schema(t(s, d, "events").schema).parquet(f"{d}/events.parque[t]")
    chunks = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("finish_reason"))
    return fold.drain(fold.fold_chunks(chunks), "answers")


def sessions(s, d):
    e = t(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n")


QUERIES = {
    "d2j_merge_last_wins": merged,
    "d2j_validate": validated,
    "wfl_input_mapping": lambda s, d: W.map_inputs(orders(s, d), [("step.o_orderstatus", "prompt"), ("step.pri", "prompt"), ("step.none", "prompt")]).select("o_orderkey", "prompt"),
    "wfl_template": lambda s, d: (lambda o: o.select("o_orderkey", W.template(o, "<step.cust>: <step.output.pri>, <step.lost>").alias("text")))(orders(s, d)),
    "str_fold_stateful": answers,
    "evt_session": sessions,
}
ORACLES = {
    "d2j_merge_last_wins": "WITH c AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL) SELECT conv_id AS doc_id, arg_max(role, turn) AS name, (max(turn) FILTER (WHERE turn % 2 = 1))::DOUBLE AS revenue, string_agg(role, ',' ORDER BY turn) AS tags, max(role) FILTER (WHERE turn = 0) AS city, max(turn)::BIGINT AS zip FROM c GROUP BY conv_id",
    "d2j_validate": "SELECT event_id, event_type AS title, event_id::DOUBLE AS revenue, CASE WHEN event_id % 2 = 0 THEN user_id END AS page_count, event_id % 3 <> 1 AS is_public FROM events",
    "wfl_input_mapping": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'own' WHEN o_orderkey % 2 = 0 THEN o_orderstatus || chr(10) || o_orderpriority ELSE o_orderstatus END AS prompt FROM orders",
    "wfl_template": "SELECT o_orderkey, o_custkey::VARCHAR || ': ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'None' END || ', <step.lost>' AS text FROM orders",
    "str_fold_stateful": "SELECT user_id AS run_id, max(event_id) AS seq, string_agg(event_type, '' ORDER BY event_id) AS content, arg_max(event_type, event_id) AS finish_reason FROM (SELECT *, coalesce(sum((event_id % 5 = 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM events) GROUP BY user_id, k HAVING max(event_id) % 5 = 0",
    "evt_session": "WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR, TRUE) OR ts = lag(ts) OVER w + INTERVAL 6 HOUR AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts))::BIGINT AS start, count(*) AS n FROM k GROUP BY user_id, k",
}
