"""Registered queries on runs, messages, rules and events."""

from pyspark.sql import functions as F

from ..functions.text import cap, tool_name
from ..operators import runs as R
from .retrieval import t


def conv(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", "role", "text")


def ev(s, d):
    return t(s, d, "events").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"), "ts")


def costs(s, d):
    e = ev(s, d)
    return R.costs_by_stage(e.select(F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("k").alias("prompt_tokens"), (F.col("k") * 2).alias("completion_tokens"), F.col("value").alias("cost")))


RULES = [("event_type CONTAINS 'err'", "no errors"), ("event_type IN ['click','view']", "no looking"), ("missing NOT CONTAINS 'x'", "no field")]
BRANCHES = ["o_totalprice / 1000 > 200 and o_orderstatus == 'O'", "100 < o_totalprice % 1000 <= 500", "not (o_orderstatus != 'F')"]


def windowed(kind):
    def run(s, d):
        w = {"tumbling": F.window("ts", "1 day"), "sliding": F.window("ts", "2 days", "1 day")}[kind]
        e = ev(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
        return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n")
    return run


#: Texts that read as numbers or truth values, or nearly so.
ODD = ("10", " 9 ", "abc", "true", "5.0", "1e3", "", "False")


def coerced(s, d):
    k = F.col("event_id")
    e = ev(s, d).select("event_id", F.element_at(F.array(*map(F.lit, ODD)), (k % 8 + 1).cast("int")).alias("a"), F.element_at(F.array(*map(F.lit, ODD)), (F.floor(k / 8) % 8 + 1).cast("int")).alias("b"), (k % 3).alias("n"))
    tests = {"lt": "a < b", "eq": "a == b", "ne": "a != b", "n_eq": "a == n", "n_gt": "a > n", "any": "a and not b"}
    return e.select("event_id", *[R.compile_expression(x, e.columns, dict(e.dtypes)).alias(c) for c, x in tests.items()])


def rule_matches(s, d):
    e = ev(s, d).select("event_id", "event_type", F.when(F.col("event_id") % 7 > 0, F.col("k")).alias("k"))
    rules = {"bad": "event_type NOT MATCHES '('", "regex": "event_type MATCHES '^c.*k$'", "bare": "k IN 1,2", "listed": "k NOT IN ['1', '2']", "none": "k CONTAINS 'None'", "missing": "other STARTS_WITH 'x'"}
    return e.select("event_id", *[R.rule(x, e.columns, dict(e.dtypes)).alias(c) for c, x in rules.items()])


def normalized(s, d):
    n = F.col("turn")
    call = lambda i, name: F.struct(i.cast("string").alias("id"), name.alias("name"))
    calls = F.when((F.col("role") == "assistant"), F.array(call(n + 1, F.lit("look")), call(n + 2, F.when(n % 2 == 0, "look").otherwise("write"))))
    role = F.when((F.col("role") == "user") & (n % 3 > 0), "tool").otherwise(F.col("role"))
    m = conv(s, d).select("conv_id", "turn", role.alias("role"), F.col("text").alias("content"), calls.alias("tool_calls"), n.cast("string").alias("tool_call_id"), (F.col("conv_id") % 2 == 0).alias("injected"))
    return R.normalize_messages(m, ["look"]).select("conv_id", "turn", "role", F.md5("content").alias("h"), F.array_join("tool_calls.id", ",").alias("calls"))


QUERIES = {
    "agg_cost_by_stage": costs,
    "agg_usage_rollup": lambda s, d: ev(s, d).rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")),
    "agt_running_budget": lambda s, d: R.running_budget(ev(s, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.coalesce("k", F.lit(0)).alias("tokens")), 300),
    "agt_doom_loop": lambda s, d: R.doom_loops(ev(s, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("call"))),
    "agt_token_estimate": lambda s, d: R.token_estimate(conv(s, d)),
    "agt_prune_turns": lambda s, d: R.prune(conv(s, d), "assistant", 1, "[removed]").select("conv_id", "turn", F.md5("text").alias("h")),
    "agt_suffix_fit": lambda s, d: R.suffix_fit(conv(s, d), 600).select("conv_id", "turn"),
    "agt_waterfill": lambda s, d: R.water_fill(conv(s, d), 500),
    "agt_session_last_n": lambda s, d: R.last_messages(conv(s, d), 2).select("conv_id", "turn", "role"),
    "agt_orphan_tools": lambda s, d: R.drop_orphans(conv(s, d).select("conv_id", "turn", (F.col("turn") % 3).alias("call_id")), conv(s, d).where("role = 'user' AND turn < 2").select("conv_id", F.col("turn").alias("call_id"))),
    "agt_rules_deny": lambda s, d: R.apply_rules(ev(s, d).select("event_id", "event_type"), RULES[:2]),
    "agt_error_class": lambda s, d: ev(s, d).select("event_id", R.error_class(F.concat("event_type", F.lit(" 50"), (F.col("event_id") % 4).cast("string"))).alias("kind")),
    "agt_rules_matches": rule_matches,
    "agt_normalize_messages": normalized,
    "agt_finish_class": lambda s, d: ev(s, d).select("event_id", R.finish_class(F.element_at(F.array(*map(F.lit, ("stop", "length", "max_tokens"))), (F.col("event_id") % 3 + 1).cast("int"))).alias("kind")),
    "wfl_expr_coerce": coerced,
    "agt_tool_cap": lambda s, d: conv(s, d).select("conv_id", "turn", F.md5(cap(F.col("text"), 100)).alias("h")),
    "orc_tool_names": lambda s, d: t(s, d, "part").select("p_partkey", tool_name(F.col("p_name")).alias("name")),
    "wfl_condition_route": lambda s, d: R.route(t(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), BRANCHES).select("o_orderkey", "route"),
    "str_fold_batch": lambda s, d: R.fold_stream(ev(s, d).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("content"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("finish_reason"))).select("run_id", F.md5("content").alias("h"), "finish_reason"),
    "db_list_page": lambda s, d: t(s, d, "customer").orderBy("c_custkey").offset(20).limit(10).select("c_custkey", "c_name"),
    "db_get_row": lambda s, d: t(s, d, "customer").where("c_custkey = 7").select("c_custkey", "c_name", "c_acctbal"),
    "store_chunk_count": lambda s, d: t(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    "evt_tumbling": windowed("tumbling"),
    "evt_sliding": windowed("sliding"),
}
_E = "(SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k, ts FROM events)"
ORACLES = {
    "agg_cost_by_stage": f"SELECT event_type AS stage, count(*) AS calls, arg_min('m' || (user_id % 3)::VARCHAR, event_id) AS model, sum(k)::BIGINT AS prompt_tokens, sum(2 * k)::BIGINT AS completion_tokens, round(sum(value), 6) AS cost FROM {_E} GROUP BY event_type",
    "agg_usage_rollup": f"SELECT event_type, count(*) AS n, sum(k)::BIGINT AS k FROM {_E} GROUP BY ROLLUP (event_type)",
    "agt_running_budget": f"SELECT run_id, step, tokens, used, greatest(0, 300 - used)::BIGINT AS remaining, used >= 300 AS exceeded, greatest(0, 300 - used) < 45 AS warn FROM (SELECT user_id AS run_id, event_id AS step, coalesce(k, 0) AS tokens, sum(coalesce(k, 0)) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS used FROM {_E})",
    "agt_doom_loop": f"SELECT user_id AS run_id, event_id AS seq, event_type AS call, coalesce(lag(event_type) OVER w = event_type, FALSE) AND coalesce(lag(event_type, 2) OVER w = event_type, FALSE) AS loop FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "agt_token_estimate": "SELECT conv_id, (coalesce(sum(length(text)), 0) // 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id",
    "agt_prune_turns": "WITH c AS (SELECT *, (SELECT count(*) FROM conversations u WHERE u.conv_id = m.conv_id AND u.role = 'user' AND u.turn >= m.turn) AS later, (SELECT count(*) FROM conversations u WHERE u.conv_id = m.conv_id AND u.role = 'user') AS users FROM conversations m) SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' AND (later >= 1 OR users <= 1) THEN '[removed]' ELSE text END) AS h FROM c",
    "agt_suffix_fit": "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 600",
    "agt_waterfill": "WITH l AS (SELECT conv_id, length(text) AS n FROM conversations), m AS (SELECT conv_id, max(n) AS top FROM l GROUP BY conv_id), c AS (SELECT conv_id, unnest(range(0, least(500, top) + 1)) AS cap FROM m) SELECT c.conv_id, max(c.cap)::BIGINT AS cap FROM c JOIN (SELECT c.conv_id, c.cap FROM c JOIN l USING (conv_id) GROUP BY ALL HAVING sum(least(n, cap)) <= 500) g ON c.conv_id = g.conv_id AND c.cap = g.cap GROUP BY c.conv_id",
    "agt_session_last_n": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system') WHERE n <= 2",
    "agt_orphan_tools": "SELECT conv_id, turn % 3 AS call_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn < 2 AND u.turn = c.turn % 3)",
    "agt_rules_deny": "SELECT event_id, event_type, CASE WHEN contains(event_type, 'err') THEN 'no errors' WHEN event_type IN ('click', 'view') THEN 'no looking' END AS reason, NOT (contains(event_type, 'err') OR event_type IN ('click', 'view')) AS allowed FROM events",
    "agt_error_class": "SELECT event_id, CASE WHEN event_id % 4 <> 1 THEN 'model_error' ELSE 'unrecoverable' END AS kind FROM events",
    "agt_rules_matches": f"SELECT event_id, TRUE AS bad, regexp_matches(event_type, '^c.*k$') AS regex, FALSE AS bare, coalesce(k::VARCHAR, 'None') NOT IN ('1', '2') AS listed, k IS NULL AS none, FALSE AS missing FROM (SELECT event_id, event_type, CASE WHEN event_id % 7 > 0 THEN k END AS k FROM {_E})",
    "agt_normalize_messages": """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 3 > 0 THEN 'tool' ELSE role END AS role, CASE WHEN role = 'system' AND conv_id % 2 = 0 AND text <> '' THEN E'<system-context>\n' || text || E'\n</system-context>' ELSE text END AS content,
CASE WHEN role = 'assistant' THEN CASE WHEN turn % 2 = 0 THEN [turn + 1, turn + 2] ELSE [turn + 1] END END AS ids FROM conversations), c AS (SELECT DISTINCT conv_id, unnest(ids) AS id FROM m)
SELECT conv_id, turn, role, md5(content) AS h, array_to_string(ids, ',') AS calls FROM m WHERE role <> 'tool' OR EXISTS (SELECT 1 FROM c WHERE c.conv_id = m.conv_id AND c.id = m.turn)""",
    "agt_finish_class": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'max_output_tokens' END AS kind FROM events",
    "wfl_expr_coerce": f"""WITH v AS (SELECT * FROM (VALUES (0, '10', 10.0, TRUE), (1, ' 9 ', 9.0, TRUE), (2, 'abc', NULL, TRUE), (3, 'true', 1.0, TRUE), (4, '5.0', 5.0, TRUE), (5, '1e3', 1000.0, TRUE), (6, '', NULL, FALSE), (7, 'False', 0.0, TRUE)) AS v(i, s, x, t))
SELECT event_id, coalesce(CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN a.x < b.x WHEN a.x IS NULL AND b.x IS NULL THEN a.s < b.s END, FALSE) AS lt,
coalesce(CASE WHEN a.x IS NULL AND b.x IS NULL THEN a.s = b.s ELSE a.x = b.x END, FALSE) AS eq, coalesce(CASE WHEN a.x IS NULL AND b.x IS NULL THEN a.s <> b.s ELSE a.x <> b.x END, TRUE) AS ne,
coalesce(a.x = event_id % 3, FALSE) AS n_eq, coalesce(a.x > event_id % 3, FALSE) AS n_gt, a.t AND NOT b.t AS any FROM {_E} JOIN v a ON a.i = event_id % 8 JOIN v b ON b.i = event_id // 8 % 8""",
    "agt_tool_cap": "SELECT conv_id, turn, md5(CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || chr(10) || '[Truncated: ' || length(text)::VARCHAR || ' chars total]' ELSE text END) AS h FROM conversations",
    "orc_tool_names": "SELECT p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g') AS name FROM part",
    "wfl_condition_route": "SELECT o_orderkey, CASE WHEN o_totalprice / 1000 > 200 AND o_orderstatus = 'O' THEN 'if' WHEN 100 < o_totalprice - 1000 * floor(o_totalprice / 1000) AND o_totalprice - 1000 * floor(o_totalprice / 1000) <= 500 THEN 'elif_1' WHEN o_orderstatus = 'F' THEN 'elif_2' ELSE 'else' END AS route FROM orders",
    "str_fold_batch": "SELECT user_id AS run_id, md5(string_agg(event_type, '' ORDER BY event_id)) AS h, arg_max(event_type, event_id) FILTER (WHERE event_id % 5 = 0) AS finish_reason FROM events GROUP BY user_id",
    "db_list_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20",
    "db_get_row": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7",
    "store_chunk_count": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "evt_tumbling": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "evt_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([epoch(date_trunc('day', ts))::BIGINT, epoch(date_trunc('day', ts))::BIGINT - 86400]) AS start FROM events) GROUP BY ALL",
}
