import json
import random
import time

import pytest

from loomwright.operators import extraction as X
from loomwright.operators import flow as W
from loomwright.operators import retrieval as R
from loomwright.operators import runs as U
from loomwright.operators import text as T
from loomwright.streaming.fold import drain, fold_chunks

def limited(pool, k, least, most):
    """Rows (item, source, score) in order: at most `most` of a source, the first `least` of each source before all else."""
    most = most if most and most > 0 else len(pool)
    least = min(least or 0, most)
    pool = sorted(pool, key=lambda r: -(r[2] or 0))
    rank, seen, first = {}, {}, {}
    for i, (item, source, _) in enumerate(pool):
        key = source or ("alone", item)
        rank[item] = (seen.setdefault(key, 0), first.setdefault(key, i), i)
        seen[key] += 1
    left = [r[0] for r in pool if rank[r[0]][0] < most]
    chosen = sorted(left, key=lambda x: (0, rank[x][1], rank[x][0]) if rank[x][0] < least else (1, rank[x][2], 0))[: max(k, 0)]
    return sorted(chosen, key=lambda x: rank[x][2])


@pytest.mark.parametrize("seed", range(8))
def test_source_limits(spark, seed):
    r = random.Random(seed)
    pool = [(f"p{i}", r.choice(["red", "blue", "green", None]), round(1 - i / 40, 3)) for i in range(r.randint(1, 14))]
    df = spark.createDataFrame([(0, i, s, x, n) for n, (i, s, x) in enumerate(pool)], "query_id int, item_id string, source_id string, score double, ord int")
    for k, least, most in ((4, None, None), (r.randint(0, 9), r.randint(0, 3), r.randint(0, 4))):
        assert [x["item_id"] for x in R.source_limits(df, k, least, most).orderBy("rank").collect()] == limited(pool, k, least, most)


def test_no_lists_to_fuse(spark):
    assert R.rank_fusion([]).count() == 0


def test_recursive_tail():
    assert T.recursive_spans("x" * 100, 40, 10) == [(0, 40), (30, 70), (60, 100), (90, 100), (94, 100), (98, 100)]
    assert T.recursive_spans("x" * 100, 40, 10, drop_tail=True) == [(0, 40), (30, 70), (60, 100)]
    assert T.recursive_spans("  \n", 40, 10) == []


def test_sizes_are_checked():
    for size, overlap in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            T.check_sizes(size, overlap)


def test_rules(spark):
    df = spark.createDataFrame([("rm -rf /tmp/x", "shell", None), ("ls", "file", True)], "cmd string, tool string, safe boolean")
    hits = lambda c: [r[0] for r in df.select(U.rule(c, df.columns, dict(df.dtypes))).collect()]
    for condition, want in {
        "cmd STARTS_WITH 'rm '": [True, False], "cmd NOT CONTAINS \"-rf\"": [False, True], "tool IN ['shell', 'net']": [True, False], "tool NOT IN [\"file\"]": [True, False],
        "tool IN shell": [False, False], "tool NOT IN shell": [True, True], "cmd MATCHES '['": [False, False], "cmd NOT MATCHES '['": [True, True], f"cmd NOT MATCHES '{'a' * 501}'": [True, True],
        "cmd MATCHES 'r.*x$'": [True, False], "other CONTAINS 'a'": [False, False], "other NOT CONTAINS 'a'": [True, True], "safe IN ['None']": [True, False], "safe STARTS_WITH 'T'": [False, True], "cmd contains 'rm'": [False, False],
    }.items():
        assert hits(condition) == want, condition
    got = U.apply_rules(df, [("tool IN ['file']", "logged", "log"), ("cmd STARTS_WITH 'rm'", "no removal"), ("tool IN ['shell']", "late")]).collect()
    assert [(r["allowed"], r["reason"]) for r in got] == [(False, "no removal"), (True, None)]
    assert U.rule_problem("tool IN ['a']") is None and all(map(U.rule_problem, ("", None, "x LIKE y", "x IN y", "x MATCHES '('", f"x MATCHES {'b' * 501}")))


def test_errors(spark):
    rows = [(None, None), ("Error 429", "RateLimitError"), ("x", "AuthenticationError"), ("HTTP 413", None), ("max_tokens is 5", None), ("Unauthorized", None), ("upstream 503", None), ("who knows", None), ("Prompt is too long (500)", None)]
    df = spark.createDataFrame(rows, "m string, t string")
    got = [r[0] for r in df.select(U.error_class(df["m"], df["t"])).collect()]
    assert got == [None, "rate_limit", "unrecoverable", "prompt_too_long", "max_output_tokens", "unrecoverable", "model_error", "unrecoverable", "prompt_too_long"]


def test_expressions_coerce_texts(spark):
    df = spark.sql("SELECT '10' AS a, ' 9' AS b, 'abc' AS c, 'True' AS t, CAST(NULL AS STRING) AS z, 5 AS n, array(1, 2, 3) AS l, map('k', 'v') AS m, '' AS e, 2.5D AS d")
    for source, want in {
        "a > b": True, "c == 5": False, "c != 5": True, "c < 5": False, "t == 1": True, "t": True, "e": False, "z": False, "z == None": True, "z != a": True, "a == 10.0": True, "1 < n <= 5": True, "l[0] == 1 and l[-1] == 3": True,
        "l[9] == 1": False, "m['k'] == 'v'": True, "m['x'] == None": True, "not c": False, "n and d": True, "n - 5": False, "a == '1_0'": True, "c == 'abc '": False, "n / 0 == 1": False, "-n == '-5'": True, "'nan' == 'nan'": False,
    }.items():
        assert df.select(U.compile_expression(source, df.columns, dict(df.dtypes))).first()[0] is want, source
        assert df.select(U.compile_expression(source, df.columns)).first()[0] is want, source


def test_messages_are_made_ready(spark):
    call = lambda *ids: [(i, "look" if i < "c" else "write") for i in ids]
    rows = [(1, 0, "system", "be kind", None, None, True), (1, 1, "system", "", None, None, True), (1, 2, "assistant", "x", call("a", "c"), None, False), (1, 3, "tool", "r", None, "a", False), (1, 4, "tool", "r", None, "c", None), (1, 5, "assistant", None, call("d"), None, None), (2, 0, "tool", "r", None, "a", None), (2, 1, None, "?", [], None, None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string, tool_calls array<struct<id:string,name:string>>, tool_call_id string, injected boolean")
    ids = lambda d: {(r["conv_id"], r["turn"]): [c["id"] for c in r["tool_calls"] or []] for r in d.collect()}
    assert ids(U.normalize_messages(df)) == {(1, 0): [], (1, 1): [], (1, 2): ["a", "c"], (1, 3): [], (1, 4): [], (1, 5): ["d"], (2, 1): []}
    assert ids(U.normalize_messages(df, ["look"])) == {(1, 0): [], (1, 1): [], (1, 2): ["a"], (1, 3): [], (1, 5): [], (2, 1): []}
    assert ids(U.normalize_messages(df, [])) == {(1, 0): [], (1, 1): [], (1, 2): [], (1, 5): [], (2, 1): []}
    assert U.normalize_messages(df).where("turn = 0").first()["content"] == "<system-context>\nbe kind\n</system-context>"


def test_expressions_refuse_calls():
    for bad in ("f(x)", "x ** 2", "[1]", "x if y else z"):
        with pytest.raises(ValueError):
            U.compile_expression(bad, ["x", "y", "z"])


def test_merge_and_validation(spark):
    schema = {"name": "string", "tags": "array", "addr": {"city": "string", "zip": "integer"}, "n": "number"}
    rows = [(1, 0, '{"name": "old", "tags": ["a"], "addr": {"city": "NYC", "zip": null}}'), (1, 1, '{"name": null, "tags": ["b", "c"], "addr": {"zip": "10001"}, "more": 1}'), (2, 0, None), (3, 0, "no JSON"), (4, 0, '{"tags": "x", "addr": 3, "n": "42.5"}')]
    df = spark.createDataFrame(rows, "doc_id int, win int, data string")
    got = {r["doc_id"]: r["fields"].asDict(recursive=True) for r in X.merge(df, schema).collect()}
    assert got[1] == {"name": "old", "tags": ["a", "b", "c"], "addr": {"city": "NYC", "zip": 10001}, "n": None}
    empty = {"name": None, "tags": [], "addr": {"city": None, "zip": None}, "n": None}
    assert got[2] == got[3] == empty and got[4] == empty | {"n": 42.5}
    kinds = {"b": "boolean", "i": "integer"}
    values = [("true", 3), ("True", "4"), ("Yes", 5.7), (1, "5.7"), ("no", None), (False, "x"), (0, "")]
    df = spark.createDataFrame([(json.dumps({"b": b, "i": i}),) for b, i in values], "data string")
    assert [tuple(r["fields"]) for r in X.validate(df, kinds).collect()] == [(True, 3), (True, 4), (True, 5), (True, None), (False, None), (False, None), (False, None)]


def test_templates_and_mappings(spark):
    df = spark.sql("SELECT named_struct('output', named_struct('m', 'hi', 'ok', true), 'x', CAST(NULL AS INT)) AS a, '' AS p, 'original' AS q, '' AS r")
    assert df.select(W.template(df, "<a.output.m> <a.output.ok> <a.x> <a.y> <b>")).first()[0] == "hi True None <a.y> <b>"
    got = W.map_inputs(df, [("a.m", "p"), ("a.output.m", "p"), ("a.m", "q"), ("a.x", "r"), ("a.none", "r"), ("a.ok", "new")]).first()
    value = {"x": "<a.output.m>", "y": ["<a.output.ok>", True], "z": {"n": 3, "t": "is <a.x>, <b>"}}
    assert df.select(W.resolved(df, value).alias("v")).first()["v"].asDict(recursive=True) == {"x": "hi", "y": [True, True], "z": {"n": 3, "t": "is None, <b>"}}
    assert (got["p"], got["q"], got["r"], got["new"]) == ("hi\nhi", "original", "", "true")


def test_stream_over_batches(spark, tmp_path):
    kind = "run_id bigint, seq bigint, content string, finish_reason string"
    for k, rows in enumerate(([(1, 1, "he", None), (2, 1, "x", None)], [(1, 3, "lo", "stop"), (1, 2, "l", None), (3, 1, None, "stop")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 * (k == 0))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, drain(fold_chunks(stream), "test").collect())) == [(1, 3, "hello", "stop"), (3, 1, "", "stop")]
