import collections

import pytest
from pyspark.sql import functions as F

from loomwright.operators import answers as A
from loomwright.operators import graph as G


def block(name, **more):
    return G.Block(name, lambda r: F.lit(name), **more)


def test_order_is_first_come_first_served():
    blocks = [block(x) for x in "dabc"]
    assert G.order(blocks, [G.Edge("a", "d"), G.Edge("b", "d"), G.Edge("a", "c")]) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        G.order(blocks, [G.Edge("a", "b"), G.Edge("b", "a")])
    with pytest.raises(KeyError):
        G.order(blocks, [G.Edge("a", "x")])


def test_blocks_behind_nothing_do_not_run(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    check = G.Block("check", lambda r: F.when(r["x"] == 1, "yes"))
    done = G.execute(rows, [check, block("yes"), block("any"), block("start")], [G.Edge("check", "yes", "yes"), G.Edge("check", "any")])
    got = collections.Counter(map(tuple, done.select("check", "yes", "any", "start").collect()))
    assert got == {(None, None, None, "start"): 2, ("yes", "yes", "any", "start"): 1}
    assert [r["block_id"] for r in G.events(done.where("x = 1"), "x", ["check", "yes", "any", "start"]).orderBy("seq").collect()] == ["check", "yes", "any", "start"]
    with pytest.raises(ValueError):
        G.execute(rows, [block("x")], [])
    assert G.execute(rows.limit(0), [check], []).count() == 0


def test_empty_and_null_answers(spark):
    rows = spark.createDataFrame([("{",), (None,), ("",), ("[1]",)], "u string")
    assert all(set(r["x"].asDict().values()) == {None} for r in rows.select(A.usage(F.col("u")).alias("x")).collect())
    deltas = spark.createDataFrame([(1, 0, None, None, None, None), (1, 1, 0, "", "", '{"a"')], "run_id int, seq int, index int, id string, name string, arguments string")
    assert [tuple(r) for r in A.tool_calls(deltas).select("index", "id", "name", "arguments", "whole").collect()] == [(0, "call_0", "", '{"a"', False)]
    assert A.tool_calls(deltas.where("run_id > 1")).count() == 0
    picked = spark.createDataFrame([(1, 0, "d9:x"), (1, 1, "dx:0001"), (1, 2, "0001"), (1, 3, None)], "query_id int, pos int, id string")
    nodes = spark.createDataFrame([(0, "0001", "a"), (0, "0001", "a"), (None, "0002", "b")], "doc int, node_id string, title string")
    assert [tuple(r) for r in A.selected_nodes(picked, nodes).collect()] == [(1, 0, 0, "0001", "a")]
    got = A.selected_documents(picked, nodes.select("doc"), spark.createDataFrame([(1,), (2,)], "query_id int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, None, None), (2, None, None)]
