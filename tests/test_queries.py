import hashlib
import re

import pytest

from loomwright.plans import registry, retrieval

from .compare import SF, same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(f"{k}_whole" for k in retrieval.WHOLE))
def test_whole_search_set(spark, name):
    """Every row whose id is divisible by 50 is a query; the ten of embeddings, and one of benchmark, on sf0.001."""
    table, key = ("embeddings", "vec_id") if "vector" in name or "limits" in name else ("benchmark", "item_id")
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").where(f"{key} % 50 = 0").select(key).collect()}
    got = {r[0] for r in registry.QUERIES[name](spark, SF).select("query_id").distinct().collect()}
    assert got == want


def test_whole_texts_are_read(spark):
    """Terms behind the eighth, terms with several positions, and the last page of each document."""
    words = {r["item_id"]: re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["item_id"], r["term"]): r["tf"] for r in registry.QUERIES["ret_tsvector_whole"](spark, SF).collect()}
    assert got == {(i, w): ws.count(w) for i, ws in words.items() for w in ws}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").collect():
        lines = r["text"].split("\n")
        want |= {(r["doc_id"], k // 3): hashlib.md5("".join(lines[k : k + 3]).encode()).hexdigest() for k in range(0, len(lines), 3)}
    assert {(r["doc_id"], r["ord"]): r["h"] for r in registry.QUERIES["tre_range_text_whole"](spark, SF).collect()} == want


def test_names_are_registered_once(spark):
    assert len(registry.QUERIES) == sum(len(m.QUERIES) for m in registry.MODULES)
    assert len(registry.ORACLES) == sum(len(m.ORACLES) for m in registry.MODULES)
    with pytest.raises(ValueError):
        registry.merged([{"a": 1}, {"a": 2}])
    got = {r[0] for r in registry.QUERIES["ret_node_ids_order"](spark, "/root/testdata/sf0.1").select("event_id").distinct().collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.1/events.parquet").count() == 100_000
