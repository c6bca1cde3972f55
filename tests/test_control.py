import pytest
from pyspark.sql import functions as F

from loomwright.operators import control as C


def test_urls(spark):
    want = {None: "empty", "": "empty", "ftp://x": "scheme", "http://": "host", "http://LocalHost/": "internal", "http://[::1]:8/": "internal", "http://[fe80::1]/": "internal", "http://[::ffff:8.8.8.8]/": "internal", "http://[2001:db8::1]/": None, "https://a.example:1/p": None, "http://172.31.255.255": "internal", "http://172.32.0.0": None, "http://u@10.0.0.1/": "internal", "http://999.1.1.1/": None}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert [r[0] for r in df.select(C.url_problem(F.col("u"))).collect()] == list(want.values())


def test_event_streams(spark):
    bodies = {None: [], "": [], "data: a\ndata:b\n\n: c\n\ndata: \r\n\r\nevent: x\n": ["a\nb", ""], "data:d\n\n\n\ndata: b": ["d", "b"]}
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert [r[0] for r in df.select(C.sse_payloads(F.col("b"))).collect()] == list(bodies.values())


def test_table_pages(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert [r[0] for r in C.table_page(spark, "ten", ["id"], 3, 4).collect()] == [4, 5, 6]
    with pytest.raises(ValueError):
        C.table_page(spark, "ten; drop", ["id"], 1)
