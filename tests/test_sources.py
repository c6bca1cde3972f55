from pyspark.sql import functions as F

from loomwright.sources import files as S
from loomwright.sources.chunks import ChunkStore
from loomwright.sources.html import extract_html, page_text


def test_page_text():
    page = "<!DOCTYPE html><html><head><title> A &amp; <b>B</b></title><meta name='description' content='no'></head><body><nav>menu</nav><main><h1>Top</h1><p>one  two<br>three<img alt='pic' src=x></p></p><script>var x='</p>';</script><!-- note --><p>four <b>five</b></main>after</body></html>"
    text, title, description = page_text(page)
    assert text == "Top\none two\nthree [Image: pic] note\nfour five" and description is None
    assert title in ("A &B", "A & <b>B</b>")  # whether markup counts in titles is the parser's choice
    assert page_text("") == ("", None, None) and page_text("plain <i>text") == ("plain text", None, None)
    assert page_text("<aside><main>x</main></aside><article>y</article><meta name=description content=d>") == ("y", None, "d")
    assert page_text("<img alt=x>z", alt=False)[0] == "z"


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a<p>b")], "k int, html string")
    got = {r["k"]: r["page"] for r in extract_html(rows).collect()}
    assert got[1] is None and tuple(got[2]) == ("", None, None, 0, 1) and tuple(got[3]) == ("a\nb", None, None, 3, 2)


def test_names_and_bytes(spark):
    names = {"a.html": "text/html", "a/.html": S.UNKNOWN, "x.y/z": S.UNKNOWN, "a.TXT": "text/plain", "": S.UNKNOWN}
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string")
    assert [r[0] for r in df.select(S.mime_type(F.col("n"))).collect()] == [*names.values(), S.UNKNOWN]
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),), (None,)], "b binary")
    assert [r[0] for r in df.select(S.decoded(F.col("b"))).collect()] == ["é", "é", None]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# x")
    got = S.read_files(spark, str(tmp_path)).collect()
    assert [(r["name"], r["mime_type"], r["size"], bytes(r["content"])) for r in got] == [("a.md", "text/markdown", 3, b"# x")]


def test_annotations_with_odd_ids(spark):
    df = spark.sql(r"SELECT '![a\\Eb](u) ![n](n)' AS md, array(named_struct('id', 'a\\Eb', 'note', 'N'), named_struct('id', 'n', 'note', '')) AS notes")
    assert df.select(S.with_annotations(F.col("md"), F.col("notes"))).first()[0] == "![a\\Eb]\n**N** ![n](n)"


def test_chunk_store(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/chunks", "kb_id string, source_id string, pos int, content string")
    assert store.count() == store.delete("s") == 0
    rows = [("k1", "001", 0, "a"), ("k1", "001", 1, "b"), ("k2", "001", 0, "c"), ("k1", "s/2 x", 0, "d")]
    assert store.store(spark.createDataFrame(rows, store.schema)) == 4
    assert (store.count(), store.count("k1"), store.count("k1", "001"), store.count(source_id="s/2 x")) == (4, 3, 2, 1)
    assert store.delete("001") == 3 and [tuple(r) for r in store.read().select("kb_id", "source_id", "pos", "content").collect()] == [rows[3]]
    assert store.delete("s/2 x") == 1 and store.count() == 0
