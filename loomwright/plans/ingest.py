"""Registered queries on files, pages and what extraction gives."""

from pyspark.sql import functions as F

from ..operators import control as C
from ..sources import files as S
from ..sources.html import extract_html
from .retrieval import t


def html_extract(s, d):
    return extract_html(t(s, d, "pages").select("page_id", "url", "html")).select("page_id", "url", "page.title", "page.description", "page.text", "page.char_count", "page.line_count")


def names(s, d):
    ending = F.element_at(F.array(*map(F.lit, (".html", ".MD", ".pdf", "", ".csv.gz", ".json"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return t(s, d, "documents").select("doc_id", F.concat(F.lit("dir.x/file"), F.col("doc_id").cast("string"), ending).alias("name"))


def mime_guess(s, d):
    return names(s, d).withColumn("mime_type", S.mime_type(F.col("name")))


def extractor_route(s, d):
    mime = F.element_at(F.array(*map(F.lit, ("text/html; charset=x", "text/rtf", "image/png", "text/plain", "audio/ogg", "text/html"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return t(s, d, "documents").select("doc_id", mime.alias("mime_type")).withColumn("extractor", S.extractor(F.col("mime_type")))


def derivatives(s, d):
    kind = F.element_at(F.array(*map(F.lit, ("page_text", "text", "html", "image", "markdown"))), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 + 1).cast("int"))
    rows = t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.concat(F.min("l_returnflag"), F.lit(" "), F.min("l_partkey").cast("string")).alias("content"), F.min("l_partkey").alias("pages"))
    return rows.select(F.col("l_orderkey").alias("uri"), F.col("l_linenumber").alias("ord"), kind.alias("type"), "content", "pages")


def page_batches(s, d):
    return S.page_batches(t(s, d, "part").select(F.col("p_partkey").alias("uri"), F.col("p_size").alias("pages")), 15)


def batch_merge(s, d):
    return S.merge_batches(derivatives(s, d).select("uri", F.col("ord").alias("batch"), F.col("content").alias("markdown"), F.col("pages").alias("pages_processed")))


def annotations(s, d):
    md = F.concat(F.lit("![a.1](a.1) ![b](http://x/"), F.col("p_partkey").cast("string"), F.lit(") ![b](b$1) ![c](c)"))
    note = lambda i, n: F.struct(F.lit(i).alias("id"), n.alias("note"))
    notes = F.array(note("a.1", F.col("p_brand")), note("b", F.concat(F.lit("$1 "), "p_type")), note("c", F.lit(None).cast("string")))
    return t(s, d, "part").select("p_partkey", S.with_annotations(md, notes).alias("markdown"))


def sse(s, d):
    body = F.concat(F.lit(": hi\nevent: m\r\ndata: "), "p_brand", F.lit("\r\ndata:  "), "p_type", F.lit("\r\n\r\n\ndata:\n\nid: 3\n\ndata:end"))
    return t(s, d, "part").select("p_partkey", F.posexplode(C.sse_payloads(body)).alias("pos", "payload"))


def urls(s, d):
    ip = lambda f: F.concat_ws(".", *[(F.col("p_partkey") * k % 256).cast("string") for k in f])
    url = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://u:p@"), ip((1, 7, 11, 13)), F.lit(":80/x"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("http://172."), ip((5, 3, 1)), F.lit("?q=://a"))).otherwise(F.concat(F.lit("ftp://x/"), F.col("p_partkey").cast("string")))
    return t(s, d, "part").select("p_partkey", url.alias("url")).withColumn("problem", C.url_problem(F.col("url")))


def thresholds(s, d):
    return t(s, d, "part").select("p_partkey", C.context_threshold(F.col("p_partkey") * 997 + 4000, F.col("p_size") * 900).alias("threshold"))


_D = """WITH d AS (SELECT l_orderkey AS uri, l_linenumber AS ord, ['page_text', 'text', 'html', 'image', 'markdown'][((l_orderkey + l_linenumber) % 5 + 1)::INT] AS type,
min(l_returnflag) || ' ' || min(l_partkey) AS content, min(l_partkey) AS pages FROM lineitem GROUP BY ALL)
"""
_NAMES = "SELECT doc_id, 'dir.x/file' || doc_id || ['.html', '.MD', '.pdf', '', '.csv.gz', '.json'][(doc_id % 6 + 1)::INT] AS name, doc_id % 6 AS k FROM documents"

QUERIES = {
    "src_html_extract": html_extract,
    "src_mime_guess": mime_guess,
    "src_extractor_route": extractor_route,
    "src_primary_text": lambda s, d: S.primary_text(derivatives(s, d)),
    "src_all_text": lambda s, d: S.all_text(derivatives(s, d)),
    "src_page_batches": page_batches,
    "src_batch_merge": batch_merge,
    "src_image_annotations": annotations,
    "snk_sse_payloads": sse,
    "agt_url_check": urls,
    "agt_context_threshold": thresholds,
}
ORACLES = {
    "src_mime_guess": f"SELECT doc_id, name, ['text/html', 'text/markdown', 'application/pdf', 'application/octet-stream', 'text/csv', 'application/json'][(k + 1)::INT] AS mime_type FROM ({_NAMES})",
    "src_extractor_route": """SELECT doc_id, ['text/html; charset=x', 'text/rtf', 'image/png', 'text/plain', 'audio/ogg', 'text/html'][(doc_id % 6 + 1)::INT] AS mime_type,
['html', 'text', 'image', 'txt', NULL, 'html'][(doc_id % 6 + 1)::INT] AS extractor FROM documents""",
    "src_primary_text": _D + "SELECT uri, arg_min(content, list_position(['markdown', 'text', 'html'], type) * 1000 + ord) AS text FROM d WHERE type IN ('markdown', 'text', 'html') GROUP BY uri",
    "src_all_text": _D + "SELECT uri, string_agg(content, E'\\n\\n' ORDER BY ord) AS text FROM d WHERE type IN ('markdown', 'text', 'html') GROUP BY uri",
    "src_page_batches": "SELECT p_partkey AS uri, b AS batch, b * 15 + 1 AS first_page, least(b * 15 + 15, p_size)::BIGINT AS last_page FROM (SELECT p_partkey, p_size, unnest(range(0, ((p_size - 1) // 15)::BIGINT + 1)) AS b FROM part WHERE p_size > 0)",
    "src_batch_merge": _D + "SELECT *, length(markdown)::BIGINT AS char_count FROM (SELECT uri, string_agg(content, E'\\n\\n' ORDER BY ord) AS markdown, sum(pages)::BIGINT AS pages_processed, count(*) AS batch_count FROM d GROUP BY uri)",
    "src_image_annotations": """SELECT p_partkey, E'![a.1]\\n**' || p_brand || E'** ![b]\\n**$1 ' || p_type || E'** ![b]\\n**$1 ' || p_type || '** ![c](c)' AS markdown FROM part""",
    "snk_sse_payloads": "SELECT p_partkey, unnest([0, 1, 2])::INT AS pos, unnest([p_brand || E'\\n ' || p_type, '', 'end']) AS payload FROM part",
    "agt_url_check": """SELECT p_partkey, url, CASE WHEN k = 2 THEN 'scheme' WHEN a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) THEN 'internal' END AS problem FROM (
SELECT p_partkey, p_partkey % 3 AS k, CASE WHEN p_partkey % 3 = 1 THEN 172 ELSE p_partkey % 256 END AS a, CASE WHEN p_partkey % 3 = 1 THEN p_partkey * 5 % 256 ELSE p_partkey * 7 % 256 END AS b,
CASE p_partkey % 3 WHEN 0 THEN 'https://u:p@' || concat_ws('.', p_partkey % 256, p_partkey * 7 % 256, p_partkey * 11 % 256, p_partkey * 13 % 256) || ':80/x'
WHEN 1 THEN 'http://172.' || concat_ws('.', p_partkey * 5 % 256, p_partkey * 3 % 256, p_partkey % 256) || '?q=://a' ELSE 'ftp://x/' || p_partkey END AS url FROM part)""",
    "agt_context_threshold": """SELECT p_partkey, (w - least(greatest(r, 8000), w - b - trunc(w * 0.25::DOUBLE)::BIGINT) - b)::BIGINT AS threshold FROM (SELECT *, least(greatest(13000, trunc(w * 0.08::DOUBLE)::BIGINT), trunc(w * 0.25::DOUBLE)::BIGINT) AS b
FROM (SELECT p_partkey, p_partkey * 997 + 4000 AS w, p_size * 900 AS r FROM part))""",
}
