"""Registered queries on texts and section trees."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import text as T
from ..operators import tree as E
from .retrieval import t


def docs(s, d):
    return t(s, d, "documents").select("doc_id", "text")


def marked(s, d):
    """Documents with a header before every fifth line."""
    line = lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (i.bitwiseAND(3) + 1).cast("int")), F.lit(" "), x)).otherwise(x)
    return docs(s, d).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def nodes(s, d):
    return E.headers(marked(s, d))


def thinned(s, d):
    n = E.section_text(marked(s, d), nodes(s, d)).withColumn("tokens", X.word_count(F.col("text")))
    n = E.subtree_sums(n, "tokens").select("doc_id", "line_num", "level", "text", F.col("total").cast("bigint").alias("tokens"))
    return E.thinned(n, 150).select("doc_id", "line_num", "level", "tokens", F.md5("text").alias("h"))


def grouped_pages(s, d):
    p = T.document_pages(docs(s, d), 100).withColumn("tokens", X.word_count(F.col("text")))
    return T.page_groups(p, 400).select("doc_id", "group", F.md5("text").alias("h"))


def items(s, d):
    l = t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag"))
    return l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("ord"), (F.col("l_partkey") % 50 + F.col("l_linenumber") * 3).cast("bigint").alias("physical_index"), F.when(F.col("l_returnflag") == "N", "yes").otherwise("no").alias("appear_start"), F.lit(99).cast("bigint").alias("last"))


def subtree(s, d):
    n = E.section_text(marked(s, d), nodes(s, d)).withColumn("tokens", F.size(X.tokens(F.col("text"))).cast("bigint")).drop("text")
    return E.subtree_sums(n, "tokens").select("doc_id", "line_num", "level", F.col("total").cast("bigint").alias("total"))


def whole_ranges(s, d):
    """Ranges of three pages each that together cover the document."""
    lines = docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    first = F.posexplode(F.sequence(F.lit(0), F.size(F.split("text", "\n")) - 1, F.lit(3)))
    r = docs(s, d).where("text IS NOT NULL").select("doc_id", first.alias("ord", "a")).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "a", (F.col("a") + 2).alias("b"))
    return E.range_text(r, lines).select("doc_id", "ord", F.md5("text").alias("h"))


_MARK = "(SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN repeat('#', ((i - 1) & 3) + 1) || ' ' || x ELSE x END) AS lines FROM documents)"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_HEAD = f"""m AS {_MARK}, l0 AS (SELECT doc_id, unnest(lines) AS line0, unnest(range(1, len(lines) + 1)) AS line_num FROM m),
l AS (SELECT doc_id, line_num, line0, {_STRIP.format('line0')} AS line FROM l0),
h AS (SELECT doc_id, line_num::BIGINT AS line_num, length(regexp_extract(line, '^(#+)', 1))::BIGINT AS level, regexp_extract(line, '^#{{1,6}}\\s+(.+)$', 1) AS title FROM l WHERE regexp_matches(line, '^#{{1,6}}\\s+\\S')),
hp AS (SELECT *, (SELECT max(b.line_num) FROM h b WHERE b.doc_id = h.doc_id AND b.line_num < h.line_num AND b.level < h.level) AS parent_line FROM h)"""
_SEC = f"""{_HEAD}, hn AS (SELECT *, coalesce(lead(line_num) OVER (PARTITION BY doc_id ORDER BY line_num), 1000000000) AS after FROM h),
sec AS (SELECT hn.doc_id, hn.line_num, hn.level, {_STRIP.format("array_to_string(m.lines[hn.line_num:hn.after - 1], chr(10))")} AS text FROM hn JOIN m USING (doc_id))"""
_ITEMS = "SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS ord, (l_partkey % 50 + l_linenumber * 3)::BIGINT AS physical_index, CASE WHEN l_returnflag = 'N' THEN 'yes' ELSE 'no' END AS appear_start, 99::BIGINT AS last FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"

QUERIES = {
    "txt_clean_fixed": lambda s, d: docs(s, d).select("doc_id", F.md5(X.clean_fixed(F.col("text"))).alias("h")),
    "txt_clean_recursive": lambda s, d: docs(s, d).select("doc_id", F.md5(X.clean_recursive(F.col("text"))).alias("h")),
    "txt_document_pages": lambda s, d: T.document_pages(docs(s, d), 100).select("doc_id", "page", F.md5("text").alias("h")),
    "txt_heading_pages": lambda s, d: T.document_pages(marked(s, d), 100, headings=True).select("doc_id", "page", F.md5("text").alias("h")),
    "txt_group_pages": grouped_pages,
    "txt_token_chunks": lambda s, d: T.token_chunks(docs(s, d), 100, 10).select("doc_id", "chunk", "start_char", "end_char", F.md5("text").alias("h")),
    "tre_thinning": thinned,
    "txt_word_pages": lambda s, d: T.word_pages(docs(s, d), 100).select("doc_id", "page", F.md5("text").alias("h")),
    "txt_pages_greedy": lambda s, d: T.pages(docs(s, d), 120, "\n", "\n").select("doc_id", "page", F.md5("text").alias("h")),
    "txt_fixed_chunks_nosnap": lambda s, d: T.fixed_windows(docs(s, d), 400, 50).select("doc_id", "chunk", "start_char", "end_char", F.md5("text").alias("h")),
    "txt_token_offsets": lambda s, d: T.token_offsets(docs(s, d)),
    "txt_embed_batches": lambda s, d: T.embed_batches(t(s, d, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("item_id"), X.word_count(F.col("text")).alias("tokens")), 5000),
    "txt_recursive_chunks": lambda s, d: T.chunk(docs(s, d), T.recursive_spans, 400, 40),
    "txt_fixed_chunks": lambda s, d: T.chunk(docs(s, d), T.fixed_spans, 400, 40),
    "txt_count_windows": lambda s, d: T.count_windows(t(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")), "l_orderkey", "l_linenumber", 3),
    "src_html_clean": lambda s, d: t(s, d, "pages").select("page_id", F.md5(X.clean_html_text(F.regexp_replace("html", "<[^>]*>", "\n"))).alias("h")),
    "src_text_stats": lambda s, d: docs(s, d).select("doc_id", X.line_count(F.col("text")).alias("n_lines"), X.word_count(F.col("text")).alias("n_words")),
    "tre_headers": nodes,
    "tre_section_text": lambda s, d: E.section_text(marked(s, d), nodes(s, d)).select("doc_id", "line_num", "level", F.md5("text").alias("h")),
    "tre_node_ids": lambda s, d: E.node_ids(nodes(s, d)).select("doc_id", "line_num", "node_id"),
    "tre_parent": lambda s, d: E.parents(nodes(s, d)).select("doc_id", "line_num", "parent_line"),
    "tre_leaf_nodes": lambda s, d: E.leaves(E.parents(nodes(s, d))).select("doc_id", "line_num"),
    "tre_subtree_tokens": subtree,
    "tre_page_ranges": lambda s, d: E.page_ranges(items(s, d), "last"),
    "tre_range_text_whole": whole_ranges,
    "tre_page_offset_mode": lambda s, d: E.page_offset(items(s, d).select("doc_id", F.col("ord").alias("pos"), F.col("ord").alias("page"), F.col("physical_index").alias("physical"))),
    "tre_title_match": lambda s, d: E.title_pairs(t(s, d, "part").select(F.col("p_size").alias("doc_id"), F.col("p_brand").alias("title"), F.col("p_partkey").alias("page")), t(s, d, "part").select(F.col("p_size").alias("doc_id"), F.col("p_brand").alias("title"), (F.col("p_partkey") + 3).alias("physical")), 50),
    "tre_asof_bounds": lambda s, d: E.known_bounds(items(s, d).select("doc_id", "ord", F.when(F.col("physical_index") % 3 == 0, F.col("physical_index")).alias("known")), "known"),
    "tre_toc_islands": lambda s, d: E.islands(items(s, d).select("doc_id", F.col("ord").alias("page"), (F.col("physical_index") % 3 == 0).alias("flag")), 2),
}
_W = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
ORACLES = {
    "txt_clean_fixed": f"SELECT doc_id, md5({_STRIP.format('regexp_replace(regexp_replace(text, chr(10) || $$+$$, chr(10), $$g$$), $$ +$$, $$ $$, $$g$$)')}) AS h FROM documents",
    "txt_clean_recursive": f"SELECT doc_id, md5({_STRIP.format('regexp_replace(regexp_replace(text, chr(10) || $${3,}$$, chr(10) || chr(10), $$g$$), $$[ \\t]+$$, $$ $$, $$g$$)')}) AS h FROM documents",
    "txt_word_pages": f"SELECT doc_id, page, md5(array_to_string(w[page * 100 + 1:page * 100 + 100], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 100 + 1)) AS page FROM (SELECT doc_id, {_W} AS w FROM documents) WHERE len(w) > 0)",
    "txt_pages_greedy": """WITH RECURSIVE b AS (SELECT doc_id, trim(x, ' ') AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(x, ' ') <> ''),
w AS (SELECT doc_id, i, x, len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '')) AS n FROM b),
r AS (SELECT doc_id, i, x, n AS s, 0::BIGINT AS page FROM w WHERE i = 1 UNION ALL SELECT w.doc_id, w.i, w.x, CASE WHEN r.s + w.n > 120 THEN w.n ELSE r.s + w.n END, r.page + (r.s + w.n > 120)::BIGINT FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1)
SELECT doc_id, page, md5(string_agg(x, chr(10) ORDER BY i)) AS h FROM r GROUP BY doc_id, page""",
    "txt_fixed_chunks_nosnap": "SELECT doc_id, i AS chunk, i * 350 AS start_char, least(i * 350 + 400, length(text)) AS end_char, md5(substr(text, i * 350 + 1, 400)) AS h FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 400 THEN 1 ELSE ceil((length(text) - 400) / 350)::BIGINT + 1 END)) AS i FROM documents WHERE length(text) > 0)",
    "txt_token_offsets": """WITH x AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS t, string_split_regex(text, '[\\p{L}\\p{N}]+') AS g FROM documents),
u AS (SELECT doc_id, unnest(t) AS token, unnest(g[1:len(t)]) AS gap, unnest(range(0, len(t))) AS pos FROM x)
SELECT doc_id, pos, token, (sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY pos) - length(token))::BIGINT AS start_char FROM u""",
    "txt_embed_batches": f"""WITH RECURSIVE w AS (SELECT source AS group_id, doc_id AS item_id, len({_W}) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT group_id, item_id, i, n AS s, 0::BIGINT AS batch FROM w WHERE i = 1 UNION ALL SELECT w.group_id, w.item_id, w.i, CASE WHEN r.s + w.n > 5000 THEN w.n ELSE r.s + w.n END, r.batch + (r.s + w.n > 5000)::BIGINT FROM r JOIN w ON w.group_id = r.group_id AND w.i = r.i + 1)
SELECT group_id, item_id, batch FROM r""",
    "txt_count_windows": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3 AS \"window\" FROM lineitem",
    "src_html_clean": f"SELECT page_id, md5({_STRIP.format('array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, $$<[^>]*>$$, chr(10), $$g$$), $$ +$$, $$ $$, $$g$$), $$\\n\\s*\\n+$$, chr(10) || chr(10), $$g$$), chr(10)), lambda y: regexp_replace(y, $$^\\s+|\\s+$$$, $$$$, $$g$$)), chr(10))')}) AS h FROM pages".replace("$$^\\s+|\\s+$$$, $$$$", "'^\\s+|\\s+$', ''"),
    "src_text_stats": f"SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines, len({_W})::BIGINT AS n_words FROM documents",
    "tre_headers": f"WITH {_HEAD} SELECT * FROM h",
    "tre_section_text": f"WITH {_SEC} SELECT doc_id, line_num, level, md5(text) AS h FROM sec",
    "tre_node_ids": f"WITH {_HEAD} SELECT doc_id, line_num, lpad((row_number() OVER (PARTITION BY doc_id ORDER BY line_num) - 1)::VARCHAR, 4, '0') AS node_id FROM h",
    "tre_parent": f"WITH {_HEAD} SELECT doc_id, line_num, parent_line FROM hp",
    "tre_leaf_nodes": f"WITH {_HEAD} SELECT doc_id, line_num FROM hp a WHERE NOT EXISTS (SELECT 1 FROM hp b WHERE b.doc_id = a.doc_id AND b.parent_line = a.line_num)",
    "tre_subtree_tokens": f"""WITH {_SEC}, k AS (SELECT doc_id, line_num, level, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS n FROM sec),
e AS (SELECT a.doc_id, a.line_num, a.level, coalesce((SELECT min(b.line_num) FROM k b WHERE b.doc_id = a.doc_id AND b.line_num > a.line_num AND b.level <= a.level), 1000000000) AS stop FROM k a)
SELECT e.doc_id, e.line_num, e.level, sum(k.n)::BIGINT AS total FROM e JOIN k ON k.doc_id = e.doc_id AND k.line_num >= e.line_num AND k.line_num < e.stop GROUP BY ALL""",
    "tre_page_ranges": f"SELECT *, coalesce(lead(physical_index) OVER w - CASE WHEN lead(appear_start) OVER w = 'yes' THEN 1 ELSE 0 END, last)::BIGINT AS end_index FROM ({_ITEMS}) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)",
    "tre_range_text_whole": "SELECT doc_id, k AS ord, md5(array_to_string(lines[3 * k + 1:3 * k + 3], '')) AS h FROM (SELECT doc_id, lines, unnest(range(0, (len(lines) + 2) // 3)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))",
    "tre_page_offset_mode": f"SELECT doc_id, arg_max(diff, c * 1000 - f)::BIGINT AS \"offset\" FROM (SELECT doc_id, physical_index - ord AS diff, count(*) AS c, min(ord) AS f FROM ({_ITEMS}) GROUP BY ALL) GROUP BY doc_id",
    "tre_title_match": "SELECT a.p_size AS doc_id, a.p_brand AS title, a.p_partkey AS page, b.p_partkey + 3 AS physical FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand WHERE b.p_partkey + 3 >= 50",
    "tre_asof_bounds": f"SELECT doc_id, ord, known, last_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(known IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (SELECT doc_id, ord, CASE WHEN physical_index % 3 = 0 THEN physical_index END AS known FROM ({_ITEMS}))",
    "tre_toc_islands": f"WITH f AS (SELECT doc_id, ord AS page FROM ({_ITEMS}) WHERE physical_index % 3 = 0), g AS (SELECT *, coalesce((page - lag(page) OVER (PARTITION BY doc_id ORDER BY page) > 2), TRUE)::INT AS n FROM f), i AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY page)::BIGINT AS island FROM g) SELECT doc_id, island, min(page) AS a, max(page) AS b, count(*) AS n FROM i GROUP BY doc_id, island",
}
