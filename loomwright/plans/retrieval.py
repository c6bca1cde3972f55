"""Registered retrieval queries."""

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import retrieval as R


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark, sf):
    return t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("source").alias("source_id"))


def questions(spark, sf):
    first = F.array_join(F.slice(tokens(F.col("text")), 1, 6), " ")
    return t(spark, sf, "benchmark").where("item_id < 5").select(F.col("item_id").alias("query_id"), first.alias("query"))


def whole_questions(spark, sf):
    """The search set: benchmark rows whose id is divisible by 50, with their whole texts."""
    return t(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def whole_vectors(spark, sf):
    q = t(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))
    return q, vectors(spark, sf)[1]


def vectors(spark, sf):
    e = t(spark, sf, "embeddings")
    return e.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec")), e.select(F.col("vec_id").alias("item_id"), "embedding", "label", F.concat(F.lit("s"), F.col("label").cast("string")).alias("source_id"))


def _vector(k=5, least=0.0, wanted=None, sides=vectors):
    return lambda s, d: R.threshold(R.vector_search(*sides(s, d), k, wanted), least)


#: Chunk vectors for the hybrid leg: how often the ten vowels and consonants below stand in the text.
LETTERS = "aeioutnsrh"


def _letters(c):
    return F.array(*[(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double") for x in LETTERS])


def hybrid(s, d, asked=questions):
    q = asked(s, d).withColumn("q_vec", _letters(F.col("query")))
    return R.hybrid_search(q, chunks(s, d).withColumn("embedding", _letters(F.col("text"))), 5)


def limited(k, least, most, sides=vectors):
    def run(s, d):
        q, e = sides(s, d)
        pool = R.vector_search(q, e, 50).join(e.select("item_id", "source_id"), "item_id").withColumn("ord", F.col("item_id"))
        return R.source_limits(pool, k, least, most).select("query_id", "item_id", "score", "source_id", "rank")
    return run


def fused(weights):
    def run(s, d):
        q, e = vectors(s, d)
        a, b = R.vector_search(q, e, 10), R.vector_search(q, e.where("label % 2 = 0"), 10)
        return R.rank_fusion([a, b], weights, 8)
    return run


def whole_fused(weights):
    """Vector and full-text searches over the documents, fused."""
    def run(s, d):
        q, c = whole_questions(s, d), chunks(s, d)
        a = R.vector_search(q.withColumn("q_vec", _letters(F.col("query"))), c.withColumn("embedding", _letters(F.col("text"))), 10)
        return R.rank_fusion([a, R.full_text_search(q, c, 10)], weights, 8)
    return run


def whole_tsvector(s, d):
    """Every term of a text with all its positions, as to_tsvector writes them."""
    terms = F.transform(F.array_distinct("w"), lambda x: F.concat(F.lit("'"), x, F.lit("':"), F.array_join(F.transform("w", lambda y, i: F.when(y == x, (i + 1).cast("string"))), ",")))
    m = t(s, d, "benchmark").select("item_id", tokens(F.col("text")).alias("w")).select("item_id", R.parse_tsvector(F.array_join(terms, " ")).alias("m"))
    return m.select("item_id", F.explode("m").alias("term", "tf"))


def tsvector(s, d):
    v = F.concat_ws(" ", F.transform(F.slice(tokens(F.col("text")), 1, 8), lambda w: F.concat(F.lit("'"), w, F.lit("':1,"), F.length(w).cast("string"))))
    m = t(s, d, "benchmark").select("item_id", R.parse_tsvector(v).alias("m"))
    return m.select("item_id", F.explode("m").alias("term", "tf"))


def reranked(s, d, asked=questions):
    q, c = asked(s, d), chunks(s, d)
    return R.rerank(R.full_text_search(q, c, 20).join(q, "query_id").join(c, "item_id"), 5)


def parsed_ids(s, d):
    x = F.concat(F.lit("pick d1:"), F.lpad(F.col("event_id").cast("string"), 4, "0"), F.lit(" then d2:0007, d1:"), F.lpad(F.col("event_id").cast("string"), 4, "0"))
    return t(s, d, "events").select("event_id", F.posexplode(R.node_ids(F.when(F.col("event_id") % 2 == 0, x).otherwise(F.concat(F.lit("see 0012 and "), F.lpad(F.col("event_id").cast("string"), 4, "0")))))).select("event_id", F.col("pos").cast("bigint").alias("pos"), F.col("col").alias("node_id"))


_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"
_PAIRS = f"(SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label, {_COS} AS score FROM embeddings q, embeddings e WHERE q.vec_id < 5)"


def _top(pairs, k, more=""):
    return f"SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {pairs} {more}) WHERE rank <= {k}"


_TOK = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
_BM25 = f"""q AS (SELECT item_id AS query_id, unnest({_TOK.format('text')}[1:6]) AS term FROM benchmark WHERE item_id < 5),
p AS (SELECT doc_id AS item_id, length(text) AS len, term, count(*) AS tf FROM (SELECT doc_id, text, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), st AS (SELECT count(*) AS n, avg(length(text)) AS al FROM documents),
bm AS (SELECT query_id, item_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL)"""
_FUSE = """f AS (SELECT query_id, item_id, sum(part) AS raw, min(list * 1000 + rank) AS seen FROM legs GROUP BY ALL),
g AS (SELECT query_id, item_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 12) DESC, seen) AS rank FROM f)"""
_LET = "[" + ", ".join(f"(length({{0}}) - length(replace({{0}}, '{x}', '')))::DOUBLE" for x in LETTERS) + "]"


def _limits(k, least, most):
    return f"""WITH pool AS ({_top(_PAIRS, 50)}), s AS (SELECT pool.*, 's' || label::VARCHAR AS source_id FROM pool JOIN embeddings ON item_id = vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY r) AS n, min(r) OVER (PARTITION BY query_id, source_id) AS b FROM r),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (n > {least or 0}), CASE WHEN n <= {least or 0} THEN b ELSE r END, n) AS p FROM n WHERE n <= {most or 10**9})
SELECT query_id, item_id, score, source_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM c WHERE p <= {k}"""


def _fused(w):
    return f"""WITH a AS ({_top(_PAIRS, 10)}), b AS ({_top(_PAIRS, 10, 'WHERE label % 2 = 0')}),
legs AS (SELECT query_id, item_id, rank, 0 AS list, {w[0]}::DOUBLE / (59 + rank) AS part FROM a UNION ALL SELECT query_id, item_id, rank, 1, {w[1]}::DOUBLE / (59 + rank) FROM b), {_FUSE} SELECT * FROM g WHERE rank <= 8"""


QUERIES = {
    "ret_vector_topk": _vector(), "ret_vector_threshold": _vector(20, 0.3), "ret_vector_filtered": _vector(5, 0.0, {"label": 3}),
    "ret_bm25_terms": lambda s, d: R.bm25(questions(s, d), chunks(s, d)), "ret_bm25_topk": lambda s, d: R.full_text_search(questions(s, d), chunks(s, d), 10),
    "ret_tsvector_parse": tsvector, "ret_rrf_fuse": fused(None), "ret_rrf_weighted": fused([0.7, 0.3]), "ret_hybrid_search": hybrid,
    "ret_limits_cap": limited(10, None, 2), "ret_limits_floor": limited(12, 1, None), "ret_limits_both": limited(10, 1, 3),
    "ret_rerank": reranked, "ret_node_ids_order": parsed_ids,
}
ORACLES = {
    "ret_vector_topk": _top(_PAIRS, 5), "ret_vector_threshold": f"SELECT * FROM ({_top(_PAIRS, 20)}) WHERE score >= 0.3", "ret_vector_filtered": _top(_PAIRS, 5, "WHERE label = 3"),
    "ret_bm25_terms": f"WITH {_BM25} SELECT * FROM bm", "ret_bm25_topk": f"WITH {_BM25} {_top('bm', 10)}",
    "ret_tsvector_parse": f"WITH w AS (SELECT item_id, {_TOK.format('text')}[1:8] AS w FROM benchmark), u AS (SELECT DISTINCT item_id, unnest(w) AS term FROM w) SELECT item_id, term, 2::BIGINT AS tf FROM u",
    "ret_rrf_fuse": _fused((1, 1)), "ret_rrf_weighted": _fused((0.7, 0.3)),
    "ret_hybrid_search": f"""WITH {_BM25}, qq AS (SELECT item_id AS query_id, array_to_string({_TOK.format('text')}[1:6], ' ') AS query FROM benchmark WHERE item_id < 5),
v AS (SELECT query_id, doc_id AS item_id, CASE WHEN list_sum({_LET.format('text')}) > 0 THEN round(list_cosine_similarity({_LET.format('query')}, {_LET.format('text')}), 6) END AS score FROM qq, documents),
a AS ({_top('v', 10)}), b AS ({_top('bm', 10)}), legs AS (SELECT query_id, item_id, rank, 0 AS list, 0.5::DOUBLE / (59 + rank) AS part FROM a UNION ALL SELECT query_id, item_id, rank, 1, 0.5::DOUBLE / (59 + rank) FROM b), {_FUSE} SELECT * FROM g WHERE rank <= 5""",
    "ret_limits_cap": _limits(10, None, 2), "ret_limits_floor": _limits(12, 1, None), "ret_limits_both": _limits(10, 1, 3),
    "ret_node_ids_order": "WITH e AS (SELECT event_id, lpad(event_id::VARCHAR, 4, '0') AS p FROM events), l AS (SELECT event_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['d1:' || p, 'd2:0007'] WHEN p = '0012' THEN ['0012'] ELSE ['0012', p] END) AS node_id, unnest(CASE WHEN event_id % 2 = 0 OR p <> '0012' THEN [0, 1] ELSE [0] END)::BIGINT AS pos FROM e) SELECT * FROM l",
}


def _whole(sql):
    """SQL of the whole search set from that of the first ids and words."""
    for a, b in (("vec_id < 5", "vec_id % 50 = 0"), ("item_id < 5", "item_id % 50 = 0"), (f"array_to_string({_TOK.format('text')}[1:6], ' ')", "coalesce(text, '')"), ("[1:6]", "")):
        sql = sql.replace(a, b)
    return sql


def _whole_fused(w):
    sql = ORACLES["ret_hybrid_search"].replace("0.5::DOUBLE / (59 + rank) AS part", f"{w[0]}::DOUBLE / (59 + rank) AS part")
    return _whole(sql.replace("rank, 1, 0.5::DOUBLE", f"rank, 1, {w[1]}::DOUBLE").replace("rank <= 5", "rank <= 8"))


#: The queries above for every row whose id is divisible by 50 and for whole texts.
WHOLE = {
    "ret_vector_topk": _vector(sides=whole_vectors), "ret_vector_threshold": _vector(20, 0.3, sides=whole_vectors), "ret_vector_filtered": _vector(5, 0.0, {"label": 3}, whole_vectors),
    "ret_bm25_terms": lambda s, d: R.bm25(whole_questions(s, d), chunks(s, d)), "ret_bm25_topk": lambda s, d: R.full_text_search(whole_questions(s, d), chunks(s, d), 10),
    "ret_rrf_fuse": whole_fused(None), "ret_rrf_weighted": whole_fused([0.7, 0.3]), "ret_hybrid_search": lambda s, d: hybrid(s, d, whole_questions),
    "ret_limits_cap": limited(10, None, 2, whole_vectors), "ret_limits_floor": limited(12, 1, None, whole_vectors), "ret_limits_both": limited(10, 1, 3, whole_vectors),
    "ret_rerank": lambda s, d: reranked(s, d, whole_questions),
}
QUERIES["ret_tsvector_whole"] = whole_tsvector
ORACLES["ret_tsvector_whole"] = f"SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL"
ORACLES |= {f"{k}_whole": _whole(ORACLES[k]) for k in WHOLE if k in ORACLES and "rrf" not in k} | {"ret_rrf_fuse_whole": _whole_fused((1, 1)), "ret_rrf_weighted_whole": _whole_fused((0.7, 0.3))}
QUERIES |= {f"{k}_whole": q for k, q in WHOLE.items()}
for _k in [*WHOLE, "ret_tsvector_parse"]:  # the statements above are those that the whole ones are made of; only these are registered
    QUERIES.pop(_k)
    ORACLES.pop(_k, None)
