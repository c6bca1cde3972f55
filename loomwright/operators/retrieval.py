"""Retrieval: batches of queries against chunks, as ranked rows (query_id, item_id, score, ...).

A batch of queries is the smaller side and is broadcast after its size is checked; chunks are never broadcast. Ties go by
item id, so results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Queries of a batch that are broadcast at most; a larger batch is joined as Spark sees fit.
BROADCAST_QUERIES = 10_000
K1, B, RRF_K = 1.2, 0.75, 60


@dataclass(frozen=True)
class RetrievalConfig:
    method: str = "vector_search"
    top_k: int = 5
    similarity_threshold: float = 0.0
    filter_metadata: dict | None = None
    vector_weight: float = 0.5
    min_per_source: int | None = None
    max_per_source: int | None = None


def _small(queries: DataFrame) -> DataFrame:
    return F.broadcast(queries) if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else queries


def dot(a: Column, b: Column) -> Column:
    """The sum of products of two vectors, worked in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(rows: DataFrame, name: str) -> DataFrame:
    """rows with the vector of column `name` made one long, once for each row; null where it has no length."""
    length = F.sqrt(dot(F.col(name), F.col(name)))
    made = F.transform(F.array(F.struct(F.col(name).alias("v"), length.alias("n"))), lambda x: F.transform(x["v"], lambda e: F.try_divide(e.cast("double"), x["n"])))
    # exploded, as Spark would otherwise work it out again for each pair
    return rows.select(*[c for c in rows.columns if c != name], F.explode_outer(made).alias(name))


def where_metadata(chunks: DataFrame, wanted: dict | None) -> DataFrame:
    """Rows whose columns equal the wanted values; before scoring, so that scans can skip what doesn't match."""
    for name, value in (wanted or {}).items():
        chunks = chunks.where(F.col(name) == F.lit(value))
    return chunks


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = 5, wanted: dict | None = None) -> DataFrame:
    """queries (query_id, q_vec), chunks (item_id, embedding, ...): the k chunks nearest by cosine."""
    own = unit(where_metadata(chunks, wanted).select("item_id", "embedding"), "embedding")
    pairs = own.join(_small(unit(queries.select("query_id", "q_vec"), "q_vec")), F.lit(True))
    return top_k(pairs.select("query_id", "item_id", F.round(dot(F.col("q_vec"), F.col("embedding")), 6).alias("score")), k)


def threshold(ranked: DataFrame, least: float) -> DataFrame:
    """Scores of `least` or more; 0 or less leaves all, negative scores too. Comes after the top k."""
    return ranked if least <= 0 else ranked.where(F.col("score") >= least)


def postings(chunks: DataFrame) -> DataFrame:
    """(item_id, term, tf, doc_len) of chunks (item_id, text); doc_len counts characters."""
    rows = chunks.select("item_id", F.length("text").alias("doc_len"), F.explode(tokens(F.col("text"))).alias("term"))
    return rows.groupBy("item_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """queries (query_id, query): BM25 of every chunk that has a query term; repeated terms count again."""
    terms = _small(queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))
    stats = chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("avg_len"))
    hits = postings(chunks).join(_small(terms.select("term").distinct()), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(terms, "term").join(df, "term").join(F.broadcast(stats), F.lit(True))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return rows.groupBy("query_id", "item_id").agg(F.round(F.sum(F.col("times") * idf * part), 6).alias("score"))


def full_text_search(queries: DataFrame, chunks: DataFrame, k: int = 5, wanted: dict | None = None) -> DataFrame:
    return top_k(bm25(queries, where_metadata(chunks, wanted)), k)


def rank_fusion(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = 10, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, item_id, rank from 1); the best of a query scores 1.

    Ties keep the order of first sight: by list, then by rank. Scores are scaled before the cut.
    """
    weights = [1.0] * len(lists) if weights is None else list(weights)
    if len(weights) != len(lists):
        raise ValueError(f"{len(lists)} lists, but {len(weights)} weights")
    if not lists:
        return SparkSession.active().createDataFrame([], "query_id bigint, item_id bigint, score double, rank bigint")
    both = None
    for i, (ranked, w) in enumerate(zip(lists, weights, strict=True)):
        own = ranked.select("query_id", "item_id", (F.lit(float(w)) / (constant + F.col("rank") - 1)).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("at")).alias("seen"))
        both = own if both is None else both.unionByName(own)
    fused = both.groupBy("query_id", "item_id").agg(F.sum("part").alias("raw"), F.min("seen").alias("seen"))
    best = Window.partitionBy("query_id")
    fused = fused.withColumn("score", F.round(F.col("raw") / F.max("raw").over(best), 6))
    fused = fused.withColumn("rank", F.row_number().over(best.orderBy(F.desc(F.round("raw", 12)), "seen")).cast("bigint"))
    return fused.where(F.col("rank") <= k).select("query_id", "item_id", "score", "rank")


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int = 5, vector_weight: float = 0.5, wanted: dict | None = None) -> DataFrame:
    """Vector and full-text legs of 2k rows each, fused."""
    vector, words = vector_search(queries, chunks, 2 * k, wanted), full_text_search(queries, chunks, 2 * k, wanted)
    return rank_fusion([vector, words], [vector_weight, 1 - vector_weight], k)


def source_limits(ranked: DataFrame, k: int, least: int | None = None, most: int | None = None) -> DataFrame:
    """The k best rows of each query with at most `most` and, where there are enough, at least `least` of a source.

    ranked: query_id, item_id, score, source_id, ord (the order of ties). Null sources are sources of one row each; null
    scores count as 0; limits of 0 or less are none; `least` can't pass `most`.
    """
    least, most = (x if x and x > 0 else None for x in (least, most))
    if k <= 0:
        return ranked.limit(0).withColumn("rank", F.lit(0).cast("bigint"))
    if least and most:
        least = min(least, most)
    source = F.coalesce("source_id", F.concat(F.lit("\u0000item:"), F.col("item_id").cast("string")))
    best, score = Window.partitionBy("query_id"), F.coalesce("score", F.lit(0.0))
    rows = ranked.withColumn("_s", source).withColumn("_r", F.row_number().over(best.orderBy(F.desc(score), "ord")))
    own = Window.partitionBy("query_id", "_s")
    rows = rows.withColumn("_n", F.row_number().over(own.orderBy("_r"))).withColumn("_b", F.min("_r").over(own))
    if most:
        rows = rows.where(F.col("_n") <= most)
    floor = F.col("_n") <= (least or 0)
    rows = rows.withColumn("_p", F.row_number().over(best.orderBy(F.when(floor, 0).otherwise(1), F.when(floor, F.col("_b")).otherwise(F.col("_r")), "_n")))
    rows = rows.where(F.col("_p") <= k).withColumn("rank", F.row_number().over(best.orderBy("_r")).cast("bigint"))
    return rows.drop("_s", "_r", "_n", "_b", "_p")


def retrieve(queries: DataFrame, chunks: DataFrame, config: RetrievalConfig) -> DataFrame:
    """The plan that a configuration asks for; the threshold holds for vector search alone."""
    c = config
    if c.method == "vector_search":
        out = threshold(vector_search(queries, chunks, c.top_k, c.filter_metadata), c.similarity_threshold)
    elif c.method == "full_text_search":
        out = full_text_search(queries, chunks, c.top_k, c.filter_metadata)
    elif c.method == "hybrid_search":
        out = hybrid_search(queries, chunks, c.top_k, c.vector_weight, c.filter_metadata)
    else:
        raise ValueError(f"unknown method {c.method}")
    if not (c.min_per_source or c.max_per_source):
        return out
    out = out.join(chunks.select("item_id", "source_id"), "item_id").withColumn("ord", F.col("rank"))
    return source_limits(out, c.top_k, c.min_per_source, c.max_per_source)


def parse_tsvector(c: Column) -> Column:
    """Map of term to number of positions for a string like 'cat':1,5 'dog':2."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"('[^']+':[0-9,]+)"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, "'([^']+)':", 1).alias("k"), F.size(F.filter(F.split(F.regexp_extract(x, "':([0-9,]+)", 1), ","), lambda p: p != "")).cast("bigint").alias("v")))
    last = F.aggregate(found, F.create_map().cast("map<string,bigint>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    return last


def node_ids(c: Column) -> Column:
    """Node ids in a model's answer: prefixed ones if any, else bare ones, each once in order of first sight."""
    full, bare = F.regexp_extract_all(c, F.lit(r"(d\d+:\d{4})"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"(\d{4})"), F.lit(1))
    return F.array_distinct(F.when(F.size(full) > 0, full).otherwise(bare))


def hashed_embedding(c: Column, dim: int = 64) -> Column:
    """A deterministic embedding without a model: counts of tokens by hash."""
    at = F.transform(tokens(c), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda h: h == i)).cast("float"))


def rerank(ranked: DataFrame, k: int) -> DataFrame:
    """ranked (query_id, query, item_id, text) by the share of query tokens that the text has; the k best."""
    q, t = F.array_distinct(tokens(F.col("query"))), tokens(F.col("text"))
    score = F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)), F.size(q)), F.lit(0.0))
    return top_k(ranked.select("query_id", "item_id", F.round(score, 6).alias("score")), k)
