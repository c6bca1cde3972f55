"""Mixing sources to target weights by weighted fair queueing (operator 2), in DataFrame functions only.

Each source's documents, shuffled by a hash, queue up twice at most. An entry's virtual finish time is its source's
cumulative words divided by the source's target. All entries are ranged by finish time and cut at the total budget.
Cumulative sums go in two levels, buckets of the shuffle order and then rows within a bucket, so that a source with a
third of all rows is spread over as many tasks as it needs.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, words

#: Rows of a bucket, about; a bucket's rows are summed up in one task.
BUCKET_ROWS = 4096
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, rank, source_size, target for rows (source, size), one row per source.

    Sources in code point order, null last, take the weights in turn. The targets share `share` times all sizes by weight;
    no target passes `most` times its source's size, the excess is shared again (water filling: sources fill up in the
    order of limit to weight). The sources themselves are ranked in one task, which handles tens of millions of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", weight)
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.col("before")) / F.col("rest"))
    per = per.withColumn("at", F.row_number().over(order))
    level = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct("at", "level"))).over(Window.partitionBy())["level"]
    return per.withColumn("chosen", level).select("source", "rank", "source_size", F.least("cap", F.col("chosen") * F.col("w")).alias("target"))


def _queue(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """rows (doc_id, source, size, print) with the cumulative words of their source's shuffled queue in `cum`."""
    same = ["doc_id", "source", "size", "print"]
    ones = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    # rows that agree in all this become numbered copies, which the shuffle order then spreads
    ones = ones.select(*same, F.explode(F.expr("sequence(0L, (n - 1) div 65536)")).alias("hi"), "n")
    ones = ones.select(*same, F.explode(F.expr("sequence(hi * 65536, least(n, (hi + 1) * 65536) - 1)")).alias("copy"))
    buckets = max(1, -(-n // BUCKET_ROWS))
    key = F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), F.col("copy").cast("string")))
    ones = ones.withColumn("key", key).withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * F.lit(buckets), 32))
    sums = ones.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    base = sums.select(F.col("source").alias("src"), F.col("bucket").alias("bkt"), (F.sum("s").over(Window.partitionBy("source").orderBy("bucket")) - F.col("s")).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy("key", "size", "print").rowsBetween(Window.unboundedPreceding, 0)
    out = ones.withColumn("off", F.sum("size").over(inner)).join(base, F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("bkt")))
    return out.select(*same, "copy", "key", (F.col("base") + F.col("off")).alias("cum"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, print, copy, source_size, target, times (how often the mix takes it).

    size counts the words of text (null or blank: 0; such documents are never taken). print is a hash of the text that
    tells rows with the same doc_id apart; equal rows are numbered by copy. Null sources form one source. An empty table
    gives an empty result. The order depends on doc_id and seed alone, so reruns agree.
    """
    sizes = materialize(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("text").alias("print")), "mix-sizes")
    n, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = source_targets(sizes, weights, share, float(most)).withColumnRenamed("source", "src")
    placed = _queue(sizes, n, seed).join(targets, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    placed = materialize(placed, "mix-placed")
    rounds = [F.struct(((F.lit(e) * F.col("source_size") + F.col("cum")) / F.col("target")).alias("t"), F.col("rank"), F.lit(e).alias("round"), F.col("key")) for e in range(most)]
    entries = placed.where("size > 0").select("size", F.explode(F.array(*rounds)).alias("e"))
    # finish times spread evenly, about total * share words for each unit of time
    slices = max(1, -(-n * most // BUCKET_ROWS))
    part = F.floor(F.least(F.col("e.t"), F.lit(4.0)) * F.lit(slices)).cast("bigint")
    sums = entries.groupBy(part.alias("part")).agg(F.sum("size").alias("s"))
    running = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("base"), "s")
    edge = running.where((F.col("base") + F.col("s") > share * total) & (F.col("base") <= share * total)).orderBy("part").first()
    if edge is None:  # nothing but empty texts
        return placed.withColumn("times", F.lit(0))
    last = entries.where(part == edge["part"]).withColumn("run", F.sum("size").over(Window.orderBy("e").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(edge["base"]))
    cut = last.where(F.col("run") > share * total).agg(F.min("e").alias("e")).first()["e"]
    line = F.struct(F.lit(cut["t"]).alias("t"), F.lit(cut["rank"]).alias("rank"), F.lit(cut["round"]).alias("round"), F.lit(cut["key"]).alias("key"))
    taken = sum(((r < line).cast("int") for r in rounds[1:]), (rounds[0] < line).cast("int"))
    return placed.withColumn("times", F.when(F.col("size") > 0, taken).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as the mix takes it (0 to `most` times).

    Needs the columns doc_id, source and text; others, whatever their names, pass through unchanged. Rows that agree in
    doc_id, source and text are numbered, by the file part they are read from and within it, and each is taken as often as
    the plan's copy of that number; so rows that differ in other columns alone all count. Null and blank texts are never
    taken, null sources form one source, and an empty table gives an empty result.
    """
    d, same = "_row", ["doc_id", "source", "size", "print"]  # docs' own names are inside the struct
    keys = [f"_k{i}" for i in range(4)]

    def on(left: str, right: str) -> Column:
        return functools.reduce(operator.and_, [F.col(f"{left}{i}").eqNullSafe(F.col(f"{right}{i}")) for i in range(4)])

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(d))
    held = held.withColumns({"_k0": F.col(d)["doc_id"], "_k1": F.col(d)["source"], "_k2": F.size(words(F.col(d)["text"])).cast("bigint"), "_k3": F.xxhash64(F.col(d)["text"])})
    plan = mix_plan(docs.select("doc_id", "source", "text"), weights, share, most, seed)
    plan = plan.select(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(same)], F.col("copy").alias("_copy"), F.col("times").alias("_times"))
    votes = plan.groupBy("_v0", "_v1", "_v2", "_v3").agg(F.count(F.lit(1)).alias("_n"), F.sum("_times").cast("int").alias("_times")).where("_times > 0")
    ones = held.join(votes.where("_n = 1"), on("_k", "_v")).select(d, "_times")

    # rows that agree: numbers within a part, and how many came in the parts before, so that no key's rows meet in one task
    twins = held.join(votes.where("_n > 1").drop("_times"), on("_k", "_v"), "left_semi").withColumn("_at", F.monotonically_increasing_id())
    twins = materialize(twins, "mix-twins")  # the numbers stay as they are
    keyed = twins.select(*keys, "_at", F.shiftright("_at", 33).alias("_part"))
    parts = keyed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.col("_part").alias("_bp"), (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).alias("_base"))
    numbered = keyed.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_at")))
    numbered = numbered.join(before, on("_k", "_b") & (F.col("_part") == F.col("_bp"))).select(*keys, "_at", (F.col("_base") + F.col("_i") - 1).alias("_number"))
    taken = numbered.join(plan.where("_times > 0"), on("_k", "_v") & (F.col("_number") == F.col("_copy"))).select("_at", "_times")
    out = ones.unionByName(twins.select(d, "_at").join(taken, "_at").select(d, "_times"))
    return out.select(d, F.explode(F.expr("sequence(1, _times)")).alias("_again")).select(f"{d}.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '?')) AS print, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 2::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS w FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY cap / w, rank) AS pos,
    (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s0) - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
      / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s AS (SELECT source, rank, source_size, least(cap, (SELECT arg_min(level, pos) FROM s3 WHERE cap / w > level) * w) AS target FROM s3),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, print) - 1 AS copy FROM d),
k AS (SELECT c.*, rank, source_size, target, md5('mix/' || coalesce(doc_id::VARCHAR, 'null') || '/' || copy::VARCHAR) AS key FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, row_number() OVER () AS id, sum(size) OVER (PARTITION BY rank ORDER BY key, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM k),
e AS (SELECT id, size, rank, key, r, (r * source_size + cum)::DOUBLE / target AS t FROM q, (SELECT unnest([0, 1]) AS r) WHERE size > 0),
f AS (SELECT *, sum(size) OVER (ORDER BY t, rank, r, key ROWS UNBOUNDED PRECEDING) AS run FROM e),
g AS (SELECT id, sum(size)::BIGINT AS taken FROM f WHERE run <= 1.5 * (SELECT sum(size) FROM d) GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN g USING (id)
"""
