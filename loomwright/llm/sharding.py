"""Sharding by jump consistent hashing (operator 5), in DataFrame functions only.

A shard follows from the key and the number of shards alone, without a ring table; with one more shard only
1/(n+1) of the rows move, all of them into the new shard. The 64-bit linear congruential step is worked in four
16-bit limbs, so that it wraps as unsigned arithmetic does, with ANSI overflow checks on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed value: the multiplier that jump consistent hashing is defined with.
MULTIPLIER = 2862933555777941757
#: Rows that one (shard, block) group holds about; groups of this size get their slots in one task.
BLOCK_ROWS = 16384


def _step(s: str) -> str:
    """Limbs of key * MULTIPLIER + 1 modulo 2^64 for the limbs s.a0 to s.a3, as a struct without names."""
    m = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
    carry, limbs = "1L", []
    for i in range(4):
        column = " + ".join(f"{s}.a{j} * {m[i - j]}L" for j in range(i + 1))
        total = f"({column} + {carry})"
        limbs.append(f"({total} & 65535L)")
        carry = f"shiftright({total}, 16)"
    return ", ".join(f"'a{i}', {x}" for i, x in enumerate(limbs))


def jump(key: str, shards: int) -> Column:
    """Struct of shard (of `shards`), grown (of one more) and mix, a 31-bit hash of the key that is free for other uses.

    key: a BIGINT expression in SQL; null counts as 0.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    k = f"coalesce(CAST({key} AS BIGINT), 0L)"
    limbs = ", ".join(f"'a{i}', shiftright({k}, {16 * i}) & 65535L" for i in range(4))
    go, r = f"s.j <= {shards}L", "shiftright(t.a3 * 65536L + t.a2, 1)"
    # b: the last jump; was: the last one below `shards`; j: the next. The turn after the first gives mix, so there are two at least.
    turn = (
        f"CASE WHEN {go} OR s.i < 2 THEN transform(array(named_struct({_step('s')})), t -> named_struct('a0', t.a0, 'a1', t.a1, 'a2', t.a2, 'a3', t.a3, "
        f"'b', CASE WHEN {go} THEN s.j ELSE s.b END, 'was', CASE WHEN s.j < {shards}L THEN s.j ELSE s.was END, "
        f"'j', CASE WHEN {go} THEN CAST(floor((s.j + 1L) * (2147483648.0D / ({r} + 1L))) AS BIGINT) ELSE s.j END, 'i', s.i + 1L, "
        f"'mix', CASE WHEN s.i = 1L THEN {r} ELSE s.mix END))[0] ELSE s END"
    )
    return F.expr(
        f"transform(array(aggregate(sequence(0, {shards + 1}), named_struct({limbs}, 'b', -1L, 'was', -1L, 'j', 0L, 'i', 0L, 'mix', 0L), (s, z) -> {turn})), "
        "s -> named_struct('shard', CAST(s.was AS INT), 'grown', CAST(s.b AS INT), 'mix', s.mix))[0]"
    )


def assign_shards(docs: DataFrame, key: str = "doc_id", shards: int = 16, into: str = "shard") -> DataFrame:
    """docs with the column `into`: the row's shard, 0 to shards - 1. No shuffle; rows with equal keys share a shard.

    String keys are hashed first (xxhash64); null keys count as key 0. A column named as `into` is replaced.
    """
    k = f"`{key}`"
    if dict(docs.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        k = f"if({k} IS NULL, NULL, xxhash64({k}))"
    return docs.withColumn(into, jump(k, shards)["shard"])


def shard_slots(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    slot numbers the rows of a shard from 0 without gaps. Rows of a shard are dealt into blocks by a second hash of the
    key; within a block, rows are numbered by id, size and checksum, in two levels, and the blocks' totals, a few for each
    16384 rows, shift them. Rows that agree in all three are counted before the shuffle and numbered afterwards; rows of
    one id are split by size.
    Null texts have size 1 and checksum 0; null keys count as key 0; an empty table gives an empty result.
    """
    blocks = max(1, -(-docs.count() // (BLOCK_ROWS * shards)))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("h", jump("doc_id", shards))
        .select("doc_id", "size", "text_crc32", "n", F.col("h.shard").alias("shard"), F.col("h.grown").alias("grown_shard"), F.shiftright(F.col("h.mix") * F.lit(blocks), 31).alias("block"))
    )
    # blocks, then ids and sizes within a block, then rows of one id and size: an id with very many rows is split by size
    group, order = ["shard", "block", "doc_id", "size"], "ORDER BY doc_id NULLS FIRST, size"
    totals = rows.groupBy(*group).agg(F.sum("n").alias("t"))
    blocks_before = totals.groupBy("shard", "block").agg(F.sum("t").alias("t")).selectExpr("shard AS s2", "block AS b2", "sum(t) OVER (PARTITION BY shard ORDER BY block) - t AS base")
    before = totals.selectExpr("shard AS s1", "block AS b1", "doc_id AS d1", "size AS z1", f"sum(t) OVER (PARTITION BY shard, block {order}) - t AS mid")
    placed = rows.selectExpr("*", f"sum(n) OVER (PARTITION BY {', '.join(group)} ORDER BY text_crc32) - n AS off")
    placed = placed.join(before, (F.col("shard") == F.col("s1")) & (F.col("block") == F.col("b1")) & F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("size") == F.col("z1")))
    placed = placed.join(blocks_before, (F.col("shard") == F.col("s2")) & (F.col("block") == F.col("b2"))).withColumn("first", F.expr("base + mid + off"))
    # rows that agree are numbered in runs of 65536
    placed = placed.select("*", F.explode(F.expr("sequence(0L, (n - 1) div 65536)")).alias("run"))
    slot = F.explode(F.expr("sequence(first + run * 65536, first + least(n, (run + 1) * 65536) - 1)"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_slots(table(spark, sf_dir, "documents"), 16)


_JUMP = """list_reduce(list_prepend({'k': (CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END),
    'b': (-1)::BIGINT, 'j': 0::BIGINT, 'i': 0::BIGINT, 'mix': 0::BIGINT}, list_transform(range(%(turns)d), lambda z: {'k': 0::HUGEINT, 'b': 0::BIGINT, 'j': 0::BIGINT, 'i': 0::BIGINT, 'mix': 0::BIGINT})),
  lambda s, z: {'k': (s.k * 2862933555777941757 + 1) %% 18446744073709551616,
    'b': CASE WHEN s.j < %(n)d THEN s.j ELSE s.b END,
    'j': CASE WHEN s.j < %(n)d THEN floor((s.j + 1) * (2147483648::DOUBLE / ((((s.k * 2862933555777941757 + 1) %% 18446744073709551616) // 8589934592) + 1)::DOUBLE))::BIGINT ELSE s.j END,
    'i': s.i + 1,
    'mix': CASE WHEN s.i = 1 THEN (((s.k * 2862933555777941757 + 1) %% 18446744073709551616) // 8589934592)::BIGINT ELSE s.mix END})"""

ORACLE = f"""
WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, (length(x) // 2 + 1)::BIGINT AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: (('0x' || substr(x, i * 2 + 1, 2))::BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS text_crc32 FROM h, tbl),
j AS (SELECT *, {_JUMP % dict(n=16, turns=18)} AS h16, {_JUMP % dict(n=17, turns=18)} AS h17 FROM c),
b AS (SELECT *, h16.b::INT AS shard, h17.b::INT AS grown_shard,
    ((h16.mix::HUGEINT * greatest(1, ((SELECT count(*) FROM documents) + {BLOCK_ROWS * 16 - 1}) // {BLOCK_ROWS * 16})) // 2147483648)::BIGINT AS block FROM j)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
    (row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM b
"""
