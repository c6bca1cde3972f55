"""Benchmark decontamination (operator 6) by Wu-Manber search over words.

The patterns are the 13-word windows of the benchmark's items (a shorter item is one pattern), searched in groups of
equal length. A shift table, indexed by a hash of a block of two words, tells how far the search may jump from a
position; it has eight slots or more for each block of the benchmark, so that few positions of other texts read zero.
Where it says zero, the hash of the last block picks a bucket of patterns, the hash of the whole window those in the
bucket to compare, and the words themselves are compared, byte by byte. Many documents are searched at once: each lane of
the search is a cursor of its own, and numpy moves all.

Patterns are flat arrays of places in the benchmark's words, about 100 bytes for each word of the benchmark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import flat, slices, tidy
from .common import fresh, table

WINDOW, BLOCK = 13, 2
#: Bits of a shift table's index, at least and at most; words of a lane; bytes of text searched, and of words compared, at once.
BITS, LANE, AT_ONCE, COMPARED = (12, 26), 512, 1 << 20, 4 << 20
#: Words that are hashed at once; rows of an Arrow batch, each with whole texts.
HASHED, BATCH_ROWS = 1 << 14, 1000
#: Benchmark text that is held at once, in bytes; a larger benchmark is searched in several passes without a shuffle.
BENCH_BYTES = 16 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_PLACES = np.random.default_rng(13).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """The lower-cased words, runs of the bytes in `signs`, of several texts: start and end of each in `data`, its hash, its text's number."""

    def __init__(self, texts: pa.Array, signs: np.ndarray = _WORD):
        data, offsets, _ = flat(texts)
        self.data = _LOWER[data]
        inside = signs[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[offsets] = True
        before, after = np.append(False, inside[:-1]) if len(inside) else inside, np.append(inside[1:], False) if len(inside) else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.hash = np.zeros(len(self.start), np.uint64)
        for k in range(0, len(self.start), HASHED):  # a byte takes some 40 bytes here
            start = self.start[k : k + HASHED]
            length = self.end[k : k + HASHED] - start
            first = np.cumsum(length) - length
            at, place = _spread(start, length), _spread(np.zeros(len(start), np.int64), length)
            self.hash[k : k + HASHED] = np.add.reduceat((self.data[at].astype(np.uint64) + np.uint64(1)) * _PLACES[place & 4095], first)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    return x ^ (x >> np.uint64(29))


def _block(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the block of `size` words that ends at each position."""
    x = h[at] * _M1
    if size > 1:
        x = x + (h[at - 1] ^ (h[at - 1] >> np.uint64(29))) * _M2
    return _mix(x)


def _window(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m words from each position on."""
    x = np.zeros(len(first), np.uint64)
    for j in range(m):
        x = x * _M2 + h[first + j]
    return _mix(x)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of n[i] numbers each, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _equal(a: Words, i: np.ndarray, b: Words, j: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words of a from each i on are those of b from j on, byte by byte."""
    out = np.zeros(len(i), bool)
    step = max(1, COMPARED // (m * 64))
    for k in range(0, len(i), step):
        x, y = (z[k : k + step, None] + np.arange(m) for z in (i, j))
        n = a.end[x] - a.start[x]
        ok = (n == b.end[y] - b.start[y]).all(1)
        n, x, y = n[ok].ravel(), x[ok].ravel(), y[ok].ravel()
        if len(n):
            differ = a.data[_spread(a.start[x], n)] != b.data[_spread(b.start[y], n)]
            ok[ok] = np.add.reduceat(differ, (np.cumsum(n) - n)[::m], dtype=np.int64) == 0
        out[k : k + step] = ok
    return out


class Group:
    """Wu-Manber tables for the patterns of m words: windows of `bench` that start at `first`, each of an item."""

    def __init__(self, m: int, bench: Words, first: np.ndarray, item: np.ndarray):
        self.m, self.block, self.bench = m, min(BLOCK, m), bench
        most = m - self.block + 1
        self.bits = int(np.clip(np.ceil(np.log2(8 * len(first) + 1)), *BITS))
        self.shift = np.full(1 << self.bits, most, np.uint8)
        for q in range(self.block - 1, m):  # a block's least distance to a pattern's end is written last
            for k in range(0, len(first), 1 << 20):
                self.shift[self._slot(_block(bench.hash, first[k : k + (1 << 20)] + q, self.block))] = m - 1 - q
        # buckets by the last block, within them windows by their hash
        key = (_block(bench.hash, first + m - 1, self.block) & ~np.uint64(0xFFFFFFFF)) | (_window(bench.hash, first, m) >> np.uint64(32))
        order = np.argsort(key, kind="stable")
        key, first, item = key[order], first[order], item[order]
        # equal windows are one pattern with several items
        new = np.append(True, key[1:] != key[:-1])
        twin = np.flatnonzero(~new)
        new[twin] = ~_equal(bench, first[twin - 1], bench, first[twin], m)
        self.key, self.first, self.item, self.items = key[new], first[new], item, np.append(np.flatnonzero(new), len(item))

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, number of the pattern) of every pattern's every occurrence."""
        counts = np.diff(w.bounds) - self.m + 1
        lanes = np.maximum(0, -(-counts // LANE))
        at = np.repeat(w.bounds[:-1] + self.m - 1, lanes) + _spread(np.zeros(len(lanes), np.int64), lanes) * LANE
        stop = np.minimum(at + LANE, np.repeat(w.bounds[1:], lanes))
        words, places = [], []
        while len(at):
            b = _block(w.hash, at, self.block)
            step = self.shift[self._slot(b)]
            hit = step == 0
            if hit.any():
                i = at[hit] - self.m + 1
                key = (b[hit] & ~np.uint64(0xFFFFFFFF)) | (_window(w.hash, i, self.m) >> np.uint64(32))
                lo = np.searchsorted(self.key, key, "left")
                n = np.searchsorted(self.key, key, "right") - lo
                if n.any():
                    i, p = np.repeat(i, n), _spread(lo, n)
                    same = _equal(w, i, self.bench, self.first[p], self.m)
                    words.append(i[same])
                    places.append(p[same])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(words + none), np.concatenate(places + none)


class Searcher:
    """Tables for a set of items."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int = WINDOW):
        self.ids, self.bench = ids, Words(texts)
        n = np.diff(self.bench.bounds)
        m = np.minimum(window, n)
        self.groups = []
        for size in np.unique(m[m > 0]).tolist():
            own = np.flatnonzero(m == size)
            windows = n[own] - size + 1
            self.groups.append(Group(size, self.bench, _spread(self.bench.bounds[own], windows), np.repeat(own, windows)))

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is hit; the texts and the ids of the items found in them, by text, ascending, each once."""
        edges, pairs = np.zeros(len(w.start) + 1, np.int64), [np.zeros(0, np.int64)]
        for g in self.groups:
            i, p = g.occurrences(w)
            np.add.at(edges, i, 1)
            np.add.at(edges, i + g.m, -1)
            found = np.unique(w.text[i] * np.int64(len(g.first)) + p)
            p = found % max(1, len(g.first))
            n = g.items[p + 1] - g.items[p]
            pairs.append(np.unique(np.repeat(found // max(1, len(g.first)), n) * np.int64(len(self.ids)) + g.item[_spread(g.items[p], n)]))
        pair = np.unique(np.concatenate(pairs))
        text, item = pair // max(1, len(self.ids)), self.ids[pair % max(1, len(self.ids))] if len(pair) else pair
        order = np.lexsort((item, text))
        text, item = text[order], item[order]
        once = np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])) if len(text) else np.zeros(0, bool)
        return np.cumsum(edges[:-1]) > 0, text[once], item[once]


_SEARCHERS: dict[str, Searcher] = {}


def searcher(held, name: str) -> Searcher:
    """The worker's tables for a broadcast part of the benchmark; the last part's are kept."""
    if name not in _SEARCHERS:
        _SEARCHERS.clear()
        rows = pa.ipc.open_stream(held.value).read_all()
        _SEARCHERS[name] = Searcher(rows["i"].to_numpy(), rows["t"].combine_chunks().cast(pa.large_string()))
    return _SEARCHERS[name]


def contamination(docs: DataFrame, bench: DataFrame, bench_bytes: int = BENCH_BYTES) -> DataFrame:
    """docs with a struct column `contamination`: n_words, n_hit, item_ids (array, ascending), contaminated.

    docs needs `text`, bench item_id and text. Contaminated: a word is hit, and at least every twentieth. Null and
    wordless texts have no words and aren't contaminated; items without words or id are left out; items that agree in
    their id are one; an empty benchmark hits nothing. Rows pass through one by one, with no shuffle; a benchmark beyond
    bench_bytes is hashed into parts, each searched in a pass of its own. The column gets underscores in front where
    docs has it already.
    """
    spark, name = docs.sparkSession, fresh(docs, "contamination")
    bench = bench.select(F.col("item_id").cast("bigint").alias("i"), F.col("text").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-total // bench_bytes))
    out = docs.withColumn(name, F.expr("named_struct('n_words', CAST(NULL AS BIGINT), 'hits', CAST(NULL AS BINARY), 'item_ids', CAST(NULL AS ARRAY<BIGINT>))"))

    for part in range(parts):
        own = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).distinct().toArrow().sort_by([("i", "ascending"), ("t", "ascending")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as stream:
            stream.write_table(own)
        held = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
        out = out.mapInArrow(_pass(held, uuid.uuid4().hex, out.columns.index(name), docs.columns.index("text")), out.schema)
    n, h = F.col(name)["n_words"], F.col(name)["hits"]
    hit = F.length(F.replace(F.decode(h, "ISO-8859-1"), F.lit("0"), F.lit(""))).cast("bigint")
    verdict = F.struct(n.alias("n_words"), hit.alias("n_hit"), F.col(name)["item_ids"].alias("item_ids"), ((hit > 0) & (20 * hit >= n)).alias("contaminated"))
    return out.withColumn(name, verdict)


def _pass(held, part: str, at: int, text: int):
    """A pass that adds one part's hits, a string of 0 and 1 for each word, and items to the struct column at `at`."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searcher(held, part)
        for batch in batches:
            texts, struct = batch.column(text), batch.column(at)
            old_hits, old_items = struct.field("hits"), struct.field("item_ids")
            n_words, hits, items = [], [], []
            for a, b in slices(texts, AT_ONCE):
                w = Words(texts.slice(a, b - a).cast(pa.string()))
                hit, of, ids = tables.search(w)
                marks = (hit + np.uint8(48)).astype(np.uint8)
                cuts = np.searchsorted(of, np.arange(b - a + 1))
                for i in range(b - a):
                    own, more = marks[w.bounds[i] : w.bounds[i + 1]], ids[cuts[i] : cuts[i + 1]].tolist()
                    if old := old_hits[a + i].as_py():
                        own, more = own | np.frombuffer(old, np.uint8), sorted({*more, *old_items[a + i].as_py()})
                    n_words.append(len(own))
                    hits.append(own.tobytes() if more else b"")
                    items.append(more)
            new = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.int64()))], ["n_words", "hits", "item_ids"])
            cols = list(batch.columns)
            cols[at] = new
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return run


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with the columns of docs, whatever their names.

    Null, empty and wordless texts stay; equal rows stay as many as they are; an empty benchmark drops nothing.
    """
    out = contamination(docs, bench)
    return out.where(~F.col(out.columns[-1])["contaminated"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    ids = F.array_join(F.array_sort(F.transform(c["item_ids"], lambda i: i.cast("string"))), ",")
    return out.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["item_ids"]).cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), c["contaminated"].alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(13, len(w)) AS m FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT m FROM p),
q AS (SELECT id, m, i, array_to_string(w[i:i + m - 1], ' ') AS x FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT id, i, q.m, item_id FROM q JOIN p ON q.m = p.m AND q.x = p.x),
n AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY id),
t AS (SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT id, item_id::VARCHAR AS item_id FROM hits) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN n USING (id) LEFT JOIN t USING (id)
"""
