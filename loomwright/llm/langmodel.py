"""Language-model scoring (operator 7) by a hashed maximum-entropy model with a class-factored softmax.

The most frequent words, in classes of equal number by frequency, have a softmax over classes and one within the class;
both are linear in hashed features of the word before (n-gram), of the two words before together (n-gram) and of the
word before last (skip). All other words fall into classes by their first byte, within which a word's probability
follows from its count in all training texts, so that unseen words have one too.

Training runs in rounds over disjoint parts of all training texts. In a round each trainer updates the weights on its
share by stochastic gradients (AdaGrad by rows), and the trainers' weights are averaged. Trainers are as many as the
tokens ask for, at most one for each of the input's partitions, and not as many as there are cores, so that the longest
task doesn't grow with the input and a lost executor repeats no more than its partitions. Counts of all words stay in a
table; a bounded number of frequent words goes to the executors, the rest is looked up by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import slices
from .common import materialize, table

#: Words with a softmax of their own: CLASSES classes of WIDTH words. Other words: OTHER classes.
CLASSES, WIDTH, OTHER = 32, 64, 32
MODEL = CLASSES * WIDTH
#: Ids of contexts: the words above, the other classes, the start of a text.
START, CONTEXTS = MODEL + OTHER, MODEL + OTHER + 1
#: Hash rows of the pair of words before, and of a feature with a class.
PAIRS, WITHIN = 1 << 13, 1 << 14
ROUNDS, RATE, BATCH = 4, 0.2, 4096
#: Tokens that a trainer learns from in a round, about: more trainers than partitions aren't made.
SHARE = 1 << 21
#: Frequent words whose counts every executor gets, at most (about 20 bytes each).
HOT = 1 << 19
AT_ONCE = 6 << 20
#: Weights that are averaged together.
CHUNK = 1 << 16


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, the number of words of each): runs without blanks, A to Z lower-cased; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(lists)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(n)), n)
    return (flat if keep.all() else flat.filter(full)), np.bincount(doc[keep], minlength=len(n))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(0), 4 * AT_ONCE):
            words, _ = split(batch.column(0).slice(a, b - a))
            c = pc.value_counts(words)
            yield pa.record_batch({"word": c.field("values"), "c": c.field("counts")})


class Vocabulary:
    """Frequent words in order, the greatest count first, with the counts; the first are the model's."""

    def __init__(self, words: list[str], counts: list[int], texts: int, tokens: int, distinct: int, other: list[tuple[int, int]]):
        self.words, self.counts = pa.array(words, pa.string()), np.array(counts, np.int64)
        self.texts, self.tokens, self.distinct = texts, tokens, distinct
        self.total = tokens + 0.5 * (distinct + 1)
        # per other class: log10 of the sum of its words' counts, each half a token more, and the same for an unseen one
        self.other = np.log10(np.array([n + 0.5 * (v + 1) for n, v in other]))
        prior = np.zeros(CLASSES + OTHER)
        first = np.concatenate([[texts], self.counts[: MODEL - 1]]).astype(np.float64)
        first = np.pad(first, (0, MODEL - len(first)))
        within = first.reshape(CLASSES, WIDTH) + 0.5
        prior[:CLASSES], prior[CLASSES:] = within.sum(1), [n + 0.5 * (v + 1) for n, v in other]
        self.class_bias, self.word_bias = np.log(prior / prior.sum()).astype(np.float32), np.log(within / within.sum(1, keepdims=True)).astype(np.float32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(ids, counts, text of each token, words that aren't frequent): each text ends with the end token, id 0.

        ids: a model word's number, or MODEL + its class. counts: -1 for words that aren't frequent.
        """
        words, n = split(texts)
        at = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy()
        lead = np.zeros(len(words), np.int64)
        if len(words):
            offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)]
            lead = np.frombuffer(words.buffers()[2], np.uint8)[offsets].astype(np.int64) & (OTHER - 1)
        model = (at >= 0) & (at < MODEL - 1)
        ids = np.where(model, at + 1, MODEL + lead)
        counts = np.where(at >= 0, self.counts[at], -1) if len(self.counts) else np.full(len(words), -1)
        ends = np.cumsum(n)
        cold = words.filter(pa.array(at < 0))
        return np.insert(ids, ends, 0), np.insert(counts, ends, self.texts), np.repeat(np.arange(len(n)), n + 1), cold


def contexts(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one and two before each token in its text."""
    one, two = np.full(len(ids), START), np.full(len(ids), START)
    if len(ids) > 1:
        one[1:] = np.where(doc[1:] == doc[:-1], ids[:-1], START)
    if len(ids) > 2:
        two[2:] = np.where(doc[2:] == doc[:-2], ids[:-2], START)
    return one, two


class Weights:
    """Linear weights of both levels and AdaGrad's sums by row, in one flat array: later rounds go on with the sums."""

    def __init__(self, flat: np.ndarray | None = None):
        rows = 2 * CONTEXTS + PAIRS
        ends = np.cumsum([rows * (CLASSES + OTHER), WITHIN * WIDTH, rows, WITHIN])
        self.flat = np.zeros(ends[-1], np.float32) if flat is None else flat
        upper, lower, *self.sums = np.split(self.flat, ends[:-1])
        self.upper, self.lower = upper.reshape(rows, CLASSES + OTHER), lower.reshape(WITHIN, WIDTH)

    @staticmethod
    def features(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        pair = ((one * 0x9E3779B1 + two * 0x85EBCA77) >> 7) & (PAIRS - 1)
        return [one, CONTEXTS + two, 2 * CONTEXTS + pair]

    @staticmethod
    def within(one: np.ndarray, two: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
        return [((one * 0x9E3779B1 + cls * 0x85EBCA77 + 1) >> 9) & (WITHIN - 1), ((two * 0xC2B2AE35 + cls * 0x27D4EB2F + 5) >> 9) & (WITHIN - 1)]


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _level(w: np.ndarray, feats: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    z = w.take(feats[0], 0)
    for f in feats[1:]:
        z += w.take(f, 0)
    z += bias
    return _softmax(z)


def _update(w: np.ndarray, acc: np.ndarray, feats: list[np.ndarray], g: np.ndarray) -> None:
    for f in feats:
        order = np.argsort(f.astype(np.uint16), kind="stable")
        s = f[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        # pairs of floats added as complex numbers take half the steps
        rows, sums = s[first], np.add.reduceat(g.view(np.complex64).take(order, 0), first).view(np.float32)
        acc[rows] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        w[rows] -= sums * (RATE / np.sqrt(acc[rows] + 1e-3))[:, None]


def _class(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < MODEL, ids // WIDTH, ids - MODEL + CLASSES)


def train_on(w: Weights, v: Vocabulary, ids: np.ndarray, doc: np.ndarray) -> None:
    one, two = contexts(ids, doc)
    cls = _class(ids)
    for a in range(0, len(ids), BATCH):
        s = slice(a, a + BATCH)
        feats = Weights.features(one[s], two[s])
        p = _level(w.upper, feats, v.class_bias)
        p[np.arange(len(p)), cls[s]] -= 1
        _update(w.upper, w.sums[0], feats, p)
        k = np.flatnonzero(ids[s] < MODEL) + a
        if len(k):
            feats = Weights.within(one[k], two[k], cls[k])
            p = _level(w.lower, feats, v.word_bias[cls[k]])
            p[np.arange(len(k)), ids[k] % WIDTH] -= 1
            _update(w.lower, w.sums[1], feats, p)


def log10_probability(w: Weights, v: Vocabulary, ids: np.ndarray, counts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """log10 of each token's probability; for words that aren't frequent (count -1), without log10(count + 0.5)."""
    one, two = contexts(ids, doc)
    cls, out = _class(ids), np.zeros(len(ids))
    for a in range(0, len(ids), BATCH):
        s = slice(a, a + BATCH)
        p = _level(w.upper, Weights.features(one[s], two[s]), v.class_bias)
        out[s] = np.log10(np.maximum(p[np.arange(len(p)), cls[s]], 1e-30))
        k = np.flatnonzero(ids[s] < MODEL) + a
        if len(k):
            p = _level(w.lower, Weights.within(one[k], two[k], cls[k]), v.word_bias[cls[k]])
            out[k] += np.log10(np.maximum(p[np.arange(len(k)), ids[k] % WIDTH], 1e-30))
    rest = ids >= MODEL
    out[rest] += np.where(counts[rest] >= 0, np.log10(np.maximum(counts[rest], 0) + 0.5), 0) - v.other[ids[rest] - MODEL]
    return out


def _vocabulary(counts: DataFrame, texts: int) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count that makes a word frequent."""
    level = F.floor(F.log2("c") * 16).cast("int")
    steps = counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("l")).collect()
    least, n = 1 << 62, 0
    for r in steps:
        if (n := n + r["n"]) > HOT:
            break
        least = r["c"]
    hot = counts.where(F.col("c") >= least).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, c = hot["word"].to_pylist(), hot["c"].to_pylist()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    lead = F.conv(F.hex(F.substring(F.encode("word", "UTF-8"), 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(OTHER - 1))
    by = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy(lead.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    for word, k in zip(words[: MODEL - 1], c[: MODEL - 1], strict=True):
        i = word.encode()[0] & (OTHER - 1)
        by[i] = (by[i][0] - k, by[i][1] - 1)
    return Vocabulary(words, c, texts, sums[0] + texts, sums[1] + (texts > 0), [by.get(i, (0, 0)) for i in range(OTHER)]), least


def train(docs: DataFrame, vocabulary, rounds: int = ROUNDS) -> Weights:
    """Weights from all texts of docs (text), in `rounds` rounds over disjoint parts of them."""
    spark, now = docs.sparkSession, Weights()
    n = max(2, math.ceil(vocabulary.value.tokens / rounds / SHARE))
    for r in range(rounds):
        held = spark.sparkContext.broadcast(now.flat)

        def learn(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            w, v, tokens = Weights(held.value.copy()), vocabulary.value, 0
            for batch in batches:
                for a, b in slices(batch.column(0), AT_ONCE):
                    ids, _, doc, _ = v.encode(batch.column(0).slice(a, b - a))
                    train_on(w, v, ids, doc)
                    tokens += len(ids)
            if tokens:
                for i in range(0, len(w.flat), CHUNK):
                    yield pa.record_batch({"chunk": pa.array([i // CHUNK], pa.int32()), "n": pa.array([float(tokens)]), "data": pa.array([w.flat[i : i + CHUNK].tobytes()], pa.binary())})

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            weight: dict[int, float] = {}
            for batch in batches:
                for k, m, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    sums[k] = sums.get(k, 0) + m * np.frombuffer(d, np.float32).astype(np.float64)
                    weight[k] = weight.get(k, 0) + m
            for k, x in sums.items():
                yield pa.record_batch({"chunk": pa.array([k], pa.int32()), "data": pa.array([(x / weight[k]).astype(np.float32).tobytes()], pa.binary())})

        part = docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).select("text").coalesce(n)
        rows = part.mapInArrow(learn, "chunk int, n double, data binary").repartition("chunk").mapInArrow(average, "chunk int, data binary").collect()
        if rows:
            now = Weights(np.concatenate([np.frombuffer(x["data"], np.float32) for x in sorted(rows)]))
    return now


def score(docs: DataFrame, learns: str) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    learns: an SQL condition on docs' columns; the model and the counts learn from the rows where it holds, held_out is
    its negation. Null texts are empty: one token, the end. Without training texts base_score is 0 and the probabilities
    are even. Whole texts count; rows stay as many as they are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.expr(f"NOT ({learns})").alias("held_out"))
    seen = rows.where("NOT held_out")
    counts = materialize(seen.select("text").mapInArrow(_count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    vocabulary, least = _vocabulary(counts, seen.count())
    v = spark.sparkContext.broadcast(vocabulary)
    w = spark.sparkContext.broadcast(train(seen.select("text"), v).flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, weights, n = v.value, Weights(w.value), TaskContext.get().partitionId() << 33
        names = ["id", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "tf"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64()]
        for batch in batches:
            for a, b in slices(batch.column("text"), AT_ONCE):
                m = b - a
                ids, c, doc, cold = voc.encode(batch.column("text").slice(a, m))
                p = log10_probability(weights, voc, ids, c, doc)
                base = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.5), 0) - np.log10(voc.total)
                sums = lambda x: np.bincount(doc, weights=x, minlength=m)  # noqa: B023, E731
                own = np.arange(n, n + m)
                yield pa.record_batch([pa.array(own), batch.column("doc_id").slice(a, m), batch.column("held_out").slice(a, m), pa.array(np.bincount(doc, minlength=m)), pa.array(sums(c > 0).astype(np.int64)), pa.array(sums(base)), pa.array(sums(p)), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names=names)
                if len(cold):
                    d = cold.dictionary_encode()
                    pair, tf = np.unique(doc[c < 0] * len(d.dictionary) + d.indices.to_numpy(), return_counts=True)
                    k = len(pair)
                    yield pa.record_batch([pa.array(own[pair // len(d.dictionary)]), *[pa.nulls(k, t) for t in kinds[1:7]], d.dictionary.take(pa.array(pair % len(d.dictionary))), pa.array(tf.astype(np.int64))], names=names)
                n += m

    done = materialize(rows.mapInArrow(run, "id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, word string, tf bigint"), "scores")
    rare = counts.where(F.col("c") < least)
    late = done.where("word IS NOT NULL").select("id", "word", "tf").join(rare, "word", "left")
    late = late.groupBy("id").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("x"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"))
    out = done.where("word IS NULL").join(late, "id", "left")
    x = F.coalesce("x", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + x).alias("base_score"), (F.col("score") + x).alias("score"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, "crc32(coalesce(CAST(doc_id AS STRING), '')) % 5 <> 1")
