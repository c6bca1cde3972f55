"""Toxicity by a classifier chain (operator 8).

Categories are predicted one after the other by linear models over the presence of words; a later model also gets the
earlier categories' log odds. In training these come from folds that the row was left out of, so that the later models
learn from probabilities as good as those they will meet.

The models are fitted to a bounded sample of labelled rows; every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import slices
from .common import table
from .decontam import Words

#: Labelled rows that the models are fitted to, about (chosen by a hash of doc_id).
SAMPLE = 8000
#: Hash buckets of words (bits), and how many each model uses, those that tell its category best.
BITS, FEATURES = 18, 512
FOLDS, ROUNDS, RIDGE = 5, 15, 1.0
AT_ONCE = 2 << 20


def present(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words of each text, each pair once; words are those of Words, lower-cased in ASCII."""
    w = Words(texts.cast(pa.string()))
    x = (w.hash ^ (w.hash >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    pair = np.unique(w.text * (1 << BITS) + (x >> np.uint64(64 - BITS)).astype(np.int64))
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """Ridge logistic regression over chosen words and the earlier categories' log odds, fitted by Newton's method."""

    def __init__(self, rows: np.ndarray, buckets: np.ndarray, early: np.ndarray, y: np.ndarray):
        pos, n = max(1, int(y.sum())), max(1, len(y))
        with_word = np.bincount(buckets, minlength=1 << BITS)
        both = np.bincount(buckets, weights=y[rows], minlength=1 << BITS)
        expected = with_word * pos / n
        gain = np.abs(both - expected) / np.sqrt(expected + 1)
        self.words = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
        x = self.matrix(rows, buckets, early, n)
        w = np.zeros(x.shape[1])
        w[-1] = np.log((pos + 0.5) / (n - min(pos, n) + 0.5))
        ridge = np.full(len(w), RIDGE)
        ridge[-1] = 1e-6
        for _ in range(ROUNDS):
            p = _sigmoid(x @ w)
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def matrix(self, rows: np.ndarray, buckets: np.ndarray, early: np.ndarray, n: int) -> np.ndarray:
        at = np.searchsorted(self.words, buckets)
        known = (at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == buckets)
        x = np.zeros((n, len(self.words) + early.shape[1] + 1))
        x[rows[known], at[known]] = 1
        x[:, len(self.words) : -1] = early
        x[:, -1] = 1
        return x

    def odds(self, rows: np.ndarray, buckets: np.ndarray, early: np.ndarray, n: int) -> np.ndarray:
        return self.matrix(rows, buckets, early, n) @ self.w


def fit(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, prints: np.ndarray) -> list[Linear]:
    """The chain for labels, one column for each category. prints: a hash of each text; copies go to one fold."""
    n, early, chain = len(labels), np.zeros((len(labels), 0)), []
    fold = prints.astype(np.uint64) % np.uint64(FOLDS)
    for k in range(labels.shape[1]):
        y, out = labels[:, k].astype(float), np.zeros(n)
        for f in range(FOLDS):
            train, number = fold != f, np.cumsum(fold != f) - 1
            if train.all() or not train.any():
                continue
            own = train[rows]
            model = Linear(number[rows[own]], buckets[own], early[train], y[train])
            out[~train] = model.odds(rows, buckets, early, n)[~train]
        chain.append(Linear(rows, buckets, early, y))
        early = np.column_stack([early, np.clip(out, -8, 8)])
    return chain


def score(chain: list[Linear], texts: pa.Array) -> np.ndarray:
    rows, buckets = present(texts)
    early = np.zeros((len(texts), 0))
    for m in chain:
        early = np.column_stack([early, np.clip(m.odds(rows, buckets, early, len(texts)), -8, 8)])
    return _sigmoid(early)


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> DataFrame:
    """doc_id and p_<category> for each row of docs, the categories in their order in the chain.

    categories: name to an SQL expression over the columns of labels (doc_id, ...) that gives 0 or 1; labels that are
    null in any category are left out; of several labels of a doc_id, the smallest in the order of the categories holds.
    Null texts have no words and get the base rates; without any labels all probabilities are 0.5. Equal rows get equal
    probabilities, and other columns are ignored. Rows pass one by one, without a shuffle.
    """
    spark, names = docs.sparkSession, list(categories)
    known = labels.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", *[f"CAST({e} AS DOUBLE) AS `c{i}`" for i, e in enumerate(categories.values())]).dropna()
    n = known.count()
    share = min(1.0, sample / max(n, 1))
    known = known.where(F.pmod(F.xxhash64(F.lit("labels"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    cats = [f"c{i}" for i in range(len(names))]
    known = known.groupBy("doc_id").agg(F.min(F.struct(*cats)).alias("c")).select("doc_id", "c.*").orderBy("doc_id").limit(2 * sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), AT_ONCE):
                rows, buckets = present(batch.column(1).slice(a, b - a))
                ends = np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets, pa.int32()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists, *[c.slice(a, b - a) for c in batch.columns[2:]]], names=["doc_id", "words", "print", *cats])

    # at most 2 * sample small rows are broadcast
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    chosen = chosen.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("print"), *cats).orderBy("doc_id", "print").limit(2 * sample)
    got = chosen.mapInArrow(features, "doc_id bigint, words array<int>, print bigint, " + ", ".join(f"{c} double" for c in cats)).toArrow().sort_by([("doc_id", "ascending"), ("print", "ascending")])
    words = got["words"].combine_chunks()
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False) if len(got) else np.zeros(0, np.int64)
    y = np.column_stack([got[f"c{i}"].to_numpy() for i in range(len(names))])
    chain = fit(np.repeat(np.arange(len(got)), sizes), words.flatten().to_numpy().astype(np.int64), y, got["print"].to_numpy()) if len(got) >= FOLDS else None
    held = spark.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), AT_ONCE):
                p = score(held.value, batch.column(1).slice(a, b - a)) if held.value else np.full((b - a, len(names)), 0.5)
                yield pa.record_batch([batch.column(0).slice(a, b - a), *[pa.array(p[:, i]) for i in range(len(names))]], names=["doc_id", *[f"p_{x}" for x in names]])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, " + ", ".join(f"p_{x} double" for x in names))


#: The labels have two categories: low quality goes first, as it often comes with the other.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), CATEGORIES)
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)
