"""Language identification (operator 3): nearest centroid over TF-IDF vectors of character n-grams.

Each language has several centroids, found by spherical k-means, so that its kinds of text needn't share one mean. A
text belongs to the language of the centroid with the greatest cosine. It is rejected when that cosine is below what
nearly all training texts of the centroid reach.

Document frequencies are counted over all training texts; the centroids are fitted to a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import slices
from .common import table

#: Hash buckets of n-grams, the n-grams' greatest length, centroids of a language.
BUCKETS, ORDER, CENTROIDS = 4096, 3, 4
#: Labelled texts of each language that the centroids are fitted to, about (chosen by a hash of doc_id).
SAMPLE = 800
#: Share of a centroid's own training texts that rejection would hit.
REJECT = 0.005
#: With fewer training texts than this, a centroid or a language has no limit of its own.
FEW = 20
#: Bytes of text and rows worked on at once; a row takes 12 bytes for each bucket.
AT_ONCE, ROWS = 1 << 20, 512
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of n-gram counts, whether each text has a letter). Letters are lower-cased, all else is a blank."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, 32).astype(np.uint64)
    lengths = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    doc = np.repeat(np.arange(len(lower)), lengths)
    keep = is_letter | np.append(True, is_letter[:-1])  # one blank after a word
    codes, doc, is_letter = codes[keep], doc[keep], is_letter[keep]
    out = np.zeros((len(texts), BUCKETS), np.float32)
    h = np.zeros(len(codes), np.uint64)
    for n in range(ORDER):
        h = h[: len(codes) - n] * _K[0] + codes[n:] * _K[1] + _K[2] if n else codes * _K[1] + _K[2]
        mixed = h ^ (h >> np.uint64(31))
        bucket = ((mixed * _K[0]) >> np.uint64(52)).astype(np.int64)
        d = doc[: len(codes) - n]
        same = d == doc[n:]
        out += np.bincount(d[same] * BUCKETS + bucket[same], minlength=out.size).reshape(out.shape)
    return out, np.bincount(doc, weights=is_letter, minlength=len(texts)) > 0


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def held_out(doc_id: Column, of: int = 4, is_: int = 2) -> Column:
    """Whether crc32 of the id as text, modulo `of`, is `is_`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == is_


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means; the first is nearest to the mean, each next the text farthest from them."""
    start = [int(np.argmax(x @ x.mean(0)))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(1))))
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


class Model:
    """Centroids with the language and rejection limit of each, and the n-grams' weights."""

    def __init__(self, idf: np.ndarray, samples: dict[str, np.ndarray]):
        self.idf, centroids, limits, names, every = idf, [], [], [], []
        for lang in sorted(samples):
            x = vectors(samples[lang], idf)
            c = cluster(x)
            best = x @ c.T
            own, top = best.argmax(1), best.max(1)
            every.append(top)
            # a centroid of few texts has the limit of its language, and a language of few texts that of all
            whole = float(np.quantile(top, REJECT)) if len(top) >= FEW else np.nan
            limits += [float(np.quantile(top[own == i], REJECT)) if (own == i).sum() >= FEW else whole for i in range(len(c))]
            centroids.append(c)
            names += [lang] * len(c)
        limits = np.nan_to_num(limits, nan=float(np.quantile(np.concatenate(every), REJECT)) if every else 0.0)
        self.centroids = np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, BUCKETS), np.float32)
        self.limits, self.names = limits, names

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        c, lettered = counts(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = vectors(c, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
        return [self.names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0), ~lettered | (score < self.limits[best])


def fit(train: DataFrame) -> Model:
    """The model from training rows (doc_id, text, lang); rows without text or lang are left out."""
    train = train.where("text IS NOT NULL AND lang IS NOT NULL")
    langs = {r["lang"]: r["count"] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}

    def df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for a, b in slices(batch.column(0), AT_ONCE, ROWS):
                c, _ = counts(batch.column(0).slice(a, b - a).to_pylist())
                total += (c > 0).sum(0)
                n += b - a
        if n:
            yield pa.record_batch({"bucket": pa.array(np.arange(-1, BUCKETS), pa.int32()), "n": pa.array(np.append(n, total), pa.int64())})

    rows = dict(train.select("text").mapInArrow(df, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect())
    idf = np.log((1 + rows.get(-1, 0)) / (1 + np.array([rows.get(i, 0) for i in range(BUCKETS)]))).astype(np.float32) + 1
    if not langs:
        return Model(idf, {})

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), AT_ONCE, ROWS):
                c, _ = counts(batch.column(0).slice(a, b - a).to_pylist())
                at = [np.flatnonzero(r) for r in c]
                yield pa.record_batch({"lang": batch.column(1).slice(a, b - a), "at": pa.array([x.astype(np.int16) for x in at], pa.list_(pa.int16())), "n": pa.array([r[x].astype(np.float32) for r, x in zip(c, at, strict=True)], pa.list_(pa.float32()))})

    share = F.create_map(*[x for k, v in langs.items() for x in (F.lit(k), F.lit(min(1.0, SAMPLE / v)))])[F.col("lang")]
    chosen = train.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000)
    got = chosen.select("text", "lang").limit(2 * SAMPLE * len(langs)).mapInArrow(sparse, "lang string, at array<smallint>, n array<float>").toArrow()
    samples: dict[str, list[np.ndarray]] = {}
    for lang, at, n in zip(got["lang"].to_pylist(), got["at"], got["n"], strict=True):
        row = np.zeros(BUCKETS, np.float32)
        row[at.values.to_numpy()] = n.values.to_numpy()
        samples.setdefault(lang, []).append(row)
    return Model(idf, {k: np.stack(sorted(v, key=lambda r: r.tobytes())) for k, v in samples.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row; the text alone decides.

    Null texts and texts without a letter are `und`, with score 0 and rejected; so is every text when nothing was
    learned. Rows pass one by one, without a shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, far = [], [], []
            for a, b in slices(batch.column(1), AT_ONCE, ROWS):
                x, y, z = held.value.predict([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                langs, scores, far = langs + x, scores + y.tolist(), far + z.tolist()
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))
