"""N-gram Jaccard self-join (operator 9) with PartEnum signatures.

Sets in size bands: with U the greatest size of a band, two sets with a Jaccard similarity of 0.8 or more, one of them in
the band and the other no smaller, differ in k = U / 4 shingles at most. The feature domain is partitioned by hash into
n1 = k / (k2 + 1) + 1 + E parts, of which E + 1 at least differ in k2 shingles or fewer, and each part into n2 smaller
ones. Every subset of n2 - k2 smaller parts of a part that a set meets gives one signature, so similar sets share one in
E + 1 parts at least. Subsets that are empty in both would be no evidence; a part counts for a set if more than k2 of its
smaller parts aren't empty, and a set with E or fewer parts that don't count has a signature in common with each partner.
A set with more of them also gives the signatures of the next scheme, which has a greater E. All these leave out frequent
shingles, which can't make sets differ more; the last scheme has all shingles, and empty subsets count in it. A set enters
its own band and, where a smaller partner could be in the band below, that band too.

Sets with a common signature are tied to one of them and verified on their texts. Where a signature's sets don't all end
up in one component, a set is only looked at further if it could be linked with another component. A set all of whose parts
count but for f <= E in the first scheme shares E + 1 - f signatures with each partner, so one that has fewer in common
with other components drops out, and the others leave their largest groups while what they leave is less than that: a
pair's smallest common group keeps both. Of the rest, at least 0.8 of a set's shingles stand in other components too. That
is counted over all such sets, again and again as sets drop out. What is
left is tied to two more sets of its signature, and in the end pairs across components are verified too, unless these
counts, a sketch of 512 parities of what a set shares with other components (each parity that differs takes a shingle
that only one of the sets has), or the triangle inequality of the Jaccard distance rule them out. So no link between components is lost, and
hardly a pair is joined that isn't a link.

Shingles and signatures are 64-bit hashes; equal texts are one set from the start, by a 64-bit hash of the text. Two of
10^9 different texts have the same hash with a probability of 3 %; they would then count as copies.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtext import slices, tidy
from .common import forget, fresh, materialize, release_shuffles, small_batches, table
from .components import components
from .decontam import Words

SHINGLE, SIMILAR = 5, 0.8
#: Documents (about) whose shingles tell which are frequent, how often those occur in them, and how many are kept.
SAMPLE, FREQUENT, MOST_FREQUENT = 2000, 4, 200_000
#: Smaller parts of a part (n2), and how many of them may differ (k2).
SUBPARTS, MISSES = 3, 1
#: Bytes of text worked on at once, signatures that a task holds before it passes them on.
AT_ONCE, HELD = 1 << 20, 200_000
#: Buckets of signatures at least, and bytes of text for each; bytes of text for each task that matches them; sets of a bucket.
BUCKETS, BUCKET_BYTES, TASK_BYTES, BUCKET_SETS = 1024, 16 << 20, 64 << 20, 1 << 16
#: Rows of an Arrow batch, each with two whole texts at most.
BATCH_ROWS = 1000
#: Keys (8 bytes each) that are broadcast at most; more of them are joined by shuffles.
BROADCAST_KEYS = 1 << 18
#: E as a share of all parts, in the schemes without frequent shingles.
SLACK = (1 / 6, 1 / 3, 1 / 2)
#: Documents known to be signed already that a task remembers.
REMEMBERED = 1_000_000

_SIGNS = np.ones(256, bool)
_SIGNS[[9, 10, 11, 12, 13, 32]] = False
_C = np.random.default_rng(9).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_S31, _S29 = np.uint64(31), np.uint64(29)
_ROW = np.dtype([("sig", "<u8"), ("key", "<i8")])
_SET = np.dtype([("key", "<i8"), ("n", "<i8"), ("least", "<i8"), ("sketch", "<i8", 8)])


def mixed(x: np.ndarray, c: int = 0) -> np.ndarray:
    x = (x ^ (x >> _S31)) * _C[c]
    return (x ^ (x >> _S29)) * _C[c + 1]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; a text of fewer words is one shingle, one without words has none."""
    w = Words(texts.cast(pa.string()), _SIGNS)
    h = mixed(w.hash, 2)
    out = []
    full = sum((h[j : len(h) - SHINGLE + 1 + j] * _C[4 + j] for j in range(1, SHINGLE)), h[: max(0, len(h) - SHINGLE + 1)] * _C[4]) if len(h) >= SHINGLE else h[:0]
    full = mixed(full, 10)
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            x = np.sort(full[a : b - SHINGLE + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            out.append(mixed(np.array([(h[a:b] * _C[4 : 4 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]), 12))
        else:
            out.append(h[:0])
    return out


def _bands(most: int) -> list[int]:
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return edges


_EDGES = np.array(_bands(1 << 40))


def signatures(x: np.ndarray, frequent: np.ndarray, subparts: int = SUBPARTS, misses: int = MISSES) -> np.ndarray:
    """The signatures of a set of shingle hashes; frequent: sorted hashes that only the last scheme has."""
    return signed(x, frequent, subparts, misses)[0]


def signed(x: np.ndarray, frequent: np.ndarray, subparts: int = SUBPARTS, misses: int = MISSES) -> tuple[np.ndarray, int]:
    """signatures(), and how many of them the set shares at least with each set that it is linked with."""
    out, least = [], []
    own = int(np.searchsorted(_EDGES, len(x)))
    # the band below, if its greatest size could be a partner's
    levels = [own] + ([own - 1] if own and _EDGES[own - 1] >= SIMILAR * len(x) else [])
    rare = x
    if len(frequent):
        at = np.searchsorted(frequent, x)
        rare = x[frequent[np.minimum(at, len(frequent) - 1)] != x]
    for level in levels:
        k = int(_EDGES[level]) // 4
        k2 = min(misses, k)
        n2 = subparts if k2 else 1
        subsets = _subsets(n2, k2)
        for scheme, share in enumerate((*SLACK, SLACK[0])):
            last = scheme == len(SLACK)
            need = k // (k2 + 1) + 1
            slack = int((need - 1) * share / (1 - share))
            n = need + slack
            y = mixed(x if last else rare, scheme)
            cell = ((y >> np.uint64(32)) * np.uint64(n * n2) >> np.uint64(32)).astype(np.int64)
            tag = np.uint64((level * 8 + scheme) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            sums = np.zeros(n * n2, np.uint64)
            np.add.at(sums, cell, y * _C[14] ^ (y >> _S29) * _C[15])
            full = (np.bincount(cell, minlength=n * n2) > 0).reshape(n, n2)
            sums = mixed(sums + np.arange(1, n * n2 + 1, dtype=np.uint64) * _C[13] + tag, 6).reshape(n, n2)
            few = int((full.sum(1) <= k2).sum())
            for number, subset in enumerate(subsets):
                sig = (sums @ subset.astype(np.uint64)) + np.uint64(number)
                any_full = full @ subset
                out.append(sig[any_full] if not last or few <= slack else sig)
            if few <= slack:
                break
        # past the first scheme, a partner may have ended in an earlier one with a single signature in common
        least.append(1 if scheme else max(1, slack + 1 - few))
    return (np.concatenate(out) if out else x[:0]), min(least, default=1)


@functools.cache
def _subsets(n2: int, k2: int) -> tuple[np.ndarray, ...]:
    """All subsets of n2 - k2 of n2 parts, as masks."""
    return tuple(np.isin(np.arange(n2), c) for c in itertools.combinations(range(n2), n2 - k2))


def sketch(x: np.ndarray) -> np.ndarray:
    """512 parities of a set's shingles by hash, as 8 numbers."""
    odd = np.bincount((mixed(x, 5) >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sign(frequent, buckets: int, set_buckets: int):
    """Rows (bucket, data): signatures with keys in buckets 0 and up, sets' sizes and sketches in buckets below 0."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs, keys, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            rows = np.empty(held, _ROW)
            rows["sig"], rows["key"] = np.concatenate([*sigs, np.zeros(0, np.uint64)]), np.concatenate([*keys, np.zeros(0, np.int64)])
            bucket = (rows["sig"] >> np.uint64(24)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if held else np.zeros(0, np.int64)
            names = bucket[cuts].tolist()
            data = [r.tobytes() for r in np.split(rows, cuts[1:])] if held else []
            own = np.array(sizes, _SET)
            place = own["key"] % set_buckets
            order = np.argsort(place, kind="stable")
            own, place = own[order], place[order]
            cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(own) else np.zeros(0, np.int64)
            names += (-1 - place[cuts]).tolist()
            data += [r.tobytes() for r in np.split(own, cuts[1:])] if len(own) else []
            return pa.record_batch({"bucket": pa.array(names, pa.int64()), "data": pa.array(data, pa.binary())})

        for batch in batches:
            texts, all_keys = batch.column("text"), batch.column("key").to_pylist()
            for a, b in slices(texts, AT_ONCE):
                fresh = [i for i in range(a, b) if all_keys[i] not in seen and not seen.add(all_keys[i])]
                if len(seen) > REMEMBERED:
                    seen.clear()
                if not fresh:
                    continue
                for i, x in zip(fresh, shingle_sets(texts.take(pa.array(fresh))), strict=True):
                    s, least = signed(x, frequent.value) if len(x) else (x, 1)
                    sizes.append((all_keys[i], len(x), least, sketch(x)))
                    if len(x):
                        sigs.append(s)
                        keys.append(np.full(len(s), all_keys[i], np.int64))
                        held += len(s)
                if held >= HELD:
                    yield flush()
                    sigs, keys, sizes, held = [], [], [], 0
        if sizes:
            yield flush()

    return run


@tidy
def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, least, s0 to s7) of sets, and (key, rep, bid, times): keys of sets with a common signature.

    The rows come sorted by bucket, and one bucket is worked on at a time. bid names a group of three keys or more (null
    for two); equal groups of a bucket are given once, times being the number of their signatures.
    """
    now, parts = None, []
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != now and parts:
                yield from _bucket(now, parts)
                parts = []
            now = bucket
            parts.append(np.frombuffer(data.as_buffer(), _ROW if bucket >= 0 else _SET))
    if parts:
        yield from _bucket(now, parts)


def _bucket(bucket: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    rows = np.concatenate(parts)
    parts.clear()
    if bucket < 0:
        rows = rows[np.unique(rows["key"], return_index=True)[1]]
        yield _rows(rows["key"], n=rows["n"], least=rows["least"], sketch=rows["sketch"])
        return
    order = np.argsort(rows["sig"], kind="stable")
    sig = rows["sig"][order]
    same = sig[1:] == sig[:-1]
    shared = np.append(False, same) | np.append(same, False)
    sig, key = sig[shared], rows["key"][order][shared]
    del rows, order, same
    if not len(sig):
        return
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    once = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))
    sig, key = sig[once], key[once]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    count = np.diff(np.append(first, len(sig)))
    bid = np.add.reduceat(mixed(key.astype(np.uint64), 3), first)
    _, pick, times = np.unique(bid, return_index=True, return_counts=True)
    pick, times = pick[count[pick] > 1], times[count[pick] > 1]
    n = count[pick]
    at = np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    step = 1 << 16
    for a in range(0, len(at), step):
        s = slice(a, a + step)
        yield _rows(key[at[s]], rep=np.repeat(key[first[pick]], n)[s], bid=np.repeat(bid[pick], n)[s].view(np.int64), two=np.repeat(n == 2, n)[s], times=np.repeat(times, n)[s])


_NAMES = ["key", "n", "least", "rep", "times", "bid", *[f"s{i}" for i in range(8)]]


def _rows(key, n=None, least=None, rep=None, bid=None, two=None, times=None, sketch=None) -> pa.RecordBatch:
    kind, size = pa.int64(), len(key)
    cols = [pa.array(np.ascontiguousarray(c), kind) if c is not None else pa.nulls(size, kind) for c in (key, n, least, rep, times)]
    cols.append(pa.array(bid, kind, mask=two) if bid is not None else pa.nulls(size, kind))
    cols += [pa.array(np.ascontiguousarray(sketch[:, i]), kind) if sketch is not None else pa.nulls(size, kind) for i in range(8)]
    return pa.record_batch(cols, names=_NAMES)


def _apart(a: str, b: str, s: str = "s") -> str:
    """SQL for a lower bound of the number of shingles that only one of two sets has, by their sketches."""
    return "(" + " + ".join(f"bit_count({a}{s}{i} ^ {b}{s}{i})" for i in range(8)) + ")"


def _apart_common(a: str, b: str) -> str:
    """The same from what _open() gives: shingles that no other component has are certain to differ."""
    return f"({a}n - {a}v + {b}n - {b}v + greatest({_apart(a, b, 'k')}, abs({a}v - {b}v)))"


@tidy
def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, None
    for batch in batches:
        key, rep, tx, tr = batch.columns
        sets = [s for a, b in slices(tx, AT_ONCE) for s in shingle_sets(tx.slice(a, b - a))]
        common, union = [], []
        for i, r in enumerate(rep.to_pylist()):
            if r != last:
                last, own = r, shingle_sets(tr.slice(i, 1))[0]
            x = sets[i]
            c = len(np.intersect1d(x, own, assume_unique=True))
            common.append(c)
            union.append(len(x) + len(own) - c)
        yield pa.record_batch([key, rep, pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["key", "rep", "common", "union"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (key, rep) with the sizes of their sets' intersection and union."""
    a = texts.select(F.col("key"), F.col("text").alias("tx"))
    b = texts.select(F.col("key").alias("rep"), F.col("text").alias("tr"))
    return pairs.join(a, "key").join(b, "rep").select("key", "rep", "tx", "tr").mapInArrow(_similarity, "key bigint, rep bigint, common bigint, `union` bigint")


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of shingles that many of a sample of n documents have; they bear on speed alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), AT_ONCE):
                for x in shingle_sets(batch.column(0).slice(a, b - a)):
                    yield pa.record_batch({"s": pa.array(x.view(np.int64))})

    some = docs.where(F.pmod(F.col("key"), F.lit(max(1, n // SAMPLE))) == 0).select("key", "text").limit(2 * SAMPLE).dropDuplicates(["key"]).select("text")
    rows = some.mapInArrow(run, "s bigint").groupBy("s").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).select("s").toArrow()
    return np.sort(rows["s"].to_numpy().astype(np.int64).view(np.uint64))


@tidy
def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, key) for each shingle of each text of (key, text)."""
    for batch in batches:
        for a, b in slices(batch.column(1), AT_ONCE):
            sets = shingle_sets(batch.column(1).slice(a, b - a))
            keys = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), [len(x) for x in sets])
            yield pa.record_batch({"s": pa.array(np.concatenate(sets).view(np.int64)), "key": pa.array(keys, pa.int64())})


def _open(some: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, c, n, least, v, k0 to k7) of those of some (key, c, n, least) that could be linked with one of another component c.

    v counts a set's shingles that stand in other components too; k0 to k7 are a sketch of these alone. A set with
    v < 0.8 n has no link to any other component and drops out, and its shingles with it, until few more do.
    """
    bits = [F.bit_xor(F.when(F.shiftright(F.col("s"), 6).bitwiseAND(F.lit(7)) == i, F.expr("shiftleft(1L, CAST(s & 63L AS INT))")).otherwise(F.lit(0).cast("bigint"))).alias(f"k{i}") for i in range(8)]
    now = materialize(some, "open")
    found = materialize(texts(now.select("key")).mapInArrow(_shingles, "s bigint, key bigint").join(now.select("key", "c"), "key"), "shingles")
    left = now.count()
    while True:
        common = materialize(found.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("s"), "common")
        kept = materialize(found.join(common, "s"), "shingles")
        counts = kept.groupBy("key").agg(F.count(F.lit(1)).alias("v"), *bits)
        new = materialize(now.select("key", "c", "n", "least").join(counts, "key").where("5 * v >= 4 * n"), "open")
        before, left = left, new.count()
        for old in (now, found, common):
            forget(old)
        now, found = new, kept
        if not left or left > 0.9 * before:
            forget(found)
            return now
        found = materialize(found.join(now.select("key"), "key", "left_semi"), "shingles")
        forget(kept)


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """(key, n_shingles, component_id, group) for each distinct text of docs (doc_id, text); key is xxhash64 of the text.

    Texts are linked when 100 * intersection >= 80 * union of their shingle sets. component_id is the smallest doc_id
    that links reach, the text's own included; a null doc_id is smaller than none: it is null only where all are. A null
    text has no shingles and is linked with nothing, so its rows have components of their own; so do wordless texts.
    group is the smallest key of the component: components that share their component_id differ in it.
    The session's Arrow batches are kept small while the join runs.
    """
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _groups(docs)


def _groups(docs: DataFrame) -> DataFrame:
    """jaccard_groups() itself."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("key", F.xxhash64("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    held = spark.sparkContext.broadcast(_frequent(rows, n))
    signed = rows.select("key", "text").mapInArrow(_sign(held, max(BUCKETS, size // BUCKET_BYTES), max(64, n // BUCKET_SETS)), "bucket bigint, data binary")
    tasks = size // TASK_BYTES
    dealt = signed.repartition(tasks, "bucket") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else signed.repartition("bucket")
    found = materialize(dealt.sortWithinPartitions("bucket").mapInArrow(_match, ", ".join(f"{x} bigint" for x in _NAMES)), "matches")
    release_shuffles(spark)
    marks = [f"s{i}" for i in range(8)]
    sets = materialize(found.where("n IS NOT NULL").select("key", "n", "least", *marks), "sets")
    sizes = sets.select("key", "n")
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("first"))
    members = materialize(found.where("rep IS NOT NULL AND (bid IS NOT NULL OR key <> rep)").groupBy("bid", "rep", "key").agg(F.sum("times").alias("times")), "members")
    forget(found)
    release_shuffles(spark)

    # what may be similar by sizes and sketches goes on; of the other pairs, the least distance is kept
    sketches = sets.drop("least")
    pairs = members.where("key <> rep").select("key", "rep").distinct().join(sketches, "key")
    pairs = pairs.join(sketches.select(*[F.col(c).alias("rep" if c == "key" else f"r{c}") for c in sketches.columns]), "rep")
    far = f"greatest({_apart('', 'r')}, abs(n - rn))"
    pairs = materialize(pairs.selectExpr("key", "rep", f"{far} AS apart", f"2.0D * {far} / (n + rn + {far}) AS lo", "n + rn AS both"), "pairs")

    def texts(keys: DataFrame) -> DataFrame:
        """(key, text), one row for each of the keys, which are distinct."""
        few = keys.count() <= BROADCAST_KEYS
        # the one document that stands for a text: joined by its id too, as a text may have very many copies
        wanted = firsts.join(F.broadcast(keys) if few else keys, "key").select("key", F.coalesce("first", F.lit(0)).alias("id"))
        own = rows.select("key", F.coalesce("doc_id", F.lit(0)).alias("id"), "text")
        return own.join(F.broadcast(wanted) if few else wanted, ["key", "id"]).select("key", "text").dropDuplicates(["key"])

    def check(pairs: DataFrame, tag: str) -> DataFrame:
        pairs = materialize(pairs, "pairs")
        keys = materialize(pairs.select("key").unionByName(pairs.select(F.col("rep").alias("key"))).distinct(), "keys")
        out = materialize(_verified(pairs, texts(keys)), tag)
        forget(pairs)
        forget(keys)
        return out

    star = check(pairs.where("9 * apart <= both").select("key", "rep"), "verified")
    linked = "100 * common >= 80 * `union`"
    links = star.where(linked).select(F.col("key").alias("u"), F.col("rep").alias("v"))
    groups = materialize(components(links), "components")
    release_shuffles(spark)

    # signatures of three sets or more that aren't in one component yet
    many = members.where("bid IS NOT NULL")
    split = F.min("c") != F.max("c")

    def in_split(own: DataFrame) -> DataFrame:
        return own.join(own.groupBy("bid").agg(split.alias("split"), F.count(F.lit(1)).alias("sets")).where("split").select("bid", "sets"), "bid")

    def enough(own: DataFrame, marked: DataFrame) -> DataFrame:
        """(key, c, n, least) of own (bid, key, times, c) that have so many signatures in common with other components; marked (key, n, least)."""
        own = in_split(own).groupBy("key", "c").agg(F.sum("times").alias("times"))
        return own.join(marked, "key").where("times >= least").select("key", "c", "n", "least")

    def narrowed(some: DataFrame) -> DataFrame:
        """(bid, rep, key, c) of the groups that some (key, c, n, least) are to be compared in; each may leave its largest ones."""
        own = materialize(many.join(some.select("key", "c", "least"), "key"), "held")
        largest = Window.partitionBy("key").orderBy(F.desc("sets"), "bid").rowsBetween(Window.unboundedPreceding, 0)
        cut = in_split(own).withColumn("left", F.sum("times").over(largest)).where("left >= least").select("bid", "rep", "key", "c")
        cut = materialize(cut, "narrowed")
        forget(own)
        out = materialize(in_split(cut).drop("sets"), "narrowed")
        forget(cut)
        return out

    def component(keys: DataFrame) -> DataFrame:
        return keys.join(groups, F.col("key") == F.col("node"), "left").withColumn("c", F.coalesce("component", "key")).drop("node", "component")

    def joined(more: DataFrame) -> DataFrame:
        """The components, once `more` links are added to them."""
        new = more.where(linked).select(F.col("key").alias("u"), F.col("rep").alias("v"))
        if not new.limit(1).count():
            return groups
        return materialize(components(groups.selectExpr("node AS u", "component AS v").unionByName(new)), "components")

    live = _open(enough(component(many), sets.select("key", "n", "least")), texts)
    done = star
    if live.limit(1).count():
        # ties to two other sets of each such signature join most of what is linked
        own = narrowed(live)
        others = [F.max("key"), F.min(F.struct(F.xxhash64("key"), "key"))["key"]]
        hubs = own.groupBy("bid").agg(F.array_distinct(F.array(*others)).alias("hubs")).select("bid", F.explode("hubs").alias("hub"))
        marked = live.drop("c", "least")
        hubs = hubs.join(live.select(*[F.col(x).alias("hub" if x == "key" else f"h{x}") for x in (*marked.columns, "c")]), "hub")
        tied = own.join(marked, "key").join(hubs, "bid").where(f"c <> hc AND 9 * {_apart_common('', 'h')} <= n + hn").select(F.greatest("key", "hub").alias("key"), F.least("key", "hub").alias("rep")).distinct()
        more = check(tied.join(star.select("key", "rep"), ["key", "rep"], "left_anti"), "verified")
        forget(own)
        done = star.unionByName(more)
        groups = joined(more)
        release_shuffles(spark)

        now = materialize(component(live.select("key", "n", "least")), "open")
        live = _open(enough(many.join(now.select("key", "c"), "key"), now.select("key", "n", "least")), texts)
        forget(now)
        known = pairs.join(star, ["key", "rep"], "left").selectExpr("key", "rep", "coalesce(1.0D - common / union, lo) AS lo", "coalesce(1.0D - common / union, 1.0D) AS hi")
        own = narrowed(live)
        rest = own.join(live.drop("c"), "key").join(known, ["key", "rep"], "left")
        rest = rest.select("bid", *live.columns, F.when(F.col("key") == F.col("rep"), 0.0).otherwise(F.coalesce("lo", F.lit(0.0))).alias("lo"), F.when(F.col("key") == F.col("rep"), 0.0).otherwise(F.coalesce("hi", F.lit(1.0))).alias("hi"))
        rest = materialize(rest, "split")
        x, y = rest.alias("x"), rest.alias("y")
        near = f"9 * {_apart_common('x.', 'y.')} <= x.n + y.n AND x.lo - y.hi <= 0.2 AND y.lo - x.hi <= 0.2"
        across = x.join(y, (F.col("x.bid") == F.col("y.bid")) & (F.col("x.c") < F.col("y.c")) & F.expr(near))
        across = across.select(F.greatest("x.key", "y.key").alias("key"), F.least("x.key", "y.key").alias("rep")).distinct()
        across = materialize(across, "across").join(done.select("key", "rep"), ["key", "rep"], "left_anti")
        groups = joined(check(across, "verified"))
        for old in (rest, more, own):
            forget(old)
    for old in (members, pairs, star, live):
        forget(old)
    release_shuffles(spark)
    named = firsts.join(groups, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("component", "key").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    return named.join(least, "c").join(sizes, "key").select("key", F.col("n").alias("n_shingles"), "component_id", F.col("c").alias("group"))


def with_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    g = jaccard_groups(docs).select(F.col("key").alias("_k"), "n_shingles", "component_id")
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("_t"))
    out = d.join(g, F.col("_t") == F.col("_k"), "left")
    n = F.coalesce("n_shingles", F.lit(0)).cast("bigint")
    return out.select("doc_id", n.alias("n_shingles"), F.when(n > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id; texts without words all stay.

    Of rows with that doc_id, the one with the smallest text key stays, so rows that agree in doc_id and text count as one
    document. Unlinked texts stay, however many rows share their doc_id or have none. Other columns pass through,
    whatever their names.
    """
    names = docs.columns
    t, k, i, c, r = (fresh(docs, x) for x in ("_key", "_k", "_id", "_c", "_row"))
    g = jaccard_groups(docs.select("doc_id", "text")).where("n_shingles > 0").select(F.col("key").alias(k), F.col("component_id").alias(i), F.col("group").alias(c))
    d = docs.withColumn(t, F.xxhash64(F.col("text").cast("string")))
    bare = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    # by id and text at once: neither a text with very many copies nor an id of very many rows lands in one task
    worded = d.where(~bare).join(g, (F.col(t) == F.col(k)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(i)))
    worded = worded.groupBy(c).agg(F.min_by(F.struct(*[F.col(f"`{x}`") for x in names]), t).alias(r)).select(f"{r}.*")
    return worded.select(*[F.col(f"`{x}`") for x in names]).unionByName(d.where(bare).select(*[F.col(f"`{x}`") for x in names]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS x FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id),
l AS (SELECT a, b FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT id AS a, id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n USING (id)
JOIN (SELECT r.a AS id, min(e.doc_id) AS component_id FROM r JOIN d e ON r.b = e.id GROUP BY r.a) m ON m.id = d.id
"""
