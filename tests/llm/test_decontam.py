"""Wu-Manber search against a plain one, with many patterns, and its memory."""

import re
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomwright.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, items):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    hit, found = set(), set()
    for name, t in items:
        p = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        m = min(13, len(p))
        windows = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)} if m else set()
        for i in range(len(w) - m + 1) if m else ():
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(name)
    return len(w), len(hit), sorted(found)


def cases(seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "ß9", "日本"]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(i % 37, say(int(rng.integers(0, 40)))) for i in range(60)] + [(90, "w1"), (91, "w1"), (92, None), (93, "--")]
    docs = [say(int(rng.integers(0, 200))) for _ in range(60)] + [None, "", "...", "x" * 200_000, say(20_000)]
    for i in range(0, 60, 3):
        cut = (items[i][1] or "").split(" ")
        docs[i] = docs[i].upper() + "; " + " ".join(cut[:20]) + "-" + docs[i + 1]
    return docs, items


@pytest.mark.parametrize("part_bytes", [1 << 24, 300])
def test_same_as_plain_search(spark, part_bytes):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(docs)], "doc_id bigint, text string, contamination string, _hits int")
    out = decontam.contamination(d, spark.createDataFrame(items, "item_id bigint, text string"), part_bytes)
    for r in out.collect():
        v = r["_contamination"]
        n, hit, found = plain(docs[r["doc_id"]], items)
        assert (v["n_words"], v["n_hit"], v["item_ids"]) == (n, hit, found)
        assert v["contaminated"] == (hit > 0 and 20 * hit >= n) and r["contamination"] == "x" and r["_hits"] == 7


def test_empty_tables_and_null_items(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string")
    for items in ([], [(1, None)], [(None, "a")], [(1, "?")]):
        bench = spark.createDataFrame(items, "item_id bigint, text string")
        assert sorted(map(tuple, decontam.decontaminate(docs, bench).collect()), key=str) == [(1, "a b"), (None, None)]
    bench = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert decontam.decontaminate(docs, bench).count() == 1


def test_items_that_share_windows():
    items = [(i, "a b c") for i in range(500)] + [(1000 + i, "z") for i in range(500)]
    s = decontam.Searcher(np.array([i for i, _ in items]), pa.array([t for _, t in items]))
    hit, of, ids = s.search(decontam.Words(pa.array(["a b c " * 3000, "b c", "z" * 3])))
    assert hit.sum() == 9000 and set(of) == {0} and sorted(ids) == list(range(500))


def test_memory_of_a_large_benchmark():
    """A part of the greatest size, in a process of its own: less than 1 GB, and most positions are skipped."""
    code = """
import numpy as np, pyarrow as pa, resource
from loomwright.llm import decontam as D
rng = np.random.default_rng(1)
words = np.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(200_000)])
text = [" ".join(words[rng.integers(0, len(words), 300)]) for _ in range(D.BENCH_BYTES // 2100)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
s = D.Searcher(np.arange(len(text)), pa.array(text, pa.large_string()))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024, float(max((g.shift == 0).mean() for g in s.groups)))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    mb, zero = map(float, out.stdout.split())
    assert mb < 1000 and zero < 0.15, out


def test_memory_of_hashing_words(monkeypatch):
    texts = pa.array([None, "", "É ß9" * 5000, "x" * 100_000, *[" ".join(f"word{i * j % 997}" for j in range(1000)) for i in range(120)]])
    tracemalloc.start()
    whole = decontam.Words(texts).hash
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    monkeypatch.setattr(decontam, "HASHED", 7)
    assert (decontam.Words(texts).hash == whole).all() and len(whole) > 2 << 14
