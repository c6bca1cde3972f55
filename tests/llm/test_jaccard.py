"""The Jaccard join on large groups, its signatures, and its rows with odd ids and names."""

import collections

import numpy as np
import pytest

from loomwright.llm import jaccard
from loomwright.llm.components import components


def labels(x):
    """The smallest index reachable by links, for a 0/1 matrix of sets by shingles."""
    common = x @ x.T
    n = x.sum(1)
    link = (100 * common >= 80 * (n[:, None] + n[None, :] - common)) & (n[:, None] > 0)
    out = np.arange(len(x))
    while True:
        new = np.minimum(out, np.where(link, out[None, :], len(x)).min(1))
        new = np.minimum(new, new[new])
        if (new == out).all():
            return out
        out = new


def test_two_thousand_near_copies(spark):
    """A group whose members are linked in many components; no link is lost."""
    rng = np.random.default_rng(7)
    base, texts = [f"w{i}" for i in range(70)], []
    for i in range(2000):
        w = list(base)
        for at in rng.integers(0, 70, int(rng.integers(0, 7))):
            w[at] = f"e{at}x{rng.integers(4)}"  # edits that others have too
        texts.append(" ".join(w[: 70 - int(rng.integers(0, 12))]))
    shingles, rows = {}, []
    for t in texts:
        w = t.split(" ")
        rows.append({shingles.setdefault(tuple(w[k : k + 5]), len(shingles)) for k in range(len(w) - 4)})
    x = np.zeros((len(texts), len(shingles)), np.float32)
    for i, r in enumerate(rows):
        x[i, list(r)] = 1
    want = labels(x)
    assert 20 < len(set(want)) < 1900
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.with_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want.tolist()


@pytest.mark.parametrize(("subparts", "misses"), [(1, 0), (2, 1), (3, 1), (4, 2), (5, 1)])
def test_subsets_of_parts_cover_similar_sets(subparts, misses):
    """Sets that differ as much as links allow share a signature, whatever the subsets, with frequent shingles or without."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 4, 9, 30, 150, 700):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            lost = n // 10  # as many others in their place: n + lost in both together
            y = np.unique(np.concatenate([rng.permutation(x)[lost:], rng.integers(0, 1 << 63, lost, dtype=np.uint64)]))
            common = len(np.intersect1d(x, y))
            assert 100 * common >= 80 * (len(x) + len(y) - common)
            for frequent in (x[:0], np.sort(rng.permutation(x)[: int(0.7 * n)])):
                a, b = (jaccard.signatures(z, frequent, subparts, misses) for z in (x, y))
                assert np.intersect1d(a, b).size


def test_linked_sets_share_as_many_signatures_as_stated():
    """Sets that differ as much as links allow have at least the stated number of signatures in common."""
    rng = np.random.default_rng(10)
    stated = []
    for n in (1, 4, 30, 150, 700):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            lost = n // 10
            for y in (np.unique(np.concatenate([rng.permutation(x)[lost:], rng.integers(0, 1 << 63, lost, dtype=np.uint64)])), np.sort(rng.permutation(x)[n // 5 :])):
                for frequent in (x[:0], np.sort(rng.permutation(x)[: int(0.4 * n)]), np.sort(rng.permutation(x)[: int(0.9 * n)])):
                    (a, least), (b, other) = (jaccard.signed(z, frequent) for z in (x, y))
                    stated.append(max(least, other))
                    assert len(np.intersect1d(a, b)) >= stated[-1]
    assert min(stated) == 1 and max(stated) > 15


def test_texts_that_share_a_passage_are_left_early(spark, monkeypatch):
    """Three texts with half of their words in common have few signatures together: their shingles aren't gathered."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(1 << 40)}"
    texts = []
    for _ in range(20):
        passage = [word() for _ in range(220)]
        texts += [" ".join([*passage, *(word() for _ in range(200))]) for _ in range(3)]
    seen, plain = [], jaccard._open
    monkeypatch.setattr(jaccard, "_open", lambda some, texts: seen.append(some.count()) or plain(some, texts))
    got = jaccard.with_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == 60
    assert seen == [0]


def test_clashing_names_and_types(spark):
    """Helper columns take names that docs doesn't have; ids may be of a smaller type."""
    text = lambda g, more="": " ".join(f"w{g}_{k}" for k in range(40)) + more
    rows = [(1, text(1), "a", "b", "c", "d", "e"), (2, text(1, " end"), "f", "g", "h", "i", "j"), (3, "", "k", None, "m", "n", "o")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _key string, _k string, `_id` string, `_c` string, `_row.x` string")
    got = jaccard.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]
    assert jaccard.drop_near_copies(docs.limit(0)).count() == 0


def test_components_of_a_hub_and_a_chain(spark):
    links = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(7000, 7000), (7001, 7002), (7002, 7001)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert collections.Counter(got.values()) == {0: 3000, 5000: 201, 7001: 2}
