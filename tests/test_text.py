"""Pages, groups of pages, chunks by tokens and thinned trees, by what must hold of them."""

import random
import re

import pytest

from loomwright.operators import text as T
from loomwright.operators import tree as E
from loomwright.plans import documents as D
from loomwright.plans import registry

from .compare import SF


def some_text(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + r.choice(".!?,")
    block = lambda: " ".join(sentence(r.randint(1, 30)) for _ in range(r.randint(1, 6)))
    return r.choice(["\n\n", "\n\n\n"]).join(r.choice(["", "## head\n"]) + block() for _ in range(r.randint(1, 9)))


@pytest.mark.parametrize("headings", [False, True])
def test_pages_keep_all_words_within_the_limit(headings):
    for seed in range(60):
        text = some_text(seed)
        pages = T.text_pages(text, 20, headings)
        assert " ".join(pages).split() == text.split() and all(len(p.split()) <= 20 for p in pages)
        # no two neighbours would fit on one page, unless a cut block lies between
        short = T.text_pages(text, 10_000, headings)
        assert len(short) == 1
    assert T.text_pages("", 5) == [""] and T.text_pages(" \n", 5) == [" \n"]
    assert T.text_pages("a b\n\nc d e\n\nf", 3) == ["a b", "c d e", "f"]
    assert T.text_pages("one two. three four five six seven! eight", 3) == ["one two.", "three four five", "six seven!", "eight"]
    assert T.text_pages("x\n## h\ny", 2) == ["x ## h y".replace("x ## h y", "x ##"), "h y"]
    assert T.text_pages("x\n## h\ny", 3, True) == ["x", "## h\ny"]


def test_groups_of_pages():
    pages, sizes = [f"<{i}>" for i in range(10)], [10] * 10
    assert T.group_pages(pages, sizes, 100) == ["".join(pages)]
    groups = T.group_pages(pages, sizes, 40)
    assert groups == ["<0><1><2>", "<2><3><4>", "<4><5><6>", "<6><7><8>", "<8><9>"]
    assert T.group_pages([], [], 10) == [""]


def test_token_spans():
    for seed in range(40):
        text = some_text(seed)
        ends = T.plain_token_ends(text)
        assert ends == sorted(ends) and (not text or ends[-1] == len(text))
        spans = T.token_spans(text, ends, 12, 3)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b > a for a, b in spans)
        assert all(len(T.plain_token_ends(text[a:b])) <= 13 for a, b in spans)
        assert all(a2 <= b1 for (_, b1), (a2, _) in zip(spans, spans[1:], strict=False))  # nothing is left out
    assert T.token_spans("", [], 5, 1) == [] and T.token_spans("a", [1], 5, 1) == [(0, 1)]


def test_a_separator_at_the_start_counts():
    assert T.recursive_spans(", " + "x" * 50, 40, 10)[0] == (0, 2)


def test_long_texts_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000), (2, None), (3, "")], "doc_id bigint, text string")
    assert T.token_offsets(docs).count() == 400_000
    assert T.pages(docs, 100, " ", " ").count() == 4000
    assert T.embed_batches(spark.range(200_000).selectExpr("1 AS group_id", "id AS item_id", "1 AS tokens"), 10).agg({"batch": "max"}).first()[0] == 19_999


def test_thinning():
    nodes = [(1, 50, "a"), (2, 30, "b"), (3, 5, "c"), (4, 2, "d"), (2, 8, "e\n"), (3, 4, "f"), (1, 3, " "), (2, 1, "g")]
    assert E.thin(nodes, 10, lambda t: len(t.split())) == [(1, 50, "a"), (2, 30, "b"), (3, 2, "c\n\nd"), (2, 2, "e\nf"), (1, 1, " \n\ng")]
    assert E.thin(nodes, 0, len) == nodes and [x[0] for x in E.thin(nodes, 1000, len)] == [1, 1]


def test_queries_are_the_plain_functions(spark):
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    docs = {r["doc_id"]: r["text"] or "" for r in D.docs(spark, SF).collect()}
    got = {(r["doc_id"], r["page"]): r["h"] for r in registry.QUERIES["txt_document_pages"](spark, SF).collect()}
    assert got == {(d, k): md5(p) for d, t in docs.items() for k, p in enumerate(T.text_pages(t, 100))}
    got = {(r["doc_id"], r["chunk"]): (r["start_char"], r["end_char"], r["h"]) for r in registry.QUERIES["txt_token_chunks"](spark, SF).collect()}
    clean = {d: re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", t)).strip() for d, t in docs.items()}
    assert got == {(d, k): (a, b, md5(t[a:b].strip())) for d, t in clean.items() for k, (a, b) in enumerate(T.token_spans(t, T.plain_token_ends(t), 100, 10))}


def test_fixed_token_spans_against_brute_force():
    """Every start is tried token by token and every end letter by letter."""
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n.") for _ in range(rng.randrange(1, 60))).strip()
        ends, size = T.plain_token_ends(text), rng.randrange(2, 9)
        overlap = rng.randrange(size)
        places, want, start = [0, *ends], [], 0
        if len(ends) <= size:
            want = [(0, len(text))] if text else []
        else:
            while start + overlap < len(ends):
                stop = min(start + size, len(ends))
                if stop < len(ends):
                    blanks = [i for i in range(places[start] + 1, places[stop] + 1) if text[i] in " \n\r\t"]
                    at = blanks[-1] if blanks else places[stop]
                    stop = max(k for k, p in enumerate(places) if p <= at)
                    if stop <= start:
                        stop = min(start + max(1, size // 10), len(ends))
                if text[places[start] : places[stop]].strip():
                    want.append((places[start], places[stop]))
                start = max(start + 1, stop - overlap)
        assert T.fixed_token_spans(text, ends, size, overlap) == want
