"""Paging, chunking and token offsets: one row in, many rows out."""

from __future__ import annotations

import bisect
import collections
import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, word_list

PAGE_WORDS, CHUNK, OVERLAP, BATCH_TOKENS = 1500, 2000, 50, 200_000


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk_size must be positive")
    if overlap < 0:
        raise ValueError("chunk_overlap must not be negative")
    if overlap >= size:
        raise ValueError("chunk_overlap must be less than chunk_size")


def packed(sizes: Iterable[int], most: int) -> Iterator[int]:
    """Greedy packing: the number from 0 of the batch that each size goes to.

    A batch is closed when the next size would take it past `most`; a batch is never empty, so a greater size is one.
    """
    number, total, any_yet = 0, 0, False
    for n in sizes:
        if any_yet and total + n > most:
            number, total = number + 1, 0
        total, any_yet = total + n, True
        yield number


def _rows(docs: DataFrame, cut: Callable[[str], Iterable[tuple]], kinds: str) -> DataFrame:
    """One row for each tuple that `cut` gives for the text of docs (doc_id, text); null texts are empty.

    Rows go on in batches, so a text of any length takes memory in proportion to itself.
    """
    names = [x.split()[0] for x in kinds.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string()}
    schema = [types[x.split()[1]] for x in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], [[] for _ in names]

            def full(batch=batch) -> pa.RecordBatch:
                nonlocal at, cols
                out = pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, schema, strict=True)]], names=["doc_id", *names])
                at, cols = [], [[] for _ in names]
                return out

            for i, text in enumerate(batch.column(1)):
                for row in cut(text.as_py() or ""):
                    at.append(i)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                    if len(at) == 50_000:
                        yield full()
            yield full()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {kinds}")


def word_pages(docs: DataFrame, n: int) -> DataFrame:
    """docs (doc_id, text): pages of n words each, numbered from 0."""
    w = docs.select("doc_id", word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    pages = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / n).cast("int"))).alias("page"))
    return pages.select("doc_id", F.col("page").cast("bigint").alias("page"), F.array_join(F.slice("w", F.col("page") * n + 1, n), " ").alias("text"))


def pages(docs: DataFrame, most: int = PAGE_WORDS, block: str = r"\n\n+", glue: str = "\n\n") -> DataFrame:
    """docs (doc_id, text): blocks packed into pages of `most` words at most; greater blocks are pages of their own."""

    def cut(text: str) -> Iterator[tuple[int, str]]:
        blocks = [x for x in (y.strip(" ") for y in re.split(block, text)) if x]
        numbers = packed((len(re.findall(r"[^\s]+", x, re.ASCII)) for x in blocks), most)
        for number, own in itertools.groupby(zip(numbers, blocks, strict=True), lambda x: x[0]):
            yield number, glue.join(x for _, x in own)

    return _rows(docs, cut, "page bigint, text string")


# What ends a sentence, and where a heading starts.
_SENTENCE_END, _HEADING = re.compile(r"(?<=[.!?])\s+"), re.compile(r"(?=(?:^|\n)#{1,6}\s)", re.MULTILINE)


def text_pages(text: str, most: int = PAGE_WORDS, headings: bool = False) -> list[str]:
    """A text as pages of about `most` words: paragraphs packed, those that are longer cut by sentences, then by words.

    headings: sections start new paragraphs. A blank text is its own page; there is always one at least.
    """
    if not text.strip():
        return [text]
    sections = _HEADING.split(text) if headings else [text]
    out: list[str] = []
    held: list[str] = []
    count = 0

    def flush(glue: str) -> None:
        nonlocal held, count
        if held:
            out.append(glue.join(held))
        held, count = [], 0

    def put(part: str, n: int, glue: str) -> None:
        nonlocal count
        if held and count + n > most:
            flush(glue)
        held.append(part)
        count += n

    for block in (p.strip() for s in sections for p in re.split(r"\n\n+", s)):
        n = len(block.split())
        if not n:
            continue
        if n <= most:
            put(block, n, "\n\n")
            continue
        flush("\n\n")
        for sentence in _SENTENCE_END.split(block):
            words = sentence.split()
            if len(words) <= most:
                put(sentence, len(words), " ")
                continue
            flush(" ")
            out += [" ".join(words[k : k + most]) for k in range(0, len(words), most)]
        flush(" ")
    flush("\n\n")
    return out or [text]


def document_pages(docs: DataFrame, most: int = PAGE_WORDS, headings: bool = False) -> DataFrame:
    """docs (doc_id, text): text_pages of each text, numbered from 0; null texts are empty."""
    return _rows(docs, lambda t: enumerate(text_pages(t, most, headings)), "page bigint, text string")


def group_pages(contents: list[str], sizes: list[int], most: int = 32_000, overlap: int = 1) -> list[str]:
    """Pages joined into groups of even size, `most` tokens at most, each starting with the last `overlap` pages of the one before."""
    total = sum(sizes)
    if total <= most:
        return ["".join(contents)]
    target = math.ceil((total / math.ceil(total / most) + most) / 2)
    out, first, held, start = [], 0, 0, 0
    for i, n in enumerate(sizes):
        if held + n > target:
            out.append("".join(contents[start:i]))
            start = max(i - overlap, 0)
            held = sum(sizes[start:i])
        held += n
    return [*out, "".join(contents[start:])] if contents[start:] else out


def page_groups(pages_: DataFrame, most: int = 32_000, overlap: int = 1) -> DataFrame:
    """pages_ (doc_id, page, text, tokens): the groups of each document's pages, numbered from 0; a document's pages meet in one row."""
    d = pages_.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text", "tokens"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, text = [], [], []
            for i, p in enumerate(batch.column(1)):
                p = p.as_py()
                for k, t in enumerate(group_pages([x["text"] or "" for x in p], [x["tokens"] for x in p], most, overlap)):
                    at.append(i), number.append(k), text.append(t)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "group", "text"])

    return d.mapInArrow(run, f"doc_id {dict(pages_.dtypes)['doc_id']}, group bigint, text string")


def fixed_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """docs (doc_id, text): windows of `size` characters that overlap, cut anywhere, numbered from 0."""
    check_sizes(size, overlap)
    step, n = size - overlap, F.length("text")
    d = docs.where(n > 0)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step))
    d = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("i"))
    start = F.col("i") * step
    return d.select("doc_id", F.col("i").cast("bigint").alias("chunk"), start.cast("bigint").alias("start_char"), F.least(start + size, n).cast("bigint").alias("end_char"), F.substr("text", start + 1, F.lit(size)).alias("text"))


# Where a recursive chunk may end, in order of preference.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")


def recursive_spans(text: str, size: int, overlap: int, drop_tail: bool = False) -> list[tuple[int, int]]:
    """Spans of chunks that end behind the last separator of the first kind found, else at `size` characters.

    Past the end of the text, shrinking suffixes follow until the overlap is used up, unless drop_tail is set.
    """
    out, start = [], 0
    if len(text) <= size:
        return [(0, len(text))] if text.strip() else []
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for sep in SEPARATORS:
                if (at := text.rfind(sep, start, end)) >= start:
                    end = at + len(sep)
                    break
        if text[start:end].strip():
            out.append((start, end))
        if drop_tail and end == len(text):
            break
        start = end - overlap if end - overlap > start else start + max(1, size // 10)
    return out


def token_spans(text: str, ends: Sequence[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of recursive chunks of `size` tokens; ends: where each token ends in the text.

    A chunk ends behind the last separator of the first kind found, moved back to the end of a token; spans cover whole
    tokens.
    """
    places, n, out, start = [0, *ends], len(ends), [], 0
    if n <= size:
        return [(0, len(text))] if text.strip() else []
    while start < n:
        stop = min(start + size, n)
        if stop < n:
            a, b = places[start], places[stop]
            cut = next((at + len(x) for x in SEPARATORS if (at := text.rfind(x, a, b)) >= a), b)
            stop = bisect.bisect_right(places, cut) - 1
            if stop <= start:
                stop = min(start + max(1, size // 10), n)
        if text[places[start] : places[stop]].strip():
            out.append((places[start], places[stop]))
        start = stop - overlap if stop - overlap > start else min(n, start + max(1, size // 10))
    return out


#: Letters and digits, or one other sign with the blanks before it: the tokens that stand in for a model's.
_SIGNS = re.compile(r"\s*(?:[^\W_]+|\S)|\s+$")


def plain_token_ends(text: str) -> list[int]:
    return [m.end() for m in _SIGNS.finditer(text)]


def token_chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, ends: Callable[[str], Sequence[int]] = plain_token_ends) -> DataFrame:
    """docs (doc_id, text): recursive chunks of `size` tokens of cleaned text.

    ends: gives the end of each token of a text, in characters; any tokenizer can be used by it. Characters count in the
    cleaned text; chunk texts have no white space on either side.
    """
    check_sizes(size, overlap)

    def cut(text: str) -> Iterator[tuple[int, int, int, str]]:
        text = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text)).strip()
        for k, (a, b) in enumerate(token_spans(text, ends(text), size, overlap)):
            yield k, a, b, text[a:b].strip()

    return _rows(docs, cut, "chunk bigint, start_char bigint, end_char bigint, text string")


def fixed_token_spans(text: str, ends: Sequence[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of `size` tokens that back up to a blank, moved back to the end of a token; ends: where each token ends.

    They end once the rest lies within the overlap. Where no token ends before the blank, a tenth of `size` tokens is taken.
    """
    places, n, out, start = [0, *ends], len(ends), [], 0
    if n <= size:
        return [(0, len(text))] if text.strip() else []
    while start + overlap < n:
        stop = min(start + size, n)
        if stop < n:
            a, b = places[start], places[stop]
            cut = max(text.rfind(x, a + 1, b + 1) for x in " \n\r\t")
            stop = bisect.bisect_right(places, cut if cut > a else b) - 1
            if stop <= start:
                stop = min(start + max(1, size // 10), n)
        if text[places[start] : places[stop]].strip():
            out.append((places[start], places[stop]))
        start = max(start + 1, stop - overlap)
    return out


def fixed_token_chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, ends: Callable[[str], Sequence[int]] = plain_token_ends) -> DataFrame:
    """docs (doc_id, text): fixed chunks of `size` tokens of cleaned text; ends and the columns are token_chunks'."""
    check_sizes(size, overlap)

    def cut(text: str) -> Iterator[tuple[int, int, int, str]]:
        text = re.sub(" +", " ", re.sub(r"\n+", "\n", text)).strip()
        for k, (a, b) in enumerate(fixed_token_spans(text, ends(text), size, overlap)):
            yield k, a, b, text[a:b].strip()

    return _rows(docs, cut, "chunk bigint, start_char bigint, end_char bigint, text string")


def fixed_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of `size` characters that back up to white space; they end once the rest lies within the overlap."""
    if len(text) <= size:
        return [(0, len(text))] if text.strip() else []
    out, start = [], 0
    while start + overlap < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at = max((m.start() for m in re.finditer(r"\s", text[start:end])), default=0)
            end = start + at if at > overlap else start + size
        if text[start:end].strip():
            out.append((start, end))
        start = max(start + 1, end - overlap)
    return out


def chunk(docs: DataFrame, spans, size: int = CHUNK, overlap: int = OVERLAP, **more) -> DataFrame:
    """docs (doc_id, text) cut by a function of text, size and overlap that gives spans."""
    check_sizes(size, overlap)
    cut = lambda t: ((k, x, y, t[x:y]) for k, (x, y) in enumerate(spans(t, size, overlap, **more)))
    return _rows(docs, cut, "chunk bigint, start_char bigint, end_char bigint, text string")


def token_offsets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): pos, token and start_char of each token."""

    def cut(text: str) -> Iterator[tuple[int, str, int]]:
        import regex

        for k, m in enumerate(regex.finditer(TOKEN, text)):
            yield k, m[0], m.start()

    return _rows(docs, cut, "pos bigint, token string, start_char bigint")


def embed_batches(chunks: DataFrame, most: int = BATCH_TOKENS) -> DataFrame:
    """chunks (group_id, item_id, tokens): the batch of each item, packed in item order within its group.

    A group's rows pass through one task in order, and only the batch that is open is known there: no group is held.
    """
    kinds = dict(chunks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, feed, numbers = object(), None, None
        for batch in batches:
            out = []
            for group, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if group != open_:
                    open_, feed = group, collections.deque()
                    numbers = packed(iter(feed.popleft, None), most)
                feed.append(n or 0)
                out.append(next(numbers))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["group_id", "item_id", "batch"])

    rows = chunks.select("group_id", "item_id", F.col("tokens").cast("bigint").alias("tokens"))
    return rows.repartition("group_id").sortWithinPartitions("group_id", "item_id", "tokens").mapInArrow(run, f"group_id {kinds['group_id']}, item_id {kinds['item_id']}, batch bigint")


def count_windows(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """rows with the number, from 0, of their slice of n rows of a group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("window", F.floor((F.row_number().over(w) - 1) / n).cast("bigint"))
