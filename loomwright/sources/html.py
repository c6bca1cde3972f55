"""Text of HTML pages: one pass of the standard library's parser, in Arrow batches of the HTML column alone."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements left out with all they hold, elements that start a line, the parts preferred as main text, and
# elements that never hold anything.
LEFT_OUT = frozenset("script style head nav footer aside noscript".split())
BLOCKS = frozenset("p div section article main header h1 h2 h3 h4 h5 h6 ul ol li br hr blockquote pre table tr td th".split())
MAIN = ("main", "article", "body")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Page(HTMLParser):
    """Collects what a page shows; a closing tag closes all that was opened since its element, a stray one nothing."""

    def __init__(self, alt: bool):
        super().__init__(convert_charrefs=True)
        self.alt, self.open, self.shown, self.run = alt, [], [], []
        self.hidden = 0  # open elements that are left out
        self.spans: dict[str, list] = {}
        self.title, self.description, self.in_title = None, None, False

    def _flush(self) -> None:
        text, self.run = "".join(self.run).strip(), []
        if text and self.in_title:
            self.title.append(text)
        if text and not self.hidden:
            self.shown.append(text + " ")

    def handle_data(self, data: str) -> None:
        self.run.append(data)

    def handle_comment(self, data: str) -> None:
        """Comments count as text of their own, but not in titles."""
        self._flush()
        if data.strip() and not self.hidden:
            self.shown.append(data.strip() + " ")

    handle_decl = handle_pi = handle_comment

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        found = dict(attrs)
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        if tag in LEFT_OUT:
            self.hidden += 1
        elif not self.hidden:
            if tag in BLOCKS:
                self.shown.append("\n")
            if tag in MAIN and tag not in self.spans:
                self.spans[tag] = [len(self.shown), None, len(self.open)]
            if tag == "img" and self.alt and found.get("alt"):
                self.shown.append(f"[Image: {found['alt']}] ")
            if tag == "meta" and found.get("name") == "description" and self.description is None:
                self.description = found.get("content") or ""
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            self.hidden -= last in LEFT_OUT
            self.in_title &= last != "title"
            span = self.spans.get(last)
            if span and span[1] is None and span[2] == len(self.open):
                span[1] = len(self.shown)
            if last == tag:
                break

    def result(self) -> tuple[str, str | None, str | None]:
        self.close()
        self._flush()
        start, end, _ = next((self.spans[t] for t in MAIN if t in self.spans), (0, None, 0))
        text = re.sub(r"\n\s*\n+", "\n\n", re.sub(" +", " ", "".join(self.shown[start:end])))
        return "\n".join(x.strip() for x in text.split("\n")).strip(), "".join(self.title or []) or None, self.description or None


def page_text(html: str, alt: bool = True) -> tuple[str, str | None, str | None]:
    """(text, title, description) of a page."""
    page = _Page(alt)
    page.feed(html)
    return page.result()


def extract_html(pages: DataFrame, html: str = "html", alt: bool = True) -> DataFrame:
    """pages with a struct `page`: text, title, description, char_count, line_count. Null HTML gives a null struct."""

    @F.pandas_udf("text string, title string, description string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([page_text(x or "", alt) for x in batch], columns=["text", "title", "description"])

    read = read.asNondeterministic()  # keeps it from being worked out once for each field
    got = pages.withColumn("page", read(F.col(html)))
    page = F.col("page")
    lines = F.length(page["text"]) - F.length(F.replace(page["text"], F.lit("\n"), F.lit(""))) + 1
    full = F.struct(page["text"].alias("text"), page["title"].alias("title"), page["description"].alias("description"), F.length(page["text"]).cast("bigint").alias("char_count"), lines.cast("bigint").alias("line_count"))
    return got.withColumn("page", F.when(F.col(html).isNotNull(), full))
