"""Column functions on text that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: a run of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"


def strip(c: Column) -> Column:
    """Without white space on either side (all of it, not only blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def word_list(c: Column) -> Column:
    """Words between white space; none for blank or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(word_list(c)).cast("bigint")


def tokens(c: Column) -> Column:
    """Lower-case tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def clean_fixed(c: Column) -> Column:
    """Runs of line feeds and of blanks as one each, nothing on either side."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n+", "\n"), " +", " "))


def clean_recursive(c: Column) -> Column:
    """At most one empty line in a row, runs of blanks and tabs as one blank, nothing on either side."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def clean_html_text(c: Column) -> Column:
    """Squeezes blanks and empty lines of text taken from HTML, and strips every line."""
    squeezed = F.regexp_replace(F.regexp_replace(c, " +", " "), r"\n\s*\n+", "\n\n")
    return strip(F.array_join(F.transform(F.split(squeezed, "\n"), strip), "\n"))


def line_count(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def tool_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_-]", "_")


def cap(c: Column, most: int) -> Column:
    """Long text cut, with a note of its whole length."""
    note = F.concat(F.left(c, F.lit(most)), F.lit("\n[Truncated: "), F.length(c).cast("string"), F.lit(" chars total]"))
    return F.when(F.length(c) > most, note).otherwise(c)


def dot_leaders(c: Column) -> Column:
    """Rows of five dots or more, with or without blanks between them, as a colon."""
    return F.regexp_replace(F.regexp_replace(c, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def labelled_page(number: Column, text: Column) -> Column:
    """A page's text between two tags with its number."""
    tag = F.concat(F.lit("<physical_index_"), number.cast("string"), F.lit(">\n"))
    return F.concat(tag, text, F.lit("\n"), tag)
