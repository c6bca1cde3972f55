"""Files as rows: media types, decoding, choice of an extractor, and the derivatives that extraction gives."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "application/octet-stream"
_OFFICE = "application/vnd.openxmlformats-officedocument."
# The media types of each extractor; of equal ones, the last holds.
EXTRACTORS = [
    ("text", "text/markdown"), ("text", "text/x-markdown"), ("text", "text/csv"), ("text", "text/html"), ("text", "text/xml"), ("text", "text/json"),
    ("text", "application/json"), ("text", "text/x-python"), ("text", "text/x-java"), ("text", "text/javascript"), ("text", "application/javascript"), ("text", "text/*"),
    ("html", "text/html"), ("html", "application/xhtml+xml"), ("pdf", "application/pdf"), ("docx", _OFFICE + "wordprocessingml.document"),
    ("xlsx", _OFFICE + "spreadsheetml.sheet"), ("xlsx", "application/vnd.ms-excel"), ("pptx", _OFFICE + "presentationml.presentation"), ("txt", "text/plain"),
    ("image", "image/png"), ("image", "image/jpeg"), ("image", "image/jpg"), ("image", "image/webp"), ("image", "image/gif"), ("image", "image/tiff"),
]


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def mime_type(name: Column) -> Column:
    """The media type of a file name by its ending; names without a known one are octet streams."""
    known = mimetypes.MimeTypes()
    bare = F.regexp_replace(name, r"\.(gz|Z|bz2|xz|br)$", "")
    ending = F.lower(F.regexp_extract(bare, r"(?:^|/)\.*[^./][^/]*(\.[^./]+)$", 1))
    return F.coalesce(F.try_element_at(_lookup({k.lower(): v for k, v in known.types_map[True].items()}), ending), F.lit(UNKNOWN))


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """uri, name, mime_type, size, modified_at and content of all files below path; content is read only if selected.

    A missing path raises when the files are listed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("uri"), name.alias("name"), mime_type(name).alias("mime_type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")


def uploads(df: DataFrame) -> DataFrame:
    """Rows (filename, content, optionally mime_type) as files; rows without content raise."""
    given = F.col("mime_type") if "mime_type" in df.columns else F.lit(None).cast("string")
    content = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no content for "), F.coalesce("filename", F.lit("?"))))).otherwise(F.col("content"))
    return df.select(F.concat(F.lit("upload://"), "filename").alias("uri"), F.col("filename").alias("name"), F.coalesce(given, mime_type(F.col("filename"))).alias("mime_type"), content.alias("content"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 if they aren't valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def extractor(mime: Column, registered: list[tuple[str, str]] = EXTRACTORS) -> Column:
    """The extractor's name: by the whole type, else by what precedes a semicolon, else by `type/*`; null if none."""
    names = _lookup({m: n for n, m in registered})
    base = F.trim(F.element_at(F.split(mime, ";"), 1))
    return F.coalesce(F.try_element_at(names, mime), F.try_element_at(names, base), F.try_element_at(names, F.concat(F.element_at(F.split(base, "/"), 1), F.lit("/*"))))


def primary_text(derivatives: DataFrame) -> DataFrame:
    """(uri, text) of each uri's preferred derivative (uri, ord, type, content): markdown, then text, then html; the first."""
    rank = F.array_position(F.array(*map(F.lit, ("markdown", "text", "html"))), F.col("type"))
    return derivatives.where("type IN ('markdown', 'text', 'html')").groupBy("uri").agg(F.min_by("content", F.struct(rank, "ord")).alias("text"))


def all_text(derivatives: DataFrame) -> DataFrame:
    """(uri, text): a uri's markdown, text and html derivatives in order, between empty lines; pages aren't repeated."""
    kept = derivatives.where("type IN ('markdown', 'text', 'html')")
    return kept.groupBy("uri").agg(F.expr("listagg(content, '\n\n') WITHIN GROUP (ORDER BY ord)").alias("text"))


def page_batches(files: DataFrame, size: int) -> DataFrame:
    """(uri, batch, first_page, last_page) for files (uri, pages), pages counted from 1; files without pages have none."""
    if size < 1:
        raise ValueError("a batch has one page at least")
    rows = files.where("pages > 0").select("uri", "pages", F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("pages") - 1) / size).cast("bigint"))).alias("batch"))
    return rows.select("uri", "batch", (F.col("batch") * size + 1).alias("first_page"), F.least(F.col("batch") * size + size, F.col("pages").cast("bigint")).alias("last_page"))


def merge_batches(results: DataFrame) -> DataFrame:
    """One row for each uri of results (uri, batch, markdown, pages_processed): the batches' markdown in order, and sums."""
    text = F.coalesce(F.expr("listagg(markdown, '\n\n') WITHIN GROUP (ORDER BY batch)"), F.lit(""))
    out = results.groupBy("uri").agg(text.alias("markdown"), F.sum("pages_processed").alias("pages_processed"), F.count(F.lit(1)).alias("batch_count"))
    return out.withColumn("char_count", F.length("markdown").cast("bigint"))


def with_annotations(markdown: Column, notes: Column) -> Column:
    """Image placeholders with their notes (array of structs id, note) beneath; images without a note stay.

    A placeholder whose address is the id itself comes first; if there is none, any address will do.
    """

    def put(text: Column, n: Column) -> Column:
        mark = F.concat(F.lit("!["), n["id"], F.lit("]"))
        exact, new = F.concat(mark, F.lit("("), n["id"], F.lit(")")), F.concat(mark, F.lit("\n**"), n["note"], F.lit("**"))
        quoted = F.concat(F.lit("\\Q"), F.replace(mark, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\([^)]*\\)"))
        swapped = F.when(F.contains(text, exact), F.replace(text, exact, new)).otherwise(F.call_function("array_join", F.split(text, quoted), new))
        return F.when(F.coalesce(n["note"], F.lit("")) == "", text).otherwise(swapped)

    return F.aggregate(notes, markdown, put)
