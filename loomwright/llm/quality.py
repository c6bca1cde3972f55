"""Quality rules with cross-document line frequency (operator 10), in DataFrame functions only.

Normalised lines are hashed, and distinct documents are counted for each host (the source) and line. Lines above the
host's limit are removed; documents that lose most of their words, or keep too few, are rejected.

Documents count as distinct by a 64-bit hash of the whole text, in the counts of lines and of a host's documents alike:
exact copies count once, so that a much copied document isn't taken for boilerplate. Near copies are documents of their
own, and lines that more of them have than the limit are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, fresh, materialize, table

#: A line is removed when more distinct documents of its host have it than this, and more than this share of the host's.
LIMIT_DOCS, LIMIT_SHARE = 10, 0.01
#: A document is depleted with fewer words than this left, or a smaller share of its words.
LEFT_WORDS, LEFT_SHARE = 20, 0.3
#: Up to so many frequent lines (8 bytes each), and so many of a host, go to all executors at once; more are joined by shuffles.
BROADCAST_LINES, HOST_LINES = 200_000, 2_000

_SPLIT = BLANKS.replace("\\", "\\\\")
_WORDS = f"filter(split({{t}}, '{_SPLIT}'), w -> w != '')"
_LINES = "filter(split({t}, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
#: The key of a line: lower case, blanks squeezed.
_KEY = f"xxhash64(trim(regexp_replace(lower({{l}}), '{_SPLIT}', ' ')))"
#: Words in 8-word windows that the text has twice or more, from h, the hashes of all its windows.
_REPEATS = (
    "transform(array({h}), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE "
    "transform(array(array_sort(zip_with(h, sequence(1, size(h)), (x, i) -> named_struct('x', x, 'i', i)))), o -> "
    "aggregate(array_sort(transform(filter(o, (s, k) -> coalesce(get(o, k - 1).x = s.x, false) OR coalesce(get(o, k + 1).x = s.x, false)), s -> s.i)), "
    "named_struct('c', 0L, 'end', 0), (a, i) -> named_struct('c', a.c + i + 8 - greatest(a.end, i), 'end', i + 8), a -> a.c))[0] END)[0]"
)


def base_stats(text: str) -> str:
    """SQL for a struct of n_words, word_chars, n_repeat_words, n_symbols and n_dup_lines of the column `text`.

    Windows are compared by 64-bit hashes.
    """
    t = f"coalesce({text}, '')"
    windows = "CASE WHEN size(w) < 8 THEN array() ELSE transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8))) END"
    return (
        f"transform(array({_WORDS.format(t=t)}), w -> named_struct('n_words', CAST(size(w) AS BIGINT), 'word_chars', CAST(length(array_join(w, '')) AS BIGINT), "
        f"'n_symbols', CAST(length(regexp_replace({t}, '[^#*$%&|<>]+', '')) AS BIGINT), "
        f"'n_dup_lines', transform(array({_LINES.format(t=t)}), l -> CAST(size(l) - size(array_distinct(l)) AS BIGINT))[0], "
        f"'n_repeat_words', CAST({_REPEATS.format(h=windows)} AS BIGINT)))[0]"
    )


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(host, line): hosts and line hashes above the limits, from all documents."""
    rows = docs.select(F.col(f"`{host}`").alias("host"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).withColumn("print", F.xxhash64("t"))
    texts = rows.groupBy("host", "print").agg(F.count(F.lit(1)).alias("_"))
    totals = texts.groupBy("host").agg(F.greatest(F.lit(float(LIMIT_DOCS)), LIMIT_SHARE * F.count(F.lit(1))).alias("most")).withColumnRenamed("host", "h")
    keys = f"array_distinct(transform({_LINES.format(t='t')}, l -> {_KEY.format(l='l')}))"
    rows = rows.select("host", "print", F.explode(F.expr(keys)).alias("line"))
    counts = rows.groupBy("host", "line", "print").agg(F.count(F.lit(1)).alias("_")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where(F.col("n") > LIMIT_DOCS)  # most pairs end here
    return counts.join(totals, F.col("host").eqNullSafe(F.col("h")) & (F.col("n") > F.col("most"))).select("host", "line")


def quality(docs: DataFrame, host: str = "source", text: str = "text", broadcast_lines: int = BROADCAST_LINES, host_lines: int = HOST_LINES) -> DataFrame:
    """docs with struct columns `stats` (see base_stats) and `verdict`: lines_removed, words_left, base_failed, kept, text.

    verdict.text is the text without the removed lines. A null text has no words and fails; a null host is a host of its
    own; rows that agree stay as many as they are; empty tables give empty results. The names of the new columns get
    underscores in front where docs has them already. Results are the same whether the frequent lines are broadcast, as
    they are up to broadcast_lines in all and host_lines of one host, or joined by host and line.
    """
    spark = docs.sparkSession
    lines = materialize(frequent_lines(docs, host, text), "frequent-lines")
    h, b, s, v = fresh(docs, "_host"), fresh(docs, "_bad"), fresh(docs, "stats"), fresh(docs, "verdict")
    total, most = lines.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if total <= broadcast_lines and most <= host_lines:
        bad = lines.groupBy(F.col("host").alias(h)).agg(F.collect_list("line").alias(b))
        out = docs.join(F.broadcast(bad), F.col(f"`{host}`").eqNullSafe(F.col(h)), "left")
    else:
        p = fresh(docs, "_print")
        own = docs.select(F.col(f"`{host}`").alias(h), F.xxhash64(F.col(f"`{text}`")).alias(p), F.col(f"`{text}`").alias("t"))
        own = own.select(h, p, F.explode(F.expr(f"array_distinct(transform({_LINES.format(t='t')}, l -> {_KEY.format(l='l')}))")).alias("key"))
        bad = own.join(lines, F.col(h).eqNullSafe(F.col("host")) & (F.col("key") == F.col("line"))).groupBy(h, p).agg(F.collect_set("line").alias(b))
        out = docs.join(bad, F.col(f"`{host}`").eqNullSafe(F.col(h)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(p)), "left").drop(p)
    t = f"coalesce(`{text}`, '')"
    keys = f"transform(split({t}, '\\n'), l -> {_KEY.format(l='l')})"
    # without a frequent line, as most documents are, the text stays as it is
    left = (
        f"CASE WHEN {b} IS NULL OR NOT arrays_overlap({keys}, {b}) THEN named_struct('lines', 0L, 'text', `{text}`) ELSE "
        f"transform(array(filter(split({t}, '\\n'), l -> NOT (array_contains({b}, {_KEY.format(l='l')}) AND l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'))), "
        f"x -> named_struct('lines', CAST(size(split({t}, '\\n')) - size(x) AS BIGINT), 'text', array_join(x, '\\n')))[0] END"
    )
    out = out.withColumn(s, F.expr(base_stats(f"`{text}`"))).withColumn(v, F.expr(left))
    n = F.col(s)["n_words"]
    failed = (n < 20) | (100 * F.col(s)["n_repeat_words"] > 30 * n)
    after = F.when(F.col(v)["lines"] == 0, n).otherwise(F.expr(f"CAST(size({_WORDS.format(t=f'coalesce({v}.text, {chr(39)}{chr(39)})')}) AS BIGINT)"))
    kept = ~failed & (after >= LEFT_WORDS) & (after >= LEFT_SHARE * n)
    verdict = F.struct(F.col(v)["lines"].alias("lines_removed"), after.alias("words_left"), failed.alias("base_failed"), kept.alias("kept"), F.col(v)["text"].alias("text"))
    return out.withColumn(v, verdict).drop(h, b)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col("stats")[x].alias(x) for x in names], F.col("verdict")["base_failed"].alias("base_failed"), F.col("verdict")["kept"].alias("kept"), F.col("verdict")["words_left"].alias("words_left"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT id, source, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
bad AS (SELECT c.source, c.key FROM (SELECT source, key, count(DISTINCT t) AS n FROM (SELECT m.source, key, d.t FROM m JOIN d USING (id)) GROUP BY source, key) c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE c.n > 10 AND c.n > 0.01 * h.n),
gone AS (SELECT id, sum(m.n) AS n FROM m JOIN bad ON m.source IS NOT DISTINCT FROM bad.source AND m.key = bad.key GROUP BY id),
dup AS (SELECT id, (count(*) - count(DISTINCT line)) AS n FROM m GROUP BY id),
win AS (SELECT id, i, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT id, x FROM win GROUP BY id, x HAVING count(*) > 1),
rep AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT win.id, unnest(range(i, i + 8)) AS p FROM win JOIN twice ON win.id = twice.id AND win.x = twice.x) GROUP BY id),
a AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(gone.n, 0))::BIGINT AS words_left
  FROM d LEFT JOIN dup USING (id) LEFT JOIN rep USING (id) LEFT JOIN gone USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_left >= 20 AND words_left >= 0.3 * n_words) AS kept, words_left FROM a
"""
