"""Every stage of the pipeline against a plain version of it, on a small fixture."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loomwright.llm import mixing

from .test_decontam import plain
from .test_llm import brute_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fixture():
    rng = np.random.default_rng(12)
    say = lambda n, g: " ".join(f"{g}{rng.integers(10_000)}" for _ in range(n))
    items = [(i, say(20, "q")) for i in range(5)]
    rows = []
    for i in range(90):
        text = say(int(rng.integers(15, 90)), "w")
        if i % 3 == 0:
            text += "\nSee  https://example.org/terms-of-use-of-a-very-long-address\n" + say(5, "v")
        if i % 10 == 1:
            text += " " + items[i % 5][1]
        if i % 7 == 2:
            text = say(4, "r") + " " + " ".join(["again and again we say the same words here"] * 6)
        rows.append((i, text))
    rows += [(100 + i, rows[4][1] + f" {i}") for i in range(6)] + [(120, rows[5][1]), (120, rows[5][1]), (None, rows[8][1] + " z"), (None, say(40, "n")), (None, None), (130, ""), (131, " \n")]
    rows = [(d, t, None if k % 5 else "en", ["a", "b", None, "c"][k % 4] if k % 2 else "hot", len(t or "")) for k, (d, t) in enumerate(rows)]
    return rows, items


def quality(rows):
    line = lambda x: " ".join(WORDS.findall(x.lower()))
    texts, lines = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, _, host, _ in rows:
        texts[host].add(t or "")
        for x in (t or "").split("\n"):
            if line(x):
                lines[host, line(x)].add(t or "")
    bad = {k for k, v in lines.items() if len(v) > 10 and len(v) > 0.01 * len(texts[k[0]])}
    out = []
    for d, t, lang, host, n in rows:
        w = WORDS.findall(t or "")
        windows = collections.defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        twice = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        left = [x for x in (t or "").split("\n") if (host, line(x)) not in bad]
        new = "\n".join(left)
        k = len(WORDS.findall(new))
        if len(w) >= 20 and 100 * len(twice) <= 30 * len(w) and k >= 20 and k >= 0.3 * len(w):
            out.append((d, new, lang, host, n if new == t else len(new)))
    return out


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_each_stage(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, rows):
        return [tuple(r) for r in stages[name](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()]

    kept = run("quality rules", rows)
    assert bag(kept) == bag(quality(rows)) and 20 < len(kept) < len(rows)
    assert any(t != dict((r[0], r[1]) for r in rows).get(d) for d, t, *_ in kept if d is not None)

    groups = collections.defaultdict(list)
    for i, (_, c) in brute_components({i: r[1] for i, r in enumerate(kept)}).items():
        groups[c].append(kept[i])
    near = run("near copies", kept)
    assert len(near) == len(groups) < len(kept) and not bag(near) - bag(kept)
    for g in groups.values():
        least = min(((r[0] is None, r[0]) for r in g))[1]
        assert sum(r in near and r[0] == least for r in set(g)) == 1

    clean = run("decontamination", near)
    want = [r for r in near for n, hit, _ in [plain(r[1], items)] if not (hit > 0 and 20 * hit >= n)]
    assert bag(clean) == bag(want) and len(clean) < len(near)

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in clean]))
    plan = con.sql(f"SELECT doc_id, size, sum(taken) FROM ({mixing.ORACLE}) GROUP BY ALL").fetchall()
    mixed = run("source mixing", clean)
    got = collections.Counter((r[0], len(WORDS.findall(r[1]))) for r in mixed)
    assert got == {(d, n): taken // n for d, n, taken in plan if taken} and not set(mixed) - set(clean)

    from tokenizers import Tokenizer
    import public_tokenizers

    tok, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    done = run("token output", mixed)
    by = collections.defaultdict(list)
    for d, t, *_ in mixed:
        by[d].append(np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4"))
    for d in sorted(by, key=lambda d: (d is not None, d)):
        want += [(d, len(x), zlib.crc32(x.tobytes())) for x in by[d]]
    assert bag((d, n, c) for d, _, n, c in done) == bag(want)
    for _, s, n, _ in sorted(done, key=lambda r: r[1]):
        assert s == start
        start += n


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, tmp_path, stage):
    """Columns with the names that operators use for themselves pass through."""
    spark.createDataFrame([(1, "q1 q2 q3")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ["stats", "verdict", "contamination", "_key", "_c", "_d", "_row", "_at", "size", "print", "bucket", "key", "rank", "c", "n"]
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), None, "s", 0, *[f"{x}{i}" for x in extra]) for i in (1, 2, 3, 3)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {x} string" for x in extra))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    got = {tuple(r) for r in out.collect()}
    assert out.columns == docs.columns and got <= set(rows) and (stage == "source mixing" or got == set(rows))


def test_decontamination_in_small_batches(spark, tmp_path, monkeypatch):
    """The stage's rows have gone through small Arrow batches by the time it returns; the session's setting is as before."""
    bench = [(1, "x y z")]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = lambda batches: (b.set_column(0, "doc_id", pa.array([b.num_rows] * b.num_rows, pa.int64())) for b in batches)
    monkeypatch.setattr(corpus_pipeline, "decontaminate", lambda docs, bench: docs.mapInArrow(sizes, docs.schema))
    setting = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = corpus_pipeline.decontamination(spark, spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text"), str(tmp_path))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == setting
    rows = out.collect()
    assert len({r["text"] for r in rows}) == len(rows) == 3000 and max(r["doc_id"] for r in rows) <= 1000
