"""Rows that agree, hot keys, long texts and files of the corpus operators."""

import collections

import numpy as np

from loomwright.llm import langid, mixing, quality, secrets, sharding, tokens, toxicity

from ..compare import SF


def test_mix_keeps_rows_that_differ_in_other_columns(spark):
    rows = [(1, "a b c", "s", f"x{i}") for i in range(50)] + [(None, "d e", None, f"y{i}") for i in range(30)] + [(2, None, "s", "z"), (3, "", "t", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _row string").repartition(7)
    got = collections.Counter(tuple(r) for r in mixing.mix(docs).collect())
    plan = mixing.mix_plan(docs).collect()
    assert sum(got.values()) == sum(r["times"] for r in plan) and set(got) <= set(rows) and max(got.values()) <= 2
    assert len([r for r in got if r[0] == 1]) == sum(r["times"] > 0 for r in plan if r["doc_id"] == 1)


def test_shards_of_a_hot_key(spark):
    rows = [(None, "x" * (i % 40)) for i in range(300)] + [(7, "same")] * 200 + [(i, "t") for i in range(100)]
    out = sharding.shard_slots(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).collect()
    assert len(out) == len(rows)
    for shard in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))


def test_special_tokens_and_random_access(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|>b", "x  <|endoftext|>  y\n", "<|endoftext|>", "<|endof text|>", "long " * 3000, "", None, "w" * 100_000] + ["one two three"] * 20
    for plain in (False, True):
        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = plain
        want = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        shards = tokens.write_token_files(docs, path, f"file://{tmp_path}/{plain}", sequence=16, plain=plain)
        all_ids = np.concatenate([np.concatenate(want)])
        got, place = [], 0
        for _, file, n in shards:
            s = tokens.Sequences(file)
            for k in reversed(range(len(s))):  # in any order
                ids, mask = s[k]
                real = all_ids[place + 16 * k : place + min(n, 16 * (k + 1))]
                assert mask.to_pylist() == [i < len(real) for i in range(16)] and ids[: len(real)].tolist() == real.tolist()
                assert not ids.flags.owndata
            place += n
            got.append(n)
        assert sum(got) == len(all_ids)
        back = tokens.read_token_files(spark, shards).orderBy("start").collect()
        assert [r["n_tokens"] for r in back] == [len(x) for x in want]


def test_rejection(spark):
    """Few texts of the learned kinds are rejected, and texts of letters in another order are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])).select("doc_id", "text", "lang"))
    long = docs.where("length(text) > 200")
    rejected = [r["rejected"] for r in langid.identify(long, model).where("held_out").collect()]
    foreign = spark.createDataFrame([(i, "жзкл мнпр стфх цчшщ " * 20) for i in range(5)] + [(9, "zqxj kvwq xzzj qqkx " * 20)], "doc_id bigint, text string")
    assert rejected and np.mean(rejected) < 0.1 and all(r["rejected"] for r in langid.identify(foreign, model).collect())


def test_one_letter_texts_by_the_thousand():
    c, lettered = langid.counts(["ab"] * langid.ROWS)
    assert c.shape == (langid.ROWS, langid.BUCKETS) and lettered.all()


def test_coders_of_two_files():
    import public_tokenizers

    a, b = (open(public_tokenizers.path(x)).read() for x in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"))
    text = "internationalization 日本語"
    assert secrets.coder(a).encode_ordinary(text) != secrets.coder(b).encode_ordinary(text)
    assert secrets.coder(a).encode_ordinary(text) == secrets.coder(a).encode_ordinary(text)


def test_random_strings_are_told_from_words(spark):
    """Precision and recall of the strings found by tokens alone, on a seeded fixture."""
    import public_tokenizers

    coder = secrets.coder(open(public_tokenizers.path("byte_bpe_50k.tiktoken")).read())
    rng = np.random.default_rng(2)
    chars = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = ["".join(rng.choice(chars, 32)) for _ in range(200)]
    words = ["value", "config", "source", "window", "Default", "Memory", "string", "length", "table", "column"]
    names = ["".join(rng.choice(words, 4)) + str(rng.integers(10, 99)) for _ in range(200)]
    found = lambda s: any(k == 3 for _, k, _ in secrets.find(f"x {s} y", coder))
    assert np.mean([found(k) for k in keys]) > 0.95 and np.mean([found(k) for k in names]) < 0.05


def test_labels_that_disagree_and_copies(spark):
    """Refits agree, whatever the order of the rows; copies of a text go to one fold."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["bad", "vile", "nice", "good", "calm", "tree"], 12))) for i in range(300)]
    labels = [(i, int(i % 3 > 0), int("bad" in t and "vile" in t)) for i, t in rows] + [(i, 1, 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    schema = "doc_id bigint, quality int, toxic int"
    a, b = (sorted(map(tuple, toxicity.toxicity(d, spark.createDataFrame(x, schema), toxicity.CATEGORIES).collect())) for d, x in ((docs, labels), (docs.repartition(5), labels[::-1])))
    assert np.allclose(np.array(a), np.array(b))


def test_frequent_lines_broadcast_or_joined(spark):
    """The same rows, whichever way the frequent lines get to the documents; null hosts and odd names among them."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(25)) + f"\nShared  LINE {i % 3}\nshared line {i % 3}\n", ["a", None, "b"][i % 3], "z") for i in range(60)]
    rows += [(1, None, "a", "z"), (None, "", None, "z"), (2, "x " * 50_000, "b", "z"), (2, "x " * 50_000, "b", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, `_host.x` string")
    a, b, c = (collections.Counter(map(str, quality.quality(docs, broadcast_lines=x, host_lines=y).collect())) for x, y in ((1000, 1000), (0, 1000), (1000, 0)))
    assert a == b == c and sum(a.values()) == len(rows) and any("lines_removed=2" in r for r in a)
