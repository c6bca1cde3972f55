"""Secret scans (operator 4): fixed patterns, and strings that a public vocabulary encodes badly.

A random string gives few characters for each token of a tiktoken vocabulary; prose, names and paths give many. Known
digests (by their length in hex), UUIDs and plain numbers are left out first.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: The same matches as AKIA[A-Z0-9]+ of 18 characters or more and [0-9a-f]+ of 16 or more.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
#: What may be a random string: 20 characters or more, with a digit and a letter.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}")
#: At most so many characters for each token.
RATIO = 1.9
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hex.
DIGESTS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(rf"(?:{'|'.join(rf'[0-9a-fA-F]{{{n}}}' for n in DIGESTS)})\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_CODERS: dict[str, object] = {}


def coder(ranks: str):
    """The worker's tiktoken coder for the lines of a ranks file; the last file's is kept."""
    if ranks not in _CODERS:
        import public_tokenizers
        import tiktoken

        _CODERS.clear()
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _CODERS[ranks] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return _CODERS[ranks]


def find(text: str, coder) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, in order; kinds are numbered as in KINDS."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if _DIGEST.match(s) or _UUID.match(s) or any(a < m.end() and m.start() < b for a, _, b in spans):
            continue
        if len(s) <= RATIO * len(coder.encode_ordinary(s)):
            more.append((m.start(), 3, m.end()))
    return sorted(spans + more)


def secret_spans(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of each document.

    spans joins kind:start:end in code points, by start; of spans that start together, kinds go as listed in KINDS. Null
    texts are empty and have none; equal rows stay as many as they are; other columns are ignored; whole texts are
    searched, in one pass without a shuffle. ranks: a file of tiktoken ranks.
    """
    if ranks is None:
        import public_tokenizers

        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(ranks, encoding="ascii") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(lines.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = find(text.as_py() or "", enc)
                base = [x for x in found if x[1] < 3]
                say = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in xs)
                rows.append([sum(k == n for _, k, _ in found) for n in range(4)] + [hashlib.sha256(say(base).encode()).hexdigest(), say(found)])
            cols = list(zip(*rows, strict=True)) or [()] * 6
            ints = [pa.array(cols[i], pa.int64()) for i in range(4)]
            yield pa.record_batch([batch.column("doc_id"), *ints[:3], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), ints[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(
        scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint"
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))
