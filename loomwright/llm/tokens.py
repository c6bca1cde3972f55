"""Token IDs in Arrow stream files (operator 1).

Documents are ranged by doc_id; each range becomes one shard. A shard is two files in Arrow's stream format:
`<shard>.arrows` holds the packed ids of its documents, each followed by the end id, as batches of equal-length
sequences (fixed-size lists) with a mask that is false on the padding at the shard's end; `<shard>.docs.arrows` holds
doc_id, start and n_tokens within the shard. Mapped into memory, sequences are read without copying, and all batches but
the last have the same number of them, so that a sequence's place follows from its number.

Text is encoded in pieces that end where a run of blanks starts: byte-level pre-tokenisation always splits there, so a
piece has the same ids wherever it stands, and equal pieces are encoded once. Texts with other white space than ASCII
are encoded whole. Any tokenizers file whose pre-tokeniser is byte-level with its own pattern and that has no normaliser
can be used; for others, whole texts are encoded.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import flat, slices, tidy
from .common import local_path, new_path, table

SEQUENCE, PER_BATCH = 2048, 256
#: Pieces kept with their ids in each of a worker's two generations (about 180 bytes each), and the longest that is kept.
CACHE, CACHED_BYTES = 200_000, 48
#: Bytes of text that are encoded at once.
AT_ONCE = 4 << 20
#: A piece of at most one line feed, one word of Latin letters with at most one blank before it, and marks: byte-level
#: pre-tokenisation splits it into just these parts.
_SIMPLE = re.compile(r"(\n?)( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([.,;:!?]*)")
#: White space beyond ASCII, and the ASCII control characters that some patterns count as white space.
_OTHER_SPACE = "[\x1c-\x1f\x85\xa0  -     　]"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ENCODERS: dict[tuple[int, bool], Encoder] = {}


class Encoder:
    """Ids of whole texts, as flat numpy arrays."""

    def __init__(self, spec: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = plain
        pre, rest = json.loads(spec).get("pre_tokenizer") or {}, json.loads(spec)
        self.pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not rest.get("normalizer")
        # added tokens are found within a piece, unless they have blanks or take those around them
        self.pieces = self.pieces and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in rest.get("added_tokens", []))
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.code = "H" if self.dtype == np.uint16 else "I"
        model = rest.get("model") or {}
        # a BPE model alone, on the bytes' stand-ins, encodes what pre-tokenisation leaves whole
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.model = self.tok.model if plain and not any(t["content"].isalpha() for t in rest.get("added_tokens", [])) else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.signs = dict(zip(shown, shown, strict=True)) | {b: 256 + i for i, b in enumerate(hidden)}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        key = part.encode()
        got = self.new.get(key) or self.old.get(key)
        if got is None:
            got = array(self.code, [t.id for t in self.model.tokenize(key.decode("latin-1").translate(self.signs))]).tobytes()
            if len(key) <= CACHED_BYTES:
                self.new[key] = got
        return got

    def _lookup(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; new ones are kept."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old, got, hard = self.new, self.old, [None] * len(pieces), []
        for i, p in enumerate(pieces):
            x = new.get(p)
            if x is None:
                x = old.get(p)
                if x is None:
                    m = self.model and _SIMPLE.fullmatch(p.decode())
                    if not m:
                        hard.append(i)
                        continue
                    a, b, c = m.groups()
                    x = (self._part(a) if a else b"") + self._part(b) + (self._part(c) if c else b"")
                if len(p) <= CACHED_BYTES:
                    new[p] = x
            got[i] = x
        for i, x in zip(hard, self._ids([pieces[i].decode() for i in hard]), strict=True):
            got[i] = x
            if len(pieces[i]) <= CACHED_BYTES:
                new[pieces[i]] = x
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts together and where each text's ids end."""
        whole = pc.fill_null(pc.match_substring_regex(texts, _OTHER_SPACE), False).to_numpy(zero_copy_only=False) if self.pieces else np.ones(len(texts), bool)
        if whole.any():
            ids = [np.zeros(0, self.dtype)] * len(texts)
            for i in np.flatnonzero(whole):
                ids[i] = np.frombuffer(self._ids([texts[int(i)].as_py() or ""])[0], self.dtype)
            rest = np.flatnonzero(~whole)
            got, ends = self._pieces(texts.take(pa.array(rest))) if len(rest) else (None, [])
            for k, i in enumerate(rest):
                ids[i] = got[ends[k - 1] if k else 0 : ends[k]]
            return np.concatenate([*ids, np.zeros(0, self.dtype)]), np.cumsum([len(x) for x in ids])
        return self._pieces(texts)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets, buffer = flat(texts)
        blank = _BLANK[data]
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.flatnonzero(first)
        bounds = np.append(at, len(data)).astype(np.int64)
        codes = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), buffer]).dictionary_encode()
        got = self._lookup(codes.dictionary.to_pylist())
        width = np.dtype(self.dtype).itemsize
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // width
        ids = np.frombuffer(b"".join(got), self.dtype)
        starts = np.cumsum(lengths) - lengths
        which = codes.indices.to_numpy()
        n = lengths[which]
        ends = np.cumsum(n)
        out = ids[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.searchsorted(at, offsets[1:])  # pieces up to each text's end
        return out, np.append(0, ends)[last]


def encoder(spec, plain: bool = False) -> Encoder:
    """The worker's encoder for a broadcast specification, with its cache."""
    if (spec.id, plain) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec.id, plain] = Encoder(spec.value, plain)
    return _ENCODERS[spec.id, plain]


class _Held:
    """A broadcast value with an id that workers know it by."""

    def __init__(self, spark: SparkSession, value: str):
        self.broadcast, self.id = spark.sparkContext.broadcast(value), zlib.crc32(value.encode())

    @property
    def value(self) -> str:
        return self.broadcast.value


def _open(path: str, write: bool):
    if (p := local_path(path)) is not None:
        if write:
            pafs.LocalFileSystem().create_dir(p.rpartition("/")[0])
            return pa.OSFile(p, "wb")
        return pa.memory_map(p)
    store, p = pafs.FileSystem.from_uri(path)
    return store.open_output_stream(p) if write else store.open_input_file(p)


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, sequence: int = SEQUENCE, end: int = 0, plain: bool = False) -> list[tuple[int, str, int]]:
    """Writes docs (doc_id, text) into `folder`, which all executors must see; returns (shard, path, tokens) in order.

    Null and empty texts have the end id alone; null doc_ids come first; documents with equal doc_ids are ordered by a hash
    of their text, and rows that agree in both are dealt over several ranges; other columns are ignored; an empty table
    gives no shard. plain: strings of special tokens in a text are ordinary text; otherwise they become the special ids, as
    the tokenizers library has it. docs is read twice, so it should be a table. What comes back is one small row for each shard. A lost executor's shards are written again
    under names of their own attempt.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = _Held(spark, f.read())

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, enc = TaskContext.get(), encoder(spec, plain)
        path = f"{folder}/shard-{ctx.partitionId():07d}-{ctx.taskAttemptId()}"
        item = pa.from_numpy_dtype(enc.dtype)
        schema = pa.schema([("tokens", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        out = index = None
        held, total, size = [np.zeros(0, enc.dtype)], 0, sequence * PER_BATCH
        count = 0

        def put(ids: np.ndarray) -> None:
            rows = -(-len(ids) // sequence)
            mask = np.arange(rows * sequence) < len(ids)
            ids = np.pad(ids, (0, rows * sequence - len(ids)))
            out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), sequence), pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence)], schema=schema))

        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id")
            for a, b in slices(texts, AT_ONCE):
                if out is None:
                    sinks = [_open(f"{path}{x}", True) for x in (".arrows", ".docs.arrows")]
                    out, index = pa.ipc.new_stream(sinks[0], schema), pa.ipc.new_stream(sinks[1], _DOCS)
                ids, ends = enc.encode(texts.slice(a, b - a))
                ids = np.insert(ids, ends, end)
                n = np.diff(ends, prepend=0) + 1
                index.write_batch(pa.record_batch([names.slice(a, b - a), pa.array(total + np.cumsum(n) - n), pa.array(n)], schema=_DOCS))
                total += len(ids)
                held.append(ids)
                count += len(ids)
                if count >= size:
                    ready = np.concatenate(held)
                    for k in range(0, count - count % size, size):
                        put(ready[k : k + size])
                    held, count = [ready[count - count % size :].copy()], count % size
        if out is not None:
            if count:
                put(np.concatenate(held))
            for x in (out, index, *sinks):
                x.close()
            yield pa.record_batch({"shard": pa.array([ctx.partitionId()], pa.int32()), "path": [path], "tokens": pa.array([total], pa.int64())})

    order = [F.col("doc_id").asc_nulls_first(), F.col("print"), F.col("row")]
    ranged = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"print": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return sorted(tuple(r) for r in ranged.mapInArrow(write, "shard int, path string, tokens bigint").collect())


class Sequences:
    """Random access to the sequences of one shard: a memory map of its file, from which nothing is copied.

    Batches have the same number of sequences, but for the last, so that number k is in batch k // (batch size).
    """

    def __init__(self, path: str):
        with pa.ipc.open_stream(_open(f"{path}.arrows", False)) as stream:
            self.batches = list(stream)  # headers alone are read from a memory map

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of sequence k: views of the file."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        batch, row = divmod(k, self.batches[0].num_rows)
        tokens, mask = (self.batches[batch].column(c) for c in ("tokens", "mask"))
        width = tokens.type.list_size
        return tokens.values.slice(row * width, width).to_numpy(zero_copy_only=True), mask.values.slice(row * width, width)


def read_token_files(spark: SparkSession, shards: list[tuple[int, str, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, all of them read from the shards' files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                tokens, docs = pa.ipc.open_stream(_open(f"{path}.arrows", False)), pa.ipc.open_stream(_open(f"{path}.docs.arrows", False))
                now, at = np.zeros(0, np.uint32), 0
                for d in docs:
                    sums = []
                    for n in d.column("n_tokens").to_pylist():
                        crc = 0
                        while n:
                            if at == len(now):
                                b = next(tokens)
                                ids, mask = b.column("tokens").flatten().to_numpy(), b.column("mask").flatten().to_numpy(zero_copy_only=False)
                                now, at = ids[mask].astype("<u4"), 0
                            k = min(n, len(now) - at)
                            crc = zlib.crc32(now[at : at + k].data, crc)
                            at, n = at + k, n - k
                        sums.append(crc)
                    yield pa.record_batch({"doc_id": d.column("doc_id"), "start": pc.add(d.column("start"), base), "n_tokens": d.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64())})

    rows, base = [], 0
    for shard, path, n in shards:
        rows.append((shard, path, base))
        base += n
    places = spark.createDataFrame(rows, "shard int, path string, base bigint").repartition(max(1, len(rows)))
    return places.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs in the shared folder's files and reads them back; no tokenizer: byte_bpe_50k.json."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, str(tokenizer), new_path(spark, "tokens")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
