"""Text columns of Arrow batches as flat numpy arrays, for the operators that work in Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer]:
    """(bytes, offsets, buffer): the UTF-8 bytes of all texts together and where each starts; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count or texts.offset:
        texts = pa.concat_arrays([texts.fill_null("")])
        texts = pa.array(texts) if texts.offset else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) and texts.buffers()[2] is not None else pa.py_buffer(b"")
    data = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return np.frombuffer(data, np.uint8), offsets - offsets[0], data


def slices(texts: pa.Array, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of `rows` rows at most that have `most` bytes together at most; a longer text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))) if len(texts) else np.zeros(0)
    a = 0
    while a < len(texts):
        b = min(a + rows, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right"))))
        yield a, b
        a = b


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for mapInArrow, with memory given back before it starts and when it ends: workers live on idle."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    """Gives memory that earlier tasks of this worker have freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass
