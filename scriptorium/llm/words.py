"""Fast, bounded word handling for Arrow batches, shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words a cache holds before it is emptied; bounds a worker's memory whatever the vocabulary.
CACHE_WORDS = 150_000


class WordHashes(dict):
    """bytes of a word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # a C library that gives memory back by itself
    _TRIM = None


def release() -> None:
    """Give a worker's unused memory back: workers are reused, so what one task leaves behind weighs on the next."""
    HASHES.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(apply: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that leaves no memory behind at the end of its task."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from apply(source)
        finally:
            release()

    return run


def hashes_of(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multiplier of the rolling polynomial over word hashes.
BASE = 0x9E3779B97F4A7C15


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive word hashes, mixed; order matters."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    base = np.uint64(BASE)
    for i in range(width):
        total *= base
        total += words[i : i + n]
    return mixed(total)


def batches(source: Iterator[pa.RecordBatch], limit: int, size: str = "text") -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about ``limit`` bytes of one column, so that memory stays bounded."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in source:
        step = max(1, int(batch.num_rows * limit / max(1, batch.column(size).nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            total += part.column(size).nbytes
            if total >= limit:
                yield pa.Table.from_batches(held)
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)
