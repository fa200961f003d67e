"""Vectorised word and n-gram hashing of whole texts, for use inside tasks.

A batch of texts is joined into one byte buffer. A word's hash is taken from running sums
of a polynomial over that buffer, so the cost is a few array passes and no loop over words.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text hashed at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 18

#: Rows of a batch that travels between Spark and Python.
BATCH_ROWS = 2000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ORDER = np.uint64(0xD6E8FEB86659FD93)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAPS = [0x20, *range(0x09, 0x0E)]

#: Byte classes: words are runs of one class; 0 lies between words.
SPACED = np.ones(256, dtype=np.uint8)
SPACED[_GAPS] = 0
#: Letters, digits and bytes of longer characters on one side, other marks on the other.
PUNCTUATED = np.array([1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)
PUNCTUATED[_GAPS] = 0


def _store() -> dict:
    """Tables of this worker process by owner."""
    module = sys.modules.setdefault("_hazardlake_kept", types.ModuleType("_hazardlake_kept"))
    return vars(module).setdefault("tables", {})


def give_back() -> None:
    """Return memory that is free but held by the allocators of this worker process, which lives on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def claim(owner: str) -> None:
    """Drop the tables that other operators have left in this worker process, and give their memory back."""
    store = _store()
    others = [k for k in store if k not in (owner, "shared")]
    for name in others:
        del store[name]
    if others:
        gc.collect()
        give_back()


def kept(owner: str, name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once per worker process and kept until another owner claims it.

    Functions arrive anew with every task, and what they hold is freed only when Python looks
    for cycles; large tables are kept here instead of piling up.
    """
    claim(owner)
    mine = _store().setdefault(owner, {})
    if name not in mine:
        mine[name] = make()
    return mine[name]


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Arrow batches of this session hold at most ``rows`` rows; texts make rows wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. n-1`` modulo 2^64, kept for texts of usual length."""

    def table(size: int) -> np.ndarray:
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        return np.multiply.accumulate(known, out=known)

    usual = 2 * BATCH_BYTES
    if n > usual:
        return table(n)
    mine = _store().setdefault("shared", {})
    if base not in mine:
        mine[base] = table(usual)
    return mine[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def batches(texts: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    """(Number of the first text, UTF-8 texts) in runs of about ``BATCH_BYTES``; null is empty."""
    first, size, run = 0, 0, []
    for at in range(0, len(texts), rows):
        for i, text in enumerate(texts.slice(at, rows).cast(pa.binary()).to_pylist(), at):
            data = text or b""
            if run and size + len(data) > BATCH_BYTES:
                yield first, run
                first, size, run = i, 0, []
            run.append(data)
            size += len(data) + 1
    if run:
        yield first, run


class Words(NamedTuple):
    """Words of a run of texts: hash, number of the text, and place in the buffer."""

    hashes: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    buffer: np.ndarray


def find_words(run: Sequence[bytes], classes: np.ndarray = SPACED, lower: bool = True) -> Words:
    """The words of all texts in order: maximal runs of bytes of one class other than 0.

    By default words are runs outside 0x20 and 0x09-0x0D, and letters A-Z are lower-cased.
    """
    data = b" ".join(run) + b" "
    buffer = np.frombuffer(data.translate(_LOWER) if lower else data, dtype=np.uint8)
    ends_of_text = np.cumsum([len(x) + 1 for x in run])
    kind = classes[buffer]
    bounds = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True])))
    inside = kind[bounds[:-1]] != 0
    starts, ends = bounds[:-1][inside], bounds[1:][inside]
    n = len(buffer)
    running = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=running[1:])
    raw = (running[ends] - running[starts]) * powers(_BASE_INVERSE, n)[starts]
    text = np.searchsorted(ends_of_text, starts, side="right")
    return Words(mix(raw + (ends - starts).astype(np.uint64)), text, starts, ends, buffer)


def spaced(found: Words, classes: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of ``find_words`` in a buffer of their own with one space between two, and their starts and ends there."""
    ends = np.cumsum(found.ends - found.starts + 1) - 1
    starts = ends - (found.ends - found.starts)
    buffer = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, dtype=np.uint8)
    inside = np.ones(len(buffer), dtype=bool)
    inside[ends] = False
    buffer[inside] = found.buffer[classes[found.buffer] != 0]
    return buffer, starts, ends


def word_hashes(run: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of the text of each."""
    found = find_words(run)
    return found.hashes, found.text


def shingles(run: Sequence[bytes], n: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``n``-word shingles.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    words, text = word_hashes(run)
    bounds = np.searchsorted(text, np.arange(len(run) + 1))
    weights = powers(_ORDER, n)
    total = len(words) - n + 1
    if total > 0:
        grams = np.zeros(total, dtype=np.uint64)
        for j in range(n):
            grams += words[j : j + total] * weights[j]
        grams = mix(grams)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            whole = (words[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mix(np.array([whole], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)
