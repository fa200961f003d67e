"""Importance resampling towards a target corpus, features hashed by CRC-32 from a position table.

CRC-32 is linear in its bytes: the checksum of a span is the XOR of one table entry a byte, chosen by
the byte and its distance from the span's end, and of a constant for the span's length. A batch's
one- and two-word spans are therefore hashed together with one gather and one
``bitwise_xor.reduceat``. Spans longer than the table are folded block by block: the running
checksum is moved on by the table's own entries, being four bytes in front of the next block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.words import batches, bound_batches, find_words, spaced
from hazardlake.operators.numbering import numbered

#: Words are runs of digits, letters and bytes of longer characters.
WORD_BYTES = np.zeros(256, dtype=np.uint8)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1

#: Distances from the end that the table holds.
DISTANCES = 64
#: Bytes of spans hashed at once.
SPAN_BYTES = 1 << 20

_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)


def position_table(distances: int = DISTANCES) -> np.ndarray:
    """(distance from the end, byte) -> what the byte adds to a checksum that starts at 0."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(_POLYNOMIAL), first >> 1).astype(np.uint32)
    table = np.empty((distances, 256), dtype=np.uint32)
    table[0] = first
    for d in range(1, distances):  # one more zero byte behind
        table[d] = first[table[d - 1] & 0xFF] ^ (table[d - 1] >> 8)
    return table


def move_on(state: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Checksum states after ``n`` zero bytes, 1 to the table's length."""
    moved = np.zeros_like(state)
    for k in range(4):
        byte = (state >> np.uint32(8 * k)) & np.uint32(0xFF)
        far = n - 1 - k
        moved ^= np.where(far >= 0, table[np.maximum(far, 0), byte], 0).astype(np.uint32)
    rest = np.where(n < 4, state >> np.minimum(8 * n, 31).astype(np.uint32), 0)
    return moved ^ rest.astype(np.uint32)


def length_constants(table: np.ndarray) -> np.ndarray:
    """Checksum of n zero bytes for n from 0 to the table's length: start and final inversion of a checksum."""
    n = np.arange(len(table) + 1)
    start = np.full(len(n), _ONES, dtype=np.uint32)
    return np.where(n == 0, 0, move_on(start, np.maximum(n, 1), table) ^ _ONES).astype(np.uint32)


def linear_parts(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """XOR of the table entries of each span; spans hold 1 to the table's length of bytes and may overlap."""
    after = np.cumsum(sizes)
    begin = after - sizes
    total = int(after[-1])
    within = np.arange(total) - np.repeat(begin, sizes)
    byte = buffer[within + np.repeat(starts, sizes)]
    far = np.repeat(sizes, sizes) - 1 - within
    return np.bitwise_xor.reduceat(table.ravel()[far * 256 + byte], begin)


def crc32_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of every span ``buffer[start:end]``; spans hold at least one byte and may overlap.

    Memory is bounded by ``SPAN_BYTES`` whatever the number and lengths of the spans.
    """
    reach, constants = len(table), length_constants(table)
    sizes = ends - starts
    out = np.empty(len(sizes), dtype=np.uint32)
    short = np.flatnonzero(sizes <= reach)
    places = np.cumsum(sizes[short])
    for part in np.split(short, np.searchsorted(places, np.arange(SPAN_BYTES, places[-1] if len(places) else 0, SPAN_BYTES))):
        if len(part):
            out[part] = linear_parts(buffer, starts[part], sizes[part], table) ^ constants[sizes[part]]
    long = np.flatnonzero(sizes > reach)
    for part in np.split(long, np.arange(SPAN_BYTES // reach, len(long), SPAN_BYTES // reach)):
        state, at = np.full(len(part), _ONES, dtype=np.uint32), starts[part].copy()
        step = (sizes[part] - 1) % reach + 1  # the odd block first, then whole ones
        going = np.arange(len(part))
        while len(going):
            block = linear_parts(buffer, at[going], step[going], table)
            state[going] = move_on(state[going], step[going], table) ^ block
            at[going] += step[going]
            step[:] = reach
            going = going[at[going] < ends[part][going]]
        out[part] = state ^ _ONES
    return out


def features(run: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32, number of the text) of all runs of one and two words of the texts, and each text's words."""
    found = find_words(run, WORD_BYTES)
    buffer, starts, ends = spaced(found, WORD_BYTES)
    pair = np.flatnonzero(found.text[1:] == found.text[:-1])
    hashes = crc32_spans(
        buffer, np.concatenate([starts, starts[pair]]), np.concatenate([ends, ends[pair + 1]]), table
    )
    return hashes, np.concatenate([found.text, found.text[pair]]), np.bincount(found.text, minlength=len(run))


def bucket_counts(texts: DataFrame, n_buckets: int) -> np.ndarray:
    """Features of a whole table by bucket, counted in the tasks first; the driver gets one number a bucket."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = position_table(), np.zeros(n_buckets, dtype=np.int64)
        for batch in parts:
            for _, run_ in batches(batch.column("text")):
                counts += np.bincount(features(run_, table)[0] % np.uint32(n_buckets), minlength=n_buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    summed = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, dtype=np.int64)
    for row in summed.collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed target and raw shares of every bucket, rounded down."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(raw, target)
    ], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs`` with n_words, n_features and weight, the mean gain of a text's features rounded down (0 without any)."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_features", "weight")
    names = [*docs.columns, "n_words", "n_features", "weight"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, value = position_table(), shared.value
        for batch in parts:
            rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, run_ in batches(batch.column("text")):
                hashes, text, words = features(run_, table)
                n = np.bincount(text, minlength=len(run_))
                # Sums of whole numbers are exact in doubles below 2^53.
                total = np.bincount(text, weights=value[hashes % np.uint32(len(value))], minlength=len(run_)).astype(np.int64)
                for column, found in zip(rows, (words, n, total // np.maximum(n, 1))):
                    column.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.concatenate(c).astype(np.int64)) for c in rows)], names)

    return docs.mapInArrow(run, ", ".join([*kinds, "n_words long", "n_features long", "weight long"]))


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = 10_000, percent: int = 25, least_words: int = 20,
             salt: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``: Gumbel top-k towards ``target``'s texts.

    ``score`` is weight plus the Gumbel noise of SHA-256 of ``salt:doc_id``, in thousandths. Of the rows with at least ``least_words``
    words, ``percent`` in a hundred (rounded down) are drawn, the highest scores first and ties by the smaller
    doc_id; their ``rank`` counts from 1, the others have none. A null or empty text has no features and weight 0.
    Rows without doc_id hash the empty text for it and come last among ties; repeated rows are
    drawn as rows. Both tables are counted whole. Without target texts the smoothed uniform model is the target.
    Extra columns are ignored. An empty table gives an empty one.
    """
    gain = gains(bucket_counts(docs, n_buckets), bucket_counts(target, n_buckets))
    weighed = weigh(docs.select("doc_id", "text"), gain).drop("text")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = weighed.withColumns({"score": F.col("weight") + noise, "enough": F.col("n_words") >= least_words})
    # Rows with enough words are a run of their own, so their places are their ranks.
    placed = numbered(scored, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "enough")
    drawn = F.col("enough") & (F.col("place") < F.floor(F.col("of") * percent / 100))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place") + 1).alias("rank"))
