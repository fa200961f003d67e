"""SimHash near-duplicates by anchor points of a covering code.

The 64 bits are cut into segments, and a segment into parts of 23, 7 and single bits. Codewords of the
perfect Golay code, the perfect Hamming code and all words of the single bits are the anchors of the
parts: every word lies within radius 3, 1 and 0 of exactly one. Two fingerprints that differ in
at most ``distance`` bits differ in at most ``distance / segments`` bits of one segment; a word half-way between
them there is covered by an anchor, from which both are at most half that number of bits beyond the radii. So each
fingerprint is replicated to all anchors within covering radius plus that half, and fingerprints are
compared where they share an anchor. No link is missed and none is guessed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.components import components
from hazardlake.llm.words import batches, bound_batches, find_words, spaced
from hazardlake.session import discard, materialize

#: Shingles hashed at once.
CHUNK = 1 << 15
#: Replicas that one task compares at a time.
TASK_ROWS = 400_000
#: Replicas of one anchor that one task compares; more are dealt into blocks, compared two by two.
BLOCK_ROWS = 10_000
#: Documents with one fingerprint that go through an ordinary join.
HOT_ROWS = 1_000_000
#: Anchors with more than ``BLOCK_ROWS`` replicas may be broadcast up to this many.
BROADCAST_ANCHORS = 200_000

_GOLAY = 0b101011100011


def shingle_spans(run: list[bytes], n: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Text with single spaces, and start, end and text number of every ``n``-word shingle, texts in order."""
    found = find_words(run)
    buffer, starts, ends = spaced(found)
    count = np.bincount(found.text, minlength=len(run))
    first = np.cumsum(count) - count
    full = np.flatnonzero(found.text[n - 1 :] == found.text[: len(found.text) - n + 1]) if len(found.text) >= n else np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < n))
    begin = np.concatenate([starts[full], starts[first[few]]])
    end = np.concatenate([ends[full + n - 1], ends[first[few] + count[few] - 1]])
    owner = np.concatenate([found.text[full], few])
    order = np.argsort(owner, kind="stable")
    return buffer.tobytes(), begin[order], end[order], owner[order]


def fingerprints(run: list[bytes], n: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of every text: a bit is 1 if it is in more than half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest as digest

    data, begin, end, owner = shingle_spans(run, n)
    ones = np.zeros((len(run), 64), dtype=np.int64)
    for at in range(0, len(owner), CHUNK):
        mine = owner[at : at + CHUNK]
        spans = zip(begin[at : at + CHUNK].tolist(), end[at : at + CHUNK].tolist())
        hashes = np.fromiter((digest(data[a:b], seed) for a, b in spans), dtype="<u8", count=len(mine))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        turns = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        ones[mine[turns]] += np.add.reduceat(bits, turns, axis=0, dtype=np.int64)
    total = np.bincount(owner, minlength=len(run))
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<i8").ravel()


class Part(NamedTuple):
    """A linear covering code on ``bits`` bits; ``columns`` is the syndrome of each bit."""

    bits: int
    radius: int
    columns: list[int]


def parts_of(bits: int) -> list[Part]:
    """Golay codes on 23 bits, then Hamming codes on 7, then all words of what is left."""
    golay, x = [], 1
    for _ in range(23):
        golay.append(x)
        x = x << 1 ^ (_GOLAY if x & 1 << 10 else 0)
    many, rest = divmod(bits, 23)
    some, rest = divmod(rest, 7)
    return [Part(23, 3, golay)] * many + [Part(7, 1, list(range(1, 8)))] * some + [Part(rest, 0, [0] * rest)] * (rest > 0)


def errors(part: Part, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """Differences from words to codewords ``beyond`` bits outside the radius (0: all inside), by syndrome.

    Returns the differences, those of a syndrome together, and where each syndrome's begin.
    """
    weights = range(part.radius + 1) if beyond == 0 else [part.radius + beyond]
    masks, syndromes = [], []
    for weight in weights:
        for bits in combinations(range(part.bits), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= part.columns[b]
            masks.append(sum(1 << b for b in bits))
            syndromes.append(syndrome)
    size = 1 << max(part.columns).bit_length()
    order = np.argsort(syndromes, kind="stable")
    starts = np.searchsorted(np.array(syndromes)[order], np.arange(size + 1))
    return np.array(masks, dtype=np.int64)[order], starts


class Cover:
    """The anchors of all segments of 64-bit words."""

    def __init__(self, distance: int, segments: int):
        self.bits = 64 // segments
        self.parts = parts_of(self.bits)
        self.beyond = (distance // segments + 1) // 2
        self.errors = [[errors(p, e) for e in range(self.beyond + 1)] for p in self.parts]
        self.ways = [w for w in product(range(self.beyond + 1), repeat=len(self.parts)) if sum(w) <= self.beyond]
        self.segments = segments

    def anchors(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(segment, row, codeword) of all anchors within covering radius plus the threshold of each word."""
        for segment in range(self.segments):
            word = words >> np.uint64(segment * self.bits)
            syndromes, shift = [], 0
            for part in self.parts:
                found = np.zeros(len(words), dtype=np.int64)
                for b, column in enumerate(part.columns):
                    found ^= (word >> np.uint64(shift + b) & np.uint64(1)).astype(np.int64) * column
                syndromes.append(found)
                shift += part.bits
            low = word & np.uint64((1 << self.bits) - 1)
            for way in self.ways:
                row, mask, shift = np.arange(len(words)), np.zeros(len(words), dtype=np.uint64), 0
                for part, syndrome, known, beyond in zip(self.parts, syndromes, self.errors, way):
                    masks, starts = known[beyond]
                    at = starts[syndrome[row]]
                    size = starts[syndrome[row] + 1] - at
                    after = np.cumsum(size)
                    here = np.arange(after[-1] if len(after) else 0) + np.repeat(at - after + size, size)
                    row = np.repeat(row, size)
                    mask = np.repeat(mask, size) | masks[here].astype(np.uint64) << np.uint64(shift)
                    shift += part.bits
                yield segment, row, low[row] ^ mask


def join_near(anchor: np.ndarray, word: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (word, smallest linked word) that hold together what links within runs of equal anchors hold.

    Each two words of a run are compared, the ones next to each other first; words already held
    together give no further star.
    """
    order = np.lexsort((word, anchor))
    anchor, word = anchor[order], word[order]
    unique, which = np.unique(word, return_inverse=True)
    label = np.arange(len(unique))
    end = np.searchsorted(anchor, anchor, side="right")
    at, lag = np.arange(len(word)), 1
    while True:
        at = at[at + lag < end[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(word[at] ^ word[at + lag]) <= distance]
        a, b = which[near], which[near + lag]
        while True:
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low != high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, high[apart], low[apart])
            while (further := label[label]).tobytes() != label.tobytes():
                label = further
        lag += 1
    moved = label != np.arange(len(unique))
    return unique[moved], unique[label[moved]]


def near_links(words: DataFrame, distance: int = 4, segments: int = 2) -> DataFrame:
    """(a, b): stars that connect exactly those distinct 64-bit ``word``s that links of ``distance`` bits connect.

    A hot anchor's replicas are dealt into blocks and every two blocks meet in a task of their own, so no anchor is too large
    for a task and none is cut short.
    """
    def replicate(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = Cover(distance, segments)
        for batch in parts:
            word = batch.column("word").to_numpy().view(np.uint64)
            for segment, row, codeword in cover.anchors(word):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), segment, np.int32)), pa.array(codeword.view(np.int64)), pa.array(word[row].view(np.int64))],
                    ["segment", "anchor", "word"],
                )

    def link(group: pa.Table) -> pa.Table:
        anchor = group["anchor"].to_numpy() + (group["segment"].to_numpy().astype(np.int64) << (64 // segments) % 64)
        a, b = join_near(anchor, group["word"].to_numpy().view(np.uint64), distance)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    placed = materialize(words.select("word").mapInArrow(replicate, "segment int, anchor long, word long"), "anchors")
    keys = ["segment", "anchor"]
    hot = placed.groupBy(*keys).count().filter(F.col("count") > BLOCK_ROWS)
    hot = materialize(hot.select(*keys, F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), "hot")
    n_hot = hot.count()
    small = F.broadcast(hot) if n_hot <= BROADCAST_ANCHORS else hot
    tasks = max(1, -(-placed.count() // TASK_ROWS))
    usual = placed.join(small, keys, "left_anti").withColumn("task", F.pmod(F.xxhash64(*keys), F.lit(tasks)))
    linked = usual.groupBy("task").applyInArrow(link, "a long, b long")
    if n_hot:
        block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
        met = placed.join(small, keys).withColumn("one", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.withColumns({"low": F.least("one", "other"), "high": F.greatest("one", "other")})
        linked = linked.union(met.groupBy(*keys, "low", "high").applyInArrow(link, "a long, b long"))
    return linked


def simhash_components(docs: DataFrame, distance: int = 4, n: int = 4, seed: int = 42, segments: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    A fingerprint is 16 hex digits; texts without words (null, empty, white space) have zero, which links like
    any other. ``component_id`` is the smallest doc_id reachable over links of at most
    ``distance`` differing bits. Equal fingerprints are one node, so a group of copies costs nothing extra. Rows without
    doc_id link like others but name no component; if a component has only such rows, its id is null. Repeated rows come back
    as often as they occur; extra columns are ignored; an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            words = [fingerprints(texts, n, seed) for _, texts in batches(batch.column("text"))]
            found = np.concatenate([np.zeros(0, np.int64), *words])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "word"])

    rows = materialize(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, word long"), "simhash")
    words = materialize(rows.groupBy("word").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "words")
    edges = materialize(near_links(words, distance, segments), "links")
    labels = components(edges).select(F.col("node").alias("word"), F.col("component").alias("label"))
    discard(edges)
    named = words.join(labels, "word", "left").withColumn("label", F.coalesce("label", "word"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = materialize(named.select("word", "label", "rows").join(least, "label").select("word", "component_id", "rows"), "components")
    # At most one entry in HOT_ROWS documents.
    hot = F.broadcast(known.filter(F.col("rows") > HOT_ROWS).drop("rows"))
    usual = known.filter(F.col("rows") <= HOT_ROWS).drop("rows")
    joined = rows.join(hot, "word").unionByName(rows.join(hot.select("word"), "word", "left_anti").join(usual, "word"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("word")), 16, "0").alias("fingerprint"), "component_id")
