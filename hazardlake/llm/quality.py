"""Quality by importance resampling: hashed n-gram models of target and raw text.

A text's importance is the ratio of its probability under a bag of hashed n-grams counted on
target documents to that under one counted on all documents. Gumbel noise on the log ratios and
a top-k make the choice a sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.words import PUNCTUATED, batches, bound_batches, claim, find_words, give_back, mix
from hazardlake.session import materialize

#: Hash buckets of the n-gram models.
BUCKETS = 1 << 14
#: Labelled documents that the target model and the size of the sample are taken from, per label.
SAMPLE = 20_000
#: Largest band of keys that the driver looks through for the k-th one.
BAND = 200_000


def buckets(run: list[bytes], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, and the text of each.

    Words and runs of marks are told apart and case counts. A pair is hashed by the difference
    of its words, so that all repetitions of a word share one bucket.
    """
    found = find_words(run, PUNCTUATED, lower=False)
    together = found.text[1:] == found.text[:-1]
    pairs = mix(found.hashes[1:][together] - found.hashes[:-1][together] + np.uint64(1))
    where = np.concatenate([found.text, found.text[1:][together]])
    return (np.concatenate([found.hashes, pairs]) % np.uint64(n_buckets)).astype(np.int64), where


class Model(NamedTuple):
    """Log ratio of target to raw per bucket, and the cut on document weights that labels ask for."""

    ratio: np.ndarray
    cut: float


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the documents labelled 0 or 1; the larger label of a doubled id counts."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))


def labelled_sample(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(doc_id, y) of at most ``sample`` documents per label, drawn by hash."""
    known = labelled(labels, label)
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    return materialize(drawn[0].union(drawn[1]), "sample")


def _counts(docs: DataFrame, drawn: DataFrame, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts per bucket: of the target documents drawn, and of all documents."""
    target = drawn.filter("y = 1").select(F.col("doc_id").alias("__id"), F.lit(True).alias("target"))
    marked = docs.select("doc_id", "text").join(F.broadcast(target), F.col("doc_id") == F.col("__id"), "left")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        totals = np.zeros((2, n_buckets), dtype=np.int64)
        for batch in parts:
            chosen = batch.column("target").fill_null(False).to_numpy(zero_copy_only=False)
            for first, texts in batches(batch.column("text")):
                bucket, where = buckets(texts, n_buckets)
                totals[0] += np.bincount(bucket, minlength=n_buckets)
                mine = chosen[first : first + len(texts)][where]
                totals[1] += np.bincount(bucket[mine], minlength=n_buckets)
        some = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(totals[0][some]), pa.array(totals[1][some])], ["bucket", "raw", "target"]
        )
        del totals
        give_back()

    parts = marked.select("text", "target").mapInArrow(run, "bucket long, raw long, target long")
    summed = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, aim = np.zeros(n_buckets), np.zeros(n_buckets)
    raw[summed["bucket"].to_numpy()] = summed["raw"].to_numpy()
    aim[summed["bucket"].to_numpy()] = summed["target"].to_numpy()
    return aim, raw


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``docs`` with log_weight, the sum of the log ratios of a text's n-grams; 0 for an empty text."""
    names = list(docs.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    table = docs.sparkSession.sparkContext.broadcast(ratio)  # one number per bucket

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = table.value
        for batch in parts:
            weight = np.zeros(batch.num_rows)
            for first, texts in batches(batch.column("text")):
                bucket, where = buckets(texts, len(values))
                weight[first : first + len(texts)] = np.bincount(where, weights=values[bucket], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(weight)], [*names, "log_weight"])
        give_back()

    return docs.mapInArrow(run, f"{fields}, log_weight double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", n_buckets: int = BUCKETS, sample: int = SAMPLE) -> Model:
    """The two models, and the cut between documents of either label.

    The raw model counts every document; the target model at most ``sample`` documents labelled
    1. The cut halves the way between the labels where it errs least, a lost document of label 1
    weighing ten times a kept one of label 0 and the sample weighted back to the labels' counts in
    the whole table. Without documents of both labels nothing is cut.
    """
    bound_batches(docs.sparkSession)
    drawn = labelled_sample(labels, label, sample)
    target, raw = _counts(docs, drawn, n_buckets)
    ratio = np.log((target + 1) / (target.sum() + n_buckets)) - np.log((raw + 1) / (raw.sum() + n_buckets))
    if not target.sum():
        ratio = np.zeros(n_buckets)
    ids = F.broadcast(drawn.select(F.col("doc_id").alias("__id"), "y"))
    chosen = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"))
    # Of rows that share a doc_id one is taken, so that the sample bounds what comes to the driver.
    rows = weigh(chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y"), ratio)
    known = rows.select("y", "log_weight").toArrow()
    y, w = known["y"].to_numpy(), known["log_weight"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Model(ratio, float("-inf"))
    counts = {r.y: r["count"] for r in labelled(labels, label).groupBy("y").count().collect()}
    each = np.array([counts[v] / (y == v).sum() * (1, 10)[v] for v in (0, 1)])[y.astype(int)]
    order = np.argsort(w, kind="stable")
    y, w, each = y[order], w[order], each[order]
    lost, passed = np.cumsum(np.where(y == 1, each, 0)), np.cumsum(np.where(y == 0, each, 0))
    # Rounded, as sums of weights that tie must stay ties.
    errors = np.round(np.concatenate(([0], lost)) + passed[-1] - np.concatenate(([0], passed)), 6)
    best = int(np.flatnonzero(errors == errors.min()).mean())
    edges = np.concatenate(([w[0] - 1], (w[1:] + w[:-1]) / 2, [w[-1] + 1]))
    return Model(ratio, float(edges[best]))


def kth_largest(rows: DataFrame, column: str, k: int, band: int = BAND) -> float:
    """The ``k``-th largest value: values near it narrow it down to at most ``band`` ones, which are sorted.

    Every round counts exactly what lies above two of the values and goes on strictly between or
    beside them, so it ends whatever values repeat.
    """
    low, high, above = float("-inf"), float("inf"), 0  # both excluded; ``above``: values from ``high`` up
    values = rows.select(F.col(column).alias("v"))
    while True:
        inside = values.filter((F.col("v") > low) & (F.col("v") < high))
        n = inside.count()
        if n <= band:
            found = np.sort(inside.toArrow()["v"].to_numpy())
            return float(found[n - (k - above)])
        p = 1 - (k - above) / n
        step = max(band / n / 8, 1e-7)
        a, b = inside.approxQuantile("v", [max(0.0, p - 2 * step), min(1.0, p + 2 * step)], step)
        limits = [F.col("v") > b, F.col("v") >= b, F.col("v") > a, F.col("v") >= a]
        beyond = [above + c for c in inside.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(limits)]).first()]
        if k <= beyond[0]:
            low = b
        elif k <= beyond[1]:
            return float(b)
        elif k <= beyond[2]:
            low, high, above = a, b, beyond[1]
        elif k <= beyond[3]:
            return float(a)
        else:
            high, above = a, beyond[3]


def resample(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: int | None = None, seed: int = 17,
             n_buckets: int = BUCKETS, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with log_weight, key and kept: Gumbel top-k of the importance weights.

    ``key`` is the log weight plus Gumbel noise drawn from doc_id and ``seed``; ``kept`` marks the
    ``keep`` largest keys. By default that many are kept as have a weight above the cut that the
    labels ask for, so that documents like the rejected ones go and the others stay. Every row
    comes back once with all its columns (log_weight, key and kept are replaced); a null or empty
    text weighs 0; rows without doc_id share one draw; repeated rows share their draw, and rows
    whose keys tie at the limit are kept together. Without labels of both kinds all are kept. An
    empty table gives an empty one.
    """
    docs = docs.drop(*[c for c in ("log_weight", "key", "kept") if c in docs.columns])
    model = fit(docs, labels, label, n_buckets, sample)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weigh(docs, model.ratio).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))
    narrow = materialize(keyed.select("log_weight", "key"), "weights")
    if keep is None:
        keep = narrow.filter(F.col("log_weight") > model.cut).count()
    limit = kth_largest(narrow, "key", keep) if keep > 0 else float("inf")
    return keyed.withColumn("kept", F.col("key") >= limit)
