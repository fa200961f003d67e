"""Toxicity by a convolutional text classifier trained in numpy, on every labelled document.

Words are hashed; a word's hash picks its embedding. Filters of several widths run over the
embeddings, each keeps its largest response over the whole text, and a logistic layer weighs them.
Labelled documents are dealt into shards by hash. Every epoch is a job: each shard trains a copy of the network on its own documents,
and the copies' changes are averaged, as whole numbers, so that the order of the tasks does not matter. Words are counted and thresholds
found over all labelled documents as well; the driver holds the network alone. After training only the most telling words keep their embeddings; all others, like unknown words,
are blank. A filter answers with its bias wherever it sees blanks alone, so applying the network
means looking every word up and working out the responses around the words that are not blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.llm.words import PUNCTUATED, batches, bound_batches, find_words
from hazardlake.operators.prefix import cut_points, running
from hazardlake.session import materialize

#: Documents and words in a shard, about; a task trains one shard at a time.
SHARD_DOCUMENTS = 2400
SHARD_WORDS = 1_500_000
#: Documents in a step of the training.
STEP = 48
#: Words that have embeddings during training, those that tell the labels apart best.
CANDIDATES = 8000
#: Averaged changes are added up in units of 2**-40.
UNITS = 2.0**40
#: A word needs an embedding of its own only if so many of them have it.
LEAST_DOCUMENTS = 8
#: Words that keep their embeddings.
KEPT_WORDS = 3000
WIDTHS, FILTERS, DIM, EPOCHS = (1, 2, 3), 8, 8, 8


class Network(NamedTuple):
    """Word hashes with embeddings, filters by width (width, dim, filters), biases, last layer, shift."""

    words: np.ndarray
    embeddings: np.ndarray
    filters: list
    biases: list
    last: np.ndarray
    offset: float
    thresholds: dict


def look_up(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Embedding row of each word; unknown words have the blank row, ``len(words)``."""
    if not len(words):
        return np.zeros(len(found), dtype=np.int64)
    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
    return np.where(words[at] == found, at, len(words))


def _tables(net: Network) -> list[list[np.ndarray]]:
    """Per width and offset, each word's contribution to every filter; the last row is the blank."""
    padded = np.concatenate([net.embeddings, np.zeros((1, net.embeddings.shape[1]), np.float32)])
    return [[padded @ f[j] for j in range(len(f))] for f in net.filters]


def _windows(rows: np.ndarray, text: np.ndarray, at: np.ndarray, j: int, blank: int) -> np.ndarray:
    """Rows of the ``j``-th words behind the places ``at``; blank where the text has ended."""
    behind = np.minimum(at + j, len(rows) - 1)
    return np.where((at + j < len(rows)) & (text[behind] == text[at]), rows[behind], blank)


def pooled(net: Network, tables: list, found: np.ndarray, text: np.ndarray, n_texts: int, peaks: list | None = None) -> np.ndarray:
    """Largest response of every filter per text; ``peaks`` gets the place of each, or -1 for blanks."""
    rows, blank = look_up(net.words, found), len(net.words)
    some = np.flatnonzero(rows != blank)
    out = []
    for table, bias in zip(tables, net.biases):
        best = np.tile(bias, (n_texts, 1))
        peak = np.full(best.shape, -1)
        near = np.unique(np.concatenate([some - j for j in range(len(table))]))
        near = near[near >= 0]
        if len(near):
            r = bias + sum(t[_windows(rows, text, near, j, blank)] for j, t in enumerate(table))
            owner = text[near]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            if peaks is None:
                best[owner[first]] = np.maximum(best[owner[first]], np.maximum.reduceat(r, first, axis=0))
            else:
                for a, b in zip(first, [*first[1:], len(near)]):
                    top = r[a:b].argmax(0)
                    value = r[a:b][top, np.arange(r.shape[1])]
                    more = value > best[owner[a]]
                    best[owner[a]][more] = value[more]
                    peak[owner[a]][more] = near[a + top[more]]
        out.append(best)
        if peaks is not None:
            peaks.append(peak)
    return np.concatenate(out, axis=1)


def logits(net: Network, tables: list, found: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    hidden = np.maximum(pooled(net, tables, found, text, n_texts), 0)
    return hidden @ net.last[:-1] + net.last[-1] + net.offset


def start(n_words: int, odds: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Embeddings, filters, biases and last layer before training, from the words' log odds."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (n_words, DIM)).astype(np.float32)
    # The first coordinate starts at the words' log odds, so that telling words win the maximum early.
    emb[:, 0] = np.clip(odds, -3, 3) / 3
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] += np.linspace(0.2, 1.0, FILTERS, dtype=np.float32) / len(f)
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    last = np.concatenate([rng.normal(0.2, 0.05, FILTERS * len(WIDTHS)), [0]]).astype(np.float32)
    return [emb, *filters, *biases, last]


def network(params: list[np.ndarray], words: np.ndarray) -> Network:
    return Network(words, params[0], params[1 : 1 + len(WIDTHS)], params[1 + len(WIDTHS) : -1], params[-1], 0.0, {})


def epoch(params: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray, weights: np.ndarray, seed: int) -> None:
    """One pass of Adam over the places of each text's words in the vocabulary; a document counts by the weight of its label. Changes ``params``."""
    emb, last = params[0], params[-1]
    words = np.arange(len(emb), dtype=np.uint64)
    net = network(params, words)
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step, group in enumerate(np.array_split(rng.permutation(len(texts)), max(1, len(texts) // STEP)), 1):
        text = np.repeat(np.arange(len(group)), [len(texts[i]) for i in group])
        peaks: list[np.ndarray] = []
        found = np.concatenate([texts[i] for i in group])
        hidden = np.maximum(pooled(net, _tables(net), found, text, len(group), peaks), 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ last[:-1] + last[-1], -30, 30)))
        error = ((p - y[group]) * weights[y[group]] / len(group)).astype(np.float32)
        grads = [np.zeros_like(x) for x in params]
        grads[-1][:-1], grads[-1][-1] = hidden.T @ error + 1e-4 * last[:-1], error.sum()
        back = (error[:, None] * last[None, :-1]) * (hidden > 0)
        padded = np.concatenate([emb, np.zeros((1, DIM), np.float32)])
        rows = look_up(words, found)
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads[1 + len(WIDTHS) + k] += g.sum(0)
            for j in range(w):
                peak = peaks[k]
                at = np.where(peak >= 0, _windows(rows, text, np.maximum(peak, 0), j, len(words)) if len(rows) else len(words), len(words))
                grads[1 + k][j] += np.einsum("nf,nfd->df", g, padded[at])
                add = np.zeros((len(words) + 1, DIM), np.float32)
                np.add.at(add, at.ravel(), (g[:, :, None] * net.filters[k][j].T[None]).reshape(-1, DIM))
                grads[0] += add[:-1]
        for x, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _flat(params: list[np.ndarray]) -> np.ndarray:
    """All parameters as rows of ``DIM`` numbers: an embedding a row, then the rest."""
    rest = np.concatenate([p.ravel() for p in params[1:]])
    return np.concatenate([params[0], np.append(rest, np.zeros(-len(rest) % DIM, np.float32)).reshape(-1, DIM)])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, rest = [flat[: len(like[0])].astype(np.float32)], flat[len(like[0]) :].ravel()
    for p in like[1:]:
        out.append(rest[: p.size].reshape(p.shape).astype(np.float32))
        rest = rest[p.size :]
    return out


def train(texts: list[np.ndarray], y: np.ndarray, seed: int = 5, least_documents: int = LEAST_DOCUMENTS,
          kept_words: int = KEPT_WORDS) -> Network:
    """A network from the hashed words of each text and its label (0 or 1), trained like a single shard of these texts.

    Words of fewer than ``least_documents`` texts are blank from the start, all but the ``kept_words`` most telling ones
    in the end.
    """
    sets = [np.unique(t) for t in texts]
    words, at = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    label = np.repeat(y, [len(s) for s in sets])
    seen = np.stack([np.bincount(at[label == v], minlength=len(words)) for v in (0, 1)])
    stay = seen.sum(0) >= least_documents
    words, sizes = words[stay], np.bincount(y, minlength=2)
    shares = (seen[:, stay] + 0.5) / (sizes[:, None] + 1)
    params = start(len(words), np.log(shares[1] / shares[0]), seed)
    places = [look_up(words, t).astype(np.uint64) for t in texts]
    for number in range(EPOCHS):
        epoch(params, places, y, sizes.sum() / np.maximum(2 * sizes, 1), seed * 1000 + number)
    stay = most_telling(params, kept_words)
    return network([params[0][stay], *params[1:]], words[stay])


def train_shards(shards: DataFrame, params: list[np.ndarray], weights: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """The parameters after ``EPOCHS`` epochs over the shards (shard, y, sizes, places), labels weighted by ``weights``.

    A parameter moves by the mean of its changes over the shards that change it.
    """
    context, names = shards.sparkSession.sparkContext, [f"v{i}" for i in range(DIM)]
    for number in range(EPOCHS):
        shared = context.broadcast(params)

        def run(parts: Iterator[pa.RecordBatch], number: int = number, shared=shared) -> Iterator[pa.RecordBatch]:
            before = _flat(shared.value).astype(np.float64)
            total, times = np.zeros(before.shape, np.int64), np.zeros(len(before), np.int64)
            for batch in parts:
                for row in batch.to_pylist():
                    texts = np.split(np.frombuffer(row["places"], np.int32).astype(np.uint64), np.cumsum(np.frombuffer(row["sizes"], np.int32))[:-1])
                    copy = [p.copy() for p in shared.value]
                    epoch(copy, texts, np.frombuffer(row["y"], np.int8).astype(np.int64), weights, seed * 1000 + number)
                    change = np.rint((_flat(copy).astype(np.float64) - before) * UNITS).astype(np.int64)
                    total += change
                    times += (change != 0).any(axis=1)
            at = np.flatnonzero(times)
            columns = [at.astype(np.int32), times[at], *total[at].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["at", "times", *names])

        changed = shards.mapInArrow(run, "at int, times long, " + ", ".join(f"{n} long" for n in names))
        sums = changed.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("times", *names)]).toArrow()  # as large as the network
        flat = _flat(params).astype(np.float64)
        at = sums["at"].to_numpy()
        flat[at] += np.stack([sums[n].to_numpy() for n in names], axis=1) / UNITS / sums["times"].to_numpy()[:, None]
        params = _shaped(flat, params)
        shared.unpersist()
    return params


def most_telling(params: list[np.ndarray], kept_words: int) -> np.ndarray:
    """Places of the words that move the filters most, ascending."""
    net = network(params, np.zeros(len(params[0]), np.uint64))
    weights = np.abs(net.last[:-1]).reshape(len(WIDTHS), FILTERS)
    telling = np.max([np.abs(t[:-1] * w).max(1) for table, w in zip(_tables(net), weights) for t in table], axis=0) if len(net.words) else np.zeros(0)
    return np.sort(np.argsort(-telling, kind="stable")[:kept_words])


def cuts(scored: DataFrame) -> DataFrame:
    """(lang, z, hits, others): the logit at which F1 is best, halfway to the next lower one, for each language (null: all rows) with both labels.

    ``scored`` has (lang, y, z). Of several best cuts the middle one is taken.
    """
    scope = F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit("").alias("lang")), F.struct(F.lit(False).alias("every"), F.coalesce("lang", F.lit("")).alias("lang"))))
    cells = scored.select(scope.alias("s"), "y", (-F.col("z")).alias("back")).groupBy("s.every", "s.lang", "back").agg(
        F.sum("y").alias("hit"), F.count(F.lit(1)).alias("n")
    )
    cells = materialize(cells, "cells")
    by = ["every", "lang"]
    ranked = running(cells, by, "back", sums={"caught": "hit", "taken": "n"}, totals={"hits": "hit", "total": "n"}, cuts=cut_points(cells, "back"))
    ranked = materialize(ranked.filter("hits > 0 and hits < total").withColumn("f1", F.expr("2 * caught / (taken + hits)")), "ranked")
    best = ranked.join(ranked.groupBy(*by).agg(F.max("f1").alias("top")), by).filter("f1 >= top - 1e-12")
    place = Window.partitionBy(*by).orderBy("back")  # cuts that are equally good are few
    best = best.withColumns({"place": F.row_number().over(place) - 1, "several": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    best = materialize(best.filter("place = several div 2").select(*by, F.col("back").alias("cut"), "hits", (F.col("total") - F.col("hits")).alias("others")), "cuts")
    lower = ranked.select(*by, "back").join(best.select(*by, "cut"), by).filter("back > cut").groupBy(*by).agg(F.min("back").alias("next"))
    z = -F.coalesce((F.col("cut") + F.col("next")) / 2, F.col("cut") + 1)
    return best.join(lower, by, "left").select(F.when(~F.col("every"), F.col("lang")).alias("lang"), z.alias("z"), "hits", "others")


def _words(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, run in batches(text):
        found = find_words(run, PUNCTUATED)
        yield first, len(run), found.hashes, found.text


def known_words(texts: DataFrame, least_documents: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and log odds of the words that tell the labels apart best, from all ``texts`` (y, words).

    Words are ranked by the deviance of their counts of documents by label; words of fewer than ``least_documents`` are left out.
    """
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sets = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
            for y, b in zip(batch.column("y").to_pylist(), batch.column("words").to_pylist()):
                sets[y].append(np.unique(np.frombuffer(b, np.uint64)))
            words, at = np.unique(np.concatenate([*sets[0], *sets[1]]), return_inverse=True)
            label = np.repeat([0, 1], [sum(map(len, s)) for s in sets])
            seen = [np.bincount(at, weights=label == v, minlength=len(words)).astype(np.int64) for v in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(seen[0]), pa.array(seen[1])], ["word", "n0", "n1"])

    counted = texts.select("y", "words").mapInArrow(count, "word long, n0 long, n1 long")
    counted = counted.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= least_documents)
    sizes = {r.y: r["count"] for r in texts.groupBy("y").count().collect()}
    part = lambda c, v: f"if({c} = 0, 0D, {c} * ln({c} * {sizes[0] + sizes[1]}D / ((n0 + n1) * {sizes[v]}D)))"
    deviance = F.round(F.expr(f"{part('n0', 0)} + {part('n1', 1)}"), 6)
    shares = [F.expr(f"(n{v} + 0.5D) / {sizes[v] + 1}D") for v in (0, 1)]
    top = counted.orderBy(F.desc(deviance), "word").limit(candidates).select("word", F.ln(shares[1] / shares[0]).alias("odds")).toArrow()
    words, odds = top["word"].to_numpy().view(np.uint64), top["odds"].to_numpy()
    order = np.argsort(words)
    return words[order], odds[order]


def dealt(texts: DataFrame, words: np.ndarray) -> DataFrame:
    """(shard, y, sizes, places): the documents of ``texts`` as places of their words in the vocabulary, a row a shard, in an order of hashes."""
    n, size = texts.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length("words") / 8), F.lit(0.0))).first()
    shards = int(max(1, -(-n // SHARD_DOCUMENTS), -(-size // SHARD_WORDS)))
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def bundle(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("words", "ascending")])
        found = [np.frombuffer(b, np.uint64) for b in group["words"].to_pylist()]
        return pa.table({
            "shard": group["shard"].slice(0, 1), "y": [group["y"].to_numpy().astype(np.int8).tobytes()],
            "sizes": [np.array([len(f) for f in found], np.int32).tobytes()],
            "places": [look_up(shared.value, np.concatenate(found)).astype(np.int32).tobytes()],
        })

    placed = texts.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).select("shard", "key", "y", "words")
    placed = placed.repartition(min(shards, 4000), "shard")
    return placed.groupBy("shard").applyInArrow(bundle, "shard int, y binary, sizes binary, places binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 0, folds: int = 5,
        least_documents: int = LEAST_DOCUMENTS, kept_words: int = KEPT_WORDS) -> Network:
    """A network from all labelled documents, none of the held-out fold.

    Of rows that share a doc_id one is taken, the one with the least text. ``least_documents`` and ``kept_words`` bound the vocabulary.

    A fifth of the documents is kept from training; on it the logits are shifted so that 0.5 is the best cut, and the best cut of each
    language with enough documents is found. Without documents of both labels every score is the smallest.
    """
    bound_batches(docs.sparkSession)
    crc = F.crc32(F.col("doc_id").cast("string"))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc % folds != fold))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).cast("int").alias("y"))

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = []
            for _, n, found, text in _words(batch.column("text")):
                ends = np.searchsorted(text, np.arange(n + 1))
                out += [found[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "y", "lang", "spare")), pa.array(out, pa.binary())], ["key", "y", "lang", "spare", "words"]
            )

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    chosen = docs.select("doc_id", "text", lang.alias("lang")).join(known, F.col("doc_id") == F.col("__id"))
    chosen = chosen.groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("s")).select("doc_id", "y", "s.*").select(
        F.xxhash64("doc_id").alias("key"), "y", "lang", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0).alias("spare"), "text"
    )
    texts = materialize(chosen.mapInArrow(hashed, "key long, y int, lang string, spare boolean, words binary"), "labelled")
    seen = {(r.spare, r.y): r["count"] for r in texts.groupBy("spare", "y").count().collect()}
    whole = all(spare for spare, _ in seen)
    use = texts if whole else texts.filter("not spare")
    sizes = np.array([sum(n for (spare, y), n in seen.items() if y == v and (whole or not spare)) for v in (0, 1)])
    if not sizes.all():
        return Network(np.zeros(0, np.uint64), np.zeros((0, DIM), np.float32), [], [], np.zeros(1, np.float32), -10.0, {})
    words, odds = known_words(use, least_documents, max(CANDIDATES, kept_words))
    # both labels weigh alike in all
    params = train_shards(materialize(dealt(use, words), "shards"), start(len(words), odds), sizes.sum() / (2 * sizes))
    stay = most_telling(params, kept_words)
    net = network([params[0][stay], *params[1:]], words[stay])
    check = texts.filter("spare") if {(True, 0), (True, 1)} <= set(seen) else use
    shared = docs.sparkSession.sparkContext.broadcast(tuple(net))

    def judged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Network(*shared.value)
        tables = _tables(one)
        for batch in parts:
            found = [np.frombuffer(b, np.uint64) for b in batch.column("words").to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            z = logits(one, tables, np.concatenate([*found, np.zeros(0, np.uint64)]), owner, len(found))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(z.astype(np.float64))], ["lang", "y", "z"])

    found = cuts(materialize(check.select("lang", "y", "words").mapInArrow(judged, "lang string, y int, z double"), "judged"))
    rows = found.filter("lang is null or least(hits, others) >= 10").collect()  # a row a language
    offset = -next(r.z for r in rows if r.lang is None)
    thresholds = {r.lang: float(1 / (1 + np.exp(-(r.z + offset)))) for r in sorted((r for r in rows if r.lang is not None), key=lambda r: r.lang)}
    return net._replace(offset=offset, thresholds=thresholds)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang, score) of every row: 0 to 1 from the text alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(net))  # bounded by the kept words

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Network(*shipped.value)
        tables = _tables(known)
        for batch in parts:
            z = np.full(batch.num_rows, known.offset, dtype=np.float64)
            for first, n, found, text in _words(batch.column("text")):
                if tables:
                    z[first : first + n] = logits(known, tables, found, text, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "lang", "score"]
            )

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", lang.alias("lang"), "text").mapInArrow(run, f"doc_id {kind}, lang string, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 0, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged) of every row of ``docs``.

    ``held_out`` marks the fold (crc32 of doc_id as text) whose labels are never learned from;
    ``predicted`` is score >= 0.5, ``flagged`` is score >= the threshold of the row's language,
    0.5 where too few labelled documents have it. The score depends on the text alone. Null and empty
    texts are scored as a text without words. Repeated rows score alike; a row without doc_id is
    not held out. Extra columns are ignored; an empty table gives an empty one.
    """
    net = fit(docs, labels, label, fold, folds)
    threshold = F.lit(0.5)
    for name, value in net.thresholds.items():
        threshold = F.when(F.coalesce("lang", F.lit("")) == name, F.lit(value)).otherwise(threshold)
    return score(docs, net).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), threshold.alias("threshold"),
    ).withColumn("flagged", F.col("score") >= F.col("threshold"))
