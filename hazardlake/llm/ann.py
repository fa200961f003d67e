"""Nearest neighbours by largest inner product over balanced posting lists.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest
norm. Centroids are fitted on a bounded sample by k-means, large clusters being cut in two until
the lists are balanced. Each distinct vector joins the nearest lists, boundary vectors several.
Centroids are found by a beam search in a neighbour graph held in memory. A query reads its few
nearest lists, and then every list whose centroid lies within a ratio of the distance of the
k-th neighbour found so far. The ratio is calibrated on the sample for the recall asked for.
Lists are dealt out in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.session import materialize

#: Distinct vectors that the centroids are fitted on.
SAMPLE = 30_000
#: Sample vectors that the ratio is calibrated with.
CALIBRATION = 400
#: Distinct vectors in a list before replication.
LIST_SIZE = 48
#: Lists that one vector joins at most, and how much farther than the nearest they may lie.
REPLICAS, REPLICA_RATIO = 6, 1.3
#: Lists that every query reads first.
FIRST_LISTS = 6
#: Queries whose hits one task ranks.
QUERIES_PER_TASK = 1000
#: Rows of a block of a list, and queries of a list that one task scans a block for.
BLOCK, QUERY_BLOCK = 4096, 4096


class Index(NamedTuple):
    """Centroids (with the added coordinate), their neighbour graph, and the search's settings."""

    centroids: np.ndarray
    graph: np.ndarray
    largest_norm: float
    ratio: float
    beam: int


def lift(x: np.ndarray, largest_norm: float) -> np.ndarray:
    """Vectors with the coordinate that makes distance order inner products."""
    more = np.sqrt(np.maximum(largest_norm**2 - (x * x).sum(1, keepdims=True), 0))
    return np.concatenate([x, more], axis=1).astype(np.float32)


def lift_query(q: np.ndarray, largest_norm: float) -> np.ndarray:
    """Queries scaled to the largest norm, with a zero coordinate; the order stays."""
    norm = np.sqrt((q * q).sum(1, keepdims=True))
    scaled = q * (largest_norm / np.where(norm > 0, norm, 1))
    return np.concatenate([scaled, np.zeros((len(q), 1))], axis=1).astype(np.float32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    return np.sqrt(np.maximum(squared, 0))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """k-means centroids; a cluster of over twice the mean size is cut in two."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        sizes = np.bincount(near, minlength=len(c))
        some = sizes > 0
        sums = np.add.reduceat(x[order], (np.cumsum(sizes) - sizes)[some], axis=0)
        c = (sums / sizes[some, None]).astype(np.float32)
    limit = max(2, 2 * -(-len(x) // k))
    near = _nearest(x, c)
    ends = np.cumsum(np.bincount(near, minlength=len(c)))[:-1]
    todo, done = np.split(np.argsort(near, kind="stable"), ends), []
    while todo:
        rows = todo.pop()
        if len(rows) <= limit or np.ptp(x[rows], axis=0).max() == 0:
            if len(rows):
                done.append(x[rows].mean(0))
            continue
        far = rows[distances(x[rows], x[rows].mean(0)[None]).argmax()]
        away = distances(x[rows], x[far][None])[:, 0]
        half = np.argsort(away, kind="stable")
        todo += [rows[half[: len(half) // 2]], rows[half[len(half) // 2 :]]]
    return np.array(done, dtype=np.float32)


def neighbour_graph(c: np.ndarray, degree: int = 24, seed: int = 11) -> np.ndarray:
    """Per centroid its nearest others, a ring link, and a few random ones to cross the graph."""
    k = len(c)
    near = min(degree, k - 1)
    rows = []
    for i in range(0, k, 1024):
        d = distances(c[i : i + 1024], c)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        rows.append(np.argpartition(d, near - 1, axis=1)[:, :near] if near else np.zeros((len(d), 0), int))
    ring = ((np.arange(k) + 1) % k)[:, None]
    jumps = np.random.default_rng(seed).integers(0, k, (k, 7))
    return np.concatenate([np.concatenate(rows), ring, jumps], axis=1).astype(np.int32)


def search_graph(index: Index, x: np.ndarray, hop: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances) of the beam of each row, nearest first."""
    c, graph = index.centroids, index.graph
    k, beam = len(c), min(index.beam, len(c))
    entry = np.unique(np.linspace(0, k - 1, min(k, 32)).astype(int))
    found, away = [], []
    for at in range(0, len(x), 128):
        q = x[at : at + 128]
        rows = np.arange(len(q))[:, None]
        reached = np.full((len(q), k), np.inf, dtype=np.float32)
        opened = np.zeros((len(q), k), dtype=bool)
        reached[:, entry] = distances(q, c[entry])
        while True:
            best = np.argpartition(reached, beam - 1, axis=1)[:, :beam] if beam < k else np.argsort(reached, axis=1)
            closed = np.where(opened[rows, best], np.inf, reached[rows, best])
            pick = np.argsort(closed, axis=1)[:, :hop]
            live = np.isfinite(np.take_along_axis(closed, pick, 1))
            if not live.any():
                break
            node = np.take_along_axis(best, pick, 1)
            opened[np.broadcast_to(rows, node.shape)[live], node[live]] = True
            nodes = np.where(live[:, :, None], graph[node], node[:, :, None]).reshape(len(q), -1)
            step = c[nodes] - q[:, None, :]
            reached[rows, nodes] = np.sqrt(np.einsum("bnd,bnd->bn", step, step))
        order = np.argsort(reached, axis=1, kind="stable")[:, :beam]
        found.append(order)
        away.append(reached[rows, order])
    return np.concatenate(found), np.concatenate(away)


def lists_of_vectors(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest list, and others about as near for boundary vectors."""
    found, away = search_graph(index._replace(beam=min(64, len(index.centroids))), lift(x, index.largest_norm))
    chosen = away[:, :REPLICAS] <= REPLICA_RATIO * away[:, :1] + 1e-6
    rows, places = np.nonzero(chosen)
    return rows, found[rows, places]


def lists_of_queries(index: Index, q: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the first lists of each query, or those after them within the ratio of ``reach``."""
    lifted = lift_query(q, index.largest_norm)
    if reach is None:
        found, _ = search_graph(index._replace(beam=min(64, len(index.centroids))), lifted)
        first = found[:, :FIRST_LISTS]
        return np.repeat(np.arange(len(q)), first.shape[1]), first.ravel()
    rows, lists = [], []
    left, wide = np.arange(len(q)), index
    while len(left):
        found, away = search_graph(wide, lifted[left])
        # The ratio may be 0, and 0 * inf is no bound.
        inside = np.isinf(reach[left, None]) | (away <= index.ratio * np.where(np.isinf(reach), 0, reach)[left, None] + 1e-6)
        whole = ~inside[:, -1] | (found.shape[1] == len(index.centroids))
        r, place = np.nonzero(inside[whole][:, FIRST_LISTS:])
        rows.append(left[whole][r])
        lists.append(found[whole][r, place + FIRST_LISTS])
        left, wide = left[~whole], wide._replace(beam=2 * wide.beam)
    return np.concatenate(rows), np.concatenate(lists)


def fit(sample: np.ndarray, n_vectors: int, largest_norm: float, recall: float, k: int) -> Index:
    """The index of a sample of distinct vectors; ``n_vectors`` is the number in the whole table."""
    x = lift(sample, largest_norm)
    lists = max(1, min(-(-n_vectors // LIST_SIZE), len(x) // 6 + 1))
    c = balanced_centroids(x, lists)
    index = Index(c, neighbour_graph(c), largest_norm, 1.0, min(len(c), 64))
    if len(c) <= FIRST_LISTS:
        return index
    # Relative to the distance of its k-th neighbour, how far a query must look for each neighbour.
    probe = np.arange(0, len(sample), max(1, len(sample) // CALIBRATION))
    take, tops = min(k, len(sample) - 1), []
    for at in range(0, len(probe), 32):
        scores = sample[probe[at : at + 32]] @ sample.T
        here = np.arange(len(scores))[:, None]
        scores[here[:, 0], probe[at : at + 32]] = -np.inf
        near = np.argpartition(-scores, take - 1, axis=1)[:, :take]
        tops.append(np.take_along_axis(near, np.argsort(-scores[here, near], axis=1, kind="stable"), 1))
    top = np.concatenate(tops)
    members = np.unique(top)
    rows, lists_ = lists_of_vectors(index, sample[members])
    joined = np.full((len(sample), REPLICAS), -1)
    joined[members[rows], np.concatenate([np.arange(n) for n in np.bincount(rows, minlength=len(members))])] = lists_
    lifted = lift_query(sample[probe], largest_norm)
    d = distances(lifted, c)
    rank = d.argsort(1).argsort(1)
    reach = np.sqrt(((x[top[:, -1]] - lifted) ** 2).sum(1))
    need = np.zeros(top.shape)
    for i in range(len(probe)):
        to = joined[top[i]]
        met = ((to >= 0) & (rank[i][to] < FIRST_LISTS)).any(1)
        need[i] = np.where(met, 0, np.where(to >= 0, d[i][to], np.inf).min(1) / max(reach[i], 1e-9))
    ratio = float(np.quantile(need, recall))
    inside = (d <= ratio * reach[:, None]).sum(1)
    return index._replace(ratio=ratio, beam=int(min(len(c), max(64, 1.25 * inside.max()))))


def nearest(vectors: DataFrame, queries, k: int = 20, recall: float = 0.97, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of each query, best first.

    ``vectors`` has (vec_id, embedding); ``queries`` is a condition on vec_id. All rows are
    candidates but the query's own vec_id. ``score`` is the inner product of the original
    vectors in double precision; ties go to the smaller vec_id. Vectors that are null, zero, or
    hold null or non-finite components take no part, nor do rows without vec_id or with another
    number of components than most have. Equal vectors are searched once, whatever their number,
    and come back as the rows they are; repeated rows count as rows. With fewer candidates than
    ``k``, all that were found. Extra columns are ignored. An empty table gives an empty one.

    The centroids are fitted on ``sample`` distinct vectors, drawn by hash; every row is indexed.
    ``recall`` is the share of true neighbours aimed at.
    """
    spark = vectors.sparkSession
    fine = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.coalesce(fine, F.lit(False)))
    width = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("embedding") == width.w)
    keyed = rows.withColumns({"h": F.xxhash64("embedding"), "g": F.hash("embedding")})
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    distinct = materialize(
        keyed.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding")), "vectors"
    )
    n, largest = distinct.agg(F.count(F.lit(1)), F.max(norm)).first()
    drawn = distinct.orderBy(F.xxhash64("h"), "rep").limit(sample).select("embedding").toArrow()["embedding"]
    fitted = drawn.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width.w)
    # Bounded by the sample: centroids and graph.
    index = spark.sparkContext.broadcast(tuple(fit(fitted, n, largest, recall, k)))

    def assign(choose, carried: list[str] = [], reach: bool = False):  # noqa: B006
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Index(*index.value)
            for batch in parts:
                column = batch.column("embedding")
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for a in range(0, len(x), 2048):
                    part = batch.slice(a, 2048)
                    more = [part.column("reach").to_numpy(zero_copy_only=False)] if reach else []
                    r, lists = choose(known, x[a : a + 2048], *more)
                    taken = part.take(pa.array(r.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column("rep"), taken.column("embedding"), pa.array(lists.astype(np.int32)), *(taken.column(c) for c in carried)],
                        ["rep", "embedding", "list", *carried],
                    )

        return run

    out = "rep long, embedding array<double>, list int"
    asked = materialize(keyed.filter(queries).select("vec_id", "h", "g"), "queries")
    probes = distinct.join(asked.select("h", "g").distinct(), ["h", "g"], "left_semi").select("rep", "embedding")
    posting = materialize(distinct.select("rep", "embedding").mapInArrow(assign(lists_of_vectors), out), "postings")
    blocks = posting.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = posting.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Of equal vectors only the k + 1 smallest ids can matter.
    most = k + 1

    parts = max(1, -(-probes.count() // QUERIES_PER_TASK))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best hits of one block for all queries that read it, packed by the part that ranks them."""
        asks, found, scores = [], [], []
        if left.num_rows and right.num_rows:
            grid = lambda t: t.combine_chunks()["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            x, q = grid(right), grid(left)
            rep, query, least = right["rep"].to_numpy(), left["rep"].to_numpy(), left["least"].to_numpy()
            order = np.argsort(rep, kind="stable")
            x, rep = x[order], rep[order]
            take = min(most + 11, len(x))
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                rough = part @ x.T
                near = np.sort(np.argpartition(-rough, take - 1, axis=1)[:, :take], axis=1)
                exact = (part[:, None, :] * x[near]).sum(-1)
                best = np.argsort(-exact, axis=1, kind="stable")[:, :most]
                score = np.take_along_axis(exact, best, 1)
                hits = rep[np.take_along_axis(near, best, 1)]
                # Where more than were taken may reach the last score, all of them are looked at, smaller ids first.
                edge = score[:, -1:] - 1e-9 * np.maximum(1.0, np.abs(score[:, -1:]))
                for i in np.flatnonzero((rough >= edge).sum(1) > take).tolist():
                    tied = np.flatnonzero(rough[i] >= edge[i])
                    exact_i = np.concatenate([(part[i] * x[tied[c : c + 4096]]).sum(-1) for c in range(0, len(tied), 4096)])
                    first = np.argsort(-exact_i, kind="stable")[:most]
                    score[i], hits[i] = exact_i[first], rep[tied[first]]
                good = score >= least[a : a + 256, None]
                asks.append(np.broadcast_to(query[a : a + 256, None], score.shape)[good])
                found.append(hits[good])
                scores.append(score[good])
        columns = [np.concatenate(c) if c else np.zeros(0) for c in (asks, found, scores)]
        part = np.mod(columns[0], parts)
        each = [np.flatnonzero(part == i) for i in np.unique(part)]
        packed = [pa.array([c[i].tobytes() for i in each], pa.binary()) for c in columns]
        return pa.table([pa.array([int(part[i[0]]) for i in each], pa.int32()), *packed], ["part", "query", "rep", "score"])

    def rank(group: pa.Table) -> pa.Table:
        """The first hits of each query by score and then id; a hit found in several lists counts once."""
        join = lambda c, kind: np.concatenate([np.frombuffer(v, kind) for v in group[c].to_pylist()])
        query, rep, score = join("query", np.int64), join("rep", np.int64), join("score", np.float64)
        order = np.lexsort((rep, -score, query))
        query, rep, score = query[order], rep[order], score[order]
        new = np.concatenate(([True], (query[1:] != query[:-1]) | (rep[1:] != rep[:-1])))
        query, rep, score = query[new], rep[new], score[new]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        r = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) + 1
        top = r <= most
        return pa.table({"query": query[top], "rep": rep[top], "score": score[top], "r": r[top].astype(np.int32)})

    ranked = "query long, rep long, score double, r int"

    def read_lists(probing: DataFrame) -> DataFrame:
        """Hits of (query, list) rows. A list's rows and its queries are both dealt into blocks, which meet two by two."""
        probing = materialize(probing, "probes")
        asks = probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("asks"))
        # One row a list, no more than there are centroids.
        meet = F.broadcast(materialize(blocks.join(asks, "list"), "meet"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = probing.join(meet, "list").withColumn("ask", F.pmod(F.xxhash64("rep"), F.col("asks")).cast("int"))
        left = left.select("list", every("blocks").alias("block"), "ask", "rep", "embedding", "least")
        right = dealt.drop("blocks").join(meet, "list").select("list", "block", every("asks").alias("ask"), "rep", "embedding")
        keys = ["list", "block", "ask"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, packed)

    packed = "part int, query binary, rep binary, score binary"
    start = probes.withColumn("least", F.lit(float("-inf")))
    first_hits = materialize(read_lists(start.mapInArrow(assign(lists_of_queries, ["least"]), f"{out}, least double")), "hits")
    near = materialize(first_hits.groupBy("part").applyInArrow(rank, ranked), "near")
    # Distance of the k-th neighbour so far, which later hits must match; without one, every list is read.
    squared = 2 * float(largest) ** 2 - 2 * float(largest) * F.col("least") / norm
    known = near.filter(F.col("r") == most).select(F.col("query").alias("rep"), F.col("score").alias("least"))
    reach = probes.join(known, "rep", "left").select(
        "rep", "embedding", F.coalesce("least", F.lit(float("-inf"))).alias("least"),
        F.coalesce(F.sqrt(F.greatest(squared, F.lit(0.0))), F.lit(float("inf"))).alias("reach"),
    )
    wider = read_lists(reach.mapInArrow(assign(lists_of_queries, ["least"], True), f"{out}, least double"))
    best = first_hits.union(wider).groupBy("part").applyInArrow(rank, ranked)
    copies = keyed.withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))).filter(F.col("r") <= most)
    members = copies.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = (
        best.select("query", "rep", "score").join(members.select("rep", "ids"), "rep")
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("r", F.row_number().over(by_row)).filter(F.col("r") <= most)
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("answer"))
    )
    # Every asking row takes its vector's answer, leaves itself out and ranks the rest.
    reps = distinct.select("h", "g", F.col("rep").alias("query")).join(answers, "query").select("h", "g", "answer")
    mine = asked.join(reps, ["h", "g"]).select(
        F.col("vec_id").alias("query_id"),
        F.posexplode(F.slice(F.filter("answer", lambda a: a.vec_id != F.col("vec_id")), 1, k)),
    )
    return mine.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))
