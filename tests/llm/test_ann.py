import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlake.llm import ann

SCHEMA = "vec_id long, embedding array<float>, list int, rep long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0.0) for i, v in rows], SCHEMA)


def exact(rows, k, asks):
    """Per asking id the ids and scores of the true answer, rows repeated as they are."""
    fine = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for i, v in fine:
        if asks(i):
            scored = sorted((-float((v * w).sum()), j) for j, w in fine if j != i)[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert [i for i, _ in got[k]] == [i for i, _ in want[k]]
        assert [s for _, s in got[k]] == pytest.approx([s for _, s in want[k]], abs=1e-12)


def test_small_table_is_exact(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()][:150]
    same(answers(ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0)), exact(rows, 20, lambda i: i % 20 == 0))


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=24)).astype(np.float32).tolist()) for i in range(6000)]
    got, want = answers(ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0)), exact(rows, 20, lambda i: i % 20 == 0)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert all(len(got[q]) == 20 for q in want) and recall >= 0.9


def test_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows = [(i, hot) for i in range(0, 400)] + [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400, 460)]
    odd = [(500, None), (520, [0.0] * 8), (540, [1.0, None] + [0.0] * 6), (560, [float("nan")] + [1.0] * 7), (580, [float("inf")] + [1.0] * 7), (None, hot), (600, [1.0])]
    got = answers(ann.nearest(frame(spark, rows + odd), F.col("vec_id") % 20 == 0, k=5))
    same(got, exact(rows, 5, lambda i: i % 20 == 0))


def test_many_ties_go_to_the_smaller_ids(spark):
    """Different vectors with one score for the query, far more than the answer holds."""
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, float(a), float(b)]) for i, (a, b) in enumerate(rng.integers(-50, 50, size=(1500, 2)) * 0.25)]
    rows[0] = (0, [1.0, 0.0, 0.0])
    got = answers(ann.nearest(frame(spark, rows), F.col("vec_id") == 0, sample=12))
    same(got, exact(rows, 20, lambda i: i == 0))


def test_lists_and_queries_in_blocks(spark, monkeypatch):
    """Small blocks on both sides give the answers that whole lists give."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 330)]
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    got = answers(ann.nearest(frame(spark, rows), F.col("vec_id") % 2 == 0, sample=30))
    same(got, exact(rows, 20, lambda i: i % 2 == 0))


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 1.0]), (7, [2.0, 2.0])]
    same(answers(ann.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0)), exact(rows, 20, lambda i: i % 20 == 0))
    assert ann.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(frame(spark, [(1, None)]), F.col("vec_id") % 20 == 0).count() == 0


def test_few_first_hits_read_every_list():
    rng = np.random.default_rng(5)
    c = rng.normal(size=(40, 6)).astype(np.float32)
    index = ann.Index(c, ann.neighbour_graph(c), 10.0, 0.0, 8)
    q = rng.normal(size=(3, 5))
    with np.errstate(invalid="raise"):
        rows, lists = ann.lists_of_queries(index, q, np.array([np.inf, 2.0, np.inf]))
    first = ann.search_graph(index._replace(beam=40), ann.lift_query(q, 10.0))[0][:, : ann.FIRST_LISTS]
    for i in (0, 2):
        assert sorted([*lists[rows == i], *first[i]]) == list(range(40))
    assert not (rows == 1).any()


def test_graph_search_finds_nearest():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(700, 16)).astype(np.float32)
    index = ann.Index(c, ann.neighbour_graph(c), 1.0, 1.0, 64)
    x = rng.normal(size=(50, 16)).astype(np.float32)
    found, away = ann.search_graph(index, x)
    assert (found[:, 0] == ann.distances(x, c).argmin(1)).mean() >= 0.95
    assert (np.diff(away, axis=1) >= 0).all()
