"""Every stage of the pipeline against plain Python on the stage's own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import test_mixing
import test_ngram_join
import test_packing
import test_secret_scan
from hazardlake.llm import queries, secret_scan
from hazardlake.session import materialize


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage, by name."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        new = materialize(stage(spark, docs, "/root/testdata/sf0.001"), name)
        out[name] = (docs, new)
        docs = new
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_order_and_columns(stages):
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    first = stages["quality"][0].columns
    assert all(out.columns == first for name, (_, out) in stages.items() if name != "packing")


def test_quality(spark, stages):
    docs, kept = stages["quality"]
    assert not rows(kept) - rows(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    good, bad = ([i for i, q in labels.items() if q == v] for v in (1, 0))
    assert sum(i in left for i in good) >= 0.95 * len(good) and sum(i in left for i in bad) <= 0.3 * len(bad)
    want = {r.doc_id for r in queries.op10_quality_resampling(spark, "/root/testdata/sf0.001").filter("kept").collect()}
    assert left == want


def test_near_duplicates(stages):
    docs, kept = stages["near_duplicates"]
    groups = test_ngram_join.brute([(r.doc_id, r.text) for r in docs.collect()])
    assert not rows(kept) - rows(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, n, c in groups if n} | {i for i, n, _ in groups if not n})


def test_secrets(stages):
    docs, clean = stages["secrets"]
    find = secret_scan.finder(**{"path": queries.rank_vocabulary()["vocabulary"], "pattern": queries.rank_vocabulary()["pattern"]})
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert before.keys() == after.keys()
    touched = 0
    for i, r in after.items():
        spans = find(before[i].text)
        touched += bool(spans)
        if not spans:
            assert r == before[i]
            continue
        assert r.n_chars == len(r.text) and test_secret_scan.base_spans(r.text) == []
        rest, at = [], 0
        for _, a, b in spans:
            if a >= at:
                rest += [before[i].text[at:a], "[SECRET]"]
            at = max(at, b)
        assert r.text == "".join([*rest, before[i].text[at:]])
    assert touched


def test_mixing_stage(stages):
    docs, mixed = stages["mixing"]
    want = Counter(i for i, _, _ in test_mixing.brute([(r.doc_id, r.text, r.source) for r in docs.collect()]))
    assert Counter(r.doc_id for r in mixed.collect()) == want
    assert set(rows(mixed)) == set(rows(docs))


def test_packing_stage(stages):
    docs, packed = stages["packing"]
    frame = packed.toPandas()
    got = Counter(zip(frame.doc_id, frame.piece, frame.start, frame.length, frame.ids_crc32))
    assert got == Counter(test_packing.expected([(r.doc_id, r.text) for r in docs.collect()]))
    test_packing.check_sequences(frame)


def test_run_equals_the_stages(spark, stages):
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(corpus_pipeline.run(spark, "/root/testdata/sf0.001").select(*pieces)) == rows(stages["packing"][1].select(*pieces))


def test_odd_and_empty_rows(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (8, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, odd_docs.filter(F.lit(False))):
        count = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            new = materialize(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert new.columns == docs.columns
            docs = new
        assert (docs.count() > 0) == (count > 0)


def test_stages_keep_batches_small_and_give_memory_back(spark, monkeypatch):
    """Executors live on between the stages, and so do the buffers of batches and what the workers hold."""
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "some words here", "en", "web", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        for stage in (corpus_pipeline.near_duplicate_stage, corpus_pipeline.secret_stage, corpus_pipeline.packing_stage):
            spark.conf.set(name, "10000")
            stage(spark, docs, "")
            assert int(spark.conf.get(name)) <= corpus_pipeline.BATCH_ROWS
    finally:
        spark.conf.set(name, before)
    given = []
    monkeypatch.setattr(secret_scan, "give_back", lambda: given.append(1))
    assert len(list(secret_scan._each(iter([pa.RecordBatch.from_pydict({"text": ["a", None]})]), lambda text: []))) == 1
    assert given == [1]
