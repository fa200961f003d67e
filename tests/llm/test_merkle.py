import hashlib
import re

import pytest
from pyspark.sql import functions as F

from hazardlake.llm import merkle

PIECE = re.compile(r"[^.,;:!?|\n]{0,80}[.,;:!?|\n]|[^.,;:!?|\n]{1,80}")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def root(text):
    sections, run = [], []
    for p in text.split("\n"):
        run.append(sha(p))
        if p == "" or run[-1][0] in "01":
            sections.append(run)
            run = []
    if run:
        sections.append(run)
    return sha(",".join(sha(",".join(s)) for s in sections))


def near(a, b):
    x, y = set(PIECE.findall(a)), set(PIECE.findall(b))
    size = lambda s: sum(map(len, s))
    return 2 * size(x & y) / (size(x) + size(y)) if x or y else 1.0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        e = t[: len(t) - h] + after[:h]
        out.append((i, len(t), sha(e), root(t), root(e), near(t, e), near(t, after)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_weight", [1000, 3])
def test_odd_rows(odd_docs, bucket_weight):
    got = merkle.compare_with_next(odd_docs, bucket_weight).collect()
    want = expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert [tuple(r)[:5] for r in sorted(map(tuple, got), key=str)] == [w[:5] for w in want]
    assert [r[5:] for r in sorted(map(tuple, got), key=str)] == [pytest.approx(w[5:]) for w in want]


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(map(tuple, merkle.compare_with_next(docs, 40).collect()), key=str)
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5:] == pytest.approx(w[5:]) for g, w in zip(got, want))


def rows_and_wanted(spark, rows, kind, bucket_weight):
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
    got = sorted(map(tuple, merkle.compare_with_next(docs, bucket_weight).collect()), key=str)
    want = expected(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5:] == pytest.approx(w[5:]) for g, w in zip(got, want))


@pytest.mark.parametrize("bucket_weight", [4, 1000])
def test_hot_ids(spark, bucket_weight):
    """Many rows without id, and many of one id: cut by their texts, in the right order."""
    rows = [(None, f"{i * 37 % 101} without an id, {i}.") for i in range(40)] + [(None, "the same text")] * 5
    rows += [(17, f"{i * 53 % 97} of a full id, {i}.") for i in range(40)] + [(17, "\u00e9t\u00e9"), (17, None), (17, "")]
    rows += [(i, f"text of {i}, short.") for i in range(40)] + [(-5, "below"), (2**60, "far"), (2**60 + 1, "far too")]
    rows_and_wanted(spark, rows, "long", bucket_weight)


@pytest.mark.parametrize("bucket_weight", [4, 1000])
def test_text_ids(spark, bucket_weight):
    rows = [(f"doc-{i * 7919 % 1000:04d}", f"text number {i}; end") for i in range(60)]
    rows += [("doc-", "short id"), ("doc-0500x", "longer id"), (None, "no id"), ("doc-0007", "an id twice"), ("doc-0007", None)]
    rows_and_wanted(spark, rows, "string", bucket_weight)


def test_buckets_by_length(spark):
    """Long texts fill a bucket sooner than short ones, and a bucket's window sees no others."""
    rows = [(i, "x" * (40_000 if i < 20 else 10)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, _ = merkle.with_next(docs, 50)
    held = dealt.filter("not edge").groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()
    assert sum(r.n for r in held) == 400 and len(held) > 8
    assert max(r["size"] for r in held) <= 400_000 and max(r.n for r in held) <= 100


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert merkle.compare_with_next(empty).count() == 0
    one = merkle.compare_with_next(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == sha("ab ab")


def test_locate_edits(spark):
    text = "\n".join(f"Paragraph number {i}." for i in range(40))
    before = merkle.fingerprints(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string"))
    after = merkle.fingerprints(
        spark.createDataFrame([(1, text), (2, text.replace("number 17", "no 17")), (3, "")], "doc_id long, text string")
    )
    found = {r.doc_id: r for r in merkle.locate_edits(before, after).collect()}
    assert found[1].same and found[1].paragraphs == [] and found[3].same
    assert not found[2].same and found[2].paragraphs == [17] and 1 <= len(found[2].sections) < 4


def test_native_plan(spark, small):
    plan = merkle.compare_with_next(spark.read.parquet(f"{small}/documents.parquet")).select(F.count(F.lit(1)))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
