import hashlib
import math
import re
from collections import Counter

import pytest

from hazardlake.llm import mixing


def place(seed, pass_, doc_id):
    text = f"{seed}:{pass_}:{'null' if doc_id is None else doc_id}"
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def brute(rows, repetition=2.0, seed=23):
    """Copies (doc_id, source, pass) of rows (doc_id, text, source) for a repetition limit."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    n = Counter()
    for _, t, s in rows:
        n[s] += size(t)
    known = {s: v for s, v in n.items() if v}
    spread = max(known.values()) / min(known.values())
    alpha = 1 - min(1, math.log(repetition) / math.log(spread)) if spread > 1 else 0
    out = []
    for s, v in n.items():
        repeats = (v / max(known.values())) ** (alpha - 1) if v else 1
        passes = math.floor(repeats + 1e-7)
        rest = (repeats - passes) * v if repeats - passes > 1e-7 else 0
        mine = [(place(seed, passes, i), i, size(t)) for i, t, x in rows if x == s]
        for key, i, _ in mine:
            upto = sum(z for k, _, z in mine if k <= key)
            own = sum(z for k, _, z in mine if k == key)
            more = rest > 0 and upto - own / 2 <= rest
            out += [(i, s, p) for p in range(passes + more)]
    return sorted(out, key=str)


def got(docs, **how):
    return sorted(((r.doc_id, r.source, r["pass"]) for r in mixing.mix(docs, **how).collect()), key=str)


@pytest.mark.parametrize("block_rows", [7, 50_000])
def test_repetition_limit(spark, block_rows):
    rows = [(i, "w " * (1 + i % 50), "big" if i % 3 else f"s{i % 7}" if i % 2 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    assert got(docs, block_rows=block_rows) == brute(rows)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = got(docs)
    assert out == brute([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert {i for i, _, _ in out} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_odd_rows(spark, odd_docs):
    mixed = mixing.mix(odd_docs.withColumnRenamed("node", "pass"))
    assert mixed.columns == [*(c for c in odd_docs.columns if c != "node"), "pass", "place"]
    assert mixed.count() == odd_docs.count()  # a single source keeps its share
    assert mixing.mix(odd_docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert got(blank) == [(1, "a", 0), (2, None, 0)]


def test_entropy_and_budget(spark):
    rows = [(i, "x " * 10, "a" if i < 700 else "b" if i < 900 else "c") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = mixing.shares(docs.withColumn("tokens", mixing.F.lit(10)))
    target = 0.95
    found = mixing.temper(sources, repetition=None, entropy=target)
    w = [p**found.alpha / found.total for p in (0.7, 0.2, 0.1)]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(target, abs=1e-6)
    out = got(docs, repetition=None, entropy=target, budget=5000.0)
    counts = Counter(s for _, s, _ in out)
    assert [counts[s] * 10 / 5000 for s in "abc"] == pytest.approx(w, abs=0.003)
    assert mixing.temper(sources, repetition=1.0).alpha == 1.0


def test_native_plan(spark, small):
    plan = mixing.mix(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
