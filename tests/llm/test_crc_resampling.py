import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from hazardlake.llm import crc_resampling


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def features_of(text):
    w = words_of(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(rows, target, n_buckets=10_000, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    raw = Counter(bucket(f) for _, t in rows for f in features_of(t))
    aim = Counter(bucket(f) for t in target for f in features_of(t))
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + n_buckets) / ((raw[b] + 1) * (t + n_buckets))))
    scored = []
    for doc_id, text in rows:
        found = features_of(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append([doc_id, len(found), weight, score, None, len(words_of(text))])
    able = [r for r in scored if r[5] >= 20]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in scored), key=str)


@pytest.mark.parametrize("distances", [4, 7, 64])
def test_crc32_spans(distances, monkeypatch):
    monkeypatch.setattr(crc_resampling, "SPAN_BYTES", 500)
    rng = np.random.default_rng(distances)
    buffer = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 2500, 400)
    sizes = np.concatenate([np.arange(1, 201), rng.integers(1, 480, 200)])
    table = crc_resampling.position_table(distances)
    found = crc_resampling.crc32_spans(buffer, starts, starts + sizes, table)
    assert found.tolist() == [zlib.crc32(buffer[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
    assert crc_resampling.length_constants(table).tolist() == [zlib.crc32(bytes(n)) for n in range(distances + 1)]


def run(spark, rows, target, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, crc_resampling.resample(docs, aim, **more).collect()), key=str)


def test_resample_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["naïve", "中文字", "x" * 90, "Y" * 200, "a-b", "ÀÉ"]
    text = lambda n, words: rng.choice([" ", "\n", " - "]).join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.choice([0, 3, 19, 20, 21, 80, 400]), vocabulary)) for i in range(200)]
    target = [text(50, vocabulary[:40]) for _ in range(30)] + [None, ""]
    assert run(spark, rows, target) == brute(rows, target)
    assert run(spark, rows, target, percent=60, n_buckets=50) == brute(rows, target, 50, 60)


def test_resample_odd_rows(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    rows += [(7, rows[5][1])] * 30 + [(None, rows[5][1])] * 5  # ties: equal rows and rows without id
    clash = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as weight", "'r' as rank", "2 as place", "3 as n_words")
    aim = spark.createDataFrame([("one two three",)], "text string")
    found = sorted(map(tuple, crc_resampling.resample(clash, aim).collect()), key=str)
    expected = brute(rows, ["one two three"])
    assert [r[:4] for r in found] == [r[:4] for r in expected]
    # Equal rows may swap their ranks, but the same ranks go to the same ids.
    assert sorted((r[4], str(r[0])) for r in found if r[4]) == sorted((r[4], str(r[0])) for r in expected if r[4])


def test_resample_empty_tables(spark):
    assert run(spark, [], ["some words"]) == []
    rows = [(1, "a b"), (2, None)]
    assert run(spark, rows, []) == brute(rows, [])
