"""Held-out accuracy of the two text classifiers, and their awkward rows."""

import math
import random
import struct

import numpy as np
import pytest
import xxhash

from hazardlake.llm import quality, queries, toxicity
from hazardlake.llm.words import find_words


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        text = words(rng, rng.randint(3, 120)).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["idiot", "Moron!", "scum,"]))
        rows.append((i, " ".join(text), rng.choice(["en", "de", None])))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(toxic):
    docs, labels = toxic
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 900 and 120 < len(held) < 240
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.flagged == (r.score >= r.threshold) for r in rows)


def test_toxicity_learns_from_every_label(spark):
    """A word that only the last documents in order of hashes have is learned too, whatever the partitions."""
    rng = random.Random(2)
    ids = spark.range(4400).selectExpr("id", "xxhash64(id) as h").orderBy("h")
    rows = []
    for place, r in enumerate(ids.collect()):
        bad = r.id % 2 == 0
        rows.append((r.id, words(rng, rng.randint(4, 12)) + (" idiot" if place < 3700 else " scum") * bad, "en", int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    docs, labels = table.drop("toxic"), table.select("doc_id", "toxic")
    net = toxicity.fit(docs, labels)
    asked = spark.createDataFrame([(0, "abc scum def"), (1, "abc idiot def"), (2, "abc def")], "doc_id long, text string")
    assert [r.score >= 0.5 for r in toxicity.score(asked, net).orderBy("doc_id").collect()] == [True, True, False]
    again = toxicity.fit(docs.repartition(5), labels.repartition(3))
    assert net.offset == again.offset and (net.last == again.last).all() and (net.embeddings == again.embeddings).all()


def test_toxicity_cuts(spark):
    """Cuts of all rows and of each language against a plain search."""
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de", None]), y, round(rng.gauss(2 * y, 1), 2)) for y in rng.choices([0, 1], [5, 1], k=600)]
    found = {r.lang: r.z for r in toxicity.cuts(spark.createDataFrame(rows, "lang string, y int, z double")).collect()}
    assert set(found) == {None, "", "en", "de"}
    for name, z in found.items():
        mine = [r for r in rows if name is None or (r[0] or "") == name]

        def f1(cut):
            taken = [y for _, y, v in mine if v >= cut]
            return 2 * sum(taken) / (len(taken) + sum(y for _, y, _ in mine))

        assert f1(z) == pytest.approx(max(f1(v) for _, _, v in mine))


def test_toxicity_scores_from_text_alone(toxic, odd_docs):
    docs, labels = toxic
    net = toxicity.fit(docs, labels)
    rows = toxicity.score(odd_docs, net).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    # The same text scores alike wherever it stands in a batch, and without words as an empty one.
    texts = ["a idiot", "b c", "", None, " \n", "b c", "idiot", "a"]
    spark = docs.sparkSession
    for order in (texts, texts[::-1]):
        frame = spark.createDataFrame(list(enumerate(order)), "doc_id long, text string").coalesce(1)
        got = {}
        for r in toxicity.score(frame, net).collect():
            got.setdefault(order[r.doc_id] or "", set()).add(round(r.score, 9))
        assert all(len(v) == 1 for v in got.values()) and got[""] == got[" \n"]


def test_toxicity_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.classify(odd_docs, none).collect()} == {0}
    assert toxicity.classify(odd_docs.limit(0), none).count() == 0


def test_scores_by_plain_loops(spark, small):
    """Every score again, word by word and filter by filter."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = docs.select("doc_id", "text").collect()
    found = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    place = {int(w): i for i, w in enumerate(net.words)}
    blank = np.zeros(net.embeddings.shape[1], np.float32)
    assert len(place) > 20 and len(found) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[::3]:
        hashes = find_words([(r.text or "").encode()], toxicity.PUNCTUATED).hashes.tolist()
        vectors = [net.embeddings[place[h]] if h in place else blank for h in hashes]
        z = float(net.last[-1]) + net.offset
        for k, (filters, bias) in enumerate(zip(net.filters, net.biases)):
            for f in range(filters.shape[2]):
                best = bias[f]
                for at in range(len(vectors)):
                    value = bias[f]
                    for j in range(len(filters)):
                        if at + j < len(vectors):
                            value = value + vectors[at + j] @ filters[j][:, f]
                    best = max(best, value)
                z += max(float(best), 0.0) * float(net.last[k * filters.shape[2] + f])
        assert found[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_vocabulary_bounds_are_parameters(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    assert len(toxicity.fit(docs, labels, kept_words=7).words) == 7
    assert len(toxicity.fit(docs, labels, least_documents=1).words) > len(toxicity.fit(docs, labels, least_documents=20).words)


def test_quality_keys_and_kept_set(spark, small):
    """Key of every document from its weight and draw, and the kept set as the largest keys."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = quality.resample(docs, labels, keep=77).collect()

    def draw(doc_id):
        inner = xxhash.xxh64_intdigest(struct.pack("<i", 17), 42)
        signed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), inner)
        return (signed % (1 << 52) + 0.5) / (1 << 52)

    for r in rows:
        assert r.key == pytest.approx(r.log_weight - math.log(-math.log(draw(r.doc_id))), abs=1e-9)
    kept = sorted(rows, key=lambda r: -r.key)[:77]
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in kept}


def test_network_gradient_learns_word_order():
    """Two-word filters tell 'a b' from 'b a'."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for i in range(600):
        t = rng.integers(10, 40, 12).astype(np.uint64)
        at = rng.integers(0, 11)
        t[at : at + 2] = [1, 2] if i % 2 else [2, 1]
        texts.append(t)
        y.append(i % 2)
    y = np.array(y)
    net = toxicity.train(texts, y)
    z = toxicity.logits(net, toxicity._tables(net), np.concatenate(texts), np.repeat(np.arange(600), 12), 600)
    assert ((z > 0) == (y == 1)).mean() > 0.9


def test_quality_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op10_quality_resampling(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000
    known = [r for r in rows if r.quality is not None]
    assert np.mean([r.kept for r in known if r.quality == 1]) >= 0.99
    assert np.mean([r.kept for r in known if r.quality == 0]) <= 0.1


def test_quality_weights_by_hand(spark):
    """Weights equal the log ratio of add-one bucket shares, counted one by one."""
    texts = {1: "good good, day", 2: "bad!! bad!! bad!!", 3: "good day", 4: "", 5: None, 6: "Bad!! day"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (2, 0)], "doc_id long, quality int")
    n = 64
    grams = {}
    for i, t in texts.items():
        bucket, _ = quality.buckets([(t or "").encode()], n)
        grams[i] = bucket.tolist()
    assert grams[1].count(grams[1][0]) >= 2 and len(grams[2]) == 6 + 5
    raw = [b for g in grams.values() for b in g]
    aim = grams[1] + grams[3]
    ratio = [math.log((aim.count(b) + 1) / (len(aim) + n)) - math.log((raw.count(b) + 1) / (len(raw) + n)) for b in range(n)]
    got = {r.doc_id: r for r in quality.resample(docs, labels, n_buckets=n).collect()}
    for i, g in grams.items():
        assert got[i].log_weight == pytest.approx(sum(ratio[b] for b in g), abs=1e-9)


def test_quality_cut_does_not_depend_on_the_sample(spark):
    """Rejected documents that look like wanted ones count by their number in the table, not in the sample."""
    texts = ["good fine words"] * 30 + ["mixed other lines"] * 10 + ["mixed other lines"] * 200 + ["bad worse trash"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(len(texts))], "doc_id long, quality int")
    whole, thin = (quality.fit(docs, labels, n_buckets=1024, sample=n).cut for n in (1000, 40))
    assert thin == pytest.approx(whole)


@pytest.mark.parametrize("band", [5, 1000])
def test_kth_largest(spark, band):
    values = [random.Random(i).choice([random.Random(i).random(), 0.5]) for i in range(400)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 17, 200, 399, 400):
        assert quality.kth_largest(frame, "v", k, band) == sorted(values, reverse=True)[k - 1]


def test_kth_largest_of_few_values(spark):
    """Two values that repeat far beyond the band end the search at once."""
    frame = spark.createDataFrame([(float(i % 2),) for i in range(200)] + [(0.5,)] * 30, "v double")
    ordered = sorted([float(i % 2) for i in range(200)] + [0.5] * 30, reverse=True)
    for k in (1, 99, 100, 101, 115, 130, 131, 230):
        assert quality.kth_largest(frame, "v", k, 10) == ordered[k - 1]


def test_quality_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.resample(odd_docs, none).collect()
    assert len(rows) == odd_docs.count() and all(r.kept and r.log_weight == 0 for r in rows)
    some = spark.createDataFrame([(4, 1), (5, 1), (8, 0), (8, None), (None, 1)], "doc_id long, quality int")
    out = quality.resample(odd_docs, some, keep=3)
    assert out.columns == [*odd_docs.columns, "log_weight", "key", "kept"]
    keys = sorted((r.key for r in out.collect()), reverse=True)
    assert sum(r.kept for r in out.collect()) == sum(k >= keys[2] for k in keys)
    assert quality.resample(odd_docs.limit(0), some).count() == 0
