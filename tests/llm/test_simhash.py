import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from hazardlake.llm import simhash


def fingerprint(text, n=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(words, distance):
    """Smallest member of the component of every word, by comparing all pairs."""
    root = {w: w for w in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= distance:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {w: find(w) for w in root}


def brute(rows, distance=4):
    prints = [fingerprint(t) for _, t in rows]
    of = classes(prints, distance)
    members = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            members.setdefault(of[p], []).append(doc_id)
    return sorted(((d, f"{p:016x}", min(members.get(of[p], []), default=None)) for (d, _), p in zip(rows, prints)), key=str)


def run(docs, **more):
    return sorted(map(tuple, simhash.simhash_components(docs, **more).collect()), key=str)


@pytest.mark.parametrize("segments, distance", [(1, 4), (2, 4), (2, 5), (4, 4), (1, 1)])
def test_near_words_share_an_anchor(segments, distance):
    rng = random.Random(segments)
    cover = simhash.Cover(distance, segments)
    first = [rng.getrandbits(64) for _ in range(60)]
    second = []
    for w in first:
        for b in rng.sample(range(64), rng.randint(max(0, distance - 1), distance)):
            w ^= 1 << b
        second.append(w)

    def anchors(words):
        held = [set() for _ in words]
        for segment, row, codeword in cover.anchors(np.array(words, dtype=np.uint64)):
            for r, c in zip(row.tolist(), codeword.tolist()):
                held[r].add((segment, c))
        return held

    assert all(a & b for a, b in zip(anchors(first), anchors(second)))


def test_codes_cover_perfectly():
    for part in simhash.parts_of(32):
        masks, starts = simhash.errors(part, 0)
        assert (np.diff(starts) == 1).all() and max(m.bit_count() for m in masks.tolist()) == part.radius


def close_words(rng, n):
    """Chains and clouds of words a few bits apart, and some far from all others."""
    words = set()
    for _ in range(6):
        w = rng.getrandbits(64)
        for _ in range(n):
            words.add(w)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                w ^= 1 << b
    return sorted(words | {rng.getrandbits(64) for _ in range(n)})


@pytest.mark.parametrize("block, segments", [(10_000, 2), (7, 2), (10_000, 1)])
def test_links_brute_force(spark, monkeypatch, block, segments):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(simhash, "TASK_ROWS", 700)
    words = close_words(random.Random(block), 40)
    if block < 100:  # one anchor of the upper half holds them all
        words += [(words[0] >> 32 << 32) | w for w in range(60)]
    signed = [(w - (1 << 64) if w >> 63 else w,) for w in sorted(set(words))]
    found = simhash.near_links(spark.createDataFrame(signed, "word long").repartition(3), segments=segments).collect()
    root = {w: w for w in words}
    plain = lambda x: x % (1 << 64)
    held = {frozenset((plain(r.a), plain(r.b))) for r in found}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in map(sorted, held):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    assert {w: find(w) for w in root} == classes(words, 4)


def test_components_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([2, 30, 300]))]
        for _ in range(25):
            new = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n", "  \t"]).join(new)))
    rng.shuffle(rows)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_components_odd_rows(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 2)
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    clash = odd_docs.withColumnsRenamed({"node": "word", "bucket": "component_id", "gram": "fingerprint"})
    assert run(clash) == brute(rows)
    assert run(odd_docs.limit(0)) == []
    alone = odd_docs.filter("doc_id is null")
    assert run(alone) == brute([tuple(r) for r in alone.select("doc_id", "text").collect()])
