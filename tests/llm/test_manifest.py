import zlib
from hashlib import sha256

import pytest

from hazardlake.llm import manifest

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root of a list of digests and every node's siblings, None where it has none."""
    paths, now, k = [[] for _ in nodes], list(nodes), 0
    while len(now) > 1:
        for i, path in enumerate(paths):
            at = i >> k
            other = at ^ 1
            path.append((other < at, now[other]) if other < len(now) else None)
        now, k = [H(*now[i : i + 2]) for i in range(0, len(now), 2)], k + 1
    return (now[0] if now else None), paths


def brute(rows):
    """The rows of the query by a plain walk; rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row, leaf(row)))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rows_of in groups.values():
        rows_of.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    subs = {lang: tree([d for _, d in groups[lang]]) for lang in order}
    root, upper = tree([subs[lang][0] for lang in order])
    out = []
    for lang, above in zip(order, upper):
        for (row, digest), path in zip(groups[lang], subs[lang][1]):
            changed = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                changed[3] += 1
            node, siblings = leaf(changed), [*path, *above]
            for step in siblings:
                node = H(node) if step is None else H(step[1], node) if step[0] else H(node, step[1])
            proof = H(*(s[1] for s in siblings if s))
            out.append((row[0], digest, subs[lang][0], root, proof, node, node == root))
    return sorted(out, key=str)


def run(docs, levels):
    return sorted(map(tuple, manifest.verify(manifest.document_manifest(docs, levels)).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_manifest_brute_force(spark, levels):
    rows = [(i * 3, f"s{i % 4}", ["en", "fr", None, "é"][min(3, i % 7 // 2)], None if i % 11 == 0 else i, f"text é {i}") for i in range(83)]
    rows += [(500, None, "only", 1, "a lone leaf"), (501, "", "", 0, "")]
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(5), levels) == brute(rows)


def test_manifest_odd_rows(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select(*COLUMNS).collect()] * 2
    docs = odd_docs.union(odd_docs).withColumnsRenamed({"node": "tree", "bucket": "place", "gram": "digest"})
    assert run(docs, 2) == brute(rows)


def test_manifest_empty(spark, odd_docs):
    found = manifest.verify(manifest.document_manifest(odd_docs.limit(0)))
    assert found.count() == 0 and "verified" in found.columns


def test_a_forged_sibling_is_found(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(20)]
    made = manifest.document_manifest(spark.createDataFrame(rows, SCHEMA), 2)
    forged = made.selectExpr("doc_id", "leaf", "leaf as changed", "subroot", "root", "transform(proof, s -> replace(s, 'a', 'b')) as proof")
    assert not any(r.verified for r in manifest.verify(forged).collect())
