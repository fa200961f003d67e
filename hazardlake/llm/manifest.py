"""Merkle manifest of a dataset that stores only every few levels of its trees.

A tree's level is a table of (tree, place, of, digest). ``build`` writes the leaves' level and every
``LEVELS``-th above it. What lies between is never stored: ``prove`` takes the stored nodes below
one stored node, an aligned subtree of at most 2^LEVELS, works the missing levels out again,
emits every node's siblings and drops them. A task holds one subtree, whatever a tree's size.

Digests are lower-case hex SHA-256, and inner nodes hash the hex text of their children. While a
level has several nodes, each two consecutive ones become one; a last single one is hashed alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.operators.numbering import numbered
from hazardlake.session import materialize

#: Levels of a tree from one stored level to the next.
LEVELS = 8

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields one after another: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def parents(nodes: list[str]) -> list[str]:
    """The next level of a run of consecutive nodes that starts at an even place."""
    return [sha256("".join(nodes[i : i + 2]).encode()).hexdigest() for i in range(0, len(nodes), 2)]


def depth(of: int, levels: int) -> int:
    """Levels to the next stored one, or to the root where that comes first."""
    return levels if of > 1 << levels else (of - 1).bit_length()


def build(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The stored levels of the trees of ``leaves`` (tree, place, of, digest), the leaves' first.

    The last level holds one row a tree, its root; the root of a tree with one leaf is that leaf.
    ``place`` counts from 0 in a tree, ``of`` is the number of its nodes at that level; ``tree`` must
    not be null. An empty table has its own level only.
    """
    def fold(group: pa.Table) -> pa.Table:
        nodes = group.sort_by("place")["digest"].to_pylist()
        of = group["of"][0].as_py()
        for _ in range(depth(of, levels)):
            nodes = parents(nodes)
        return pa.table({
            "tree": group["tree"].slice(0, 1), "place": group["block"].slice(0, 1),
            "of": pa.array([-(-of >> levels)], pa.int64()), "digest": nodes,
        })

    stored, now = [leaves], leaves.select("tree", "place", "of", "digest")
    kind = now.schema["tree"].dataType.simpleString()
    while (now.agg(F.max("of")).first()[0] or 0) > 1:
        blocks = now.withColumn("block", F.shiftright("place", levels)).groupBy("tree", "block")
        now = materialize(blocks.applyInArrow(fold, f"tree {kind}, place long, of long, digest string"), "level")
        stored.append(now)
    return stored


def prove(stored: Sequence[DataFrame], levels: int = LEVELS, above: DataFrame | None = None) -> DataFrame:
    """The leaves of ``build``'s levels with ``top``, their tree's root, and ``proof``.

    A proof is one text a level, from the leaf up: ``l`` or ``r`` (the sibling's side) and the
    sibling's digest, or an empty text where the node has none. ``above`` (tree, proof) goes on
    where a tree is itself a leaf of a larger one. All columns of the leaves are kept.
    """
    def expand(nodes: pa.Table, higher: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("place")
        of, now = nodes["of"][0].as_py(), nodes["digest"].to_pylist()
        paths: list[list[str]] = [[] for _ in now]
        for k in range(depth(of, levels)):
            steps = [
                "l" + now[i - 1] if i & 1 else "r" + now[i + 1] if i + 1 < len(now) else "" for i in range(len(now))
            ]
            for i, path in enumerate(paths):
                path.append(steps[i >> k])
            now = parents(now)
        rest = higher["proof"][0].as_py()
        nodes = nodes.drop_columns(["block"]).append_column("top", pa.array(higher["top"].to_pylist() * len(paths), pa.string()))
        return nodes.append_column("proof", pa.array([p + rest for p in paths], pa.list_(pa.string())))

    proofs = stored[-1].withColumn("top", F.col("digest"))
    if above is None:
        proofs = proofs.withColumn("proof", F.array().cast("array<string>"))
    else:
        proofs = proofs.join(above.select("tree", "proof"), "tree")
    for i, nodes in enumerate(reversed(stored[:-1])):
        if i:
            proofs = materialize(proofs, "proofs")
        names = [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema]
        lower = nodes.withColumn("block", F.shiftright("place", levels)).groupBy("tree", "block")
        upper = proofs.select("tree", F.col("place").alias("block"), "top", "proof").groupBy("tree", "block")
        proofs = lower.cogroup(upper).applyInArrow(expand, ", ".join([*names, "top string", "proof array<string>"]))
    return proofs


def fold_proof(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and proof lead to."""
    def step(node: Column, sibling: Column) -> Column:
        other = F.substring(sibling, 2, 64)
        return F.sha2(
            F.when(sibling == "", node).when(F.startswith(sibling, F.lit("l")), F.concat(other, node)).otherwise(F.concat(node, other)), 256
        )

    return F.aggregate(proof, digest, step)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, proof) of every row of ``docs``.

    Rows of one ``lang`` (null is one of its own) make a tree, in order of doc_id; the roots of these, in bytewise order
    of lang, make the tree of ``root``. ``changed`` is the leaf with one more in n_chars where 7
    divides the CRC-32 of the decimal doc_id, else ``leaf`` itself; a null n_chars stays null and a row without doc_id
    is left as it is. Rows without doc_id come first; equal doc_ids follow their leaves' digests,
    and repeated rows are leaves of their own. Empty and long texts are hashed whole. Extra columns are ignored.
    An empty table gives an empty one.
    """
    fields = {f: F.col(f) for f in FIELDS}
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    hashed = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("tree"),
        leaf_digest(list(fields.values())).alias("digest"),
        F.when(struck, leaf_digest(list((fields | {"n_chars": F.col("n_chars") + 1}).values()))).alias("changed"),
    )
    placed = numbered(hashed, [F.col("doc_id").asc(), F.col("digest").asc()], "tree")
    languages = build(placed, levels)
    subroots = languages[-1].select(F.col("tree").alias("lang"), "digest").withColumn("tree", F.lit(0))
    whole = build(numbered(subroots, [F.col("lang").asc()], "tree"), levels)
    root = whole[-1].first()
    above = prove(whole, levels).select(F.col("lang").alias("tree"), "proof")
    proofs = prove(languages, levels, above)
    return proofs.select(
        "doc_id", F.col("digest").alias("leaf"), F.coalesce("changed", "digest").alias("changed"),
        F.col("top").alias("subroot"), F.lit(root.digest if root else None).cast("string").alias("root"), "proof",
    )


def verify(manifest: DataFrame) -> DataFrame:
    """Every row of a manifest checked: its proof's digest, and the root its changed leaf leads to."""
    folded = manifest.withColumns({
        "proof_sha256": proof_digest(F.col("proof")), "folded_root": fold_proof(F.col("changed"), F.col("proof")),
    })
    return folded.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
