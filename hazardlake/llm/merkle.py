"""Document fingerprints as Merkle trees over paragraphs and sections, in DataFrame functions only.

A text is cut at line ends into paragraphs; a section ends after an empty paragraph or one whose
hash falls on a fixed residue, so that an edit moves no boundary but its own. Hashes of the
paragraphs make a section's, those of the sections the root. Below the paragraphs lie phrases:
their 64-bit leaves measure how much two trees have in common.
"""

from __future__ import annotations

import os
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hazardlake.session import materialize

#: Phrases end at a mark of punctuation or a line end, and after 80 characters at the latest.
PHRASE = r"[^.,;:!?|\n]{0,80}[.,;:!?|\n]|[^.,;:!?|\n]{1,80}"
#: First hex digits of a paragraph's hash that end a section.
SECTION_ENDS = "01"
#: Weight that one window sorts, and the characters for which a text weighs 1 more.
BUCKET_WEIGHT, UNIT = 2048, 4096
#: Cut points that come to the driver at most; buckets of larger tables grow.
MOST_BUCKETS = 100_000
#: Largest table of bucket borders that is broadcast (an id and three numbers a row).
BROADCAST_IDS = 1_000_000


def tree(text: Column) -> Column:
    """struct(root, sections, paragraphs): hex hashes of the whole, of each section and each paragraph."""
    paragraph = F.transform(F.split(text, "\n", -1), lambda p: F.struct(F.sha2(p, 256).alias("h"), (p == "").alias("blank")))
    marked = F.transform(
        paragraph,
        lambda x: F.concat(x.h, F.when(x.blank | F.left(x.h, F.lit(1)).isin(*SECTION_ENDS), ";").otherwise(",")),
    )
    sections = F.transform(F.split(F.rtrim(F.array_join(marked, ""), F.lit(",;")), ";", -1), lambda s: F.sha2(s, 256))
    return F.struct(
        F.sha2(F.array_join(sections, ","), 256).alias("root"),
        sections.alias("sections"),
        F.transform(paragraph, lambda x: x.h).alias("paragraphs"),
    )


def root(text: Column) -> Column:
    """Root hash; equal roots mean equal texts."""
    return tree(text)["root"]


def leaves(text: Column) -> Column:
    """Distinct phrase leaves: 57 bits of hash, and the phrase's length in the low 7 bits."""
    leaf = lambda s: F.shiftleft(F.xxhash64(s), 7).bitwiseOR(F.length(s).cast("long"))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)), leaf))


def _weight(leaf_list: Column) -> Column:
    return F.aggregate(leaf_list, F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(127)))


def likeness(a: Column, b: Column) -> Column:
    """Share of characters in common phrases, 0 to 1; 1 for two empty texts."""
    total = _weight(a) + _weight(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * _weight(F.array_intersect(a, b)) / total)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, root, sections, paragraphs, leaves) of every row; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", tree(text).alias("t"), leaves(text).alias("leaves")).select("doc_id", "t.*", "leaves")


def locate_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """Where two versions differ, from their fingerprints: (doc_id, same, sections, paragraphs).

    ``sections`` and ``paragraphs`` are the places (from 0) in ``after`` whose hashes ``before``
    lacks; only documents with different roots are looked into. Ids of one side only are left out.
    """
    a, b = before.alias("a"), after.alias("b")
    same = F.col("a.root") == F.col("b.root")

    def places(name: str) -> Column:
        new = F.array_except(F.col(f"b.{name}"), F.col(f"a.{name}"))
        marked = F.transform(F.col(f"b.{name}"), lambda h, i: F.when(F.array_contains(new, h), i))
        return F.when(same, F.array().cast("array<int>")).otherwise(F.filter(marked, lambda i: i.isNotNull()))

    return a.join(b, F.col("a.doc_id") == F.col("b.doc_id")).select(
        "a.doc_id", same.alias("same"), places("sections").alias("sections"), places("paragraphs").alias("paragraphs")
    )


def _leading(value: Column, skip: int = 0) -> Column:
    """The six bytes of a string after the first ``skip`` as a number; it never falls as strings rise."""
    some = F.hex(F.substring(F.encode(value, "UTF-8"), skip + 1, 6))
    return F.conv(F.rpad(some, 12, "0"), 16, 10).cast("double")


def _weight_of(text: Column) -> Column:
    return (F.floor(F.length(text) / UNIT) + 1).cast("int")


def _cuts(rows: DataFrame, key: str, parts: int) -> list[float]:
    """Quantiles of ``key`` that cut ``rows`` into ``parts`` of about the same weight; they may repeat."""
    if parts < 2:
        return []
    weighted = rows.select(key, F.explode(F.sequence(F.lit(1), _weight_of(F.col("text")))).alias("__unit"))
    return sorted(weighted.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts))


def _dealt(rows: DataFrame, key: str, cuts: list[float], name: str) -> DataFrame:
    if not cuts:
        return rows.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    return Bucketizer(splits=splits, inputCol=key, outputCol=name, handleInvalid="keep").transform(rows)


def with_next(docs: DataFrame, bucket_weight: int = BUCKET_WEIGHT) -> tuple[DataFrame, Window]:
    """Rows (bucket, edge, doc_id, text) and the window in whose order the next row follows.

    The order is by doc_id (null first), then text, and goes from the last row to the first.
    doc_id may be of a numeric or text type. It is cut at quantiles into buckets of about
    ``bucket_weight``; a text weighs 1, and 1 more for every ``UNIT`` characters. Rows without
    doc_id, and those of an id that fills whole buckets, are cut by the first bytes of their texts
    too. Only the cut points, at most ``MOST_BUCKETS``, come to the driver. Each bucket also
    gets the first row of the bucket after it, marked ``edge``, to be dropped at the end. A window
    sorts one bucket and spills what memory can't hold.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own, weight = F.col("doc_id"), _weight_of(F.col("text")).cast("long")
    total, without, least, largest = docs.agg(
        F.sum(weight), F.sum(F.when(own.isNull(), weight)), F.min("doc_id"), F.max("doc_id")
    ).first()
    parts = max(1, min(MOST_BUCKETS, -(-(total or 0) // bucket_weight)))
    if isinstance(docs.schema["doc_id"].dataType, StringType):
        common = os.path.commonprefix([(least or "").encode(), (largest or "").encode()])
        keyed = docs.withColumn("__k", _leading(own, len(common)))
    else:
        keyed = docs.withColumn("__k", own.cast("double"))
    cuts = _cuts(keyed, "__k", parts)
    # Of ids between which a quantile lies more than once, those that are one id and not several alike in the key.
    full = {k: n for k, n in Counter(cuts).items() if n > 1}
    single = []
    if full:
        ends = keyed.filter(F.col("__k").isin(list(full))).groupBy("__k").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        single = [r.a for r in ends.filter("a = b").collect()]
    hot = own.isNull() | own.isin(single) if single else own.isNull()
    keyed = keyed.withColumn("__t", F.when(hot, _leading(F.col("text"))).otherwise(F.lit(0.0)))
    inner = _cuts(keyed.filter(hot), "__t", min(parts, -(-(without or 0) // bucket_weight) + sum(full.values())))
    placed = _dealt(_dealt(keyed, "__k", cuts, "__outer"), "__t", inner, "__inner")
    outer = F.when(own.isNull(), 0).otherwise(F.col("__outer") + 1)
    # A hot id begins its bucket; the other ids there follow it.
    inside = F.when(hot, F.col("__inner")).otherwise(len(inner) + 1)
    dealt = placed.select((outer * (len(inner) + 2) + inside).cast("long").alias("bucket"), "doc_id", "__t", "text")
    # One row a bucket.
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "__t")).alias("f"))
    by = Window.orderBy("bucket")
    last = F.last("bucket").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moves = materialize(firsts.select(
        F.col("bucket").alias("__b"), F.col("f.doc_id").alias("__id"), F.col("f.__t").alias("__first"),
        F.coalesce(F.lag("bucket").over(by), last).alias("to"),
    ), "moves")
    buckets = moves.count()
    meets = (F.col("bucket") == F.col("__b")) & own.eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__first"))
    edges = (
        dealt.join(F.broadcast(moves) if buckets <= BROADCAST_IDS else moves, meets)
        .groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    )
    both = dealt.select("bucket", F.lit(False).alias("edge"), "doc_id", "text").union(
        edges.select(F.col("to").alias("bucket"), F.lit(True), "doc_id", "text")
    )
    # Tasks grow in number with the table, not in size.
    return both.repartition(max(1, -(-buckets // 2)), "bucket"), Window.partitionBy("bucket").orderBy("edge", "doc_id", "text")


def compare_with_next(docs: DataFrame, bucket_weight: int = BUCKET_WEIGHT) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points replaced by
    the first as many (or all) of the next document, by ascending doc_id, the first following
    the last. Every row comes back once; a null text is empty; a single row follows itself; rows
    that share a doc_id, or have none, follow each other by text. doc_id may be of a numeric or
    text type. Extra columns are ignored; an empty table gives an empty one. Likeness of two empty
    texts is 1.
    """
    rows, window = with_next(docs, bucket_weight)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    ahead = rows.withColumn("__next", F.lead("text").over(window)).withColumn("__own", leaves(F.col("text")))
    ahead = ahead.withColumn("__after", F.lead("__own").over(window)).filter(~F.col("edge"))
    edited = ahead.select(
        "doc_id", "text", "__own", "__after", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("__next", F.lit(1), half)).alias("__edited"),
    )
    return edited.select(
        "doc_id", "n_chars",
        F.sha2("__edited", 256).alias("edited_sha256"),
        root(F.col("text")).alias("fingerprint"),
        root(F.col("__edited")).alias("edited_fingerprint"),
        likeness(F.col("__own"), leaves(F.col("__edited"))).alias("near_edited"),
        likeness(F.col("__own"), F.col("__after")).alias("near_next"),
    )
