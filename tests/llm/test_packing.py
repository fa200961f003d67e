import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazardlake.llm import packing, queries

PATH = queries.word_vocabulary()


def expected(texts, capacity=2048):
    model = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in texts:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out.append((doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check_sequences(rows, capacity=2048):
    for _, group in rows.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert (group.offset.to_numpy() == np.cumsum(group.length) - group.length).all()
        assert group.length.sum() <= capacity


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = queries.op1_best_fit_packing(spark, small).toPandas()
    got = Counter(zip(rows.doc_id, rows.piece, rows.start, rows.length, rows.ids_crc32))
    assert got == Counter(expected([(r.doc_id, r.text) for r in docs.collect()]))
    check_sequences(rows)
    least = -(-rows.length.sum() // 2048)
    assert rows.sequence_id.nunique() <= least * 1.02 + 1


def test_odd_rows(odd_docs):
    rows = packing.pack(packing.pieces(odd_docs, PATH)).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == Counter(expected([(r.doc_id, r.text) for r in odd_docs.collect()]))


def test_white_space_and_marks(spark):
    texts = ["a\x0bb\x0c\x1c c", "é é ́x", "it's we'll 'S", "<|endoftext|> <|STARTOFTEXT|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|", "It<|ENDOFTEXT|>s x<|endoftext|>'s", "İstanbul ΣΑΣ Σ. ẞ", "  .", "　x\x85y", "1a2b,,.. ,"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.ids_crc32) for r in packing.pieces(docs, PATH).collect()}
    assert got == {(x[0], x[4]) for x in expected(enumerate(texts))}


@pytest.mark.parametrize("group_items", [40, 100_000])
def test_rounds(spark, group_items):
    items = spark.range(0, 600, numPartitions=6).select("id", (F.col("id") * 37 % 90 + 1).alias("length"), F.lit("x").alias("members"), F.lit(1).alias("fill"))
    rows = packing.pack(items, capacity=100, group_items=group_items).toPandas()
    assert sorted(rows.id) == list(range(600)) and set(rows.columns) == {"id", "length", "members", "fill", "sequence_id", "offset"}
    check_sequences(rows, 100)
    assert rows.sequence_id.nunique() <= rows.length.sum() / 100 * (1.15 if group_items == 40 else 1.05) + 1


def test_nothing_merges(spark):
    items = spark.range(0, 500, numPartitions=4).select("id", F.lit(60).cast("long").alias("length"))
    rows = packing.pack(items, capacity=100, group_items=50).toPandas()
    assert rows.sequence_id.nunique() == 500 and (rows.offset == 0).all()


def test_empty_and_wrong_lengths(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(empty, PATH)).count() == 0
    for bad in (0, 101, None):
        with pytest.raises(Exception, match="length outside"):
            packing.pack(spark.createDataFrame([(1, bad)], "id long, length long"), capacity=100).collect()


def test_ids_are_carried(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    row = packing.pieces(docs, PATH, with_ids=True).first()
    assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length
