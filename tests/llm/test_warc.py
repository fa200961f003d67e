import gzip
import hashlib
import random

from pyspark.sql import functions as F

from hazardlake.llm import warc
from hazardlake.session import scratch_path


def expected(rows):
    firsts, out = {}, []
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            firsts[data] = min(firsts.get(data, i), i)
    for i, html in rows:
        data = (html or "").encode()
        first = firsts.get(data)
        other = i is not None and first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other else "response", first if other else None))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}", h, "r", "k") for i, h in rows], "page_id long, url string, html string, record_type string, kind string")


def test_round_trip(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "x" * 300
    rows = [(3, long), (1, long), (2, long), (2, long), (4, "short"), (5, "short"), (6, None), (7, ""), (None, long), (8, "y" * 99), (9, "y" * 99), (10, "z" * 2_000_000)]
    got = warc.round_trip(pages(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_rotation_and_empty(spark):
    rows = [(i, f"<html>{random.Random(i).random()}" * 20) for i in range(60)]
    folder = scratch_path(spark, "warc")
    files = warc.write(pages(spark, rows).repartition(2), folder, file_bytes=2000)
    assert files.count() > 4 and files.agg(F.sum("records")).first()[0] == 60
    assert warc.read(files).count() == 60
    assert warc.round_trip(pages(spark, [])).count() == 0


def archive(n=12, packed=True):
    records = []
    for i in range(n):
        html = (f"<p>{i} " * 50).encode()
        records.append(warc.record(i, f"http://h/{i}", html, hashlib.sha256(html).hexdigest(), None))
    return [gzip.compress(r) if packed else r for r in records]


def kinds(data):
    return [(k, int(h["warc-record-id"].strip("<>").rpartition(":")[2]) if h else None) for k, _, _, h, _ in warc.salvage(data)]


def test_salvage_damage():
    for packed in (True, False):
        parts = archive(packed=packed)
        assert kinds(b"".join(parts)) == [("record", i) for i in range(12)]
        hurt = list(parts)
        middle = bytearray(hurt[4])
        middle[len(middle) // 2] ^= 0xFF
        hurt[4] = bytes(middle)
        hurt[8] = hurt[8][:60]
        hurt[-1] = hurt[-1][:-20]
        data = b"junk" + b"".join(hurt)
        found = kinds(data)
        assert [i for k, i in found if k == "record"] == [0, 1, 2, 3, 5, 6, 7, 9, 10]
        spans = [(a, b) for _, a, b, _, _ in warc.salvage(data)]
        assert spans[0] == (0, 4) and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] == len(data)
        assert [k for k, _ in found].count("gap") == 4
    assert list(warc.salvage(b"")) == [] and kinds(b"nothing here") == [("gap", None)]


def numbers(data):
    return [i for k, i in kinds(data) if k == "record"]


def test_salvage_inside_members():
    plain = archive(30, packed=False)
    assert numbers(gzip.compress(b"".join(plain))) == list(range(30))
    hurt = list(plain)
    hurt[4] = hurt[4].replace(b"<p>4 ", b"<p>5 ", 1)
    # One bad record of a whole member; its bytes are logged.
    one = list(warc.salvage(gzip.compress(b"".join(hurt))))
    assert [k for k, *_ in one].count("gap") == 1 and one[4][0] == "gap" and one[4][4] == hurt[4]
    assert numbers(gzip.compress(b"".join(hurt))) == [i for i in range(30) if i != 4]
    for level in (0, 6):
        # A member that lost its tail, with another right behind it.
        packed = gzip.compress(b"".join(plain), level)
        cut = packed[: len(packed) * 2 // 3]
        got = numbers(cut)
        assert 10 < len(got) < 30 and got == list(range(len(got)))
        assert numbers(cut + gzip.compress(plain[7]) + plain[9]) == [*got, 7, 9]
        spans = [(a, b) for _, a, b, _, _ in warc.salvage(cut + gzip.compress(plain[7]))]
        assert all(x[1] == y[0] or x == y for x, y in zip(spans, spans[1:])) and spans[-1][1] == len(cut) + len(gzip.compress(plain[7]))
    flipped = bytearray(gzip.compress(b"".join(plain), 0))
    flipped[flipped.index(b"<p>12 ") + 3] ^= 1
    assert numbers(bytes(flipped)) == [i for i in range(30) if i != 12]
    assert numbers(gzip.compress(b"".join(plain))[:-8]) == list(range(30))


def test_read_logs_gaps(spark):
    import os

    folder = scratch_path(spark, "warc").removeprefix("file:")
    os.makedirs(folder)
    parts = archive()
    with open(f"{folder}/a.warc.gz", "wb") as out:
        out.write(b"".join([*parts[:3], b"\x00" * 77, *parts[3:]]))
    rows = warc.read(spark.createDataFrame([(f"{folder}/a.warc.gz",)], "path string")).collect()
    gap = [r for r in rows if r.kind == "gap"]
    assert len(rows) == 13 and len(gap) == 1 and gap[0].end - gap[0].start == 77


def test_reading_takes_time_in_proportion():
    import time

    def seconds(n):
        data = b"".join(archive(12)) * n
        start = time.process_time()
        assert sum(1 for _ in warc.salvage(data)) == 12 * n
        return time.process_time() - start

    seconds(50)
    assert seconds(4000) < 10 * seconds(1000)


def test_round_trip_reports_damage(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(warc, "member", lambda data, level=3: gzip.compress(data)[:-9])
    with pytest.raises(RuntimeError, match="written"):
        warc.round_trip(pages(spark, [(i, f"<html>{i}" * 40) for i in range(5)]))


def test_names_of_stores():
    assert warc._place("file:/tmp/x")[1] == "/tmp/x" and warc._place("/tmp/x")[1] == "/tmp/x"
