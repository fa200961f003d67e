"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Archives are gzip files with one member a record, rotated at a bounded size. They are written by
tasks to a folder that all executors share; a task returns the list of its files, and only listed
files are read, so that a repeated task leaves nothing behind that counts.

The reader checks every member and record. Where a check fails it searches for the next valid
member or version line, goes on from there, and logs the bytes between as a quarantined gap. The
same is done inside a member, over what it gives when inflated, up to its end or first error.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.words import bound_batches
from hazardlake.session import materialize, scratch_path

#: Bytes at which a writer starts the next file.
FILE_BYTES = 16 << 20
#: Payloads that are shorter are never revisits.
LEAST_REVISIT = 100
#: Bytes of a damaged member that are inflated at a time.
STEP = 4096
VERSION = b"WARC/1.1\r\n"
_ID = "urn:x-page:"
_DATE = "2024-01-01T00:00:00Z"


def roles(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) once per page and payload; refers_to is null for responses.

    Of payloads that are equal and of at least ``least`` bytes the smallest page_id is the
    response. Rows of one page_id and payload have the same role; rows without page_id are
    responses that nothing refers to.
    """
    html = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size")).distinct()
    firsts = narrow.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"))
    joined = narrow.join(firsts, "digest", "left")
    other = F.col("page_id").isNotNull() & F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    return joined.select("page_id", "digest", F.when(other, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c for c in url or "urn:x-unknown" if c.isprintable())
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: <{_ID}{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return VERSION + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """One gzip member; its bytes depend on the data alone."""
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def _place(uri: str):
    """Arrow's file system and path of a URI, Hadoop's names of S3 included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns (path, records, bytes) per file.

    Null html is an empty payload. Repeated rows are written as often as they come. ``folder`` is
    a path or URI that every executor can open. The returned table is already written.
    """
    bound_batches(pages.sparkSession)
    has_url = "url" in pages.columns
    rows = pages.select("page_id", (F.col("url") if has_url else F.lit(None)).cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    role = roles(pages, least).withColumnsRenamed({"page_id": "__page", "digest": "__digest"})
    joined = rows.withColumn("digest", F.sha2("html", 256)).join(
        role, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest"))
    ).select("page_id", "url", "html", "digest", "refers_to")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        base = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        done, held, size = [], [], 0

        def close() -> None:
            name = f"{base}-{len(done):05d}.warc.gz"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for data in held:
                    out.write(data)
            done.append((f"{folder}/{name}", len(held), size))

        for batch in parts:
            for a in range(0, batch.num_rows, 256):
                for row in batch.slice(a, 256).to_pylist():
                    payload = row["html"].encode("utf-8", "replace")
                    held.append(member(record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"])))
                    size += len(held[-1])
                    if size >= file_bytes:
                        close()
                        held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["path", "records", "bytes"],
        )

    return materialize(joined.mapInArrow(run, "path string, records long, bytes long"), "archives")


def _parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int] | None:
    """(headers, block, end) of the record that starts at ``at``, if it is whole and its digests hold."""
    if data[at : at + 5] != b"WARC/":
        return None
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    lines = data[at:head].decode("utf-8", "replace").split("\r\n")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        # A header that was cut runs on into the next record's: its fields come twice.
        if not colon or name in headers and name in ("warc-type", "warc-record-id", "content-length"):
            return None
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    start, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[start:end]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
        return None
    return headers, block, end + 4


def _inner(data: bytes) -> Iterator[tuple[dict | None, bytes, int]]:
    """(headers, block, end) of the whole records of inflated bytes; what lies between has no headers."""
    at, gap = 0, None
    while at < len(data):
        one = _parse(data, at)
        if one is None:
            gap = at if gap is None else gap
            at = data.find(b"WARC/", at + 1)
            at = len(data) if at < 0 else at
            continue
        if gap is not None:
            yield None, data[gap:at], at
            gap = None
        yield one
        at = one[2]
    if gap is not None:
        yield None, data[gap:], len(data)


def _feed(unpack, data: bytes, at: int, step: int, out: list[bytes], enough: float = float("inf")) -> int:
    """Inflates from ``at`` on into ``out`` until an error, the end or enough bytes; returns where it stopped."""
    size = sum(map(len, out))
    while at < len(data) and size < enough and not unpack.eof:
        held = unpack.copy() if step > 1 else None
        try:
            out.append(unpack.decompress(data[at : at + step]))
        except zlib.error:
            return at if step == 1 else _feed(held, data, at, 1, out, enough)
        size += len(out[-1])
        at += step
    return min(at, len(data))


def _damaged(data: bytes, at: int) -> tuple[list[tuple[dict | None, bytes]], int] | None:
    """Records and gaps of the damaged or cut member at ``at``, and where its last whole record ends.

    A lone record without a gap may be what is damaged and doesn't count.
    """
    out: list[bytes] = []
    _feed(zlib.decompressobj(31), data, at, STEP, out)
    found = list(_inner(b"".join(out)))
    whole = [end for headers, _, end in found if headers is not None]
    if not whole or len(found) == 1:
        return None
    # The next member may begin right behind it.
    unpack, seen, place = zlib.decompressobj(31), 0, at
    for part in out:
        if seen + len(part) >= whole[-1] or place + STEP > len(data):
            break
        unpack.decompress(data[place : place + STEP])
        seen, place = seen + len(part), place + STEP
    items: list[tuple[dict | None, bytes]] = []
    for headers, block, _ in found:
        # A stored block that was cut runs on into the members behind it.
        more = salvage(block) if headers is None else [("record", 0, 0, headers, block)]
        items += [(h, block[a:b] if h is None and not inner else inner) for _, a, b, h, inner in more]
    return items, _feed(unpack, data, place, 1, [], whole[-1] - seen)


def _at(data: bytes, at: int) -> tuple[list[tuple[dict | None, bytes]], int] | None:
    """The records (and gaps between them) of the valid member or plain record at ``at``, and where it ends."""
    if data[at : at + 3] == b"\x1f\x8b\x08":
        # In bounded steps, as what lies behind the member is copied by each.
        unpack, out, place, step = zlib.decompressobj(31), [], at, STEP
        try:
            while not unpack.eof and place < len(data):
                out.append(unpack.decompress(data[place : place + step]))
                place, step = place + step, min(2 * step, 1 << 20)
        except zlib.error:
            return None
        if not unpack.eof:
            return None
        found = [one[:2] for one in _inner(b"".join(out))]
        return (found, min(place, len(data)) - len(unpack.unused_data)) if any(headers is not None for headers, _ in found) else None
    one = _parse(data, at)
    return ([one[:2]], one[2]) if one else None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict | None, bytes]]:
    """('record' or 'gap', start, end, headers, block) over the bytes of one archive, in order.

    A gap inside a member has the place of the member and its inflated bytes as block. A damaged
    or cut member that still holds whole records ends behind the last of them.
    """
    at, gap = 0, None
    while at < len(data):
        found = _at(data, at)
        if found is None and data[at : at + 3] == b"\x1f\x8b\x08":
            found = _damaged(data, at)
        if found is None:
            gap = at if gap is None else gap
            places = [p for p in (data.find(b"\x1f\x8b\x08", at + 1), data.find(b"WARC/", at + 1)) if p >= 0]
            at = min(places, default=len(data))
            continue
        if gap is not None:
            yield "gap", gap, at, None, b""
            gap = None
        for headers, block in found[0]:
            yield "gap" if headers is None else "record", at, found[1], headers, block
        at = found[1]
    if gap is not None:
        yield "gap", gap, len(data), None, b""


def read(archives: DataFrame) -> DataFrame:
    """Every record and gap of the files in ``archives`` (path; other columns are ignored).

    Columns: path, start, end, kind ('record' or 'gap'), record_type, record_id, target_uri,
    refers_to, payload_digest, payload_bytes (of the full payload; null where a record doesn't
    say), payload (null in revisits). Of a gap inside a member, start and end are the member's,
    and payload its inflated bytes; other gaps have no payload. A damaged, cut or empty file gives what can be
    saved of it, and its gaps. A file that is missing is an error.
    """
    schema = (
        "path string, start long, end long, kind string, record_type string, record_id string, target_uri string, "
        "refers_to string, payload_digest string, payload_bytes long, payload binary"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        bare = lambda x: x.strip("<>") if x else None
        for kind, start, end, headers, block in salvage(data):
            if kind == "gap":
                yield (path, start, end, kind, *[None] * 5, len(block) if block else None, block or None)
                continue
            type_, payload, size = headers.get("warc-type"), block, None
            if headers.get("content-type", "").startswith("application/http"):
                head, _, payload = block.partition(b"\r\n\r\n")
                for line in head.split(b"\r\n")[1:]:
                    name, _, value = line.partition(b":")
                    if name.strip().lower() == b"content-length" and value.strip().isdigit():
                        size = int(value)
            whole = type_ != "revisit"
            digest = hashlib.sha256(payload).hexdigest() if whole else (headers.get("warc-payload-digest") or "").removeprefix("sha256:") or None
            yield (
                path, start, end, kind, type_, bare(headers.get("warc-record-id")), headers.get("warc-target-uri"),
                bare(headers.get("warc-refers-to")), digest, len(payload) if whole else size, payload if whole else None,
            )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for path in batch.column("path").to_pylist():
                store, place = _place(path)
                with store.open_input_file(place) as file:
                    data = file.read()
                held, size = [], 0
                for row in rows(path, data):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size > 1 << 22 or len(held) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    files = archives.select("path")
    spread = files.repartition(max(1, min(files.count(), 10_000)), "path")
    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from its archive.

    An archive that gives back other than what was written to it is an error.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    page = lambda c: F.nullif(F.replace(F.col(c), F.lit(_ID), F.lit("")), F.lit("")).cast("long")
    files = write(pages, folder)
    found = materialize(read(files).select("kind", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    written = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    gaps, records = found.agg(F.count_if(F.col("kind") == "gap"), F.count_if(F.col("kind") == "record")).first()
    if gaps or records != written:
        raise RuntimeError(f"{written} records written to {folder}, {records} read, {gaps} gaps")
    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
