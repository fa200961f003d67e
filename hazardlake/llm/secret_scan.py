"""Secrets in texts: fixed patterns, and random strings found by their token efficiency.

A vocabulary trained on natural text needs few tokens for words and names, but about one for
every one or two characters of a random string. Long runs with few characters per token are reported, unless
they are known digests or numbers; letters alone are words where they take few tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazardlake.llm.words import bound_batches, give_back, kept

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Least lengths: group 2 of an assignment, an access key, a hex run.
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
#: Runs that may be random strings, and the greatest characters per token of one.
RANDOM_LENGTH = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RANDOM_LENGTH},}}"
RATIO = 2.1
#: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: Characters of a longer candidate that are tokenised at a time.
WINDOW = 4096


#: Words and short numbers joined by marks.
WORDS = r"([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})([+/_=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[+/_=-]*"


def _known(run: str) -> bool:
    """Digests and identifiers: hex of a digest's length, UUIDs, numbers."""
    if re.fullmatch(r"[0-9a-fA-F]+", run) and len(run) in DIGEST_LENGTHS:
        return True
    return bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run) or re.fullmatch(r"[0-9+/_=-]+", run))


def _random(run: str, ratio: float, tokens) -> bool:
    """Few characters per token.

    Of words joined by marks the marks don't count, nor do single characters, and a number counts
    as one token.
    """
    if not re.fullmatch(WORDS, run):
        return len(run) < ratio * tokens(run)
    words = [w for w in re.findall(r"[A-Za-z]+|[0-9]+", run) if len(w) > 1]
    return sum(map(len, words)) < ratio * sum(1 if w.isdigit() else tokens(w) for w in words)


def _outside(a: int, b: int, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a..b that no span covers."""
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= b:
            break
        if a < min(start, b):
            yield a, start
        a = max(a, end)
    if a < b:
        yield a, b


def token_counter(path: str, pattern: str):
    """A function giving the number of tokens of a run under a byte-pair vocabulary of ranks."""
    import tiktoken

    def load() -> tiktoken.Encoding:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    model = kept("secrets", f"{path} {pattern}", load)
    return lambda run: sum(len(model.encode_ordinary(run[i : i + WINDOW])) for i in range(0, len(run), WINDOW))


def finder(path: str, pattern: str, ratio: float = RATIO):
    """A function from a text to its spans (kind, start, end) by start and kind, in code points."""
    assign = re.compile(f"(?ai:{ASSIGN})")
    access, hexes, candidate = re.compile(ACCESS), re.compile(f"{HEX[:-1]}{{{HEX_LENGTH},}}"), re.compile(CANDIDATE)
    tokens = token_counter(path, pattern)
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")

    def find(text: str) -> list[tuple[str, int, int]]:
        spans = []
        low = text.lower()
        if any(w in low for w in words):
            spans += [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
        spans += [("access", *m.span()) for m in access.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
        spans += [("hex", *m.span()) for m in hexes.finditer(text)]
        base = list(spans)
        for m in candidate.finditer(text):
            touching = [s for s in base if m.start() < s[2] and s[1] < m.end()]
            for a, b in _outside(*m.span(), touching):
                if a > m.start():
                    # What joins it to the span before it is no part of it.
                    a = b - len(text[a:b].lstrip("+/_=-"))
                if b - a >= RANDOM_LENGTH and not _known(text[a:b]) and _random(text[a:b], ratio, tokens):
                    spans.append(("random", a, b))
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))

    return find


def _each(parts: Iterator[pa.RecordBatch], find, rows: int = 256):
    """(slice of the batch, spans of each text) in slices of few rows."""
    for batch in parts:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            texts = part.column("text").to_pylist()
            yield part, texts, [find(t or "") for t in texts]
    give_back()


def scan(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = RATIO) -> DataFrame:
    """(doc_id, spans, n_assign, n_access, n_hex, base_sha256) of every row of ``docs`` (doc_id, text).

    ``spans`` is an array of (kind, start, end, secret), by start and then kind; offsets count
    code points, end exclusive. The base kinds are matched leftmost and without overlap per
    kind; of the keywords only A-Z count in either case. A ``random`` span overlaps no base span;
    the rest of a run beside a base span is tested on its own.
    Null and empty texts have none. ``base_sha256`` is the digest of the base spans as
    kind:start:end, comma-joined. Every row comes back once, repeated rows and rows without
    doc_id too; extra columns are ignored. ``vocabulary`` is a file of ranks that every worker
    has, ``pattern`` its splitting rule. A run of more than ``WINDOW`` characters is tokenised in
    pieces of that length, as byte-pair merging takes the square of a run; a cut adds few tokens
    to the 1,950 that a piece at the limit has, so that only a ratio next to it could change.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(vocabulary, pattern, ratio)
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.string())])
        for part, texts, found in _each(parts, find):
            counts = [[sum(s[0] == k for s in spans) for spans in found] for k in KINDS[:3]]
            base = [",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "random") for spans in found]
            listed = [[{"kind": k, "start": a, "end": b, "secret": t[a:b]} for k, a, b in spans] for t, spans in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(listed, pa.list_(item)),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]),
                ],
                ["doc_id", "spans", "n_assign", "n_access", "n_hex", "base_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,secret:string>>, "
        "n_assign long, n_access long, n_hex long, base_sha256 string",
    )


def redact(docs: DataFrame, vocabulary: str, pattern: str, ratio: float = RATIO, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of text replaced by ``mask``; overlapping spans as one.

    All columns and rows stay; ``n_chars``, where it is a column, is counted anew in texts that
    changed. Null texts stay null.
    """
    bound_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = list(docs.columns)

    def clean(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
        out, at = [], 0
        for _, a, b in spans:
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, found in _each(parts, finder(vocabulary, pattern, ratio)):
            new = [clean(t, spans) for t, spans in zip(texts, found)]
            columns = {n: part.column(n) for n in names}
            if "n_chars" in names:
                old = columns["n_chars"]
                sizes = [len(n) if spans else o for n, spans, o in zip(new, found, old.to_pylist())]
                columns["n_chars"] = pa.array(sizes, old.type)
            columns["text"] = pa.array(new, part.column("text").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.mapInArrow(run, fields)
