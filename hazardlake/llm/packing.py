"""Best-fit packing of token pieces into sequences by hierarchical residual packing.

Every partition packs its own pieces best-fit. Bins that are nearly full are done; the others
become items of the next round, dealt anew to fewer groups, until one group holds what is left
or a round no longer merges anything.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.words import batches, bound_batches, find_words, give_back, kept
from hazardlake.session import materialize

#: Items that one task packs at a time.
GROUP_ITEMS = 200_000
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 800_000


def tokenizer_ids(path: str):
    """A function from UTF-8 texts to (all ids in order, number of ids of each text).

    No token of this kind of vocabulary crosses white space and letters are lower-cased, so ids
    are looked up by the hash of a word and only words not seen before are tokenised. Words of
    plain letters, with at most one full stop or comma behind, skip the normaliser. The vocabulary's
    special tokens, as written, part a text before all that.
    """
    def models() -> tuple:
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        letters_only = Tokenizer(whole.model)
        letters_only.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        special = {t.content.encode(): i for i, t in whole.get_added_tokens_decoder().items() if t.special}
        return whole, letters_only, special

    whole, letters_only, special = kept("packing", "models " + path, models)
    plain = re.compile("([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)").fullmatch

    def ids_of(model, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]

    marks = dict(zip(["", ".", ","], [[], *ids_of(whole, [".", ","])]))

    def tokenise(words: list[str]) -> list[list[int]]:
        found: dict[str, list[int]] = {}
        simple = [(w, m[1].lower(), m[2]) for w in words if (m := plain(w))]
        bare = list({letters for _, letters, _ in simple})
        known = dict(zip(bare, ids_of(letters_only, bare)))
        for word, letters, mark in simple:
            found[word] = known[letters] + marks[mark]
        others = [w for w in words if w not in found]
        found.update(zip(others, ids_of(whole, others)))
        return [found[w] for w in words]

    small = np.uint16 if whole.get_vocab_size() <= 1 << 16 else np.uint32
    table = kept(
        "packing", "ids " + path,
        lambda: {"key": np.zeros(0, np.uint64), "at": np.zeros(0, np.uint32), "size": np.zeros(0, np.uint16), "pool": np.zeros(0, small)},
    )

    apart = re.compile(b"(" + b"|".join(map(re.escape, sorted(special))) + b")") if special else None

    def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if apart is None or not any(apart.search(t) for t in texts):
            return ordinary(texts)
        # Ordinary pieces and special tokens take turns; a token stands behind its piece.
        pieces, owner, behind = [], [], []
        for i, text in enumerate(texts):
            split = apart.split(text)
            pieces += split[::2]
            owner += [i] * len(split[::2])
            behind += [*map(special.get, split[1::2]), -1]
        flat, counts = ordinary(pieces)
        behind = np.array(behind)
        marked = behind >= 0
        flat = np.insert(flat, np.cumsum(counts)[marked], behind[marked])
        return flat, np.bincount(owner, weights=counts + marked, minlength=len(texts)).astype(np.int64)

    def ordinary(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = find_words(texts)
        unique, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(table["key"], unique)
        new = np.ones(len(unique), dtype=bool)
        inside = place < len(table["key"])
        new[inside] = table["key"][place[inside]] != unique[inside]
        old = ~new
        size, begin = np.zeros(len(unique), dtype=np.int64), np.zeros(len(unique), dtype=np.int64)
        size[old], begin[old] = table["size"][place[old]], table["at"][place[old]]
        pool = table["pool"]
        if new.any():
            data = words.buffer.tobytes()
            found = tokenise(
                [data[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())]
            )
            size[new] = [len(x) for x in found]
            begin[new] = len(pool) + np.cumsum(size[new]) - size[new]
            pool = np.concatenate([pool, np.array([i for x in found for i in x], dtype=small)])
            # Words met early are the frequent ones; once the table is full, others are tokenised each time.
            if len(table["key"]) < CACHE_WORDS and size.max() <= 0xFFFF and len(pool) < 1 << 32:
                table["pool"] = pool
                for name, values in (("key", unique), ("at", begin), ("size", size)):
                    table[name] = np.insert(table[name], place[new], values[new].astype(table[name].dtype))
        size, begin = size[which], begin[which]
        after = np.cumsum(size)
        flat = pool[np.repeat(begin - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        return flat.astype("<u4"), np.bincount(words.text, weights=size, minlength=len(texts)).astype(np.int64)

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's token pieces.

    A document is its whole text's ids and then ``end``; only one of more than ``capacity`` ids
    is cut, every ``capacity`` ids. A null or empty text is the piece [``end``]. Rows are taken
    as they come: repeated rows and rows without doc_id give pieces like any other. Write the
    result before packing it, so that no task holds two Python workers.
    ``tokenizer_path`` is a file of the installed vocabulary package, which every worker has.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_ids(tokenizer_path)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in parts:
            rows, out = [], {n: [] for n in names[1:]}
            for first, texts in batches(batch.column("text")):
                flat, counts = encode(texts)
                data, begin = flat.tobytes(), 0
                for row, count in enumerate(counts.tolist(), first):
                    ids = data[begin : begin + 4 * count] + last
                    begin += 4 * count
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(row)
                        out["piece"].append(k)
                        out["start"].append(at // 4)
                        out["length"].append(len(part) // 4)
                        out["ids_crc32"].append(zlib.crc32(part))
                        if with_ids:
                            out["ids"].append(part)
            kinds = {"piece": pa.int32(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(out[n], kinds.get(n, pa.int64())) for n in names[1:])],
                names,
            )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest items first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin has r places left
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[chosen].append(item)
        else:
            room, chosen = capacity, len(bins)
            bins.append([item])
        left = room - need
        if left:
            by_room[left].append(chosen)
            rooms |= 1 << left
    return bins


def _packed(lengths: np.ndarray, members: pa.ListArray, capacity: int, slack: int, tag: int) -> pa.RecordBatch:
    """One packing of items, each a list of members: rows of (done, sequence_id, fill, members)."""
    bins = best_fit(lengths, capacity)
    bounds = members.offsets.to_numpy()
    flat: list[np.ndarray] = []
    ends, fills = [0], []
    for items in bins:
        for i in items:
            flat.append(np.arange(bounds[i], bounds[i + 1]))
        ends.append(ends[-1] + sum(int(bounds[i + 1] - bounds[i]) for i in items))
        fills.append(int(sum(lengths[i] for i in items)))
    order = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
    fill = np.array(fills, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(fill >= capacity - slack),
            pa.array(np.arange(len(bins), dtype=np.int64) + tag),
            pa.array(fill),
            pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), members.values.take(order)),
        ],
        ["done", "sequence_id", "fill", "members"],
    )


def _tag(round_: int, group: int) -> int:
    """First sequence number of a task; numbers of different tasks and rounds never meet."""
    return (round_ << 56) | (group << 32)


def pack(items: DataFrame, capacity: int = 2048, length: str = "length", slack: int = 4, group_items: int = GROUP_ITEMS) -> DataFrame:
    """``items`` with sequence_id and offset: sequences of at most ``capacity``, gapless from 0.

    ``length`` is a whole number from 1 to ``capacity`` in every row; anything else is an error.
    All columns are carried along, whatever they hold (null, repeated rows); columns named
    sequence_id or offset are replaced. A bin with at most ``slack`` free places is done at
    once. An empty table gives an empty one. Each round is written to the shared folder. A task
    holds at most ``group_items`` items; where the items left can't be merged any further (all
    longer than half a sequence, say), the groups close as they are.
    """
    items = items.drop(*[c for c in ("sequence_id", "offset") if c in items.columns])
    names = list(items.columns)
    inner = items.select(F.struct(*items.columns).alias("m")).schema["m"].dataType.simpleString()
    schema = f"done boolean, sequence_id long, fill long, members array<{inner}>"
    valid = F.coalesce((F.col(length) >= 1) & (F.col(length) <= capacity), F.lit(False))
    single = items.select(
        F.when(valid, F.col(length)).otherwise(F.raise_error(F.lit(f"length outside 1 to {capacity}"))).cast("long").alias("fill"),
        F.array(F.struct(*items.columns)).alias("members"),
    )

    def local(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        place = TaskContext.get().partitionId() if TaskContext.get() else 0
        made = 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            out = _packed(table["fill"].to_numpy(), table["members"].combine_chunks(), capacity, slack, _tag(1, place) + made)
            return out

        for batch in parts:
            held.append(batch)
            if sum(b.num_rows for b in held) >= group_items:
                out = close()
                made += out.num_rows
                yield out
                held = []
        if held and sum(b.num_rows for b in held):
            yield close()

    def merged(round_: int):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            members = group["members"]
            members = members.combine_chunks() if isinstance(members, pa.ChunkedArray) else members
            out = _packed(group["fill"].to_numpy(), members, capacity, slack, _tag(round_, key[0].as_py()))
            return pa.Table.from_batches([out])

        return run

    rounds = [materialize(single.mapInArrow(local, schema), "bins")]
    left = rounds[-1].filter("not done").count()
    while left:
        groups = -(-left // group_items)
        dealt = rounds[-1].filter("not done").select(
            F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("group"), "fill", "members"
        )
        packed = dealt.groupBy("group").applyInArrow(merged(len(rounds) + 1), schema)
        rounds.append(materialize(packed, "bins"))
        before, left = left, rounds[-1].filter("not done").count()
        if groups == 1 or left > 0.95 * before:
            break
    closed = rounds[-1]
    for earlier in rounds[:-1]:
        closed = closed.union(earlier.filter("done"))

    def lay_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            members = batch.column("members")
            bounds = members.offsets.to_numpy() - members.offsets[0].as_py()
            rows = members.flatten()
            sizes = rows.field(length).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.concatenate(([0], np.cumsum(sizes)))
            each = np.diff(bounds)
            offset = before[:-1] - np.repeat(before[bounds[:-1]], each)
            sequence = np.repeat(batch.column("sequence_id").to_numpy(), each)
            yield pa.RecordBatch.from_arrays(
                [*(rows.field(i) for i in range(len(names))), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return closed.select("sequence_id", "members").mapInArrow(lay_out, f"{fields}, sequence_id long, offset long")
