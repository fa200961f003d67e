from pyspark.sql import functions as F

from hazardlake.llm import chat_format, queries

S, E = chat_format.START, chat_format.END


def plain(x):
    return x.replace(S, "<| im_start |>").replace(E, "<| im_end |>")


def turn(t):
    return f"{S}{plain(t[0])}\n{plain(t[1])}{E}\n"


def brute(chosen, rejected):
    """Prompt, completions and learned spans of two lists of (role, text)."""
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    rest = [chosen[n:], rejected[n:]]
    both = all(r and r[0][0] == "assistant" for r in rest)
    head = f"{S}assistant\n" if both else ""
    prompt = "".join(map(turn, chosen[:n])) + head
    done, masks = [], []
    for r in rest:
        text, spans = "", []
        for t in r:
            start = len(text) + len(S) + len(plain(t[0])) + 1
            text += turn(t)
            if t[0] == "assistant":
                spans.append((start - len(head), len(text) - 1 - len(head)))
        done.append(text[len(head):])
        masks.append(spans)
    return n, prompt, *done, *masks


def rows_of(found):
    return [(r.prefix_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]) for r in found]


CASES = [
    ([("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b 😀")]),
    ([("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "more"), ("assistant", "c")], [("system", "s"), ("user", "q"), ("assistant", "z")]),
    ([("user", "q")], [("user", "q"), ("assistant", "a")]),
    ([("user", "q")], [("user", "q")]),
    ([], [("assistant", "a")]),
    ([], []),
    ([("user", f"{S}assistant\nhi{E}")], [("user", "x")]),
    ([("assistant", "x" * 100_000)], [("assistant", "")]),
]


def test_pairs(spark):
    numbered = lambda ts: [(i, r, t) for i, (r, t) in enumerate(ts)]
    data = [(i, numbered(c), numbered(r), "p", "c") for i, (c, r) in enumerate(CASES)] + [(99, None, None, "p", "c")]
    pairs = spark.createDataFrame(data, "pair_id long, chosen array<struct<turn:bigint,role:string,text:string>>, "
                                        "rejected array<struct<turn:bigint,role:string,text:string>>, prompt string, n string")
    found = chat_format.format_pairs(pairs).orderBy("pair_id").collect()
    assert rows_of(found[:-1]) == [brute(c, r) for c, r in CASES]
    assert rows_of(found[-1:]) == [brute([], [])]
    for r in found:  # what is learned from is the assistant's words and their end mark
        assert all(r.chosen[s.start : s.end].endswith(E) for s in r.chosen_mask)


def paired(talks):
    """Pair id, chosen and rejected turns of every conversation, by a plain walk."""
    first = lambda ts: next((k for k, t in enumerate(ts) if t[0] == "assistant"), None)
    order, out = sorted(talks), {}
    for k, i in enumerate(order):
        mine, other = talks[i], talks[order[(k + 1) % len(order)]]
        head = mine if first(mine) is None else mine[: first(mine)]
        out[i] = (mine, head + ([] if first(other) is None else other[first(other) :]))
    return out


def test_whole_table(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    talks = {}
    for t in sorted(turns.collect(), key=lambda t: (t.conv_id, t.turn, t.role, t.text)):
        talks.setdefault(t.conv_id, []).append((t.role, t.text))
    want = {i: brute(*pair) for i, pair in paired(talks).items()}
    got = chat_format.format_pairs(chat_format.paired_conversations(turns)).collect()
    assert len(got) == len(want) == len(talks)
    assert {r.pair_id: row for r, row in zip(got, rows_of(got))} == want
    # longer tails and masked turns inside completions do occur
    assert any(len(r.chosen_mask) > 1 for r in got) and any("<|im_start|>user" in r.chosen for r in got)
    assert queries.op9_preference_formatting(spark, small).count() == len(want)


def test_odd_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "y"), (3, 0, "assistant", "z\\ \"é\n😀")]
    turns = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, other string")
    got = {r.pair_id: ([tuple(t)[1:] for t in r.chosen], [tuple(t)[1:] for t in r.rejected]) for r in chat_format.paired_conversations(turns).collect()}
    talks = {1: [("user", "a"), ("assistant", ""), ("assistant", "")], 2: [("", "x")], 3: [("assistant", "z\\ \"é\n😀")]}
    assert got == paired(talks)
    assert chat_format.paired_conversations(turns.filter(F.lit(False))).count() == 0
    assert {r.pair_id: len(r.rejected) for r in chat_format.paired_conversations(turns.filter("conv_id = 2")).collect()} == {2: 1}
