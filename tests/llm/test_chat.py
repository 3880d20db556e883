"""Prefix tree: round trips, shared nodes once, positions and attention."""

import hashlib
from collections import defaultdict

import pytest

from quillframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, path string"


def digest(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    formatted = sum(len(s) for r, t in turns for s in chat.segments(r, t))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(turns), sha(whole), len(loss), sha(loss), formatted)


def expected(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by_conv[conv].append((turn, role or "", text or ""))
    first = lambda x: (x[0] is not None, x)
    return {c: digest([x[1:] for x in sorted(t, key=first)]) for c, t in by_conv.items()}


def got(tree, path):
    return {r[0]: tuple(r)[1:] for r in chat.read_back(tree, path).collect()}


def rows():
    odd = ["\\### Assistant: </turn> ok", "<turn>\n</turn>", "\\", "\\\\n\\n", "", None, "a b\r\n", "é😀" * 3000]
    out = []
    for conv in range(12):
        out.append((conv, 0, "system", "shared start", "x"))
        out.append((conv, 1, "user", odd[conv % len(odd)], "x"))
        for turn in range(2, 2 + conv % 4):
            out.append((conv, turn, "assistant" if turn % 2 else "us\ner<turn>", f"same {turn}", "x"))
    out += [(50, t, "assistant", f"t{t}", "x") for t in range(30)]
    out += [(51, t, "assistant", f"t{t}", "x") for t in range(17)]
    out += [(None, 0, "user", "no id", "x"), (None, 1, None, None, "x"), (60, 0, "user", "a", "x"), (60, 0, "user", "a", "x")]
    return out


@pytest.mark.parametrize("block", [4096, 4])
def test_round_trip(spark, block):
    data = rows()
    path = chat.tokenizer_path()
    tree = chat.prefix_tree(spark.createDataFrame(data, SCHEMA), path, block)
    assert got(tree, path) == expected(data)
    if block == 4:
        return
    nodes = {r.key: r for r in tree.nodes.collect()}
    prefixes = set()
    by_conv = defaultdict(list)
    for conv, turn, role, text, _ in data:
        by_conv[conv].append((turn, role or "", text or ""))
    for turns in by_conv.values():
        turns.sort(key=lambda x: (x[0] is not None, x))
        prefixes |= {tuple(t[1:] for t in turns[: i + 1]) for i in range(len(turns))}
    assert len(nodes) == len(prefixes)  # each shared turn once
    ordered = sorted(nodes.values(), key=lambda r: r.start)
    end = 0
    for r in ordered:  # one sequence without gaps
        assert r.start == end and r.n_tokens == len(r.tokens)
        end += r.n_tokens
    for member in tree.members.collect():
        own = [[r for r in ordered if r.run == run] for run in member.runs]
        line = [r for run in own for r in run]
        at = 0
        for r in line:  # position ids as if the conversation stood alone
            assert r.position == at
            at += r.n_tokens
        for i, run in enumerate(own):
            spans = [(run_[0].start, run_[-1].start + run_[-1].n_tokens) for run_ in own[:i]]
            for r in run:
                assert [tuple(a) for a in r.attends] == sorted(spans)


def test_whole_table(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    data = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    data += [(-7, t, r, r"\### Assistant: </turn> ok") for t, r in enumerate(("user", "assistant"))]
    df = chat.op5_chat_prefix_tree(spark, "/root/testdata/sf0.01")
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == expected(data)


def test_empty(spark):
    tree = chat.prefix_tree(spark.createDataFrame([], SCHEMA), chat.tokenizer_path())
    assert chat.read_back(tree, chat.tokenizer_path()).count() == 0 and tree.nodes.count() == 0
