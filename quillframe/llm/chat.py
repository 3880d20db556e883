r"""Chat formatting as a prefix tree of shared turns.

Conversations that begin with the same turns share those turns' nodes. A node
is a turn together with everything before it, named by a hash of both. All
nodes are emitted once, depth first, as token ids in one long sequence: a node
has its ``start`` in that sequence, ``position`` (the position id of its first
token: the tokens of its ancestors) and ``attends``, the intervals of the
sequence its tokens attend to besides earlier ones of its own run.

A run is a chain of nodes that exactly the same conversations go through. Its
nodes lie side by side in the sequence, so an ancestor interval is a whole run
and a conversation is the list of its runs.

Template: ``<turn>role\ntext</turn>\n``. A backslash, ``<turn>`` and ``</turn>``
inside a role or text, and a line break inside a role, get a backslash in front;
reading undoes it. The loss mask covers the text of assistant turns.

Nothing gathers a conversation or a tree in one task: positions come from a
global sort, running hashes are carried over blocks of ``BLOCK`` turns, and the
reader streams sorted turns.

Cases: a null role or text is empty; a null conversation id is one conversation;
rows of one turn number (repeated rows too) follow each other by role and text,
each as a turn of its own. An empty table gives an empty result. Only the four
named columns are read, so others cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm.common import query, table
from quillframe.operators.ordered import with_ordinals
from quillframe.session import materialise

OPEN, CLOSE = "<turn>", "</turn>"
LOSS_ROLE = "assistant"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Turns of one conversation whose running hash one window computes.
BLOCK = 4096

CONTROL = re.compile(r"\\|</?turn>")
MARK = re.compile(r"\\(\\|</?turn>|n)|<turn>|</turn>")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def segments(role: str, text: str) -> tuple[str, str, str]:
    """The formatted turn as head, text and tail."""
    return f"{OPEN}{escape(role)}".replace("\n", "\\n") + "\n", escape(text), CLOSE + "\n"


def unescape(text: str) -> str:
    return MARK.sub(lambda m: {None: m[0], "n": "\n"}.get(m[1], m[1] or m[0]), text)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation."""
    start = None
    for mark in MARK.finditer(formatted):
        if mark[0] == OPEN:
            start = mark.end()
        elif mark[0] == CLOSE:
            role, _, text = formatted[start : mark.start()].partition("\n")
            yield unescape(role), unescape(text)


@cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


TOKENS = "tokens array<int>, n_tokens long, loss_from int, loss_to int"


def encode_turn(path: str):
    @F.arrow_udf(TOKENS)
    def encode(roles: pa.Array, texts: pa.Array) -> pa.Array:
        known, out, heads = encoding(path), [], {}
        for role, text in zip(roles.to_pylist(), texts.to_pylist(), strict=True):
            first, inner, last = segments(role, text)
            if role not in heads:  # few roles: their marks are encoded once for a batch
                heads[role] = known.encode_ordinary(first), known.encode_ordinary(last)
            (head, tail), body = heads[role], known.encode_ordinary(inner)
            a, b = len(head), len(head) + len(body)
            if role != LOSS_ROLE:
                a = b = 0
            tokens = [*head, *body, *tail]
            out.append({"tokens": tokens, "n_tokens": len(tokens), "loss_from": a, "loss_to": b})
        kind = [("tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("loss_from", pa.int32()), ("loss_to", pa.int32())]
        return pa.array(out, pa.struct(kind))

    return encode.asNondeterministic()


def prefix_keys(turns: DataFrame, block: int) -> DataFrame:
    """``turns`` with ``depth`` (1-based place in the conversation) and ``key``,
    a 128-bit hash of all turns up to this one.

    The key folds the hashes of (place, turn) with exclusive or: within blocks
    by a window, over blocks by one row for each block.
    """
    places = turns.groupBy("conv").agg(F.min("ordinal").alias("first"))
    rows = turns.join(places, "conv").withColumn("depth", F.col("ordinal") - F.col("first") + 1)
    for n in ("a", "b"):
        rows = rows.withColumn(n, F.xxhash64("depth", f"hash_{n}"))
    rows = rows.withColumn("block", F.floor((F.col("depth") - 1) / block)).drop("hash_a", "hash_b")
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("conv", "block").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
    carried = whole.select(
        "conv",
        "block",
        F.coalesce(F.bit_xor("ta").over(earlier), F.lit(0)).alias("ca"),
        F.coalesce(F.bit_xor("tb").over(earlier), F.lit(0)).alias("cb"),
    )
    key = F.concat(*(F.lpad(F.hex(F.col(f"k{n}")), 16, "0") for n in ("a", "b")))
    folded = rows.join(carried, ["conv", "block"])
    for n in ("a", "b"):
        folded = folded.withColumn(f"k{n}", F.bit_xor(n).over(upto).bitwiseXOR(F.col(f"c{n}")))
    return folded.select("conv", "ordinal", "depth", key.alias("key"))


class PrefixTree:
    """``nodes``: one row for each distinct prefix, as emitted. ``members``: one
    row for each conversation with the list of its runs, from the root."""

    def __init__(self, nodes: DataFrame, members: DataFrame):
        self.nodes, self.members = nodes, members


def prefix_tree(chats: DataFrame, tokenizer: str, block: int = BLOCK) -> PrefixTree:
    """Merge conversations (``conv_id, turn, role, text``) into a prefix tree."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = chats.select("conv_id", "turn", empty("role"), empty("text"))
    # a table of whole numbers for conversations keeps null ids apart from others
    named = plain.withColumn(
        "conv",
        F.struct(
            F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("id")
        ),
    )
    placed = with_ordinals(
        named.withColumns({"hash_a": F.xxhash64("role", "text"), "hash_b": F.xxhash64(F.lit(7), "text", "role")}),
        ["conv", "turn", "role", "text"],
        "ordinal",
    )
    keys = materialise(prefix_keys(placed.select("conv", "ordinal", "hash_a", "hash_b"), block), "keys")

    # the conversations through a node, and the turn that gives the node its text
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("ordinal").alias("owner"))
    counted = materialise(keys.join(shared, "key"), "counted")
    above = counted.select("conv", (F.col("depth") + 1).alias("depth"), F.col("n").alias("n_above"))
    heads = counted.join(above, ["conv", "depth"], "left").where("n_above is null or n <> n_above")
    members = materialise(
        heads.groupBy("conv").agg(
            F.sort_array(F.collect_list(F.struct("depth", "key"))).alias("path")
        ),
        "members",
    )
    owned = counted.where("ordinal = owner").join(members, "conv").select(
        "ordinal",
        "key",
        "depth",
        F.filter("path", lambda p: p["depth"] <= F.col("depth")).alias("path"),
    )
    nodes = owned.join(placed.select("ordinal", "role", "text"), "ordinal").select(
        "key",
        "depth",
        "path",
        F.element_at("path", -1)["key"].alias("run"),
        encode_turn(tokenizer)(F.col("role"), F.col("text")).alias("t"),
    )
    # stored: encoded once. Places are found without the tokens, which then meet them
    encoded = materialise(nodes.select("key", "depth", "path", "run", "t.*"), "encoded")
    emitted = with_ordinals(
        encoded.select("key", "depth", "path", "run", "n_tokens"),
        ["path", "depth"],
        "node",
        size=F.col("n_tokens"),
        offset_name="start",
    )
    emitted = materialise(emitted, "nodes")

    runs = emitted.groupBy("run").agg(
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("n_tokens")).alias("end"),
        F.min("path").alias("path"),
    )
    above = runs.select("run", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("p"))
    intervals = (
        above.select("run", F.col("p.key").alias("ancestor"))
        .join(runs.select(F.col("run").alias("ancestor"), "start", "end"), "ancestor")
        .groupBy("run")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("attends"))
    )
    no_one = F.array().cast("array<struct<start:bigint,end:bigint>>")
    placed_runs = runs.join(intervals, "run", "left").select(
        "run", F.col("start").alias("run_start"), F.coalesce("attends", no_one).alias("attends")
    )
    before = F.aggregate("attends", F.lit(0).cast("long"), lambda a, i: a + i["end"] - i["start"])
    places = emitted.join(placed_runs, "run").select(
        "node",
        "key",
        "run",
        "depth",
        "start",
        (before + F.col("start") - F.col("run_start")).alias("position"),
        "attends",
    )
    tokens = encoded.select("key", "tokens", "n_tokens", "loss_from", "loss_to")
    final = places.join(tokens, "key")
    ids = members.select(
        F.when(~F.col("conv.no_id"), F.col("conv.id")).alias("conv_id"),
        F.transform("path", lambda p: p["key"]).alias("runs"),
    )
    return PrefixTree(final, ids)


def conversations_of(tree: PrefixTree) -> DataFrame:
    """``conv, conv_id, depth, tokens, loss_from, loss_to``: the emitted nodes of
    every conversation."""
    member = tree.members.select("conv_id", F.explode("runs").alias("run"))
    return member.join(tree.nodes, "run").select("conv_id", "depth", "tokens", "loss_from", "loss_to")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(tree: PrefixTree, tokenizer: str) -> DataFrame:
    """A digest of every conversation, decoded from the emitted tokens.

    Sorted turns stream through a task, so a conversation of any length takes
    the memory of a turn.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done, current, state = encoding(tokenizer), [], object(), None
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))

        def close():
            turns, loss = state["turns"], state["loss"]
            done.append([current, state["n"], turns.hexdigest(), state["chars"], loss.hexdigest(), state["all"]])

        def flush():
            batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema)
            done.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != current:
                    if state is not None:
                        close()
                    current = row["conv_id"]
                    state = {"n": 0, "chars": 0, "all": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
                formatted = known.decode(row["tokens"])
                state["all"] += len(formatted)
                for role, text in read_turns(formatted):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                learned = unescape(known.decode(row["tokens"][row["loss_from"] : row["loss_to"]]))
                state["chars"] += len(learned)
                state["loss"].update(learned.encode())
            if len(done) >= 1000:
                yield flush()
        if state is not None:
            close()
        yield flush()

    turns = conversations_of(tree)
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(digest, DIGEST)


@query()
def op5_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that contains the template's own
    control strings, read back from the prefix tree."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)],
        "conv_id long, turn long, role string, text string",
    )
    path = tokenizer_path()
    return read_back(prefix_tree(chats.unionByName(own), path), path)
