"""Chat formatting of reply trees.

Messages point to the message they reply to. Iterative self-joins double the known stretch of every message's way to its
root, so a tree of depth d takes log2(d) joins. Ways that begin at leaves are the branches; they are ranked by their mean score (then
by the least leaf) and each chosen branch becomes one conversation.

Template: <|turn|>role<|text|>text<|end|> and a line feed. Inside roles and texts, control strings (this template's and those
of common chat templates) get a backslash after their < or [, and those that already have backslashes there one
more, which unescape() takes back. loss_starts and loss_ends are the code points of the trained roles' texts.

Defined cases: a null role or text is empty; a reply to a message that is not there is a root; messages that reply to each other in
a ring belong to no branch; of messages with one id the first (least parent, score, role, text) has the replies and the others end
branches of their own; an empty table gives no conversation; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import as_batch, written

TRAINED = ("assistant",)
_REST = r"(?:\||/?s>|/?INST\]|/?SYS>>)"  # what follows the last < or [ of a control string
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})"), re.compile(rf"([<\[])(\\*)\\(?={_REST})")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED) -> tuple[str, list[int], list[int]]:
    """The formatted conversation and where the trained texts begin and end in it."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"<|turn|>{escape(role)}<|text|>", escape(text)
        if role in trained:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, "<|end|>\n"]
        at += len(head) + len(body) + len("<|end|>\n")
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _numbered(messages: DataFrame) -> DataFrame:
    """copy: 0 for the first message of an id (least parent, score, role, text), 1 and up for the repeated ones."""
    order = W.partitionBy("tree", "node").orderBy("parent", "score", "role", "text")
    return messages.withColumn("copy", F.row_number().over(order) - 1)


_NODE = ["tree", "node", "copy"]


def branches(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """messages: tree, node, copy, parent, score. Returns tree, branch (1: the best), place (0: the root), node, copy for each message of the chosen branches.

    After k joins a message knows its ancestor 2^k replies above and the sum of the scores up to there; no path is stored, so
    the work grows with messages times the logarithm of the depth. The chosen leaves then take the same jumps, longest
    first: each doubles the members that are known.
    """
    messages = messages.select(*_NODE, "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    known = messages.where("copy = 0").select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    now = messages.join(known, ["tree", "parent"], "left").select(*_NODE, F.when(F.col("_there"), F.col("parent")).alias("top"), "total", F.lit(1).cast("long").alias("length"))
    now, closed, jumps = written(now, "jumps"), None, []
    left = now.where("top is not null").count()
    while True:
        closed = now.where("top is null") if closed is None else closed.unionByName(now.where("top is null"))
        if not left:
            break
        jumps.append(now.where("top is not null"))
        above = closed.unionByName(jumps[-1]).where("copy = 0").select("tree", F.col("node").alias("top"), F.col("top").alias("_top"), F.col("total").alias("_total"), F.col("length").alias("_length"))
        now = written(jumps[-1].join(above, ["tree", "top"]).select(*_NODE, F.col("_top").alias("top"), (F.col("total") + F.col("_total")).alias("total"), (F.col("length") + F.col("_length")).alias("length")), "jumps")
        still = now.where("top is not null").count()
        # of a depth from 2^k some message always closes; if none does, the rest lead into rings
        left = still if still < left else 0
    replied = messages.where("parent is not null").select("tree", F.col("parent").alias("node"), F.lit(0).alias("copy")).distinct()
    best = W.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), "node", "copy")
    ranked = closed.join(replied, _NODE, "left_anti").withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= top_k)
    members = written(ranked.select("tree", "branch", "node", "copy", (F.col("length") - 1).alias("place")), "members")
    for k, jump in reversed(list(enumerate(jumps))):
        up = members.join(jump.select(*_NODE, "top"), _NODE).select("tree", "branch", F.col("top").alias("node"), F.lit(0).alias("copy"), (F.col("place") - 2**k).alias("place"))
        members = written(members.unionByName(up), "members")
    return members


SCHEMA = "tree long, branch int, formatted string, loss_starts array<long>, loss_ends array<long>"
_ARROW = pa.schema([("tree", pa.int64()), ("branch", pa.int32()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def format_trees(messages: DataFrame, top_k: int = 1, trained: tuple[str, ...] = TRAINED, unique: bool = False) -> DataFrame:
    """messages: tree, node, parent, score, role, text. A row for each chosen branch; see SCHEMA. unique: no id is repeated in a tree."""
    messages = messages.select("tree", "node", "parent", "score", "role", "text")
    messages = messages.withColumn("copy", F.lit(0)) if unique else _numbered(messages)
    turns = branches(messages, top_k).join(messages.select(*_NODE, "role", "text"), _NODE)
    whole = turns.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render([(t["role"], t["text"]) for t in turns], trained) for turns in b.column(2).to_pylist()]
            yield as_batch(_ARROW, b.column(0), b.column(1), *(zip(*made, strict=True) if made else [[]] * 3))

    return whole.mapInArrow(run, SCHEMA)


def linear_messages(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows ordered by turn (ties by role, then text) as trees without forks: each replies to the one before; rows without an id belong to no conversation."""
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    base = rows.select(F.col(id_col).cast("long").alias("tree"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).where("tree is not null")
    return base.withColumn("node", F.row_number().over(order).cast("long")).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read from them and their loss spans alone."""

    def one(text: str, starts: list[int], ends: list[int]) -> tuple:
        turns = parse(text)
        loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(turns), sha(said), len(loss), sha(loss), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(*x) for x in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield as_batch(_DIGEST, b.column(0), *(zip(*rows, strict=True) if rows else [[]] * 5))

    return formatted.select("tree", "formatted", "loss_starts", "loss_ends").mapInArrow(run, DIGEST)
