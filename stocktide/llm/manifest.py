"""Merkle manifest of a dataset, with a proof for every document.

A document's leaf is the SHA-256 of its fields; the leaves of a group (source), ascending by id, and then the groups' roots are the
nodes of a tree of `fanout`. A tree is built in aligned blocks of fanout ** levels nodes: a block is one contiguous matrix of
64-byte hex digests, reshaped to rows of fanout digests that are hashed level by level; its root is a node of the next, smaller
tree, until one is left. Siblings are slices of a block's level matrices, found from positions alone: a node's own siblings in its block,
followed by those of its block. Paths come down the same way, one row a block, so no task holds more than a block and nothing the
size of the data meets in one place.

Defined cases: a null field is `-`; equal ids are ordered by their leaves; a null id comes first, is a `-` in its leaf, and
is never tampered with by `claim`; repeated rows are leaves each; the null group is the first; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .ordering import positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 8
NODES = "key string, pos long, total long, digest string"
PATHS = "key string, pos long, path string, subroot string"


def leaf(values: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the values, each as its UTF-8 length, a colon and itself, `-` for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def depth(total: int, fanout: int) -> int:
    """Levels above `total` nodes until one is left."""
    d = 0
    while total > 1:
        total, d = -(-total // fanout), d + 1
    return d


def level_matrices(digests: list[str], levels: int, fanout: int) -> list[np.ndarray]:
    """Matrices of hex digests, a row a node, from the given nodes up."""
    out = [np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)]
    for _ in range(levels):
        m = out[-1]
        whole = len(m) // fanout
        rows = [*m[: whole * fanout].reshape(whole, 64 * fanout), *([m[whole * fanout :].reshape(-1)] if len(m) % fanout else [])]
        out.append(np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in rows).encode(), np.uint8).reshape(-1, 64))
    return out


def siblings(matrices: list[np.ndarray], fanout: int) -> list[list[tuple[str, str]]]:
    """For each node of the lowest matrix, the digests left and right of it in its run, level by level."""
    text = [m.tobytes().decode() for m in matrices[:-1]]
    out = []
    for node in range(len(matrices[0])):
        path, i = [], node
        for t in text:
            first = i // fanout * fanout
            path.append((t[64 * first : 64 * i], t[64 * (i + 1) : 64 * (first + fanout)]))
            i //= fanout
        out.append(path)
    return out


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a digest and its siblings give."""
    for before, after in path:
        digest = hashlib.sha256((before + digest + after).encode()).hexdigest()
    return digest


def path_text(path: list[tuple[str, str]]) -> str:
    return "".join(f"{a}.{b}\n" for a, b in path)


def path_of(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split(".")) for line in text.split("\n")[:-1]]


class Shape(NamedTuple):
    """Of the trees: nodes of a run, levels of a block."""

    fanout: int = 3
    levels: int = BLOCK_LEVELS

    @property
    def block(self) -> Column:
        return F.floor(F.col("pos") / self.fanout**self.levels).alias("block")

    def matrices(self, block: pa.Table) -> list[np.ndarray]:
        levels = min(self.levels, depth(block.column("total")[0].as_py(), self.fanout))
        return level_matrices(block.column("digest").to_pylist(), levels, self.fanout)


def _up(nodes: DataFrame, shape: Shape) -> DataFrame:
    """The blocks' roots, as nodes of the next tree."""
    size = shape.fanout**shape.levels

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        top = shape.matrices(block)[-1].tobytes().decode()
        return pa.table({"key": block.column("key")[:1], "pos": [block.column("pos")[0].as_py() // size], "total": [-(-block.column("total")[0].as_py() // size)], "digest": [top]})

    return written(nodes.select("key", "pos", "total", "digest", shape.block).groupBy("key", "block").applyInArrow(run, NODES), "nodes")


def _down(nodes: DataFrame, above: DataFrame, shape: Shape) -> DataFrame:
    """The nodes' paths, from those of their blocks (PATHS)."""

    def run(block: pa.Table, up: pa.Table) -> pa.Table:
        block, rest = block.sort_by("pos"), up.column("path")[0].as_py()
        paths = [path_text(p) + rest for p in siblings(shape.matrices(block), shape.fanout)]
        return pa.table({"key": block.column("key"), "pos": block.column("pos"), "path": paths, "subroot": pa.array([up.column("subroot")[0].as_py()] * len(paths), pa.string())})

    left, right = nodes.select("key", "pos", "total", "digest", shape.block), above.withColumnRenamed("pos", "block")
    return left.groupBy("key", "block").cogroup(right.groupBy("key", "block")).applyInArrow(run, PATHS)


def _trees(nodes: DataFrame, shape: Shape) -> list[DataFrame]:
    """nodes and the trees above, the last of which has one node for each key."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(_up(out[-1], shape))
    return out


def _paths(trees: list[DataFrame], top: DataFrame, shape: Shape) -> DataFrame:
    """Paths of the second of the trees' nodes, the blocks of the first, from those of the last (top)."""
    for nodes in reversed(trees[1:-1]):
        top = _down(nodes, top, shape)
    return top


def proofs(df: DataFrame, fields: Sequence[str] = FIELDS, claim: dict[str, Column] | None = None, shape: Shape = Shape(), id_col: str = "doc_id", group_col: str = "source", keep_path: bool = True) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, path (siblings as text, one level a line).

    claim: other values of fields, from which the leaf to be verified is made; without it the original leaf is verified.
    """
    group = F.col(group_col).cast("string")
    claimed = leaf([(claim or {}).get(c, F.col(c)) for c in fields])
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group)).alias("key"), leaf([F.col(c) for c in fields]).alias("digest"), claimed.alias("claim"))
    placed = positions(written(rows, "leaves"), ["key"], [F.col("doc_id").asc_nulls_first(), *(F.conv(F.substring(c, 1, 15), 16, 10).cast("long") for c in ("digest", "claim"))])  # their leading 60 bits
    leaves = written(placed.withColumnRenamed("position", "pos"), "placed")
    trees = _trees(leaves, shape)
    groups = written(positions(trees[-1].select(F.col("key").alias("group"), "digest"), [], [F.col("group")]).select(F.lit("").alias("key"), F.col("position").alias("pos"), "total", "digest", "group"), "groups")
    upper = _trees(groups, shape)
    last = upper[-1].select("digest").first()
    root = last[0] if last else ""
    start = leaves.sparkSession.createDataFrame([("", 0, "", None)], PATHS)
    tops = _down(groups, _paths(upper, start, shape), shape) if len(upper) > 1 else start
    named = tops.drop("key", "subroot").join(groups.select("pos", F.col("group").alias("key"), F.col("digest").alias("subroot")), "pos").select("key", F.lit(0).cast("long").alias("pos"), "path", "subroot")
    above = _paths(trees, named, shape)

    def run(block: pa.Table, up: pa.Table) -> pa.Table:
        block, rest = block.sort_by("pos"), path_of(up.column("path")[0].as_py())
        known, checked, folded, text = "".join(a + b for a, b in rest), [], [], []
        for c, own in zip(block.column("claim").to_pylist(), siblings(shape.matrices(block), shape.fanout), strict=True):
            checked.append(hashlib.sha256(("".join(a + b for a, b in own) + known).encode()).hexdigest())
            folded.append(fold(fold(c, own), rest))
            text.append(path_text(own + rest) if keep_path else None)
        n = len(checked)
        same = lambda v: pa.array([v] * n, pa.string())
        return pa.table({"doc_id": block.column("doc_id"), "leaf": block.column("digest"), "subroot": same(up.column("subroot")[0].as_py()), "root": same(root), "proof_sha256": checked, "folded_root": folded, "verified": [f == root for f in folded], "path": pa.array(text, pa.string())})

    left, right = leaves.withColumn("block", shape.block), above.withColumnRenamed("pos", "block")
    out = left.groupBy("key", "block").cogroup(right.groupBy("key", "block")).applyInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path string")
    return out if keep_path else out.drop("path")


def without_line_ends(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """The claim of a copy whose texts lost their line ends wherever 2 divides the checksum of the id."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return {text_col: F.when(hit, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))}
