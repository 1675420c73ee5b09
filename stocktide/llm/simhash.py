"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Fingerprints are the leaves of a binary trie, one level a bit. Two nodes of one depth are traversed together: the pair keeps
the number of bits in which the prefixes differ, its children are the four pairs of child nodes, and a pair beyond the error
budget is dropped with all below it. Distinct fingerprints are dealt to the node pairs of a fixed depth, chosen so that a
node holds a bounded number on average; each task goes on from its pair with numpy over sorted arrays, where a node is a range. A task
links what it finds into trees (one link a fingerprint, not one a pair), and the trees are joined by star contraction.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; copies share a fingerprint
and are never expanded into pairs; a null id takes part but is never the least id; repeated rows are returned each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, id_and_text, slices, written
from .graph import components

SEED = 42
NODE = 2000  # fingerprints in a node of the depth at which tasks begin, on average
HEAVY = 100_000  # fingerprints that a node may hold before it is dealt again further down
DEEPER = 10  # bits
_BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits, each set if it is set in over half the XXH64 hashes of the text's word shingles; 0 without a word."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return majority(np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :].tolist())], "<u8"))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


_ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            yield as_batch(_ARROW, ids, np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(a: np.ndarray, b: np.ndarray | None, budget: int, depth: int, differing: int = 0, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of all pairs within budget, from the node pair (a, b) of the given depth; b None: pairs of a with itself.

    a and b: sorted distinct uint64 that share their first `depth` bits. The frontier is gone through depth first in pieces
    of at most `most` node pairs, which bounds memory.
    """
    self_join = b is None
    b = a if self_join else b
    if not len(a) or not len(b):
        return
    stack = [(depth, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), differing)))]
    while stack:
        level, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > most:
            for at in range(0, len(alo), most):
                stack.append((level, *(x[at : at + most] for x in (alo, ahi, blo, bhi, diff))))
            continue
        # small pairs of nodes are compared outright
        small = (ahi - alo) * (bhi - blo) <= 8 if level < 64 else np.ones(len(alo), bool)
        if small.any():
            na, nb = (ahi - alo)[small], (bhi - blo)[small]
            n = na * nb
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(alo[small], n) + k // np.repeat(nb, n)
            j = np.repeat(blo[small], n) + k % np.repeat(nb, n)
            keep = np.bitwise_count(a[i] ^ b[j]) <= budget
            if self_join:
                keep &= i < j
            if keep.any():
                yield i[keep], j[keep]
            alo, ahi, blo, bhi, diff = (x[~small] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        bit = np.uint64(1) << np.uint64(63 - level)
        above = ~((bit << np.uint64(1)) - np.uint64(1)) if level else np.uint64(0)
        amid = np.searchsorted(a, (a[alo] & above) | bit)
        bmid = np.searchsorted(b, (b[blo] & above) | bit)
        same = (alo == blo) & (ahi == bhi) if self_join else np.zeros(len(alo), bool)
        kids = [(alo, amid, blo, bmid, diff), (amid, ahi, bmid, bhi, diff), (alo, amid, bmid, bhi, diff + 1)]
        kids.append(tuple(x[~same] for x in (amid, ahi, blo, bmid, diff + 1)))  # of a node with itself, the mirror of the third
        kids = [np.concatenate(x) for x in zip(*kids, strict=True)]
        keep = (kids[0] < kids[1]) & (kids[2] < kids[3]) & (kids[4] <= budget)
        stack.append((level + 1, *(x[keep] for x in kids)))


def least_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of n places, the least that each can reach over the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            li, lj = label[i], label[j]
            open_ = li != lj
            if not open_.any():
                break
            i, j, li, lj = i[open_], j[open_], li[open_], lj[open_]
            np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
            while (label[label] != label).any():
                label = label[label]
    return label


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(distinct: DataFrame, budget: int = 2, node: int = NODE, heavy: int = HEAVY, depth: int | None = None) -> DataFrame:
    """(a, b): trees that connect exactly the fingerprints (column fp, distinct) that chains of pairs within budget connect.

    Where near copies crowd a node beyond `heavy` fingerprints, its pairs are not made at this depth: its fingerprints and those
    of the nodes near it are dealt again DEEPER bits further down, until no node is crowded.
    """
    if depth is None:
        n, depth = distinct.count(), 0
        while depth < 20 and n > node << depth:
            depth += 1
    masks = [sum(1 << k for k in bits) for size in range(budget + 1) for bits in combinations(range(depth), size)]
    near = F.array(*(F.lit(m).cast("long") for m in masks))
    prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    placed = distinct.select("fp", prefix.alias("p"))
    dealt = placed.select("fp", "p", F.explode(near).alias("m")).select("fp", "p", F.col("p").bitwiseXOR(F.col("m")).alias("q"))
    dealt = dealt.select("fp", F.least("p", "q").alias("left"), F.greatest("p", "q").alias("right"))
    below = None
    if depth + DEEPER <= 60:
        crowded = written(placed.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("p"), "crowded")
        if crowded.limit(1).count():
            around = crowded.select(F.explode(near).alias("m"), "p").select(F.col("p").bitwiseXOR(F.col("m")).alias("p")).distinct()
            below = links(written(placed.join(around, "p", "left_semi").select("fp"), "around"), budget, node, heavy, depth + DEEPER)
            dealt = dealt.join(crowded.withColumnRenamed("p", "left"), "left", "left_anti").join(crowded.withColumnRenamed("p", "right"), "right", "left_anti")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        left, right = (k.as_py() for k in key)
        fps = np.sort(table.column("fp").to_numpy().view(np.uint64))
        if left == right:
            label = least_labels(len(fps), trie_pairs(fps, None, budget, depth))
        else:
            cut = int(np.searchsorted(fps, np.uint64(right << (64 - depth))))
            label = least_labels(len(fps), ((i, j + cut) for i, j in trie_pairs(fps[:cut], fps[cut:], budget, depth, (left ^ right).bit_count())))
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return pa.Table.from_batches([as_batch(_LINKS, fps[moved].view(np.int64), fps[label[moved]].view(np.int64))])

    found = dealt.groupBy("left", "right").applyInArrow(run, "a long, b long")
    return found if below is None else found.unionByName(below)


def near_duplicates(df: DataFrame, budget: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id that chains of links reach."""
    docs = written(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), budget)).withColumnRenamed("node", "fp")
    of = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = of.join(least, "root").select("fp", "component_id")
    return docs.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
