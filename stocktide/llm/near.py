"""SimHash near-dedup of a corpus at a similarity: one row stays for each group of texts that chains of 5-word Jaccard similarity of at
least 0.8 connect.

A text is its words (lower-cased, split at white space); texts of the same words are one node. Each node has the SimHash of its
set of 5-word shingles. Two texts of similarity 0.8 differ in some 10 of 64 bits, which no trie of a corpus can be searched for, so
pairs are looked for twice: the trie self-join of simhash.links() finds those within TRIE_BITS, and nodes that share one of BANDS
keys of ROWS min-hashes are compared within BITS. A pair of similarity 0.8 shares no key with probability
(1 - 0.8 ** ROWS) ** BANDS = 1e-5 and differs in over BITS bits with some 1e-5. What is found is checked exactly on the shingle
sets, so nothing is linked that is less similar.

Candidates stay in proportion to the rows where groups are clear: a key's nodes are first compared with its least node, and what
they are linked to is joined. Nodes of a key that are still apart from the group of its least node are then compared with all others
of the key in other groups, in rounds over blocks of some HUBS nodes, four times as many blocks each round, until every block has had
its turn; groups are joined after each round, so that only pairs of different groups are made. No pair of a key is left out but
those that cannot be similar: two of these nodes either have a shingle in common that RARE nodes have at most (such pairs are found
by that shingle) or nothing but their other shingles, which are too few in a cloud of copies with edits of their own.

Defined cases: null, empty and blank texts are one node; a text of fewer than 5 words is one shingle; of a group the row with the
least id stays (rows without an id come last, ties by text, then by place); rows of one id with different texts are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_batch, free_name, written
from .graph import components
from .simhash import SEED, links, majority

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 16, 3
TRIE_BITS, BITS = 2, 22
HUBS = 8
RARE = 32
_PIECE = 1 << 12
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_XOR, _ODD = _MIX[0][:, None], (_MIX[1] * np.uint64(2) + np.uint64(1))[:, None]


def words(text: str) -> list[bytes]:
    return [w.encode() for w in text.lower().split()]


def shingles(ws: list[bytes]) -> np.ndarray:
    """The sorted distinct XXH64 hashes of the word shingles."""
    import xxhash

    if not ws:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) < SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.unique(np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64))


def keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS signed longs, each of ROWS min-hashes and its band's number; none for an empty set."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _PIECE):
        least = np.minimum(least, ((hashes[None, at : at + _PIECE] ^ _XOR) * _ODD).min(axis=1))
    raw = least.astype("<u8").tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[k * 8 * ROWS : (k + 1) * 8 * ROWS], k) for k in range(BANDS)], np.uint64).view(np.int64)


_SIGNED = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("said", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _signed(texts: DataFrame) -> DataFrame:
    """texts: row, id, said (hash of the text), text. Returns row, id, said, node (hash of the words), fp (SimHash), n (shingles) and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                nodes, prints, counts, found = [], [], [], []
                for text in part.column(3).to_pylist():
                    ws = words(text)
                    hashes = shingles(ws)
                    nodes.append(xxhash.xxh64_intdigest(b" ".join(ws), SEED))
                    prints.append(majority(hashes))
                    counts.append(len(hashes))
                    found.append(keys(hashes).tolist() if len(ws) > SHINGLE else [])
                signed = (np.array(x, np.uint64).view(np.int64) for x in (nodes, prints))
                yield as_batch(_SIGNED, part.column(0), part.column(1), part.column(2), *signed, counts, found)

    return texts.mapInArrow(run, "row long, id long, said long, node long, fp long, n long, keys array<long>")


_SET = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def _sets(texts: DataFrame) -> DataFrame:
    """texts: node, text, a row each. Returns node and hashes, its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                each = [shingles(words(t)).view(np.int64) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, each)])
                yield as_batch(_SET, part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *each]))))

    return texts.mapInArrow(run, "node long, hashes array<long>")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose sets' Jaccard similarity is at least LEAST."""
    x, y = (sets.select(F.col("node").alias(side), F.col("hashes").alias(f"of_{side}")) for side in "ab")
    return pairs.join(y, "b").join(x, "a").where(_similar("of_a", "of_b")).select("a", "b")


def _similar(a: str, b: str) -> Column:
    """Whether two sets' Jaccard similarity is at least LEAST: both / (size + size - both)."""
    return (1 + LEAST) * F.size(F.array_intersect(a, b)) >= LEAST * (F.size(a) + F.size(b)) - 1e-9


def _may_be(a: str, b: str) -> Column:
    """Whether two structs (node, fp, n, m) can be similar: their fingerprints differ in BITS at most, and the shingles that they can
    have in common (m of n) suffice for LEAST."""
    need = LEAST / (1 + LEAST) * (F.col(f"{a}.n") + F.col(f"{b}.n")) - 1e-6
    return (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= BITS) & (F.least(f"{a}.m", f"{b}.m") >= need)


def _node() -> Column:
    return F.struct("node", "fp", "n", F.col("n").alias("m"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.node", f"{b}.node").alias("a"), F.greatest(f"{a}.node", f"{b}.node").alias("b")]


def _trie_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) from the trie self-join of the fingerprints: nodes of one fingerprint, and nodes whose fingerprints it links."""
    nodes = nodes.where("n > 1")
    first = written(nodes.groupBy("fp").agg(F.min(_node()).alias("x")), "prints")
    of = lambda side: first.select(F.col("fp").alias(side), F.col("x").alias(f"_{side}"))
    far = links(first.select("fp"), TRIE_BITS).join(of("a"), "a").join(of("b"), "b").where(_may_be("_a", "_b")).select(*_pair("_a", "_b"))
    same = nodes.join(first, "fp").select(_node().alias("y"), "x").where("x.node <> y.node").where(_may_be("x", "y")).select(*_pair("x", "y"))
    return far.unionByName(same)


def _in_common(sets: DataFrame) -> DataFrame:
    """node, hash, n (nodes that have it) for each shingle that several nodes of the table have."""
    each = sets.select("node", F.explode("hashes").alias("hash"))
    return each.join(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "hash")


def _grouped(nodes: DataFrame, roots: DataFrame, node: str = "node", group: str = "group") -> DataFrame:
    """nodes with their root as group; a node without links is its own."""
    of = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return nodes.join(of, F.col(node) == F.col("_node"), "left").withColumn(group, F.coalesce("_root", node)).drop("_node", "_root")


def groups(signed: DataFrame, rows: DataFrame) -> DataFrame:
    """signed: row, node, fp, n, keys; rows: row, text. Returns (node, root) for the nodes with links; root: the least node of the group."""
    nodes = written(signed.groupBy("node").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    held = nodes.select(_node().alias("x"), F.explode("keys").alias("key"))
    sizes = held.groupBy("key").agg(F.min("x").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = written(held.join(sizes, "key"), "shared")
    pairs = shared.where("x.node <> least.node").where(_may_be("x", "least")).select(*_pair("x", "least"))
    pairs = written(pairs.unionByName(_trie_pairs(nodes)).distinct(), "pairs")
    used = shared.select("x.node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = written(_sets(rows.join(nodes.join(used, "node", "left_semi").select("row", "node"), "row").select("node", "text")), "sets")
    found = written(_checked(pairs, sets), "links")
    roots = components(found)

    now = _grouped(_grouped(shared.select("key", "x", "least.node").withColumnRenamed("node", "least"), roots, "x.node"), roots, "least", "of_least")
    apart = now.where(F.col("group") != F.col("of_least"))
    blocks = apart.groupBy("key").agg(F.ceil(F.count("*") / HUBS).alias("blocks"))
    at = F.when(F.col("group") != F.col("of_least"), F.pmod(F.xxhash64("x.node", "key"), F.col("blocks")))
    # only keys with nodes that are apart go on; block: NULL for nodes in the group of the key's least node
    now = written(now.join(blocks, "key").select("key", "x", at.alias("block")), "apart")
    common = written(_in_common(sets.join(now.select("x.node").distinct(), "node", "left_semi")), "common")
    # pairs with a rare shingle in common have one among the rarest fifth of either's (RARE nodes a shingle at most)
    place = F.row_number().over(W.partitionBy("node").orderBy("n", "hash"))
    rare = common.where(F.col("n") <= RARE).select("node", "hash", place.alias("place"))
    alone = rare.join(_grouped(now.select("x").distinct(), roots, "x.node"), F.col("node") == F.col("x.node")).where(F.col("place") <= (1 - LEAST) * F.col("x.n") + 2).select("hash", "x", "group")
    other = alone.select("hash", F.col("x").alias("y"), F.col("group").alias("other_group"))
    met = alone.join(other, "hash").where("x.node < y.node and group <> other_group").where(_may_be("x", "y")).select(*_pair("x", "y")).distinct()
    # pairs without one have no more than their other shingles in common
    often = common.where(F.col("n") > RARE).groupBy(F.col("node").alias("_node")).agg(F.count("*").alias("often"))
    now = now.join(often, F.col("x.node") == F.col("_node")).where(F.col("often") >= LEAST * F.col("x.n"))
    now = now.select("key", F.struct("x.node", "x.fp", "x.n", F.col("often").alias("m")).alias("x"), "block", "_node")
    now = written(now.join(sets.withColumnRenamed("node", "_node"), "_node").drop("_node"), "open")
    many, low, high = now.agg(F.max("block")).first()[0], 0, 1
    while met is not None or many is not None and low <= many:
        if met is not None:
            more, met = written(_checked(met, sets), "links"), None
        else:
            grouped = _grouped(now, roots, "x.node")
            hubs = grouped.where(F.col("block").between(low, high - 1)).select("key", F.col("x").alias("hub"), F.col("group").alias("hub_group"), F.col("hashes").alias("hub_hashes"))
            others = grouped.where(F.col("block").isNull() | (F.col("block") >= low))
            # checked in the join, so that only what is similar comes out of it
            met = others.join(hubs, "key").where("group <> hub_group").where(_may_be("x", "hub")).where(_similar("hashes", "hub_hashes"))
            more, met, low, high = written(met.select(*_pair("x", "hub")).distinct(), "links"), None, high, 4 * high + 1
        if more.limit(1).count():
            found = found.unionByName(more)
            roots = components(found)
    return roots


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay: one of each group, rows without an id included."""
    row = free_name(df, "_row")
    placed = written(df.withColumn(row, F.monotonically_increasing_id()), "placed")
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = placed.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("said"), text.alias("text"))
    signed = written(_signed(plain), "signed")
    roots = groups(signed, plain.select("row", "text"))
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "said", "row"))
    stay = _grouped(signed.select("row", "id", "said", "node"), roots).groupBy("group").agg(first.alias("first")).select(F.col("first.row").alias(row))
    return placed.join(stay, row, "left_semi").select(*df.columns)
