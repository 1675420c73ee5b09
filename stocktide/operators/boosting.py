"""Histogram boosting over a cluster, with Tweedie and pinball losses, many models at once.

Rows are binned once and kept as blocks of small integers; the current prediction of each row is a second, aligned data set. A level of a
tree is one aggregate: gradients, hessians and counts by (model, node, feature, bin), added up by model, and the best split of each node
found where a model's sums meet. Only splits come to the driver. All models (folds, one pooled or one for each store, losses) grow in
the same aggregates, so the number of jobs depends on trees and depth alone. Blocks and predictions are RDDs of numpy arrays: hundreds
of small passes over the same rows would each pay for planning a query. Predictions are written by checkpoint() every few trees, so a lost
executor costs those few.

A split is a set of bins that go left, a 64-bit mask: bins up to a cut for numbers, and for categories those with the lowest gradient
over hessian. NULLs and unknown categories are bin 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder

BINS = 64
POWER = 1.1  # of the Tweedie loss
BLOCK_ROWS = 200_000
CHECKPOINT_EVERY = 25
DIGEST = 65


@dataclass(frozen=True)
class Wanted:
    """One model: the fold it may learn from, the store whose rows it is for (None: all), its loss (tweedie, or pinball at `level`)."""

    name: str
    fold: str
    store: str | None = None
    loss: str = "tweedie"
    level: float = 0.5


@dataclass
class Forest:
    numeric: list[str]
    cuts: list[list[float]]
    categorical: list[str]
    codes: list[dict[str, int]]
    models: list[Wanted]
    start: list[float] = field(default_factory=list)
    #: Of each model, its trees: (feature, mask, value) of the nodes in breadth-first order; feature -1 marks a leaf.
    trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, len(self.numeric) + len(self.categorical)), np.uint8)
        for k, (c, cuts) in enumerate(zip(self.numeric, self.cuts, strict=True)):
            x = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts, x, side="right"))
        for k, (c, codes) in enumerate(zip(self.categorical, self.codes, strict=True), len(self.numeric)):
            out[:, k] = [codes.get(v, 0) for v in batch.column(c).to_pylist()]
        return out


def descend(x: np.ndarray, feature: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The node of a tree that each row of bins reaches."""
    at = np.zeros(len(x), np.int64)
    while True:
        f = feature[at]
        go = np.flatnonzero(f >= 0)
        if not len(go):
            return at
        left = (mask[at[go]] >> x[go, f[go]].astype(np.uint64)) & np.uint64(1)
        at[go] = 2 * at[go] + 2 - left.astype(np.int64)


def slopes(loss: str, level: float, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian. tweedie: f is the log of the mean."""
    if loss == "tweedie":
        a, b = y * np.exp((1 - POWER) * f), np.exp((2 - POWER) * f)
        return b - a, (POWER - 1) * a + (2 - POWER) * b
    return np.where(y < f, 1 - level, -level), np.ones(len(y))


def histograms(x: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of g, h and 1 by node, feature and bin."""
    wide = x.shape[1]
    at = ((node[:, None] * wide + np.arange(wide)) * BINS + x).ravel()
    weights = (np.repeat(g, wide), np.repeat(h, wide), None)
    return np.stack([np.bincount(at, w, nodes * wide * BINS) for w in weights]).reshape(3, nodes, wide, BINS)


def best_splits(sums: np.ndarray, numeric: int, least: int, l2: float) -> list[tuple]:
    """For each node (gain, feature, mask, sums left, sums right); feature -1 where no split gains."""
    order = np.broadcast_to(np.arange(BINS), sums.shape[1:]).copy()
    order[:, numeric:] = np.argsort(sums[0, :, numeric:] / (sums[1, :, numeric:] + l2), axis=-1, kind="stable")
    left = np.take_along_axis(sums, order[None], -1).cumsum(axis=-1)
    total, left = left[..., -1:], left[..., :-1]
    right = total - left
    worth = lambda s: s[0] ** 2 / (s[1] + l2)
    gain = worth(left) + worth(right) - worth(total)
    gain[(left[2] < least) | (right[2] < least)] = -np.inf
    out = []
    for node, flat in enumerate(gain.reshape(len(gain), -1)):
        k, at = divmod(int(flat.argmax()), BINS - 1)
        if flat.max() <= 1e-9:
            out.append((0.0, -1, 0, None, None))
        else:
            out.append((float(flat.max()), k, sum(1 << int(b) for b in order[node, k, : at + 1]), left[:, node, k, at], right[:, node, k, at]))
    return out


def _digest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values at equal ranks, with the rows that each stands for: a merged quantile's rank is off by 1 / (DIGEST - 1) at most."""
    return np.quantile(values, np.linspace(0, 1, DIGEST)), np.full(DIGEST, len(values) / DIGEST)


def _quantile(digests: list, level: float) -> float:
    v, w = (np.concatenate(x) for x in zip(*digests, strict=True))
    order = np.argsort(v, kind="stable")
    return float(v[order][min(np.searchsorted(np.cumsum(w[order]), level * w.sum()), len(v) - 1)])


def _bins_of(rows: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[list, list]:
    """Cuts of each number at (approximate) equal shares, and codes of the most frequent BINS - 1 values of each category."""
    shares = [i / (BINS - 2) for i in range(1, BINS - 2)]
    cuts = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 2000).alias(c) for c in numeric)).first()
    codes = []
    for c in categorical:
        top = rows.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(BINS - 1).collect()
        codes.append({r[c]: k + 1 for k, r in enumerate(sorted(top, key=lambda r: r[c]))})
    return [sorted(set(cuts[c] or [])) for c in numeric], codes


def fit(rows: DataFrame, label: str, learn: dict[str, Column], models: list[Wanted], numeric: list[str], categorical: list[str], store: str = "store_id", trees: int = 300, depth: int = 5, rate: float = 0.05, least: int = 20, l2: float = 1.0, warm: Forest | None = None) -> Forest:
    """rows: features, label and store. learn: fold -> which rows its models may see. warm: a forest of the same models whose trees are kept
    and continued, with its bins. A model without a row predicts 0.
    """
    spark = rows.sparkSession
    if warm is None:
        cuts, codes = _bins_of(rows, numeric, categorical)
        forest = Forest(numeric, cuts, categorical, codes, models)
    else:
        forest = replace(warm, start=list(warm.start), trees=[list(t) for t in warm.trees])
    sc, folds = spark.sparkContext, list(learn)
    sc.setCheckpointDir(f"{shared_folder(spark)}/boosting")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = (forest.bins(b), b.column("_y").to_numpy(zero_copy_only=False), np.array(b.column("_s").to_pylist(), object), np.stack([b.column(f"_f{k}").to_numpy(zero_copy_only=False).astype(bool) for k in range(len(folds))]))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part)], pa.binary())], ["block"])

    flags = [F.coalesce(c, F.lit(False)).alias(f"_f{k}") for k, c in enumerate(learn.values())]
    columns = [F.col(c).cast("double").alias(c) for c in numeric] + [F.col(c).cast("string").alias(c) for c in categorical]
    # neighbours in (store, row) order lie together, so that few tasks hold rows of one store, and none all of a large one
    data = rows.select(*columns, F.col(label).cast("double").alias("_y"), F.col(store).cast("string").alias("_s"), *flags).repartitionByRange("_s", *forest.numeric[:2], "_y").mapInArrow(block, "block binary")
    blocks = data.rdd.map(lambda r: pickle.loads(r[0])).glom().persist(StorageLevel.MEMORY_AND_DISK)  # a list of blocks a partition

    def mine(part, m: Wanted) -> np.ndarray:
        _, _, stores, seen = part
        return np.flatnonzero(seen[folds.index(m.fold)] & ((stores == m.store) if m.store is not None else True))

    sums = blocks.flatMap(lambda parts: [(k, np.array([p[1][i].sum(), len(i)])) for p in parts for k, m in enumerate(models) for i in [mine(p, m)]]).reduceByKey(np.add).collectAsMap()
    if warm is None:
        mean = lambda k: sums[k][0] / sums[k][1] if k in sums and sums[k][1] else 0.0
        forest.start = [float(np.log(max(mean(k), 1e-6))) if m.loss == "tweedie" else mean(k) for k, m in enumerate(models)]
        forest.trees = [[] for _ in models]
    known = [list(t) for t in forest.trees]

    def first(parts):
        out = []
        for p in parts:
            state = {}
            for k, m in enumerate(models):
                i = mine(p, m)
                if len(i):
                    f = np.full(len(i), forest.start[k])
                    for feature, mask, value in known[k]:
                        f += value[descend(p[0][i], feature, mask)]
                    state[k] = (i, f)
            out.append(state)
        return out

    state = blocks.map(first).persist(StorageLevel.MEMORY_AND_DISK)
    size, live = 2 ** (depth + 1) - 1, [k for k in range(len(models)) if k in sums and sums[k][1]]
    for tree in range(trees):
        grown = {k: (np.full(size, -1, np.int64), np.zeros(size, np.uint64), np.zeros(size)) for k in live}
        for level in range(depth):
            nodes, offset, shape = 2**level, 2**level - 1, {k: g[:2] for k, g in grown.items()}

            def level_sums(pair, shape=shape, nodes=nodes, offset=offset):
                out = {}
                for (x, y, _, _), own in zip(*pair, strict=True):
                    for k, (i, f) in own.items():
                        at = descend(x[i], *shape[k]) - offset
                        here = at >= 0  # rows that stopped at a leaf above are done
                        g, h = slopes(models[k].loss, models[k].level, y[i], f)
                        s = histograms(x[i][here], at[here], nodes, g[here], h[here])
                        out[k] = out[k] + s if k in out else s
                return out.items()

            split = blocks.zip(state).flatMap(level_sums).reduceByKey(np.add).mapValues(lambda s: best_splits(s, len(numeric), least, l2)).collectAsMap()
            for k, found in split.items():
                feature, mask, value = grown[k]
                for node, (_, f, m, left, right) in enumerate(found):
                    if f >= 0:
                        feature[offset + node], mask[offset + node] = f, np.uint64(m)
                        for child, s in ((1, left), (2, right)):
                            value[2 * (offset + node) + child] = -rate * s[0] / (s[1] + l2)
        if any(models[k].loss != "tweedie" for k in live):
            shape = {k: g[:2] for k, g in grown.items() if models[k].loss != "tweedie"}

            def leaf_digests(pair, shape=shape):
                for (x, y, _, _), own in zip(*pair, strict=True):
                    for k, (i, f) in own.items():
                        if k in shape:
                            at = descend(x[i], *shape[k])
                            for leaf in np.unique(at):
                                yield (k, int(leaf)), [_digest((y[i] - f)[at == leaf])]

            leaves = blocks.zip(state).flatMap(leaf_digests).reduceByKey(lambda a, b: a + b).map(lambda kv: (kv[0], _quantile(kv[1], models[kv[0][0]].level))).collectAsMap()
            for (k, leaf), q in leaves.items():
                grown[k][2][leaf] = rate * q
        for k, g in grown.items():
            forest.trees[k].append(g)

        def step(pair, grown=grown):
            return [{k: (i, f + grown[k][2][descend(x[i], *grown[k][:2])]) for k, (i, f) in own.items()} for (x, _, _, _), own in zip(*pair, strict=True)]

        before, state = state, blocks.zip(state).map(step).persist(StorageLevel.MEMORY_AND_DISK)
        if (tree + 1) % CHECKPOINT_EVERY == 0:
            state.checkpoint()
        state.count()
        before.unpersist()
    blocks.unpersist()
    state.unpersist()
    return forest


def predict(forest: Forest, rows: DataFrame, names: list[str], keep: list[str], store: str = "store_id") -> DataFrame:
    """keep, model, forecast (at least 0): each named model's forecasts of the rows that are its own."""
    spark, schema = rows.sparkSession, rows.select(*keep).schema
    sent = spark.sparkContext.broadcast(forest)  # nodes of the trees: 2 ** depth a tree and model
    which = [k for k, m in enumerate(forest.models) if m.name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for b in batches:
            x, stores = f.bins(b), np.array(b.column("_s").to_pylist(), object)
            for k in which:
                m = f.models[k]
                i = np.flatnonzero((stores == m.store) if m.store is not None else np.ones(len(x), bool))
                if not len(i):
                    continue
                out = np.full(len(i), f.start[k])
                for feature, mask, value in f.trees[k]:
                    out += value[descend(x[i], feature, mask)]
                out = np.exp(out) if m.loss == "tweedie" and f.trees[k] else np.maximum(out, 0.0) if m.loss != "tweedie" else np.zeros(len(i))
                took = pa.array(i)
                yield pa.RecordBatch.from_arrays([*(b.column(f"_k{n}").take(took) for n in range(len(keep))), pa.array([m.name] * len(i)), pa.array(np.maximum(out, 0.0))], [*keep, "model", "forecast"])

    columns = [F.col(c).cast("double").alias(c) for c in forest.numeric] + [F.col(c).cast("string").alias(c) for c in forest.categorical]
    out = schema.add("model", "string").add("forecast", "double")
    return rows.select(*columns, F.col(store).cast("string").alias("_s"), *(F.col(c).alias(f"_k{n}") for n, c in enumerate(keep))).mapInArrow(run, out)


STORE = "run string, parent string, note string, trees int, forest binary"


def save(spark: SparkSession, path: str, run: str, forest: Forest, parent: str | None = None, note: str = "") -> None:
    """Appends a forest to a model store: its nodes, and the run that it continues."""
    row = (run, parent, note, max((len(t) for t in forest.trees), default=0), bytearray(pickle.dumps(forest)))
    spark.createDataFrame([row], STORE).coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, run: str) -> Forest:
    found = spark.read.schema(STORE).parquet(path).where(F.col("run") == run).select("forest").head(1)
    if not found:
        raise KeyError(f"no run {run!r} in {path}")
    return pickle.loads(found[0].forest)
