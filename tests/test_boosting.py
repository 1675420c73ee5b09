"""Histogram boosting against plain splits, separate fits and known means."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocktide.operators import boosting as bo


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    out = []
    for i in range(1500):
        store, a, b, c = "st"[i % 2], float(r.integers(0, 40)), float(r.normal()), "xyz"[int(r.integers(0, 3))]
        mean = np.exp(0.05 * a + {"x": 0.0, "y": 1.0, "z": -1.0}[c] + (0.5 if store == "s" else 0.0))
        out.append((store, a, None if i % 17 == 0 else b, c, float(r.poisson(mean)), i))
    return spark.createDataFrame(out, "store_id string, a double, b double, c string, y double, i int").repartition(4)


def one_tree(x, y, start, numeric, depth, rate, least, l2):
    """A tree grown row by row sets, every split tried: leaf values of each row."""
    value = np.zeros(len(y))

    def grow(idx, level):
        g, h = bo.slopes("tweedie", 0.5, y[idx], np.full(len(idx), start))
        value[idx] = -rate * g.sum() / (h.sum() + l2) if level else 0.0
        best = (1e-9, None)
        if level < depth:
            for k in range(x.shape[1]):
                bins = np.unique(x[idx, k])
                if k >= numeric:
                    bins = sorted(bins, key=lambda b: g[x[idx, k] == b].sum() / (h[x[idx, k] == b].sum() + l2))
                for n in range(1, len(bins)):
                    left = np.isin(x[idx, k], bins[:n])
                    if min(left.sum(), (~left).sum()) < least:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, left)
        if best[1] is not None:
            grow(idx[best[1]], level + 1)
            grow(idx[~best[1]], level + 1)

    grow(np.arange(len(y)), 0)
    return value


def test_one_tree_equals_every_split_tried(rows):
    m = [bo.Wanted("all", "f")]
    forest = bo.fit(rows, "y", {"f": F.lit(True)}, m, ["a", "b"], ["c"], trees=1, depth=3, rate=1.0)
    pdf = rows.toPandas()
    import pyarrow as pa

    x, y = forest.bins(pa.RecordBatch.from_pandas(pdf[["a", "b", "c"]])), pdf["y"].to_numpy()
    feature, mask, value = forest.trees[0][0]
    want = one_tree(x, y, forest.start[0], 2, 3, 1.0, 20, 1.0)
    assert np.allclose(value[bo.descend(x, feature, mask)], want)
    assert len(np.unique(want)) > 4 and forest.codes == [{"x": 1, "y": 2, "z": 3}]


def test_models_of_stores_equal_separate_fits(rows):
    learn = {"f": F.col("i") < 1200, "g": F.col("i") < 900}
    models = [bo.Wanted("all", "f"), bo.Wanted("s", "f", "s"), bo.Wanted("t", "g", "t"), bo.Wanted("none", "f", "nowhere")]
    how = {"trees": 6, "depth": 3, "rate": 0.3}
    together = bo.fit(rows, "y", learn, models, ["a", "b"], ["c"], **how)
    for k, m in enumerate(models[:3]):
        alone = bo.fit(rows, "y", learn, [m], ["a", "b"], ["c"], **how)
        for a, b in zip(together.trees[k], alone.trees[0], strict=True):
            assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))
    got = bo.predict(together, rows, ["s", "t", "none"], ["i"])
    assert {(r.model, r["count"]) for r in got.groupBy("model").count().collect()} == {("s", 750), ("t", 750)}
    longer = bo.fit(rows, "y", learn, models, ["a", "b"], ["c"], warm=bo.fit(rows, "y", learn, models, ["a", "b"], ["c"], trees=4, depth=3, rate=0.3), trees=2, depth=3, rate=0.3)
    assert all(np.allclose(longer.trees[0][t][2], together.trees[0][t][2]) for t in range(6))  # a warm start goes on where it stopped


def test_losses_find_means_and_quantiles(rows):
    models = [bo.Wanted("mean", "f"), bo.Wanted("q90", "f", loss="pinball", level=0.9), bo.Wanted("q10", "f", loss="pinball", level=0.1)]
    forest = bo.fit(rows, "y", {"f": F.lit(True)}, models, ["a", "b"], ["c", "store_id"], trees=40, depth=4, rate=0.2)
    got = bo.predict(forest, rows, ["mean", "q90", "q10"], ["i", "y", "c"])
    s = {r.model: r for r in got.groupBy("model").agg(F.avg("forecast").alias("f"), F.avg("y").alias("y"), F.avg((F.col("y") <= F.col("forecast")).cast("int")).alias("below"), F.min("forecast").alias("low")).collect()}
    assert abs(s["mean"].f / s["mean"].y - 1) < 0.03 and 0.85 < s["q90"].below < 0.97 and s["q10"].below < 0.35 and min(r.low for r in s.values()) >= 0
    by = {(r.c): r.f / r.y for r in got.where("model = 'mean'").groupBy("c").agg(F.avg("forecast").alias("f"), F.avg("y").alias("y")).collect()}
    assert all(abs(v - 1) < 0.1 for v in by.values())
