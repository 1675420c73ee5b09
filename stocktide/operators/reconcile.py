"""Coherent forecasts over a strict tree of nodes: bottom-up, top-down, minimum trace by variances in two passes or by a full covariance, and daily against weekly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import div
from ..sources.store import materialised


def proportions(history: DataFrame, key: str = "series_id") -> DataFrame:
    """history: key, date, sales. Mean daily share over days with sales, made to sum to one."""
    days = history.groupBy("date").agg(F.sum("sales").alias("day")).where("day > 0")
    share = history.select(key, "date", "sales").join(days, "date").groupBy(key).agg(F.avg(F.col("sales") / F.col("day")).alias("share"))
    total = F.broadcast(share.agg(F.sum("share").alias("_total")))  # one row
    return share.crossJoin(total).select(key, div(F.col("share"), F.col("_total")).alias("proportion"))


def top_down(props: DataFrame, total: DataFrame) -> DataFrame:
    return props.crossJoin(total).withColumn("forecast", F.col("proportion") * F.col("forecast"))


def mint_tree(base: DataFrame, depth: int, by: list[str]) -> DataFrame:
    """Weighted least squares with the constraint that parents are their children's sums.

    base: by, node, parent, level (0 the root to `depth` the leaves), y, w (the variance, at least 1e-9). Up: a node's estimate
    from its own value and its children's sum, weighted by their precision; down: each parent's gap is shared by the children's variances.
    One aggregate and one join a level, all keyed by node: nothing the size of the summing matrix is ever built.
    """
    base = base.withColumn("w", F.greatest("w", F.lit(1e-9)))
    up = {depth: base.where(F.col("level") == depth).select(*by, "node", "parent", F.col("y").alias("m"), F.col("w").alias("v"))}
    sums = {}
    for level in range(depth - 1, -1, -1):
        sums[level] = up[level + 1].groupBy(*by, F.col("parent").alias("node")).agg(F.sum("m").alias("sm"), F.sum("v").alias("sv"))
        j = base.where(F.col("level") == level).join(sums[level], [*by, "node"])
        v = 1 / (1 / F.col("w") + 1 / F.col("sv"))
        up[level] = j.select(*by, "node", "parent", (v * (F.col("y") / F.col("w") + F.col("sm") / F.col("sv"))).alias("m"), v.alias("v"))
    x = up[0].select(*by, "node", F.col("m").alias("x"))
    out = x.withColumn("level", F.lit(0))
    for level in range(1, depth + 1):
        gap = x.join(sums[level - 1], [*by, "node"]).select(*by, F.col("node").alias("parent"), (F.col("x") - F.col("sm")).alias("gap"), "sv")
        x = up[level].join(gap, [*by, "parent"]).select(*by, "node", (F.col("m") + F.col("v") / F.col("sv") * F.col("gap")).alias("x"))
        out = out.unionByName(x.withColumn("level", F.lit(level)))
    return out.withColumnRenamed("x", "forecast")


def mint_dense(summing, y, w):
    """The same by the dense formula, for tests."""
    import numpy as np

    s, wi = np.asarray(summing, float), np.diag(1 / np.asarray(w, float))
    return s @ np.linalg.pinv(s.T @ wi @ s) @ s.T @ wi @ np.asarray(y, float)


def clip_and_add_up(leaves: DataFrame, levels: dict[str, list[str]], by: list[str]) -> DataFrame:
    """Leaves clipped at zero and every level their sum, in one pass of grouping sets."""
    leaf = leaves.withColumn("forecast", F.greatest("forecast", F.lit(0.0)))
    cols = [c for c in dict.fromkeys(c for v in levels.values() for c in v)]
    g = leaf.groupingSets([[*by, *v] for v in levels.values()], *by, *cols).agg(F.sum("forecast").alias("forecast"))
    return g


def temporal(daily: DataFrame, weekly: DataFrame, by: list[str]) -> DataFrame:
    """daily: by, week, step, forecast, vd; weekly: by, week, total, vw. Whole weeks; the gap is shared equally over the seven days."""
    w = W.partitionBy(*by, "week")
    j = daily.join(weekly, [*by, "week"])
    gap = F.col("total") - F.sum("forecast").over(w)
    adjust = F.coalesce(div(gap * F.col("vd"), F.col("vw") + 7 * F.col("vd")), F.lit(0.0))
    return j.select(*by, "week", "step", F.greatest(F.col("forecast") + adjust, F.lit(0.0)).alias("forecast"))


def shrinkage(errors: DataFrame) -> tuple[DataFrame, float]:
    """errors: node, date, error. (a, b, r: the off-diagonal correlations that are not zero, and the shrinkage intensity).

    The intensity is the sum of the variances of all off-diagonal sample correlations over the sum of their squares (Schaefer and
    Strimmer), between 0 and 1; products of standardised errors are one join on the date and one aggregate.
    """
    stat = errors.groupBy("node").agg(F.avg(F.col("error") ** 2).alias("_v")).where("_v > 0")  # around zero, as forecasts are to have no bias
    z = errors.join(stat, "node").select("node", "date", (F.col("error") / F.sqrt("_v")).alias("z"))
    pairs = z.select(F.col("node").alias("a"), "date", F.col("z").alias("za")).join(z.select(F.col("node").alias("b"), "date", F.col("z").alias("zb")), "date").where("a < b")
    x = F.col("za") * F.col("zb")
    each = materialised(pairs.groupBy("a", "b").agg(F.avg(x).alias("r"), (F.var_samp(x) / F.count("*")).alias("var")), "products")
    top, below = each.agg(F.sum("var"), F.sum(F.col("r") ** 2)).first()
    return each.select("a", "b", "r"), min(max(top / below, 0.0), 1.0) if below else 1.0


def mint_shrunk(base: DataFrame, errors: DataFrame, tolerance: float = 1e-7, rounds: int = 200) -> DataFrame:
    """Minimum-trace reconciliation with a full error covariance W, shrunk towards its diagonal.

    base: step, node, parent, level (0 the root), y, w. W has the variances w (their mean over the steps) and the correlations of `errors`
    times one less the intensity. The coherent forecasts are y - W C' z with C W C' z = C y, where row p of C is node p less its children:
    conjugate gradients over the edge tables, for all steps at once. Neither the summing matrix nor the inverse of W is
    ever built. W itself has a row for each pair of nodes, so this is for trees of thousands of nodes. Returns step, node, level, forecast.
    """
    tree = materialised(base.groupBy("node", "parent", "level").agg(F.avg("w").alias("w")), "tree")
    correlated, intensity = shrinkage(errors)
    sd = tree.select("node", F.sqrt("w").alias("sd"))
    near = correlated.join(sd.withColumnsRenamed({"node": "a", "sd": "sa"}), "a").join(sd.withColumnsRenamed({"node": "b", "sd": "sb"}), "b").select("a", "b", (F.lit(1 - intensity) * F.col("r") * F.col("sa") * F.col("sb")).alias("c"))
    w = materialised(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")).unionByName(tree.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("w").alias("c"))), "covariance")
    inner = tree.select(F.col("parent").alias("p")).where("p <> ''").distinct()
    c = inner.select("p", F.col("p").alias("node"), F.lit(1.0).alias("s")).unionByName(tree.where("parent <> ''").select(F.col("parent").alias("p"), "node", F.lit(-1.0).alias("s")))
    c = materialised(c, "constraints")

    # C W and C W C', a row for each inner node and node, and for each pair of inner nodes: never more than W
    cw = materialised(c.join(w, F.col("node") == F.col("b")).groupBy("p", F.col("a").alias("node")).agg(F.sum(F.col("s") * F.col("c")).alias("g")), "gains")
    cwc = materialised(cw.join(c.withColumnRenamed("p", "p2"), "node").groupBy("p2", "p").agg(F.sum(F.col("g") * F.col("s")).alias("m")), "system")
    gap = base.select("step", "node", "y").join(c, "node").groupBy("step", "p").agg(F.sum(F.col("s") * F.col("y")).alias("r"))
    state = materialised(gap.select("step", "p", F.lit(0.0).alias("z"), "r", F.col("r").alias("d")), "gradients")
    first = None
    for _ in range(rounds):
        size = state.agg(F.max(F.abs("r"))).first()[0] or 0.0
        first = size if first is None else first
        if size <= tolerance * max(first, 1.0):
            break
        q = state.select("step", F.col("p").alias("p2"), "d").join(cwc, "p2").groupBy("step", "p").agg(F.sum(F.col("m") * F.col("d")).alias("q"))
        j = materialised(state.join(q, ["step", "p"]), "gradients")
        dots = F.broadcast(j.groupBy("step").agg(div(F.sum(F.col("r") ** 2), F.sum(F.col("d") * F.col("q"))).alias("alpha"), F.sum(F.col("r") ** 2).alias("rr")))  # a row a step
        moved = j.join(dots, "step").select("step", "p", (F.col("z") + F.coalesce("alpha", F.lit(0.0)) * F.col("d")).alias("z"), (F.col("r") - F.coalesce("alpha", F.lit(0.0)) * F.col("q")).alias("r"), "d", "rr")
        beta = F.broadcast(moved.groupBy("step").agg(F.coalesce(div(F.sum(F.col("r") ** 2), F.first("rr")), F.lit(0.0)).alias("beta")))
        state = moved.join(beta, "step").select("step", "p", "z", "r", (F.col("r") + F.col("beta") * F.col("d")).alias("d"))
    change = state.join(cw, "p").groupBy("step", "node").agg(F.sum(F.col("g") * F.col("z")).alias("change"))
    return base.join(change, ["step", "node"], "left").select("step", "node", "level", (F.col("y") - F.coalesce("change", F.lit(0.0))).alias("forecast"))
