"""Operators on small hand-made tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocktide.functions import exprs
from stocktide.operators import allocate, drift, features, forecast, hierarchy, metrics, reconcile, stockouts, uncertainty

D = dt.date(2016, 1, 1)


def day(k):
    return D + dt.timedelta(days=k)


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, day(k), k, v) for k, v in enumerate(values)], "series_id string, date date, day_idx int, sales double")


def test_node_ids_and_selection(spark):
    rows = [("I1", "D", "C", "S1", "X", D, 3.0), ("I1", "D", "C", "S2", "X", D, 4.0), ("I2", "D", "C", "S1", "X", D, 10.0)]
    f = spark.createDataFrame(rows, "item_id string, dept_id string, cat_id string, store_id string, state_id string, date date, sales double")
    up = {r.node_id: r.sales for r in hierarchy.roll_up(f, [F.sum("sales").alias("sales")]).collect()}
    assert up["total:total"] == 17 and up["store:store_id=S1"] == 13 and up["item:item_id=I1|store_id=S2"] == 4 and len(up) == 3 + 2 + 2 + 2 + 1 + 1
    assert hierarchy.select_node(f, "department:dept_id=D|store_id=S1").first().sales == 13
    for bad in ("planet:x=1", "store:dept_id=D"):
        with pytest.raises(ValueError):
            hierarchy.select_node(f, bad)


def test_features_leak_nothing(spark):
    f = features.add_features(series(spark, [float(k) for k in range(120)])).orderBy("date").collect()
    assert f[28].lag_28 == 0 and f[27].lag_28 is None and f[100].lag_56 == 44
    assert f[34].rolling_mean_7 == 3 and f[33].rolling_mean_7 is None and f[119].rolling_mean_56 == np.mean(range(36, 92))
    assert abs(f[119].rolling_std_28 - np.std(range(64, 92), ddof=1)) < 1e-9
    with pytest.raises(ValueError):
        features.add_features(series(spark, [1.0]), lags=(7,))


def test_event_distances(spark):
    event = dt.date(2016, 2, 7)
    days = [event + dt.timedelta(days=k) for k in (-2, -1, 0, 1, 40)]
    c = spark.createDataFrame([(d, "SuperBowl" if d == event else None) for d in days], "date date, event_name string")
    got = [(r.days_to_next, r.days_since) for r in features.event_distance(c).orderBy("date").collect()]
    assert got == [(2, 15), (1, 15), (0, 15), (15, 1), (15, 15)]


def test_stockouts(spark):
    fast = [0.0] * 3 + [5.0] * 40 + [0.0] * 5 + [5.0] * 10
    got = stockouts.probable_stockouts(series(spark, fast)).where("flagged").collect()
    assert sorted(r.day_idx for r in got) == list(range(43, 48)) and {r.run_length for r in got} == {5}
    assert not stockouts.probable_stockouts(series(spark, ([0.0] * 9 + [1.0]) * 6)).where("flagged").count()


def test_classes(spark):
    rev = spark.createDataFrame([(str(k), float(v)) for k, v in enumerate([80, 10, 5, 3, 2])], "series_id string, revenue double")
    assert [r.abc for r in stockouts.abc_class(rev).orderBy("series_id").collect()] == ["A", "B", "B", "C", "C"]
    weeks = {"x": [10, 10, 11, 9], "y": [10, 2, 18, 4], "z": [0, 0, 40, 0], "none": [0, 0, 0, 0]}
    w = spark.createDataFrame([(k, float(v)) for k, vs in weeks.items() for v in vs], "series_id string, sales double")
    assert {r.series_id: r.xyz for r in stockouts.xyz_class(w).collect()} == {"x": "X", "y": "Y", "z": "Z", "none": "Z"}


def test_case_packs(spark):
    q = spark.createDataFrame([(v,) for v in (0.0, 0.2, 6.0, 6.1, 13.0)], "q double")
    assert [r[0] for r in q.select(exprs.round_to_case(F.col("q"), 6)).collect()] == [0, 6, 6, 12, 18]


def test_scorecard_and_windows(spark):
    rows = spark.createDataFrame([("x", 10.0, 8.0), ("x", 0.0, 0.0), ("y", 0.0, 3.0)], "g string, actual double, forecast double")
    s = {r.g: r for r in metrics.scorecard(rows, ["g"]).collect()}
    assert s["x"].wmape == 0.2 and s["x"].mape == 0.2 and s["y"].wmape == 0 and s["x"].n == 2
    assert {r.g: r.wmape for r in metrics.wmape_bias(rows, ["g"]).collect()}["y"] is None
    w = spark.createDataFrame([("a", k + 1, float(k)) for k in range(14)], "s string, step int, v double")
    assert [r.v for r in metrics.window_sums(w, 5, 14, ["v"], ["s"]).orderBy("window").collect()] == [10, 35]


def test_scales_and_wrmsse(spark):
    assert metrics.naive_scale(series(spark, [0.0, 0.0, 2.0, 4.0, 2.0])).first().scale == 4.0
    assert metrics.mad_scale(series(spark, [1.0] * 80)).first().scale == 0.1
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 2.0), ("b", 1.0, 5.0), ("b", 1.0, 5.0), ("c", 1.0, 9.0)], "series_id string, actual double, forecast double")
    scale = spark.createDataFrame([("a", 1.0), ("b", 4.0), ("c", 0.0)], "series_id string, scale double")
    weight = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 9.0)], "series_id string, weight double")
    assert metrics.wrmsse(rows.withColumn("m", F.lit(1)), scale, weight, ["m"]).first().wrmsse == 1.75


def test_bias_tools(spark):
    rows = spark.createDataFrame([("steady", 10.0 + k % 2, 9.0) for k in range(16)] + [("fair", 10.0 + (-1) ** k, 10.0) for k in range(16)], "series_id string, actual double, forecast double")
    s = metrics.tracking_signal(rows, ["series_id"])
    got = {r.series_id: r.tracking_signal for r in s.collect()}
    assert got["steady"] > 4 and abs(got["fair"]) < 1e-9
    price = spark.createDataFrame([("steady", 2.0), ("fair", 2.0)], "series_id string, unit_price double")
    e = metrics.bias_exceptions(s, price).collect()
    assert [(r.series_id, r.direction, r.weekly_impact) for r in e] == [("steady", "under-forecast", 3.0)]
    c = {r.series_id: r.multiplier for r in metrics.bias_correction(s).collect()}
    assert abs(c["steady"] - (1 + 0.5 * (10.5 / 9 - 1))) < 1e-9 and c["fair"] == 1


def test_paired_ci(spark):
    p = spark.createDataFrame([(3.0, 1.0), (4.0, 1.0), (5.0, 1.0)], "a double, b double")
    r = metrics.paired_ci(p).first()
    assert r["mean"] == 3 and abs(r["upper"] - 3 - 4.302652729749464 / math.sqrt(3)) < 1e-6 and r["wins"] == 1
    assert metrics.paired_ci(p.limit(1)).first()["lower"] is None


def plain_psi(e, a, bins=10):
    inner = np.unique(np.quantile(e, np.linspace(0, 1, bins + 1))[1:-1])
    share = lambda x: np.maximum(np.bincount(np.searchsorted(inner, x, side="right"), minlength=len(inner) + 1) / len(x), 1e-6)
    p, q = share(e), share(a)
    return float(((q - p) * np.log(q / p)).sum())


def test_psi(spark):
    r = np.random.default_rng(0)
    for shift in (0.0, 1.0):
        e, a = r.normal(size=500), r.normal(shift, 1, 300)
        df = spark.createDataFrame([("g", False, float(v)) for v in e] + [("g", True, float(v)) for v in a], "g string, recent boolean, x double")
        assert abs(drift.psi(df, ["g"]).first().psi - plain_psi(e, a)) < 1e-9
    assert drift.psi(df.where("not recent"), ["g"]).first().psi == 0
    flag = drift.retrain_flag(spark.createDataFrame([("n2", 0.5), ("n1", 0.3), ("n3", 0.1)], "node string, psi double"), "node", spark.createDataFrame([(1.2, 1.0)], "recent double, reference double")).first()
    assert flag.retrain and flag.reasons.startswith("PSI >= 0.2 for 2 node(s): n1, n2; WMAPE is worse than before by over 0.1 of it")


def test_sketches_of_days_give_the_psi(spark, tmp_path):
    """Only new days are read; PSI of merged sketches is near the exact one, for ties and for a group without recent days."""
    r, path = np.random.default_rng(9), str(tmp_path / "sketches")
    rows = [(g, day(k), float(np.round(r.gamma(2, 3) + (2 if g == "moved" and k >= 30 else 0), 1 if g != "ties" else 0))) for g in ("same", "moved", "ties") for k in range(40) for _ in range(150)]
    rows += [("old", day(1), 1.0), ("same", day(2), None), ("same", day(2), float("nan"))]
    df = spark.createDataFrame(rows, "g string, date date, x double")
    assert drift.add_sketches(df.where(F.col("date") < day(30)), path, ["g"]) == 30 and drift.add_sketches(df, path, ["g"]) == 10 and drift.add_sketches(df, path, ["g"]) == 0
    stored = spark.read.parquet(path)
    assert stored.agg(F.sum("n")).first()[0] == 3 * 40 * 150 + 1
    new = F.col("date") >= day(30)
    got = {q.g: q.psi for q in drift.psi_of_sketches(stored, ["g"], ~new, new).collect()}
    exact = {q.g: q.psi for q in drift.psi(df.select("g", new.alias("recent"), "x"), ["g"]).collect()}
    assert set(got) == {"same", "moved", "ties", "old"} and got["old"] == 0 and exact["moved"] > 0.2
    assert all(abs(got[g] - exact[g]) < 0.02 + 0.05 * exact[g] for g in ("same", "moved", "ties"))


def test_floors(spark):
    p = series(spark, [float(k) for k in range(20)]).unionByName(series(spark, [5.0], "short").withColumn("date", F.lit(day(19))))
    folds = spark.createDataFrame([("f", day(19))], "fold string, origin date")
    f = {(r.series_id, r.method, r.step): r.forecast for r in forecast.floors(p, folds, 9).collect()}
    assert f["a", "naive", 9] == 19 and [f["a", "seasonal_naive", s] for s in (1, 7, 8)] == [13, 19, 13] and f["short", "seasonal_naive", 3] == 5


def test_rolling_origin_wants_every_forecast(spark):
    p, folds = series(spark, [1.0] * 60), spark.createDataFrame([("f", day(30))], "fold string, origin date")
    with pytest.raises(ValueError):
        forecast.rolling_origin(p, folds, lambda seen, fold: seen.select("fold", "series_id", "date", F.lit(1.0).alias("forecast")))


def test_tree_equals_dense(spark):
    parent = {"t": "", "s1": "t", "s2": "t", "a": "s1", "b": "s1", "c": "s2"}
    level = {"t": 0, "s1": 1, "s2": 1, "a": 2, "b": 2, "c": 2}
    r = np.random.default_rng(3)
    y, w = {n: float(v) for n, v in zip(parent, r.uniform(1, 9, 6))}, {n: float(v) for n, v in zip(parent, r.uniform(0.1, 4, 6))}
    df = spark.createDataFrame([("f", n, parent[n], level[n], y[n], w[n]) for n in parent], "f string, node string, parent string, level int, y double, w double")
    got = {x.node: x.forecast for x in reconcile.mint_tree(df, 2, ["f"]).collect()}
    names = ["t", "s1", "s2", "a", "b", "c"]
    s = np.array([[1, 1, 1], [1, 1, 0], [0, 0, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1]])
    assert np.allclose([got[n] for n in names], reconcile.mint_dense(s, [y[n] for n in names], [w[n] for n in names]))


def test_shrunk_covariance_equals_dense(spark):
    """Two levels with correlated errors: the intensity and the reconciled values by the dense formulas."""
    r = np.random.default_rng(11)
    names, parents, level = ["t", "a", "b", "a1", "a2", "b1", "b2"], ["", "t", "t", "a", "a", "b", "b"], [0, 1, 1, 2, 2, 2, 2]
    e = r.normal(size=(30, 7)) + 1.5 * r.normal(size=(30, 1))
    errors = spark.createDataFrame([(n, day(k), float(e[k, i])) for k in range(30) for i, n in enumerate(names)], "node string, date date, error double")
    y, w = r.uniform(5, 30, (3, 7)), r.uniform(1, 4, 7)
    base = spark.createDataFrame([(s, n, parents[i], level[i], float(y[s, i]), float(w[i])) for s in range(3) for i, n in enumerate(names)], "step int, node string, parent string, level int, y double, w double")
    z = e / np.sqrt((e**2).mean(axis=0))
    x = z[:, :, None] * z[:, None, :]
    off = ~np.eye(7, dtype=bool)
    lam = min(max((x.var(axis=0, ddof=1) / 30)[off].sum() / (x.mean(axis=0) ** 2)[off].sum(), 0), 1)
    _, got = reconcile.shrinkage(errors)
    assert abs(got - lam) < 1e-9 and 0 < lam < 1
    cov = np.where(off, (1 - lam) * x.mean(axis=0), 1.0) * np.sqrt(np.outer(w, w))
    c = np.array([[1, -1, -1, 0, 0, 0, 0], [0, 1, 0, -1, -1, 0, 0], [0, 0, 1, 0, 0, -1, -1]], float)
    want = y.T - cov @ c.T @ np.linalg.solve(c @ cov @ c.T, c @ y.T)
    out = {(q.step, q.node): q.forecast for q in reconcile.mint_shrunk(base, errors).collect()}
    assert len(out) == 21 and all(abs(out[s, n] - want[i, s]) < 1e-6 for s in range(3) for i, n in enumerate(names))


def test_additive_models_equal_dense_solves(spark):
    """Nodes dealt over tasks against one solve each; a change of slope and a holiday are found; intervals widen and hold."""
    from stocktide.operators import additive

    r, n = np.random.default_rng(8), 900
    t = np.arange(n)
    mean = {"a": 40 + 0.02 * t + np.maximum(t - 360, 0) * 0.05 + 6 * np.sin(2 * np.pi * t / 7), "b": 90 + 10 * np.cos(2 * np.pi * t / 365.25)}
    hol = (t % 50 == 0).astype(float)
    rows = [(k, day(i), float(m[i] + 15 * hol[i] + r.normal(0, 2)), float(hol[i])) for k, m in mean.items() for i in range(n)]
    future = spark.createDataFrame([(day(i), float(i % 50 == 0)) for i in range(n, n + 28)], "date date, holiday double")
    got = {(q.node, q.date): q for q in additive.forecasts(spark.createDataFrame(rows, "node string, date date, sales double, holiday double").repartition(5), future, ["node"]).collect()}
    first = (D - dt.date(1970, 1, 1)).days
    ahead = np.arange(n, n + 28)
    for k in mean:
        x = additive.design((first + t).astype(float), hol, first, first + n - 1)
        y = np.array([q[2] for q in rows if q[0] == k])
        ridge = np.full(x.shape[1], 1e-9)
        ridge[2 : 2 + additive.CHANGES] = 0.01
        beta = np.linalg.solve(x.T @ x + np.diag(ridge * n), x.T @ y)
        want = additive.design((first + ahead).astype(float), (ahead % 50 == 0).astype(float), first, first + n - 1) @ beta
        mine = [got[k, day(int(i))] for i in ahead]
        assert np.allclose([q.forecast for q in mine], want, atol=1e-6) and all(q.lower <= q.forecast <= q.upper for q in mine)
        assert 7 < mine[0].upper - mine[0].lower < 14 and mine[-1].upper - mine[-1].lower > mine[1].upper - mine[1].lower - 1
    assert abs(got["a", day(900)].forecast - (40 + 18 + 27 + 15 + 6 * np.sin(2 * np.pi * 900 / 7))) < 5


def test_top_down_and_temporal(spark):
    h = spark.createDataFrame([(k, day(d), v) for d in range(3) for k, v in (("a", 4.0), ("b", 6.0))], "series_id string, date date, sales double")
    total = spark.createDataFrame([(1, 100.0), (2, 50.0)], "step int, forecast double")
    got = sorted(r.forecast for r in reconcile.top_down(reconcile.proportions(h), total).collect())
    assert np.allclose(got, [20, 30, 40, 60])
    daily = spark.createDataFrame([("n", 0, k, 10.0, 1.0) for k in range(7)], "node string, week int, step int, forecast double, vd double")
    weekly = spark.createDataFrame([("n", 0, 84.0, 0.0)], "node string, week int, total double, vw double")
    assert np.allclose([r.forecast for r in reconcile.temporal(daily, weekly, ["node"]).collect()], [12.0] * 7)


def plain_quantile(x, q):
    n = len(x)
    return np.quantile(x, np.clip((np.ceil if q >= 0.5 else np.floor)((n + 1) * q) / n, 0, 1))


def test_conformal_quantiles(spark):
    x = np.random.default_rng(5).normal(size=57)
    s = spark.createDataFrame([("g", float(v)) for v in x] + [("g", None)], "g string, score double")
    qs = [0.02, 0.1, 0.5, 0.9, 0.999]
    got = {r.q: r.value for r in uncertainty.conformal_quantiles(s, ["g"], spark.createDataFrame([("g", q) for q in qs], "g string, q double")).collect()}
    assert np.allclose([got[q] for q in qs], [plain_quantile(x, q) for q in qs])


def test_share_at_most_counts_ties(spark):
    s = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 2.0, 3.0)], "g string, score double")
    p = spark.createDataFrame([("g", "a", 2.0), ("g", "b", 0.5), ("g", "c", 9.0)], "g string, k string, threshold double")
    assert {r.k: r["share"] for r in uncertainty.share_at_most(s, p, ["g"], ["k"]).collect()} == {"a": 0.75, "b": 0.0, "c": 1.0}


def test_allocation_is_optimal(spark):
    import itertools

    r = np.random.default_rng(7)
    for trial in range(4):
        d = r.integers(0, 6, (3, 4)).astype(float)
        w = r.uniform(1, 5, 3)
        rows = [("r", str(i), float(d[i].mean()), float(w[i]), float(trial % 2), [float(v) for v in d[i]]) for i in range(3)]
        df = spark.createDataFrame(rows, "run string, node string, forecast double, weight double, held double, scenarios array<double>")
        got = {x.node: x.allocated for x in allocate.allocate(df, ["run"], F.lit(5.0), 0.0).collect()}
        worth = lambda x: sum(w[i] * np.minimum(d[i], x[i] + trial % 2).mean() for i in range(3))
        best = max(worth(x) for x in itertools.product(range(6), repeat=3) if sum(x) <= 5)
        assert sum(got.values()) <= 5 + 1e-9 and worth([got[str(i)] for i in range(3)]) >= best - 1e-9


def test_pro_rata_and_runs(spark):
    df = spark.createDataFrame([("r", "a", 10.0, 0.0), ("r", "b", 30.0, 40.0), ("r", "c", 30.0, 0.0)], "run string, node string, forecast double, held double")
    assert {x.node: x.allocated for x in allocate.pro_rata(df, ["run"], F.lit(20.0)).collect()} == {"a": 5.0, "b": 0.0, "c": 15.0}
    fill = spark.createDataFrame([("a", k, v) for k, v in enumerate((0.4, 0.4, 0.4, 0.9, 0.1))] + [("b", k, 0.9) for k in range(5)], "node string, period int, fill_rate double")
    assert [(x.node, x.longest_short_run) for x in allocate.longest_short_runs(fill, 0.5, 2).collect()] == [("a", 3)]


def test_rationing_modes(spark):
    o = spark.createDataFrame([("p", str(k), 10.0, 14.0, c, v) for k, (c, v) in enumerate(((5.0, 1.0), (1.0, 2.0), (3.0, 9.0)))], "product string, row string, quantity double, available double, cover double, value double")
    got = lambda m: [round(x.shipped, 6) for x in allocate.ration(o, m).orderBy("row").collect()]
    assert got("days_of_cover") == [0, 10, 4] and got("value") == [0, 4, 10] and got("proportional") == [4.666667] * 3
    with pytest.raises(ValueError):
        allocate.ration(o, "by_mood")


def test_sarima_likelihood_equals_the_dense_gaussian():
    from stocktide.operators import sarima

    r = np.random.default_rng(2)
    for season, p in ((7, (0.5, -0.4, -0.6)), (0, (0.3, 0.6, 0.0)), (7, (-0.7, 0.2, 0.5))):
        w = r.normal(size=(2, 40))
        ma = sarima._moving(np.array([p]), season)[0]
        psi = [0.0] * 600  # of the stationary process, far enough back
        for k in range(600):
            psi[k] = (ma[k] if k < len(ma) else 0.0) + (p[0] * psi[k - 1] if k else 0.0)
        psi = np.array(psi)
        auto = np.array([(psi[: 600 - lag] * psi[lag:]).sum() for lag in range(40)])
        cov = auto[np.abs(np.subtract.outer(np.arange(40), np.arange(40)))]
        v, f, _ = sarima.innovations(w, np.tile(p, (2, 1)), season)
        for k in range(2):
            s2 = w[k] @ np.linalg.solve(cov, w[k]) / 40
            dense = -0.5 * (40 * np.log(2 * np.pi * s2) + 40 + np.linalg.slogdet(cov)[1])
            assert abs(sarima.log_likelihood(v, f)[k] - dense) < 1e-8


def test_sarima_finds_parameters_and_forecasts(spark):
    from stocktide.operators import sarima

    r, phi, theta, big = np.random.default_rng(4), 0.4, 0.3, -0.5
    e = r.normal(size=(6, 900))
    w = np.zeros((6, 900))
    for t in range(9, 900):
        w[:, t] = phi * w[:, t - 1] + e[:, t] + theta * e[:, t - 1] + big * e[:, t - 7] + theta * big * e[:, t - 8]
    got = sarima.fit(w[:, 50:], 7)
    assert np.abs(got.mean(axis=0) - [phi, theta, big]).max() < 0.08
    best = sarima.log_likelihood(*sarima.innovations(w[:, 50:], got, 7)[:2])
    for move in np.eye(3) * 0.01:  # a maximum: no neighbour is better
        for sign in (1, -1):
            assert (sarima.log_likelihood(*sarima.innovations(w[:, 50:], got + sign * move, 7)[:2]) <= best + 1e-6).all()
    t = np.arange(300)
    x = 50 + 10 * np.sin(2 * np.pi * t / 7) + r.normal(0, 1, (3, 300))
    f, var = sarima.forecast(x[:, :-28], 28)
    naive = np.tile(x[:, -35:-28], 4)
    assert (f >= 0).all() and np.abs(f - x[:, -28:]).mean() < 0.9 * np.abs(naive - x[:, -28:]).mean() and (np.diff(var, axis=1) >= 0).all() and 0.3 < var[:, 0].mean() < 3
    assert (sarima.forecast(np.array([[3.0, 4.0]]), 3)[0] == [[4, 4, 4]]).all() and (sarima.forecast(np.full((1, 60), 5.0), 3)[0] == 5).all()
    rows = [(n, day(k), float(x[i, k])) for i, n in enumerate("abc") for k in range(272)] + [("short", day(k), 2.0) for k in range(5)]
    out = {(q.node, q.step): q for q in sarima.nodes(spark.createDataFrame(rows, "node string, date date, sales double").repartition(3), ["node"]).collect()}
    assert len(out) == 4 * 28 and all(abs(out[n, h + 1].forecast - f[i, h]) < 1e-6 * 50 for i, n in enumerate("abc") for h in range(28)) and out["short", 9].variance == 0


def test_shadow_price_equals_a_greedy_pass(spark):
    """Many nodes, two groups, equal weights (ties at the price), supplies from nothing to more than all can use."""
    r = np.random.default_rng(3)
    rows = [(g, f"{g}{i}", float(r.integers(1, 9)), float(r.choice([1.0, 2.0, 2.5])), float(r.integers(0, 3)), [float(v) for v in r.integers(0, 12, 5)]) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "run string, node string, forecast double, weight double, held double, scenarios array<double>").repartition(3)
    for part in (0.0, 0.3, 0.9, 9.0):
        got = allocate.allocate(df, ["run"], F.lit(part) * F.col("t_forecast"), 0.2).collect()
        for g in "ab":
            mine, total, segments = {x.node: x.allocated for x in got if x.run == g}, 0.0, []
            for _, node, forecast, weight, held, demand in (x for x in rows if x[0] == g):
                total += forecast
                start, below = held + max(0.2 * forecast - held, 0), 0.0
                for j, top in enumerate(sorted(demand)):
                    segments.append((weight * (5 - j) / 5, max(top - max(start, below), 0), node))
                    below = top
            floors = sum(max(0.2 * x[2] - x[4], 0) for x in rows if x[0] == g)
            left, worth = part * total - floors, 0.0
            for value, length, _ in sorted(segments, reverse=True):
                take = min(max(left, 0), length)
                left, worth = left - take, worth + value * take
            reached = 0.0
            for _, node, forecast, weight, held, demand in (x for x in rows if x[0] == g):
                low, high = held + max(0.2 * forecast - held, 0), held + mine[node]
                reached += weight * sum(min(d, high) - min(d, low) for d in demand) / 5
            assert abs(sum(mine.values()) - floors - min(max(part * total - floors, 0), sum(s[1] for s in segments))) < 1e-6 and abs(reached - worth) < 1e-6


def test_a_planted_bias_is_flagged_at_the_real_threshold(spark):
    weeks = [("m", "steady", k, 70.0 + k % 2, 70.0) for k in range(12)] + [("m", "low", k, 80.0 + k % 2, 70.0) for k in range(12)]
    s = metrics.tracking_signal(spark.createDataFrame(weeks, "method string, series_id string, window int, actual double, forecast double"), ["method", "series_id"])
    prices = spark.createDataFrame([("steady", 1.0), ("low", 2.0)], "series_id string, unit_price double")
    assert [(r.series_id, r.direction) for r in metrics.bias_exceptions(s, prices).collect()] == [("low", "under-forecast")]
    got = {r.series_id: (r.flagged, round(r.multiplier, 3)) for r in metrics.bias_correction(s).collect()}
    assert got == {"steady": (False, 1.0), "low": (True, 1.075)}
