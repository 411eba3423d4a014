"""Operators against hand-worked tables, NumPy and simulation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import exposure, gram, grids, inference, joins, ladder, models, panel, posterior, raster, scoring, search, spatial, splits
from terraloom.plans import chains
from terraloom.sources import tables
from terraloom.streaming import events

from .conftest import DATA


def frame(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    n = 600
    z, x, c = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 40, n)
    u = rng.normal(size=40)
    y = 0.5 * x - 0.3 * z + rng.normal(size=n) + u[c]
    w = rng.uniform(0.5, 2, n)
    px, py = rng.uniform(0, 1000, n), rng.uniform(0, 1000, n)
    a = np.column_stack([np.arange(n), y, x + 0.4 * z, z, c, w, px, py])
    df = spark.createDataFrame([tuple(map(float, r)) for r in a], "id double, y double, e double, z double, c double, w double, x double, py double").withColumn("id", F.col("id").cast("long")).withColumn("c", F.col("c").cast("long"))
    return df, a


def lstsq(y, *x):
    m = np.column_stack([np.ones(len(y)), *x])
    b = np.linalg.lstsq(m, y, rcond=None)[0]
    return b, y - m @ b


def test_radius_and_nearest(spark):
    left = frame(spark, [(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, -50.0, -50.0)], "k long, x double, y double")
    right = frame(spark, [(1, 100.0, 0.0, 5.0), (2, 0.0, 100.0, 7.0), (3, 1e6, 0.0, 9.0)], "m long, mx double, my double, v double")
    assert sorted((r.k, r.m) for r in joins.radius_join(left, right, 100.0).collect()) == [(1, 1), (1, 2)]
    near = {r.k: (r.v, r.distance) for r in joins.nearest_join(left, right, "k", ["v"], 100.0, "m").collect()}
    assert near == {1: (5.0, 100.0), 2: (None, None), 3: (None, None)}
    st = ladder.disc_stats(left, right, "k", "v", [100.0]).collect()
    assert [(r.n, r["mean"], r.p90) for r in st] == [(2, 6.0, 6.8)]


def test_points_in_closed_cells(spark):
    pts = frame(spark, [(1, 5.0, -5.0), (2, 10.0, -5.0), (3, 10.0, -10.0), (3, 10.0, -10.0)], "k long, x double, y double")
    out = {}
    for r in exposure.point_cells(pts, "k", 10.0).collect():
        out.setdefault(r.k, {})[r.row, r.col] = r.weight
    assert out[1] == {(0, 0): 1} and out[2] == {(0, 0): 1, (0, 1): 1} and out[3] == {(r, c): 2 for r in (0, 1) for c in (0, 1)}


def test_lines_and_polygons(spark):
    shape = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    df = spark.createDataFrame([(1, "line", shape((5, -5), (25, -5))), (2, "polygon", shape((1, -1), (12, -1), (12, -9), (1, -9), (1, -1))), (3, "polygon", shape((0, 0), (10, 0), (10, -10), (0, -10), (0, 0)))], "k long, kind string, xy array<struct<x double, y double>>")
    out = {}
    for r in exposure.shape_cells(df, "k", 10.0).collect():
        out.setdefault(r.k, {})[r.row, r.col] = r.weight
    assert out == {1: {(0, 0): 1, (0, 1): 1, (0, 2): 1}, 2: {(0, 0): 1, (0, 1): 1}, 3: {(0, 0): 1}}
    assert exposure.line_passes(np.array([(-5.0, 5), (15, 5), (15, 8), (-5, 8)]), (0, 0, 10, 10)) == 2
    wide = exposure.shape_cells(df.where("k = 3"), "k", 10.0, "uniform", 5.0).collect()
    assert len(wide) == 9
    grid = list(exposure.anchored_grid([(0, 0), (30, 0), (30, -20), (0, -20), (0, 0)], 10))
    assert len(grid) == 6 and grid[0][:2] == (0, 0)


def test_collapse_and_coverage(spark):
    cells = frame(spark, [(1, 2.0, 1.0), (1, None, 5.0), (1, 4.0, 3.0), (2, None, 1.0)], "k long, v double, w double")
    assert {r.k: (r.v, r.weight) for r in ladder.collapse(cells, "k", "v", "w").collect()} == {1: (3.5, 4.0), 2: (None, 0.0)}
    assert [r.asDict() for r in ladder.ring_stats(frame(spark, [(1, 0, 1.0), (1, 1, 3.0)], "k long, ring int, v double"), "k", "ring", "v", 2).select("ring", "n", "mean").orderBy("ring").collect()] == [{"ring": 0, "n": 1, "mean": 1.0}, {"ring": 1, "n": 2, "mean": 2.0}]


def test_raster(spark):
    r = frame(spark, [(i, j, float(10 * i + j)) for i in range(4) for j in range(4)], "row long, col long, value double")
    got = {(x.row, x.col): x.value for x in raster.focal(r, "mean", 1).collect()}
    assert got[0, 0] == pytest.approx((0 + 1 + 10) / 3) and got[1, 1] == 11 and len(got) == 16
    assert {(x.row, x.col): x.value for x in raster.overview(r, 2).collect()}[1, 1] == 27.5
    tiles = r.withColumn("i", F.lit(1)).unionByName(r.where("row = 0").withColumn("value", F.lit(None).cast("double")).withColumn("i", F.lit(2)))
    assert {(x.row, x.col): x.value for x in raster.mosaic(tiles, "i").collect()}[0, 1] is None
    s = raster.band_statistics(r.withColumn("value", F.when(F.col("row") > 0, F.col("value")).otherwise(-9999.0)), nodata=-9999.0).first()
    assert (s.minimum, s.maximum, s.valid_percent) == (10, 33, 75)
    assert raster.widened(100, 60, 2, 5) == (70, 120) and raster.widened(100, 60, 2, 2) == (100, 60)


def test_capture_rules(spark):
    c = frame(spark, [(1, 1, 2015, 1), (1, 2, 2017, 7), (1, 3, 2019, None), (2, 4, None, 3)], "k long, capture_id long, year int, month int")
    pick = lambda *a, **k: {r.k: r.capture_id for r in joins.choose_capture(c, "k", *a, **k).collect()}
    assert pick(None) == {1: 3} and pick(2016) == {1: 2} and pick(2014, 0) == {} and pick(None, months=(5, 10)) == {1: 2} and pick(2015, months=(5, 10), hard=True) == {1: 2}


def test_panel(spark):
    df = frame(spark, [(1, "a", 1.0), (1, "b", 3.0), (2, "a", None), (None, "a", 2.0)], "id long, v string, y double")
    out = panel.from_waves({"w1": df, "w2": df.drop("v")}, "id", "y", ["v"])
    assert out.count() == 4 and out.columns == ["entity_id", "wave", "outcome", "v"]
    with pytest.raises(ValueError):
        panel.require_unique(out, "entity_id", "wave")
    assert panel.one_hot(df, "v").columns == ["id", "v", "y", "v_b"]
    with pytest.raises(ValueError):
        panel.as_binary(df.select((F.col("id")).alias("y")).where("y is null"), "y")
    assert [r.y for r in panel.as_binary(frame(spark, [(2.0,), (5.0,)], "y double"), "y").collect()] == [0.0, 1.0]
    assert "t" not in panel.period_controls(frame(spark, [("a", 1.0), ("b", 2.0)], "w string, t double"), "w", years="t").columns


def test_splits(spark, numbers):
    df, a = numbers
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    assert splits.quantiles(df, "y", shares) == pytest.approx(np.quantile(a[:, 1], shares))
    assert splits.quantiles(frame(spark, [(1.0,), (1.0,), (None,), (4.0,)], "v double"), "v", [0.0, 0.5, 0.75]) == [1.0, 1.0, 2.5]
    assert splits.quantiles(df.where("y > 1e9"), "y", [0.5]) == []
    q = splits.qcut(df, "y", 5).groupBy("bin").count().collect()
    assert sorted(r["count"] for r in q) == [120] * 5
    s = splits.stratified_split(df, "id", "y", 0.25).groupBy("bin").agg(F.sum(F.col("test").cast("int")).alias("t")).collect()
    assert [r.t for r in s] == [30] * 5
    g = splits.redrawn_holdout(df, "c", 0.25).groupBy("c").agg(F.count_distinct("test").alias("n")).collect()
    assert all(r.n == 1 for r in g)
    b = splits.area_balanced(splits.qcut(df, "y", 3), "bin", "w", {"a": 0.5, "b": 0.5}, "id").groupBy("bin", "split").agg(F.sum("w").alias("w")).collect()
    by = {(r.bin, r.split): r.w for r in b}
    assert all(abs(by[k, "a"] - by[k, "b"]) < 2 for k in range(3))
    size = splits.block_size(df, 25, 10.0, y="py")
    n = splits.spatial_blocks(df, size, y="py").select("block").distinct().count()
    assert 16 <= n <= 36 and splits.default_blocks(10) == 9 and splits.default_blocks(10**6) == 200
    assert sorted((r.id, r.n) for r in splits.numbered(df.select("id"), [F.col("id")], "n").collect()) == [(i, i + 1) for i in range(600)]
    p = splits.permuted(df, "id", "y", 3)
    assert sorted(r.permuted for r in p.collect()) == pytest.approx(sorted(a[:, 1]))


def test_regressions(spark, numbers):
    df, a = numbers
    y, e, z, c, w = a[:, 1], a[:, 2], a[:, 3], a[:, 4], a[:, 5]
    g = gram.gram(df, ["z", "e", "y"])
    _, res0 = lstsq(y, z)
    beta, res1 = lstsq(y, z, e)
    sst = ((y - y.mean()) ** 2).sum()
    assert gram.incremental_r2(g, "y", "e", ["z"]) == pytest.approx((res0 @ res0 - res1 @ res1) / sst)
    f = gram.raw_slope(g, "y", "e", ["z"])
    m = np.column_stack([np.ones(len(y)), z, e])
    cov = np.linalg.inv(m.T @ m) * (res1 @ res1) / (len(y) - 3)
    assert (f["slope"], f["se"], f["df"]) == (pytest.approx(beta[2]), pytest.approx(math.sqrt(cov[2, 2])), len(y) - 3)
    p = gram.partial_slope(g, "y", "e", ["z"])
    rx = lstsq(e, z)[1]
    assert p["beta"] == pytest.approx(np.corrcoef(res0, rx)[0, 1])
    o = gram.ols(df, "y", ["e", "z"], "c")
    m = np.column_stack([np.ones(len(y)), e, z])
    inv = np.linalg.inv(m.T @ m)
    meat = sum(np.outer(s, s) for k in np.unique(c) for s in [m[c == k].T @ res1[c == k]])
    n_c = len(np.unique(c))
    want = inv @ meat @ inv * n_c / (n_c - 1) * (len(y) - 1) / (len(y) - 3)
    assert o["se"] == pytest.approx(np.sqrt(np.diag(want)))
    ws = gram.weighted_slope(df, "y", "e", ["z"], "w")
    mw = np.column_stack([np.ones(len(y)), z, e])
    bw = np.linalg.solve(mw.T @ (w[:, None] * mw), mw.T @ (w * y))
    assert ws["slope"] == pytest.approx(bw[2]) and ws["n_effective"] == pytest.approx(w.sum() ** 2 / (w**2).sum())
    v = gram.vif(g, ["z", "e"])
    assert v["z"] == pytest.approx(1 / (1 - np.corrcoef(z, e)[0, 1] ** 2)) and gram.reduce_vif(g, ["z", "e"], 1.0)[0] == ["e"]
    i = gram.information(g, "y", ["z"])
    like = -len(y) / 2 * (math.log(2 * math.pi) + math.log(res0 @ res0 / len(y)) + 1)
    assert i["aic"] == pytest.approx(-2 * like + 4) and gram.verdict(7) == "strong for the second"
    stat, pv = gram.spline_test(df, "y", "e", ["z"])
    assert 0 <= pv <= 1 and gram.moderation(df, "y", "e", "z", [])["slopes"]["mean"][0] == pytest.approx(0.5, abs=0.2)


def test_scores(spark, numbers):
    df, a = numbers
    y, e, z = a[:, 1], a[:, 2], a[:, 3]
    rank = lambda v: v.argsort().argsort() + 1.0
    want = abs(np.corrcoef(lstsq(rank(y), rank(z))[1], lstsq(rank(e), rank(z))[1])[0, 1])
    assert scoring.score("spearman", df, "y", "e", ["z"]) == pytest.approx(want)
    assert scoring.distance_correlation(y[:200], y[:200]) == pytest.approx(1) and scoring.distance_correlation(y[:200], np.ones(200)) == 0
    assert abs(scoring.partial_distance_correlation(y[:200], e[:200], z[:200])) <= 1
    u = scoring.u_centre(scoring.distances(y[:50]))
    assert np.abs(u.sum(axis=0)).max() < 1e-9
    assert scoring.score("nrmse", df.withColumn("k", F.lit(1.0)), "y", "k") == float("inf")
    with pytest.raises(ValueError):
        scoring.bounded_rows(df, ["y"], 10)
    with pytest.raises(KeyError):
        scoring.score("odd", df, "y", "e")


def test_distance_correlation_of_all_rows(spark):
    rng = np.random.default_rng(4)
    for n in (3, 4, 37, 500):
        x, z = np.round(rng.normal(size=n), 1), rng.normal(size=n)
        y = x**2 + np.round(rng.normal(size=n), 1)
        assert scoring.fast_distance_correlation(x, y) == pytest.approx(scoring.distance_correlation(x, y))
        assert scoring.fast_partial_distance_correlation(x, y, z) == pytest.approx(scoring.partial_distance_correlation(x, y, z))
    assert scoring.fast_distance_correlation(x, np.ones(n)) == 0
    df = spark.range(scoring.PAIR_ROWS + 500).selectExpr("cast(id as double) as x", "cast(id * id as double) as y", "sin(id) as z")
    v = np.array([list(r) for r in df.collect()])
    assert scoring.score("distance", df, "y", "x") == pytest.approx(scoring.distance_correlation(v[:, 0], v[:, 1]))
    assert abs(scoring.score("distance", df, "y", "x", ["z"])) <= 1


def test_inference(spark, numbers):
    df, a = numbers
    b = inference.bootstrap_ci(df, "y", "e", ["z"], "id", 200)
    assert b["low"] < b["observed"] < b["high"] and b["replicates"] == 200
    # a Poisson weight has mean and variance 1
    w = df.crossJoin(spark.range(200).withColumnRenamed("id", "k")).agg(F.avg(inference.poisson_weight(F.col("id"), F.col("k"))), F.var_pop(inference.poisson_weight(F.col("id"), F.col("k")))).first()
    assert w[0] == pytest.approx(1, abs=0.02) and w[1] == pytest.approx(1, abs=0.03)
    assert inference.bootstrap_ci(df, "y", "e", ["z"], "c", 50, method="bca")["low"] < b["observed"]
    assert inference.permutation_p(df, "y", "e", ["z"], "id", 9)["p"] == pytest.approx(0.1)
    c = inference.paired_contrast(df.withColumn("noise", F.rand(3)), "y", "noise", "e", ["z"], "c", 60)
    assert c["delta"] > 0 and c["p"] < 0.1
    assert inference.specificity(df.withColumn("noise", F.rand(3)).withColumn("other", F.rand(4)), "y", "noise", ("e", "other"), ["z"], "c", 40)["delta"] > 0
    t = inference.transfer_test(df.withColumn("copy", F.col("y")), "y", ["copy"], "e", ["z"])
    assert [r["flagged"] for r in t] == [False, True] and t[0]["p"] == pytest.approx(t[1]["p"]) and t[0]["p"] < 0.001
    k = inference.split_inference({"slope": 1.0}, {"slope": 0.9, "se": 0.1, "p": 0.0})
    assert k["least_detectable"] == pytest.approx(0.28)


def test_search():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([0.7, 0.3, 0.0]) + 0.3 * rng.normal(size=400)
    w, value = search.simplex_fit(x.T @ x, x.T @ y)
    best = max((abs(v @ x.T @ y) / math.sqrt(v @ (x.T @ x) @ v) for v in rng.dirichlet(np.ones(3), 20000)), default=0)
    assert value >= best - 1e-9 and w[0] == pytest.approx(0.7, abs=0.05) and w.sum() == pytest.approx(1)
    w, _ = search.simplex_fit(x.T @ x, -(x.T @ y))
    assert w[0] > 0.6


def test_search_in_spark(spark, numbers):
    df, _ = numbers
    df = df.withColumns({"n1": F.rand(1), "n2": F.rand(2)})
    out = search.sweep(df, "y", {"a": ["e", "n1"], "b": ["n2"]}, ["z"], "c", splits=3)
    assert out["best"]["columns"] == ("e", "n2") and out["candidates"] == 2
    assert search.choose_form(df, "y", {"good": ["e"], "bad": ["n1"]}, ["z"], "c", 3)[0] == "good"
    assert search.repeated_discovery(df, "y", {"a": ["e", "n1"]}, ["z"], "c", 2)["columns"] == ("e",)
    assert len(search.holdout_gain(df, "y", ["e", "n1"], ["z"], "c", 4)["gains"]) == 4
    assert search.null_calibration(df, "y", ["n1", "n2"], ["z"], "id", 3) <= 1


def test_spatial(spark):
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (5, 0), (9, 0), (100, 0), (104, 0), (500, 500)])]
    df = frame(spark, pts, "k long, x double, y double")
    labels = spatial.radius_components(df, "k", 6.0)
    assert {r.k: r.component for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert {r.k: r.component for r in spatial.merge_small(df, labels, "k", 2).collect()}[5] == 3
    chain = frame(spark, [(i, float(i), 0.0) for i in range(40)], "k long, x double, y double")
    assert spatial.radius_components(chain, "k", 1.0).select("component").distinct().count() == 1
    assert spatial.hull_extent(np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)], float)) == 4
    z = np.random.default_rng(0).uniform(0, 100, (60, 2))
    b = spatial.thin_plate_basis(z, spatial.covering_knots(z, k=15))
    assert b.shape == (60, 15) and np.linalg.matrix_rank(b) == 15
    assert len(spatial.covering_knots(z, radius=1e9)) == 1
    v = np.sin(z[:, 0] / 20)
    s = spatial.surrogate(z, v, np.random.default_rng(1))
    assert s.std() == pytest.approx(v.std()) and s.mean() == pytest.approx(v.mean())
    out = spatial.surrogates(df.withColumn("g", F.lit(1)).withColumn("v", F.col("x")), "g", "k", "v", 2)
    assert out.count() == 12


def test_spatial_plus_recovers_slope(spark):
    rng = np.random.default_rng(5)
    z = rng.uniform(0, 10, (300, 2))
    field = np.sin(z[:, 0]) + np.cos(z[:, 1])
    e = field + 0.5 * rng.normal(size=300)
    o = 0.8 * e + 2 * field + 0.3 * rng.normal(size=300)
    df = spark.createDataFrame([(1, *map(float, r)) for r in np.column_stack([z, e, o])], "g long, x double, y double, e double, o double")
    r = spatial.spatial_plus(df, "g", "o", "e").first()
    assert r.slope == pytest.approx(0.8, abs=0.15)


def test_models(spark, numbers):
    df, a = numbers
    y, e, z, c = a[:, 1], a[:, 2], a[:, 3], a[:, 4]
    m = models.mixed(df, "c", "y", ["e", "z"])
    assert m["beta"][1] == pytest.approx(0.5, abs=0.15) and m["tau2"] == pytest.approx(1, abs=0.6) and m["sigma2"] == pytest.approx(1, abs=0.25)
    # the profile likelihood against the dense one
    x = np.column_stack([np.ones(len(y)), e, z])
    v = m["sigma2"] * np.eye(len(y)) + m["tau2"] * (c[:, None] == c[None, :])
    vi = np.linalg.inv(v)
    beta = np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y)
    assert m["beta"] == pytest.approx(beta, rel=1e-4)
    s = models.mixed_scores(df, "c", "y", "e", ["z"])
    assert s["tstat"] > 5 and s["lr"] > 10 and 0 < s["r2"] < 1
    b = df.withColumn("b", (F.col("y") > 0).cast("double"))
    lo = models.logit(b, "b", ["e", "z"])
    t = (y > 0).astype(float)
    xx, beta = np.column_stack([np.ones(len(y)), e, z]), np.zeros(3)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-xx @ beta))
        beta = beta + np.linalg.solve(xx.T @ ((mu * (1 - mu))[:, None] * xx), xx.T @ (t - mu))
    assert lo["beta"] == pytest.approx(beta, rel=1e-6)
    ge = models.gee_logit(b, "c", "b", ["e", "z"])
    assert ge["beta"][1] == pytest.approx(lo["beta"][1], abs=0.3) and ge["alpha"] > 0.05
    assert models.logit(df.limit(5).withColumn("b", F.lit(1.0)), "b", ["e"])["beta"] is None
    d = models.decline_terms(df.withColumn("t", F.col("id") % 3 + 0.0), "c", "y", "e", "t", ["z"])
    assert set(d) == {"overall", "between", "within"}


def test_posterior(spark, numbers):
    df, _ = numbers
    made = posterior.planted(df, ["e", "z"], [0.9, 0.1], 1.0, "id")
    sd = made.agg(F.stddev_pop("planted")).first()[0]
    assert 1.1 < sd < 1.8
    a, c, n, _ = posterior.cross_products(made, "planted", ["e", "z"], [])
    out = posterior.posterior(a, c, n, [100.0], 1, 2, draws=200, chains=2, center=math.log(100))
    assert out["w0"]["mean"] > 0.6 and out["beta"]["low"] > 0
    assert posterior.plasmode(df, ["e", "z"], [([1.0, 0.0], 1.0)], [], "id", 2)[0]["recovered"] == 1


def test_chains_and_run_files():
    c = chains.parse_lines("smooth = focal:mean:2 > temporal:median > water_mask # note\nplain = temporal:max")
    assert c[0].radius == 2 and c[1].statistic == "max" and chains.parse_lines(chains.format_lines(c)) == c
    for bad in ("x = focal:mean:2", "x = temporal:mode", "= temporal:max", "a = temporal:max\nA = temporal:min"):
        with pytest.raises(ValueError):
            chains.parse_lines(bad)
    assert chains.temporal_reducers("Max, median") == ["median", "max"]
    run = '[steps.fuse]\nengine = "fusion"\nndvi = "@ndvi.summer[median]"\n[steps.summer]\nengine = "ndvi"\n[steps.report]\nengine = "report"\nafter = ["fuse"]'
    steps = chains.load_run(run, {"summer.cloud": 5})
    assert [s.name for s in steps] == ["summer", "fuse", "report"] and chains.levels(steps) == {"summer": 0, "fuse": 1, "report": 2}
    assert steps[0].settings == {"cloud": 5}
    with pytest.raises(ValueError):
        chains.load_run('[steps.a]\nengine = "x"\nafter = ["b"]\n[steps.b]\nengine = "x"\nafter = ["a"]')
    assert chains.check_settings({"test_share": 0.5})["seed"] == 42
    with pytest.raises(ValueError, match="unknown.*must be"):
        chains.check_settings({"odd": 1, "seed": "x"})


def test_sources(spark, tmp_path):
    geo = tmp_path / "a.geojson"
    geo.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"NDVI":0.5,"id":1},"geometry":{"type":"Point","coordinates":[1.5,2.5]}},{"type":"Feature","properties":{"NDVI":null,"id":2},"geometry":{"type":"Point","coordinates":[3.0,4.0]}}]}')
    df = tables.read(spark, str(geo))
    assert tables.field_names(spark, str(geo)) == ["NDVI", "id", "x", "y"]
    assert [(r.mx, r.my, r.value) for r in tables.metric(df, "ndvi", "2015").orderBy("mx").collect()] == [(1.5, 2.5, 0.5), (3.0, 4.0, None)]
    with pytest.raises(ValueError):
        tables.metric(df, "veg")
    assert tables.is_raster("x.TIF") and tables.format_of("a.gpkg") == "gpkg"
    import sqlite3

    with sqlite3.connect(tmp_path / "p.gpkg") as con:
        con.execute("create table gpkg_contents (table_name text)")
        con.execute("insert into gpkg_contents values ('spots')")
        con.execute("create table spots (fid integer, name text, geom blob)")
        con.execute("insert into spots values (1, 'a', ?)", (b"GP\0\x01" + bytes(4) + b"WKB",))
    got = tables.read(spark, str(tmp_path / "p.gpkg")).first()
    assert (got.fid, got.name, bytes(got.geometry)) == (1, "a", b"WKB")
    one, two = (tables.geometry_digest(df.orderBy(o)).first()[0] for o in ("id", F.desc("id")))
    assert one == two
    prints = tables.fingerprints(spark, str(tmp_path))
    assert {r.status for r in tables.drift(prints, prints).collect()} == {"ok"}
    shards = frame(spark, [(0, 1.0), (2, 2.0)], "shard int, v double")
    tables.write_shards(shards, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError, match="1"):
        tables.read_shards(spark, str(tmp_path / "s"), 3)
    tables.persist_unit(shards, str(tmp_path / "u"), ["shard"])
    tables.persist_unit(shards.where("shard = 2").withColumn("v", F.lit(9.0)), str(tmp_path / "u"), ["shard"])
    assert {r.shard: r.v for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {0: 1.0, 2: 9.0}
    tables.write_geojson(df.select("id", "x", "y"), str(tmp_path / "out"))
    assert '"coordinates":[1.5,2.5]' in "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    tables.write_report({"t": shards}, str(tmp_path / "r"), {"seed": 1})
    assert (tmp_path / "r/manifest/_SUCCESS").exists()


def test_streaming(spark, tmp_path):
    path = f"{DATA}/events.parquet"
    live = events.run_once(events.windowed(events.read_events(spark, path)), "daily", str(tmp_path / "c"))
    still = events.windowed(spark.read.parquet(path))
    key = lambda r: (str(r.start), r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, live.collect())) == sorted(map(key, still.collect()))
    s = events.run_once(events.sessions(events.read_events(spark, path)), "visits", str(tmp_path / "d"), "append")
    assert s.columns == ["user_id", "start", "end", "n"]


def test_grids(spark):
    pts = frame(spark, [(1, 0.0, 0.0), (2, 15.0, 0.0), (3, 500.0, 0.0)], "k long, x double, y double")
    cells = grids.clustered_grid(pts, "k", 10.0, 10.0)
    got = {(r.row, r.col): r.cluster_id for r in cells.collect()}
    assert got == {(r, c): 1 for r in (-1, 0) for c in (-1, 0, 1)} | {(r, c): 3 for r in (-1, 0) for c in (49, 50)}
    tiles = grids.planar_tiles(cells, 20.0)
    assert sorted((r.cluster_id, r.cells) for r in tiles.collect()) == [(1, 2), (1, 4), (3, 4)]
    assert grids.quadrants(tiles).count() == 12


def test_bandwidth():
    x = np.linspace(0, 10, 200)
    assert grids.first_crossing(x, 3 - x) == pytest.approx(3) and grids.first_crossing(x, x + 1) is None
    assert grids.loess(x, x**2, np.array([5.0]))[0] == pytest.approx(25)
    z = np.random.default_rng(0).uniform(0, 100, (80, 2))
    b = spatial.thin_plate_basis(z, spatial.covering_knots(z, k=20))
    weights = grids.smoother_weights(b, np.r_[0, 0, 0, np.ones(b.shape[1] - 3)], 1e-3)
    width = grids.effective_bandwidth(z, weights)
    assert width is None or 0 < width < 100


def test_weighted(spark, numbers):
    df, _ = numbers
    assert inference.weighted_r2(df.withColumn("one", F.lit(2.0)), "y", "e", ["z"], "one") == pytest.approx(scoring.score("r2", df, "y", "e", ["z"]))
    assert inference.r2_difference(df.withColumn("n", F.rand(1)), "y", ("e", "n"), ["z"], "id", 50)["low"] > 0
    assert ladder.stat_column("percentile", 25) == "p25" and ladder.stat_column("percentile", 33) is None and ladder.stat_column("median") == "p50"
