"""Many rows at few places: what depends on the place alone is worked out once, so the work doesn't grow with the square of the rows."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import tails
from terraloom.operators import exposure, grids, joins, ladder, shapes, spatial
from terraloom.plans import catalogue


def soon(spark, f, seconds=30):
    """f's result; its jobs are cancelled, which is an error, when they take longer."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return f()
    finally:
        timer.cancel()


def crowd(spark, rows, key, x, y, places=2):
    """Rows at few places, 30 apart."""
    return spark.range(rows, numPartitions=4).select(F.col("id").alias(key), (F.col("id") % places * 30.0).alias(x), F.lit(0.0).alias(y), (F.col("id") % 5).cast("double").alias("v"))


def test_ladder_of_a_crowd(spark):
    targets, metric = crowd(spark, 160_000, "k", "x", "y"), crowd(spark, 160_000, "m", "mx", "my")
    out = ladder.disc_stats(targets, metric, "k", "v", [10.0, 40.0])
    got = soon(spark, lambda: {(r.radius, r.n, r["mean"], r.p50): r["count"] for r in out.groupBy("radius", "n", "mean", "p50").count().collect()})
    assert got == {(10.0, 80_000, 2.0, 2.0): 160_000, (40.0, 160_000, 2.0, 2.0): 160_000}
    rings = ladder.disc_rings(targets, metric, "k", "v", [40.0, 10.0]).groupBy("ring").agg(F.min("n").alias("n"))
    assert soon(spark, lambda: {r.ring: r.n for r in rings.collect()}) == {0: 80_000, 1: 160_000}


def test_ladder_against_brute_force(spark):
    """Shared places, keys of several rows, missing values and places, radii on the edge."""
    rng = np.random.default_rng(5)
    t = [(int(k), *(float(c) for c in rng.integers(-6, 7, 2) * 5)) for k in [*range(40), 3, 3, 17]] + [(90, None, 1.0)]
    m = [(int(k), *(float(c) for c in rng.integers(-6, 7, 2) * 5), None if k % 7 == 0 else float(k % 4), float("nan") if k % 11 == 0 else k / 3) for k in range(300)]
    out = ladder.disc_stats_columns(spark.createDataFrame(t, "k long, x double, y double"), spark.createDataFrame(m, "m long, mx double, my double, a double, b double"), "k", ["a", "b"], [5.0, 12.5], None)
    got = {(r.k, r.radius, r.channel): r for r in out.collect()}
    want = {}
    for k, x, y in t:
        for _, mx, my, *v in m:
            for radius in (5.0, 12.5):
                if x is not None and np.hypot(x - mx, y - my) <= radius:
                    for c, value in zip("ab", v):
                        want.setdefault((k, radius, c), []).append(value)
    assert got.keys() == want.keys() and any(k == 3 for k, *_ in want)
    for at, values in want.items():
        kept = [v for v in values if v is not None and v == v]
        assert got[at].n == len(kept)
        if kept:
            assert [got[at]["mean"], got[at].p10, got[at].p75] == pytest.approx([np.mean(kept), *np.quantile(kept, [0.1, 0.75])])
        else:
            assert got[at]["mean"] is None and got[at].p50 is None


def test_exact_interval_tails_of_many(spark, tmp_path):
    """Binomial coefficients of thousands exceed a float."""
    spark.range(9000).select(F.col("id").alias("l_suppkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    out = catalogue.QUERIES["exact_interval_tails"](spark, str(tmp_path)).collect()
    assert {(r.n, r.at_low, r.at_high) for r in out} == {(3000, 0.025, 0.025)} and sum(r.hits for r in out) == 450
    low, high = tails.clopper_pearson(60_000, 1_200_000)
    assert tails.binomial_tail(60_000, 1_200_000, low) == pytest.approx(0.025) and tails.binomial_tail(1_140_000, 1_200_000, 1 - high) == pytest.approx(0.025)
    assert [tails.binomial_tail(0, 5, 0.0), tails.binomial_tail(2, 5, 0.0), tails.binomial_tail(2, 5, 1.0), tails.binomial_tail(1, 2, 0.5)] == pytest.approx([1, 0, 1, 0.75])


def test_nearest_on_the_sphere_of_a_crowd(spark):
    at = lambda n, k, lat, lon: crowd(spark, n, k, "x", "y").select(k, (45 + F.col("x") / 1e5).alias(lat), F.lit(7.0).alias(lon))
    out = joins.haversine_nearest(at(160_000, "k", "lat", "lon"), at(160_000, "p", "plat", "plon"), "k", "p", 800.0).groupBy("lat", "p", "distance_m").count()
    assert soon(spark, lambda: sorted((r.p, r.distance_m, r["count"]) for r in out.collect())) == [(159_998, 0.0, 80_000), (159_999, 0.0, 80_000)]


def test_nearest_of_a_crowd(spark):
    left, right = crowd(spark, 160_000, "k", "x", "y"), crowd(spark, 160_000, "m", "mx", "my")
    out = joins.nearest_join(left, right, "k", ["m", "v"], 50.0, "m").groupBy("x", "m", "distance").count()
    assert soon(spark, lambda: sorted(tuple(r) for r in out.collect())) == [(0.0, 0, 0.0, 80_000), (30.0, 1, 0.0, 80_000)]


def test_nearest_of_keys_with_several_rows(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (1, 9.0, 0.0), (2, 0.0, 0.0), (3, 99.0, 0.0), (4, None, 0.0)], "k long, x double, y double")
    right = spark.createDataFrame([(7, 4.0, 0.0, "b"), (5, 4.0, 0.0, "a"), (6, 8.0, 0.0, "c"), (8, -4.0, 0.0, "d")], "m long, mx double, my double, v string")
    out = joins.nearest_join(left, right, "k", ["v"], 5.0, "m")
    assert sorted((r.k, r.x is not None and r.x, r.v, r.distance) for r in out.collect()) == [(1, 0.0, "c", 1.0), (1, 9.0, "c", 1.0), (2, 0.0, "a", 4.0), (3, 99.0, None, None), (4, False, None, None)]


def test_spacing_of_a_crowd(spark):
    out = soon(spark, lambda: joins.grid_spacing(crowd(spark, 160_000, "k", "mx", "my"), "k", 100.0).first())
    assert out.spacing == 0


def test_spacing_against_brute_force(spark):
    """Alone, together, far off, and one key at two places, which isn't its own neighbour."""
    p = [(1, 0.0, 0.0), (1, 1.0, 0.0), (2, 5.0, 0.0), (3, 5.0, 0.0), (4, 12.0, 0.0), (5, 500.0, 0.0), (6, None, 0.0)]
    near = {}
    for k, x, _ in p:
        near[k] = min([near.get(k, np.inf), *(abs(x - q) for j, q, _ in p if None not in (x, q) and j != k and abs(x - q) <= 50)]) if x is not None else np.inf
    want = np.median([d for d in near.values() if d < np.inf])
    assert joins.grid_spacing(spark.createDataFrame(p, "k long, mx double, my double"), "k", 50.0).first().spacing == pytest.approx(want)
    assert joins.grid_spacing(spark.createDataFrame(p[:1], "k long, mx double, my double"), "k", 50.0).first().spacing is None


def test_variogram_of_a_crowd(spark):
    out = soon(spark, lambda: {r.bin: (r.n_pairs, r.gamma) for r in spatial.variogram(crowd(spark, 160_000, "k", "x", "y"), "k", "v", 40.0, 4).collect()})
    inside, across = 80_000 * 79_999, 80_000 * 80_000
    # of values 0 to 4, equally often, the mean squared difference of all ordered pairs is 4
    assert out[0] == (inside, pytest.approx(0.5 * 4 * 80_000**2 / inside)) and out[3] == (across, pytest.approx(2.0))


def test_variogram_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p = [(k, *(float(c) for c in rng.integers(0, 6, 2) * 3), None if k % 9 == 0 else float(1e6 + rng.normal())) for k in range(120)]
    want = {}
    for i, (_, x, y, v) in enumerate(p):
        for _, x2, y2, v2 in p[i + 1 :]:
            d = np.hypot(x - x2, y - y2)
            if d <= 9:
                want.setdefault(min(int(d // 3), 2), []).append(None if None in (v, v2) else 0.5 * (v - v2) ** 2)
    got = {r.bin: r for r in spatial.variogram(spark.createDataFrame(p, "k long, x double, y double, v double"), "k", "v", 9.0, 3).collect()}
    assert got.keys() == want.keys()
    for b, pairs in want.items():
        assert got[b].n_pairs == len(pairs) and got[b].gamma == pytest.approx(np.mean([q for q in pairs if q is not None]))


def test_components_of_a_crowd(spark):
    out = spatial.radius_components(crowd(spark, 160_000, "k", "x", "y", 3), "k", 20.0).groupBy("component").count()
    assert soon(spark, lambda: sorted(tuple(r) for r in out.collect())) == [(0, 53_334), (1, 53_333), (2, 53_333)]


def test_components_against_union_find(spark):
    """Dense and sparse places, the reach on the edge, a key at two places, a key without one."""
    rng = np.random.default_rng(8)
    p = [(int(k), *(float(c) for c in rng.integers(0, 60, 2))) for k in rng.permutation(150)] + [(7, 500.0, 500.0), (800, 501.0, 500.0), (900, None, 1.0)]
    for reach in (5.0, 0.0):
        up = {k: k for k, *_ in p}
        find = lambda k: k if up[k] == k else find(up[k])  # noqa: E731, B023
        for k, x, y in p:
            for j, x2, y2 in p:
                if x is not None and x2 is not None and np.hypot(x - x2, y - y2) <= reach and find(k) != find(j):
                    a, b = sorted((find(k), find(j)))
                    up[b] = a
        got = spatial.radius_components(spark.createDataFrame(p, "k long, x double, y double"), "k", reach).collect()
        assert len(got) == len(p) and {r.k: r.component for r in got} == {k: find(k) for k, *_ in p}


def test_merged_components_of_a_crowd(spark):
    p = crowd(spark, 160_000, "k", "x", "y").unionByName(spark.createDataFrame([(900_000, 200.0, 0.0, 1.0)], "k long, x double, y double, v double"))
    out = spatial.component_report(p, spatial.group_labels(p, "k", reach=35.0, least=4).withColumnRenamed("group", "component"), "k")
    assert soon(spark, lambda: [tuple(r) for r in out.collect()]) == [(0, 160_001, 200.0)]


def test_grid_of_a_crowd(spark):
    cells = grids.clustered_grid(crowd(spark, 20_000, "k", "x", "y"), "k", 10.0, 0.1)  # 30,000 cells about each place
    tiles = grids.planar_tiles(cells, 5.0).groupBy("cluster_id").agg(F.sum("cells").alias("n"))
    got = soon(spark, lambda: {r.cluster_id: r.n for r in tiles.collect()})
    assert got.keys() == {0, 1} and all(abs(n - np.pi * 100**2) < 100 for n in got.values())


def test_cells_are_made_in_all_partitions(spark):
    """Points are spread before they become cells, and the sums need no shuffle of cells."""
    one = crowd(spark, 3000, "k", "x", "y").coalesce(1)
    out = exposure.point_cells(one, "k", 10.0, "linear", 25.0, 5.0)
    assert out.count() == 3000 * out.where("k = 2").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    assert out.where("k = 2").select(F.sum("weight")).first()[0] == pytest.approx(exposure.point_cells(one.where("k = 2"), "k", 10.0, "linear", 25.0, 5.0).select(F.sum("weight")).first()[0])


def test_dispersion_by_counted_values(spark):
    df = spark.range(5000, numPartitions=4).select((F.col("id") % 50).cast("double").alias("a"), F.when(F.col("id") == 7, 1e6).otherwise(F.col("id") % 3).alias("b"), (F.col("id") % 2).alias("c"), F.lit(None).cast("double").alias("d"))
    out = ladder.dispersion_flags(df, ["a", "b", "c", "d"])
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.column: r for r in out.collect()}
    a, b = np.arange(5000) % 50, np.where(np.arange(5000) == 7, 1e6, np.arange(5000) % 3)
    assert [got["a"].sd, got["a"].spread, got["a"]["values"]] == pytest.approx([a.std(), np.quantile(a, 0.9) - np.quantile(a, 0.1), 50])
    assert [got["b"].sd, got["b"].spread, got["b"]["values"]] == pytest.approx([b.std(), np.quantile(b, 0.9) - np.quantile(b, 0.1), 4])
    assert {c: r.flagged for c, r in got.items()} == {"a": False, "b": True, "c": False, "d": False} and got["d"].sd is None and got["d"]["values"] == 0


def forms(spark, rows, places=2):
    """Many keys whose shapes are triangles at few places."""
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), F.lit(float(dy)).alias("y"))
    return crowd(spark, rows, "s", "x", "y", places).select("s", F.lit("polygon").alias("kind"), F.array(at(0.0, -1), at(4.0, -1), at(0.0, 3), at(0.0, -1)).alias("xy"))


def test_shape_statistics_of_a_crowd(spark):
    out = shapes.shape_disc_stats(forms(spark, 8000), crowd(spark, 160_000, "m", "mx", "my"), "s", "m", "v", [5.0, 28.0])
    got = soon(spark, lambda: sorted(tuple(r) for r in out.groupBy("radius", "n", "mean", "p90").count().collect()))
    # the point of the second place lies 27 from the first triangle's edge, and that of the first 30 from the second triangle
    assert got == [(5.0, 80_000, 2.0, 4.0, 8000), (28.0, 80_000, 2.0, 4.0, 4000), (28.0, 160_000, 2.0, 4.0, 4000)]


def test_shape_statistics_against_pairs(spark):
    """Parts of one key, equal forms, a form much wider than the others, missing values, a margin."""
    rng = np.random.default_rng(6)
    ring = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    made = [(k, "polygon", ring(*(float(c) for c in rng.integers(0, 90, 2)), 3.0)) for k in range(20)]
    made += [(50, *made[0][1:]), (51, "point", [(7.0, 7.0)]), (52, "line", [(1.0, 1.0), (9.0, 4.0), (20.0, 4.0)]), (52, "polygon", ring(15.0, 2.0, 4.0)), (53, "polygon", ring(-400.0, -400.0, 900.0)), (54, "polygon", [])]
    df = spark.createDataFrame([(k, kind, [{"x": x, "y": y} for x, y in xy]) for k, kind, xy in made], "s long, kind string, xy array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i, *(float(c) for c in rng.integers(0, 90, 2)), None if i % 6 == 0 else float(i % 7)) for i in range(800)], "m long, mx double, my double, v double")
    got = shapes.shape_disc_stats(df, points, "s", "m", "v", [2.0, 6.0], 0.5)
    pairs = shapes.shape_pairs(df.where(F.size("xy") > 0), points, "s", "m", 6.5)
    rings = F.filter(F.array(F.lit(2.0), F.lit(6.0)), lambda q: q + 0.5 >= F.col("d"))
    want = ladder.summarise(pairs.select("s", "v", F.explode(rings).alias("radius")), ["s", "radius"], F.col("v"))
    plain = lambda rows: sorted(tuple(round(c, 3) if isinstance(c, float) else c for c in r) for r in rows.select("s", "radius", "n", "mean", "p10", "p50", "p90").collect())
    assert plain(got) == plain(want) and {50, 51, 52, 53} <= {r.s for r in got.collect()}


def test_clip_of_a_crowd(spark):
    points = crowd(spark, 160_000, "m", "mx", "my").unionByName(spark.createDataFrame([(900_000, 3.5, 0.0, 1.0), (900_001, None, 0.0, 1.0), (900_002, 1.0, 0.0, 1.0)], "m long, mx double, my double, v double"))
    out = shapes.clip_points(points.withColumnsRenamed({"mx": "x", "my": "y"}), forms(spark, 8000), "m")
    assert out.columns == ["m", "x", "y", "v"] and soon(spark, lambda: (out.count(), out.where("m >= 900000").count())) == (160_001, 1)


def test_buckets_of_shapes_are_as_wide_as_the_shapes(spark):
    """Not a thousand for each shape where nothing is to be reached."""
    plan = shapes.shape_pairs(forms(spark, 10), crowd(spark, 10, "m", "mx", "my"), "s", "m", 0.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "/ 4.0)" in plan


def test_zonal_statistics_of_a_crowd(spark):
    raster = spark.range(4000).select((F.col("id") % 80 - 40).alias("row"), F.floor(F.col("id") / 80).alias("col"), F.lit(1.5).alias("value"))
    out = shapes.shape_zonal_stats(forms(spark, 20_000), raster, "s", 1.0, [0.0, 6.0])
    got = soon(spark, lambda: sorted(tuple(r) for r in out.groupBy("radius", "mean").agg(F.count("*")).collect()))
    assert got == [(0.0, 1.5, 20_000), (6.0, 1.5, 20_000)]


def test_basis_of_many_rows(spark):
    """Rows of one place share its basis; a component may have any number of rows."""
    df = spark.range(24_000, numPartitions=4).select(F.col("id").alias("k"), F.when(F.col("id") >= 6, 1).alias("g"), (F.col("id") * 37 % 401).cast("double").alias("x"), (F.col("id") * 53 % 199 % 40).cast("double").alias("y"))
    rows = spatial.basis_table(df, "k", "g", 12, 8).join(df, "k").orderBy("k").collect()
    assert len(rows) == 24_000
    held = [r for r in rows if r.g]
    z, b = np.array([(r.x, r.y) for r in held]), np.array([r.basis for r in held])
    assert b.shape == (len(held), 8) and np.allclose(b[:, 1:3], (z - z.mean(axis=0)) / 400) and np.linalg.matrix_rank(b) == 8
    # the same as a basis of rows at the same knots
    places, at, counts = spatial.distinct_places(z)
    order = np.lexsort((places[:, 1], places[:, 0]))
    knots = places[order][spatial.covering_knots(places[order], k=12, weights=counts[order])]
    same = spatial.thin_plate_basis(z, np.array([np.flatnonzero((z == q).all(axis=1))[0] for q in knots]), 8)
    assert np.allclose(b, same, atol=1e-8)


def test_surrogates_of_many_rows(spark):
    """Over 3,000 rows of a group; the variogram and the neighbours of rows, of which many share a place."""
    rng = np.random.default_rng(2)
    z = rng.integers(0, 12, (500, 2)).astype(float)
    held = spatial.Places(z)
    held.step = 7
    f = rng.normal(size=500) + z[:, 0]
    d = np.hypot(*(z[:, None, :] - z[None, :, :]).transpose(2, 0, 1))
    i, j = np.triu_indices(500, 1)
    at = np.minimum((d[i, j] / (d.max() / 2) * 10).astype(int), 10)
    want = [0.5 * ((f[i] - f[j])[at == b] ** 2).mean() if (at == b).any() else 0.0 for b in range(10)]
    assert held.gammas([z[:, 1], f])[1] == pytest.approx(want)
    held = spatial.Places(z, 31)
    for row in (0, 77, 499):
        near = held.nearest[held.at[row]]
        assert len(set(near)) == 31 and np.allclose(np.sort(d[row])[:31], d[row][near])
    assert held.smooth(f, 3)[77] == pytest.approx(f[held.nearest[held.at[77], :4]].mean())
    df = crowd(spark, 4000, "k", "x", "y", 300).withColumn("g", F.lit(1))
    out = spatial.surrogates(df, "g", "k", "v", 2).groupBy("draw").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
    assert [(r.n, r.m, r.s) for r in out] == [(4000, pytest.approx(2), pytest.approx(2**0.5))] * 2


def smooth_rows(spark, rows=24_000):
    """An outcome and an exposure over one surface, many rows at few places of one group."""
    draw = lambda seed: F.randn(seed)
    at = spark.range(rows, numPartitions=2).select(F.col("id"), F.lit(1).alias("g"), (F.col("id") % 40 / 4).alias("x"), (F.floor(F.col("id") / 40) % 10).cast("double").alias("y"))
    return at.withColumn("wave", F.sin("x") + F.col("y") / 5).withColumn("ex", F.col("wave") + draw(3) * 0.5).withColumn("out", 0.7 * F.col("ex") + 2 * F.col("wave") + draw(4) * 0.3)


def test_slopes_of_many_rows(spark):
    r = spatial.plus_report(smooth_rows(spark), "g", "id", ["ex"], ["out"], 10).first()
    assert r.n == 24_000 and r.slope == pytest.approx(0.7, abs=0.02) and r.low < r.slope < r.high


def test_smoother_adds_rows_up_by_place():
    rng = np.random.default_rng(4)
    z = rng.integers(0, 6, (300, 2)).astype(float)
    made, v, w = spatial.Smoother(z, 20), rng.normal(size=300), rng.integers(0, 3, 300).astype(float)
    b = made.basis[made.at]
    assert len(made.basis) == 36 and (b**2).mean(axis=0) == pytest.approx(np.ones(b.shape[1]))
    for weights in (None, w):
        wide = b.T * (np.ones(300) if weights is None else weights)
        m = wide @ b + 0.3 * np.diag(made.penalty) + 1e-10 * np.eye(b.shape[1])
        assert made.fitted(made.penalised(0.3, made.gram(weights)), v, weights) == pytest.approx(b @ np.linalg.solve(m, wide @ v))
    assert made.trace(0.3) == pytest.approx(np.trace(b @ np.linalg.solve(b.T @ b + 0.3 * np.diag(made.penalty) + 1e-10 * np.eye(b.shape[1]), b.T)))


def test_search_columns_of_many_rows(spark):
    df = smooth_rows(spark)
    moved = spatial.search_transform(df, "g", "id", ["ex"])
    left = lambda t: abs(t.agg(F.corr("ex", "wave")).first()[0])
    assert moved.count() == 24_000 and left(moved) < 0.1 * left(df)
