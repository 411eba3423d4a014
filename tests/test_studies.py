"""Files, shapes, projections, resamples, designs and whole studies on small fixtures, against NumPy and hand-made answers."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import composites, crs, kernels
from terraloom.operators import designs, gram, models, posterior, resampling, search, shapes, spatial
from terraloom.plans import chains, study
from terraloom.sources import exports, geotiff, tables


def raster_rows(spark, values):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(values) if np.isfinite(v)], "row long, col long, value double")


def tiff(values, compression=1, predictor=1, tile=None, kind="<f4"):
    """A TIFF of one band in strips of three rows or in tiles."""
    h, w = values.shape
    v = values.astype(kind)
    blocks = []
    if tile:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                b = np.zeros((tile, tile), kind)
                part = v[r : r + tile, c : c + tile]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(b)
    else:
        blocks = [v[r : r + 3] for r in range(0, h, 3)]

    def pack(b):
        if predictor == 2:
            b = np.diff(b, axis=1, prepend=np.zeros((len(b), 1), kind)).astype(kind)
        raw = np.ascontiguousarray(b).tobytes()
        if predictor == 3:
            planes = np.ascontiguousarray(b).astype(">f4").view(np.uint8).reshape(len(b), -1, 4).transpose(0, 2, 1).reshape(len(b), -1)
            raw = np.diff(planes, axis=1, prepend=np.zeros((len(b), 1), np.uint8)).astype(np.uint8).tobytes()
        return zlib.compress(raw) if compression == 8 else raw

    data = [pack(b) for b in blocks]
    sample = {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [np.dtype(kind).itemsize * 8]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [sample]), (33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 500.0, 900.0, 0.0])]
    tags += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, [0] * len(data)), (325, 4, [len(x) for x in data])] if tile else [(273, 4, [0] * len(data)), (278, 4, [3]), (279, 4, [len(x) for x in data])]
    tags.sort()
    sizes, code = {3: 2, 4: 4, 12: 8}, {3: "H", 4: "I", 12: "d"}
    head = 8 + 2 + 12 * len(tags) + 4
    extra = sum(sizes[t] * len(v) for _, t, v in tags if sizes[t] * len(v) > 4)
    starts = np.cumsum([head + extra, *(len(x) for x in data[:-1])]).tolist()
    body, entries = b"", b""
    for n, t, v in tags:
        raw = struct.pack(f"<{len(v)}{code[t]}", *(starts if n in (273, 324) else v))
        if len(raw) > 4:
            entries += struct.pack("<HHII", n, t, len(v), head + len(body))
            body += raw
        else:
            entries += struct.pack("<HHI", n, t, len(v)) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + struct.pack("<I", 0) + body + b"".join(data)


@pytest.mark.parametrize("options", [{}, {"compression": 8}, {"compression": 8, "predictor": 3}, {"compression": 8, "predictor": 2, "kind": "<i2"}, {"tile": 16}, {"tile": 16, "compression": 8, "kind": "<u1"}])
def test_geotiff_is_read(spark, tmp_path, options):
    values = np.arange(20 * 21).reshape(20, 21) % 250
    path = tmp_path / "a.tif"
    path.write_bytes(tiff(values, **options))
    got = {(r.row, r.col): r.value for r in geotiff.read_geotiff(spark, str(path)).collect()}
    assert got == {k: float(v) for k, v in np.ndenumerate(values)}
    part = geotiff.read_geotiff(spark, str(path), window=(4, 2, 9, 19)).collect()
    assert {(r.row, r.col): r.value for r in part} == {k: float(v) for k, v in np.ndenumerate(values) if 4 <= k[0] < 9 and 2 <= k[1] < 19}
    info = geotiff.raster_info(spark, [str(path)]).first()
    assert (info.width, info.height, info.x0, info.y0, info.size_x) == (21, 20, 500.0, 900.0, 10.0)


def test_lzw_and_packbits():
    assert geotiff.unpack_bits(bytes([254, 7, 2, 1, 2, 3, 128])) == bytes([7, 7, 7, 1, 2, 3])
    # codes of nine bits: clear, 7, 258 (7 7), 8, end
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257))
    assert geotiff.unpack_lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == bytes([7, 7, 7, 8])


def test_geotiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = np.where(rng.random((30, 25)) < 0.2, np.nan, rng.normal(size=(30, 25)).astype("f4"))
    index = geotiff.write_geotiff_tiles(raster_rows(spark, values), str(tmp_path / "t"), 100.0, 900.0, 10.0, epsg=32633, tile=16)
    assert index.count() == 4 and index.agg(F.sum("pixels")).first()[0] == np.isfinite(values).sum()
    assert geotiff.read_info(str(tmp_path / "t/tile_1_0.tif")).y0 == 740.0 and geotiff.read_info(str(tmp_path / "t/tile_1_0.tif")).epsg == 32633
    got = {}
    for r in geotiff.read_geotiff(spark, str(tmp_path / "t")).where("value is not null").collect():
        i, j = map(int, r.path.rsplit("tile_", 1)[1][:-4].split("_"))
        got[i * 16 + r.row, j * 16 + r.col] = r.value
    assert got == {k: float(v) for k, v in np.ndenumerate(values) if np.isfinite(v)}
    assert study.load_target(spark, str(tmp_path / "t/tile_0_0.tif")).count() == np.isfinite(values[:16, :16]).sum()
    with pytest.raises(ValueError):
        geotiff.local_path("s3://a/b.tif")


SHAPES = [(1, "polygon", [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]), (2, "line", [(20, 0), (30, 0)]), (2, "line", [(20, 40), (30, 40)]), (3, "point", [(50, 50)])]


@pytest.fixture
def shaped(spark):
    return spark.createDataFrame([(k, kind, [{"x": float(x), "y": float(y)} for x, y in xy]) for k, kind, xy in SHAPES], "k long, kind string, xy array<struct<x:double,y:double>>")


def test_shapes(spark, shaped):
    assert {r.k: r.km2 for r in shapes.areas_km2(shaped, "k").collect()} == {1: 1e-4, 2: None, 3: None}
    assert {r.k: (r.x, r.y) for r in shapes.middles(shaped, "k").collect()} == {1: (5.0, 5.0), 2: (25.0, 20.0), 3: (50.0, 50.0)}
    points = spark.createDataFrame([(1, 5.0, 5.0, 1.0), (2, 13.0, 14.0, 2.0), (3, 25.0, 3.0, 3.0), (4, 50.0, 50.0, 4.0), (5, 25.0, 36.0, 5.0)], "p long, mx double, my double, v double")
    near = {(r.k, r.p): r.d for r in shapes.shape_pairs(shaped, points, "k", "p", 5.0).collect()}
    assert near == {(1, 1): 0.0, (1, 2): 5.0, (2, 3): 3.0, (3, 4): 0.0, (2, 5): 4.0}
    stats = {(r.k, r.radius): (r.n, r["mean"]) for r in shapes.shape_disc_stats(shaped, points, "k", "p", "v", [0.0, 4.0, 5.0]).collect()}
    assert stats == {(1, 0.0): (1, 1.0), (1, 4.0): (1, 1.0), (1, 5.0): (2, 1.5), (2, 4.0): (2, 4.0), (2, 5.0): (2, 4.0), (3, 0.0): (1, 4.0), (3, 4.0): (1, 4.0), (3, 5.0): (1, 4.0)}
    kept = shapes.clip_points(points.withColumnsRenamed({"mx": "x", "my": "y"}), shaped, "p")
    assert [r.p for r in kept.collect()] == [1]


def test_shape_pixels(spark, shaped):
    raster = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(-12, 2) for c in range(-2, 12)], "row long, col long, value double")
    touched = {(r.row, r.col) for r in shapes.shape_pixels(shaped.where("k = 3"), "k", 10.0).collect()}
    assert touched == {(-6, 4), (-6, 5), (-5, 4), (-5, 5)}  # a corner belongs to four pixels
    inside = {(r.row, r.col): r.d for r in shapes.shape_pixels(shaped.where("k = 1"), "k", 10.0, 5.0).collect()}
    assert inside[(-1, 0)] == 0.0 and inside[(0, 0)] == 0.0 and (1, 0) not in inside
    out = shapes.shape_zonal_stats(shaped.where("k = 3"), raster, "k", 10.0, [0.0, 4.0]).collect()
    assert {(r.radius, r.n) for r in out} == {(0.0, 4), (4.0, 4)}


def test_sampling_points(spark, shaped):
    inside = {(r.row, r.col) for r in shapes.sampling_points(shaped, "k", 5.0).collect()}
    assert inside == {(-1, 0), (-1, 1), (-2, 0), (-2, 1)}
    points = spark.createDataFrame([(1, 2.5, -2.5)], "k long, x double, y double")
    assert shapes.sampling_points(points, "k", 5.0).count() == 1
    assert shapes.sampling_points(points, "k", 5.0, 5.0).count() == 5
    assert shapes.cell_boxes(spark.createDataFrame([(2, 3)], "row long, col long"), 10.0).first()[2:] == (30.0, -30.0, 40.0, -20.0)


def test_projections(spark, monkeypatch):
    assert crs.in_metres(32633) and crs.in_metres(3978) and not crs.in_metres(4326) and not crs.in_metres(None) and not crs.in_metres(99999)
    df = spark.createDataFrame([(10.0, 50.0)], "x double, y double")
    assert crs.normalised(df, 4258)[1] == 4326 and crs.normalised(df, 32633)[1] == 32633 and crs.normalised(df, None)[0].count() == 1
    with pytest.raises(Exception, match="look like metres"):
        crs.normalised(df.select(F.lit(400000.0).alias("x"), "y"), 4326)[0].collect()
    # a published worked example, on its own ellipsoid
    c = {"lat_1": 33.0, "lat_2": 45.0, "lat_0": 23.0, "lon_0": -96.0}
    with monkeypatch.context() as m:
        for k, v in (("A", 6378206.4), ("E2", 0.00676866), ("E1", 0.0822719)):
            m.setattr(crs, k, v)
        r = spark.range(1).select(*crs.conic_forward(F.lit(35.0), F.lit(-75.0), c)).first()
    assert r[0] == pytest.approx(1894410.9, abs=0.5) and r[1] == pytest.approx(1564649.5, abs=0.5)
    assert crs.conic_scale(33.0, c) == pytest.approx(1, abs=1e-12) and crs.conic_scale(39.0, c) < 1
    grid, most = crs.distortion(10.0, 13.0, 48.0, 50.0)
    assert grid["kind"] == "utm" and most < 0.001
    assert crs.distortion(-10.0, 30.0, 10.0, 70.0)[1] > 0.02
    assert crs.distortion(0.0, 40.0, 78.0, 82.0)[0]["kind"] == "polar"
    info = {"x0": -1000.0, "y0": 1000.0, "width": 20, "height": 20, "size_x": 100.0, "size_y": 100.0, "epsg": None}
    left, bottom, right, top = crs.raster_bounds_degrees(info, c)
    assert left < -96 < right and bottom < 23 < top and crs.raster_bounds_degrees(info) is None


def test_small_grammars():
    assert chains.output_stems("a", ["median", "max"]) == {"median": "a", "max": "a_max"}
    assert chains.parse_value("20") == 20 and chains.parse_value('["a"]') == ["a"] and chains.parse_value("2019-05-01") == "2019-05-01" and chains.parse_value("plain text") == "plain text"
    assert kernels.radius_bounds(1030.4, 99.7, 300) == (100, 1000, 300) and kernels.radius_bounds(0, 0.2, 0) == (0, 1, 1)
    composites.check_disjoint()
    with pytest.raises(ValueError):
        composites.check_disjoint({"a": ("X",), "b": ("x",)})
    assert search.decode_column(5, [100.0, 200.0, 400.0], ["mean", "p50"]) == (400.0, "p50")
    assert exports.plain({1: np.array([1.0, np.nan]), "d": {"x": np.int64(3), "t": (True, None)}}) == {"1": [1.0, None], "d": {"x": 3, "t": [True, None]}}


def test_simplex_batch_is_the_single_fit():
    rng = np.random.default_rng(2)
    gs, cs = [], []
    for _ in range(60):
        x = rng.normal(size=(40, 3))
        gs.append(x.T @ x)
        cs.append(rng.normal(size=3) * 5)
    w, v = search.simplex_batch(np.array(gs), np.array(cs))
    for g, c, a, b in zip(gs, cs, w, v):
        own, value = search.simplex_fit(g, c)
        assert b == pytest.approx(value, abs=1e-9) and a == pytest.approx(own, abs=1e-7)


def test_wide_gram(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 25))
    x[7, 3] = np.nan
    names = [f"c{i}" for i in range(25)]
    df = spark.createDataFrame([(int(i % 3), float(i % 5), *map(float, r)) for i, r in enumerate(x)], "g long, w double, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    ok = np.isfinite(x).all(axis=1)
    one = np.column_stack([np.ones(500), x])[ok]
    assert gram.gram(df, names).matrix == pytest.approx(one.T @ one) and gram.gram(df, names).n == 499
    w = (np.arange(500) % 5)[ok].astype(float)
    assert gram.gram(df, names, "w").matrix == pytest.approx((one * w[:, None]).T @ one * (w > 0).sum() / w.sum())
    by = gram.grams_by(df, "g", names)
    for k in range(3):
        own = one[(np.arange(500) % 3)[ok] == k]
        assert by[k].n == len(own) and by[k].matrix == pytest.approx(own.T @ own)
    assert gram.gram(df.limit(0), names).n == 0


def panel(spark, seed=4, entities=60):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(entities):
        u, z = rng.normal(), rng.normal()
        for t in range(2 + e % 3):
            g = rng.normal() + z
            rows.append((e, float(t), float(g), float(z), float(1 + 2 * g + z + 0.3 * t + u + rng.normal() * 0.5)))
    return spark.createDataFrame(rows, "e long, t double, g double, z double, y double")


def test_mixed_sums_agree_with_the_fit(spark):
    df = panel(spark)
    sums = models.MixedSums(df, "e", ["g", "z", "t", "y"])
    for reml in (True, False):
        one, two = models.mixed(df, "e", "y", ["g", "z", "t"], reml), sums.fit("y", ["g", "z", "t"], reml)
        assert two["beta"] == pytest.approx(one["beta"], rel=1e-4) and two["se"] == pytest.approx(one["se"], rel=1e-3)
    assert sums.marginal_r2("y", ["g", "z"]) == pytest.approx(models.marginal_r2(df, "e", "y", ["g", "z"]), rel=1e-4)
    impact = {r["covariate"]: r for r in models.covariate_impact(df, "e", "y", "g", ["z", "t"])}
    assert impact["z"]["lr"] > 4 and impact["z"]["r2_drop"] > impact["t"]["r2_drop"] >= 0
    ci = models.entity_bootstrap(df, "e", "y", "g", ["z", "t"], "coef", 60)
    assert ci["low"] < ci["observed"] < ci["high"] and 1.7 < ci["low"] and ci["high"] < 2.3
    assert models.post_metrics(df, "e", "y", ["g"], ["z"])["g"]["coef"] == pytest.approx(2, abs=0.2)
    assert models.make_fitter(df, "y", "ols", "e")(["g"])["names"] == ["1", "g"]
    with pytest.raises(ValueError):
        models.make_fitter(df, "y", "gee")


def test_permutations_match_numpy(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=80)
    x = z + rng.normal(size=80)
    y = 0.2 * x + z + rng.normal(size=80)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z))], "id long, x double, y double, z double")
    got = resampling.permutation_r2(df, "y", "x", ["z"], "id", 20, 3)
    order = [r.id for r in df.withColumn("u", resampling.draw(F.col("id"), 3)).orderBy("u", "id").collect()]
    x, y, z = x[order], y[order], z[order]
    d = np.column_stack([np.ones(80), z])
    fit = d @ np.linalg.lstsq(d, y, rcond=None)[0]
    r2 = lambda yy, m: 1 - ((yy - m @ np.linalg.lstsq(m, yy, rcond=None)[0]) ** 2).sum() / ((yy - yy.mean()) ** 2).sum()
    full = np.column_stack([d, x])
    want = []
    for a, b in resampling.steps(80, 20, 3):
        moved = fit + (y - fit)[(a * np.arange(80) + b) % 80]
        want.append(r2(moved, full) - r2(moved, d))
    assert sorted(got["scores"]) == pytest.approx(sorted(want), abs=1e-9)
    assert got["observed"] == pytest.approx(r2(y, full) - r2(y, d)) and got["p"] == pytest.approx((sum(w >= got["observed"] for w in want) + 1) / 21)
    assert all(sorted((a * i + b) % 80 for i in range(80)) == list(range(80)) for a, b in resampling.steps(80, 20, 3))


def test_distance_scorer_and_blocks(spark):
    from terraloom.operators.scoring import partial_distance_correlation

    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 4))
    s = resampling.DistanceScorer(v[:, 0], v[:, 1], v[:, 2:])
    assert s.at() == pytest.approx(partial_distance_correlation(v[:, 1], v[:, 0], v[:, 2:]))
    order = rng.permutation(40)
    assert s.surrogate(order) == pytest.approx(partial_distance_correlation(v[:, 1], v[order, 0], v[:, 2:]))
    rows = rng.integers(0, 40, 40)
    assert s.at("x", rows) == pytest.approx(partial_distance_correlation(v[rows, 1], v[rows, 0], v[rows, 2:]))
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], "y double, x double, a double, b double").withColumn("id", F.monotonically_increasing_id())
    assert resampling.pdcor_bootstrap(df, "y", ["x"], ["a", "b"], 6).count() == 6
    assert 0 < resampling.pdcor_permutation(df, "y", "x", ["a", "b"], 19)["p"] <= 1
    assert resampling.residual_replicates(df, "nrmse", "y", "x", ["a"], "id", 5).where("score > 0").count() == 5
    smooth = np.zeros((40, 6))
    smooth[:20, :3], smooth[20:, 3:] = rng.normal(size=(20, 3)), rng.normal(size=(20, 3))
    assert [(len(r), c.tolist()) for r, c in resampling.smooth_blocks(smooth)] == [(20, [0, 1, 2]), (20, [3, 4, 5])]
    w = rng.integers(0, 3, 40).astype(float)
    made = resampling.BlockDesign(np.ones((40, 1)), smooth)
    root, d = np.sqrt(w)[:, None], np.column_stack([np.ones(40), smooth])
    rss = lambda m: ((root[:, 0] * v[:, 0] - root * m @ np.linalg.lstsq(root * m, root[:, 0] * v[:, 0], rcond=None)[0]) ** 2).sum()
    sst = (w * (v[:, 0] - np.average(v[:, 0], weights=w)) ** 2).sum()
    assert made.r2(w, v[:, 0], v[:, 1]) == pytest.approx((rss(d) - rss(np.column_stack([d, v[:, 1]]))) / sst)
    assert resampling.orthonormal(np.column_stack([v, v[:, :1]])).shape == (40, 4)
    assert resampling.row_weights(np.array([[0, 0, 2]]), 3).tolist() == [[2, 0, 1]]


def test_designs(spark):
    df = panel(spark)
    wide, names = designs.expand_splines(df, ["g", "t"])
    assert names[0] == "g" and len(names) == 4 and names[-1] == "t"  # t has four values, so it stays as it is
    rows, columns, target = designs.target_design(df, "e", "g", "t", ["z"], "decline_within")
    assert columns == ["between", "within", "t", "z", "decline_between", "decline_within"] and target in rows.columns
    assert designs.target_design(df, "e", "g", "t", [], "level", time=False)[1] == ["g"]
    with pytest.raises(ValueError):
        designs.target_design(df, "e", "g", "t", [], "other")
    assert designs.relationship_sign(df, "y", "g", ["z"]) == 1 and designs.relationship_sign(df.withColumn("n", -F.col("y")), "n", "g") == -1
    assert designs.score_over_smooth(df, "y", "g", [], ["z"]) == pytest.approx(gram.incremental_r2(gram.gram(df, ["z", "g", "y"]), "y", "g", ["z"]))
    assert 0 < designs.score_over_smooth(df, "y", "g", [], ["z"], "exposure") < 1
    f = designs.collinearity(df.withColumn("twin", F.col("g") + F.col("t") / 1000).withColumn("k", F.monotonically_increasing_id()), ["g", "twin", "t"], "k")
    assert set(f["flagged"]) >= {"g", "twin"}


def test_smoother(spark):
    rng = np.random.default_rng(7)
    z = rng.uniform(0, 10, (150, 2))
    wave = np.sin(z[:, 0]) + z[:, 1] / 5
    x = wave + rng.normal(size=150) * 0.5
    y = 0.7 * x + 2 * wave + rng.normal(size=150) * 0.3
    made = spatial.Smoother(z, 40)
    for kind in ("gcv", "reml"):
        r, _ = made.exposure_residual(x, kind)
        slope, se, _ = made.outcome_slope(y, r, kind)
        assert slope == pytest.approx(0.7, abs=0.15) and 0 < se < 0.2
    df = spark.createDataFrame([(i, 1, float(a), float(b), float(c), float(e)) for i, ((a, b), c, e) in enumerate(zip(z, x, y))], "id long, g int, x double, y double, ex double, out double")
    r = spatial.plus_report(df, "g", "id", ["ex"], ["out"], 30).first()
    assert r.slope == pytest.approx(0.7, abs=0.15) and r.low < r.slope < r.high and r.n == 150
    moved = spatial.search_transform(df, "g", "id", ["ex"])
    left = lambda t: abs(t.agg(F.corr("ex", F.sin("x"))).first()[0])
    assert moved.count() == 150 and left(moved) < 0.5 * left(df)
    labels = {r.id: r.group for r in spatial.group_labels(df.where("id < 6").withColumn("v", F.col("id") % 2), "id", "v").collect()}
    assert labels == {i: i % 2 for i in range(6)}


def test_posteriors(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(300, 4))
    y = 0.5 * v[:, 0] + 0.3 * v[:, 3] + rng.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, r), float(o)) for i, (r, o) in enumerate(zip(v, y))], "id long, a double, b double, c double, d double, y double")
    grid = posterior.grid_posterior(df, "y", {"p": ["a", "b"], "q": ["c", "d"]}, [])
    assert grid[0]["columns"] == ("a", "d") and sum(g["probability"] for g in grid) == pytest.approx(1) and grid[0]["beta"] > 0.3
    cells = spark.createDataFrame([(1, 4.0, 1.0, 1.0), (1, 0.0, 9.0, 3.0)], "k long, gvi double, ndvi double, weight double")
    r = posterior.synergy_design(cells, "k", ["gvi", "ndvi"]).first()
    assert (r.gvi, r.ndvi, r.gvi_ndvi) == (1.0, 7.0, 0.5)
    records = spark.createDataFrame([("s", 0.1, 0.5, 0.4, 0.2, 0.6, True), ("s", 0.1, 0.5, 0.6, 0.55, 0.7, True), ("n", 0.0, 0.0, 0.1, -0.1, 0.2, False)], "scenario string, effect double, beta_true double, beta_mean double, beta_low double, beta_high double, excluded boolean")
    out = {(r.scenario, r.metric): r.value for r in posterior.recovery_summary(records).collect()}
    assert out == pytest.approx({("s", "power"): 1.0, ("s", "beta_bias"): 0.0, ("s", "beta_coverage"): 0.5, ("n", "false_positive_rate"): 0.0})


def test_study_chain(spark):
    rng = np.random.default_rng(9)
    n = 240
    xy = rng.uniform(0, 2000, (n, 2))
    target = spark.createDataFrame([(i, float(a), float(b), float(np.sin(a / 300) + rng.normal() * 0.2), float(rng.normal())) for i, (a, b) in enumerate(xy)], "id long, x double, y double, out double, z double")
    at = rng.uniform(0, 2000, (1500, 2))
    veg = spark.createDataFrame([(float(a), float(b), float(np.sin(a / 300))) for a, b in at], "mx double, my double, value double")
    noise = spark.createDataFrame([(float(a), float(b), float(rng.normal())) for a, b in at], "mx double, my double, value double")
    st, b = study.Study(target, "id", "out", ("z",), metrics={"veg": veg}, radii=(200.0, 400.0)).adopt({"ndvi": noise}).loaded()
    assert b[0] < 100 and st.validate_bounds(100.0) == {"veg": 1.0, "ndvi": 1.0} and st.coverage(400.0) == {"veg": 1.0, "ndvi": 1.0}
    train, held = st.prepared().split()
    assert train.wide.count() + held.wide.count() == train.all_rows(held).count() == n
    params, found = train.search(sweep_splits=3)
    assert found["candidates"] == 16 and params.weights[0] > 0.6 and params.columns[0].startswith("veg_")
    assert train.evaluate_on_test(held, params, predictions=True)["score"] > 0.5
    effects = {e["subset"]: e for e in train.evaluate_effects(held, params, 40, 19)}
    assert effects["test"]["low"] > 0.3 and effects["all"]["p"] == pytest.approx(0.05)
    assert held.paired_difference(params, train.single(params, 1), 30)["delta"] > 0.3
    assert train.retuned(["out"], params, sweep_splits=3)[0]["weight_distance"] < 1e-9
    assert st.sampled(target.select("id", "x", "y"), "id", 300.0).where("veg is not null").count() > n * 0.9
    with pytest.raises(ValueError):
        study.fill_missing({"veg": None}, {})
    assert study.fill_missing({"veg": None}, {"veg": lambda: veg})["veg"] is veg


def test_exports(spark, tmp_path):
    points = spark.createDataFrame([(1, 0, 1.0, 2.0, float("nan")), (2, 1, 3.0, 4.0, 5.0)], "id long, cluster_id long, x double, y double, v double")
    record = exports.write_points(points, str(tmp_path / "p"), "cluster_id", {"name": "a"})
    assert record == {"name": "a", "clusters": 2, "points": 2} and exports.read_record(spark, str(tmp_path / "p/record")) == record
    for kind in ("csv", "json", "geojson", "parquet"):
        exports.export_entities(points, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).where("v is null").count() == 1
    with pytest.raises(ValueError):
        exports.export_entities(points, str(tmp_path / "x"), "xlsx")
    small = exports.narrowed(points, ["id"])
    assert dict(small.dtypes) == {"id": "bigint", "cluster_id": "tinyint", "x": "float", "y": "float", "v": "float"}
    exports.write_tile(points.select("id"), str(tmp_path / "tiles"), "a", "k1")
    exports.write_tile(points.select("id"), str(tmp_path / "tiles"), "b", "k2")
    exports.write_tile(points.select("id").limit(1), str(tmp_path / "tiles"), "a", "k3")
    assert {(r.tile, r["count"]) for r in spark.read.parquet(str(tmp_path / "tiles")).groupBy("tile").count().collect()} == {("a", 1), ("b", 2)}
    tiles = spark.createDataFrame([("a", "k", 0.0, 0.0, 1.0, 1.0)], "tile string, content string, x0 double, y0 double, x1 double, y1 double")
    assert exports.record_tiles(exports.record_tiles(None, tiles), tiles.withColumn("content", F.lit("n"))).first().content == "n"


def test_read_gpkg_in_ranges(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "a.gpkg")
    with sqlite3.connect(path) as con:
        con.execute("create table gpkg_contents (table_name text)")
        con.execute("insert into gpkg_contents values ('l')")
        con.execute("create table l (fid integer primary key, name text, v real, geom blob)")
        wkb = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
        con.executemany("insert into l values (?, ?, ?, ?)", [(i, f"n{i}", i / 2, b"GP\0\1" + struct.pack("<i", 4326) + wkb) for i in range(1, 26)])
    out = tables.read_gpkg(spark, path, rows=10).orderBy("fid").collect()
    assert len(out) == 25 and bytes(out[3].geometry) == wkb and out[3].v == 2.0 and out[24].name == "n25"


def test_nearest_across_the_date_line(spark):
    points = spark.createDataFrame([(1, 10.0, 179.9999), (2, 10.0, -179.9999), (3, 10.0, 0.0)], "k long, lat double, lon double")
    panos = spark.createDataFrame([(7, 10.0, -179.9999), (8, 10.0, 0.0003)], "p long, plat double, plon double")
    from terraloom.operators import joins

    out = {r.k: (r.p, r.distance_m) for r in joins.haversine_nearest(points, panos, "k", "p", 50.0).collect()}
    assert out[1][0] == 7 and out[1][1] == pytest.approx(2e-4 * 111195 * math.cos(math.radians(10)), rel=0.01) and out[2][0] == 7 and out[3][0] == 8
