"""Functions against hand-worked values, NumPy and the standard library."""

import datetime
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import bands, composites, dates, geometry, kernels, tails, text


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("v")).first()[0]


def test_cells(spark):
    for row, col in ((0, 0), (-3, 5), (7, -9), (-(2**20), 2**20)):
        cell = one(spark, geometry.cell_id(F.lit(row), F.lit(col)))
        assert cell == int(np.int64(row) << np.int64(32) | np.int64(col) & np.int64(0xFFFFFFFF))
        back = geometry.cell_of_id(F.lit(cell))
        assert (one(spark, back[0]), one(spark, back[1])) == (row, col)
    assert one(spark, geometry.gap_to_cell(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(1), 10.0)) == 10.0
    assert one(spark, geometry.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(math.radians(1) * geometry.EARTH_M)
    assert one(spark, geometry.utm_epsg(F.lit(51.0), F.lit(-114.0))) == 32612
    east, north = geometry.utm_forward(F.lit(0.0), F.lit(3.0), F.lit(3.0))
    assert (one(spark, east), one(spark, north)) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    assert geometry.choose_grid(80, 81, 0, 1)["kind"] == "polar" and geometry.choose_grid(50, 51, 0, 1) == {"kind": "utm", "epsg": 32631} and geometry.choose_grid(30, 50, 0, 20)["kind"] == "lcc"
    tiles = one(spark, geometry.tiles_around(F.lit(51.0), F.lit(7.0), 50.0))
    x, y = geometry.slippy_tile(F.lit(51.0), F.lit(7.0))
    assert (one(spark, x), one(spark, y)) in [tuple(t) for t in tiles]


def test_kernels(spark):
    w = lambda d, *a, **k: one(spark, kernels.kernel_weight(F.lit(float(d)), *a, **k))
    assert [w(d, "linear", 100, 20) for d in (0, 20, 60, 100)] == [1, 1, 0.5, 0]
    assert w(35, "gaussian", 100, sigma=35) == pytest.approx(math.exp(-0.5)) and w(9, "none") == 1
    for bad in (("odd", 1), ("linear", 10, 20), ("gaussian", 10, 0, 0), ("uniform", 0)):
        with pytest.raises(ValueError):
            kernels.check_kernel(*bad)
    assert kernels.ladder_radii(100, 1000, step=300) == [100, 400, 700, 1000] and kernels.ladder_radii(100, 800, 4, log=True) == [100, 200, 400, 800]
    assert kernels.blend_quantiles(np.array([100.0]), np.array([1.0]), (0.25, 1.0)) == [pytest.approx(50), pytest.approx(100)]
    assert kernels.blend_weight(np.array([1.0, 2.0]), np.array([1.0, 1.0]), np.array([0.0, 1.5])).tolist() == [1.0, pytest.approx(0.2)]
    assert kernels.log_widths(np.array([1.0, math.e, math.e**2])).tolist() == [pytest.approx(0.5), pytest.approx(1), pytest.approx(0.5)]
    assert one(spark, kernels.thin_plate(F.lit(0.0))) == 0


def test_composites(spark):
    v = {"veg": F.lit(0.5), "terrain": F.lit(-1.0), "ndvi": F.lit(0.2)}
    assert one(spark, composites.composite("weighted_three", v, {"veg": 1, "ndvi": 3})) == pytest.approx((0.5 + 0.6) / 4)
    assert one(spark, composites.composite("weighted_three", v, {})) is None
    assert one(spark, composites.composite("synergy_three", v, {"veg_ndvi": 1, "veg_terrain": 1})) == pytest.approx(math.sqrt(0.1) / 2)
    assert composites.FORMULAS["synergy_three"].active({"veg_ndvi": 1.0}) == ("veg", "ndvi")
    assert composites.formula_for(("ndvi", "gvi"), "synergy") == "synergy_two"
    with pytest.raises(KeyError):
        composites.composite("none", v, {})
    for z in (-3.0, -0.5, 0.0, 1.7):
        assert one(spark, composites.normal_cdf(F.lit(z))) == pytest.approx(NormalDist().cdf(z), abs=2e-7)
    assert composites.resolve(["ID", "GVI_Veg"], "veg") == "GVI_Veg"
    with pytest.raises(ValueError):
        composites.resolve(["value"], "ndvi")


def test_bands(spark):
    nd = lambda a, b: one(spark, bands.normalized_difference(F.lit(a), F.lit(b)))
    assert nd(0.6, 0.2) == pytest.approx(0.5) and nd(0.0, 0.0) is None and nd(-0.1, 0.2) is None
    assert one(spark, bands.s2_surface(F.lit(6000), F.lit(2000), F.lit(8))) is None
    assert one(spark, bands.landsat_oli(F.lit(20000), F.lit(10000), F.lit(8))) is None
    assert one(spark, bands.mask_water(F.lit(1.0), F.lit(50.0))) is None and one(spark, bands.mask_water(F.lit(1.0), F.lit(None).cast("double"))) == 1
    assert one(spark, bands.class_share(F.array(F.lit(8), F.lit(9), F.lit(1), F.lit(8)), 8)) == 0.5


def test_dates(spark):
    p = lambda v: one(spark, dates.parse_date(F.lit(v)))
    assert p("2019-07-03") == datetime.datetime(2019, 7, 3) and p("2019-07") == datetime.datetime(2019, 7, 1) and p(2019.0) == datetime.datetime(2019, 1, 1)
    assert p("1400") is None and p("soon") is None
    m = lambda k, a, b: one(spark, dates.in_month_window(F.lit(k), a, b))
    assert m(1, 11, 2) and not m(6, 11, 2) and m(5, 5, 10)
    assert one(spark, dates.month_distance(F.lit(12), 11, 2)) == 0.5 and one(spark, dates.month_distance(F.lit(6), 11, 2)) == 5.5
    start, end = dates.query_window(F.lit("2012-06-01").cast("date"), F.lit("2012-08-31").cast("date"))
    assert (one(spark, start), one(spark, end)) == (datetime.date(2013, 6, 1), datetime.date(2013, 9, 1))
    assert one(spark, dates.overlaps_year(F.lit("2011-12-01").cast("date"), F.lit("2012-01-01").cast("date"), 2012)) is False
    assert tuple(one(spark, dates.year_month(F.lit("2019")))) == (2019, None)
    assert one(spark, dates.years_between(F.lit("2020-01-02 12:00:00").cast("timestamp"), F.lit("2020-01-01").cast("timestamp"))) == pytest.approx(1.5 / 365.25)


def test_text(spark):
    assert one(spark, text.safe_name(F.lit(" a b/c "))) == "a_b_c" and one(spark, text.format_p(F.lit(0.00001))) == "<0.0001"
    assert text.years_in_names(["a/x_2015.tif", "a/y_2018.tif", "b/z_2018.tif", "c/no.tif"]) == {"a/x_2015.tif": 2015}
    assert text.parse_reference("@ndvi.summer[median]") == ("ndvi", "summer", "median")
    with pytest.raises(ValueError):
        text.parse_reference("ndvi.summer")


def test_tails():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4) and tails.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-4)
    assert tails.chi2_upper(5.991, 2) == pytest.approx(0.05, abs=1e-4) and tails.chi2_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    low, high = tails.clopper_pearson(5, 20)
    assert (low, high) == (pytest.approx(0.0866, abs=1e-4), pytest.approx(0.4910, abs=1e-4))
    assert tails.clopper_pearson(0, 0) == (0.0, 1.0) and tails.stop_decision(0, 50, 20, 0.2, 0.3) == "below" and tails.stop_decision(1, 5, 20, 0.2, 0.3) is None
    assert tails.holm([0.01, None, 0.04, 0.03]) == [pytest.approx(0.03), None, pytest.approx(0.06), pytest.approx(0.06)]
    t, p = tails.corrected_t([1.0, 2.0, 3.0], 0.25)
    assert t == pytest.approx(2 / math.sqrt(1 / 3 + 1 / 3)) and 0 < p < 1
    rng = np.random.default_rng(0)
    low, high = tails.bca(0.0, rng.normal(size=4000), rng.normal(size=50))
    assert -2.5 < low < -1.4 and 1.4 < high < 2.5
