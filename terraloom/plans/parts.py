"""Registered queries of single functions: sources and sinks, names, scalars, cells of shapes, small statistics. Part of the catalogue, each with its SQL."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from terraloom.functions import composites, dates, geometry, kernels, tails, text
from terraloom.operators import exposure, gram, inference, joins, ladder, models, panel, reports, scoring, search, splits
from terraloom.plans import chains
from terraloom.sources import tables
from terraloom.sources.tables import table
from terraloom.sources.work import shared_folder

from .catalogue import CUST, DRAW, PANEL, PART, SQL, customers, lines, orders_panel, parts, query, r, rounded, rows, study, suppliers
from .studies import BOX, STUDY, _pair, boxes, scored, splits_of, sums


def folder(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def values(*data: tuple) -> str:
    """Rows of literals in SQL."""
    return ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v}" for v in t) + ")" for t in data)


# sources and sinks

FORMATS = (("a.geojson", "geojson", False), ("b.GPKG", "gpkg", False), ("c/d.parquet", "parquet", False), ("e.csv", "csv", False), ("f.tif", "raster", True))


@query(f"select * from (values {values(*FORMATS)}) t(path, format, raster)")
def path_formats(s, d):
    return s.createDataFrame([(p, tables.format_of(p), tables.is_raster(p)) for p, *_ in FORMATS], "path string, format string, raster boolean")


@query(f"with c as ({CUST}) select 'veg' as channel, '1996' as wave, x as mx, y as my, case when c_custkey % 9 <> 0 then c_acctbal end as value from c")
def aliased_metric(s, d):
    """A file's column found under an accepted name in any case, the only ones read being it and the places; NaN is missing."""
    path = folder(s, "layer") + ".parquet"
    customers(s, d, F.when(F.col("c_custkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("GVI_Veg"), F.lit("z").alias("other")).write.parquet(path)
    assert "GVI_Veg" in tables.field_names(s, path)
    return tables.metrics(s, {("veg", "1996"): path}).select("channel", "wave", "mx", "my", "value")


@query("select s_suppkey, 'csv' as origin, s_acctbal from supplier union all select s_suppkey, 'parquet', s_acctbal from supplier")
def merged_layers(s, d):
    """Layers of several formats, read and merged by name."""
    at, t = folder(s, "layers"), table(s, d, "supplier").select("s_suppkey", "s_acctbal")
    t.write.option("header", True).csv(f"{at}/a.csv")
    t.write.parquet(f"{at}/b.parquet")
    read = tables.read_many(s, [f"{at}/a.csv", f"{at}/b.parquet"])
    return tables.merge([read["a"].withColumn("origin", F.lit("csv")), read["b"].withColumn("origin", F.lit("parquet"))]).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "origin", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("with h as (select sha256(n_name) as h from nation), l as (select count(*)::varchar || ',' || " + " || ',' || ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::ubigint)::varchar" for i in range(8)) + " as t from h) select sha256(t) as digest from l")
def geometry_digest(s, d):
    """Digest of a layer's geometries whatever their order."""
    return tables.geometry_digest(table(s, d, "nation").select(F.col("n_name").alias("geometry")).orderBy(F.desc("n_name")))


@query("select 'p' || s_suppkey as path, case when s_suppkey % 4 = 0 then 'missing' when s_suppkey % 4 = 1 then 'new' when s_suppkey % 4 = 2 then 'modified' else 'ok' end as status from supplier")
def path_drift(s, d):
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select(F.concat(F.lit("p"), k.cast("string")).alias("path"), (k % 4).alias("m"), k.cast("string").alias("fingerprint"))
    now = p.where("m <> 0").select("path", F.when(F.col("m") == 2, F.concat("fingerprint", F.lit("x"))).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return tables.drift(now, p.where("m <> 1").select("path", "fingerprint"))


@query("select 3 as files, true as sized")
def file_fingerprints(s, d):
    """Size and time of each file of a folder."""
    at = folder(s, "files")
    table(s, d, "nation").repartition(3).write.parquet(at)
    out = tables.fingerprints(s, at).where(F.col("path").contains("part-"))
    return out.agg(F.count("*").cast("int").alias("files"), F.min(F.col("fingerprint").rlike(r"^\d+:\d+$")).alias("sized"))


@query("select c_custkey, c_acctbal, o as composite from customer left join (select o_custkey, count(*) as o from orders where o_orderstatus = 'F' group by 1) on o_custkey = c_custkey")
def entity_table(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("composite"))
    return tables.entity_table(table(s, d, "customer").select("c_custkey", "c_acctbal"), o, "c_custkey")


@query("select o_orderkey % 4 as shard, count(*) as n, round(sum(o_totalprice),2) as total from orders group by 1")
def shard_round_trip(s, d):
    at = folder(s, "shards")
    tables.write_shards(table(s, d, "orders").select("o_totalprice", (F.col("o_orderkey") % 4).alias("shard")), at)
    return tables.read_shards(s, at, 4).groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_orderstatus as unit, count(*) as n, round(sum(case when o_orderstatus = 'F' then 2 else 1 end * o_totalprice),2) as total from orders group by 1")
def persisted_units(s, d):
    """Statistics by unit; a unit that is written again takes the place of its own rows alone."""
    at, o = folder(s, "units"), table(s, d, "orders").select(F.col("o_orderstatus").alias("unit"), "o_totalprice")
    tables.persist_unit(o, at, ["unit"])
    tables.persist_unit(o.where("unit = 'F'").withColumn("o_totalprice", 2 * F.col("o_totalprice")), at, ["unit"])
    return s.read.parquet(at).groupBy("unit").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


# schema shaping


@query("select l_orderkey, l_linenumber, case when l_quantity > 40 then null else l_quantity end as finite from lineitem where l_discount > 0 and l_quantity <= 45")
def finite_values(s, d):
    """Rows without NaN or infinite values in some columns, and such values of another as null."""
    bad = F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(F.lit(float("nan")))
    x = lines(s, d).withColumns({"a": bad, "b": F.when(F.col("l_quantity") <= 45, F.lit(1.0)).otherwise(F.lit(float("inf"))), "c": F.when(F.col("l_quantity") > 40, F.lit(float("nan"))).otherwise(F.col("l_quantity"))})
    return panel.complete(x, ["a", "b"]).select("l_orderkey", "l_linenumber", ladder.finite(F.col("c")).alias("finite"))


@query("select p_partkey, round((p_size-(select min(p_size) from part))/((select max(p_size) from part)-(select min(p_size) from part))::double,6) as scaled, 0.0::double as flat from part")
def min_max_scaled(s, d):
    p = table(s, d, "part")
    b = p.agg(F.min("p_size").cast("double").alias("a"), F.max("p_size").cast("double").alias("b")).first()
    v = F.col("p_size").cast("double")
    return p.select("p_partkey", r(composites.min_max(v, F.lit(b.a), F.lit(b.b))).alias("scaled"), composites.min_max(v, F.lit(1.0), F.lit(1.0)).alias("flat"))


REGISTRY = [(f"{form}_{label}", label, form, key) for label, cs in (("three", ("veg", "terrain", "ndvi")), ("two", ("gvi", "ndvi"))) for form in ("weighted", "synergy", "percentile") for key in (cs if form == "weighted" else ["_".join(t) for t in composites.terms(cs)])]


@query(f"select formula, weight, active from (values {values(*((f, k, '|'.join(c for c in composites.CHANNEL_SETS[lab] if c in k.split('_'))) for f, lab, _, k in REGISTRY))}) t(formula, weight, active)")
def formula_registry(s, d):
    """Formulas, the weights each takes, and the channels that a formula reads when that weight alone is positive."""
    out = [(name, k, "|".join(f.active({k: 1.0}))) for name, f in composites.FORMULAS.items() for k in f.keys()]
    assert all(composites.formula_for(f.channels, f.form) == n for n, f in composites.FORMULAS.items())
    return s.createDataFrame(out, "formula string, weight string, active string")


@query("select o_orderkey, case when o_orderstatus = 'F' then 0.0::double else 1 end as event from orders where o_orderstatus in ('F', 'O')")
def binary_outcome(s, d):
    return panel.as_binary(table(s, d, "orders").where("o_orderstatus in ('F', 'O')").select("o_orderkey", "o_orderstatus"), "o_orderstatus").select("o_orderkey", F.col("o_orderstatus").alias("event"))


@query(f"with p as ({PANEL}) select o_custkey, round(value,4) as value, " + ", ".join(f"case when year = {y} then 1.0::double else 0 end as year_{y}" for y in range(1996, 2002)) + " from p")
def period_controls(s, d):
    """Indicators of waves; time, which they span, goes."""
    p = panel.period_controls(orders_panel(s, d), "year", years="t")
    return p.select("o_custkey", r("value", 4).alias("value"), *(f"year_{y}" for y in range(1996, 2002)))


@query("select o_custkey as entity_id, cast(year(o_orderdate) as varchar) as wave, o_totalprice as outcome, o_orderkey from orders where year(o_orderdate) in (1994, 1996) and o_orderkey % 3 <> 0")
def dated_panel(s, d):
    """One dated table as a panel tagged by calendar year; rows without an outcome go."""
    o = table(s, d, "orders").withColumn("y", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")))
    return panel.from_dates(o, "o_custkey", "y", "o_orderdate", ["o_orderkey"], ["1994", "1996"]).select("entity_id", "wave", "outcome", "o_orderkey")


# cells of shapes


@query(f"with b as ({BOX}) select s_suppkey, row, col, 1.0::double as weight from (select *, unnest(generate_series(cast(floor(x0/100) as bigint), cast(floor(x1/100) as bigint))) as col from (select *, unnest(generate_series(cast(floor(-y1/100) as bigint), cast(floor(-y0/100) as bigint))) as row from b))")
def polygon_cells(s, d):
    """Cells that a polygon shares an interior with."""
    return rounded(exposure.shape_cells(boxes(s, d), "s_suppkey", 100.0).select("s_suppkey", "row", "col", "weight"))


@query(f"with b as ({BOX}) select s_suppkey, cast(floor(-y0/100) as bigint) as row, unnest(generate_series(cast(floor(x0/100) as bigint), cast(floor((x0+430)/100) as bigint))) as col, 1.0::double as weight from b")
def line_cells(s, d):
    """Cells that a line goes through, once a pass."""
    at = lambda dx: F.struct((F.col("mx") + 3.5 + dx).alias("x"), (F.col("my") + 7.25).alias("y"))
    ls = suppliers(s, d).select("s_suppkey", F.lit("line").alias("kind"), F.array(at(0.0), at(200.0), at(430.0)).alias("xy"))
    return rounded(exposure.shape_cells(ls, "s_suppkey", 100.0).select("s_suppkey", "row", "col", "weight"))


@query("select c_custkey, cast(floor((lon+180)/360*131072) as bigint) as tx, cast(floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/pi())/2*131072) as bigint) as ty from (select c_custkey, c_custkey % 120 - 60 + 0.123 as lat, c_custkey % 340 - 170 + 0.456 as lon from customer)")
def slippy_tiles(s, d):
    c = table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 120 - 60 + 0.123).alias("lat"), (F.col("c_custkey") % 340 - 170 + 0.456).alias("lon"))
    x, y = geometry.slippy_tile(F.col("lat"), F.col("lon"))
    around = geometry.tiles_around(F.col("lat"), F.col("lon"), 1.0)
    return c.where(F.exists(around, lambda t: (t["tx"] == x) & (t["ty"] == y))).select("c_custkey", x.alias("tx"), y.alias("ty"))


@query(f"with c as ({CUST}), p as ({PART}), a as (select c_custkey, quantile_cont(p_retailprice, 0.9) as v from c, p where sqrt((x-mx)*(x-mx)+(y-my)*(y-my)) <= 200 group by 1) select c.c_custkey, round(v,4) as value from customer c left join a using (c_custkey)")
def stored_lookup(s, d):
    """One channel, radius and statistic of a long store for each row of a plan."""
    store = ladder.disc_stats(customers(s, d), parts(s, d), "c_custkey", "p_retailprice", [100.0, 200.0]).withColumns({"channel": F.lit("veg"), "radius": F.col("radius").cast("int")})
    return rounded(joins.lookup(table(s, d, "customer").select("c_custkey"), store, ["c_custkey"], "veg", 200, ladder.stat_column("percentile", 90)), 4)


STATS = (("mean", None, "mean"), ("median", None, "p50"), ("percentile", 10, "p10"), ("percentile", 90, "p90"), ("percentile", 33, None), ("mode", None, None))


@query(f"select * from (values {values(*STATS)}) t(stat, percentile, stored)")
def stored_columns(s, d):
    return s.createDataFrame([(a, b, ladder.stat_column(a, b)) for a, b, _ in STATS], "stat string, percentile int, stored string")


# small statistics


@query("select s_suppkey % 3 as kind, count(*) as n, count(*) filter ((s_suppkey*7919 % 1000) < 50) as hits, case when count(*) filter ((s_suppkey*7919 % 1000) < 50) > 0 then 0.025::double else 1 end as at_low, 0.025::double as at_high from (select distinct l_suppkey as s_suppkey from lineitem) group by 1")
def exact_interval_tails(s, d):
    """The exact interval of a share of nulls, held against its definition: at either end the binomial tail is a fortieth."""
    k = F.col("l_suppkey")
    p = lines(s, d).select("l_suppkey").distinct().select((k % 3).alias("kind"), ((k * 7919 % 1000) / 1000.0).alias("p"))
    out = []
    for x in reports.null_summary(p, ["kind"], "p").collect():  # three kinds
        upper = tails.binomial_tail(x.hits, x.n, x.low)
        lower = tails.binomial_tail(x.n - x.hits, x.n, 1 - x.high)  # as many hits at most: as many misses at least
        out.append((x.kind, x.n, x.hits, round(float(upper), 6), round(float(lower), 6)))
    return s.createDataFrame(out, "kind long, n long, hits long, at_low double, at_high double")


STOPS = ((0, 3, 5, None), (0, 100, 5, "below"), (50, 100, 5, "above"), (5, 100, 5, None))


@query(f"select * from (values {values(*STOPS)}) t(hits, n, after, decision)")
def stop_decisions(s, d):
    return s.createDataFrame([(h, n, a, tails.stop_decision(h, n, a, 0.04, 0.06)) for h, n, a, _ in STOPS], "hits int, n int, after int, decision string")


@query("select s_suppkey, case when p is not null then p < 0.05 when low is not null then low > 0 or high < 0 end as holds from (select s_suppkey, case when s_suppkey % 3 = 0 then (s_suppkey % 10)/100.0 end as p, case when s_suppkey % 3 = 1 then s_suppkey % 5 - 2 end as low, case when s_suppkey % 3 = 1 then s_suppkey % 5 - 1 end as high from supplier)")
def holding_results(s, d):
    k = F.col("s_suppkey")
    x = table(s, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, (k % 10) / 100.0).alias("p"), F.when(k % 3 == 1, k % 5 - 2).alias("low"), F.when(k % 3 == 1, k % 5 - 1).alias("high"))
    return x.select("s_suppkey", inference.holds(F.col("p"), F.col("low"), F.col("high")).alias("holds"))


@query("with x as (select l_quantity as a, l_tax*100 as b, l_quantity + l_tax*100 + l_linenumber/4.0 as c from lineitem), k as (select corr(c,a) as ca, corr(c,b) as cb, corr(a,b) as ab from x), v as (select 1/(1-(ca*ca+cb*cb-2*ca*cb*ab)/(1-ab*ab)) as vif from k) select case when vif > 10 then 'c' end as gone, round(vif,4) as vif from v")
def vif_reduction(s, d):
    """The worst of inflated columns goes until none is over the threshold."""
    x = lines(s, d).select(F.col("l_quantity").alias("a"), (F.col("l_tax") * 100).alias("b"), (F.col("l_quantity") + F.col("l_tax") * 100 + F.col("l_linenumber") / 4.0).alias("c"))
    left, gone = gram.reduce_vif(gram.gram(x, ["a", "b", "c"]), ["a", "b", "c"])
    assert left == ["a", "b"]
    return rounded(s.createDataFrame([(c, float(v)) for c, v in gone], "gone string, vif double"), 4)


@query("select delta, case when abs(delta) < 2 then 'none' else (case when abs(delta) < 6 then 'positive' when abs(delta) < 10 then 'strong' else 'very strong' end) || ' for ' || (case when delta > 0 then 'the second' else 'the first' end) end as verdict from (select unnest([-12.0, -7.0, -3.0, 0.0, 1.9, 2.0, 6.0, 30.0])::double as delta)")
def evidence_bands(s, d):
    return s.createDataFrame([(v, gram.verdict(v)) for v in (-12.0, -7.0, -3.0, 0.0, 1.9, 2.0, 6.0, 30.0)], "delta double, verdict string")


@query("select l_orderkey, l_linenumber, round(l_extendedprice - (select regr_intercept(l_extendedprice,l_quantity) from lineitem) - (select regr_slope(l_extendedprice,l_quantity) from lineitem)*l_quantity, 3) as residual from lineitem")
def residual_column(s, d):
    return rounded(scoring.residual_column(lines(s, d), "l_extendedprice", ["l_quantity"], "residual").select("l_orderkey", "l_linenumber", "residual"), 3)


@query("select 'r2' as metric, round(pow(corr(l_extendedprice,l_quantity),2),6) as score from lineitem union all " + "select 'mutual_info', * from (" + SQL["mutual_info_deciles"] + ") union all select 'nrmse', * from (" + SQL["nrmse_score"] + ")")
def score_registry(s, d):
    """Scores by name, through the one registry."""
    return rows(s, [(m, float(scoring.score(m, lines(s, d), "l_extendedprice", "l_quantity"))) for m in ("r2", "mutual_info", "nrmse")], "metric string, score double")


@query("with c as (select c_nationkey as k, avg(c_acctbal) as v from customer group by 1), p as (select a.k as i, b.k as j, abs(a.v-b.v) as d from c a, c b), n as (select count(*)::double as n from c) select i, j, round(d,4) as d, round(case when i = j then 0 else d - sum(d) over (partition by i)/(n-2) - sum(d) over (partition by j)/(n-2) + sum(d) over ()/((n-1)*(n-2)) end,4) as u from p, n")
def centred_distances(s, d):
    """Distances of nations' means, and the same U-centred."""
    c = table(s, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v")).orderBy("c_nationkey").collect()  # one row a nation
    m = scoring.distances(np.array([x.v for x in c]))
    u = scoring.u_centre(m)
    k = [x.c_nationkey for x in c]
    return rounded(s.createDataFrame([(k[i], k[j], float(m[i, j]), float(u[i, j])) for i in range(len(k)) for j in range(len(k))], "i int, j int, d double, u double"), 4)


def _beta(y: str) -> str:
    part = lambda a, b: f"({sums(a, b)} - {sums(a, 'c_acctbal')}*{sums(b, 'c_acctbal')}/{sums('c_acctbal', 'c_acctbal')})"
    return f"{part(y, 'price')}/sqrt({part('price', 'price')}*{part(y, y)})"


@query(f"with s as ({STUDY}), b as (" + " union all ".join(f"select '{y}' as outcome, {_beta(y)} as b, count(*) as n from s" for y in ("y_out", "orders", "low_200")) + ") select outcome, round(b,6) as beta, round(sqrt((1-b*b)/(n-3)),6) as se from b")
def transfer_outcomes(s, d):
    """A frozen exposure against its target and each control outcome."""
    out = inference.transfer_test(study(s, d), "y_out", ["orders", "low_200"], "price", ["c_acctbal"])
    return rows(s, [(o["outcome"], float(o["beta"]), float(o["se"])) for o in out], "outcome string, beta double, se double")


@query("select 0.3::double as radius, 0.5::double as statistic")
def tuning_concordance(s, d):
    f = search.concordance(np.array([100.0, 200.0, 400.0]), {"radius": np.array([0.2, 0.3, 0.5]), "statistic": np.array([0.9, 0.1])}, {"radius": np.array([0.5, 0.3, 0.2]), "statistic": np.array([0.4, 0.6])})
    return rows(s, [(f["radius"], f["statistic"])], "radius double, statistic double")


_HELD = DRAW.format("c_custkey", 0)


@query(f"with s as (select *, {_HELD} < 0.25 as test from ({STUDY})), a as (select regr_slope(y_out, price) as whole from s), h as (select regr_slope(y_out, price) as b, sqrt((regr_syy(y_out,price)-pow(regr_sxy(y_out,price),2)/regr_sxx(y_out,price))/(count(*)-2)/regr_sxx(y_out,price)) as se from s where test) select round(whole,6) as estimate, round(b,6) as held_out, round(se,6) as se, round(2.8*se,6) as least_detectable from a, h")
def split_estimates(s, d):
    """The estimate of all rows with the held-out ones' error."""
    x = splits.grouped_holdout(study(s, d), "c_custkey", 0.25)
    fit = lambda t: gram.raw_slope(gram.gram(t, ["price", "y_out"]), "y_out", "price", [])
    f = inference.split_inference(fit(x), fit(x.where("test")))
    return rows(s, [(f["estimate"], f["held_out"], f["se"], f["least_detectable"])], "estimate double, held_out double, se double, least_detectable double")


@query(
    f"with s as ({STUDY}), f as (select regr_slope(y_out, price) as b, regr_intercept(y_out, price) as a, regr_sxx(y_out, price) as sxx, avg(price) as m, count(*) as n from s), c as (select c_nationkey, sum(y_out-a-b*price) as u, sum((price-m)*(y_out-a-b*price)) as v from s, f group by 1), g as (select count(*) as g, sum(v*v) as vv, sum(u*u) as uu, sum(u*v) as uv from c) select 'price' as term, round(b,6) as beta, round(sqrt(vv/(sxx*sxx)*g/(g-1)*(n-1)/(n-2)),6) as se from f, g union all select '1', round(a,6), round(sqrt((uu/(n*n) + m*m*vv/(sxx*sxx) - 2*m*uv/(n*sxx))*g/(g-1)*(n-1)/(n-2)),6) from f, g"
)
def ols_by_cluster(s, d):
    """Least squares with errors by cluster, through the fitter that every report takes."""
    f = models.make_fitter(study(s, d), "y_out", "ols", "c_nationkey")(["price"])
    return rows(s, list(zip(f["names"], map(float, f["beta"]), map(float, f["se"]))), "term string, beta double, se double")


@query(f"with s as ({STUDY}), q as ({splits_of('s', 4)}), {scored(_pair('price', 'low_200', 'q').replace('from (q)', 'from q'))}, m as (select 'mean' as form, avg(r_a*sqrt((n-3)/(1-r_a*r_a))) as held from t union all select 'least', avg(r_b*sqrt((n-3)/(1-r_b*r_b))) from t) select form, round(held,5) as held, held = (select max(held) from m) as chosen from m")
def chosen_form(s, d):
    """The form of an index with the best mean held-out t."""
    best, means = search.choose_form(study(s, d), "y_out", {"mean": ["price"], "least": ["low_200"]}, ["c_acctbal"], "c_custkey", 4)
    return rounded(s.createDataFrame([(k, float(v), k == best) for k, v in means.items()], "form string, held double, chosen boolean"), 5)


# scalars


@query("select o_orderkey, strftime(cast(o_orderdate as date), '%Y') as wave, cast(o_orderdate as date) < date '1997-01-01' and cast(o_orderdate as date) + 60 > date '1996-01-01' as reaches, cast(case when year(o_orderdate) = 1996 and year(cast(o_orderdate as date) + 60) = 1996 then cast(o_orderdate as date) + interval 12 month else cast(o_orderdate as date) end as date) as start, strftime(cast(o_orderdate as date), '%Y-%m') as month from orders")
def date_scalars(s, d):
    a = F.to_date("o_orderdate")
    start, _ = dates.query_window(a, F.date_add(a, 60), 1996, 1997)
    return table(s, d, "orders").select("o_orderkey", dates.wave_label(a).alias("wave"), dates.overlaps_year(a, F.date_add(a, 60), 1996).alias("reaches"), start.alias("start"), dates.format_year_month(F.year(a), F.month(a)).alias("month"))


@query("select c_custkey, regexp_replace(trim(c_name || ' / ' || c_mktsegment), '[^A-Za-z0-9._-]+', '_', 'g') as safe, case when c_custkey % 50 = 0 then '' when (c_custkey % 50)/1e6 < 1e-4 and c_custkey % 2 = 0 then '<0.0001' else printf('%.4f', case when c_custkey % 2 = 0 then (c_custkey % 50)/1e6 else (c_custkey % 50)/100.0::double end) end as p, length(c_name) > 22 or regexp_matches(c_name, '^(AF1Q|CIHM|CIAB)') as third_party from customer")
def text_scalars(s, d):
    k = F.col("c_custkey")
    p = F.when(k % 50 == 0, F.lit(None).cast("double")).otherwise(F.when(k % 2 == 0, (k % 50) / 1e6).otherwise((k % 50) / 100.0))
    return table(s, d, "customer").select("c_custkey", text.safe_name(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("safe"), text.format_p(p).alias("p"), text.third_party_id(F.col("c_name")).alias("third_party"))


@query("select c_custkey, round(111132.92-559.82*cos(2*p)+1.175*cos(4*p)-0.0023*cos(6*p),4) as lat_m, round(111412.84*cos(p)-93.5*cos(3*p)+0.118*cos(5*p),4) as lon_m, cast(case when lat >= 0 then 32600 else 32700 end + cast(floor((lon+180)/6) as integer) % 60 + 1 as integer) as epsg, case when p > 0 then round(p*p*ln(p),9) else 0 end as tps from (select c_custkey, lat, lon, radians(lat) as p from (select c_custkey, (c_custkey % 140 - 70)::double as lat, c_custkey % 350 - 175 + 0.5 as lon from customer))")
def place_scalars(s, d):
    c = table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 140 - 70).cast("double").alias("lat"), (F.col("c_custkey") % 350 - 175 + 0.5).alias("lon"))
    a, b = geometry.metres_per_degree(F.col("lat"))
    return c.select("c_custkey", r(a, 4).alias("lat_m"), r(b, 4).alias("lon_m"), geometry.utm_epsg(F.col("lat"), F.col("lon")).cast("int").alias("epsg"), r(kernels.thin_plate(F.greatest(F.radians("lat"), F.lit(0.0))), 9).alias("tps"))


@query("select s_suppkey, case when s_suppkey % 4 = 0 then 'no_panorama' when s_suppkey % 4 = 1 then 'failed' when s_suppkey % 4 = 2 then 'no_capture_in_window' else 'sampled' end as outcome from supplier")
def sampling_outcomes(s, d):
    k = F.col("s_suppkey") % 4
    return table(s, d, "supplier").select("s_suppkey", joins.sampling_outcome(k != 0, k != 1, k != 2).alias("outcome"))


CHAINS = "# a comment\nsmooth = focal:mean:2 > temporal:median\ndry = water_mask > temporal:max"
LINES = (("smooth", "focal:mean:2 > temporal:median", 2, None), ("dry", "water_mask > temporal:max", 0, None), ("mean", "temporal:mean", 0, "mean"))


@query(f"select * from (values {values(*LINES)}) t(name, steps, radius, statistic)")
def chain_grammar(s, d):
    """Chains parsed and written again, with their widest focal radius and the plain statistic that they amount to."""
    found = [*chains.parse_lines(CHAINS), chains.statistic_chain("mean")]
    again = chains.parse_lines(chains.format_lines(found))
    return s.createDataFrame([(c.name, c.text().split(" = ")[1], c.radius, c.statistic) for c in again], "name string, steps string, radius int, statistic string")


RUN = {"steps": {"ndvi": {"engine": "ndvi"}, "gvi": {"engine": "gvi"}, "fuse": {"engine": "fusion", "a": "@gvi.gvi[mean]", "b": ["@ndvi.ndvi"]}, "map": {"engine": "map", "after": ["fuse"]}}}


@query("select * from (values ('ndvi', 0), ('gvi', 0), ('fuse', 1), ('map', 2)) t(step, level)")
def run_levels(s, d):
    """Steps of a run by the longest way to them, from their references."""
    return s.createDataFrame(list(chains.levels(chains.load_run(json.dumps(RUN))).items()), "step string, level int")


NAMES = ("a_2019.tif", "b-2020-x.tif", "c_2020.tif", "d_2018_2019.tif", "e.tif")


@query("select 'a_2019.tif' as path, 2019 as year")
def years_of_names(s, d):
    """The year of each file whose name alone has it."""
    return s.createDataFrame(list(text.years_in_names(list(NAMES)).items()), "path string, year int")


@query("with r as (select unnest(generate_series(100, 500, 100))::double as r), x as (select r, ln(r) as x, row_number() over (order by r) as k, count(*) over () as n, lag(ln(r)) over (order by r) as a, lead(ln(r)) over (order by r) as b from r) select cast(r as integer) as radius, round(coalesce((x+b)/2, x) - coalesce((a+x)/2, x),6) as width from x")
def ladder_widths(s, d):
    """Radii of a ladder and their widths in the logarithm."""
    radii = kernels.ladder_radii(100, 500, step=100)
    return rounded(s.createDataFrame(list(zip(radii, map(float, kernels.log_widths(np.array(radii))))), "radius int, width double"))


@query("with g as (select c_nationkey, avg(x) as x, avg(y) as y from (select c_nationkey, (c_custkey*7919)%10007 as x, (c_custkey*104729)%10007 as y from customer) group by 1), b as (select c_nationkey, cast(floor((x-min(x) over ())/1000) as bigint) as ix, cast(floor((y-min(y) over ())/1000) as bigint) as iy from g) select c_nationkey, cast(dense_rank() over (order by iy, ix) - 1 as integer) as block from b")
def group_blocks(s, d):
    """Block of each group by the middle of its points."""
    c = customers(s, d, "c_nationkey").select("c_nationkey", "x", "y")
    return splits.group_blocks(c, "c_nationkey", 1000.0).select("c_nationkey", "block")


@query("with x as (select corr(a, b) as r, count(*) as n from (select l_quantity as a, l_extendedprice as b from lineitem)) select round(abs(r)*sqrt((n-2)/(1-r*r)),3) as t from x")
def correlation_t(s, d):
    g = gram.gram(lines(s, d), ["l_quantity", "l_extendedprice"])
    return rounded(rows(s, [(float(search.t_of_r(gram.correlations(g)[0][2], g.n)),)], "t double"), 3)


# the same in SQL of queries that are registered elsewhere

SQL["component_report"] = SQL["merged_components"]
SQL["shard_crc32"] = (
    f"with c as (select c_custkey, '0:' || cast(floor(floor(y/50)/64) as bigint) || ':' || cast(floor(floor(x/50)/64) as bigint) as name from ({CUST})) "
    "select c_custkey, cast(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(name)+1), lambda i: ascii(substr(name, i, 1))::bigint)), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384::bigint * (v & 1)))), 4294967295::bigint) % 3 as integer) as shard from c"
)
SQL["area_balanced_split"] = (
    "with recursive q as (select quantile_cont(p_retailprice, [0.2,0.4,0.6,0.8]) as c from part), b as (select p_partkey, p_size::double as area, len(list_filter(list_distinct(c), lambda e: p_retailprice > e)) as bin from part, q), "
    "o as (select *, row_number() over (partition by bin order by area desc, p_partkey) as k, sum(area) over (partition by bin) as total from b), "
    "r as (select bin, k, p_partkey, area as h1, 0.0::double as h2, 0.0::double as h3, 1 as pick from o where k = 1 union all select bin, k, p_partkey, h1 + case when pick = 1 then area else 0 end, h2 + case when pick = 2 then area else 0 end, h3 + case when pick = 3 then area else 0 end, pick from "
    "(select o.bin, o.k, o.p_partkey, o.area, r.h1, r.h2, r.h3, case when 0.6*total-h1 >= 0.2*total-h2 and 0.6*total-h1 >= 0.2*total-h3 then 1 when 0.2*total-h2 >= 0.2*total-h3 then 2 else 3 end as pick from r join o on o.bin = r.bin and o.k = r.k + 1)) "
    "select p_partkey, ['train','val','test'][pick] as split from r"
)


def _tail(first: str, last: str, p: str) -> str:
    """Probability of `first` to `last` hits of n."""
    return f"list_sum(list_transform(range({first}, {last} + 1), lambda i: exp(lgamma(n+1)-lgamma(i+1)-lgamma(n-i+1)+i*ln({p})+(n-i)*ln(1-{p}))))"


SQL["null_summary"] = (
    "with recursive k as (select s % 3 as kind, count(*) as n, count(*) filter ((s*7919 % 1000) < 50) as hits from (select distinct l_suppkey as s from lineitem) group by 1), "
    f"b as (select kind, n, hits, 0 as step, 0.0::double as l0, 1.0::double as l1, 0.0::double as h0, 1.0::double as h1 from k union all select kind, n, hits, step+1, case when tl < 0.025 then (l0+l1)/2 else l0 end, case when tl < 0.025 then l1 else (l0+l1)/2 end, case when th > 0.025 then (h0+h1)/2 else h0 end, case when th > 0.025 then h1 else (h0+h1)/2 end from (select *, {_tail('hits', 'n', '((l0+l1)/2)')} as tl, {_tail('0', 'hits', '((h0+h1)/2)')} as th from b where step < 50)) "
    "select kind, n, hits, round(hits/n::double,6) as rate, case when hits = 0 then 0 else round(l0,6) end as low, case when hits = n then 1 else round(h0,6) end as high from b where step = 50"
)


def _gee(source: str, first: int, rounds: int) -> str:
    """Marginal logistic model of y on one column a by entity: rounds of ordinary weights first, then rounds with the exchangeable correlation."""
    out = f"z as (select o_custkey as e, cast(value > 150 as integer)::double as y, (t - avg(t) over ())/stddev_pop(t) over () as a from {source}), u as (select avg(t) as mean, stddev_pop(t) as sd from {source}), b0 as (select 0.0::double as p, 0.0::double as q)"
    mu = "least(greatest(1/(1+exp(-(p+q*a))), 1e-8), 1-1e-8)"
    for i in range(first + rounds):
        alpha = "0.0::double" if i < first else "least(greatest(crossed/greatest(pairs-2,1)/phi, -1/greatest(most-1,1)+1e-6), 0.99)"
        out += (
            f", m{i} as (select e, y, a, mu, sqrt(mu*(1-mu)) as w from (select e, y, a, {mu} as mu from z, b{i}))"
            f", n{i} as (select e, count(*) as m, sum((y-mu)/w) as r, sum(pow((y-mu)/w,2)) as rr, sum(w) as d0, sum(w*a) as d1, sum(y-mu) as e0, sum(a*(y-mu)) as e1, sum(w*w) as a00, sum(w*w*a) as a01, sum(w*w*a*a) as a11 from m{i} group by 1)"
            f", t{i} as (select {alpha} as alpha from (select sum(rr)/(sum(m)-2) as phi, sum((r*r-rr)/2) as crossed, sum(m*(m-1)/2) as pairs, max(m) as most from n{i}))"
            f", s{i} as (select *, (e0-k*d0*r)/(1-alpha) as s0, (e1-k*d1*r)/(1-alpha) as s1 from (select n{i}.*, alpha, alpha/(1+(m-1)*alpha) as k from n{i}, t{i}))"
            f", g{i} as (select sum(s0) as s0, sum(s1) as s1, sum((a00-k*d0*d0)/(1-alpha)) as b00, sum((a01-k*d0*d1)/(1-alpha)) as b01, sum((a11-k*d1*d1)/(1-alpha)) as b11, sum(s0*s0) as m00, sum(s0*s1) as m01, sum(s1*s1) as m11, max(alpha) as alpha from s{i})"
            f", b{i + 1} as (select p + (b11*s0-b01*s1)/(b00*b11-b01*b01) as p, q + (b00*s1-b01*s0)/(b00*b11-b01*b01) as q from b{i}, g{i})"
        )
    return out


_LAST = 17
SQL["gee_fit"] = (
    f"with x as ({PANEL}), {_gee('x', 8, _LAST - 7)}, i as (select b11/d as i00, -b01/d as i01, b00/d as i11, m00, m01, m11, alpha from (select *, b00*b11-b01*b01 as d from g{_LAST})), "
    "c as (select i00*(i00*m00+i01*m01)+i01*(i00*m01+i01*m11) as c00, i01*(i00*m00+i01*m01)+i11*(i00*m01+i01*m11) as c01, i01*(i01*m00+i11*m01)+i11*(i01*m01+i11*m11) as c11, alpha from i) "
    f"select '1' as term, round(p-q*mean/sd,6) as beta, round(sqrt(c00-2*mean/sd*c01+pow(mean/sd,2)*c11),6) as se, round(alpha,6) as alpha from b{_LAST + 1}, u, c union all select 't', round(q/sd,6), round(sqrt(c11)/sd,6), round(alpha,6) from b{_LAST + 1}, u, c"
)

# group means beside a control, with errors by cluster from each cluster's share in every coefficient
SQL["quartile_terms"] = (
    f"with s as ({STUDY}), q as (select quantile_cont(price, [0.25,0.5,0.75]) as c from s), g as (select c_nationkey as cl, y_out as y, c_acctbal as z, len(list_filter(list_distinct(c), lambda v: price >= v)) as k from s, q), "
    "m as (select k, avg(y) as my, avg(z) as mz, count(*) as n from g group by 1), w as (select sum((z-mz)*(y-my))/sum((z-mz)*(z-mz)) as b, sum((z-mz)*(z-mz)) as szz from g join m using (k)), "
    "e as (select cl, k, mz, n, z, y - (my - b*mz) - b*z as e from g join m using (k), w), "
    "u as (select cl, sum((z-mz)*e)/max(szz) as uc, " + ", ".join(f"sum(case when k = {k} then e/n else 0 end) as u{k}" for k in range(4)) + " from e, w group by 1), "
    "x as (select cl, uc, " + ", ".join(f"u{k} - uc*(select mz from m where k = {k}) as v{k}" for k in range(4)) + " from u), "
    "f as (select count(*)/(count(*)-1)::double*((select count(*) from g)-1)/((select count(*) from g)-5) as f from u), "
    "t as (" + " union all ".join([f"select '1' as term, (select my - b*mz from m, w where k = 0) as beta, (select sum(v0*v0) from x) as v", *(f"select 'q{k}', (select my - b*mz from m, w where k = {k}) - (select my - b*mz from m, w where k = 0), (select sum((v{k}-v0)*(v{k}-v0)) from x)" for k in (1, 2, 3)), "select 'c_acctbal', (select b from w), (select sum(uc*uc) from x)"]) + ") "
    "select term, round(beta,6) as beta, round(sqrt(v*f),6) as se from t, f"
)
