"""Registered queries and, for those that SQL can express, the same in SQL. The tables have no coordinates, so planar ones are worked out of the
keys, alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import bands, composites, dates, geometry, kernels, text
from terraloom.operators import exposure, gram, grids, inference, joins, ladder, models, panel, posterior, raster, reports, scoring, search, spatial, splits
from terraloom.sources.tables import evict, parse_panoramas, table, upsert
from terraloom.sources.work import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, places: int = 6):
    return F.round(c, places)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else c for c, t in df.dtypes))


def rows(spark: SparkSession, data: list[tuple], ddl: str) -> DataFrame:
    return rounded(spark.createDataFrame([tuple(float(v) if hasattr(v, "dtype") and v.dtype.kind == "f" else v for v in t) for t in data], ddl))


# tables with coordinates


def place(key: str, a: int, b: int, x: str, y: str) -> list:
    return [((F.col(key) * a) % 10007).cast("double").alias(x), ((F.col(key) * b) % 10007).cast("double").alias(y)]


def customers(s, d, *extra) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", *place("c_custkey", 7919, 104729, "x", "y"), *extra)


def parts(s, d) -> DataFrame:
    return table(s, d, "part").select("p_partkey", *place("p_partkey", 6007, 7001, "mx", "my"), "p_retailprice", F.col("p_size").cast("double").alias("p_size"))


def suppliers(s, d) -> DataFrame:
    return table(s, d, "supplier").select("s_suppkey", "s_acctbal", *place("s_suppkey", 4241, 8513, "mx", "my"))


def lines(s, d) -> DataFrame:
    return table(s, d, "lineitem")


def pixels(s, d) -> DataFrame:
    return lines(s, d).select(F.col("l_linenumber").alias("scene_id"), (F.col("l_partkey") % 50).alias("row"), (F.col("l_suppkey") % 50).alias("col"), "l_shipdate", (F.col("l_discount") * 10).alias("value"))


def scenes(s, d) -> DataFrame:
    return pixels(s, d).groupBy("scene_id", "row", "col").agg(F.avg("value").alias("value"))


def orders_panel(s, d) -> DataFrame:
    """One row for each customer and year: the mean total of its orders, and its time."""
    o = table(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    return o.groupBy("o_custkey", "year").agg((F.avg("o_totalprice") / 997).alias("value")).withColumn("t", (F.col("year") - 1995).cast("double"))


CUST = "select c_custkey, cast((c_custkey*7919)%10007 as double) as x, cast((c_custkey*104729)%10007 as double) as y, c_acctbal, c_mktsegment from customer"
PART = "select p_partkey, cast((p_partkey*6007)%10007 as double) as mx, cast((p_partkey*7001)%10007 as double) as my, p_retailprice, cast(p_size as double) as p_size from part"
SUPP = "select s_suppkey, s_acctbal, cast((s_suppkey*4241)%10007 as double) as mx, cast((s_suppkey*8513)%10007 as double) as my from supplier"
SCENES = "select scene_id, row, col, avg(value) as value from (select l_linenumber as scene_id, l_partkey%50 as row, l_suppkey%50 as col, l_discount*10 as value from lineitem) group by all"
PANEL = "select o_custkey, year, avg(p)/997 as value, cast(year-1995 as double) as t from (select o_custkey, cast(year(o_orderdate) as integer) as year, o_totalprice as p from orders) group by o_custkey, year"
DIST = "sqrt((x-mx)*(x-mx)+(y-my)*(y-my))"
STATS = "round(avg(v),4) as mean, round(quantile_cont(v,0.1),4) as p10, round(quantile_cont(v,0.25),4) as p25, round(quantile_cont(v,0.5),4) as p50, round(quantile_cont(v,0.75),4) as p75, round(quantile_cont(v,0.9),4) as p90"
RADII = [100.0, 200.0, 400.0]
RINGS = "(select unnest([100.0::double,200.0::double,400.0::double]) as radius)"

# joins and ladders


@query(f"with c as ({CUST}), p as ({PART}) select c_custkey, radius, count(v) as n, {STATS} from (select c_custkey, radius, p_retailprice as v from c, p, {RINGS} where {DIST} <= radius) group by 1, 2")
def disc_stats_ladder(s, d):
    return rounded(ladder.disc_stats(customers(s, d), parts(s, d), "c_custkey", "p_retailprice", RADII, None), 4)


@query(f"with c as ({CUST}), p as ({PART}), l as (select p_partkey, mx, my, 'p_retailprice' as channel, p_retailprice as v from p union all select p_partkey, mx, my, 'p_size', p_size from p) select c_custkey, radius, channel, count(v) as n, {STATS} from (select c_custkey, radius, channel, v from c, l, {RINGS} where {DIST} <= radius) group by 1, 2, 3")
def disc_stats_two_columns(s, d):
    return ladder.disc_stats_columns(customers(s, d), parts(s, d), "c_custkey", ["p_retailprice", "p_size"], RADII)


@query(f"with c as ({CUST}), p as ({PART}), j as (select c_custkey, p_retailprice as v, case when {DIST} <= 100 then 0 when {DIST} <= 200 then 1 else 2 end as own from c, p where {DIST} <= 400) select c_custkey, ring, count(v) as n, {STATS} from j, (select unnest([0,1,2]) as ring) where own <= ring group by 1, 2")
def ring_stats(s, d):
    return ladder.disc_rings(customers(s, d), parts(s, d), "c_custkey", "p_retailprice", RADII)


@query(
    f"with c as ({CUST}), p as ({PART}), a as (select c_custkey, radius, avg(p_retailprice) as m, quantile_cont(p_retailprice, 0.9) as q, avg(p_size) as z from c, p, {RINGS} where {DIST} <= radius group by 1, 2), w as (select c_custkey, max(m) filter (radius=200) as m, max(q) filter (radius=400) as q, max(z) filter (radius=400) as z from a group by 1) select c_custkey, round((0.5*m/1000+0.3*q/1000+0.2*z/50)/1.0, 6) as composite from w where m is not null order by composite desc, c_custkey limit 10"
)
def composite_top(s, d):
    """The flagship: ladder statistics of two channels off one join, a weighted composite of chosen radii, the ten greatest."""
    st = ladder.disc_stats_columns(customers(s, d), parts(s, d), "c_custkey", ["p_retailprice", "p_size"], [200.0, 400.0], None)
    of = lambda stat, channel, radius: F.max(F.when((F.col("channel") == channel) & (F.col("radius") == radius), F.col(stat)))
    near = st.groupBy("c_custkey").agg(of("mean", "p_retailprice", 200.0).alias("m"), of("p90", "p_retailprice", 400.0).alias("q"), of("mean", "p_size", 400.0).alias("z")).where("m is not null")
    value = composites.composite("weighted_three", {"veg": F.col("m") / 1000, "terrain": F.col("q") / 1000, "ndvi": F.col("z") / 50}, {"veg": 0.5, "terrain": 0.3, "ndvi": 0.2})
    return near.select("c_custkey", r(value).alias("composite")).orderBy(F.desc("composite"), "c_custkey").limit(10)


@query(f"with c as ({CUST}), p as ({SUPP}), n as (select c_custkey, s_suppkey, s_acctbal, {DIST} as dd, row_number() over (partition by c_custkey order by {DIST}, s_suppkey) as k from c, p where {DIST} <= 900) select c.c_custkey, n.s_suppkey, n.s_acctbal, round(n.dd, 6) as distance from c left join n on c.c_custkey = n.c_custkey and k = 1")
def nearest_metric(s, d):
    return rounded(joins.nearest_join(customers(s, d), suppliers(s, d), "c_custkey", ["s_suppkey", "s_acctbal"], 900.0, "s_suppkey").select("c_custkey", "s_suppkey", "s_acctbal", "distance"))


@query(f"with p as ({SUPP}), q as (select a.s_suppkey as k, min(sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my))) as d from p a, p b where a.s_suppkey <> b.s_suppkey and sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my)) <= 3000 group by 1) select round(quantile_cont(d, 0.5), 6) as spacing, round(quantile_cont(d, 0.5) * sqrt(2.0::double)/2, 6) as cell_buffer from q")
def grid_spacing(s, d):
    return rounded(joins.grid_spacing(suppliers(s, d), "s_suppkey", 3000.0))


RASTER = f"select cast(floor((10007-my)/250) as bigint) as row, cast(floor(mx/250) as bigint) as col, round(avg(p_retailprice),6) as value from ({PART}) group by 1, 2"


def part_raster(s, d):
    return rounded(raster.to_bands(parts(s, d).withColumnsRenamed({"mx": "x", "my": "y"}), ["p_retailprice"], 0.0, 10007.0, 250.0)).withColumnRenamed("p_retailprice", "value")


@query(f"with c as ({CUST}), g as ({RASTER}) select c_custkey, value from c left join g on g.row = cast(floor((10007-y)/250) as bigint) and g.col = cast(floor(x/250) as bigint)")
def raster_sample(s, d):
    return joins.raster_sample(customers(s, d), part_raster(s, d), 0.0, 10007.0, 250.0).select("c_custkey", "value")


@query(
    f"with c as ({CUST}), g as ({RASTER}), z as (select c_custkey, value, sqrt(pow(greatest(abs(x-(col+0.5)*250)-125,0),2)+pow(greatest(abs(y-(10007-(row+0.5)*250))-125,0),2)) as dd from c, g) select c_custkey, radius, count(value) as n, round(avg(value),4) as mean from z, {RINGS} where dd <= radius and dd <= 400 group by 1, 2"
)
def zonal_stats(s, d):
    pairs = joins.zonal_pairs(customers(s, d), part_raster(s, d), RADII, 250.0, 0.0, 10007.0)
    return pairs.select("c_custkey", "value", F.explode(F.filter(F.array(*map(F.lit, RADII)), lambda q: q >= F.col("d"))).alias("radius")).groupBy("c_custkey", "radius").agg(F.count("value").alias("n"), r(F.avg("value"), 4).alias("mean"))


CELLS = f"""with c as ({CUST}), k as (select c_custkey, x, y, r0 as row, c0 as col,
 sqrt(pow(greatest(c0*100.0-x, x-(c0+1)*100.0, 0),2)+pow(greatest(-(r0+1)*100.0-y, y+r0*100.0, 0),2)) as dd
 from (select *, unnest(generate_series(cast(ceil((x-@R)/100) as bigint)-1, cast(floor((x+@R)/100) as bigint))) as c0 from (select *, unnest(generate_series(cast(ceil((-y-@R)/100) as bigint)-1, cast(floor((-y+@R)/100) as bigint))) as r0 from c)))
select c_custkey, row, col, row*4294967296 + (col & 4294967295) as cell, round(@W,6) as weight from k where dd <= @R and @W > 0"""


def cell_sql(radius: str, weight: str) -> str:
    return CELLS.replace("@R", radius).replace("@W", weight)


@query(cell_sql("0", "1.0::double"))
def exposure_cells_none(s, d):
    return exposure.point_cells(customers(s, d), "c_custkey", 100.0)


@query(cell_sql("120", "(case when dd <= 20 then 1.0::double else greatest(0, (120-dd)/100) end)"))
def exposure_cells_linear(s, d):
    return rounded(exposure.point_cells(customers(s, d), "c_custkey", 100.0, "linear", 120.0, 20.0))


@query(cell_sql("150", "exp(-0.5*(dd/35)*(dd/35))"))
def exposure_cells_gaussian(s, d):
    return rounded(exposure.point_cells(customers(s, d), "c_custkey", 100.0, "gaussian", 150.0, sigma=35.0))


@query("select l_orderkey, round(sum(v*l_quantity)/nullif(sum(case when v is not null then l_quantity end),0),6) as v, coalesce(sum(case when v is not null then l_quantity end),0) as weight from (select l_orderkey, l_quantity, case when l_returnflag <> 'R' then l_extendedprice end as v from lineitem) group by 1")
def entity_collapse_weighted(s, d):
    cells = lines(s, d).select("l_orderkey", "l_quantity", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("v"))
    return rounded(ladder.collapse(cells, "l_orderkey", "v", "l_quantity"))


@query(
    f"with c as ({CUST}), p as ({PART}), a as (select radius, count(distinct c_custkey) as covered from c, p, {RINGS} where {DIST} <= radius group by 1), t as (select radius, covered, covered/(select count(distinct c_custkey) from customer)::double as share from a) select radius, covered, round(share,6) as share, coalesce(radius = (select min(radius) from t where share >= 0.5), false) as chosen from t"
)
def coverage_gate(s, d):
    st = ladder.disc_stats(customers(s, d), parts(s, d), "c_custkey", "p_retailprice", RADII)
    return rounded(ladder.coverage_gate(st, customers(s, d), "c_custkey", 0.5))


@query("select c_custkey, row*4294967296 + (col & 4294967295) as cell, row as row_back, col as col_back from (select c_custkey, c_custkey%7-3 as row, c_custkey%11-5 as col from customer)")
def global_cell_id(s, d):
    c = table(s, d, "customer").select("c_custkey", geometry.cell_id(F.col("c_custkey") % 7 - 3, F.col("c_custkey") % 11 - 5).alias("cell"))
    row, col = geometry.cell_of_id(F.col("cell"))
    return c.select("*", row.alias("row_back"), col.alias("col_back"))


@query(f"with c as ({CUST}) select c_custkey, x, y from c where x between (select min(mx) from ({SUPP})) + 500 and (select max(mx) from ({SUPP})) - 500 and y between (select min(my) from ({SUPP})) + 500 and (select max(my) from ({SUPP})) - 500")
def crop_to_extent(s, d):
    c = customers(s, d).withColumnsRenamed({"x": "mx", "y": "my"})
    return joins.crop(c, suppliers(s, d).withColumnsRenamed({"mx": "x", "my": "y"}), -500.0).select("c_custkey", F.col("mx").alias("x"), F.col("my").alias("y"))


LATLON = f"select c_custkey, 45 + x/100000 as lat, 7 + y/100000 as lon from ({CUST})"
PANOS = f"select s_suppkey, 45 + mx/100000 as plat, 7 + my/100000 as plon from ({SUPP})"
HAV = "2*6371000.0*asin(least(1.0,sqrt(pow(sin((radians(plat)-radians(lat))/2),2)+cos(radians(lat))*cos(radians(plat))*pow(sin(radians(plon-lon)/2),2))))"


@query(f"with c as ({LATLON}), p as ({PANOS}), n as (select c_custkey, s_suppkey, dd, row_number() over (partition by c_custkey order by dd, s_suppkey desc) as k from (select c_custkey, s_suppkey, {HAV} as dd from c, p) where dd <= 800) select c.c_custkey, n.s_suppkey, round(n.dd, 3) as distance_m from c left join n on c.c_custkey = n.c_custkey and k = 1")
def haversine_nearest(s, d):
    c = customers(s, d).select("c_custkey", (45 + F.col("x") / 100000).alias("lat"), (7 + F.col("y") / 100000).alias("lon"))
    p = suppliers(s, d).select("s_suppkey", (45 + F.col("mx") / 100000).alias("plat"), (7 + F.col("my") / 100000).alias("plon"))
    return joins.haversine_nearest(c, p, "c_custkey", "s_suppkey", 800.0).select("c_custkey", "s_suppkey", r("distance_m", 3).alias("distance_m"))


CAPTURES = "select o_custkey, o_orderkey as capture_id, cast(year(o_orderdate) as integer) as year, cast(month(o_orderdate) as integer) as month from orders"


def captures(s, d):
    return table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("capture_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))


@query(f"select o_custkey, capture_id, year, month, year_gap from (select *, cast(abs(year-1998) as integer) as year_gap, row_number() over (partition by o_custkey order by abs(year-1998), year desc, capture_id) as k from ({CAPTURES}) where abs(year-1998) <= 2) where k = 1")
def capture_as_of(s, d):
    return joins.choose_capture(captures(s, d), "o_custkey", 1998, 2)


MID = "least(((month-7.5)%12+12)%12, 12-((month-7.5)%12+12)%12)"


@query(f"select o_custkey, capture_id, year, month, year_gap from (select *, cast(0 as integer) as year_gap, row_number() over (partition by o_custkey order by case when month between 5 and 10 then 0 else 1 end, year desc, {MID}, capture_id) as k from ({CAPTURES})) where k = 1")
def capture_month_window(s, d):
    return joins.choose_capture(captures(s, d), "o_custkey", None, months=(5, 10))


@query(f"select o_custkey, capture_id, year, month, year_gap from (select *, cast(abs(year-1997) as integer) as year_gap, row_number() over (partition by o_custkey order by abs(year-1997), year desc, least(((month-13.0)%12+12)%12, 12-((month-13.0)%12+12)%12), capture_id) as k from ({CAPTURES}) where month >= 11 or month <= 3) where k = 1")
def capture_hard_window(s, d):
    return joins.choose_capture(captures(s, d), "o_custkey", 1997, months=(11, 3), hard=True)


@query("select event_type, count(*) as n from events group by 1")
def capture_counters(s, d):
    return reports.counters(table(s, d, "events"), "event_type")


@query("select kind, year, month, count(*) as n from (select event_type as kind, cast(year(ts) as integer) as year, cast(month(ts) as integer) as month from events) group by grouping sets ((kind), (year), (month))")
def capture_summary(s, d):
    return reports.capture_summary(table(s, d, "events"), F.col("ts"), "event_type")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def cache_antijoin(s, d):
    return joins.missing_ids(table(s, d, "part").select("p_partkey"), lines(s, d).where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


@query("with t as (select s_suppkey as tile, s_nationkey % 5 as content, s_suppkey*37%100 as x0, s_suppkey*53%100 as y0, s_suppkey*37%100 + 5 + s_suppkey%7*10 as x1, s_suppkey*53%100 + 5 + s_suppkey%11*8 as y1 from supplier) select m.tile, min(c.tile) as donor from t m join t c on m.content = c.content and c.x0 <= m.x0 and c.y0 <= m.y0 and c.x1 >= m.x1 and c.y1 >= m.y1 where m.tile % 2 = 0 and c.tile % 2 = 1 group by 1")
def donor_tiles(s, d):
    k = F.col("s_suppkey")
    t = table(s, d, "supplier").select(k.alias("tile"), (F.col("s_nationkey") % 5).alias("content"), (k * 37 % 100).alias("x0"), (k * 53 % 100).alias("y0"), (k * 37 % 100 + 5 + k % 7 * 10).alias("x1"), (k * 53 % 100 + 5 + k % 11 * 8).alias("y1"))
    return joins.donor_tiles(t.where("tile % 2 = 0"), t.where("tile % 2 = 1"))


@query("select s_suppkey, last_access, bytes from (select *, sum(bytes) over (order by last_access desc, s_suppkey rows unbounded preceding) as run from (select s_suppkey, s_suppkey*7919%1009 as last_access, cast(s_acctbal as bigint) + 2000 as bytes from supplier where s_acctbal >= 0)) where run <= 100000")
def lru_evict(s, d):
    c = table(s, d, "supplier").where("s_acctbal >= 0").select("s_suppkey", (F.col("s_suppkey") * 7919 % 1009).alias("last_access"), (r("s_acctbal", 0).cast("long") + 2000).alias("bytes"))
    return evict(c, 100_000, key="s_suppkey")


@query("select s_suppkey, case when s_suppkey % 3 = 0 then s_acctbal*2 else s_acctbal end as v from supplier")
def cache_upsert(s, d):
    old = table(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v"))
    return upsert(old, old.where("s_suppkey % 3 = 0").withColumn("v", F.col("v") * 2), ["s_suppkey"])


@query("select cast(s_suppkey as varchar) as pano_id, cast(2000 + s_suppkey % 20 as integer) as year, cast(1 + s_suppkey % 12 as integer) as month from supplier")
def parse_captures(s, d):
    k = F.col("s_suppkey")
    m = table(s, d, "supplier").select(F.to_json(F.struct(k.cast("string").alias("id"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), F.array(F.struct(F.lit("c").alias("id"), F.array(2000 + k % 20, 1 + k % 12).alias("date"))).alias("captures"))).alias("m"))
    return parse_panoramas(m, "m").select("pano_id", "year", "month")


# composites and bands

CHAN = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount*10 as veg, l_tax*10 as terrain, (l_quantity-25)/25 as ndvi from lineitem"


def channels(s, d):
    return lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_discount") * 10).alias("veg"), (F.col("l_tax") * 10).alias("terrain"), ((F.col("l_quantity") - 25) / 25).alias("ndvi"))


def chan(*names):
    return {n: F.col(n) for n in names}


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((0.5*veg+0.2*terrain+0.3*ndvi)/1.0, 6) as composite from ({CHAN})")
def composite_weighted(s, d):
    c = channels(s, d)
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(composites.composite("weighted_three", chan("veg", "terrain", "ndvi"), {"veg": 0.5, "terrain": 0.2, "ndvi": 0.3})).alias("composite"))


GM = lambda a, b: f"(case when greatest({a},0)*greatest({b},0) > 0 then pow(greatest({a},0)*greatest({b},0), 0.5) else 0 end)"


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((0.3*veg+0.2*terrain+0.1*ndvi+0.1*{GM('veg', 'terrain')}+0.1*{GM('veg', 'ndvi')}+0.1*{GM('terrain', 'ndvi')}+0.1*(case when greatest(veg,0)*greatest(terrain,0)*greatest(ndvi,0) > 0 then pow(greatest(veg,0)*greatest(terrain,0)*greatest(ndvi,0), 1.0/3) else 0 end))/(0.3+0.2+0.1+0.1+0.1+0.1+0.1), 6) as composite from ({CHAN})")
def composite_synergy_gm(s, d):
    w = {"veg": 0.3, "terrain": 0.2, "ndvi": 0.1, "veg_terrain": 0.1, "veg_ndvi": 0.1, "terrain_ndvi": 0.1, "veg_terrain_ndvi": 0.1}
    return channels(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(composites.composite("synergy_three", chan("veg", "terrain", "ndvi"), w)).alias("composite"))


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((0.6*pow(least(greatest(veg+terrain,0),1),2.0)+0.3*pow(least(greatest(ndvi,0),1),2.0)+0.1*least(greatest(veg+terrain,0),1)*least(greatest(ndvi,0),1))/(0.6+0.3+0.1), 6) as composite from ({CHAN})")
def composite_percentile_form(s, d):
    w = {"gvi": 0.6, "ndvi": 0.3, "gvi_ndvi": 0.1, "power": 2.0}
    return channels(s, d).withColumn("gvi", F.col("veg") + F.col("terrain")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(composites.composite("percentile_two", chan("gvi", "ndvi"), w)).alias("composite"))


@query(f"with m as (select avg(veg) as a, stddev_pop(veg) as s, min(veg) as lo, max(veg) as hi from ({CHAN})) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((veg-a)/s, 6) as z, round(case when hi > lo then (veg-lo)/(hi-lo) else 0 end, 6) as scaled from ({CHAN}), m")
def standardised_channel(s, d):
    c = channels(s, d)
    m = c.agg(F.avg("veg"), F.stddev_pop("veg"), F.min("veg"), F.max("veg")).first()
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(composites.standardised(F.col("veg"), m[0], m[1])).alias("z"), r(composites.min_max(F.col("veg"), F.lit(m[2]), F.lit(m[3]))).alias("scaled"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when (cast(l_quantity as bigint) & 56) = 0 and l_tax + l_discount <> 0 then (l_tax-l_discount)/(l_tax+l_discount) end, 6) as ndvi from lineitem")
def ndvi_masked(s, d):
    v = F.when(bands.qa_clear(F.col("l_quantity").cast("long")), bands.normalized_difference(F.col("l_tax"), F.col("l_discount")))
    return lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(v).alias("ndvi"))


NDX = lambda a, b: f"case when ({a})>=0 and ({b})>=0 and ({a})+({b})<>0 then (({a})-({b}))/(({a})+({b})) end"


@query(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when q not in (3,7,8,9,10,11) then %s end,6) as s2, round(case when (q & 56)=0 then %s end,6) as oli, round(case when (q & 56)=0 then %s end,6) as tm from (select *, cast(l_quantity as bigint) as q, l_tax*400000 as nir, l_discount*300000 as red from lineitem)"
    % (NDX("nir*1e-4", "red*1e-4"), NDX("nir*2.75e-5-0.2", "red*2.75e-5-0.2"), NDX("(nir*2.75e-5-0.2)*0.8462+0.0412", "(red*2.75e-5-0.2)*0.9047+0.0061"))
)
def scene_preparation(s, d):
    x = lines(s, d).withColumns({"q": F.col("l_quantity").cast("long"), "nir": F.col("l_tax") * 400000, "red": F.col("l_discount") * 300000})
    a = (F.col("nir"), F.col("red"), F.col("q"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(bands.s2_surface(*a)).alias("s2"), r(bands.landsat_oli(*a)).alias("oli"), r(bands.landsat_tm(*a)).alias("tm"))


@query("select l_partkey%50 as row, l_suppkey%50 as col, round(quantile_cont(l_discount*10,0.5),6) as median, round(avg(l_discount*10),6) as mean, round(max(l_discount*10),6) as max from lineitem where l_shipdate >= timestamp '1996-06-01' and l_shipdate < timestamp '1998-10-01' group by 1, 2")
def temporal_median_mean_max(s, d):
    x = pixels(s, d).where((F.col("l_shipdate") >= F.lit("1996-06-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1998-10-01").cast("timestamp")))
    return rounded(raster.temporal(x, ["median", "mean", "max"]))


@query(
    f"with s as ({SCENES}), f as (select a.scene_id, a.row, a.col, avg(b.value) as value from s a join s b on a.scene_id = b.scene_id and (a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col) <= 4 group by 1, 2, 3), t as (select row, col, avg(value) as value from f group by 1, 2) select a.row, a.col, round(max(b.value),6) as value from t a join t b on (a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col) <= 1 group by 1, 2"
)
def focal_chain(s, d):
    return rounded(raster.apply_chain(scenes(s, d), [("focal", "mean", "2"), ("temporal", "mean"), ("focal", "max", "1")]))


@query(f"with s as ({SCENES}), w as (select l_partkey%50 as row, l_suppkey%50 as col, round(avg(l_quantity),6)*1.9 as occurrence from lineitem group by 1, 2) select s.row, s.col, round(avg(case when coalesce(occurrence,0) < 50 then value end),6) as value from s left join w on s.row = w.row and s.col = w.col group by 1, 2")
def water_masked_mean(s, d):
    w = lines(s, d).groupBy((F.col("l_partkey") % 50).alias("row"), (F.col("l_suppkey") % 50).alias("col")).agg((r(F.avg("l_quantity")) * 1.9).alias("occurrence"))
    return rounded(raster.apply_chain(scenes(s, d), [("water_mask",), ("temporal", "mean")], w))


@query(f"select row, col, round(value,6) as value from (select row, col, case when value > 0.9 then null else value end as value, row_number() over (partition by row, col order by scene_id desc) as k from ({SCENES})) where k = 1")
def mosaic_last_wins(s, d):
    return rounded(raster.mosaic(scenes(s, d).withColumn("value", F.when(F.col("value") <= 0.9, F.col("value"))), "scene_id"))


@query("select l_returnflag, min(v) as minimum, max(v) as maximum, round(avg(v),4) as mean, round(stddev_pop(v),4) as sd, round(100.0*count(v)/count(*),4) as valid_percent from (select l_returnflag, nullif(l_extendedprice, 0) as v from lineitem) group by 1")
def band_statistics(s, d):
    return rounded(raster.band_statistics(lines(s, d).select("l_returnflag", F.col("l_extendedprice").alias("value")), ["l_returnflag"], 0.0), 4)


@query(f"select cast(floor(row/4.0) as bigint) as row, cast(floor(col/4.0) as bigint) as col, round(avg(value),6) as value from (select row, col, avg(value) as value from ({SCENES}) group by 1, 2) group by 1, 2")
def raster_overview(s, d):
    return rounded(raster.overview(raster.temporal(scenes(s, d), ["mean"]).withColumnRenamed("mean", "value"), 4))


@query(f"select row, col, cast((col+0.5)*10 as double) as x, cast(500-(row+0.5)*10 as double) as y, round_even(v, 4) as value from (select row, col, round(avg(value),6) as v from ({SCENES}) group by 1, 2) where v is not null")
def raster_points(s, d):
    return raster.to_points(rounded(raster.temporal(scenes(s, d), ["mean"])).withColumnRenamed("mean", "value"), 0.0, 500.0, 10.0)


@query("select vec_id, round(sum(case when cast(floor(abs(x)*40) as bigint) % 3 = 0 then 1 else 0 end)/count(*)::double, 6) as vegetation, round(sum(case when cast(floor(abs(x)*40) as bigint) % 3 in (0,1) then 1 else 0 end)/count(*)::double, 6) as total from (select vec_id, cast(unnest(embedding) as double) as x from embeddings) group by 1")
def mask_shares(s, d):
    m = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 40).cast("long") % 3).alias("mask"))
    return m.select("vec_id", r(bands.class_share(F.col("mask"), 0)).alias("vegetation"), r(bands.class_share(F.col("mask"), 0, 1)).alias("total"))


# dates and text


@query("select o_orderkey, month(o_orderdate) between 5 and 10 as inside, month(o_orderdate) >= 11 or month(o_orderdate) <= 2 as winter, strftime(o_orderdate, '%Y-%m') as label, cast(year(o_orderdate) as varchar) as wave from orders")
def month_windows(s, d):
    m = F.month("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", dates.in_month_window(m, 5, 10).alias("inside"), dates.in_month_window(m, 11, 2).alias("winter"), dates.format_year_month(F.year("o_orderdate"), m).alias("label"), dates.wave_label(F.col("o_orderdate")).alias("wave"))


@query("select o_orderkey, substring(sha256(concat_ws('|', cast(o_orderkey as varchar), o_orderstatus, '~')),1,16) as key, regexp_replace(trim(o_orderpriority), '[^A-Za-z0-9._-]+', '_', 'g') as name from orders")
def resume_keys(s, d):
    return table(s, d, "orders").select("o_orderkey", text.resume_key(F.col("o_orderkey"), F.col("o_orderstatus"), F.lit(None)).alias("key"), text.safe_name(F.col("o_orderpriority")).alias("name"))


@query("select o_orderkey, make_timestamp(y, 1, 1, 0, 0, 0) as d from (select o_orderkey, year(o_orderdate) as y from orders)")
def parse_dates(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("t"))
    return o.select("o_orderkey", dates.parse_date(F.col("t")).cast("timestamp").alias("d"))


# panels


@query("select o_orderkey, o_custkey, round((epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) over (partition by o_custkey))/(365.25*86400*1e6), 6) as years_since_baseline from orders")
def panel_baseline(s, d):
    return rounded(panel.baseline_years(table(s, d, "orders"), "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", "years_since_baseline"))


@query("select o_custkey as entity_id, 'w'||year(o_orderdate) as wave, o_totalprice as outcome, o_orderkey, case when year(o_orderdate) = 1996 then o_orderstatus end as o_orderstatus from orders where year(o_orderdate) in (1995, 1996) and o_totalprice is not null")
def panel_long_union(s, d):
    o = table(s, d, "orders")
    year = lambda y, *c: o.where(F.year("o_orderdate") == y).select("o_custkey", "o_totalprice", "o_orderkey", *c)
    a = panel.from_waves({"w1995": year(1995)}, "o_custkey", "o_totalprice", ["o_orderkey"])
    b = panel.from_waves({"w1996": year(1996, "o_orderstatus")}, "o_custkey", "o_totalprice", ["o_orderkey", "o_orderstatus"])
    return a.unionByName(b, allowMissingColumns=True)


@query("select o_custkey, cast(year(o_orderdate) as integer) as year, count(*) as n from orders group by 1, 2 having count(*) > 1")
def panel_dup_guard(s, d):
    return panel.duplicate_keys(table(s, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year")), "o_custkey", "year")


@query(f'select o_custkey, year, round(avg(value) over w,5) as "between", round(value - avg(value) over w,5) as "within" from ({PANEL}) window w as (partition by o_custkey)')
def within_between(s, d):
    return rounded(panel.within_between(orders_panel(s, d), "o_custkey", "value").select("o_custkey", "year", "between", "within"), 5)


@query(f"select o_custkey, year, round(avg(value) over (partition by year),5) as placebo from ({PANEL})")
def placebo_wave_mean(s, d):
    return rounded(panel.placebo(orders_panel(s, d), "year", "value").select("o_custkey", "year", "placebo"), 5)


@query(f"select round(corr(e,t),6) as correlation, count(*) as n, abs(corr(e,t)) >= 0.2 as flagged from (select value - avg(value) over w as e, t - avg(t) over w as t from ({PANEL}) window w as (partition by o_custkey))")
def period_confounding(s, d):
    return rounded(panel.period_confounding(orders_panel(s, d), "o_custkey", "value", "t"))


@query(f"select year, round(avg(value),5) as mean, count(value) as n from ({PANEL}) group by 1")
def wave_means(s, d):
    return rounded(panel.wave_means(orders_panel(s, d), "year", "value"), 5)


SEG = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("select c_custkey, " + ", ".join(f"cast(c_mktsegment = '{v}' as double) as c_mktsegment_{v}" for v in SEG) + " from customer")
def onehot_drop_first(s, d):
    return panel.one_hot(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


@query("with c as (select c_custkey, case when c_custkey % 10 <> 0 then c_mktsegment end as seg from customer) select c_custkey, " + ", ".join(f"cast(coalesce(seg = '{v}', false) as double) as seg_{v}" for v in SEG) + ", cast(seg is null as double) as seg_missing from c")
def onehot_missing_level(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("seg"))
    return panel.one_hot(c, "seg", "indicator").drop("seg")


@query("select o_custkey, first_order, first_price from (select o_custkey, o_orderkey as first_order, o_totalprice as first_price, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) where k = 1")
def entity_rows(s, d):
    o = table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_totalprice").alias("first_price"))
    return ladder.entity_rows(o, "o_custkey", ["first_order", "first_price"], "first_order")


# bins, blocks, splits

DRAW = "(((({0} + {1}*7919) % 1000003) * 1103515245 + 12345) % 2147483648)/2147483648.0::double"


@query("with q as (select quantile_cont(p_retailprice, [0.2,0.4,0.6,0.8]) as c from part) select p_partkey, cast(len(list_filter(list_distinct(c), lambda e: p_retailprice > e)) as integer) as bin from part, q")
def qcut_bins(s, d):
    return splits.qcut(table(s, d, "part"), "p_retailprice", 5).select("p_partkey", "bin")


@query("with q as (select quantile_cont(p_size, [0.25,0.5,0.75]) as c from part) select p_partkey, cast(len(list_filter(list_distinct(c), lambda e: p_size >= e)) as integer) as quartile from part, q")
def quartile_groups(s, d):
    return splits.exposure_groups(table(s, d, "part"), "p_size").select("p_partkey", "quartile")


BLOCKS = f"select c_custkey, dense_rank() over (order by cast(floor((y-(select min(y) from ({CUST})))/1000) as bigint), cast(floor((x-(select min(x) from ({CUST})))/1000) as bigint)) - 1 as block from ({CUST})"


@query(BLOCKS)
def spatial_blocks(s, d):
    return splits.spatial_blocks(customers(s, d), 1000.0).select("c_custkey", F.col("block").cast("long").alias("block"))


@query(f"select distinct block, block % 4 = 1 as test from ({BLOCKS})")
def stripe_test_blocks(s, d):
    return splits.stripe_blocks(splits.spatial_blocks(customers(s, d), 1000.0), 0.25, 1).select(F.col("block").cast("long").alias("block"), "test")


@query(f"with b as (select block, count(*) as n from ({BLOCKS}) group by 1), u as (select *, cast(sum(n) over (order by {DRAW.format('block', 3)}, block rows unbounded preceding) as bigint) as upto, cast(sum(n) over () as bigint) as tot from b) select block, n, upto <= tot*0.25 or (upto - n < tot*0.25 and upto - tot*0.25 < tot*0.25 - (upto - n)) as test from u")
def random_test_blocks(s, d):
    return splits.random_blocks(splits.spatial_blocks(customers(s, d), 1000.0), 0.25, 3).select(F.col("block").cast("long").alias("block"), "n", "test")


@query(f"with q as (select quantile_cont(o_totalprice, [0.2,0.4,0.6,0.8]) as c from orders), b as (select o_orderkey, len(list_filter(list_distinct(c), lambda e: o_totalprice > e)) as bin from orders, q) select o_orderkey, row_number() over (partition by bin order by {DRAW.format('o_orderkey', 1)}, o_orderkey) <= floor(count(*) over (partition by bin)*0.25 + 0.5) as test from b")
def stratified_split(s, d):
    return splits.stratified_split(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 0.25, 5, 1).select("o_orderkey", "test")


@query(f"select o_orderkey, o_custkey, {DRAW.format('o_custkey', 2)} < 0.25 as test from orders")
def grouped_holdout(s, d):
    return splits.grouped_holdout(table(s, d, "orders"), "o_custkey", 0.25, 2).select("o_orderkey", "o_custkey", "test")


@query()
def shard_crc32(s, d):
    c = customers(s, d).withColumns({"cluster": F.lit(0), "row": F.floor(F.col("y") / 50), "col": F.floor(F.col("x") / 50)})
    return splits.shard(c, "cluster", "row", "col", 3).select("c_custkey", "shard")


@query()
def area_balanced_split(s, d):
    p = splits.qcut(table(s, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("area")), "p_retailprice", 5)
    return splits.area_balanced(p, "bin", "area", {"train": 0.6, "val": 0.2, "test": 0.2}, "p_partkey").select("p_partkey", "split")


@query(f"with o as (select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by o_orderkey) as r from orders), p as (select o_orderstatus, o_totalprice as permuted, row_number() over (partition by o_orderstatus order by {DRAW.format('o_orderkey', 5)}, o_orderkey) as r from orders) select o_orderkey, permuted from o join p using (o_orderstatus, r)")
def permuted_in_strata(s, d):
    return splits.permuted(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", "o_totalprice", 5, ["o_orderstatus"]).select("o_orderkey", "permuted")


# regressions

L3 = "with g as (select corr(l_extendedprice,l_quantity) as yx, corr(l_extendedprice,l_discount) as yz, corr(l_quantity,l_discount) as xz, count(*) as n, stddev_pop(l_extendedprice) as sy, stddev_pop(l_quantity) as sx from lineitem), p as (select *, (yx-yz*xz)/sqrt((1-yz*yz)*(1-xz*xz)) as b from g) "


def line_gram(s, d):
    return gram.gram(lines(s, d), ["l_discount", "l_quantity", "l_extendedprice"])


@query(L3 + "select round((yx*yx+yz*yz-2*yx*yz*xz)/(1-xz*xz) - yz*yz, 6) as r2, n from p")
def ols_incremental_r2(s, d):
    g = line_gram(s, d)
    return rows(s, [(gram.incremental_r2(g, "l_extendedprice", "l_quantity", ["l_discount"]), g.n)], "r2 double, n long")


@query(L3 + "select round(b,6) as beta, round(sqrt((1-b*b)/(n-3)),6) as se, cast(n-3 as bigint) as df from p")
def partial_slope(s, d):
    f = gram.partial_slope(line_gram(s, d), "l_extendedprice", "l_quantity", ["l_discount"])
    return rows(s, [(f["beta"], f["se"], f["df"])], "beta double, se double, df long")


@query(L3 + "select round(10*b*sy*sqrt(1-yz*yz)/(sx*sqrt(1-xz*xz)),4) as slope, round(10*sqrt((1-b*b)/(n-3))*sy*sqrt(1-yz*yz)/(sx*sqrt(1-xz*xz)),4) as se from p")
def raw_slope(s, d):
    f = gram.raw_slope(line_gram(s, d), "l_extendedprice", "l_quantity", ["l_discount"], 10.0)
    return rounded(rows(s, [(f["slope"], f["se"])], "slope double, se double"), 4)


@query("with w as (select l_extendedprice as y, l_tax as x, l_quantity as w from lineitem), m as (select sum(w*x)/sum(w) as mx, sum(w*y)/sum(w) as my, avg(w) as aw, count(*) as n, pow(sum(w),2)/sum(w*w) as k from w), r as (select w.*, x-mx as rx, y-my as ry, aw, n, k from w, m), b as (select sum(w*rx*ry)/sum(w*rx*rx) as b, sum(w*rx*rx)/max(aw) as sxx, max(n) as n, max(k) as k, max(aw) as aw from r) select round(max(b),2) as slope, round(sqrt(sum(pow(r.w*rx*(ry-b*rx)/b.aw,2))/pow(max(sxx),2)*max(b.n)/(max(b.n)-2)),2) as se, round(max(b.k),4) as n_effective from r, b")
def weighted_slope_hc1(s, d):
    f = gram.weighted_slope(lines(s, d), "l_extendedprice", "l_tax", [], "l_quantity")
    out = s.createDataFrame([(float(f["slope"]), float(f["se"]), float(f["n_effective"]))], "slope double, se double, n_effective double")
    return out.select(F.round("slope", 2).alias("slope"), F.round("se", 2).alias("se"), F.round("n_effective", 4).alias("n_effective"))


@query("select l_returnflag, round(pow(sum(l_quantity),2)/sum(l_quantity*l_quantity),4) as kish from lineitem group by 1")
def kish_neff(s, d):
    w = F.col("l_quantity")
    return lines(s, d).groupBy("l_returnflag").agg(r(F.pow(F.sum(w), 2) / F.sum(w * w), 4).alias("kish"))


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a},{b}),6) as r from lineitem" for i, a in enumerate(COLS) for b in COLS[i + 1 :]))
def pearson_matrix(s, d):
    return rows(s, gram.correlations(gram.gram(lines(s, d), COLS)), "a string, b string, r double")


@query(L3 + "select 'l_extendedprice' as column, round(1/(1-(yx*yx+yz*yz-2*yx*yz*xz)/(1-xz*xz)),6) as vif from p union all select 'l_quantity', round(1/(1-(yx*yx+xz*xz-2*yx*yz*xz)/(1-yz*yz)),6) from p union all select 'l_discount', round(1/(1-(yz*yz+xz*xz-2*yx*yz*xz)/(1-yx*yx)),6) from p".replace("as column", 'as "column"'))
def vif(s, d):
    return rows(s, list(gram.vif(line_gram(s, d), ["l_discount", "l_quantity", "l_extendedprice"]).items()), "column string, vif double")


@query("with g as (select regr_sxx(y,x) as sxx, regr_syy(y,x) as syy, regr_sxy(y,x) as sxy, count(*) as n from (select l_extendedprice/1000 as y, l_quantity as x from lineitem)), i as (select *, syy-sxy*sxy/sxx as rss from g) select round(n*(ln(2*pi())+ln(rss/n)+1)+2*2,2) as aic, round(n*(ln(2*pi())+ln(rss/n)+1)+2*ln(n),2) as bic, n from i")
def information_criteria(s, d):
    f = gram.information(gram.gram(lines(s, d).select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x")), ["x", "y"]), "y", ["x"])
    out = s.createDataFrame([(float(f["aic"]), float(f["bic"]), int(f["n"]))], "aic double, bic double, n long")
    return rounded(out, 2)


@query("with k as (select rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1)/2.0::double as a, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1)/2.0::double as b from part) select round(abs(corr(a,b)),6) as spearman from k")
def spearman_average_ties(s, d):
    return rows(s, [(scoring.score("spearman", table(s, d, "part"), "p_retailprice", "p_size"),)], "spearman double")


@query("with q as (select quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as cy, quantile_cont(l_quantity, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as cx from lineitem), b as (select len(list_filter(list_distinct(cy), lambda e: l_extendedprice > e)) as a, len(list_filter(list_distinct(cx), lambda e: l_quantity > e)) as b from lineitem, q), c as (select a, b, count(*)::double as c from b group by 1, 2), m as (select c, sum(c) over (partition by a) as ca, sum(c) over (partition by b) as cb, sum(c) over () as n from c) select round(sum(c/n*ln(c*n/(ca*cb))),6) as mi from m")
def mutual_info_deciles(s, d):
    return rows(s, [(scoring.score("mutual_info", lines(s, d), "l_extendedprice", "l_quantity"),)], "mi double")


@query("with q as (select quantile_cont(l_quantity, [0.25,0.5,0.75]) as c from lineitem), g as (select l_extendedprice as y, len(list_filter(list_distinct(c), lambda e: l_quantity >= e)) as k from lineitem, q) select round(abs(avg(y) filter (k = (select max(k) from g)) - avg(y) filter (k = 0)),2) as contrast from g")
def quartile_contrast(s, d):
    return rounded(rows(s, [(scoring.score("quartile_contrast", lines(s, d), "l_extendedprice", "l_quantity"),)], "contrast double"), 2)


@query("with m as (select min(y) as a, max(y) as b, min(x) as c, max(x) as e from (select l_extendedprice - avg(l_extendedprice) over () as y, l_quantity - avg(l_quantity) over () as x from lineitem)), r as (select l_extendedprice - avg(l_extendedprice) over () as y, l_quantity - avg(l_quantity) over () as x from lineitem) select round(sqrt(avg(pow((y-a)/(b-a)-(x-c)/(e-c),2))),6) as nrmse from r, m")
def nrmse_score(s, d):
    return rows(s, [(scoring.score("nrmse", lines(s, d), "l_extendedprice", "l_quantity"),)], "nrmse double")


@query("select round(regr_slope(l_extendedprice,l_quantity)*(quantile_cont(l_quantity,0.75)-quantile_cont(l_quantity,0.25)),2) as effect from lineitem")
def iqr_effect(s, d):
    x = lines(s, d)
    low, high = splits.quantiles(x, "l_quantity", [0.25, 0.75])
    f = gram.raw_slope(gram.gram(x, ["l_quantity", "l_extendedprice"]), "l_extendedprice", "l_quantity", [], high - low)
    return s.createDataFrame([(float(f["slope"]),)], "effect double").select(r("effect", 2).alias("effect"))


@query("select l_returnflag, count(v) as n, round(quantile_cont(v,0.5),4) as median, round(quantile_cont(v,0.25),4) as q25, round(quantile_cont(v,0.75),4) as q75, round(quantile_cont(v,0.75)-quantile_cont(v,0.25),4) as iqr, round(quantile_cont(v,0.05),4) as p5, round(quantile_cont(v,0.95),4) as p95 from (select l_returnflag, l_extendedprice as v from lineitem) group by 1")
def distribution(s, d):
    return rounded(ladder.distribution(lines(s, d), "l_extendedprice", ["l_returnflag"]), 4)


@query(" union all ".join(f"select '{c}' as \"column\", round(stddev_pop({c}),4) as sd, round(quantile_cont({c},0.9)-quantile_cont({c},0.1),4) as spread, count(distinct {c}) as values, count(distinct {c}) > 2 and stddev_pop({c}) > 20*(quantile_cont({c},0.9)-quantile_cont({c},0.1)) as flagged from lineitem" for c in COLS).replace(" as values", ' as "values"'))
def dispersion_flags(s, d):
    return rounded(ladder.dispersion_flags(lines(s, d), COLS), 4)


@query("select l_returnflag, round(regr_slope(l_extendedprice,l_quantity),4) as slope, count(*) as n from lineitem group by 1")
def moderation_slopes(s, d):
    return lines(s, d).groupBy("l_returnflag").agg(r(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.count("*").alias("n"))


# inference

PV = "select l_suppkey, case when l_suppkey % 9 <> 0 then (l_suppkey*7919%1000)/10000.0::double end as p, l_suppkey % 3 as family from (select distinct l_suppkey from lineitem)"


@query(f"select l_suppkey, family, p, round(case when p is not null then max(least(1.0, (m-k+1)*p)) over (partition by family, p is null order by p, l_suppkey rows unbounded preceding) end, 6) as p_holm from (select *, row_number() over (partition by family, p is null order by p, l_suppkey) as k, count(p) over (partition by family) as m from ({PV}))")
def holm_adjust(s, d):
    k = F.col("l_suppkey")
    p = lines(s, d).select("l_suppkey").distinct().select(k, F.when(k % 9 != 0, (k * 7919 % 1000) / 10000.0).alias("p"), (k % 3).alias("family"))
    return inference.holm_adjust(p, "p", ["family"], "l_suppkey").withColumn("p_holm", r("p_holm"))


SPLITS = f"select split, family, avg(l_quantity) filter (u < 0.25) - avg(l_quantity) filter (u >= 0.25) as v from (select split, l_suppkey % 3 as family, l_quantity, {DRAW.format('(l_orderkey+split*104729)', 0)} as u from lineitem, (select unnest(generate_series(0,9)) as split)) group by 1, 2"


def split_values(s, d):
    x = lines(s, d).select("l_orderkey", (F.col("l_suppkey") % 3).alias("family"), "l_quantity", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("split"))
    u = splits.draw(F.col("l_orderkey") + F.col("split") * 104729)
    return x.withColumn("u", u).groupBy("split", "family").agg((F.avg(F.when(F.col("u") < 0.25, F.col("l_quantity"))) - F.avg(F.when(F.col("u") >= 0.25, F.col("l_quantity")))).alias("v"))


@query(f"select family, count(v) as n_splits, round(quantile_cont(v,0.5),6) as median, round(quantile_cont(v,0.025),6) as q025, round(quantile_cont(v,0.975),6) as q975, round(min(v),6) as min, round(max(v),6) as max, round(avg(v)/sqrt(var_samp(v)*(1.0/count(v)+0.25/0.75)),6) as corrected_t from ({SPLITS}) group by 1")
def split_summary(s, d):
    return rounded(inference.split_summary(split_values(s, d), ["family"], "v", 0.25))


@query()
def corrected_t_p(s, d):
    out = inference.split_summary(split_values(s, d), ["family"], "v", 0.25)
    return rounded(inference.with_t_p(out, "corrected_t", "n_splits").select("family", "corrected_t", "corrected_p"))


HASH = "(((o_custkey % 1000003)*69069 + rep*7907) % 1000003)"
BOOT = f"((({HASH}*{HASH} + rep*104729) % 1000003)*1103515245 + 12345) % 2147483648 / 2147483648.0::double"
POIS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


@query(f"with c as (select o_custkey, sum(o_totalprice) as t, count(*) as n from orders group by 1), w as (select rep, t, n, (" + " + ".join(f"cast(u >= {p}::double as bigint)" for p in POIS) + f") as k from (select rep, t, n, {BOOT} as u from c, (select unnest(generate_series(0,99)) as rep))), m as (select rep, sum(k*t)/sum(k*n) as mean from w group by 1) select round(quantile_cont(mean,0.025),2) as low, round(quantile_cont(mean,0.975),2) as high, count(*) as replicates from m")
def bootstrap_ci(s, d):
    """Interval of a mean over resampled customers: the mean is a statistic of the Gram."""
    mean = lambda g, y, *_: float(g.part(["1"], [y])[0, 0] / g.part(["1"], ["1"])[0, 0])
    f = inference.bootstrap_ci(table(s, d, "orders"), "o_totalprice", "o_totalprice", [], "o_custkey", 100, statistic=mean)
    out = s.createDataFrame([(f["low"], f["high"], f["replicates"])], "low double, high double, replicates long")
    return out.select(r("low", 2).alias("low"), r("high", 2).alias("high"), "replicates")


@query(f"with m as (select split, v from ({SPLITS}) where family = 0), o as (select v as obs from m where split = 0) select round((count(*) filter (v >= obs)+1)/(count(v)+1)::double, 6) as p from m, o")
def permutation_p(s, d):
    v = split_values(s, d).where("family = 0")
    obs = v.where("split = 0").first().v
    return v.agg(r(inference.share_p(F.col("v"), F.lit(obs))).alias("p"))


@query(f"with t as (select split, family, row_number() over (partition by split order by v desc, family) as k from ({SPLITS})) select family, round(avg(case when k = 1 then 1.0::double else 0 end),6) as share from t group by 1")
def largest_weight_shares(s, d):
    return rounded(reports.largest_weight_shares(split_values(s, d), "split", "family", "v"))


@query(f"with t as (select family as scale, v, split from ({SPLITS})) select scale, count(*) as wins from (select split, scale, row_number() over (partition by split order by v, scale) as k from t) where k = 1 group by 1")
def scale_choice(s, d):
    return reports.scale_choice(split_values(s, d).withColumnRenamed("family", "scale"), ["split"], "scale", "v")


@query("select coalesce(o_orderstatus, 'all') as subset, round(avg(o_totalprice),4) as mean, count(*) as n from orders group by grouping sets ((o_orderstatus), ())")
def subset_scores(s, d):
    out = reports.subset_scores(table(s, d, "orders"), "o_orderstatus", {"mean": r(F.avg("o_totalprice"), 4), "n": F.count("*")})
    return out.select("subset", "mean", "n")


@query("select event_type, round(sum(value),4) as seconds, round(sum(value)/sum(sum(value)) over (),6) as share from events group by 1")
def stage_timing(s, d):
    t = reports.stage_timing(table(s, d, "events"), "event_type", "value")
    return t.select("event_type", r("seconds", 4).alias("seconds"), r("share").alias("share"))


@query("select 'discount' as quantity, l_returnflag as label, round(avg(l_discount),6) as v, null::double as w from lineitem group by 2 union all select 'tax', l_linestatus, null, round(avg(l_tax),6) from lineitem group by 2")
def report_union(s, d):
    x = lines(s, d)
    a = x.groupBy(F.col("l_returnflag").alias("label")).agg(r(F.avg("l_discount")).alias("v"))
    b = x.groupBy(F.col("l_linestatus").alias("label")).agg(r(F.avg("l_tax")).alias("w"))
    return reports.tidy({"discount": a, "tax": b}, ["label", "v", "w"])


@query("select count(*) as groups, min(n) as smallest, max(n) as largest, round(max(n)/sum(n),6) as largest_share, (select count(*) from customer where c_custkey % 17 = 0) as missing from (select c_nationkey, count(*) as n from customer where c_custkey % 17 <> 0 group by 1)")
def group_record(s, d):
    c = table(s, d, "customer").select(F.when(F.col("c_custkey") % 17 != 0, F.col("c_nationkey")).alias("g"))
    return rounded(reports.group_record(c, "g"))


@query()
def null_summary(s, d):
    k = F.col("l_suppkey")
    p = lines(s, d).select("l_suppkey").distinct().select((k % 3).alias("kind"), ((k * 7919 % 1000) / 1000.0).alias("p"))
    return rounded(reports.null_summary(p, ["kind"], "p"))


# space


@query(f"with c as ({CUST}) select cast(least(floor(dd/50), 9) as integer) as bin, count(*) as n_pairs, round(avg(0.5*pow(v1-v2,2)),2) as gamma from (select sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) as dd, a.c_acctbal as v1, b.c_acctbal as v2 from c a join c b on a.c_custkey < b.c_custkey) where dd <= 500 group by 1")
def variogram(s, d):
    return rounded(spatial.variogram(customers(s, d, "c_acctbal"), "c_custkey", "c_acctbal", 500.0, 10), 2)


@query(f"with recursive p as ({SUPP}), e as (select a.s_suppkey as a, b.s_suppkey as b from p a, p b where a.s_suppkey <> b.s_suppkey and sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my)) <= 700), w as (select s_suppkey as k, s_suppkey as r from p union select e.b, w.r from w join e on e.a = w.k) select k as s_suppkey, min(r) as component from w group by 1")
def components_radius(s, d):
    return spatial.radius_components(suppliers(s, d).withColumnsRenamed({"mx": "x", "my": "y"}), "s_suppkey", 700.0)


@query()
def component_report(s, d):
    p = suppliers(s, d).withColumnsRenamed({"mx": "x", "my": "y"})
    labels = spatial.merge_small(p, spatial.radius_components(p, "s_suppkey", 900.0), "s_suppkey", 4)
    return rounded(spatial.component_report(p, labels, "s_suppkey"))


COMPONENTS = f"p as ({SUPP}), e as (select a.s_suppkey as a, b.s_suppkey as b from p a, p b where a.s_suppkey <> b.s_suppkey and sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my)) <= 600), w as (select s_suppkey as k, s_suppkey as r from p union select e.b, w.r from w join e on e.a = w.k), l as (select k as s_suppkey, min(r) as component from w group by 1)"
GRID = "g as (select distinct row, col, component as cluster_id, (col+0.5)*100 as x, -(row+0.5)*100 as y from (select component, mx, my, unnest(generate_series(cast(floor((mx-300)/100) as bigint)-1, cast(ceil((mx+300)/100) as bigint)+1)) as col, row from (select component, mx, my, unnest(generate_series(cast(floor((-my-300)/100) as bigint)-1, cast(ceil((-my+300)/100) as bigint)+1)) as row from p join l using (s_suppkey))) where sqrt(pow(mx-(col+0.5)*100,2)+pow(my+(row+0.5)*100,2)) <= 300)"


@query(f"with recursive {COMPONENTS}, {GRID} select row, col, cluster_id, cast(x as double) as x, cast(y as double) as y from g")
def clustered_grid(s, d):
    return grids.clustered_grid(suppliers(s, d).withColumnsRenamed({"mx": "x", "my": "y"}), "s_suppkey", 300.0, 100.0)


@query(f"with recursive {COMPONENTS}, {GRID}, c as (select cluster_id, min(x) as x0, max(y) as y0 from g group by 1) select cluster_id, cast(floor((y0-y)/1000) as bigint) as tile_row, cast(floor((x-x0)/1000) as bigint) as tile_col, count(*) as cells, cast(min(x0 + floor((x-x0)/1000)*1000) as double) as left_x from g join c using (cluster_id) group by 1, 2, 3")
def planar_tiles(s, d):
    return grids.planar_tiles(clustered_grid(s, d), 1000.0).select("cluster_id", "tile_row", "tile_col", "cells", F.col("left").alias("left_x"))


@query()
def weighted_r2(s, d):
    return rows(s, [(inference.weighted_r2(lines(s, d), "l_extendedprice", "l_discount", ["l_tax"], "l_quantity"),)], "r2 double")


@query()
def r2_difference(s, d):
    f = inference.r2_difference(study(s, d), "y_out", ("price", "orders"), ["c_acctbal"], "c_custkey", 100)
    return rows(s, [(f["delta"], f["low"], f["high"])], "delta double, low double, high double")


@query()
def variogram_match(s, d):
    p = suppliers(s, d).withColumnsRenamed({"mx": "x", "my": "y"}).withColumn("one", F.lit(1))
    observed = spatial.variogram(p, "s_suppkey", "s_acctbal", 3000.0, 6)
    drawn = spatial.surrogates(p, "one", "s_suppkey", "s_acctbal", 4).join(p.select("s_suppkey", "x", "y"), "s_suppkey")
    # pairs of a surrogate are those of one draw: the draw is part of the key and set far apart in x
    apart = written(drawn.select((F.col("s_suppkey") * 8 + F.col("draw")).alias("k"), (F.col("x") + F.col("draw") * 1e6).alias("x"), "y", "value"), "surrogates")
    gammas = [spatial.variogram(apart.where(F.col("k") % 8 == i), "k", "value", 3000.0, 6).withColumn("draw", F.lit(i)) for i in range(4)]
    out = gammas[0]
    for g in gammas[1:]:
        out = out.unionByName(g)
    return rounded(grids.variogram_match(observed, out))


# statistics core: no SQL, tested in NumPy


def study(s, d) -> DataFrame:
    """Orders by customer as entities: two channels at two radii, an outcome, controls, coordinates."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"), F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("low"))
    c = customers(s, d, "c_acctbal", "c_nationkey")
    return c.join(o, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "x", "y", "c_nationkey", "c_acctbal", (F.col("price") / 1e5).alias("price"), "orders", (F.col("top") / 1e5).alias("top_400"), (F.col("low") / 1e5).alias("low_200"), (F.col("price") / 2e5 + F.col("top") / 4e5 + F.col("c_acctbal") / 1e4).alias("y_out"))


@query()
def simplex_sweep(s, d):
    out = search.sweep(study(s, d), "y_out", {"a": ["price", "top_400"], "b": ["low_200", "orders"]}, ["c_acctbal"], "c_custkey", splits=4)
    return rows(s, [("|".join(x["columns"]), float(x["mean"]), float(x["se"])) for x in out["shortlist"]], "columns string, mean double, se double")


@query()
def holdout_gain(s, d):
    out = search.holdout_gain(study(s, d), "y_out", ["price", "low_200"], ["c_acctbal"], "c_custkey", splits=6)
    return rows(s, [(float(out["mean"]), float(out["t"]), float(out["p"]))], "mean double, t double, p double")


@query()
def distance_corr(s, d):
    v = scoring.all_rows(study(s, d), ["y_out", "price", "c_acctbal"])
    return rows(s, [(scoring.fast_distance_correlation(v[:, 1], v[:, 0]), scoring.fast_partial_distance_correlation(v[:, 1], v[:, 0], v[:, 2]))], "dcor double, pdcor double")


@query()
def thin_plate_df(s, d):
    p = study(s, d).withColumn("one", F.lit(1))
    b = spatial.basis_table(p, "c_custkey", "one", 24, 16)
    best, tried = spatial.select_df(p.join(b, "c_custkey"), "y_out", ["price"], [4, 8, 12, 16])
    return rows(s, [(t["df"], float(t["aic"]), float(t["bic"]), t["df"] == best) for t in tried], "df long, aic double, bic double, chosen boolean")


@query()
def scale_profile(s, d):
    out = spatial.scale_profile(study(s, d), ["y_out"], {200.0: ["low_200"], 400.0: ["top_400"]})
    return rows(s, [(o["outcome"], o["scale_m"], float(o["aic"]), float(o["delta_aic"]), o["chosen_aic"]) for o in out], "outcome string, scale_m double, aic double, delta_aic double, chosen_aic boolean")


@query()
def spatial_plus(s, d):
    return rounded(spatial.spatial_plus(study(s, d).withColumnRenamed("x", "px").withColumn("x", F.col("px")), "c_nationkey", "y_out", "price"))


@query()
def logit_fit(s, d):
    f = models.logit(study(s, d).withColumn("b", (F.col("y_out") > 1.5).cast("double")), "b", ["price", "c_acctbal"])
    return rows(s, list(zip(f["names"], map(float, f["beta"]), map(float, f["se"]))), "term string, beta double, se double")


@query()
def gee_fit(s, d):
    f = models.gee_logit(orders_panel(s, d).withColumn("b", (F.col("value") > 150).cast("double")), "o_custkey", "b", ["t"])
    return rows(s, [(n, float(b), float(e), float(f["alpha"])) for n, b, e in zip(f["names"], f["beta"], f["se"])], "term string, beta double, se double, alpha double")


@query()
def mixedlm_fit(s, d):
    f = models.mixed(orders_panel(s, d), "o_custkey", "value", ["t"])
    return rows(s, [(n, float(b), float(e), float(f["sigma2"]), float(f["tau2"])) for n, b, e in zip(f["names"], f["beta"], f["se"])], "term string, beta double, se double, sigma2 double, tau2 double")


@query()
def posterior_index(s, d):
    a, c, n, _ = posterior.cross_products(study(s, d), "y_out", ["low_200", "price", "orders", "top_400"], ["c_acctbal"])
    out = posterior.posterior(a, c, n, [200.0, 400.0], 1, 2, draws=100, chains=2)
    return rows(s, [(k, v["mean"], v["low"], v["high"]) for k, v in out.items()], "term string, mean double, low double, high double")


@query()
def plasmode_recovery(s, d):
    out = posterior.plasmode(study(s, d), ["price", "low_200"], [([0.8, 0.2], 0.5)], ["c_acctbal"], "c_custkey", repeats=3)
    return rows(s, [(o["effect"], o["recovered"], o["low"], o["high"]) for o in out], "effect double, recovered double, low double, high double")


@query()
def paired_contrast(s, d):
    f = inference.paired_contrast(study(s, d), "y_out", "orders", "price", ["c_acctbal"], "c_custkey", 100)
    return rows(s, [(f["delta"], f["low"], f["high"], f["p"])], "delta double, low double, high double, p double")


@query()
def quartile_terms(s, d):
    f = gram.quartile_terms(study(s, d), "y_out", "price", ["c_acctbal"], "c_nationkey")["terms"]
    return rows(s, list(zip(f["names"], map(float, f["beta"]), map(float, f["se"]))), "term string, beta double, se double")


@query()
def blend_distances(s, d):
    import numpy as np

    radii = np.array(kernels.ladder_radii(100, 1000, step=100), float)
    return rows(s, [(share, q) for share, q in zip((0.5, 0.9), kernels.blend_quantiles(radii, np.exp(-radii / 400)))], "share double, distance double")


@query("select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value),4) as total from events group by 1, 2")
def event_windows(s, d):
    """The daily windows of the event stream, read as a batch: the stream's own code (terraloom.streaming) on a static table."""
    from terraloom.streaming.events import windowed

    return rounded(windowed(table(s, d, "events")), 4)


from . import studies  # noqa: E402, F401, I001  these register queries; they use the tables above
from . import parts as _parts  # noqa: E402, F401
