"""Registered queries of the statistics core, shapes, projections, files and whole studies, with the same in SQL where it can say it. They are part of the
catalogue."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import bands, crs, dates
from terraloom.operators import designs, gram, inference, models, panel, posterior, resampling, search, shapes, spatial, splits
from terraloom.plans.study import Params, Study, repeat, split_info
from terraloom.sources import exports, geotiff
from terraloom.sources.tables import table
from terraloom.sources.work import shared_folder

from .catalogue import BOOT, CUST, DRAW, PART, POIS, PANEL, RADII, RINGS, STATS, SQL, customers, lines, orders_panel, part_raster, parts, query, r, rounded, rows, study, suppliers

# an entity table in SQL, the same as catalogue.study

STUDY = f"""select c.c_custkey, c.x, c.y, c.c_acctbal, price/1e5 as price, orders, top/1e5 as top_400, low/1e5 as low_200, price/2e5 + top/4e5 + c.c_acctbal/1e4 as y_out, k.c_nationkey
from ({CUST}) c join customer k on k.c_custkey = c.c_custkey join (select o_custkey, avg(o_totalprice) as price, count(*)::double as orders, max(o_totalprice) as top, min(o_totalprice) as low from orders group by 1) o on o_custkey = c.c_custkey"""


def sums(a: str, b: str, w: str = "1.0") -> str:
    """Weighted sum of products of deviations."""
    return f"(sum({w}*{a}*{b}) - sum({w}*{a})*sum({w}*{b})/sum({w}))"


def boot(source: str, columns: str, key: str = "c_custkey", replicates: int = 100) -> str:
    """Rows of a table with their Poisson weights in each replicate."""
    u = BOOT.replace("o_custkey", key)
    return f"select rep, {columns}, (" + " + ".join(f"cast({u} >= {p}::double as bigint)" for p in POIS) + f") as w from {source}, (select unnest(generate_series(0,{replicates - 1})) as rep)"


def r2_of(y: str, x: str, z: str, w: str = "1.0") -> str:
    """Incremental R2 of x beside one control."""
    part = lambda a, b: f"({sums(a, b, w)} - {sums(a, z, w)}*{sums(b, z, w)}/{sums(z, z, w)})"
    return f"(pow({part(y, x)},2)/({part(x, x)}*{sums(y, y, w)}))"


# weighted and resampled scores


SQL["weighted_r2"] = f"select round({r2_of('l_extendedprice', 'l_discount', 'l_tax', 'l_quantity')},6) as r2 from lineitem"
SQL["r2_difference"] = f"with s as ({STUDY}), b as ({boot('s', 'y_out, price, orders, c_acctbal')}), m as (select rep, {r2_of('y_out', 'price', 'c_acctbal', 'w')} - {r2_of('y_out', 'orders', 'c_acctbal', 'w')} as d from b where w > 0 group by 1) select round((select {r2_of('y_out', 'price', 'c_acctbal')} - {r2_of('y_out', 'orders', 'c_acctbal')} from s),6) as delta, round(quantile_cont(d,0.025),6) as low, round(quantile_cont(d,0.975),6) as high from m"


def rho(y: str, w: str = "1.0") -> str:
    """Slope of y on price beside the control."""
    part = lambda a, b: f"({sums(a, b, w)} - {sums(a, 'c_acctbal', w)}*{sums(b, 'c_acctbal', w)}/{sums('c_acctbal', 'c_acctbal', w)})"
    return f"({part(y, 'price')}/{part('price', 'price')})"


def spread(y: str) -> str:
    part = lambda a, b: f"({sums(a, b)} - {sums(a, 'c_acctbal')}*{sums(b, 'c_acctbal')}/{sums('c_acctbal', 'c_acctbal')})"
    return f"sqrt({part(y, y)}/{part('price', 'price')})"


SQL["paired_contrast"] = f"with s as ({STUDY}), k as (select {spread('y_out')} as a, {spread('orders')} as b, {rho('y_out')} as ya, {rho('orders')} as yb from s), b as ({boot('s', 'y_out, price, orders, c_acctbal')}), m as (select rep, {rho('y_out', 'w')} as ya, {rho('orders', 'w')} as yb from b where w > 0 group by 1), d as (select abs(m.ya/a) - abs(m.yb/b) as d from m, k) select round((select abs(ya/a) - abs(yb/b) from k),6) as delta, round(quantile_cont(d,0.025),6) as low, round(quantile_cont(d,0.975),6) as high, round((count(*) filter (d <= 0)+1)/(count(*)+1)::double,6) as p from d"


@query(f"with s as ({STUDY}), b as ({boot('s', 'y_out, price, c_acctbal')}), m as (select rep, {r2_of('y_out', 'price', 'c_acctbal', 'w')} as v from b where w > 0 group by 1) select round((select {r2_of('y_out', 'price', 'c_acctbal')} from s),6) as observed, round(quantile_cont(v,0.025),6) as low, round(quantile_cont(v,0.975),6) as high, count(*) as replicates from m")
def bootstrap_r2_ci(s, d):
    f = inference.bootstrap_ci(study(s, d), "y_out", "price", ["c_acctbal"], "c_custkey", 100)
    return rows(s, [(f["observed"], f["low"], f["high"], f["replicates"])], "observed double, low double, high double, replicates long")


def rho_of(y: str, x: str, w: str = "1.0") -> str:
    part = lambda a, b: f"({sums(a, b, w)} - {sums(a, 'c_acctbal', w)}*{sums(b, 'c_acctbal', w)}/{sums('c_acctbal', 'c_acctbal', w)})"
    return f"({part(y, x)}/{part(x, x)})"


def scale_of(y: str, x: str) -> str:
    part = lambda a, b: f"({sums(a, b)} - {sums(a, 'c_acctbal')}*{sums(b, 'c_acctbal')}/{sums('c_acctbal', 'c_acctbal')})"
    return f"sqrt({part(y, y)}/{part(x, x)})"


_D = " + ".join(f"{sign}abs(m.{o}_{x}/k.{o}_{x})" for o, sign in (("t", ""), ("c", "-1*")) for x in ("p",)) + " - (" + " + ".join(f"{sign}abs(m.{o}_{x}/k.{o}_{x})" for o, sign in (("t", ""), ("c", "-1*")) for x in ("q",)) + ")"
_PAIRS = [("t_p", "y_out", "price"), ("c_p", "orders", "price"), ("t_q", "y_out", "low_200"), ("c_q", "orders", "low_200")]


@query(
    f"with s as ({STUDY}), k as (select {', '.join(f'{scale_of(y, x)} as {n}' for n, y, x in _PAIRS)} from s), o as (select {', '.join(f'{rho_of(y, x)} as {n}' for n, y, x in _PAIRS)} from s), b as ({boot('s', 'y_out, price, orders, low_200, c_acctbal')}), w as (select rep, {', '.join(f'{rho_of(y, x, chr(119))} as {n}' for n, y, x in _PAIRS)} from b where w > 0 group by 1), d as (select {_D.replace('m.', 'w.')} as d from w, k) select round((select {_D.replace('m.', 'o.')} from o, k),6) as delta, round(quantile_cont(d,0.025),6) as low, round(quantile_cont(d,0.975),6) as high, round((count(*) filter (d <= 0)+1)/(count(*)+1)::double,6) as p from d"
)
def specificity_contrast(s, d):
    f = inference.specificity(study(s, d), "y_out", "orders", ("price", "low_200"), ["c_acctbal"], "c_custkey", 100)
    return rows(s, [(f["delta"], f["low"], f["high"], f["p"])], "delta double, low double, high double, p double")


LCG = "select cast(0 as bigint) as k, cast(((12345*1103515245::hugeint + 12345) % 2147483648) as bigint) as s1 union all select k+1, cast(((((s1*1103515245::hugeint + 12345) % 2147483648)*1103515245::hugeint + 12345) % 2147483648) as bigint) from l where k < 49"


@query(
    f"""with recursive l as ({LCG}), s as ({STUDY}), n as (select count(*) as n from s),
steps as (select k, list_filter(list_transform(range(0, 60), lambda i: ((s1 % (n-1)) + i) % (n-1) + 1), lambda q: gcd(q, n) = 1)[1] as a, cast((s1*1103515245::hugeint + 12345) % 2147483648 as bigint) % n as b from l, n),
f as (select regr_slope(y_out, c_acctbal) as yb, regr_intercept(y_out, c_acctbal) as ya, regr_slope(price, c_acctbal) as xb, regr_intercept(price, c_acctbal) as xa from s),
e as (select c_custkey, y_out, ya+yb*c_acctbal as fit, y_out-ya-yb*c_acctbal as e, price-xa-xb*c_acctbal as rx, row_number() over (order by {DRAW.format('c_custkey', 0)}, c_custkey) - 1 as i from s, f),
p as (select k, sum(v.e*e.rx) as ex, sum(pow(e.fit+v.e,2)) - pow(sum(e.fit+v.e),2)/count(*) as sst from e, steps, n, e v where v.i = (a*e.i+b) % n.n group by 1),
o as (select pow(sum(y_out*rx),2)/(sum(rx*rx)*(sum(y_out*y_out)-pow(sum(y_out),2)/count(*))) as obs, sum(rx*rx) as xx from e)
select round(max(obs),6) as observed, round((count(*) filter (ex*ex/(xx*sst) >= obs - 1e-15)+1)/(count(*)+1)::double,6) as p, round(quantile_cont(ex*ex/(xx*sst),0.5),8) as median_null, count(*) as permutations from p, o"""
)
def permutation_r2(s, d):
    """All permutations of one test in one join; the maps that permute are worked out in SQL too."""
    f = resampling.permutation_r2(study(s, d), "y_out", "price", ["c_acctbal"], "c_custkey", 50)
    out = s.createDataFrame([(f["observed"], f["p"], float(np.quantile(f["scores"], 0.5)), f["permutations"])], "observed double, p double, median_null double, permutations long")
    return out.select(r("observed").alias("observed"), r("p").alias("p"), r("median_null", 8).alias("median_null"), "permutations")


@query("select l_returnflag, round(pow(sum(l_quantity),2)/sum(l_quantity*l_quantity),4) as kish, count(*) as n from lineitem group by 1")
def effective_size(s, d):
    """The number of rows that weights amount to, as the weighted slope of each group reports it."""
    out = []
    for flag in panel.levels(lines(s, d), "l_returnflag"):  # three groups
        part = lines(s, d).where(F.col("l_returnflag") == flag)
        out.append((flag, float(gram.weighted_slope(part, "l_extendedprice", "l_tax", [], "l_quantity")["n_effective"]), gram.gram(part, ["l_tax"]).n))
    return s.createDataFrame(out, "l_returnflag string, kish double, n long").select("l_returnflag", r("kish", 4).alias("kish"), "n")


@query("with q as (select quantile_cont(l_quantity,0.75)-quantile_cont(l_quantity,0.25) as iqr, regr_slope(l_extendedprice,l_quantity) as b, sqrt((regr_syy(l_extendedprice,l_quantity)-pow(regr_sxy(l_extendedprice,l_quantity),2)/regr_sxx(l_extendedprice,l_quantity))/(count(*)-2)/regr_sxx(l_extendedprice,l_quantity)) as se from lineitem) select round(b*iqr,2) as effect, round(se*iqr,4) as se from q")
def iqr_slope(s, d):
    """The raw slope of an exposure by its interquartile range."""
    x = lines(s, d)
    low, high = splits.quantiles(x, "l_quantity", [0.25, 0.75])
    f = gram.raw_slope(gram.gram(x, ["l_quantity", "l_extendedprice"]), "l_extendedprice", "l_quantity", [], high - low)
    return s.createDataFrame([(float(f["slope"]), float(f["se"]))], "effect double, se double").select(r("effect", 2).alias("effect"), r("se", 4).alias("se"))


@query(
    "with m as (select avg(l_quantity) as mm, stddev_pop(l_quantity) as ms, count(*) as n from lineitem), c as (select l_extendedprice/1000 as y, l_discount as x, l_quantity as q, l_discount*l_quantity as xq from lineitem), g as (select regr_sxx(y,x) as xx, regr_sxx(y,q) as qq, regr_sxx(y,xq) as pp, covar_pop(x,q)*count(*) as xq, covar_pop(x,xq)*count(*) as xp, covar_pop(q,xq)*count(*) as qp, covar_pop(x,y)*count(*) as xy, covar_pop(q,y)*count(*) as qy, covar_pop(xq,y)*count(*) as py from c), b as (select (xx*(qq*pp-qp*qp)-xq*(xq*pp-qp*xp)+xp*(xq*qp-qq*xp)) as det, (xy*(qq*pp-qp*qp)-xq*(qy*pp-qp*py)+xp*(qy*qp-qq*py)) as dx, (xx*(qq*py-qp*qy)-xq*(xq*py-xp*qy)+xy*(xq*qp-qq*xp)) as dp from g) select round(dp/det,4) as interaction, round(dx/det+(mm-ms)*dp/det,4) as low, round(dx/det+mm*dp/det,4) as mid, round(dx/det+(mm+ms)*dp/det,4) as high from b, m"
)
def moderation_terms(s, d):
    """Interaction of an exposure with a moderator and the slopes at its mean and a spread on either side."""
    x = lines(s, d).select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("x"), F.col("l_quantity").alias("q"))
    f = gram.moderation(x, "y", "x", "q", [])
    return rounded(rows(s, [(float(f["interaction"][0]), *(float(f["slopes"][k][0]) for k in ("low", "mean", "high")))], "interaction double, low double, mid double, high double"), 4)


SQL["scale_profile"] = f"with s as ({STUDY}), i as (select 200.0 as scale_m, count(*) as n, regr_syy(y_out, low_200) - pow(regr_sxy(y_out, low_200),2)/regr_sxx(y_out, low_200) as rss from s union all select 400.0, count(*), regr_syy(y_out, top_400) - pow(regr_sxy(y_out, top_400),2)/regr_sxx(y_out, top_400) from s), a as (select scale_m, n*(ln(2*pi())+ln(rss/n)+1)+4 as aic from i) select 'y_out' as outcome, scale_m::double as scale_m, round(aic,6) as aic, round(aic - min(aic) over (),6) as delta_aic, aic = min(aic) over () as chosen_aic from a"

_DIST = "with s as ({0}), p as (select a.c_custkey as i, b.c_custkey as j, abs(a.price-b.price) as dx, abs(a.y_out-b.y_out) as dy, abs(a.c_acctbal-b.c_acctbal) as dz from s a, s b), n as (select count(*)::double as n from s)"
_U = ", ".join(f"case when i = j then 0 else d{v} - sum(d{v}) over (partition by i)/(n-2) - sum(d{v}) over (partition by j)/(n-2) + sum(d{v}) over ()/((n-1)*(n-2)) end as u{v}, d{v} - avg(d{v}) over (partition by i) - avg(d{v}) over (partition by j) + avg(d{v}) over () as c{v}" for v in "xyz")
SQL["distance_corr"] = _DIST.format(STUDY) + f", u as (select {_U} from p, n), q as (select avg(cx*cy) as vxy, avg(cx*cx) as vxx, avg(cy*cy) as vyy, sum(ux*uy)/sqrt(sum(ux*ux)*sum(uy*uy)) as rxy, sum(ux*uz)/sqrt(sum(ux*ux)*sum(uz*uz)) as rxz, sum(uy*uz)/sqrt(sum(uy*uy)*sum(uz*uz)) as ryz from u) select round(sqrt(greatest(vxy,0)/sqrt(vxx*vyy)),6) as dcor, round((rxy-rxz*ryz)/(sqrt(1-rxz*rxz)*sqrt(1-ryz*ryz)),6) as pdcor from q"

_T9 = "atan(abs(t)/3.0::double)"
SQL["corrected_t_p"] = SQL["split_summary"].replace("select family, count(v)", "with z as (select family, count(v)", 1) + f") select family, corrected_t, round(1 - 2/pi()*({_T9} + sin({_T9})*(cos({_T9}) + 2.0/3*pow(cos({_T9}),3) + 8.0/15*pow(cos({_T9}),5) + 16.0/35*pow(cos({_T9}),7))),6) as corrected_p from (select family, corrected_t, corrected_t as t from z)"
SQL["blend_distances"] = "with r as (select unnest(generate_series(100,1000,100))::double as r), k as (select r*r as a, exp(-r/400)/sum(exp(-r/400)) over () as k from r), g as (select a from k union all select 0), h as (select g.a, sum(k.k*least(g.a,k.a)/k.a) as have from g, k group by 1), s as (select unnest([0.5,0.9])::double as share), b as (select share, max(a) filter (have <= share) as a0, max(have) filter (have <= share) as h0, min(a) filter (have > share) as a1, min(have) filter (have > share) as h1 from h, s group by 1) select share, round(sqrt(a0+(share-h0)/(h1-h0)*(a1-a0)),6) as distance from b"


def irls(source: str, y: str, x: list[str], rounds: int) -> str:
    """Logistic regression of standardised columns, a chain of rounds; two columns and the intercept."""
    a, b = x
    out = f"z as (select cast({y} as double) as y, ({a}-avg({a}) over ())/stddev_pop({a}) over () as a, ({b}-avg({b}) over ())/stddev_pop({b}) over () as b from {source}), m as (select avg({a}) as ma, stddev_pop({a}) as sa, avg({b}) as mb, stddev_pop({b}) as sb from {source}), b0 as (select 0.0::double as p, 0.0::double as q, 0.0::double as t)"
    for i in range(rounds):
        mu = f"(1/(1+exp(-(p+q*a+t*b))))"
        w = f"({mu}*(1-{mu}))"
        out += f", g{i} as (select max(p) as p, max(q) as q, max(t) as t, sum({w}) as a00, sum({w}*a) as a01, sum({w}*b) as a02, sum({w}*a*a) as a11, sum({w}*a*b) as a12, sum({w}*b*b) as a22, sum(y-{mu}) as s0, sum(a*(y-{mu})) as s1, sum(b*(y-{mu})) as s2 from z, b{i}), d{i} as (select *, a00*(a11*a22-a12*a12)-a01*(a01*a22-a12*a02)+a02*(a01*a12-a11*a02) as det from g{i}), b{i + 1} as (select p + (s0*(a11*a22-a12*a12)-a01*(s1*a22-a12*s2)+a02*(s1*a12-a11*s2))/det as p, q + (a00*(s1*a22-a12*s2)-s0*(a01*a22-a12*a02)+a02*(a01*s2-s1*a02))/det as q, t + (a00*(a11*s2-s1*a12)-a01*(a01*s2-s1*a02)+s0*(a01*a12-a11*a02))/det as t from d{i})"
    return out


@query(f"with s as (select o_orderkey % 3 = 0 as e, o_totalprice/100000 as price, cast(o_custkey % 7 as double) as weekday from orders), {irls('s', 'e', ['price', 'weekday'], 9)}, f as (select * from b9), v as (select (a11*a22-a12*a12)/det as v00, (a02*a12-a01*a22)/det as v01, (a01*a12-a02*a11)/det as v02, (a00*a22-a02*a02)/det as v11, (a01*a02-a00*a12)/det as v12, (a00*a11-a01*a01)/det as v22 from d8) select '1' as term, round(p-q*ma/sa-t*mb/sb,6) as beta, round(sqrt(v00+pow(ma/sa,2)*v11+pow(mb/sb,2)*v22-2*ma/sa*v01-2*mb/sb*v02+2*ma/sa*mb/sb*v12),6) as se from f, v, m union all select 'price', round(q/sa,6), round(sqrt(v11)/sa,6) from f, v, m union all select 'weekday', round(t/sb,6), round(sqrt(v22)/sb,6) from f, v, m")
def logit_orders(s, d):
    """Logistic regression by iterated weighted least squares; the rounds are a chain in SQL too."""
    o = table(s, d, "orders").select((F.col("o_orderkey") % 3 == 0).cast("double").alias("e"), (F.col("o_totalprice") / 100000).alias("price"), (F.col("o_custkey") % 7).cast("double").alias("weekday"))
    f = models.logit(o, "e", ["price", "weekday"])
    return rows(s, list(zip(f["names"], map(float, f["beta"]), map(float, f["se"]))), "term string, beta double, se double")


# searches: two columns, so the best weights on the simplex are known in closed form


def _pair(a: str, b: str, split: str) -> str:
    """Held-out t of the best weights of columns a and b, one row a split: from residual products beside the control."""
    part = lambda u, v, w: f"({sums(u, v, w)} - {sums(u, 'c_acctbal', w)}*{sums(v, 'c_acctbal', w)}/{sums('c_acctbal', 'c_acctbal', w)})"
    train, test = "(case when test then 0.0 else 1.0 end)", "(case when test then 1.0 else 0.0 end)"
    return f"select split, '{a}|{b}' as columns, " + ", ".join(f"{part(u, v, w)} as {n}{k}" for w, n in ((train, "t"), (test, "h")) for k, u, v in (("aa", a, a), ("ab", a, b), ("bb", b, b), ("ay", a, "y_out"), ("by", b, "y_out"), ("yy", "y_out", "y_out"))) + f", count(*) filter (test) as n from ({split}) group by 1"


def splits_of(source: str, k: int) -> str:
    u = DRAW.format("(c_custkey+split*104729)", 0)
    return f"select *, {u} < 0.25 as test from {source}, (select unnest(generate_series(0,{k - 1})) as split)"


def scored(pairs: str) -> str:
    """Best weights (first column's share) among the single columns and the pair, then the held-out t."""
    return f"""p as (select *, tab/sqrt(taa*tbb) as g, tay/sqrt(taa) as ca, tby/sqrt(tbb) as cb from ({pairs})),
w as (select *, (ca-g*cb)/(1-g*g) as u, (cb-g*ca)/(1-g*g) as v from p),
x as (select *, case when (u >= 0 and v >= 0 and u+v > 0) or (u <= 0 and v <= 0 and u+v < 0) then u/(u+v) end as mix from w),
y as (select *, case when mix is not null and abs(mix*ca+(1-mix)*cb)/sqrt(mix*mix+2*mix*(1-mix)*g+(1-mix)*(1-mix)) > greatest(abs(ca),abs(cb)) + 1e-12 then mix when abs(cb) > abs(ca) + 1e-12 then 0 else 1 end as wa from x),
z as (select *, wa/sqrt(taa) as ra, (1-wa)/sqrt(tbb) as rb from y),
t as (select split, columns, n, taa, tbb, ca, cb, tyy, abs(ra*hay+rb*hby)/sqrt((ra*ra*haa+2*ra*rb*hab+rb*rb*hbb)*hyy) as rr, abs(hay)/sqrt(haa*hyy) as r_a, abs(hby)/sqrt(hbb*hyy) as r_b, abs(ca) >= abs(cb) as first from z)"""


SQL["simplex_sweep"] = f"with s as ({STUDY}), q as ({splits_of('s', 4)}), {scored(' union all '.join(_pair(a, b, 'q').replace('from (q)', 'from q') for a in ('price', 'top_400') for b in ('low_200', 'orders')))}, h as (select columns, rr*sqrt((n-3)/(1-rr*rr)) as held from t) select columns, round(avg(held),6) as mean, round(stddev_samp(held)/sqrt(count(*)),6) as se from h group by 1"
SQL["holdout_gain"] = f"with s as ({STUDY}), q as ({splits_of('s', 6)}), {scored(_pair('price', 'low_200', 'q').replace('from (q)', 'from q'))}, o as (select rr*sqrt((n-3)/(1-rr*rr)) - case when first then r_a*sqrt((n-3)/(1-r_a*r_a)) else r_b*sqrt((n-3)/(1-r_b*r_b)) end as raw from t), r as (select round(raw, 9) as gain from o), c as (select avg(gain) as m, case when var_samp(gain) > 0 then avg(gain)/sqrt(var_samp(gain)*(1.0/count(*)+0.25/0.75)) end as t from r) select round(m,6) as mean, round(t,6) as t, round(1 - 2/pi()*(atan(abs(t)/sqrt(5.0::double)) + sin(atan(abs(t)/sqrt(5.0::double)))*(cos(atan(abs(t)/sqrt(5.0::double))) + 2.0/3*pow(cos(atan(abs(t)/sqrt(5.0::double))),3))),6) as p from c"


@query()
def wide_sweep(s, d):
    """A search as large as the reference's own: three channels of sixty columns, 216,000 combinations on four splits."""
    out, channels = sixty(s, d)
    found = search.sweep(out, "y_out", channels, ["c_acctbal"], "c_custkey", splits=4, top=5)
    return rows(s, [("|".join(x["columns"]), float(x["mean"]), found["candidates"]) for x in found["shortlist"]], "columns string, mean double, candidates long")


def sixty(s, d) -> tuple[DataFrame, dict[str, list[str]]]:
    """Sixty columns for each of three channels: powers and mixes of the study's columns with hashed noise."""
    base, channels, made = study(s, d), {}, {}
    for c, source in (("a", "price"), ("b", "low_200"), ("g", "orders")):
        channels[c] = [f"{c}{i}" for i in range(60)]
        made |= {f"{c}{i}": F.col(source) * (1 - i / 80) + F.pmod(F.xxhash64("c_custkey", F.lit(f"{c}{i}")), F.lit(1000)) / 1000.0 * (i / 60 + 0.05) for i in range(60)}
    return base.withColumns(made), channels


# designs


@query(f"with s as ({STUDY}) select round({r2_of('y_out', 'price', 'c_acctbal')},6) as r2, cast(sign({sums('y_out', 'price')} - {sums('y_out', 'c_acctbal')}*{sums('price', 'c_acctbal')}/{sums('c_acctbal', 'c_acctbal')}) as integer) as direction from s")
def r2_over_smooth(s, d):
    """Incremental R2 beside a smooth column, as a control on both sides."""
    x = study(s, d)
    return rows(s, [(designs.score_over_smooth(x, "y_out", "price", [], ["c_acctbal"]), designs.relationship_sign(x, "y_out", "price", ["c_acctbal"]))], "r2 double, direction int")


@query(f"with s as ({STUDY}), f as (select regr_slope(y_out, c_acctbal) as yb, regr_intercept(y_out, c_acctbal) as ya, regr_slope(price, c_acctbal) as xb, regr_intercept(price, c_acctbal) as xa from s), e as (select c_custkey, y_out-ya-yb*c_acctbal as ry, price-xa-xb*c_acctbal as rx from s, f) select c_custkey, round(ry/(select stddev_pop(ry) from e),5) as y_out, round(rx/(select stddev_pop(rx) from e),5) as price from e")
def standardised_sides(s, d):
    return rounded(designs.standardised_sides(study(s, d), "y_out", ["price"], ["c_acctbal"]).select("c_custkey", "y_out", "price"), 5)


@query(f"with s as (select *, row_number() over (order by {DRAW.format('c_custkey', 0)}, c_custkey) as k from ({STUDY})), c as (select corr(price, orders) as ab from s where k <= 20000) select 'price' as channel, round(1/(1-ab*ab),6) as vif, 1/(1-ab*ab) > 10 as flagged from c union all select 'orders', round(1/(1-ab*ab),6), 1/(1-ab*ab) > 10 from c")
def channel_collinearity(s, d):
    f = designs.collinearity(study(s, d), ["price", "orders"], "c_custkey")
    return rows(s, [(c, float(v), c in f["flagged"]) for c, v in f["vif"].items()], "channel string, vif double, flagged boolean")


@query("with c as (select c_custkey, c_mktsegment as m from customer) select c_custkey, " + ", ".join(f"case when m = '{v}' then 1.0::double else 0 end as \"c_mktsegment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from c")
def group_dummies(s, d):
    out, names = designs.group_dummies(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return out.select("c_custkey", *names)


@query("with q as (select quantile_cont(c_acctbal, [0.05,0.35,0.65,0.95]) as k from customer), b as (select c_custkey, c_acctbal as x, k from customer, q) select c_custkey, " + ", ".join(f"round(((pow(greatest(x-k[{i}],0),3)-pow(greatest(x-k[4],0),3))/(k[4]-k[{i}])-(pow(greatest(x-k[3],0),3)-pow(greatest(x-k[4],0),3))/(k[4]-k[3]))/pow(k[4]-k[1],2),4) as s{i - 1}" for i in (1, 2)) + " from b")
def spline_basis(s, d):
    """Natural cubic columns of a covariate with many values."""
    out, names = designs.expand_splines(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return out.select("c_custkey", *(r(c, 4).alias(f"s{i}") for i, c in enumerate(names[1:])))


@query(f"with p as ({PANEL}), b as (select o_custkey, year, value, t, avg(value) over (partition by o_custkey) as m from p) select o_custkey, year, round(m*t,5) as decline_between, round((value-m)*t,5) as decline_within from b")
def target_design(s, d):
    out, _, _ = designs.target_design(orders_panel(s, d), "o_custkey", "value", "t", [], "decline_within")
    return rounded(out.select("o_custkey", "year", "decline_between", "decline_within"), 5)


# panels and mixed models


@query()
def mixed_covariate_impact(s, d):
    p = orders_panel(s, d).withColumn("z", (F.pmod(F.col("o_custkey") * 7919, F.lit(101)) / 101.0)).withColumn("y", F.col("value") + 20 * F.col("z") + 3 * F.col("t"))
    out = models.covariate_impact(p, "o_custkey", "y", "value", ["z", "t"])
    return rows(s, [(o["covariate"], float(o["r2_drop"]), float(o["lr"]), float(o["coef_without"])) for o in out], "covariate string, r2_drop double, lr double, coef_without double")


@query()
def mixed_entity_bootstrap(s, d):
    f = models.entity_bootstrap(orders_panel(s, d), "o_custkey", "value", "t", [], "coef", 50)
    return rows(s, [(f["observed"], f["low"], f["high"], f["replicates"])], "observed double, low double, high double, replicates long")


@query(f"with p as ({PANEL}) select count(*) as n, count(distinct o_custkey) as entities, round(sum(value),3) as total, round(sum(t*value),3) as cross from p")
def mixed_sums(s, d):
    """Sums of a panel from which every random-intercept fit of its columns follows."""
    m = models.MixedSums(orders_panel(s, d), "o_custkey", ["t", "value"])
    return s.createDataFrame([(int(m.gram[0, 0]), m.entities, float(m.gram[0, 2]), float(m.gram[1, 2]))], "n long, entities long, total double, cross double").select("n", "entities", r("total", 3).alias("total"), r("cross", 3).alias("cross"))


# distance correlation of resamples


@query()
def pdcor_resamples(s, d):
    """Partial distance correlation of two exposures over the same resamples of nations: its rows are few by design, as its matrices need."""
    x = study(s, d).groupBy("c_nationkey").agg(*(F.avg(c).alias(c) for c in ("y_out", "price", "low_200", "c_acctbal", "orders")))
    return rounded(resampling.pdcor_bootstrap(x, "y_out", ["price", "low_200"], ["c_acctbal", "orders"], 20))


@query()
def pdcor_permutation(s, d):
    x = study(s, d).groupBy("c_nationkey").agg(*(F.avg(c).alias(c) for c in ("y_out", "price", "c_acctbal", "orders")))
    f = resampling.pdcor_permutation(x, "y_out", "price", ["c_acctbal", "orders"], 50)
    return rows(s, [(f["observed"], f["p"], f["permutations"])], "observed double, p double, permutations long")


@query()
def residual_resamples(s, d):
    """Distance correlation of residuals over permutations."""
    x = study(s, d).groupBy("c_nationkey").agg(*(F.avg(c).alias(c) for c in ("y_out", "price", "c_acctbal")))
    return rounded(resampling.residual_replicates(x, "distance", "y_out", "price", ["c_acctbal"], "c_nationkey", 20, permute=True))


# shapes: a triangle about each supplier, a line for each customer

TRI = "select s_suppkey, [mx, mx+300, mx+120, mx] as px, [my, my+60, my+240, my] as py, mx, my from (select s_suppkey, cast((s_suppkey*4241)%10007 as double) as mx, cast((s_suppkey*8513)%10007 as double) as my from supplier)"


def triangles(s, d) -> DataFrame:
    at = lambda dx, dy: F.struct((F.col("mx") + dx).alias("x"), (F.col("my") + dy).alias("y"))
    return suppliers(s, d).select("s_suppkey", F.lit("polygon").alias("kind"), F.array(at(0.0, 0.0), at(300.0, 60.0), at(120.0, 240.0), at(0.0, 0.0)).alias("xy"))


@query(f"select s_suppkey, round(abs(list_sum(list_transform(range(1,4), lambda i: px[i]*py[i+1]-px[i+1]*py[i])))/2/1e6,9) as km2, round((px[1]+px[2]+px[3])/3,4) as x, round((py[1]+py[2]+py[3])/3,4) as y from ({TRI})")
def shape_areas(s, d):
    t = triangles(s, d)
    out = shapes.attach_middles(shapes.areas_km2(t, "s_suppkey"), t, "s_suppkey")
    return out.select("s_suppkey", r("km2", 9).alias("km2"), r("x", 4).alias("x"), r("y", 4).alias("y"))


def _seg(i: int) -> str:
    ax, ay, bx, by = f"px[{i}]", f"py[{i}]", f"px[{i + 1}]", f"py[{i + 1}]"
    t = f"least(greatest(((mx2-{ax})*({bx}-{ax})+(my2-{ay})*({by}-{ay}))/(pow({bx}-{ax},2)+pow({by}-{ay},2)),0),1)"
    return f"sqrt(pow({ax}+{t}*({bx}-{ax})-mx2,2)+pow({ay}+{t}*({by}-{ay})-my2,2))"


_SIDE = [f"((px[{i + 1}]-px[{i}])*(my2-py[{i}])-(py[{i + 1}]-py[{i}])*(mx2-px[{i}]) >= 0)" for i in (1, 2, 3)]
_GAP = f"case when {' and '.join(_SIDE)} then 0 else least({', '.join(_seg(i) for i in (1, 2, 3))}) end"


@query(f"with t as ({TRI}), p as (select p_partkey, mx as mx2, my as my2, p_retailprice from ({PART})), g as (select s_suppkey, p_retailprice as v, {_GAP} as gap from t, p) select s_suppkey, radius, count(v) as n, {STATS} from g, {RINGS} where gap <= radius group by 1, 2")
def shape_disc_stats(s, d):
    """Statistics of points within radii of polygons."""
    return rounded(shapes.shape_disc_stats(triangles(s, d), parts(s, d), "s_suppkey", "p_partkey", "p_retailprice", RADII), 4)


@query(f"with t as ({TRI}), c as (select c_custkey, x as mx2, y as my2 from ({CUST})), g as (select c_custkey, {_GAP} as gap from t, c) select distinct c_custkey from g where gap = 0")
def clip_to_polygons(s, d):
    return shapes.clip_points(customers(s, d), triangles(s, d), "c_custkey").select("c_custkey")


BOX = "select s_suppkey, mx as x0, my as y0, mx+200 as x1, my+150 as y1 from (select s_suppkey, cast((s_suppkey*4241)%10007 as double) + 3.5 as mx, cast((s_suppkey*8513)%10007 as double) + 7.25 as my from supplier)"


def boxes(s, d) -> DataFrame:
    at = lambda dx, dy: F.struct((F.col("mx") + 3.5 + dx).alias("x"), (F.col("my") + 7.25 + dy).alias("y"))
    return suppliers(s, d).select("s_suppkey", F.lit("polygon").alias("kind"), F.array(at(0.0, 0.0), at(200.0, 0.0), at(200.0, 150.0), at(0.0, 150.0), at(0.0, 0.0)).alias("xy"))


@query(
    f"with b as ({BOX}), g as (select cast(floor((10007-my)/250) as bigint) as row, cast(floor(mx/250) as bigint) as col, round(avg(p_retailprice),6) as value from ({PART}) group by 1, 2), z as (select s_suppkey, value, sqrt(pow(greatest(col*250-x1, x0-(col+1)*250, 0),2)+pow(greatest(10007-(row+1)*250-y1, y0-(10007-row*250), 0),2)) as dd from b, g) select s_suppkey, radius, count(value) as n, round(avg(value),4) as mean, round(quantile_cont(value,0.5),4) as p50 from z, {RINGS} where dd <= radius group by 1, 2"
)
def shape_zonal_stats(s, d):
    """Statistics of the pixels that widened polygons touch."""
    out = shapes.shape_zonal_stats(boxes(s, d), part_raster(s, d), "s_suppkey", 250.0, RADII, 0.0, 10007.0)
    return rounded(out.select("s_suppkey", "radius", "n", "mean", "p50"), 4)


@query(f"with b as ({BOX}) select s_suppkey, row, col, cast((col+0.5)*50 as double) as x, cast(-(row+0.5)*50 as double) as y from (select *, unnest(generate_series(cast(floor(x0/50) as bigint), cast(floor(x1/50) as bigint))) as col from (select *, unnest(generate_series(cast(floor(-y1/50) as bigint), cast(floor(-y0/50) as bigint))) as row from b)) where (col+0.5)*50 > x0 and (col+0.5)*50 < x1 and -(row+0.5)*50 > y0 and -(row+0.5)*50 < y1")
def polygon_grid_points(s, d):
    return shapes.sampling_points(boxes(s, d), "s_suppkey", 50.0)


# projections and dates


@query(f"select c_custkey, round(x,2) as x, round(y,2) as y, round(lat,7) as lat, round(lon,7) as lon from (select c_custkey, @R*sin(@A) as x, @0-@R*cos(@A) as y, lat, lon from (select c_custkey, 40 + x/1000 as lat, -10 + y/400 as lon from ({CUST})))")
def conic_projection(s, d):
    """Coordinates on a conic of two parallels, and back."""
    c = crs.conic(-10.0, 15.0, 40.0, 50.0)
    at = customers(s, d).select("c_custkey", (40 + F.col("x") / 1000).alias("la"), (-10 + F.col("y") / 400).alias("lo"))
    x, y = crs.conic_forward(F.col("la"), F.col("lo"), c)
    there = at.select("c_custkey", x.alias("x"), y.alias("y"))
    lat, lon = crs.conic_inverse(F.col("x"), F.col("y"), c)
    return there.select("c_custkey", r("x", 2).alias("x"), r("y", 2).alias("y"), r(lat, 7).alias("lat"), r(lon, 7).alias("lon"))


_N, _F, _R0 = crs._constants(crs.conic(-10.0, 15.0, 40.0, 50.0))
SQL["conic_projection"] = (
    SQL["conic_projection"]
    .replace("@R", f"({_F!r}::double*pow(tan(pi()/4-radians(lat)/2)/pow((1-{crs.E1!r}::double*sin(radians(lat)))/(1+{crs.E1!r}::double*sin(radians(lat))),{crs.E1 / 2!r}::double),{_N!r}::double))")
    .replace("@A", f"({_N!r}::double*radians(lon-2.5))")
    .replace("@0", f"{_R0!r}::double")
)


@query("select o_orderkey, case when moved then cast(a + interval 12 month as date) else a end as start, case when moved then cast(cast(b - interval 1 day as date) + interval 12 month as date) + 1 else b end as stop, moved, strftime(a, '%Y-%m-%d') || ' to ' || strftime(cast(b - interval 1 day as date), '%Y-%m-%d') as shown from (select o_orderkey, cast(o_orderdate as date) as a, cast(o_orderdate as date) + 40 as b, year(o_orderdate) = 1996 and year(cast(o_orderdate as date) + 39) = 1996 as moved from orders)")
def substituted_windows(s, d):
    """Windows inside one year moved to the next, and their text."""
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 40).alias("b"))
    start, stop, moved = dates.substitute_year(F.col("a"), F.col("b"), 1996, 1997)
    return o.select("o_orderkey", start.alias("start"), stop.alias("stop"), moved.alias("moved"), dates.window_text(F.col("a"), F.col("b")).alias("shown"))


@query("select cast(year(o_orderdate) as integer) as year, count(*) as n, make_date(cast(year(o_orderdate) as integer), 6, 1) as first_day, make_date(cast(year(o_orderdate) as integer), 9, 30) as last_day from orders group by 1")
def year_windows(s, d):
    return dates.year_windows(table(s, d, "orders").select(F.col("o_orderdate").cast("string").alias("o_orderdate")), "o_orderdate", 6, 9)


@query("select o_custkey, case when 1996 is null or len(list_filter(list(year(o_orderdate)), lambda q: abs(q - 1996) <= 1)) > 0 then 'month' else 'year' end as miss from orders group by 1")
def capture_miss(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.year("o_orderdate").alias("year"))).alias("c"))
    return o.select("o_custkey", dates.window_miss(F.col("c"), F.lit(1996), 1).alias("miss"))


@query("with s as (select case l_linenumber % 4 when 0 then 'LT05' when 1 then 'LE07' when 2 then 'LC08' else 'LC09' end as sensor, cast(l_shipdate as date) as ts from lineitem) select sensor, count(*) as n from s where ts >= date '1994-01-01' and ts < date '1997-01-01' and sensor <> 'LC09' and (sensor <> 'LE07' or ts < date '1995-06-01') group by 1")
def landsat_counts(s, d):
    """Scenes of each sensor of a set inside a window."""
    k = F.col("l_linenumber") % 4
    scenes = lines(s, d).select(F.when(k == 0, "LT05").when(k == 1, "LE07").when(k == 2, "LC08").otherwise("LC09").alias("sensor"), F.to_date("l_shipdate").alias("ts"))
    kept = bands.landsat_scenes(scenes, bands.landsat_sensors(s, "no_slc_off"), F.to_date(F.lit("1994-01-01")), F.to_date(F.lit("1997-01-01")), "1995-06-01")
    return kept.groupBy("sensor").agg(F.count("*").alias("n"))


@query("select o_orderkey, case when cast(o_orderdate as date) <= date '1995-03-28' then 'landsat' else 'sentinel2' end as satellite from orders")
def satellite_choice(s, d):
    return table(s, d, "orders").select("o_orderkey", bands.pick_satellite(F.to_date("o_orderdate"), begin="1995-03-28").alias("satellite"))


# files


@query(f"with g as (select cast(floor((10007-my)/250) as bigint) as row, cast(floor(mx/250) as bigint) as col, round(avg(p_retailprice),6) as value from ({PART}) group by 1, 2) select row, col, round(cast(cast(value as float) as double),3) as value from g where row >= 5 and row < 30 and col >= 3 and col < 33")
def geotiff_round_trip(s, d):
    """A raster written as GeoTIFF tiles by the tasks that have its pixels, and a window of it read back block by block."""
    import uuid

    folder = f"{shared_folder(s)}/geotiff-{uuid.uuid4().hex}"
    index = geotiff.write_geotiff_tiles(part_raster(s, d), folder, 0.0, 10007.0, 250.0, tile=16)
    read = geotiff.read_geotiff(s, [f"{folder}/{t.name}" for t in index.select("name").toLocalIterator()])
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    part = lambda i: F.regexp_extract(name, r"tile_(\d+)_(\d+)", i).cast("long") * 16
    whole = read.where("value is not null").select((F.col("row") + part(1)).alias("row"), (F.col("col") + part(2)).alias("col"), "value")
    return rounded(geotiff.window_of(whole, (5, 30), (3, 33)), 3)


@query("select o_orderkey, strftime(cast(o_orderdate as date), '%Y-%m-%d') as o_orderdate, o_totalprice, case when o_orderkey % 5 <> 0 then o_totalprice / 2 end as half from orders")
def json_fit_attributes(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 2).alias("half"))
    return exports.json_fit(o)


@query("select o_orderkey, o_orderstatus, round(cast(cast(o_totalprice as float) as double),2) as price from orders")
def narrowed_columns(s, d):
    o = exports.narrowed(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), wave="o_orderstatus")
    return o.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.round(F.col("o_totalprice").cast("double"), 2).alias("price"))


@query("select p_partkey % 7 as cluster_id, count(value) as pixels, min(row) as row0, max(row) as row1 from (select p_partkey, p_partkey % 40 as row, p_retailprice as value from part) group by 1")
def cluster_mosaics(s, d):
    """One mosaic for each cluster and their index."""
    import uuid

    t = table(s, d, "part").select((F.col("p_partkey") % 7).alias("cluster_id"), (F.col("p_partkey") % 40).alias("row"), F.col("p_partkey").alias("col"), F.col("p_retailprice").alias("value"), F.lit(0).alias("tile"))
    index = exports.write_mosaics(t, f"{shared_folder(s)}/mosaics-{uuid.uuid4().hex}", "tile")
    return index.select(F.col("cluster_id").cast("long").alias("cluster_id"), "pixels", "row0", "row1")


# reports over splits

_SPLITS = SQL["split_summary"].split(" from (", 1)[1].rsplit(")", 1)[0]
_TAIL = "1 - 2/pi()*(atan(abs(t)/3.0::double) + sin(atan(abs(t)/3.0::double))*(cos(atan(abs(t)/3.0::double)) + 2.0/3*pow(cos(atan(abs(t)/3.0::double)),3) + 8.0/15*pow(cos(atan(abs(t)/3.0::double)),5) + 16.0/35*pow(cos(atan(abs(t)/3.0::double)),7)))"


@query(f"with q as (select family, avg(v)/sqrt(var_samp(v)*(1.0/count(v)+0.25/0.75)) as t, quantile_cont(v,0.5) as median, avg(case when v > 0 then 1.0::double else 0 end) as share from ({_SPLITS}) group by 1), p as (select *, {_TAIL} as p from q), k as (select *, row_number() over (order by p, family) as k, count(*) over () as m from p) select family, round(median,6) as median, round(share,6) as share_holds, round(t,6) as corrected_t, round(max(least(1.0, (m-k+1)*p)) over (order by p, family rows unbounded preceding),6) as p_holm from k")
def split_report_rows(s, d):
    """Quantities over repeated splits with their corrected t and the p adjusted in the family."""
    from terraloom.operators import reports

    from .catalogue import split_values

    v = split_values(s, d).withColumns({"one": F.lit(1), "held": F.col("v") > 0})
    out = reports.summarise_splits(v, ["family", "one"], "v", 0.25, ["one"], "held")
    return rounded(out.select("family", "median", "share_holds", "corrected_t", "p_holm"))


@query(f"with c as (select split, arg_min(family, v)::double as scale from ({_SPLITS}) group by 1), w as (select scale, count(*) as wins from c group by 1) select (select count(*) from c) as splits, (select quantile_cont(scale, 0.5) from c) as median, scale as mode, wins from w order by wins desc, scale limit 1")
def scale_report(s, d):
    from terraloom.operators import reports

    from .catalogue import split_values

    return reports.scale_summary(split_values(s, d).withColumn("one", F.lit(1)), ["one"], "split", "family", "v").select("splits", "median", "mode", "wins")


@query("select l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) over (partition by l_suppkey),6) as centred from lineitem where l_discount > 0")
def centred_by_group(s, d):
    """Values less their group's mean, of the rows with a usable weight."""
    return rounded(panel.centred(panel.usable_weights(lines(s, d), "l_discount"), "l_quantity", "l_suppkey", "centred").select("l_orderkey", "l_linenumber", "centred"))


@query(f"select o_orderkey, o_custkey as entity_id, o_totalprice as outcome from orders where o_custkey in (select c_custkey from customer where {DRAW.format('c_custkey', 0)} < 0.25)")
def held_out_rows(s, d):
    """Rows of the held-out entities, projected."""
    held = splits.grouped_holdout(table(s, d, "customer"), "c_custkey", 0.25).where("test").select(F.col("c_custkey").alias("o_custkey"))
    return panel.projected(panel.rows_of(table(s, d, "orders"), held, "o_custkey"), "o_custkey", "o_totalprice", ["o_orderkey", "o_custkey"])


@query("with recursive p as (select s_suppkey, cast((s_suppkey*4241)%10007 as double) as x, cast((s_suppkey*8513)%10007 as double) as y from supplier), e as (select a.s_suppkey as a, b.s_suppkey as b from p a, p b where a.s_suppkey <> b.s_suppkey and sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= 900), w as (select s_suppkey as k, s_suppkey as r from p union select e.b, w.r from w join e on e.a = w.k), l as (select k as s_suppkey, min(r) as component from w group by 1), c as (select component, avg(x) as cx, avg(y) as cy, count(*) as n from l join p using (s_suppkey) group by 1), m as (select a.component, arg_min(b.component, (sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)), b.component)) as t from c a, c b where a.n < 4 and b.n >= 4 group by 1), f as (select s_suppkey, coalesce(t, component) as component from l left join m using (component)) select component, count(*) as entities, round(sqrt(pow(max(x)-min(x),2)+pow(max(y)-min(y),2)),6) as extent_m from f join p using (s_suppkey) group by 1")
def merged_components(s, d):
    """Components, small ones merged into the nearest large one, and their extents."""
    p = suppliers(s, d).withColumnsRenamed({"mx": "x", "my": "y"})
    labels = spatial.group_labels(p, "s_suppkey", reach=900.0, least=4).withColumnRenamed("group", "component")
    return rounded(spatial.component_report(p, labels, "s_suppkey"))


# posterior and spatial smooths


@query(f"with s as ({STUDY}), k as (select {', '.join(f'{sums(a, b)} - {sums(a, chr(122))}*{sums(b, chr(122))}/{sums(chr(122), chr(122))} as {n}' for n, a, b in (('xx', 'x', 'x'), ('xw', 'x', 'w'), ('ww', 'w', 'w'), ('xy', 'x', 'y'), ('wy', 'w', 'y'), ('yy', 'y', 'y')))}, count(*) as n from (select price as x, orders as w, y_out as y, c_acctbal as z from s)) select round(xw/sqrt(xx*ww),6) as a01, round(n*xy/sqrt(xx*yy),3) as c0, round(n*wy/sqrt(ww*yy),3) as c1, n from k")
def cross_products(s, d):
    """Sufficient statistics of the index's likelihood: one aggregation."""
    a, c, _, n = posterior.cross_products(study(s, d), "y_out", ["price", "orders"], ["c_acctbal"])
    out = s.createDataFrame([(float(a[0, 1] / n), float(c[0]), float(c[1]), n)], "a01 double, c0 double, c1 double, n long")
    return out.select(r("a01").alias("a01"), r("c0", 3).alias("c0"), r("c1", 3).alias("c1"), "n")


@query()
def grid_posterior(s, d):
    out = posterior.grid_posterior(study(s, d), "y_out", {"a": ["price", "top_400"], "b": ["low_200", "orders"]}, ["c_acctbal"])
    return rows(s, [("|".join(o["columns"]), float(o["probability"]), float(o["beta"])) for o in out], "columns string, probability double, beta double")


@query()
def spatial_plus_report(s, d):
    """Slopes with both sides smoothed by group, for two exposures and two outcomes, with intervals over resamples under fixed penalties."""
    p = study(s, d).withColumnRenamed("x", "px").withColumn("x", F.col("px"))
    return rounded(spatial.plus_report(p, "c_nationkey", "c_custkey", ["price", "low_200"], ["y_out", "orders"], 20))


@query()
def spatial_search_columns(s, d):
    """Residuals of search columns on each group's smooth."""
    p = study(s, d)
    out = spatial.search_transform(p, "c_nationkey", "c_custkey", ["price", "orders"])
    return out.groupBy("c_nationkey").agg(F.count("*").alias("n"), r(F.avg("price"), 6).alias("price"), r(F.stddev_pop("orders"), 6).alias("orders"))


# whole studies


def fusion(s, d) -> Study:
    target = customers(s, d, "c_acctbal").withColumn("y_out", F.col("c_acctbal") / 1000 + F.sin(F.col("x") / 900))
    p = parts(s, d)
    veg = p.select("mx", "my", (F.col("p_retailprice") / 997).alias("value"))
    ndvi = p.select("mx", "my", F.col("p_size").alias("value"))
    return Study(target, "c_custkey", "y_out", ("c_acctbal",), metrics={"veg": veg, "ndvi": ndvi}, radii=(400.0, 800.0), stats=("mean", "p50"))


FUSION = f"with c as (select c_custkey, x, y, c_acctbal, c_acctbal/1000 + sin(x/900) as y_out from ({CUST})), p as ({PART}), l as (select mx, my, 'veg' as channel, p_retailprice/997 as v from p union all select mx, my, 'ndvi', p_size from p), a as (select c_custkey, channel, radius, avg(v) as mean, quantile_cont(v, 0.5) as p50 from c, l, (select unnest([400.0::double, 800.0::double]) as radius) where sqrt((x-mx)*(x-mx)+(y-my)*(y-my)) <= radius group by all)"


@query(FUSION + " select c_custkey, channel, radius, stat, round(case stat when 'mean' then mean else p50 end, 6) as value from a, (select unnest(['mean','p50']) as stat)")
def index_tensor(s, d):
    return rounded(fusion(s, d).index_tensor())


_W = "w as (select c_custkey, " + ", ".join(f"max({st}) filter (channel = '{c}' and radius = {q}) as {c}_{q}_{st}" for c in ("veg", "ndvi") for q in (400, 800) for st in ("mean", "p50")) + " from a group by 1)"


@query(FUSION + f", {_W}, g as (select c.c_custkey, y_out, c_acctbal, 0.6*veg_800_mean/0.2 + 0.4*ndvi_800_p50/10 as ix from c join w using (c_custkey) where veg_400_mean is not null and ndvi_400_mean is not null) select count(*) as n, round({r2_of('y_out', 'ix', 'c_acctbal')},8) as r2 from g")
def study_score(s, d):
    """Prepared rows of a study and the score of a given index on them."""
    st = fusion(s, d).prepared()
    p = Params(("veg_800_mean", "ndvi_800_p50"), (0.6, 0.4), (0.2, 10.0))
    return s.createDataFrame([(st.wide.count(), float(st.score(p)))], "n long, r2 double").select("n", r("r2", 8).alias("r2"))


@query(FUSION + f", {_W}, g as (select y_out, c_acctbal, 0.6*veg_800_mean/0.2 + 0.4*ndvi_800_p50/10 as ix from c join w using (c_custkey) where veg_400_mean is not null and ndvi_400_mean is not null) select 'c_acctbal' as covariate, round({r2_of('y_out', 'c_acctbal', 'ix')},6) as r2_drop, round(pow(corr(y_out, ix),2),8) as score_without from g")
def study_covariate_impact(s, d):
    st = fusion(s, d).prepared()
    out = st.covariate_impact(Params(("veg_800_mean", "ndvi_800_p50"), (0.6, 0.4), (0.2, 10.0)))
    made = s.createDataFrame([(o["covariate"], float(o["r2_drop"]), float(o["score_without"])) for o in out], "covariate string, r2_drop double, score_without double")
    return made.select("covariate", r("r2_drop").alias("r2_drop"), r("score_without", 8).alias("score_without"))


@query()
def study_run(s, d):
    """A whole study: statistics, split, search on the training rows, score and effects on the held-out ones."""
    train, held = fusion(s, d).prepared().split()
    params, found = train.search(sweep_splits=4)
    effects = train.evaluate_effects(held, params, 40, 39)
    out = [("best", "|".join(params.columns), float(found["best"]["mean"])), ("test", "r2", float(train.evaluate_on_test(held, params)["score"]))]
    out += [("effect", e["subset"], float(e["score"])) for e in effects] + [("difference", "single", float(held.paired_difference(params, train.single(params, 0), 40)["delta"]))]
    return rows(s, out, "kind string, name string, value double")


@query()
def study_repeats(s, d):
    return rounded(repeat(fusion(s, d).prepared(), [1, 2], 0.25, sweep_splits=3))


@query("select count(*) filter (u < 0.25) as test_rows, count(distinct case when u < 0.25 then c_nationkey end) as test_blocks, round(count(*) filter (u < 0.25)/count(*)::double,6) as share from (select c_nationkey, " + DRAW.format("c_custkey", 0) + " as u from customer)")
def split_report(s, d):
    c = splits.grouped_holdout(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 0.25)
    return rounded(split_info(c, "test", "c_nationkey"))


@query(f"select c_custkey, round((v-low)/(high-low),6) as scaled from (select c_custkey, v, min(v) over () as low, max(v) over () as high from (select c_custkey, (0.7*x+0.3*y)/1.0 as v from ({CUST})))")
def greenery_map(s, d):
    """Composite of every cell, scaled from 0 to 1."""
    cells = customers(s, d).select(F.col("c_custkey").alias("row"), F.lit(0).alias("col"), F.col("x").alias("gvi"), F.col("y").alias("ndvi"))
    st = Study(cells, "row", "gvi", metrics={"gvi": cells, "ndvi": cells})
    return rounded(st.greenery_map(cells, "weighted_two", {"gvi": 0.7, "ndvi": 0.3}, True).select(F.col("row").alias("c_custkey"), F.col("value").alias("scaled")))


@query(f"with c as ({CUST}), z as (select cast(c_custkey % 50 as bigint) as k, case when c_custkey % 11 <> 0 then (0.7*x+0.3*y) end as v, 1 + c_custkey % 3 as w from c) select k, round(sum(v*w)/nullif(sum(case when v is not null then w end),0),4) as composite from z group by 1")
def applied_fusion(s, d):
    """Composite of every entity: by cell first, then the weighted mean of its cells."""
    cells = customers(s, d).select((F.col("c_custkey") % 50).cast("long").alias("k"), F.when(F.col("c_custkey") % 11 != 0, F.col("x")).alias("gvi"), F.col("y").alias("ndvi"), (1.0 + F.col("c_custkey") % 3).alias("weight"))
    st = Study(cells, "k", "gvi", metrics={"gvi": cells, "ndvi": cells})
    return rounded(st.fused(cells, "weighted_two", {"gvi": 0.7, "ndvi": 0.3}).select("k", "composite"), 4)


@query("with o as (select o_custkey, o_orderkey from orders) select count(*) as stored, count(distinct o_custkey) as units from o")
def extended_store(s, d):
    """A store of units extended by those that it lacks."""
    import uuid

    o, path = table(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_custkey") % 3).alias("wave")), f"{shared_folder(s)}/store-{uuid.uuid4().hex}"
    compute = lambda missing: o.join(missing, ["o_custkey", "wave"])
    first = exports.extend_store(o.where("wave = 0"), None, ["o_custkey", "wave"], compute, path, ["wave"])
    both = exports.extend_store(o, first, ["o_custkey", "wave"], compute, path, ["wave"])
    return both.agg(F.count("*").alias("stored"), F.count_distinct("o_custkey").alias("units"))
