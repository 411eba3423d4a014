"""A fusion study as a chain of queries: targets and metrics in, statistics by radius, a search on the training rows, scores and effects on the held-out
ones, the composite of every entity out. Each step is a DataFrame or a small result of one aggregation; nothing here holds rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions.composites import composite
from terraloom.functions.crs import bounds
from terraloom.operators import inference, joins, ladder, models, scoring, search, splits
from terraloom.operators.gram import gram, incremental_r2
from terraloom.operators.panel import complete
from terraloom.sources.tables import metric as as_metric
from terraloom.sources.tables import read
from terraloom.sources.work import written


@dataclass(frozen=True)
class Params:
    """A chosen index: a column (channel, radius, statistic) for each channel, its weights and the columns' spreads in the training rows."""

    columns: tuple[str, ...]
    weights: tuple[float, ...]
    scales: tuple[float, ...]

    def index(self) -> Column:
        return sum((F.lit(w / s if s > 0 else 0.0) * F.col(c) for c, w, s in zip(self.columns, self.weights, self.scales)), F.lit(0.0))


@dataclass(frozen=True)
class Study:
    """target: one row an entity (key, x, y, outcome, covariates, carried columns). metrics: points (mx, my, value) of each channel."""

    target: DataFrame
    key: str
    outcome: str
    covariates: tuple[str, ...] = ()
    carried: tuple[str, ...] = ()
    entity: str | None = None
    metrics: dict[str, DataFrame] = field(default_factory=dict)
    radii: tuple[float, ...] = (100.0, 200.0, 400.0)
    stats: tuple[str, ...] = ("mean", "p50")
    wide: DataFrame | None = None

    # intake

    def intake_columns(self) -> list[str]:
        """The only columns of the target that the run reads."""
        extra = [self.entity] if self.entity else []
        return [*dict.fromkeys([self.key, "x", "y", self.outcome, *self.covariates, *self.carried, *extra])]

    def gated_columns(self) -> list[str]:
        """Columns whose missing values take a row out; carried ones (controls, weights, groups) don't."""
        return [self.outcome, *self.covariates]

    def loaded(self) -> tuple[Study, tuple[float, float, float, float] | None]:
        """The study with its target's needed columns, and the target's bounds."""
        t = self.target.select(*self.intake_columns())
        return replace(self, target=t), bounds(t)

    def adopt(self, metrics: dict[str, DataFrame]) -> Study:
        """The study with metrics that another one has loaded already; `gvi` is made of veg and terrain where both are columns of one layer."""
        return replace(self, metrics={**self.metrics, **metrics})

    def validate_bounds(self, margin: float) -> dict[str, float]:
        """Share of the target's entities within each metric's bounds and a margin; 0 for an empty metric: a warning is due below 1."""
        out, n = {}, max(self.target.count(), 1)
        for name, m in self.metrics.items():
            b = bounds(m, "mx", "my")
            inside = F.lit(False) if b is None else F.col("x").between(b[0] - margin, b[2] + margin) & F.col("y").between(b[1] - margin, b[3] + margin)
            out[name] = self.target.where(inside).count() / n
        return out

    # statistics

    def long(self) -> DataFrame:
        """(key, channel, radius, n, statistics) of all channels; each is one radius join."""
        out = None
        for name, m in self.metrics.items():
            part = ladder.disc_stats(self.target.select(self.key, "x", "y"), m, self.key, "value", list(self.radii), None).withColumn("channel", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out

    def column(self, channel: str, radius: float, stat: str) -> str:
        return f"{channel}_{radius:g}_{stat}"

    def channel_columns(self) -> dict[str, list[str]]:
        return {c: [self.column(c, r, s) for r in self.radii for s in self.stats] for c in self.metrics}

    def index_tensor(self, long: DataFrame | None = None) -> DataFrame:
        """(key, channel, radius, stat, value): the cube as a long table."""
        long = long if long is not None else self.long()
        named = F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in self.stats))
        return long.select(self.key, "channel", "radius", F.explode(named).alias("v")).select(self.key, "channel", "radius", "v.stat", "v.value")

    def prepared(self, long: DataFrame | None = None) -> Study:
        """The study with its wide table: one row an entity, a column for each channel, radius and statistic, rows gated on outcome, covariates and
        the channels. The columns are known beforehand, so the pivot is one aggregation; its result, which every later step reads, is written to the
        shared folder."""
        long = long if long is not None else self.long()
        cells = [F.max(F.when((F.col("channel") == c) & (F.col("radius") == float(r)), F.col(s))).alias(self.column(c, r, s)) for c in self.metrics for r in self.radii for s in self.stats]
        table = self.target.join(long.groupBy(self.key).agg(*cells), self.key)
        kept = complete(table, [*self.gated_columns(), *(x for xs in self.channel_columns().values() for x in xs)])
        return replace(self, wide=written(kept, "study"))

    def coverage(self, reach: float) -> dict[str, float]:
        """Share of the entities with a point of each channel within reach: places meet places."""
        out, n = {}, max(self.target.count(), 1)
        for name, m in self.metrics.items():
            near = joins.radius_join(self.target.select("x", "y").distinct(), m.where("value is not null").select("mx", "my").distinct(), reach).select("x", "y").distinct()
            out[name] = self.target.join(near, ["x", "y"], "left_semi").select(self.key).distinct().count() / n
        return out

    def sampled(self, points: DataFrame, key: str, reach: float) -> DataFrame:
        """points with the nearest value of each channel within reach."""
        out = points
        for name, m in self.metrics.items():
            near = joins.nearest_join(points, m.select("mx", "my", F.col("value").alias(name)), key, [name], reach, name).select(key, name)
            out = out.join(near, key)
        return out

    # search and scores

    def split(self, share: float = 0.25, seed: int = 42) -> tuple[Study, Study]:
        """Training and held-out rows: by whole entities where rows repeat them, else in equal parts of the outcome's bins."""
        made = splits.grouped_holdout(self.wide, self.entity, share, seed) if self.entity else splits.stratified_split(self.wide, self.key, self.outcome, share, seed=seed)
        return replace(self, wide=made.where(~F.col("test")).drop("test", "bin")), replace(self, wide=made.where("test").drop("test", "bin"))

    def all_rows(self, other: Study) -> DataFrame:
        """Training and held-out rows again as one table."""
        return self.wide.unionByName(other.wide)

    def params(self, columns: tuple[str, ...], weights: np.ndarray) -> Params:
        """An index on these columns, scaled by the residual spreads in these rows."""
        g = gram(self.wide, [*self.covariates, *columns])
        scales = [max(g.solve(c, list(self.covariates))[1] / max(g.n, 1), 0.0) ** 0.5 for c in columns]
        return Params(tuple(columns), tuple(float(w) for w in weights), tuple(scales))

    def search(self, sweep_splits: int = 8, share: float = 0.25, seed: int = 0, top: int = 10) -> tuple[Params, dict]:
        """The best combination of columns by its mean held-out t, its weights on all of these rows, and the whole result."""
        found = search.sweep(self.wide, self.outcome, self.channel_columns(), list(self.covariates), self.entity or self.key, sweep_splits, share, seed, top)
        columns = found["best"]["columns"]
        a, c, _ = search.residual_gram(gram(self.wide, [*self.covariates, *columns, self.outcome]), self.outcome, list(columns), list(self.covariates))
        s = np.sqrt(np.maximum(np.diag(a), 1e-300))
        return self.params(columns, search.simplex_fit(a / np.outer(s, s), c / s)[0]), found

    def single(self, params: Params, channel: int) -> Params:
        """One channel of an index alone."""
        w = np.eye(len(params.columns))[channel]
        return replace(params, weights=tuple(w))

    def applied(self, params: Params, name: str = "index") -> DataFrame:
        return self.wide.withColumn(name, params.index())

    def applied_exposures(self, exposures: dict[str, Params]) -> DataFrame:
        """The wide table with a column for each of several indices."""
        return self.wide.withColumns({n: p.index() for n, p in exposures.items()})

    def score(self, params: Params, metric: str = "r2", years: str | None = None) -> float:
        """The one place where an index is scored: a mixed model's metric for panels, else a cross-sectional score."""
        rows = self.applied(params)
        if metric.startswith("mixedlm_"):
            controls = [*self.covariates, *([years] if years else [])]
            return models.MixedSums(rows, self.entity, ["index", *controls, self.outcome]).metrics(self.outcome, "index", controls)[metric.removeprefix("mixedlm_")]
        return scoring.score(metric, rows, self.outcome, "index", list(self.covariates))

    def evaluate_on_test(self, held: Study, params: Params, metric: str = "r2", predictions: bool = False) -> dict:
        """The index's score on held-out rows, with the rows and indices if asked for."""
        out = {"metric": metric, "score": held.score(params, metric), "n": held.wide.count()}
        return out | ({"predictions": held.applied(params).select(self.key, self.outcome, "index")} if predictions else {})

    def evaluate_effects(self, held: Study, params: Params, replicates: int = 400, permutations: int = 199, seed: int = 0) -> list[dict]:
        """Score with an interval over resampled entities and a permutation p, on all, training and held-out rows."""
        from terraloom.operators.resampling import permutation_r2

        group, out = self.entity or self.key, []
        for subset, study in (("all", replace(self, wide=self.all_rows(held))), ("train", self), ("test", held)):
            rows = study.applied(params)
            ci = inference.bootstrap_ci(rows, self.outcome, "index", list(self.covariates), group, replicates, seed=seed)
            p = permutation_r2(rows, self.outcome, "index", list(self.covariates), self.key, permutations, seed)
            out.append({"subset": subset, "score": ci["observed"], "low": ci["low"], "high": ci["high"], "p": p["p"]})
        return out

    def paired_difference(self, params: Params, other: Params, replicates: int = 400, seed: int = 0) -> dict:
        """Score of one index less that of another, over the same resamples."""
        rows = self.applied_exposures({"_a": params, "_b": other})
        return inference.r2_difference(rows, self.outcome, ("_a", "_b"), list(self.covariates), self.entity or self.key, replicates, seed)

    def covariate_impact(self, params: Params) -> list[dict]:
        """What each covariate adds to the fit, and the index's score without it; all from one Gram."""
        g = gram(self.applied(params), [*self.covariates, "index", self.outcome])
        full = ["index", *self.covariates]
        return [{"covariate": c, "r2_drop": g.r2(self.outcome, full) - g.r2(self.outcome, [k for k in full if k != c]), "score_without": incremental_r2(g, self.outcome, "index", [k for k in self.covariates if k != c])} for c in self.covariates]

    def retuned(self, outcomes: list[str], params: Params, **options) -> list[dict]:
        """The search again for other outcomes: their columns and how far their weights are from the target's."""
        out = []
        for o in outcomes:
            found, _ = replace(self, outcome=o, wide=complete(self.wide, [o])).search(**options)
            out.append({"outcome": o, "columns": found.columns, "weight_distance": 0.5 * float(np.abs(np.array(found.weights) - np.array(params.weights)).sum())})
        return out

    # composites

    def fused(self, cells: DataFrame, formula: str, weights: dict[str, float], weight: str = "weight") -> DataFrame:
        """Composite of every entity: by cell first (cells has key, a column for each channel, and the cell's weight), then the weighted mean."""
        value = composite(formula, {c: F.col(c) for c in self.metrics}, weights)
        return ladder.collapse(cells.withColumn("composite", value), self.key, "composite", weight)

    def greenery_map(self, cells: DataFrame, formula: str, weights: dict[str, float], scaled: bool = False) -> DataFrame:
        """(row, col, value) of the composite of every cell, from 0 to 1 if asked for."""
        out = cells.groupBy("row", "col").agg(*(F.first(c, ignorenulls=True).alias(c) for c in self.metrics)).select("row", "col", composite(formula, {c: F.col(c) for c in self.metrics}, weights).alias("value"))
        if not scaled:
            return out
        b = out.agg(F.min("value"), F.max("value")).first()
        return out.withColumn("value", (F.col("value") - b[0]) / (b[1] - b[0])) if b[0] is not None and b[1] > b[0] else out.withColumn("value", F.when(F.col("value").isNotNull(), F.lit(0.0)))


def raster_entities(raster: DataFrame, x0: float, y0: float, size: float, key: str = "entity") -> DataFrame:
    """Every valid pixel as an entity (key, x, y, value), its key the cell's."""
    from terraloom.functions.geometry import cell_id

    return raster.where("value is not null").select(cell_id(F.col("row"), F.col("col")).alias(key), (F.lit(x0) + (F.col("col") + 0.5) * size).alias("x"), (F.lit(y0) - (F.col("row") + 0.5) * size).alias("y"), "value")


def load_target(spark: SparkSession, path: str, layer: str | None = None, band: int = 1) -> DataFrame:
    """A target from a vector file, or a band of a raster file, every valid pixel an entity."""
    from terraloom.sources.geotiff import raster_info, read_geotiff
    from terraloom.sources.tables import is_raster

    if not is_raster(path):
        return read(spark, path, layer)
    info = raster_info(spark, [path]).first()
    return raster_entities(read_geotiff(spark, path, bands=[band]), info.x0, info.y0, info.size_x)


def wave_metrics(spark: SparkSession, paths: dict[str, str], channel: str) -> DataFrame:
    """A channel's metric files, one for each wave, as one table with a wave column."""
    out = None
    for wave, path in paths.items():
        part = as_metric(read(spark, path), channel, wave)
        out = part if out is None else out.unionByName(part)
    return out


def fill_missing(sources: dict[str, DataFrame | None], engines: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Channels that have no table, from the engine that makes one; without an engine it is an error."""
    out = {}
    for name, df in sources.items():
        if df is None and name not in engines:
            raise ValueError(f"{name} has neither a table nor an engine")
        out[name] = df if df is not None else engines[name]()
    return out


def repeat(study: Study, seeds: list[int], share: float, metric: str = "r2", **options) -> DataFrame:
    """(split, quantity, value): split, search and held-out scores again for each seed, of the index and of each channel alone."""
    rows = []
    for k, seed in enumerate(seeds):
        train, held = study.split(share, seed)
        params, _ = train.search(seed=seed, **options)
        rows.append((k, "index", float(held.score(params, metric))))
        rows += [(k, c, float(held.score(train.single(params, i), metric))) for i, c in enumerate(study.metrics)]
    return study.wide.sparkSession.createDataFrame(rows, "split int, quantity string, value double")


def split_info(df: DataFrame, test: str, block: str) -> DataFrame:
    """Held-out rows, blocks that have some, and their share."""
    return df.agg(F.count_if(F.col(test)).alias("test_rows"), F.count_distinct(F.when(F.col(test), F.col(block))).alias("test_blocks"), (F.count_if(F.col(test)) / F.count("*")).alias("share"))
