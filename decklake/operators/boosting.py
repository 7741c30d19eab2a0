"""Boosted trees that start from each row's margin and stop with patience.

A round is a Newton step of the logistic loss: a Spark ML regression tree fits
(y - p) / h with weight h = p (1 - p), so that a leaf is the sum of y - p over
the sum of h of its rows.  Features are cut into bins once and written; all
rounds, and all settings of a sweep, read the same bins.  Margins are written
again every few rounds, so plans stay short and lost executors cost no more.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import log

from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import clip
from ..sources.materialise import held
from .metrics import metric_columns

#: Rounds between two writings of the margins.
WRITTEN_EVERY = 8
BINS = 32
#: Least h of a row: where a margin is that far out, its row moves no leaf.
LEAST_CURVE = 1e-6


@dataclass
class Bins:
    """Cuts of each feature; a value belongs to the bin above the cuts it reaches.  Null is ``fill``, and so is a feature that a table lacks."""

    cuts: dict[str, list[float]]
    fill: float = -1.0

    def missing(self, rows: DataFrame) -> list[str]:
        return [f for f in self.cuts if f not in rows.columns]

    def apply(self, rows: DataFrame, name: str = "bins") -> DataFrame:
        absent = set(self.missing(rows))
        plain = {f"own_{f}": F.coalesce(F.lit(None).cast("double") if f in absent else F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(self.fill)) for f in self.cuts}
        cutter = Bucketizer(inputCols=list(plain), outputCols=[f"{c}_bin" for c in plain], splitsArray=[[-float("inf"), *c, float("inf")] for c in self.cuts.values()])
        vector = VectorAssembler(inputCols=cutter.getOutputCols(), outputCol=name)
        return vector.transform(cutter.transform(rows.withColumns(plain))).drop(*plain, *cutter.getOutputCols())


def bins_of(rows: DataFrame, features: list[str], bins: int = BINS, fill: float = -1.0) -> Bins:
    """At most ``bins`` bins for each feature, by approximate quantiles of ``rows``; one pass for all features."""
    if not features:
        raise ValueError("no features to train on")
    known = [f for f in features if f in rows.columns]
    plain = rows.select(*[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(fill)).alias(f) for f in known])
    found = plain.approxQuantile(known, [k / bins for k in range(1, bins)], 0.2 / bins) if known else []
    return Bins({f: [0.0] for f in features} | {f: sorted(set(q)) or [0.0] for f, q in zip(known, found)}, fill)


@dataclass
class Boosted:
    """The trees of the best round, each times the step, over ``bins``; ``losses`` are those of ``val`` before the first tree and after each."""

    bins: Bins
    offset: str | None
    base: float
    model: GBTRegressionModel | None
    losses: list[float] = field(default_factory=list)

    @property
    def trees(self) -> int:
        return self.model.getNumTrees if self.model else 0

    def margin(self, rows: DataFrame, name: str = "margin") -> DataFrame:
        """``rows`` with the log odds; a missing offset counts as ``base``."""
        start = F.coalesce(F.col(self.offset), F.lit(self.base)) if self.offset else F.lit(self.base)
        if not self.model:
            return rows.withColumn(name, start)
        return self.model.setFeaturesCol("own_bins").setPredictionCol("own_sum").transform(self.bins.apply(rows, "own_bins")).withColumn(name, start + F.col("own_sum")).select(*[c for c in rows.columns if c != name], name)

    def score(self, rows: DataFrame, name: str = "p") -> DataFrame:
        """``rows`` with the probability of class 1."""
        scored = self.margin(rows, "own_margin")
        return scored.withColumn(name, sigmoid(F.col("own_margin"))).select(*[c for c in rows.columns if c != name], name)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def loss_of(margin: Column, y: Column) -> Column:
    """Mean log loss, from the margin: log(1 + e^m) - y m, for any size of m."""
    return F.avg(F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))) - y * margin)


def prepared(rows: DataFrame, features: list[str], label: str, offset: str | None = None, bins: int = BINS) -> tuple[DataFrame, Bins, float]:
    """Written (bins, y, margin, valid, row) of the rows whose split is train or val, their bins, and the log odds of the labels to train on."""
    used = rows.filter(F.col("split").isin("train", "val") & F.col(label).isNotNull())
    train = used.filter("split = 'train'")
    found = bins_of(train, features, bins)
    share = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    if share is None:
        raise ValueError("no rows to train on")
    share = min(max(share, 1e-6), 1 - 1e-6)
    base = log(share / (1 - share))
    start = F.coalesce(F.col(offset).cast("double"), F.lit(base)) if offset else F.lit(base)
    ready = found.apply(used.withColumns({"y": F.col(label).cast("double"), "margin": start, "valid": F.col("split") == "val"}), "bins")
    return held(ready.select("bins", "y", "margin", "valid", F.monotonically_increasing_id().alias("row")), "bins"), found, base


def boost(table: DataFrame, bins: Bins, base: float, offset: str | None = None, rounds: int = 500, depth: int = 6, step: float = 0.05, patience: int = 20, least_weight: float = 1.0, share: float = 1.0, seed: int = 17) -> Boosted:
    """Trees over ``prepared``'s table: until ``rounds``, or ``patience`` rounds without a smaller loss on val; the rounds up to the smallest are kept, one at least.

    ``least_weight``: the least sum of h in a leaf.  ``share`` of the rows to
    train on is drawn anew for each round, by a hash of row and round.
    Without rows to validate on, all rounds are kept.
    """
    spark, p = table.sparkSession, sigmoid(F.col("margin"))
    curve = F.greatest(p * (1 - p), F.lit(LEAST_CURVE))
    here, trees, losses, best, model = table, [], [], 0, None
    while True:
        # One job: the loss of what there is, and the weights of the next round.
        loss, weight = here.agg(loss_of(F.when(F.col("valid"), F.col("margin")), F.col("y")), F.sum(F.when(~F.col("valid"), curve))).first()
        losses.append(loss)
        if loss is not None and len(trees) > 1 and loss < losses[best] or len(trees) == 1:
            best = len(trees)
        if loss is None:
            best = len(trees)
        if len(trees) >= rounds or len(trees) - best >= patience or not weight:
            break
        drawn = here.filter(~F.col("valid"))
        if share < 1:
            drawn = drawn.filter(F.pmod(F.xxhash64("row", F.lit(len(trees)), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
        ready = drawn.select("bins", ((F.col("y") - p) / curve).alias("own_target"), curve.alias("own_weight"))
        fit = DecisionTreeRegressor(featuresCol="bins", labelCol="own_target", weightCol="own_weight", predictionCol="own_step", maxDepth=depth, maxBins=max(2, max((len(c) + 1 for c in bins.cuts.values()), default=2)), minWeightFractionPerNode=min(0.49, least_weight / (weight * share)), seed=seed)
        tree = fit.fit(ready)
        trees.append(tree)
        here = tree.transform(here).withColumn("margin", F.col("margin") + F.lit(step) * F.col("own_step")).drop("own_step")
        if len(trees) % WRITTEN_EVERY == 0:
            here = held(here, "margins")
    if best:
        kept = trees[:best]
        array = spark._sc._gateway.new_array(spark._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, best)
        weights = spark._sc._gateway.new_array(spark._jvm.double, best)
        for k, tree in enumerate(kept):
            array[k], weights[k] = tree._java_obj, float(step)
        model = GBTRegressionModel(spark._jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"boosted_{seed}", array, weights))
    return Boosted(bins, offset, base, model, losses)


def train(rows: DataFrame, features: list[str], label: str, offset: str | None = None, bins: int = BINS, **setting) -> Boosted:
    """Bins, then ``boost`` with ``setting``; rows whose label is null are left out."""
    table, found, base = prepared(rows, features, label, offset, bins)
    return boost(table, found, base, offset, **setting)


def sweep(rows: DataFrame, features: list[str], label: str, settings: list[dict], subset: Column, by: str, offset: str | None = None, at_once: int = 3, clock: Callable[[], float] | None = None) -> tuple[DataFrame, list[Boosted]]:
    """Test metrics by ``by`` of each setting, its trees, and whether it has the least log loss on the subset of val; and the models.

    Features are binned and written once; up to ``at_once`` settings are
    fitted at the same time, so that small stages of one fill the cores that
    another leaves idle.  Of equal losses the first setting is chosen.
    ``clock`` adds the seconds that each fit took.
    """
    table, bins, base = prepared(rows, features, label, offset)

    def fit(setting: dict) -> tuple[Boosted, float | None]:
        began = clock() if clock else 0.0
        return boost(table, bins, base, offset, **setting), clock() - began if clock else None

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        fitted = list(pool.map(fit, settings))
    y, judged = F.col(label).cast("double"), rows.filter(F.col("split").isin("val", "test") & F.col(label).isNotNull())
    scored = judged.select("split", F.col(by).alias("own_by"), y.alias("own_y"), subset.alias("own_subset"), *{c for c in (*features, offset) if c in rows.columns})
    for k, (model, _) in enumerate(fitted):
        scored = model.score(scored, f"own_p{k}")
    # All settings' probabilities stand in one table; its metrics are one aggregate over long rows.
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("setting"), F.col(f"own_p{k}").alias("p")) for k in range(len(settings))])).alias("x")
    long = held(scored.select("split", "own_by", "own_y", "own_subset", each).select("split", "own_by", "own_y", "own_subset", "x.*"), "scored")
    p = clip(F.col("p"), 1e-15, 1 - 1e-15)
    losses = long.filter("split = 'val' AND own_subset").groupBy("setting").agg(F.avg(-F.when(F.col("own_y") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss")).collect()
    chosen = min(((r.loss, r.setting) for r in losses if r.loss is not None), default=(None, -1))[1]
    facts = {k: (m.trees, s) for k, (m, s) in enumerate(fitted)}
    out = long.filter("split = 'test'").groupBy("setting", F.col("own_by").alias(by)).agg(*metric_columns(F.col("p"), F.col("own_y")))
    pick = lambda at, kind: F.coalesce(*[F.when(F.col("setting") == k, F.lit(v[at]).cast(kind)) for k, v in facts.items()])
    out = out.withColumns({"trees": pick(0, "int"), "chosen": F.col("setting") == F.lit(chosen)} | ({"seconds": pick(1, "double")} if clock else {}))
    return out, [m for m, _ in fitted]
