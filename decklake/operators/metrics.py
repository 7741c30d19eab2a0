"""Evaluation of predicted probabilities: ``p`` against a 0/1 label ``y``.

Every report is one grouped aggregate; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import clip
from .ranks import average_ranks, positions, quantiles, ranked_values


def log_loss(p: Column, y: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def metric_columns(p: Column, y: Column) -> list[Column]:
    """n, mean_p, actual, gap, log_loss, brier, accuracy (p >= 0.5 predicts 1)."""
    hit = F.when(p >= 0.5, y).otherwise(1 - y)
    return [F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("actual"), (F.avg(p) - F.avg(y)).alias("gap"), log_loss(p, y).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(hit).alias("accuracy")]


def grouped_metrics(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(F.col(p), F.col(y)))


def in_slices(df: DataFrame, slices: dict[str, Column], name: str = "slice") -> DataFrame:
    """One row for each slice that a row is in; a null predicate is not in."""
    marks = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(label)) for label, cond in slices.items()])
    return df.withColumn(name, F.explode(F.array_compact(marks)))


def slice_metrics(df: DataFrame, p: str, y: str, slices: dict[str, Column]) -> DataFrame:
    """Metrics of every slice, empty ones with n = 0 and nulls."""
    listed = df.sparkSession.createDataFrame([(s,) for s in slices], "slice string")
    found = grouped_metrics(in_slices(df, slices), p, y, ["slice"])
    return F.broadcast(listed).join(found, "slice", "left").fillna(0, ["n"])


def grouping_set_metrics(df: DataFrame, p: str, y: str, dimensions: list[str]) -> DataFrame:
    """Metrics by each dimension alone and overall, in one pass: (family, value, metrics)."""
    families = [F.struct(F.lit("all").alias("family"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("family"), F.coalesce(F.col(d).cast("string"), F.lit("<null>")).alias("value")) for d in dimensions]]
    return df.select(F.col(p), F.col(y), F.explode(F.array(*families)).alias("f")).groupBy("f.family", "f.value").agg(*metric_columns(F.col(p), F.col(y)))


def quantile_bins(df: DataFrame, p: str, bins: int, name: str = "bin") -> DataFrame:
    """Bins between exact quantiles, equal edges merged; a value on an inner edge belongs to the lower bin."""
    edges = quantiles(df, p, [i / bins for i in range(bins + 1)], name="e").select(F.array_distinct("e").alias("edges"))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.size(F.filter(inner, lambda e: e < F.col(p)))).drop("edges")  # one row of edges


def reliability(df: DataFrame, p: str, y: str, name: str = "bin", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), name).agg(F.count("*").alias("n"), F.min(p).alias("p_lo"), F.max(p).alias("p_hi"), F.avg(p).alias("mean_p"), F.avg(y).alias("actual"), (F.avg(p) - F.avg(y)).alias("diff"))


def equal_count_bins(df: DataFrame, p: str, ties: list[str], bins: int, name: str = "bin") -> DataFrame:
    """Bins of sorted positions with edges floor(i * n / bins)."""
    placed = positions(df, p, ties)
    total = df.agg(F.count("*").alias("total"))
    # The bin whose edges hold the position: the largest b with floor(b * n / bins) <= position.
    b = F.floor(((F.col("position") + 1) * bins - 1) / F.col("total")).cast("int")
    return placed.crossJoin(F.broadcast(total)).withColumn(name, b).drop("position", "total")


def equal_width_bins(df: DataFrame, p: str, width: float, name: str = "bin") -> DataFrame:
    last = round(1 / width) - 1
    return df.withColumn(name, F.least(F.floor(F.col(p) / F.lit(width) + 1e-9), F.lit(last)).cast("int"))


def calibration_error(table: DataFrame, least_share: float = 0.0) -> DataFrame:
    """(ece, mce) of a reliability table; the maximum over bins of at least ``least_share`` of the rows."""
    total = table.agg(F.sum("n").alias("total"))
    rows = table.crossJoin(F.broadcast(total))
    gap = F.abs(F.col("mean_p") - F.col("actual"))
    return rows.agg(F.sum(gap * F.col("n") / F.col("total")).alias("ece"), F.max(F.when(F.col("n") >= F.col("total") * least_share, gap)).alias("mce"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts of a cross table with margins (ALL), as rows; missing cells are 0."""
    named = df.select(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted"))
    counted = named.cube("actual", "predicted").agg(F.count("*").alias("n"), F.grouping("actual").alias("ga"), F.grouping("predicted").alias("gp"))
    cells = counted.select(F.when(F.col("ga") == 1, "ALL").otherwise(F.coalesce("actual", F.lit("<null>"))).alias("actual"), F.when(F.col("gp") == 1, "ALL").otherwise(F.coalesce("predicted", F.lit("<null>"))).alias("predicted"), "n")
    grid = cells.select("actual").distinct().crossJoin(F.broadcast(cells.select("predicted").distinct()))  # labels only
    return grid.join(cells, ["actual", "predicted"], "left").fillna(0, ["n"])


def threshold_sweep(df: DataFrame, p: str, won: str, thresholds: list[float]) -> DataFrame:
    """For each threshold: rows and win rate at or above, and below it.

    Rows are first added up between neighbouring thresholds; the running sums
    go over these few.
    """
    edges = F.array(*map(F.lit, thresholds))
    step = F.size(F.filter(edges, lambda e: e <= F.col(p)))
    sums = df.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.col(won).cast("long")).alias("w"))
    table = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(thresholds)], "i int, threshold double")
    # Both tables have at most one row a threshold.
    joined = F.broadcast(table).join(F.broadcast(sums), F.lit(True), "left")
    above, below = F.col("step") > F.col("i"), F.col("step") <= F.col("i")
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    out = joined.groupBy("threshold").agg(total(above, "n").alias("n_above"), total(below, "n").alias("n_below"), total(above, "w").alias("w_above"), total(below, "w").alias("w_below"))
    return out.select("threshold", "n_above", "n_below", F.try_divide("w_above", "n_above").alias("wr_above"), F.try_divide("w_below", "n_below").alias("wr_below"))


def break_even(sweep: DataFrame, baseline: float, least: int = 100) -> DataFrame:
    """The first threshold below which enough rows win at least at the baseline."""
    return sweep.filter((F.col("wr_below") >= baseline) & (F.col("n_below") >= least)).agg(F.min("threshold").alias("break_even"))


def auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Area under the curve from average ranks; null if there is one class only."""
    return grouped_auc(df, p, y, [])


def grouped_auc(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """Area under the curve of each group, ties counting half."""
    values = ranked_values(df, p, by, ones=F.sum(y))
    sums = values.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2).groupBy(*by).agg(F.sum(F.col("rank") * F.col("ones")).alias("r"), F.sum("ones").cast("double").alias("a"), F.sum("n").cast("double").alias("n"))
    return sums.select(*by, F.try_divide(F.col("r") - F.col("a") * (F.col("a") + 1) / 2, F.col("a") * (F.col("n") - F.col("a"))).alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks."""
    left = average_ranks(df, a, "rank_a").select(a, "rank_a")
    right = average_ranks(df, b, "rank_b").select(b, "rank_b")
    return df.select(a, b).join(left, a).join(right, b).agg(F.corr("rank_a", "rank_b").alias("spearman"))


def rate_threshold(df: DataFrame, p: str, rate: float) -> DataFrame:
    """The k-th smallest p (from 0), with k = round(rate * n)."""
    k = F.least(F.floor(F.col("total") * rate + 0.5), F.col("total") - 1)
    held = ranked_values(df, p).filter((F.col("before") <= k) & (k < F.col("before") + F.col("n")))
    return held.select(F.col(p).alias("threshold"), k.alias("k"))
