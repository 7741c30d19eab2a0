"""Models as Spark ML jobs: splits, baseline, calibration; boosted trees are in ``boosting``."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import clip, hash_unit, logit
from .metrics import metric_columns

#: Columns of a feature table that are no features.
NOT_FEATURES = frozenset({"draft_id", "game_id", "match_number", "game_number", "mulligan_number", "expansion", "event_type", "won", "was_kept", "split", "label", "wr", "ng", "player_rank"})


def split_of(draft: Column, val: float, test: float, calib: float = 0.0, seed: int = 17) -> Column:
    """val, calib, test or train by the draft's hash: all rows of a draft go together, without a shuffle."""
    if min(val, test, calib) < 0 or val + test + calib >= 1:
        raise ValueError("the fractions leave nothing to train on")
    u = hash_unit(F.concat(F.lit(f"{seed}:"), draft))
    return F.when(u < val, "val").when(u < val + calib, "calib").when(u < val + calib + test, "test").otherwise("train")


def checked_split(rows: DataFrame, split: Column, name: str = "split") -> DataFrame:
    out = rows.withColumn(name, split)
    if out.filter(F.col(name) == "train").isEmpty():
        raise ValueError("no rows to train on")
    return out


def baseline(rows: DataFrame, cell: list[str], other: str, label: str, c: float = 10.0) -> PipelineModel:
    """Logistic regression on one indicator for each cell and each value of ``other``; the ridge leaves out the intercept.

    The objective here is a mean, so the ridge is 1 / (c * rows).
    """
    n = rows.count()
    cells = [StringIndexer(inputCol="own_cell", outputCol="own_cell_i", handleInvalid="keep"), StringIndexer(inputCol="own_other", outputCol="own_other_i", handleInvalid="keep")]
    hot = OneHotEncoder(inputCols=["own_cell_i", "own_other_i"], outputCols=["own_cell_v", "own_other_v"], dropLast=False)
    fit = LogisticRegression(featuresCol="own_x", labelCol=label, regParam=1 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, rawPredictionCol="own_raw", probabilityCol="own_p", predictionCol="own_y")
    stages = [*cells, hot, VectorAssembler(inputCols=["own_cell_v", "own_other_v"], outputCol="own_x"), fit]
    return Pipeline(stages=stages).fit(_cells(rows, cell, other))


def _cells(rows: DataFrame, cell: list[str], other: str) -> DataFrame:
    return rows.withColumns({"own_cell": F.concat_ws("|", *[F.col(c).cast("string") for c in cell]), "own_other": F.col(other).cast("string")})


def baseline_margin(model: PipelineModel, rows: DataFrame, cell: list[str], other: str, name: str = "margin") -> DataFrame:
    """``rows`` with the model's log odds."""
    scored = model.transform(_cells(rows, cell, other))
    return scored.withColumn(name, vector_to_array("own_raw")[1]).select(*rows.columns, name)


def feature_columns(rows: DataFrame) -> list[str]:
    return [c for c, kind in rows.dtypes if c not in NOT_FEATURES and kind in ("double", "int", "bigint", "float", "boolean")]


def _counted(rows: DataFrame, p: str, label: str) -> DataFrame:
    """(``p``, own_label, own_n): how many rows have a probability and a label; a fit with these weights is that of the rows."""
    return rows.groupBy(p, F.col(label).cast("double").alias("own_label")).agg(F.count("*").cast("double").alias("own_n"))


def platt(rows: DataFrame, p: str, label: str, name: str = "p_platt"):
    """Function that adds the probability rescaled on its logit, fitted on ``rows``."""
    at = lambda df: VectorAssembler(inputCols=["own_logit"], outputCol="own_v").transform(df.withColumn("own_logit", logit(clip(F.col(p), 1e-6, 1 - 1e-6))))
    model = LogisticRegression(featuresCol="own_v", labelCol="own_label", weightCol="own_n", regParam=0.0, probabilityCol="own_p", rawPredictionCol="own_r", predictionCol="own_y").fit(at(_counted(rows, p, label)))
    return lambda df: model.transform(at(df)).withColumn(name, vector_to_array("own_p")[1]).select(*df.columns, name)


def isotonic(rows: DataFrame, p: str, label: str, name: str = "p_isotonic", low: float = 0.0, high: float = 1.0):
    """Function that adds the isotonic fit of the probability, kept within low and high."""
    model = IsotonicRegression(featuresCol=p, labelCol="own_label", weightCol="own_n", predictionCol="own_fit").fit(_counted(rows, p, label))
    return lambda df: model.transform(df).withColumn(name, clip(F.col("own_fit"), low, high)).select(*df.columns, name)


def compare_calibrations(rows: DataFrame, methods: dict[str, str], label: str) -> DataFrame:
    """Metrics and counts of extreme probabilities for each method: one aggregate over long rows."""
    entries = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("q")) for m, c in methods.items()])
    long = rows.select(F.col(label).cast("double").alias("y"), F.explode(entries).alias("e")).select("y", "e.*")
    q = F.col("q")
    return long.groupBy("method").agg(*metric_columns(q, F.col("y")), F.count_if(q == 0).alias("at_0"), F.count_if(q == 1).alias("at_1"), F.count_if(q < 0.02).alias("below_02"), F.count_if(q > 0.98).alias("above_98"))
