"""Models on small tables whose answers are known."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from decklake.operators import boosting as B, metrics as M, models as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(3000):
        a, b = rng.random(), rng.random()
        true = 1 / (1 + math.exp(-(6 * a - 3) * (1 if b > 0.5 else -1)))
        out.append((f"d{i // 5}", i, a, b, 0.5 + (true - 0.5) / 2, int(rng.random() < true), i % 3))
    df = spark.createDataFrame(out, "draft_id string, game_id int, a double, b double, squeezed double, y int, mulligan_number int").repartition(4)
    return L.checked_split(df, L.split_of(F.col("draft_id"), 0.15, 0.2, 0.1))


def test_trees_learn_an_interaction(rows):
    features = ["a", "b", "not_there"]
    model = B.train(rows, features, "y", rounds=16, depth=6, step=0.2, least_weight=15)
    assert 4 <= model.trees <= 16 and model.losses[model.trees] == min(model.losses[1:])
    scored = model.score(rows.filter("split = 'test'"))
    assert scored.columns == [*rows.columns, "p"]
    assert M.auc(scored, "p", "y").first().auc > 0.78 > 0.6 > M.auc(scored, "a", "y").first().auc
    assert model.bins.missing(rows) == ["not_there"]
    assert set(L.feature_columns(rows)) == {"a", "b", "squeezed", "y"}
    assert model.losses[model.trees] == pytest.approx(loss(model.score(rows.filter("split = 'val'")), "p"), abs=1e-9)


def test_boosting_starts_from_the_margin(rows):
    """Before the first tree the prediction is the margin; where the margin is the truth, trees add next to nothing."""
    truth = rows.withColumn("m", (6 * F.col("a") - 3) * F.when(F.col("b") > 0.5, 1).otherwise(-1))
    none = B.train(truth, ["a", "b"], "y", offset="m", rounds=0)
    assert none.trees == 0
    got = none.score(truth).select(F.max(F.abs(F.col("p") - B.sigmoid(F.col("m"))))).first()[0]
    assert got < 1e-12
    assert none.losses[0] == pytest.approx(loss(none.score(truth.filter("split = 'val'")), "p"))
    some = B.train(truth, ["a", "b"], "y", offset="m", rounds=3, depth=2, step=0.1)
    moved = some.score(truth).select(F.avg(F.abs(F.col("p") - B.sigmoid(F.col("m"))))).first()[0]
    plain = B.train(truth, ["a", "b"], "y", rounds=3, depth=2, step=0.1)
    assert some.losses[0] < plain.losses[0] - 0.1 and 0 < moved < 0.03
    hole = truth.withColumn("m", F.when(F.col("game_id") % 7 > 0, F.col("m")))
    assert B.train(hole, ["a"], "y", offset="m", rounds=1).score(hole).filter("p is null").count() == 0


def test_a_leaf_is_a_newton_step(spark):
    """One split at a known place: leaves are the sums of y - p over those of h."""
    data = [(f"d{i}", float(i % 2), int(i % 10 < (8 if i % 2 else 2)), -0.5, "train" if i % 5 else "val") for i in range(1000)]
    df = spark.createDataFrame(data, "draft_id string, x double, y int, m double, split string")
    model = B.train(df, ["x"], "y", offset="m", rounds=1, depth=1, step=1.0)
    p = 1 / (1 + math.exp(0.5))
    for r in model.margin(df, "out").filter("split = 'train'").groupBy("x").agg(F.avg("y").alias("rate"), F.avg("out").alias("out")).collect():
        assert r.out == pytest.approx(-0.5 + (r.rate - p) / (p * (1 - p)))


def test_patience_outlasts_noise(spark):
    """A first round that makes val worse, then gain: stopping at once would keep one tree."""
    rng = random.Random(1)
    data = []
    for i in range(4000):
        x = rng.random()
        valid = i % 4 == 0
        y = int(rng.random() < (0.9 if x > 0.7 else 0.1 if x < 0.3 else 0.5))
        # To val rows, a feature that looks best at first says the opposite.
        data.append((f"d{i}", x, float(y if rng.random() < 0.95 else 1 - y) * (i < 3400) if not valid else float(1 - y if rng.random() < 0.35 else y), y, "val" if valid else "train"))
    df = spark.createDataFrame(data, "draft_id string, x double, trap double, y int, split string")
    hasty, patient = (B.train(df, ["x", "trap"], "y", rounds=10, depth=2, step=1.0, patience=k) for k in (1, 9))
    assert len(patient.losses) == 11 and patient.losses[patient.trees] == min(patient.losses[1:]) <= min(hasty.losses[1:])
    assert hasty.trees <= patient.trees and len(hasty.losses) <= len(patient.losses)
    stop = next((k for k in range(2, len(hasty.losses)) if hasty.losses[k] >= min(hasty.losses[1:k])), None)
    assert stop is None or len(hasty.losses) == stop + 1


def test_patience_counts_rounds_without_gain(monkeypatch, rows):
    """The rule on given losses: the best prefix is kept, twenty rounds later it stops."""
    given = iter([0.7, 0.69, 0.70, 0.71, 0.68, *[0.69] * 40])
    monkeypatch.setattr(B, "loss_of", lambda m, y: F.lit(next(given)))
    model = B.train(rows, ["a"], "y", rounds=40, depth=1, step=0.01, patience=5)
    assert model.trees == 4 and len(model.losses) == 4 + 5 + 1


def loss(df, p):
    return df.agg(M.log_loss(F.col(p), F.col("y"))).first()[0]


def test_calibration_undoes_a_squeeze(rows):
    fit, test = rows.filter("split IN ('train', 'calib')"), rows.filter("split = 'test'")
    out = L.isotonic(fit, "squeezed", "y", "p_clamped", 0.1, 0.9)(L.isotonic(fit, "squeezed", "y")(L.platt(fit, "squeezed", "y")(test)))
    raw = loss(out, "squeezed")
    assert loss(out, "p_platt") < raw - 0.02 and loss(out, "p_isotonic") < raw - 0.02
    held = sorted((r.squeezed, r.p_platt, r.p_isotonic, r.p_clamped) for r in out.collect())
    for k in (1, 2, 3):
        assert all(x[k] <= y[k] + 1e-12 for x, y in zip(held, held[1:]))
    assert min(r[3] for r in held) >= 0.1 and max(r[3] for r in held) <= 0.9
    table = {r.method: r for r in L.compare_calibrations(out, {"raw": "squeezed", "clamped": "p_clamped"}, "y").collect()}
    assert table["raw"].n == table["clamped"].n == len(held) and table["clamped"].above_98 == 0
    assert table["raw"].log_loss == pytest.approx(raw) and table["raw"].below_02 == sum(r[0] < 0.02 for r in held)


def test_calibration_fits_on_counts(spark, monkeypatch):
    """Fits see a row a probability and label, however many rows have them, and give what the rows give."""
    data = [(k / 10, int((i * 7 + k) % 11 < k)) for k in range(1, 10) for i in range(40 * k)]
    df = spark.createDataFrame(data, "p double, y int")
    seen = []
    for kind in (L.LogisticRegression, L.IsotonicRegression):
        monkeypatch.setattr(kind, "fit", lambda self, rows, *a, f=kind.fit: seen.append(rows.count()) or f(self, rows, *a))
    out = L.isotonic(df, "p", "y")(L.platt(df, "p", "y")(df)).distinct().orderBy("p").collect()
    assert len(seen) == 2 and max(seen) <= 18
    rate = {k / 10: sum(y for p, y in data if p == k / 10) / (40 * k) for k in range(1, 10)}
    assert sorted(rate.values()) == list(rate.values())
    for r in out:
        assert r.p_isotonic == pytest.approx(rate[r.p])
    # At the optimum, residuals and their products with the logit sum to nothing.
    fitted = {r.p: r.p_platt for r in out}
    assert abs(sum(y - fitted[p] for p, y in data)) < 0.1 and abs(sum((y - fitted[p]) * math.log(p / (1 - p)) for p, y in data)) < 0.2


def test_sweep_takes_the_least_loss(rows):
    settings = [{"rounds": 1, "depth": 1}, {"rounds": 8, "depth": 3, "step": 0.3}, {"rounds": 8, "depth": 3, "step": 0.3, "share": 0.5, "least_weight": 40}]
    table, models = B.sweep(rows, ["a", "b"], "y", settings, F.col("mulligan_number") == 0, "mulligan_number", clock=time.time)
    out = table.collect()
    assert len(out) == 9 and len({r.setting for r in out if r.chosen}) == 1 and 0 not in {r.setting for r in out if r.chosen}
    assert sum(r.log_loss for r in out if r.setting == 1) < sum(r.log_loss for r in out if r.setting == 0)
    assert all(r.trees == models[r.setting].trees and r.seconds > 0 for r in out)
    # Settings fitted at the same time give what each gives alone.
    alone = B.train(rows, ["a", "b"], "y", **settings[1])
    assert alone.losses == pytest.approx(models[1].losses)


def test_no_draft_is_in_two_splits(rows):
    assert rows.groupBy("draft_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        L.split_of(F.col("draft_id"), 0.5, 0.5)
    with pytest.raises(ValueError):
        L.checked_split(rows.limit(0), F.lit("val"))


def test_margins_are_log_odds_of_cells(spark):
    rng = random.Random(9)
    rates = {("x", True): 0.4, ("x", False): 0.38, ("y", True): 0.62, ("y", False): 0.58}
    data = [(w, p, 0, int(rng.random() < r)) for (w, p), r in rates.items() for _ in range(1500)]
    df = spark.createDataFrame(data, "wr string, play boolean, opp int, won int")
    got = L.baseline_margin(L.baseline(df, ["wr", "play"], "opp", "won"), df, ["wr", "play"], "opp")
    for r in got.groupBy("wr", "play").agg(F.avg("margin").alias("m"), F.avg("won").alias("rate")).collect():
        assert abs(r.m - math.log(r.rate / (1 - r.rate))) < 0.2
