"""Queries: splits, baseline, boosted trees, calibration, the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import numbers as N
from ..operators import boosting as B, metrics as M, models as L
from ..sources.adapters import Tables
from ..sources.materialise import held
from .evaluation import rounded
from .registry import query

UNIT = "CAST('0x' || substr(sha256(concat('17:', draft_id)), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE"
FEATURES = ["p_base", "arm_keep", "arm_mull", "on_play", "opp_mulligans", "win_rate"]
#: Rounds of the registered models; a production model has 500 of depth 6 at 0.05, with a patience of 20.
SMALL = {"rounds": 10, "depth": 3, "step": 0.2, "patience": 4}


@query("j3_draft_split", f"WITH u AS (SELECT *, {UNIT} AS u FROM decisions) SELECT CASE WHEN u < 0.1 THEN 'val' WHEN u < 0.15 THEN 'calib' WHEN u < 0.3 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT draft_id) AS drafts FROM u GROUP BY 1")
def draft_split(t: Tables) -> DataFrame:
    rows = t.decisions.withColumn("split", L.split_of(F.col("draft_id"), 0.1, 0.15, 0.05))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("draft_id").alias("drafts"))


@query("j3b_three_way_split", f"WITH u AS (SELECT DISTINCT draft_id, {UNIT} AS u FROM decisions) SELECT draft_id, CASE WHEN u < 0.1 THEN 'val' WHEN u < 0.25 THEN 'test' ELSE 'train' END AS split FROM u")
def three_way(t: Tables) -> DataFrame:
    return t.decisions.select("draft_id").distinct().select("draft_id", L.split_of(F.col("draft_id"), 0.1, 0.15).alias("split"))


def split_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with their split, written once: what is fitted on them reads them several times, and they come from a join."""
    return L.checked_split(held(rows.withColumn("split", L.split_of(F.col("draft_id"), 0.15, 0.2, 0.1)), "decisions"), F.col("split"))


def with_margin(t: Tables) -> DataFrame:
    rows = t.decisions.withColumns({"wr": N.win_rate_label(F.col("win_rate")), "ng": N.n_games_label(F.col("n_games")), "label": F.col("won").cast("int")})
    rows = split_rows(rows)
    known = rows.filter("split = 'train'")
    return held(L.baseline_margin(L.baseline(known, ["wr", "ng", "on_play"], "opp_mulligans", "label"), rows, ["wr", "ng", "on_play"], "opp_mulligans"), "margins")


@query("j1_baseline")
def baseline(t: Tables) -> DataFrame:
    """Margins of each cell; they follow the cell's own log odds."""
    return rounded(with_margin(t).groupBy("wr", "ng", "on_play", "opp_mulligans").agg(F.avg("margin").alias("margin"), F.count("*").alias("n")), digits=4)


def explained(rows: DataFrame) -> DataFrame:
    """``rows`` with ``better``, drawn by a hash with the odds that both arms, and who begins, give it: a label that features can explain."""
    z = (F.col("arm_keep") - F.col("arm_mull")) * F.when(F.col("on_play"), 6.0).otherwise(2.0) + F.coalesce("win_rate", F.lit(0.5)) - 0.5
    return rows.withColumn("better", (N.hash_unit(F.concat(F.lit("better:"), F.col("game_id").cast("string"))) < B.sigmoid(z)).cast("int"))


@query("j4_win_model")
def win_model(t: Tables) -> DataFrame:
    """Metrics on each split of trees boosted from the baseline's margin, and of the margin alone (no trees); how many trees patience left."""
    rows = with_margin(t)
    model = B.train(rows, FEATURES, "won", offset="margin", **SMALL)
    scored = model.score(rows).withColumn("alone", B.sigmoid(F.col("margin")))
    both = F.explode(F.array(F.struct(F.lit(model.trees).alias("trees"), F.col("p").alias("q")), F.struct(F.lit(0).alias("trees"), F.col("alone").alias("q")))).alias("x")
    return rounded(M.grouped_metrics(scored.select("split", "label", both).select("split", "label", "x.*"), "q", "label", ["split", "trees"]), digits=4)


@query("j4b_explained_model")
def explained_model(t: Tables) -> DataFrame:
    """The same over a label that the features explain: each round lowers the loss on val, so patience keeps more than one tree."""
    rows = explained(with_margin(t))
    model = B.train(rows, FEATURES, "better", **SMALL)
    return rounded(M.grouped_metrics(model.score(rows), "p", "better", ["split"]).withColumn("trees", F.lit(model.trees)), digits=4)


@query("j5_j6_choice_model")
def choice_model(t: Tables) -> DataFrame:
    """Keep probability of each decision, with a feature that the data lacks."""
    rows = with_margin(t)
    model = B.train(rows, [*FEATURES, "margin", "not_there"], "was_kept", **SMALL)
    return model.score(rows).select("game_id", "split", F.round("p", 4).alias("p"), N.banded(F.col("p")).alias("verdict"), F.lit(model.trees).alias("trees"))


@query("j7_j8_j9_calibration")
def calibration(t: Tables) -> DataFrame:
    """Raw, Platt-scaled and isotonic probabilities, fitted on one split and compared on another."""
    rows = split_rows(t.decisions.select("draft_id", "p_keep", F.col("was_kept").cast("int").alias("y")))
    fit, test = rows.filter("split IN ('train', 'calib')"), rows.filter("split = 'test'")
    out = L.platt(fit, "p_keep", "y")(test)
    out = L.isotonic(fit, "p_keep", "y")(out)
    out = out.withColumn("p_clamped", N.clip(F.col("p_isotonic"), 0.02, 0.98))  # the same fit within a narrower range
    return rounded(L.compare_calibrations(out, {"raw": "p_keep", "platt": "p_platt", "isotonic": "p_isotonic", "clamped": "p_clamped"}, "y"), digits=4)


@query("j10_sweep")
def sweep(t: Tables) -> DataFrame:
    """Settings compared on shared bins; the one that is chosen has the least log loss on first decisions of validation."""
    settings = [{"rounds": 6, "depth": d, "step": s, "patience": 3, "least_weight": w, "share": q} for d, s, w, q in ((3, 0.3, 1, 0.8), (3, 0.3, 5, 1.0), (2, 0.2, 5, 0.8))]
    return rounded(B.sweep(explained(with_margin(t)), FEATURES, "better", settings, F.col("mulligan_number") == 0, "event_type")[0], digits=4)


REPLAY = """
WITH e AS (SELECT user_id, ts, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS n FROM events WHERE event_type <> 'error'),
s AS (SELECT *, count(*) FILTER (WHERE kind NOT IN ('purchase', 'click', 'view')) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS game FROM e),
m AS (
  SELECT *, lag(n % 190) OVER (PARTITION BY user_id, kind ORDER BY ts) AS before_deck, last_value(CASE WHEN kind = 'purchase' THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS deck,
    first_value(CASE WHEN kind IN ('click', 'view') THEN n % 2 END IGNORE NULLS) OVER (PARTITION BY user_id, game ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first,
    lag((n % 3) * 1000 + n * 3 % 210) OVER (PARTITION BY user_id, game, kind ORDER BY ts) AS before_mark, (n % 3) * 1000 + n * 3 % 210 AS mark
  FROM s),
o AS (
  SELECT user_id, ts, kind, n, deck, first,
    CASE WHEN kind NOT IN ('purchase', 'click', 'view') THEN 'match_ended' WHEN kind = 'purchase' AND before_deck IS DISTINCT FROM n % 190 THEN 'deck_submitted'
      WHEN kind = 'view' AND before_mark IS DISTINCT FROM mark THEN CASE WHEN deck IS NULL THEN 'no_deck' ELSE 'decision' END END AS what FROM m),
c AS (SELECT max(card_id) AS most FROM (SELECT p_partkey AS card_id FROM part))
SELECT CAST(user_id AS VARCHAR) AS source, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, what,
  CASE WHEN kind = 'view' THEN n % 3 END AS mulligan_count, CASE WHEN kind = 'view' THEN first = 0 END AS on_the_play, CASE WHEN kind = 'view' AND first = 1 THEN n % 2 END AS opp_mulligan_count,
  CASE WHEN kind = 'view' THEN 7 ELSE 0 END AS hand_size, CASE WHEN what IN ('decision', 'deck_submitted') THEN 36 ELSE 0 END AS deck_size
FROM o, c WHERE what IS NOT NULL
"""


def _summary(found: DataFrame) -> DataFrame:
    what = F.when(F.col("what").endswith("_unresolved"), "decision").otherwise(F.col("what"))
    return found.select("source", "at", what.alias("what"), "mulligan_count", "on_the_play", "opp_mulligan_count", F.coalesce(F.size("hand"), F.lit(0)).alias("hand_size"), F.coalesce(F.size("deck"), F.lit(0)).alias("deck_size"))


def _catalogue(t: Tables) -> DataFrame:
    return t.cards.select(F.col("card_id").cast("int").alias("id"), "name")


@query("s1_s9_live_decisions", REPLAY)
def live_decisions(t: Tables) -> DataFrame:
    """The event table as log files, tailed as a stream until all is processed: a row for each typed decision."""
    from ..streaming import log

    return _summary(log.live(log.logs_of_events(t.events), _catalogue(t)))


@query("s9_batch_replay", REPLAY)
def batch_replay(t: Tables) -> DataFrame:
    """The same logs as a finished table."""
    from ..streaming import log

    return _summary(log.replay(log.logs_of_events(t.events), _catalogue(t)))
