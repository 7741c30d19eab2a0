"""Queries: gates, labels, metrics and reports over decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import numbers as N
from ..operators import metrics as M, reports as R
from ..sources.adapters import Tables
from .registry import query

WR_LABEL = "CASE WHEN win_rate IS NULL THEN 'unknown' WHEN win_rate < 0.45 THEN '<45%' WHEN win_rate < 0.5 THEN '45-50%' WHEN win_rate < 0.55 THEN '50-55%' WHEN win_rate < 0.6 THEN '55-60%' ELSE '>=60%' END"
N_LABEL = "CASE WHEN n_games IN (1, 5) THEN '<10' WHEN n_games = 10 THEN '10-49' WHEN n_games = 50 THEN '50-99' WHEN n_games = 100 THEN '100-499' WHEN n_games IN (500, 1000) THEN '500+' ELSE 'unknown' END"
VERDICT = "CASE WHEN p_keep > 0.85 THEN 'clear_keep' WHEN p_keep > 0.65 THEN 'marginal_keep' WHEN p_keep > 0.45 THEN 'borderline' WHEN p_keep > 0.25 THEN 'marginal_mulligan' ELSE 'clear_mulligan' END"
COHORT = """CASE WHEN event_type = 'PremierDraft' AND round(win_rate, 2) >= 0.62 AND n_games >= 500 AND player_rank IN ('diamond', 'mythic') THEN 'elite'
  WHEN event_type = 'TradDraft' AND round(win_rate, 2) >= 0.68 AND n_games >= 500 THEN 'elite'
  WHEN round(win_rate, 2) BETWEEN 0.55 AND 0.61 THEN 'strong' WHEN round(win_rate, 2) BETWEEN 0.48 AND 0.54 THEN 'average' WHEN round(win_rate, 2) BETWEEN 0.40 AND 0.47 THEN 'weak' END"""


def sql_metrics(p: str, y: str) -> str:
    q = f"least(greatest({p}, 1e-7), 1 - 1e-7)"
    return f"""count(*) AS n, round(avg({p}), 6) AS mean_p, round(avg({y}), 6) AS actual, round(avg({p}) - avg({y}), 6) AS gap,
      round(avg(-({y} * ln({q}) + (1 - {y}) * ln(1 - {q}))), 6) AS log_loss, round(avg(({p} - {y}) * ({p} - {y})), 6) AS brier,
      round(avg(CASE WHEN {p} >= 0.5 THEN {y} ELSE 1 - {y} END), 6) AS accuracy"""


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order; checks compare rounded ones."""
    doubles = set(names or [c for c, kind in df.dtypes if kind == "double"])
    return df.selectExpr(*[f"round(`{c}`, {digits}) AS `{c}`" if c in doubles else f"`{c}`" for c in df.columns])


def scored(t: Tables) -> DataFrame:
    return t.decisions.withColumns({"y": F.col("was_kept").cast("int"), "w": F.col("won").cast("int")})


@query("d22_cohort_agreement", f"""
WITH x AS (SELECT *, {COHORT} AS cohort, {VERDICT} AS verdict FROM decisions WHERE mulligan_number = 0)
SELECT cohort, count(*) AS n, count(DISTINCT draft_id) AS drafts, round(avg(CASE WHEN was_kept THEN 0.0 ELSE 1.0 END), 6) AS mull_rate,
  count(*) FILTER (WHERE verdict <> 'borderline') AS judged,
  count(*) FILTER (WHERE verdict = 'clear_keep') AS clear_keep, count(*) FILTER (WHERE verdict = 'marginal_keep') AS marginal_keep,
  count(*) FILTER (WHERE verdict = 'borderline') AS borderline, count(*) FILTER (WHERE verdict = 'marginal_mulligan') AS marginal_mulligan,
  count(*) FILTER (WHERE verdict = 'clear_mulligan') AS clear_mulligan,
  round(CAST(count(*) FILTER (WHERE (verdict LIKE '%keep' AND was_kept) OR (verdict LIKE '%mulligan' AND NOT was_kept)) AS DOUBLE) / nullif(count(*) FILTER (WHERE verdict <> 'borderline'), 0), 6) AS agreement,
  count(*) FILTER (WHERE (verdict = 'marginal_keep' AND NOT was_kept) OR (verdict = 'marginal_mulligan' AND was_kept)) AS soft_disagree,
  count(*) FILTER (WHERE (verdict = 'clear_keep' AND NOT was_kept) OR (verdict = 'clear_mulligan' AND was_kept)) AS hard_disagree
FROM x WHERE cohort IS NOT NULL GROUP BY cohort""")
def cohort_agreement(t: Tables) -> DataFrame:
    rows = t.decisions.filter("mulligan_number = 0").withColumns({"cohort": R.cohort(F.col("event_type"), F.col("win_rate"), F.col("n_games"), F.col("player_rank")), "verdict": N.banded(F.col("p_keep"))})
    return rounded(R.cohort_agreement(rows.filter("cohort IS NOT NULL"), ["cohort"]))


@query("b6_b7_player_labels", f"SELECT {WR_LABEL} AS wr_label, {N_LABEL} AS n_label, count(*) AS n FROM decisions GROUP BY 1, 2")
def player_labels(t: Tables) -> DataFrame:
    return t.decisions.groupBy(N.win_rate_label(F.col("win_rate")).alias("wr_label"), N.n_games_label(F.col("n_games")).alias("n_label")).agg(F.count("*").alias("n"))


@query("b8_b9_player_filter", "SELECT game_id, (mulligan_number = 0 AND coalesce(n_games >= 100, false) AND coalesce(win_rate >= 0.55, false)) AS skilled FROM decisions WHERE NOT coalesce(n_games >= 50 AND win_rate < 0.5, false)")
def player_filter(t: Tables) -> DataFrame:
    rows = t.decisions.filter(N.keeps_player(F.col("n_games"), F.col("win_rate")))
    return rows.select("game_id", R.skilled(F.col("mulligan_number"), F.lit(7), F.col("n_games"), F.col("win_rate"), 100, 0.55).alias("skilled"))


@query("b10_elite_cohort", "SELECT game_id, event_type FROM decisions WHERE n_games >= 500 AND ((event_type = 'PremierDraft' AND win_rate >= 0.62 AND player_rank IN ('diamond', 'mythic')) OR (event_type = 'TradDraft' AND win_rate >= 0.68))")
def elite(t: Tables) -> DataFrame:
    return t.decisions.filter(R.is_elite(F.col("event_type"), F.col("win_rate"), F.col("n_games"), F.col("player_rank"))).select("game_id", "event_type")


@query("b11_cohort_assignment", f"SELECT game_id, {COHORT} AS cohort FROM decisions WHERE {COHORT} IS NOT NULL")
def cohorts(t: Tables) -> DataFrame:
    return t.decisions.select("game_id", R.cohort(F.col("event_type"), F.col("win_rate"), F.col("n_games"), F.col("player_rank")).alias("cohort")).filter("cohort IS NOT NULL")


@query("b12_verdict_bands", f"SELECT game_id, {VERDICT} AS verdict, CASE WHEN p_keep > 0.75 THEN 'keep' WHEN p_keep > 0.5 THEN 'lean_keep' WHEN p_keep > 0.25 THEN 'lean_mulligan' ELSE 'mulligan' END AS legacy FROM decisions")
def verdicts(t: Tables) -> DataFrame:
    return t.decisions.select("game_id", N.banded(F.col("p_keep")).alias("verdict"), N.banded(F.col("p_keep"), ((0.75, "keep"), (0.5, "lean_keep"), (0.25, "lean_mulligan")), "mulligan").alias("legacy"))


@query("b13_delta_verdict", "SELECT game_id, CASE WHEN d >= 0.03 THEN 'keep' WHEN d >= 0 THEN 'lean_keep' WHEN d > -0.03 THEN 'lean_mulligan' ELSE 'mulligan' END AS verdict FROM (SELECT game_id, arm_keep - (arm_mull - 0.04) AS d FROM decisions)")
def delta(t: Tables) -> DataFrame:
    return t.decisions.select("game_id", N.delta_verdict(F.col("arm_keep"), F.col("arm_mull")).alias("verdict"))


@query("b15_model_flags", "SELECT game_id, arm_keep < arm_mull + CAST(0.04 AS DOUBLE) AS win_mull, arm_keep < arm_mull AS win_mull_unbiased, p_keep < 0.5 AS choice_mull, round(arm_keep - arm_mull - CAST(0.04 AS DOUBLE), 9) AS score_win, round(p_keep - CAST(0.5 AS DOUBLE), 9) AS score_choice FROM decisions")
def flags(t: Tables) -> DataFrame:
    return rounded(R.model_flags(t.decisions, "arm_keep", "arm_mull", "p_keep").select("game_id", "win_mull", "win_mull_unbiased", "choice_mull", "score_win", "score_choice"), digits=9)


PRESETS_SQL = """
WITH f AS (SELECT *, arm_keep < arm_mull + CAST(0.04 AS DOUBLE) AS win_mull, p_keep < 0.5 AS choice_mull FROM decisions),
v AS (SELECT DISTINCT draft_id, game_id FROM decisions WHERE game_id % 20 = 0),
s AS (
  SELECT 'both_keep_player_mulled' AS preset, * FROM f WHERE NOT win_mull AND NOT choice_mull AND NOT was_kept
  UNION ALL SELECT 'both_mull_player_kept', * FROM f WHERE win_mull AND choice_mull AND was_kept
  UNION ALL SELECT 'win_mull_player_kept', * FROM f WHERE win_mull AND was_kept
  UNION ALL SELECT 'win_keep_choice_mull', * FROM f WHERE NOT win_mull AND choice_mull
  UNION ALL SELECT 'win_mull_choice_keep', * FROM f WHERE win_mull AND NOT choice_mull
  UNION ALL SELECT 'all', * FROM f
  UNION ALL SELECT 'strong', * FROM f WHERE (p_keep > 0.85 AND NOT was_kept) OR (p_keep <= 0.25 AND was_kept)
  UNION ALL SELECT 'clear_keep_mulled', * FROM f WHERE p_keep > 0.75 AND NOT was_kept)
SELECT preset, s.game_id, concat(s.draft_id, ':', CAST(s.match_number AS STRING), ':', CAST(s.game_number AS STRING), ':', CAST(s.mulligan_number AS STRING)) AS decision_key
FROM s WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.draft_id = s.draft_id AND v.game_id = s.game_id)"""


@query("b16_disagreements", PRESETS_SQL)
def disagreements(t: Tables) -> DataFrame:
    rows = R.model_flags(t.decisions, "arm_keep", "arm_mull", "p_keep").withColumn("decision_key", F.concat_ws(":", "draft_id", "match_number", "game_number", "mulligan_number"))
    votes = t.decisions.filter("game_id % 20 = 0").select("draft_id", "game_id")
    return R.disagreements(rows, votes, ["draft_id", "game_id"]).select("preset", "game_id", "decision_key")


@query("b16b_hard_disagreements", f"""
WITH x AS (SELECT *, {COHORT} AS cohort, {VERDICT} AS verdict FROM decisions WHERE mulligan_number = 0)
SELECT 'elite' AS preset, game_id FROM x WHERE cohort = 'elite' AND ((verdict = 'clear_keep' AND NOT was_kept) OR (verdict = 'clear_mulligan' AND was_kept)) AND game_id % 20 <> 0""")
def hard_disagreements(t: Tables) -> DataFrame:
    rows = t.decisions.filter("mulligan_number = 0").withColumns({"cohort": R.cohort(F.col("event_type"), F.col("win_rate"), F.col("n_games"), F.col("player_rank")), "verdict": N.banded(F.col("p_keep")), "decision_key": F.col("game_id")})
    chosen = {"elite": R.hard_disagreement("verdict", "was_kept", "cohort", "elite")}
    return R.disagreements(rows, t.decisions.filter("game_id % 20 = 0"), ["game_id"], chosen).select("preset", "game_id")


@query("b26_b27_conditional_and_vocabulary", "SELECT expansion, count(*) AS n, CAST(sum(CASE WHEN NOT on_play THEN opp_mulligans END) AS BIGINT) AS opp_on_draw FROM decisions WHERE expansion NOT IN ('BUILDING', 'MACHINERY') GROUP BY expansion ORDER BY n DESC")
def vocabulary(t: Tables) -> DataFrame:
    rows = t.decisions.withColumn("opp", F.when(~F.col("on_play"), F.col("opp_mulligans")))
    unknown = R.out_of_vocabulary(rows, "expansion", ["BUILDING", "MACHINERY"])
    return unknown.groupBy("expansion").agg(F.count("*").alias("n"), F.sum("opp").alias("opp_on_draw")).orderBy(F.desc("n"))


@query("d14_d15_slice_metrics", f"""
WITH x AS (SELECT *, CASE WHEN was_kept THEN 1 ELSE 0 END AS y FROM decisions)
SELECT event_type, on_play, {sql_metrics('p_keep', 'y')} FROM x GROUP BY event_type, on_play""")
def split_metrics(t: Tables) -> DataFrame:
    return rounded(M.grouped_metrics(scored(t), "p_keep", "y", ["event_type", "on_play"]))


@query("b29_slice_predicates", f"""
WITH x AS (SELECT *, CASE WHEN was_kept THEN 1 ELSE 0 END AS y FROM decisions), s AS (
  SELECT 'play' AS slice, * FROM x WHERE on_play UNION ALL SELECT 'draw', * FROM x WHERE NOT on_play
  UNION ALL SELECT 'first', * FROM x WHERE mulligan_number = 0 UNION ALL SELECT 'skilled', * FROM x WHERE win_rate >= 0.6
  UNION ALL SELECT 'wr unknown', * FROM x WHERE win_rate IS NULL UNION ALL SELECT 'opp 2+', * FROM x WHERE opp_mulligans >= 2)
SELECT slice, {sql_metrics('p_keep', 'y')} FROM s GROUP BY slice
UNION ALL SELECT 'none', 0, NULL, NULL, NULL, NULL, NULL, NULL""")
def slices(t: Tables) -> DataFrame:
    c = F.col
    listed = {"play": c("on_play"), "draw": ~c("on_play"), "first": c("mulligan_number") == 0, "skilled": c("win_rate") >= 0.6, "wr unknown": c("win_rate").isNull(), "opp 2+": c("opp_mulligans") >= 2, "none": c("p_keep") > 2}
    return rounded(M.slice_metrics(scored(t), "p_keep", "y", listed))


@query("d25_g4_slice_families", f"""
WITH x AS (SELECT *, CASE WHEN was_kept THEN 1 ELSE 0 END AS y FROM decisions), f AS (
  SELECT 'all' AS family, 'all' AS value, p_keep, y FROM x UNION ALL SELECT 'expansion', expansion, p_keep, y FROM x
  UNION ALL SELECT 'mulligan_number', CAST(mulligan_number AS STRING), p_keep, y FROM x UNION ALL SELECT 'on_play', CAST(on_play AS STRING), p_keep, y FROM x
  UNION ALL SELECT 'opp_mulligans', CAST(opp_mulligans AS STRING), p_keep, y FROM x UNION ALL SELECT 'player_rank', coalesce(player_rank, '<null>'), p_keep, y FROM x)
SELECT family, value, {sql_metrics('p_keep', 'y')} FROM f GROUP BY family, value""")
def families(t: Tables) -> DataFrame:
    return rounded(M.grouping_set_metrics(scored(t), "p_keep", "y", ["expansion", "mulligan_number", "on_play", "opp_mulligans", "player_rank"]))


QUANTILE_BINS = """
WITH x AS (SELECT *, CASE WHEN was_kept THEN 1 ELSE 0 END AS y FROM decisions),
e AS (SELECT list_sort(list_distinct(quantile_cont(p_keep, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM x),
b AS (SELECT x.*, CAST(len(list_filter(edges[2:len(edges) - 1], lambda v: v < p_keep)) AS INT) AS bin FROM x, e),
r AS (SELECT bin, count(*) AS n, min(p_keep) AS p_lo, max(p_keep) AS p_hi, avg(p_keep) AS mean_p, avg(y) AS actual FROM b GROUP BY bin)
"""


@query("d16_reliability_quantile", QUANTILE_BINS + "SELECT bin, n, round(p_lo, 6) AS p_lo, round(p_hi, 6) AS p_hi, round(mean_p, 6) AS mean_p, round(actual, 6) AS actual, round(mean_p - actual, 6) AS diff FROM r")
def reliability(t: Tables) -> DataFrame:
    return rounded(M.reliability(M.quantile_bins(scored(t), "p_keep", 10), "p_keep", "y"))


POSITION_BINS = """
WITH x AS (SELECT *, CASE WHEN was_kept THEN 1 ELSE 0 END AS y, row_number() OVER (ORDER BY p_keep, game_id) - 1 AS pos, count(*) OVER () AS total FROM decisions),
b AS (SELECT *, CAST((SELECT max(k) FROM range({bins}) g(k) WHERE (k * total) // {bins} <= pos) AS INT) AS bin FROM x),
r AS (SELECT bin, count(*) AS n, min(p_keep) AS p_lo, max(p_keep) AS p_hi, avg(p_keep) AS mean_p, avg(y) AS actual FROM b GROUP BY bin)
"""


@query("d17_w3_equal_count_deciles", POSITION_BINS.format(bins=10) + "SELECT bin, n, round(p_lo, 6) AS p_lo, round(p_hi, 6) AS p_hi, round(mean_p, 6) AS mean_p, round(actual, 6) AS actual, round(mean_p - actual, 6) AS diff FROM r")
def deciles(t: Tables) -> DataFrame:
    return rounded(M.reliability(M.equal_count_bins(scored(t), "p_keep", ["game_id"], 10), "p_keep", "y"))


@query("d18_equal_width", """
WITH x AS (SELECT *, CASE WHEN was_kept THEN 1 ELSE 0 END AS y, CAST(least(floor(p_keep / 0.1 + 1e-9), 9) AS INT) AS bin FROM decisions)
SELECT bin, count(*) AS n, round(avg(p_keep), 6) AS mean_p, round(avg(y), 6) AS actual, round(avg(CASE WHEN won THEN 1 ELSE 0 END), 6) AS won,
  CASE WHEN avg(CASE WHEN won THEN 1 ELSE 0 END) >= 0.57 THEN 'above' ELSE 'below' END AS against FROM x GROUP BY bin""")
def equal_width(t: Tables) -> DataFrame:
    rows = M.equal_width_bins(scored(t), "p_keep", 0.1)
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p_keep").alias("mean_p"), F.avg("y").alias("actual"), F.avg("w").alias("won"))
    return rounded(out.withColumn("against", F.when(F.col("won") >= 0.57, "above").otherwise("below")))


@query("d19_ece_mce", QUANTILE_BINS + "SELECT round(sum(abs(mean_p - actual) * n / t), 6) AS ece, round(max(CASE WHEN n >= t * 0.01 THEN abs(mean_p - actual) END), 6) AS mce FROM r, (SELECT sum(n) AS t FROM r)")
def ece(t: Tables) -> DataFrame:
    return rounded(M.calibration_error(M.reliability(M.quantile_bins(scored(t), "p_keep", 10), "p_keep", "y"), 0.01))


@query("d19b_ece_equal_count", POSITION_BINS.format(bins=20) + "SELECT round(sum(abs(mean_p - actual) * n / t), 6) AS ece, round(max(abs(mean_p - actual)), 6) AS mce FROM r, (SELECT sum(n) AS t FROM r)")
def ece_equal_count(t: Tables) -> DataFrame:
    return rounded(M.calibration_error(M.reliability(M.equal_count_bins(scored(t), "p_keep", ["game_id"], 20), "p_keep", "y")))


@query("d20_g2_confusion", """
WITH c AS (SELECT coalesce(a, 'ALL') AS actual, coalesce(p, 'ALL') AS predicted, count(*) AS n FROM (SELECT CAST(was_kept AS STRING) AS a, CAST(p_keep >= 0.5 AS STRING) AS p FROM decisions) GROUP BY CUBE (a, p))
SELECT * FROM c""")
def confusion(t: Tables) -> DataFrame:
    return M.confusion(t.decisions.withColumn("pred", F.col("p_keep") >= 0.5), "was_kept", "pred")


@query("d21_quadrants", "SELECT was_kept, p_keep >= 0.5 AS predicted, count(*) AS n, round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(arm_keep), 6) AS mean_keep, round(avg(arm_mull), 6) AS mean_mull, round(avg(arm_keep - arm_mull), 6) AS mean_delta FROM decisions GROUP BY 1, 2")
def quadrants(t: Tables) -> DataFrame:
    return rounded(R.quadrants(t.decisions.withColumn("predicted", F.col("p_keep") >= 0.5), "was_kept", "predicted", "won", "arm_keep", "arm_mull"))


@query("d23_elite_agreement", f"""
WITH x AS (SELECT *, {VERDICT} AS verdict FROM decisions WHERE n_games >= 500 AND ((event_type = 'PremierDraft' AND win_rate >= 0.62 AND player_rank IN ('diamond', 'mythic')) OR (event_type = 'TradDraft' AND win_rate >= 0.68)))
SELECT count(*) AS n, count(*) FILTER (WHERE verdict <> 'borderline') AS judged,
  round(CAST(count(*) FILTER (WHERE (verdict LIKE '%keep' AND was_kept) OR (verdict LIKE '%mulligan' AND NOT was_kept)) AS DOUBLE) / nullif(count(*) FILTER (WHERE verdict <> 'borderline'), 0), 6) AS agreement,
  round(1 - CAST(count(*) FILTER (WHERE (verdict = 'clear_keep' AND NOT was_kept) OR (verdict = 'clear_mulligan' AND was_kept)) AS DOUBLE) / nullif(count(*), 0), 6) AS not_complete_disagreement FROM x""")
def elite_agreement(t: Tables) -> DataFrame:
    rows = t.decisions.filter(R.is_elite(F.col("event_type"), F.col("win_rate"), F.col("n_games"), F.col("player_rank"))).withColumn("verdict", N.banded(F.col("p_keep")))
    out = R.cohort_agreement(rows, [])
    return rounded(out.select("n", "judged", "agreement", (1 - F.try_divide("hard_disagree", "n")).alias("not_complete_disagreement")))


@query("d26_outcome_by_mulligan", "SELECT coalesce(CAST(mulligan_number AS STRING), 'ALL') AS mulligan, count(*) AS n, round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(CASE WHEN mulligan_number > 0 THEN CASE WHEN won THEN 1.0 ELSE 0.0 END END), 6) AS post_mulligan FROM decisions GROUP BY ROLLUP (mulligan_number)")
def by_mulligan(t: Tables) -> DataFrame:
    return rounded(R.outcome_rollup(t.decisions, "mulligan_number", "won").withColumnRenamed("value", "mulligan"))


SWEEP = """
WITH th AS (SELECT k, k / 20.0::DOUBLE AS threshold FROM range(1, 20) g(k)),
s AS (SELECT threshold, count(*) FILTER (WHERE p_keep >= threshold) AS n_above, count(*) FILTER (WHERE p_keep < threshold) AS n_below,
  count(*) FILTER (WHERE p_keep >= threshold AND won) AS w_above, count(*) FILTER (WHERE p_keep < threshold AND won) AS w_below FROM decisions, th GROUP BY threshold)
"""


@query("d27_w6_threshold_sweep", SWEEP + "SELECT round(threshold, 6) AS threshold, n_above, n_below, round(w_above / nullif(n_above, 0)::DOUBLE, 6) AS wr_above, round(w_below / nullif(n_below, 0)::DOUBLE, 6) AS wr_below FROM s")
def sweep(t: Tables) -> DataFrame:
    return rounded(M.threshold_sweep(t.decisions, "p_keep", "won", [k / 20 for k in range(1, 20)]))


@query("d27b_break_even", SWEEP + "SELECT round(min(threshold), 6) AS break_even FROM s WHERE w_below / nullif(n_below, 0)::DOUBLE >= 0.57 AND n_below >= 100")
def break_even(t: Tables) -> DataFrame:
    return rounded(M.break_even(M.threshold_sweep(t.decisions, "p_keep", "won", [k / 20 for k in range(1, 20)]), 0.57))


@query("d28_w4_rate_threshold", """
WITH x AS (SELECT p_keep, row_number() OVER (ORDER BY p_keep, game_id) - 1 AS pos, count(*) OVER () AS total FROM decisions)
SELECT round(p_keep, 9) AS threshold, pos AS k FROM x WHERE pos = floor(total * CAST(0.12 AS DOUBLE) + 0.5)""")
def rate_threshold(t: Tables) -> DataFrame:
    return rounded(M.rate_threshold(t.decisions, "p_keep", 0.12), digits=9)


@query("d29_w5_residual_lift", """
WITH x AS (SELECT p_keep - p_base AS delta, (CASE WHEN was_kept THEN 1 ELSE 0 END) - p_base AS resid FROM decisions),
r AS (SELECT *, rank() OVER (ORDER BY delta) + (count(*) OVER (PARTITION BY delta) - 1) / 2.0 AS rd, rank() OVER (ORDER BY resid) + (count(*) OVER (PARTITION BY resid) - 1) / 2.0 AS rr FROM x)
SELECT count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(resid), 6) AS mean_resid, round(corr(delta, resid), 6) AS pearson, round(corr(rd, rr), 6) AS spearman FROM r""")
def residual_lift(t: Tables) -> DataFrame:
    return rounded(R.residual_lift(scored(t), "p_keep", "p_base", "y"))


@query("d30_slice_residuals", """
WITH x AS (SELECT expansion, p_keep, p_base, CASE WHEN was_kept THEN 1 ELSE 0 END AS y FROM decisions),
r AS (SELECT *, rank() OVER (PARTITION BY expansion ORDER BY p_keep) + (count(*) OVER (PARTITION BY expansion, p_keep) - 1) / 2.0 AS rk, rank() OVER (PARTITION BY expansion ORDER BY p_base) + (count(*) OVER (PARTITION BY expansion, p_base) - 1) / 2.0 AS rb FROM x)
SELECT expansion, count(*) AS n, round(avg(p_keep - p_base), 6) AS mean_delta, round(avg(y - p_base), 6) AS mean_resid, round(avg(p_keep) - avg(y), 6) AS gap,
  round(avg(-(y * ln(p_base) + (1 - y) * ln(1 - p_base))) - avg(-(y * ln(p_keep) + (1 - y) * ln(1 - p_keep))), 6) AS ll_gap,
  round(CAST(sum(rb * y) - sum(y) * (sum(y) + 1) / 2.0 AS DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc_base,
  round(CAST(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0 AS DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc_full FROM r GROUP BY expansion""")
def slice_residuals(t: Tables) -> DataFrame:
    return rounded(R.slice_residuals(scored(t), "p_keep", "p_base", "y", "expansion"))


@query("d31_auc", """
WITH r AS (SELECT CASE WHEN was_kept THEN 1 ELSE 0 END AS y, rank() OVER (ORDER BY p_keep) + (count(*) OVER (PARTITION BY p_keep) - 1) / 2.0 AS rk FROM decisions)
SELECT round(CAST(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0 AS DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0), 6) AS auc FROM r""")
def auc(t: Tables) -> DataFrame:
    return rounded(M.auc(scored(t), "p_keep", "y"))


LIFT = """
WITH h AS (SELECT DISTINCT game_id, card_id FROM hand_cards), x AS (SELECT game_id, (p_keep >= 0.5) <> was_kept AS disagree FROM decisions),
tot AS (SELECT count(*) FILTER (WHERE disagree) AS nd, count(*) FILTER (WHERE NOT disagree) AS na FROM x),
c AS (SELECT card_id, count(*) AS n, count(*) FILTER (WHERE disagree) AS d, count(*) FILTER (WHERE NOT disagree) AS a FROM h JOIN x USING (game_id) GROUP BY card_id),
l AS (SELECT card_id, n, d / nd::DOUBLE AS p_disagree, a / na::DOUBLE AS p_agree, CASE WHEN a = 0 THEN 'Infinity'::DOUBLE ELSE (d / nd::DOUBLE) / (a / na::DOUBLE) END AS lift FROM c, tot WHERE n >= 20)
"""


@query("d32_card_lift", LIFT + "SELECT card_id, n, round(p_disagree, 6) AS p_disagree, round(p_agree, 6) AS p_agree, round(lift, 6) AS lift FROM l")
def card_lift(t: Tables) -> DataFrame:
    marked = t.decisions.select("game_id", ((F.col("p_keep") >= 0.5) != F.col("was_kept")).alias("disagree"))
    return rounded(R.card_lift(t.hand_cards, marked, "game_id", "card_id", "disagree", 20))


GROUPED_LIFT = """
WITH h AS (SELECT DISTINCT game_id, card_id FROM hand_cards), y AS (SELECT game_id, expansion, was_kept, (p_keep >= 0.5) <> was_kept AS disagree FROM decisions),
x AS (SELECT *, 'overall' AS slice FROM y UNION ALL SELECT *, CASE WHEN was_kept THEN 'kept' ELSE 'mulled' END FROM y),
tot AS (SELECT expansion, slice, count(*) FILTER (WHERE disagree) AS nd, count(*) FILTER (WHERE NOT disagree) AS na FROM x GROUP BY 1, 2 HAVING nd >= 5 AND na >= 5),
c AS (SELECT expansion, slice, card_id, count(*) AS n, count(*) FILTER (WHERE disagree) AS d, count(*) FILTER (WHERE NOT disagree) AS a FROM h JOIN x USING (game_id) GROUP BY 1, 2, 3),
l AS (SELECT expansion, slice, card_id, n, d / nd::DOUBLE AS p_disagree, a / na::DOUBLE AS p_agree, CASE WHEN a = 0 THEN 'Infinity'::DOUBLE ELSE (d / nd::DOUBLE) / (a / na::DOUBLE) END AS lift FROM c JOIN tot USING (expansion, slice) WHERE n >= 5)
"""


def grouped_lift(t: Tables) -> DataFrame:
    marked = R.outcome_groups(t.decisions.select("game_id", "expansion", "was_kept", ((F.col("p_keep") >= 0.5) != F.col("was_kept")).alias("disagree")), "was_kept").drop("was_kept")
    return R.card_lift(t.hand_cards, marked, "game_id", "card_id", "disagree", 5, ["expansion", "slice"], 5)


@query("d32b_grouped_lift", GROUPED_LIFT + "SELECT expansion, slice, card_id, n, round(p_disagree, 6) AS p_disagree, round(p_agree, 6) AS p_agree, round(lift, 6) AS lift FROM l")
def lift_by_group(t: Tables) -> DataFrame:
    return rounded(grouped_lift(t))


@query("l1_top_lift", GROUPED_LIFT + "SELECT expansion, slice, card_id, round(lift, 6) AS lift, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY expansion, slice ORDER BY round(lift, 9) DESC, card_id) AS rk FROM l) WHERE rk <= 15")
def top_lift(t: Tables) -> DataFrame:
    """The cards of most lift in each set and slice: of a group's few hundred cards."""
    top = R.top_n(grouped_lift(t), ["expansion", "slice"], [F.round("lift", 9).desc(), F.col("card_id")], 15)
    return rounded(top.select("expansion", "slice", "card_id", "lift", "rk"))


@query("d33_quantile_summary", "SELECT event_type, round(quantile_cont(p_keep, 0.01), 6) AS p01, round(quantile_cont(p_keep, 0.05), 6) AS p05, round(quantile_cont(p_keep, 0.25), 6) AS p25, round(quantile_cont(p_keep, 0.5), 6) AS p50, round(quantile_cont(p_keep, 0.75), 6) AS p75, round(quantile_cont(p_keep, 0.95), 6) AS p95, round(quantile_cont(p_keep, 0.99), 6) AS p99, round(min(p_keep), 6) AS low, round(max(p_keep), 6) AS high, round(avg(p_keep), 6) AS mean FROM decisions GROUP BY event_type")
def quantile_summary(t: Tables) -> DataFrame:
    return rounded(R.quantile_summary(t.decisions, "p_keep", ["event_type"]))


@query("d34_verdict_distribution", f"""
SELECT event_type, mulligan_number, count(*) FILTER (WHERE v = 'clear_keep') AS clear_keep, count(*) FILTER (WHERE v = 'marginal_keep') AS marginal_keep, count(*) FILTER (WHERE v = 'borderline') AS borderline,
  count(*) FILTER (WHERE v = 'marginal_mulligan') AS marginal_mulligan, count(*) FILTER (WHERE v = 'clear_mulligan') AS clear_mulligan FROM (SELECT *, {VERDICT} AS v FROM decisions) GROUP BY 1, 2""")
def verdict_distribution(t: Tables) -> DataFrame:
    rows = t.decisions.withColumn("v", N.banded(F.col("p_keep")))
    return rows.groupBy("event_type", "mulligan_number").pivot("v", [n for _, n in N.VERDICTS] + [N.LOWEST_VERDICT]).count().fillna(0)


@query("d34b_verdict_shares", f"""
WITH x AS (SELECT {VERDICT} AS verdict, was_kept FROM decisions)
SELECT verdict, count(*) AS n, round(count(*) / (SELECT count(*) FROM x)::DOUBLE, 6) AS share, round(avg(CASE WHEN verdict LIKE '%keep' THEN CASE WHEN was_kept THEN 1.0 ELSE 0.0 END WHEN verdict LIKE '%mulligan' THEN CASE WHEN was_kept THEN 0.0 ELSE 1.0 END END), 6) AS agreement FROM x GROUP BY verdict""")
def verdict_shares(t: Tables) -> DataFrame:
    return rounded(R.verdict_shares(t.decisions.withColumn("v", N.banded(F.col("p_keep"))), "v", "was_kept"))


@query("d35_repeat_variance", """
WITH v AS (SELECT draft_id, mulligan_number, count(*) AS runs, avg(p_keep) AS mean, stddev_samp(p_keep) AS sd, min(p_keep) AS low, max(p_keep) AS high FROM decisions GROUP BY 1, 2)
SELECT mulligan_number, count(sd) AS groups, round(avg(sd), 6) AS mean_sd, round(median(sd), 6) AS median_sd, round(max(sd), 6) AS max_sd, round(min(sd), 6) AS min_sd FROM v GROUP BY 1""")
def repeat_variance(t: Tables) -> DataFrame:
    return rounded(R.repeat_variance(t.decisions, ["draft_id"], "mulligan_number", "p_keep"))


@query("d36_w8_floored_mean", """
WITH x AS (SELECT draft_id, mulligan_number, arm_mull, avg(arm_keep) OVER (PARTITION BY draft_id) AS floor_p FROM decisions)
SELECT draft_id, round(avg(greatest(arm_mull, floor_p)), 6) AS floored, round(avg(arm_mull), 6) AS raw, count(*) FILTER (WHERE arm_mull < floor_p) AS below FROM x GROUP BY draft_id""")
def floored(t: Tables) -> DataFrame:
    return rounded(R.floored_mean(t.decisions, ["draft_id"], "arm_mull", "arm_keep"))


@query("d37_floor_diagnostics", """
WITH x AS (SELECT *, avg(arm_keep) OVER (PARTITION BY draft_id, on_play) AS floor_p FROM decisions)
SELECT expansion, on_play, count(DISTINCT draft_id) AS arms, round(avg(CASE WHEN arm_mull < floor_p THEN 1.0 ELSE 0.0 END), 6) AS clamped, round(avg(greatest(floor_p - arm_mull, 0)), 6) AS mean_bump,
  round(max(greatest(floor_p - arm_mull, 0)), 6) AS max_bump, round(avg(CASE WHEN arm_keep < greatest(arm_mull, floor_p) THEN 1.0 ELSE 0.0 END), 6) AS should_mull FROM x GROUP BY 1, 2""")
def floor_diagnostics(t: Tables) -> DataFrame:
    return rounded(R.floor_diagnostics(t.decisions, ["draft_id", "on_play"], ["expansion", "on_play"], "draft_id", "arm_keep", "arm_mull"))


@query("d38_flag_comparison", """
WITH m AS (SELECT expansion, on_play, avg(arm_mull) AS usual FROM decisions GROUP BY 1, 2),
x AS (SELECT d.*, arm_keep < arm_mull AS per_deck, arm_keep < usual AS usual_flag FROM decisions d JOIN m USING (expansion, on_play))
SELECT per_deck, usual_flag, count(*) AS n, round(avg(CASE WHEN won THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM x GROUP BY 1, 2""")
def flag_comparison(t: Tables) -> DataFrame:
    return rounded(R.flag_comparison(t.decisions, ["expansion", "on_play"], "arm_keep", "arm_mull", "won"))


@query("d39_g1_decision_summary", "SELECT expansion, count(DISTINCT (draft_id, match_number, game_number)) AS games, count(*) FILTER (WHERE was_kept) AS kept, count(*) FILTER (WHERE NOT was_kept) AS mulled, round(avg(CASE WHEN was_kept THEN CASE WHEN won THEN 1.0 ELSE 0.0 END END), 6) AS kept_win_rate, round(avg(CASE WHEN on_play THEN 1.0 ELSE 0.0 END), 6) AS on_play FROM decisions GROUP BY expansion")
def decision_summary(t: Tables) -> DataFrame:
    return rounded(R.decision_summary(t.decisions, ["expansion"]))


@query("d46_models_side_by_side", f"""
WITH m AS (SELECT event_type, 'v1' AS model, p_keep AS p, CASE WHEN was_kept THEN 1 ELSE 0 END AS y FROM decisions UNION ALL SELECT event_type, 'v2', p_base, CASE WHEN was_kept THEN 1 ELSE 0 END FROM decisions UNION ALL SELECT event_type, 'v3', arm_keep, CASE WHEN was_kept THEN 1 ELSE 0 END FROM decisions),
l AS (SELECT event_type, model, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll FROM m GROUP BY 1, 2)
SELECT event_type, round(max(ll) FILTER (WHERE model = 'v1'), 6) AS v1, round(max(ll) FILTER (WHERE model = 'v2'), 6) AS v2, round(max(ll) FILTER (WHERE model = 'v3'), 6) AS v3,
  round(max(ll) FILTER (WHERE model = 'v2') - max(ll) FILTER (WHERE model = 'v1'), 6) AS v2_delta, round(max(ll) FILTER (WHERE model = 'v3') - max(ll) FILTER (WHERE model = 'v1'), 6) AS v3_delta FROM l GROUP BY event_type""")
def side_by_side(t: Tables) -> DataFrame:
    return rounded(R.models_side_by_side(scored(t), {"v1": "p_keep", "v2": "p_base", "v3": "arm_keep"}, "y", "event_type"))


@query("d47_ab_delta", "SELECT round(avg(abs(p_keep - p_base)), 6) AS mean, round(median(abs(p_keep - p_base)), 6) AS median, round(max(abs(p_keep - p_base)), 6) AS max FROM decisions")
def ab_delta(t: Tables) -> DataFrame:
    return rounded(R.absolute_delta(t.decisions, "p_keep", "p_base"))


@query("d48_transfer", f"""
WITH x AS (SELECT *, CASE WHEN was_kept THEN 1 ELSE 0 END AS y FROM decisions), a AS (SELECT avg(-(y * ln(p_keep) + (1 - y) * ln(1 - p_keep))) AS home FROM x WHERE expansion = 'BUILDING'),
w AS (SELECT * FROM x WHERE expansion <> 'BUILDING'), p AS (SELECT *, row_number() OVER (ORDER BY p_keep, game_id) - 1 AS pos, count(*) OVER () AS total FROM w WHERE mulligan_number = 0),
s AS (SELECT 'overall' AS section, 'all' AS value, p_keep, y FROM w UNION ALL SELECT 'mulligan', CAST(mulligan_number AS STRING), p_keep, y FROM w UNION ALL SELECT 'decile', CAST(((pos + 1) * 10 - 1) // total AS STRING), p_keep, y FROM p)
SELECT section, value, {sql_metrics('p_keep', 'y')}, round(avg(-(y * ln(p_keep) + (1 - y) * ln(1 - p_keep))) - max(home), 6) AS against_home FROM s, a GROUP BY 1, 2""")
def transfer(t: Tables) -> DataFrame:
    return rounded(R.transfer(scored(t), "p_keep", "y", "expansion", "BUILDING", "mulligan_number", ["game_id"]))


FEATURES = ["p_base", "win_rate", "n_games", "arm_draw", "arm_mull"]


@query("d48b_feature_coverage", "SELECT feature, feature <> 'arm_draw' AS present, sum(CASE WHEN expansion = 'BUILDING' AND x IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS known_home, sum(CASE WHEN expansion <> 'BUILDING' AND x IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS known_away, count(*) FILTER (WHERE expansion = 'BUILDING') AS rows_home, count(*) FILTER (WHERE expansion <> 'BUILDING') AS rows_away FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, expansion, {'NULL' if f == 'arm_draw' else f}::DOUBLE AS x FROM decisions" for f in FEATURES) + ") GROUP BY feature")
def feature_coverage(t: Tables) -> DataFrame:
    """What a model's features have at home and away; one of them isn't in the table."""
    return R.feature_coverage(t.decisions, FEATURES, "expansion", "BUILDING")


@query("d50_always_keep", "SELECT event_type, round(avg(CASE WHEN was_kept THEN 1.0 ELSE 0.0 END), 6) AS always_keep, round(avg(CASE WHEN (p_keep >= 0.5) = was_kept THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN was_kept THEN 1.0 ELSE 0.0 END), 6) AS lift, round(count(*) FILTER (WHERE p_keep < 0.5 AND NOT was_kept) / nullif(count(*) FILTER (WHERE NOT was_kept), 0)::DOUBLE, 6) AS mull_recall, round(count(*) FILTER (WHERE p_keep < 0.5 AND NOT was_kept) / nullif(count(*) FILTER (WHERE p_keep < 0.5), 0)::DOUBLE, 6) AS mull_precision FROM decisions GROUP BY event_type")
def always_keep(t: Tables) -> DataFrame:
    return rounded(R.always_keep(t.decisions, "p_keep", "was_kept", ["event_type"]))


@query("l2_lowest_tail", "WITH x AS (SELECT game_id, p_keep, count(*) OVER () AS total, row_number() OVER (ORDER BY p_keep, game_id) AS rk FROM decisions) SELECT game_id, round(p_keep, 9) AS p_keep FROM x WHERE rk <= greatest(50, total // 50)")
def lowest_tail(t: Tables) -> DataFrame:
    return rounded(R.lowest_tail(t.decisions, "p_keep", ["game_id"]).select("game_id", "p_keep"), digits=9)


@query("l3_divergent", "SELECT direction, game_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY round(score, 9) DESC, game_id) AS rk FROM (SELECT game_id, CASE WHEN arm_keep < arm_mull + CAST(0.04 AS DOUBLE) THEN 'win_mull' ELSE 'win_keep' END AS direction, abs(arm_keep - arm_mull - CAST(0.04 AS DOUBLE)) + abs(p_keep - 0.5) AS score FROM decisions WHERE (arm_keep < arm_mull + CAST(0.04 AS DOUBLE)) <> (p_keep < 0.5))) WHERE rk <= 25")
def divergent(t: Tables) -> DataFrame:
    return rounded(R.most_divergent(R.model_flags(t.decisions, "arm_keep", "arm_mull", "p_keep"), "game_id", 25), digits=9)


@query("l4_group_sample", "WITH d AS (SELECT draft_id FROM (SELECT DISTINCT draft_id FROM decisions) ORDER BY sha256(concat('7:', draft_id)), draft_id LIMIT 40) SELECT game_id, draft_id FROM decisions SEMI JOIN d USING (draft_id)")
def group_sample(t: Tables) -> DataFrame:
    return R.sample_groups(t.decisions, "draft_id", 40, 7).select("game_id", "draft_id")


@query("l5_l6_row_sample", "SELECT game_id FROM (SELECT game_id FROM decisions ORDER BY sha256(concat('3:', CAST(game_id AS STRING))), game_id LIMIT 100)")
def row_sample(t: Tables) -> DataFrame:
    return R.sample_rows(t.decisions, ["game_id"], 100, 3).select("game_id")


@query("c5_rank_join", "WITH r AS (SELECT game_id, max(player_rank) AS joined_rank FROM decisions WHERE mulligan_number = 0 GROUP BY game_id) SELECT d.game_id, r.joined_rank FROM decisions d LEFT JOIN r ON d.game_id = r.game_id WHERE d.mulligan_number = 0")
def rank_join(t: Tables) -> DataFrame:
    ranks = t.decisions.filter("mulligan_number = 0").select("game_id", F.col("player_rank").alias("joined_rank"))
    joined = R.left_join_guarded(t.decisions.filter("mulligan_number = 0").select("game_id"), ranks, ["game_id"], 0.05)
    return joined.select("game_id", "joined_rank")


@query("c13_draft_lists", "SELECT game_id FROM decisions WHERE draft_id NOT IN (SELECT draft_id FROM decisions WHERE mulligan_number = 2) AND draft_id IN (SELECT draft_id FROM decisions WHERE on_play)")
def draft_lists(t: Tables) -> DataFrame:
    d = t.decisions
    return d.join(d.filter("mulligan_number = 2").select("draft_id").distinct(), "draft_id", "left_anti").join(d.filter("on_play").select("draft_id").distinct(), "draft_id", "left_semi").select("game_id")


@query("c21_margin_lookup", f"""
WITH x AS (SELECT *, {WR_LABEL} AS wr, {N_LABEL} AS ng, CASE WHEN won THEN 1.0 ELSE 0.0 END AS w FROM decisions),
c AS (SELECT wr, ng, on_play, ln((sum(w) + 1) / (count(*) - sum(w) + 1)) AS margin, count(*) AS n FROM x WHERE wr <> 'unknown' AND ng <> 'unknown' GROUP BY 1, 2, 3),
o AS (SELECT on_play, sum(margin * n) / sum(n) AS fallback FROM c GROUP BY 1)
SELECT game_id, round(coalesce(c.margin, o.fallback), 6) AS margin FROM x LEFT JOIN c USING (wr, ng, on_play) LEFT JOIN o USING (on_play)""")
def margins(t: Tables) -> DataFrame:
    x = t.decisions.withColumns({"wr": N.win_rate_label(F.col("win_rate")), "ng": N.n_games_label(F.col("n_games"))})
    return rounded(R.margin_lookup(x, R.cell_margins(x, "won"), R.population_margins(R.cell_margins(x, "won"))).select("game_id", "margin"))


@query("d45_population_marginals", f"""
WITH x AS (SELECT *, {WR_LABEL} AS wr, {N_LABEL} AS ng, CASE WHEN won THEN 1.0 ELSE 0.0 END AS w FROM decisions),
c AS (SELECT wr, ng, on_play, ln((sum(w) + 1) / (count(*) - sum(w) + 1)) AS margin, count(*) AS n FROM x WHERE wr <> 'unknown' AND ng <> 'unknown' GROUP BY 1, 2, 3)
SELECT on_play, round(sum(margin * n) / sum(n), 6) AS fallback FROM c GROUP BY 1""")
def marginals(t: Tables) -> DataFrame:
    x = t.decisions.withColumns({"wr": N.win_rate_label(F.col("win_rate")), "ng": N.n_games_label(F.col("n_games"))})
    return rounded(R.population_margins(R.cell_margins(x, "won")))
