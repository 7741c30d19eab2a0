"""Cohorts, verdict reports, selections for review and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import LOWEST_VERDICT, VERDICTS
from .metrics import equal_count_bins, grouped_auc, grouped_metrics, log_loss, spearman
from .ranks import beside, joined, positions, quantiles

# What makes a player elite in each event: games, win rate, ranks (none asked for if empty).
ELITE = {"PremierDraft": (500, 0.62, ("diamond", "mythic")), "TradDraft": (500, 0.68, ())}
# The other cohorts' win-rate bands, both ends included, after rounding to two digits.
COHORTS = (("strong", 0.55, 0.61), ("average", 0.48, 0.54), ("weak", 0.40, 0.47))


def is_elite(event: Column, win_rate: Column, n_games: Column, rank: Column) -> Column:
    out = F.lit(False)
    for name, (games, rate, ranks) in ELITE.items():
        cond = (event == name) & (n_games >= games) & (win_rate >= rate)
        out = out | (cond & rank.isin(*ranks) if ranks else cond)
    return F.coalesce(out, F.lit(False))


def cohort(event: Column, win_rate: Column, n_games: Column, rank: Column) -> Column:
    """elite, a band's name, or null outside every band."""
    rate = F.round(win_rate, 2)
    out = F.when(is_elite(event, rate, n_games, rank), "elite")
    for name, low, high in COHORTS:
        out = out.when(rate.between(low, high), name)
    return out


def skilled(mulligans: Column, hand_size: Column, n_games: Column, win_rate: Column, least_games: int, least_rate: float) -> Column:
    return F.coalesce((mulligans == 0) & (hand_size == 7) & (n_games >= least_games) & (win_rate >= least_rate), F.lit(False))


def cohort_agreement(df: DataFrame, by: list[str], verdict: str = "verdict", kept: str = "was_kept", draft: str = "draft_id") -> DataFrame:
    """Counts of verdicts and how they agree with what was done, by group."""
    v, k = F.col(verdict), F.col(kept)
    n = lambda cond: F.count_if(cond)
    judged, keep, mull = v != "borderline", v.endswith("keep"), v.endswith("mulligan")
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_distinct(draft).alias("drafts"), F.avg(F.when(k, 0.0).otherwise(1.0)).alias("mull_rate"), n(judged).alias("judged"),
        *[n(v == name).alias(name) for name in [*(b for _, b in VERDICTS), LOWEST_VERDICT]],
        n((keep & k) | (mull & ~k)).alias("agreement"),
        n(((v == "marginal_keep") & ~k) | ((v == "marginal_mulligan") & k)).alias("soft_disagree"), n(((v == "clear_keep") & ~k) | ((v == "clear_mulligan") & k)).alias("hard_disagree"),
    )
    return out.withColumn("agreement", F.try_divide(F.col("agreement"), F.col("judged")))


def model_flags(df: DataFrame, keep_arm: str, mull_arm: str, p_keep: str, bias: float = 0.04) -> DataFrame:
    """What two models say: mulligan flags, with and without the bias, and signed scores."""
    a, b, p = F.col(keep_arm), F.col(mull_arm), F.col(p_keep)
    return df.withColumns({"win_mull": a < b + bias, "win_mull_unbiased": a < b, "choice_mull": p < 0.5, "score_win": a - b - bias, "score_choice": p - 0.5})


def presets(kept: str = "was_kept", p_keep: str = "p_keep") -> dict[str, Column]:
    """Selections for review; comparisons with a null flag select nothing."""
    w, c, k, p = F.col("win_mull"), F.col("choice_mull"), F.col(kept), F.col(p_keep)
    return {
        "both_keep_player_mulled": ~w & ~c & ~k, "both_mull_player_kept": w & c & k, "win_mull_player_kept": w & k, "win_keep_choice_mull": ~w & c, "win_mull_choice_keep": w & ~c, "all": F.lit(True),
        "strong": ((p > VERDICTS[0][0]) & ~k) | ((p <= VERDICTS[-1][0]) & k), "clear_keep_mulled": (p > 0.75) & ~k,
    }


def hard_disagreement(verdict: str, kept: str, cohort: str, name: str) -> Column:
    """A clear verdict that a player of one cohort went against."""
    v, k = F.col(verdict), F.col(kept)
    return (F.col(cohort) == name) & (((v == "clear_keep") & ~k) | ((v == "clear_mulligan") & k))


def disagreements(df: DataFrame, votes: DataFrame, key: list[str], chosen: dict[str, Column] | None = None) -> DataFrame:
    """Rows of each preset, without those voted on, in order of their decision key."""
    marks = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in (chosen or presets()).items()]))
    return df.join(votes.select(*key).distinct(), key, "left_anti").withColumn("preset", F.explode(marks)).orderBy("preset", "decision_key")


def out_of_vocabulary(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    known = df.sparkSession.createDataFrame([(v,) for v in vocabulary], f"{column} string")
    return df.join(F.broadcast(known), column, "left_anti")  # the vocabulary is a parameter


def quadrants(df: DataFrame, actual: str, predicted: str, won: str, keep_arm: str, mull_arm: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count("*").alias("n"), F.avg(F.col(won).cast("double")).alias("win_rate"), F.avg(keep_arm).alias("mean_keep"), F.avg(mull_arm).alias("mean_mull"), F.avg(F.col(keep_arm) - F.col(mull_arm)).alias("mean_delta"))


def outcome_rollup(df: DataFrame, column: str, won: str) -> DataFrame:
    """Win rate by value and overall, with the rate of all values above 0 beside it."""
    rolled = df.rollup(column).agg(F.grouping(column).alias("g"), F.count("*").alias("n"), F.avg(F.col(won).cast("double")).alias("win_rate"), F.avg(F.when(F.col(column) > 0, F.col(won).cast("double"))).alias("post_mulligan"))
    return rolled.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(column).cast("string")).alias("value"), "n", "win_rate", "post_mulligan")


def residual_lift(df: DataFrame, p_full: str, p_base: str, y: str) -> DataFrame:
    rows = df.select((F.col(p_full) - F.col(p_base)).alias("delta"), (F.col(y) - F.col(p_base)).alias("resid"))
    flat = rows.agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.avg("resid").alias("mean_resid"), F.corr("delta", "resid").alias("pearson"))
    return flat.crossJoin(F.broadcast(spearman(rows, "delta", "resid")))  # one row each


def slice_residuals(df: DataFrame, p_full: str, p_base: str, y: str, by: str) -> DataFrame:
    """Mean difference and residual of two models by slice, the gaps of mean and log loss, and both areas under the curve."""
    p, b, label = F.col(p_full), F.col(p_base), F.col(y)
    flat = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(p - b).alias("mean_delta"), F.avg(label - b).alias("mean_resid"), (F.avg(p) - F.avg(label)).alias("gap"), (log_loss(b, label) - log_loss(p, label)).alias("ll_gap"))
    for name, column in (("auc_base", p_base), ("auc_full", p_full)):
        flat = joined(flat, grouped_auc(df, column, y, [by]).withColumnRenamed("auc", name), [by])
    return flat


def card_lift(hands: DataFrame, marked: DataFrame, game: str, card: str, disagree: str, least: int, by: list[str] = (), least_group: int = 0) -> DataFrame:
    """Share of hands with a card among those that disagree and those that agree, and the ratio of both.

    ``marked`` has a row a game, or, with ``by``, a row for each game and group
    that it is in; cards in fewer than ``least`` hands of a group are left
    out, and so are groups that lack ``least_group`` hands on either side.
    """
    by, d = list(by), F.col(disagree)
    totals = marked.groupBy(*by).agg(F.count_if(d).alias("nd"), F.count_if(~d).alias("na")).filter((F.col("nd") >= least_group) & (F.col("na") >= least_group))
    counts = hands.select(game, card).distinct().join(marked, game).groupBy(*by, card).agg(F.count("*").alias("n"), F.count_if(d).alias("d"), F.count_if(~d).alias("a")).filter(F.col("n") >= least)
    shares = joined(counts, totals, by).withColumns({"p_disagree": F.try_divide("d", "nd"), "p_agree": F.try_divide("a", "na")})
    return shares.select(*by, card, "n", "p_disagree", "p_agree", F.when(F.col("a") == 0, F.lit(float("inf"))).otherwise(F.col("p_disagree") / F.col("p_agree")).alias("lift"))


def outcome_groups(df: DataFrame, kept: str) -> DataFrame:
    """Each row twice: in the slice overall, and in kept or mulled."""
    return df.withColumn("slice", F.explode(F.array(F.lit("overall"), F.when(F.col(kept), "kept").otherwise("mulled"))))


def verdict_shares(df: DataFrame, verdict: str, kept: str) -> DataFrame:
    """Of each verdict, overall: rows, their share, and the share of players who did what it says; null for what says nothing."""
    v, k = F.col(verdict), F.col(kept)
    agree = F.when(v.endswith("keep"), k).when(v.endswith("mulligan"), ~k)
    counts = df.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"), F.avg(agree.cast("double")).alias("agreement"))
    return joined(counts, df.agg(F.count("*").alias("total")), []).withColumn("share", F.col("n") / F.col("total")).drop("total")


def bands(column: Column, cuts: list[float], name: str) -> dict[str, Column]:
    """Half-open bands between cuts, open at both ends; null and NaN are in none."""
    known = ~F.isnan(column.cast("double"))
    edges = [None, *cuts, None]
    out = {}
    for low, high in zip(edges, edges[1:]):
        label = f"{name} < {high:g}" if low is None else f"{name} >= {low:g}" if high is None else f"{low:g} <= {name} < {high:g}"
        cond = known
        cond = cond if low is None else cond & (column >= low)
        out[label] = cond if high is None else cond & (column < high)
    return out


def counted(column: Column, most: int, name: str, least: int = 0) -> dict[str, Column]:
    """One slice for each number from ``least`` up to ``most``, the last with what is above."""
    return {f"{k}{'+' if k == most else ''} {name}": column >= k if k == most else column == k for k in range(least, most + 1)}


def hand_slices(roles: dict[str, list[str]]) -> dict[str, Column]:
    """Slices of a table with the features of decks and hands: colours, lands, roles, pips, land drops, mana and best rates.

    ``roles``: the columns whose sum says whether a hand has a role.
    """
    c = F.col
    out = counted(c("main_colors"), 4, "main colors", 1) | counted(c("deck_colors"), 4, "total colors", 1) | counted(c("lands"), 5, "lands")
    for role, columns in roles.items():
        n = sum((F.coalesce(c(x), F.lit(0)) for x in columns), F.lit(0))
        out |= {f"has {role}": n > 0, f"no {role}": n == 0}
    out |= counted(c("double_pip"), 3, "double pips") | counted(c("distinct_colors"), 3, "colors needed") | bands(c("lands_t3"), [0.5, 0.7, 0.85, 0.95], "p land drop t3") | bands(c("mana_t4"), [3.0, 3.5, 4.0], "mana t4")
    return out | {"no spells": c("spells") == 0} | {k: v & (c("spells") > 0) for k, v in bands(c("max_gih"), [0.48, 0.52, 0.56, 0.6], "max gih").items()}


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rk") <= n)


QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def quantile_summary(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    out = quantiles(df, p, list(QUANTILES.values()), by)
    rest = df.groupBy(*by).agg(F.min(p).alias("low"), F.max(p).alias("high"), F.avg(p).alias("mean"))
    return joined(out, rest, by).select(*by, *[F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES)], "low", "high", "mean")


def repeat_variance(df: DataFrame, combo: list[str], setting: str, p: str) -> DataFrame:
    """Spread of repeats of each combination, summed up by setting; single repeats have no spread."""
    spread = df.groupBy(*combo, setting).agg(F.stddev_samp(p).alias("sd"))
    rest = spread.groupBy(setting).agg(F.count("sd").alias("groups"), F.avg("sd").alias("mean_sd"), F.max("sd").alias("max_sd"), F.min("sd").alias("min_sd"))
    return rest.join(quantiles(spread, "sd", [0.5], [setting]), setting, "left").select(setting, "groups", "mean_sd", F.col("q")[0].alias("median_sd"), "max_sd", "min_sd")


#: What two means of the same rates differ by when they are summed in another order, at most.
ROUNDING = 1e-12


def below(p: Column, mean: Column) -> Column:
    """Less than a mean by more than the order of its sum can change: a value equal to it is never below, however rows are cut."""
    return p < mean - F.lit(ROUNDING)


def floored_mean(df: DataFrame, arm: list[str], p: str, deeper: str) -> DataFrame:
    """Mean of ``p`` with the arm's mean of ``deeper`` as a floor under each value."""
    rows = beside(df, arm, floor_p=F.avg(deeper))
    return rows.groupBy(*arm).agg(F.avg(F.greatest(p, "floor_p")).alias("floored"), F.avg(p).alias("raw"), F.count_if(below(F.col(p), F.col("floor_p"))).alias("below"))


def floor_diagnostics(df: DataFrame, arm: list[str], by: list[str], arm_key: str, keep_arm: str, mull_arm: str) -> DataFrame:
    rows = beside(df, arm, floor_p=F.avg(keep_arm))
    m, f = F.col(mull_arm), F.col("floor_p")
    bump = F.greatest(f - m, F.lit(0.0))
    return rows.groupBy(*by).agg(F.count_distinct(arm_key).alias("arms"), F.avg(below(m, f).cast("double")).alias("clamped"), F.avg(bump).alias("mean_bump"), F.max(bump).alias("max_bump"), F.avg((F.col(keep_arm) < F.greatest(m, f - F.lit(ROUNDING))).cast("double")).alias("should_mull"))


def flag_comparison(df: DataFrame, by: list[str], keep_arm: str, mull_arm: str, won: str) -> DataFrame:
    """Flags from each row's own arm against the group's usual one: counts and win rates of the 2 x 2."""
    rows = beside(df, by, usual=F.avg(mull_arm))
    rows = rows.withColumns({"per_deck": F.col(keep_arm) < F.col(mull_arm), "usual_flag": below(F.col(keep_arm), F.col("usual"))})
    return rows.groupBy("per_deck", "usual_flag").agg(F.count("*").alias("n"), F.avg(F.col(won).cast("double")).alias("win_rate"))


def decision_summary(df: DataFrame, by: list[str]) -> DataFrame:
    kept = F.col("was_kept")
    return df.groupBy(*by).agg(F.count_distinct(F.struct("draft_id", "match_number", "game_number")).alias("games"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("mulled"), F.avg(F.when(kept, F.col("won").cast("double"))).alias("kept_win_rate"), F.avg(F.col("on_play").cast("double")).alias("on_play"))


def models_side_by_side(df: DataFrame, models: dict[str, str], y: str, subset: str) -> DataFrame:
    """Log loss of several models on the same rows, by subset, and the difference to the first."""
    out = df.groupBy(subset).agg(*[log_loss(F.col(p), F.col(y)).alias(name) for name, p in models.items()])
    first, *others = models
    return out.withColumns({f"{m}_delta": F.col(m) - F.col(first) for m in others})


def absolute_delta(df: DataFrame, a: str, b: str) -> DataFrame:
    gaps = df.select(F.abs(F.col(a) - F.col(b)).alias("gap"))
    rest = gaps.agg(F.avg("gap").alias("mean"), F.max("gap").alias("max"))
    return rest.crossJoin(F.broadcast(quantiles(gaps, "gap", [0.5]))).select("mean", F.col("q")[0].alias("median"), "max")  # one row each


def transfer(df: DataFrame, p: str, y: str, domain: str, home: str, mulligan: str, ties: list[str]) -> DataFrame:
    """Metrics away from the home domain: overall, by mulligan number and by deciles of first decisions, each beside the difference of its log loss to the one at home."""
    away = df.filter(F.col(domain) != home)
    at_home = df.filter(F.col(domain) == home).agg(log_loss(F.col(p), F.col(y)).alias("home"))
    parts = [away.withColumns({"section": F.lit("overall"), "value": F.lit("all")}), away.withColumns({"section": F.lit("mulligan"), "value": F.col(mulligan).cast("string")})]
    deciles = equal_count_bins(away.filter(F.col(mulligan) == 0), p, ties, 10, "own_bin")
    parts.append(deciles.withColumns({"section": F.lit("decile"), "value": F.col("own_bin").cast("string")}).drop("own_bin"))
    out = None
    for part in parts:
        found = grouped_metrics(part, p, y, ["section", "value"])
        out = found if out is None else out.unionByName(found)
    return joined(out, at_home, []).withColumn("against_home", F.col("log_loss") - F.col("home")).drop("home")


def with_features(df: DataFrame, wanted: list[str]) -> DataFrame:
    """``df`` with NaN for each wanted feature that it lacks: a tree's way for missing values."""
    return df.withColumns({f: F.lit(float("nan")) for f in wanted if f not in df.columns})


def feature_coverage(df: DataFrame, wanted: list[str], domain: str, home: str) -> DataFrame:
    """For each feature of a model: whether the table has it, and how many rows at home and away have a value that is no NaN.

    Rows without a domain are neither.  One aggregate over all rows.
    """
    at_home, away = F.col(domain) == home, F.col(domain) != home
    known = lambda f: F.col(f).isNotNull() & ~F.coalesce(F.isnan(F.col(f).try_cast("double")), F.lit(False))
    counts = lambda f, cond: F.count_if(cond & known(f)) if f in df.columns else F.lit(0).cast("long")
    entries = df.agg(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(f in df.columns).alias("present"), counts(f, at_home).alias("known_home"), counts(f, away).alias("known_away"), F.count_if(at_home).alias("rows_home"), F.count_if(away).alias("rows_away")) for f in wanted]).alias("e"))
    return entries.select(F.inline("e"))


def always_keep(df: DataFrame, p: str, kept: str, by: list[str]) -> DataFrame:
    k, keep = F.col(kept), F.col(p) >= 0.5
    base = F.avg(k.cast("double"))
    return df.groupBy(*by).agg(base.alias("always_keep"), (F.avg((keep == k).cast("double")) - base).alias("lift"), F.try_divide(F.count_if(~keep & ~k), F.count_if(~k)).alias("mull_recall"), F.try_divide(F.count_if(~keep & ~k), F.count_if(~keep)).alias("mull_precision"))


def lowest_tail(df: DataFrame, p: str, ties: list[str], least: int = 50, share: int = 50) -> DataFrame:
    """The lowest max(``least``, n // ``share``) rows."""
    n = df.count()
    return positions(df, p, ties).filter(F.col("position") < max(least, n // share)).drop("position")


def most_divergent(flags: DataFrame, key: str, n: int) -> DataFrame:
    """The rows on which both models differ most, ``n`` in each direction."""
    rows = flags.filter(F.col("win_mull") != F.col("choice_mull")).withColumns({"direction": F.when(F.col("win_mull"), "win_mull").otherwise("win_keep"), "score": F.abs("score_win") + F.abs("score_choice")})
    parts = [rows.filter(F.col("direction") == d).orderBy(F.round("score", 9).desc(), key).limit(n) for d in ("win_mull", "win_keep")]
    return parts[0].unionByName(parts[1]).select("direction", key, "score")


def _draw(columns: list[str], seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"), 256)


def sample_groups(df: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` groups, drawn by a seeded hash: the same for any partitioning."""
    chosen = df.select(group).distinct().orderBy(_draw([group], seed), group).limit(n)
    return df.join(chosen, group, "left_semi")


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    return df.orderBy(_draw(key, seed), *key).limit(n)


def left_join_guarded(left: DataFrame, right: DataFrame, key: list[str], most_unmatched: float) -> DataFrame:
    """Left join with the first row of each key; fails if too many rows find none."""
    order = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in right.columns if c not in key])
    one = right.withColumn("own_first", F.row_number().over(order)).filter("own_first = 1").drop("own_first").withColumn("own_matched", F.lit(True))
    joined = left.join(one, key, "left")
    share = joined.agg(F.avg(F.col("own_matched").isNull().cast("double"))).first()[0] or 0.0
    if share > most_unmatched:
        raise ValueError(f"{share:.1%} of the rows have no match; {most_unmatched:.1%} are allowed")
    return joined.drop("own_matched")


def cell_margins(df: DataFrame, won: str) -> DataFrame:
    """Log odds of winning in each known cell (wr, ng, on_play), with one win and one loss added."""
    w = F.sum(F.col(won).cast("double"))
    known = df.filter((F.col("wr") != "unknown") & (F.col("ng") != "unknown"))
    return known.groupBy("wr", "ng", "on_play").agg(F.log((w + 1) / (F.count("*") - w + 1)).alias("margin"), F.count("*").alias("n"))


def population_margins(cells: DataFrame) -> DataFrame:
    return cells.groupBy("on_play").agg((F.sum(F.col("margin") * F.col("n")) / F.sum("n")).alias("fallback"))


def margin_lookup(df: DataFrame, cells: DataFrame, fallback: DataFrame) -> DataFrame:
    """Each row's cell margin, else its on-play marginal: tables of at most 72 and 2 rows."""
    joined = df.join(F.broadcast(cells.drop("n")), ["wr", "ng", "on_play"], "left").join(F.broadcast(fallback), "on_play", "left")
    return joined.withColumn("margin", F.coalesce("margin", "fallback")).drop("fallback")
