"""Queries: card statistics, features of decks and hands, trace roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import features as E, metrics as M, reports as R
from ..sources.adapters import Tables
from .evaluation import rounded, sql_metrics
from .registry import query

BINS = """
p AS (SELECT expansion, event_type, avg(gih) AS gih_mean FROM ratings GROUP BY 1, 2),
b AS (SELECT expansion, event_type, bin, min(play_rate) AS edge, avg(gih) AS mean, count(*) AS n FROM (SELECT *, ntile(10) OVER (PARTITION BY expansion, event_type ORDER BY play_rate, name) AS bin FROM ratings WHERE gih IS NOT NULL AND play_rate IS NOT NULL) GROUP BY 1, 2, 3),
f AS (SELECT r.expansion, r.event_type, r.name, r.gih, r.pick_count, coalesce((SELECT arg_max(b.mean, b.bin) FROM b WHERE b.expansion = r.expansion AND b.event_type = r.event_type AND (b.edge <= r.play_rate OR b.bin = 1)), p.gih_mean) AS prior FROM ratings r JOIN p ON p.expansion = r.expansion AND p.event_type = r.event_type),
s AS (SELECT expansion, event_type, name, coalesce(pick_count / (pick_count + 50.0::DOUBLE) * gih + (1 - pick_count / (pick_count + 50.0::DOUBLE)) * prior, prior) AS shrunk_gih FROM f)
"""


@query("d1_format_priors", "SELECT expansion, event_type, round(avg(gih), 6) AS gih_mean, round(avg(oh), 6) AS oh_mean FROM ratings GROUP BY 1, 2")
def priors(t: Tables) -> DataFrame:
    return rounded(E.format_priors(t.ratings, ["gih", "oh"]))


@query("d2_w1_rate_bins", "WITH" + BINS + "SELECT expansion, event_type, CAST(bin AS INT) AS bin, round(edge, 6) AS edge, round(mean, 6) AS mean, n FROM b")
def bins(t: Tables) -> DataFrame:
    return rounded(E.rate_bins(t.ratings, "gih"))


@query("d3_c18_shrinkage", "WITH" + BINS + "SELECT expansion, event_type, name, round(shrunk_gih, 6) AS shrunk_gih FROM s")
def shrinkage(t: Tables) -> DataFrame:
    return rounded(E.shrunk(t.ratings, ["gih"]))


@query("d4_z_scores", "WITH" + BINS + "SELECT expansion, event_type, name, round((shrunk_gih - avg(shrunk_gih) OVER w) / nullif(stddev_pop(shrunk_gih) OVER w, 0), 5) AS z_shrunk_gih FROM s WINDOW w AS (PARTITION BY expansion, event_type)")
def z_scores(t: Tables) -> DataFrame:
    out = E.z_scores(E.shrunk(t.ratings, ["gih"]), ["shrunk_gih"])
    return rounded(out.select("expansion", "event_type", "name", "z_shrunk_gih"), digits=5)


@query("c19_library", "SELECT d.game_id, d.card_id, CAST(d.n - coalesce(h.k, 0) AS INT) AS n FROM deck_cards d LEFT JOIN (SELECT game_id, card_id, count(*) AS k FROM hand_cards GROUP BY 1, 2) h USING (game_id, card_id) WHERE d.n - coalesce(h.k, 0) > 0")
def library(t: Tables) -> DataFrame:
    return E.library_of(t.deck_cards, t.hand_cards)


#: Categories of the view of roles, as SQL.
SPELL, LAND = "NOT is_land", "is_land"
CREATURE, TOKENS = "(is_creature AND NOT is_land)", "(is_creature OR makes_creatures)"
REMOVAL = "(destroy_or_exile OR burn OR bounce OR top_library OR removal_aura OR counterspell)"
MV = {"mv_le2": "coalesce(mana_value, 0) <= 2", "mv_0_2": "coalesce(mana_value, 0) <= 2", "mv_3": "mana_value = 3", "mv_4_5": "mana_value BETWEEN 4 AND 5", "mv_ge6": "mana_value >= 6", "mv_3p": "mana_value >= 3", "mv_4p": "mana_value >= 4"}


def with_colors(t: Tables) -> DataFrame:
    """The view of roles with the colours that a cost requires."""
    pips = {c: F.col(f"pip_{c.lower()}") for c in E.COLORS}
    colors = F.array_compact(F.array(*[F.when(n > 0, F.lit(c)) for c, n in pips.items()]))
    return t.role_cards.withColumns({"colors": colors, "double_pip": F.greatest(*pips.values()) >= 2})


def deck_sql() -> str:
    share = lambda cond: f"round(coalesce(coalesce(sum(n) FILTER (WHERE {cond}), 0) / nullif(sum(n) FILTER (WHERE {SPELL}), 0)::DOUBLE, 0), 6)"
    parts = [f"{share(CREATURE)} AS pct_creatures", f"{share(f'{REMOVAL} AND {SPELL}')} AS pct_removal"]
    parts += [f"{share(f'{MV[b]} AND {SPELL}')} AS pct_{b}" for b in E.CURVE] + [f"{share(f'{MV[b]} AND {CREATURE}')} AS pct_creatures_{b}" for b in E.CURVE]
    for name, more in (("main_colors", 3), ("colors", 0)):
        parts.append("CAST(" + " + ".join(f"CASE WHEN coalesce(sum(n) FILTER (WHERE pip_{c} > 0 AND {SPELL}), 0) > {more} THEN 1 ELSE 0 END" for c in "wubrg") + f" AS INT) AS {name}")
    parts += [f"round(coalesce(sum({r} * n) FILTER (WHERE {SPELL}) / nullif(sum(n) FILTER (WHERE {SPELL} AND {r} IS NOT NULL), 0), 0), 6) AS mean_{r}" for r in E.RATES]
    return f"SELECT game_id, CAST(sum(n) AS BIGINT) AS cards, round(coalesce(sum(n) FILTER (WHERE is_land), 0) / nullif(sum(n), 0)::DOUBLE, 6) AS pct_lands, {', '.join(parts)} FROM deck_cards JOIN role_cards USING (card_id) GROUP BY game_id"


@query("d5_x21_deck_features", deck_sql())
def deck_features(t: Tables) -> DataFrame:
    return rounded(E.deck_features(t.deck_cards, with_colors(t)))


def hand_sql() -> str:
    n = lambda cond, name: f"count(*) FILTER (WHERE {cond}) AS {name}"
    ramp = "(mana_ability OR fetches_land)"
    parts = [n(LAND, "lands"), n("is_land AND NOT is_basic", "nonbasic_lands"), n(SPELL, "spells"), n(f"{ramp} AND {SPELL}", "ramp_spells"), n(f"alt_mode AND {SPELL}", "multi_modal"), n(f"{MV['mv_ge6']} AND {SPELL} AND NOT alt_mode", "heavy_one_mode"), n(f"{MV['mv_ge6']} AND {SPELL} AND alt_mode", "heavy_alt_mode")]
    parts += [n(f"{CREATURE} AND {cond}", f"creature_{b}") for b, cond in (("mv_le2", MV["mv_le2"]), ("mv_3", MV["mv_3"]), ("mv_4", "mana_value = 4"), ("mv_5", "mana_value = 5"), ("mv_ge6", MV["mv_ge6"]))]
    parts += [n(f"{'draw' if r == 'card_manipulation' else r} AND {SPELL} AND {MV[b]}", f"{r}_{b}") for r in E.GRID_ROLES for b in E.GRID]
    for z in ("z_oh", "z_gd"):
        parts += [n(f"{cond} AND {SPELL}", f"{z}_{b}") for b, cond in (("bomb", f"{z} > 1.3"), ("good", f"{z} >= 0.4 AND {z} <= 1.3"), ("average", f"{z} >= -0.7 AND {z} < 0.4"), ("poor", f"{z} < -0.7"))]
    parts.append(n(f"greatest(pip_w, pip_u, pip_b, pip_r, pip_g) >= 2 AND {SPELL}", "double_pip"))
    rate = lambda f, c, name: f"round(coalesce({f}({c}) FILTER (WHERE {SPELL}), 0), 6) AS {name}"
    parts += [rate("avg", "gih", "avg_gih"), rate("max", "oh", "max_oh"), rate("max", "gd", "max_gd"), rate("sum", "gih", "sum_gih"), rate("avg", "oh - gd", "avg_earliness"), rate("max", "gih", "max_gih"), rate("avg", "weight", "avg_weight")]
    parts.append("CAST(" + " + ".join(f"coalesce(max(CASE WHEN pip_{c} > 0 THEN 1 ELSE 0 END) FILTER (WHERE {SPELL}), 0)" for c in "wubrg") + " AS INT) AS distinct_colors")
    return f"WITH h AS (SELECT game_id, {', '.join(parts)} FROM hand_cards JOIN role_cards USING (card_id) GROUP BY game_id) SELECT h.*, CAST(d.mulligan_number AS DOUBLE) AS mulligan_number FROM h JOIN decisions d USING (game_id)"


@query("d6_d7_hand_features", hand_sql())
def hand_features(t: Tables) -> DataFrame:
    return rounded(E.hand_features(t.hand_cards, with_colors(t)).join(t.decisions.select("game_id", F.col("mulligan_number").cast("double").alias("mulligan_number")), "game_id"))


ROLE_COLUMNS = {r: [f"{r}_{b}" for b in E.GRID] for r in E.GRID_ROLES} | {"ramp spell": ["ramp_spells"], "multi-modal spell": ["multi_modal"]} | {f"{k}-drop creature": [f"creature_{b}"] for k, b in (("2", "mv_le2"), ("3", "mv_3"), ("4", "mv_4"), ("5", "mv_5"), ("6+", "mv_ge6"))}


def slices_sql() -> str:
    """(label, condition) of each slice of hands, written out."""
    out = [(f"{k}{'+' if k == most else ''} {label}", f"{c} {'>=' if k == most else '='} {k}") for label, c, least, most in (("main colors", "main_colors", 1, 4), ("total colors", "deck_colors", 1, 4), ("lands", "lands", 0, 5), ("double pips", "double_pip", 0, 3), ("colors needed", "distinct_colors", 0, 3)) for k in range(least, most + 1)]
    for role, columns in ROLE_COLUMNS.items():
        out += [(f"has {role}", f"{' + '.join(columns)} > 0"), (f"no {role}", f"{' + '.join(columns)} = 0")]
    for name, c, cuts, more in (("p land drop t3", "lands_t3", ("0.5", "0.7", "0.85", "0.95"), ""), ("mana t4", "mana_t4", ("3", "3.5", "4"), ""), ("max gih", "max_gih", ("0.48", "0.52", "0.56", "0.6"), " AND spells > 0")):
        out += [(f"{name} < {cuts[0]}", f"{c} < {cuts[0]}{more}"), *[(f"{a} <= {name} < {b}", f"{c} >= {a} AND {c} < {b}{more}") for a, b in zip(cuts, cuts[1:])], (f"{name} >= {cuts[-1]}", f"{c} >= {cuts[-1]}{more}")]
    return ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for label, cond in [*out, ("no spells", "spells = 0")])


TURNS = [f"avg(CASE WHEN turn = {k} THEN CASE WHEN lands >= {k} THEN 1.0 ELSE 0.0 END END) AS lands_t{k}" for k in (2, 3, 4, 5)] + [f"avg(CASE WHEN turn = {k} THEN mana END) AS mana_t{k}" for k in (2, 3, 4)]


@query("b29b_hand_slices", f"""
WITH hf AS ({hand_sql().replace("WITH h AS", "SELECT * FROM (WITH h AS", 1)})), df AS ({deck_sql()}), g AS (SELECT run, {", ".join(TURNS)} FROM traces GROUP BY run),
x AS (SELECT hf.*, df.main_colors, df.colors AS deck_colors, g.lands_t3, g.mana_t4, d.p_keep, CASE WHEN d.was_kept THEN 1 ELSE 0 END AS y FROM hf JOIN df USING (game_id) JOIN decisions d USING (game_id) LEFT JOIN g ON g.run = hf.game_id),
s AS (SELECT unnest([{slices_sql()}]) AS slice, p_keep, y FROM x)
SELECT slice, {sql_metrics("p_keep", "y")} FROM s WHERE slice IS NOT NULL GROUP BY slice""")
def hand_slices(t: Tables) -> DataFrame:
    """Metrics of every slice of hands, those that have rows."""
    cards, games = with_colors(t), E.game_rollup(t.traces, ["run"]).withColumnRenamed("run", "game_id")
    decks = E.deck_features(t.deck_cards, cards).select("game_id", "main_colors", F.col("colors").alias("deck_colors"))
    rows = E.hand_features(t.hand_cards, cards).join(decks, "game_id").join(t.decisions.select("game_id", "p_keep", F.col("was_kept").cast("int").alias("y")), "game_id").join(games, "game_id", "left")
    return rounded(M.slice_metrics(rows, "p_keep", "y", R.hand_slices(ROLE_COLUMNS)).filter("n > 0"))


def odds_sql() -> str:
    sets = {1: {"spell": "TRUE", "creature": TOKENS}, 2: {"spell": "TRUE", "creature": TOKENS}}
    sets |= {t: {f"{n}_{b}": f"{c} AND coalesce({MV[b]}, FALSE)" for n, c in (("spell", "TRUE"), ("creature", TOKENS)) for b in bs} for t, bs in ((3, ("mv_0_2", "mv_3p")), (4, ("mv_0_2", "mv_3", "mv_4p")))}
    narrow = {"pump": "(trick OR pump_aura)", "equipment_or_vehicle": "(equipment OR vehicle)", "card_manipulation": "draw", "other": "is_other", "alt_mode": "alt_mode"}
    out = []
    for t, broad in sets.items():
        broad = {**broad, "removal": REMOVAL}
        every = {n + s: f"{c} AND z_oh > 0.5" if s else c for n, c in broad.items() for s in ("", "_strong")} | (narrow if t > 1 else {})
        for n, c in every.items():
            out.append(f"round(coalesce(1 - product(1 - c{t}) FILTER (WHERE is_land = FALSE AND {c}), 0), 6) AS any_{n}_t{t}")
            if t > 1:
                out.append(f"round(coalesce(sum(c{t}) FILTER (WHERE is_land = FALSE AND {c}), 0), 6) AS count_{n}_t{t}")
    return ", ".join(out)


GAMES = [f"lands_t{k}" for k in (2, 3, 4, 5)] + [f"mana_t{k}" for k in (2, 3, 4)]
@query("d8_x18_castability", f"""
WITH x AS (SELECT game_id, n, r.* FROM deck_cards JOIN role_cards r USING (card_id)), o AS (SELECT game_id, {odds_sql()}, round(coalesce(sum(c4 * n) FILTER (WHERE NOT is_land) / nullif(sum(n) FILTER (WHERE NOT is_land), 0), 0), 6) AS deck_castable_t4 FROM x GROUP BY game_id),
h AS (SELECT game_id, round(coalesce(avg(c4) FILTER (WHERE NOT is_land), 0), 6) AS hand_castable_t4 FROM hand_cards JOIN role_cards USING (card_id) GROUP BY game_id),
g AS (SELECT run, {", ".join(TURNS)} FROM traces GROUP BY run)
SELECT o.*, h.hand_castable_t4, {", ".join(f"round(g.{c}, 6) AS {c}" for c in GAMES)} FROM o LEFT JOIN h USING (game_id) LEFT JOIN g ON g.run = o.game_id""")
def castability(t: Tables) -> DataFrame:
    games = E.game_rollup(t.traces, ["run"]).withColumnRenamed("run", "game_id")
    return rounded(E.simulation_features(t.deck_cards, t.hand_cards, t.role_cards, games))


@query("d9_context_features", "SELECT game_id, CASE WHEN on_play THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS on_the_play, CASE WHEN event_type = 'PremierDraft' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS event_PremierDraft, CASE WHEN expansion = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS set_BUILDING, CASE WHEN expansion = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS set_MACHINERY FROM decisions")
def context(t: Tables) -> DataFrame:
    return E.context_features(t.decisions, "on_play", "event_type", "expansion", ["PremierDraft"], ["BUILDING", "MACHINERY"]).select("game_id", "on_the_play", "event_PremierDraft", "set_BUILDING", "set_MACHINERY")


def rollup_sql(by: str) -> str:
    cols = ", ".join(f"round(count(*) FILTER (WHERE first_in_hand <= {k}) / count(*)::DOUBLE, 6) AS in_hand_t{k}, round(coalesce(count(*) FILTER (WHERE first_in_hand <= {k} AND first_castable <= {k}) / nullif(count(*) FILTER (WHERE first_in_hand <= {k}), 0)::DOUBLE, 0), 6) AS castable_t{k}, round(count(*) FILTER (WHERE first_castable = {k}) / count(*)::DOUBLE, 6) AS first_t{k}" for k in (1, 2, 3, 4))
    return f"SELECT {by}, count(*) AS instances, {cols}, round(count(*) FILTER (WHERE first_castable > 4) / count(*)::DOUBLE, 6) AS first_later FROM traces GROUP BY {by}"


@query("d10_trace_rollup", rollup_sql("name"))
def trace_rollup(t: Tables) -> DataFrame:
    return rounded(E.trace_rollup(t.traces, ["name"]))


@query("d12_mode_rollup", rollup_sql("name, mode_index"))
def mode_rollup(t: Tables) -> DataFrame:
    return rounded(E.trace_rollup(t.traces, ["name", "mode_index"]))


@query("d11_snapshot_marginal", "WITH f AS (SELECT run, name, min(first_castable) AS turn FROM traces GROUP BY 1, 2), g AS (SELECT count(DISTINCT run) AS games FROM traces) SELECT name, " + ", ".join(f"round(count(*) FILTER (WHERE turn <= {k}) / max(games)::DOUBLE, 6) AS by_t{k}" for k in (1, 2, 3, 4)) + " FROM f, g GROUP BY name")
def snapshot(t: Tables) -> DataFrame:
    return rounded(E.snapshot_marginal(t.traces))


@query("d13_game_rollup", "SELECT " + ", ".join([f"round(avg(CASE WHEN turn = {k} THEN CASE WHEN lands >= {k} THEN 1.0 ELSE 0.0 END END), 6) AS lands_t{k}" for k in (2, 3, 4, 5)] + [f"round(avg(CASE WHEN turn = {k} THEN mana END), 6) AS mana_t{k}" for k in (2, 3, 4)]) + " FROM traces")
def game_rollup(t: Tables) -> DataFrame:
    return rounded(E.game_rollup(t.traces))


MISS = lambda cond, t: f"coalesce(product(1 - c{t}) FILTER (WHERE NOT is_land AND {cond}), 1)"


@query("d49_hand_explanation", f"""
WITH r AS (SELECT game_id, x.* FROM hand_cards JOIN role_cards x USING (card_id)), d AS (SELECT DISTINCT * FROM r), l AS (SELECT game_id, count(*) FILTER (WHERE is_land) AS lands FROM r GROUP BY game_id),
m AS (SELECT game_id, {", ".join(f"{MISS(TOKENS, t)} AS a{t}, {MISS('NOT ' + TOKENS, t)} AS b{t}" for t in (1, 2, 3, 4))} FROM d GROUP BY game_id)
SELECT game_id, lands, {", ".join(f"round(1 - a{t}, 6) AS creature_t{t}, round(1 - b{t}, 6) AS other_t{t}, round(1 - a{t} * b{t}, 6) AS spell_t{t}" for t in (1, 2, 3, 4))} FROM l JOIN m USING (game_id)""")
def explanation(t: Tables) -> DataFrame:
    return rounded(E.hand_explanation(t.hand_cards, t.role_cards)[1])


@query("d49b_card_explanation", "SELECT game_id, card_id, name, is_land, coalesce(mana_value, 0) AS mana_value, " + ", ".join(f"round(c{t}, 6) AS castable_t{t}" for t in (1, 2, 3, 4)) + ", round(oh, 6) AS oh FROM hand_cards JOIN role_cards USING (card_id)")
def card_explanation(t: Tables) -> DataFrame:
    return rounded(E.hand_explanation(t.hand_cards, t.role_cards)[0])


HASH = "CAST('0x' || substr(sha256({x}), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE"


@query("l11_smoothed_hands", f"""
WITH k AS (SELECT game_id, card_id, is_land, unnest(range(1, n + 1)) AS copy FROM deck_cards JOIN cards USING (card_id)),
s AS (SELECT game_id, avg(CASE WHEN is_land THEN 1.0 ELSE 0.0 END) AS deck_share FROM k GROUP BY 1),
d AS (SELECT k.*, c AS candidate, row_number() OVER (PARTITION BY game_id, c ORDER BY {HASH.format(x="concat_ws(':', '0', game_id, c, card_id, copy)")}, card_id, copy) AS rk FROM k, range(1, 4) g(c)),
h AS (SELECT game_id, candidate, count(*) FILTER (WHERE is_land) AS lands, count(*) AS size, string_agg(CAST(card_id AS STRING), '|' ORDER BY card_id) AS hand FROM d WHERE rk <= 7 GROUP BY 1, 2),
w AS (SELECT h.*, exp(-pow(lands / size::DOUBLE - deck_share, 2) / 0.015::DOUBLE) AS weight FROM h JOIN s USING (game_id)),
u AS (SELECT *, sum(weight) OVER (PARTITION BY game_id ORDER BY candidate) AS upto, sum(weight) OVER (PARTITION BY game_id) * {HASH.format(x="concat_ws(':', '0', game_id)")} AS pick FROM w)
SELECT game_id, CAST(candidate AS INT) AS candidate, lands, hand FROM u WHERE upto > pick AND upto - weight <= pick""")
def smoothed(t: Tables) -> DataFrame:
    out = E.smoothed_hands(t.deck_cards, t.cards)
    return out.select("game_id", "candidate", "lands", F.array_join(F.transform("hand", lambda c: c.cast("string")), "|").alias("hand"))


@query("l9_mono_color_decks", "SELECT color, CAST(rk AS INT) AS rk, card_id, name FROM (SELECT *, row_number() OVER (PARTITION BY color ORDER BY mana_value, name, card_id) AS rk, count(*) OVER (PARTITION BY color) AS k FROM cards WHERE NOT is_land AND color IS NOT NULL AND mana_value <= 6) WHERE rk <= 23 AND k >= 23")
def mono_decks(t: Tables) -> DataFrame:
    return E.mono_color_decks(t.cards)
