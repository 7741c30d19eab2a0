"""Queries over the card catalogue: predicates, joins, search, merges, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cards as K
from ..operators import catalogue as C
from ..sources.adapters import Tables
from .registry import query


CATEGORIES = {
    "land": "is_land", "spell": "NOT is_land", "nonbasic_land": "is_land AND NOT is_basic", "creature": "is_creature", "creature_or_tokens": "is_creature OR makes_creatures", "removal": "destroy_or_exile OR burn OR bounce OR top_library OR removal_aura OR counterspell",
    "trick": "trick", "pump": "trick OR pump_aura", "equipment_or_vehicle": "equipment OR vehicle", "card_manipulation": "draw", "alt_mode": "alt_mode", "mana_ability": "mana_ability", "fetches_land": "fetches_land", "ramp": "mana_ability OR fetches_land", "other": "is_other",
    "mv_le2": "coalesce(mana_value, 0) <= 2", "mv_3": "coalesce(mana_value, 0) = 3", "mv_4_5": "coalesce(mana_value, 0) BETWEEN 4 AND 5", "mv_ge6": "coalesce(mana_value, 0) >= 6", "mv_0_2": "coalesce(mana_value, 0) <= 2", "mv_ge3": "coalesce(mana_value, 0) >= 3", "mv_ge4": "coalesce(mana_value, 0) >= 4",
}


def nested(t: Tables) -> DataFrame:
    """The view of roles as a nested catalogue."""
    c, flag = F.col, lambda name: F.col(name)
    given = lambda name, value: F.when(c(name), value)
    pips = F.map_filter(F.create_map(*[x for k in "WUBRG" for x in (F.lit(k), c(f"pip_{k.lower()}"))]), lambda _, n: n > 0)
    effect = lambda kind, to: F.struct(F.lit(kind).alias("kind"), to.alias("destination"))
    mode = lambda kind, *effects: F.struct(F.lit(kind).alias("kind"), F.array(*effects).alias("effects"))
    fetch = effect("fetch_land", F.when(c("fetches_land"), F.when(c("card_id") % 2 == 0, "battlefield_tapped").otherwise("battlefield_untapped")).otherwise("hand"))
    cast, cycle = mode("cast", effect("damage", F.lit(None).cast("string")), fetch), mode("cycle", effect("fetch_land", F.lit("hand")))
    keyword = F.array(F.lit("flying"))
    roles = {
        "is_creature": flag("is_creature"), "removal_destroy_or_exile": flag("destroy_or_exile"), "removal_burn_damage": given("burn", c("card_id") % 4), **{f"is_{r}": flag(r) for r in ("bounce", "top_library", "removal_aura", "counterspell", "punch_fight", "pump_aura", "equipment", "vehicle", "saga", "planeswalker")}, "is_class": flag("class_card"),
        "combat_trick_power": F.when(c("trick") & (c("card_id") % 3 == 0), F.lit(0)), "combat_trick_toughness": F.when(c("trick") & (c("card_id") % 3 == 1), F.lit(2)), "combat_trick_granted_keywords": F.when(c("trick") & (c("card_id") % 3 == 2), keyword).otherwise(F.slice(keyword, 1, 0)),
        "cards_drawn": F.when(c("draw") & (c("card_id") % 2 == 0), 2).otherwise(0), "cards_manipulated": F.when(c("draw") & (c("card_id") % 2 == 1), 1).otherwise(0), "creates_creatures": given("makes_creatures", keyword), "is_other": flag("is_other"),
    }
    none = F.slice(F.array(F.lit("")), 1, 0)
    return t.role_cards.select(
        "card_id", "name", F.array(F.when(c("is_land"), "Land").otherwise("Sorcery")).alias("types"), F.when(c("is_basic"), F.array(F.lit("Basic"))).otherwise(none).alias("supertypes"),
        F.when(~c("is_land"), F.struct(c("mana_value").alias("cmc"), pips.alias("color_pips"))).alias("mana_cost"), F.when(c("alt_mode"), F.array(cast, cycle)).otherwise(F.array(cast)).alias("modes"),
        F.when(c("mana_ability"), F.array(F.lit("G"))).otherwise(none).alias("mana_abilities"), F.struct(*[v.alias(k) for k, v in roles.items()]).alias("role_features"),
    )


@query("b22_b23_categories", "SELECT card_id, " + ", ".join(f"({cond}) AS {name}" for name, cond in CATEGORIES.items()) + ", CASE WHEN is_land THEN 0 ELSE " + " + ".join(f"CAST(pip_{c} > 0 AS INT)" for c in "wubrg") + " END AS colors, coalesce(NOT is_land AND greatest(pip_w, pip_u, pip_b, pip_r, pip_g) >= 2, FALSE) AS double_pip FROM role_cards")
def categories(t: Tables) -> DataFrame:
    """From the nested catalogue to flags."""
    flat = C.flat_roles(nested(t))
    return flat.select("card_id", *[c.alias(n) for n, c in (C.categories() | C.mana_buckets(F.col("mana_value"))).items()], F.size("colors").alias("colors"), "double_pip")


ROLES = ["makes_creatures", "destroy_or_exile", "burn", "bounce", "top_library", "removal_aura", "counterspell", "punch_fight", "trick", "pump_aura", "saga", "class_card", "draw", "alt_mode", "mana_ability", "fetches_land"]
#: Type lines by the kind of a card: each of the five flags follows from one of them.
TYPED = """
SELECT r.*, c.kind, CASE c.kind WHEN 'STANDARD' THEN 'Creature' WHEN 'ECONOMY' THEN 'Planeswalker' WHEN 'PROMO' THEN 'Land' ELSE 'Artifact' END AS own_type, CASE c.kind WHEN 'SMALL' THEN 'Equipment' WHEN 'MEDIUM' THEN 'Vehicle' ELSE 'None' END AS own_subtype
FROM role_cards r JOIN cards c ON r.card_id = c.card_id
"""
FORCED = {"is_creature": "own_type = 'Creature'", "planeswalker": "own_type = 'Planeswalker'", "is_land": "own_type = 'Land'", "equipment": "own_subtype = 'Equipment'", "vehicle": "own_subtype = 'Vehicle'"}


@query("b24_invariants", f"WITH t AS ({TYPED}), f AS (SELECT *, {', '.join(f'({flag} OR {cond}) AS now_{flag}' for flag, cond in FORCED.items())} FROM t) SELECT card_id, {', '.join(f'now_{f} AS {f}' for f in FORCED)}, NOT ({' OR '.join([*(f'now_{f}' for f in FORCED), *ROLES])}) AS is_other, CASE WHEN now_is_land THEN 0 ELSE 1 END AS modes FROM f")
def invariants(t: Tables) -> DataFrame:
    kinds = t.cards.select("card_id", "kind")
    is_kind = lambda pairs, rest: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in pairs.items()], F.lit(rest))
    typed = t.role_cards.join(kinds, "card_id").withColumns({"types": F.array(is_kind({"STANDARD": "Creature", "ECONOMY": "Planeswalker", "PROMO": "Land"}, "Artifact")), "subtypes": F.array(is_kind({"SMALL": "Equipment", "MEDIUM": "Vehicle"}, "None"))})
    return C.with_invariants(typed, ROLES).select("card_id", *C.TYPE_FLAGS, "is_other", F.size("modes").alias("modes"))


@query("b19_search", "SELECT card_id, name, total FROM (SELECT *, count(*) OVER () AS total FROM cards WHERE lower(name) LIKE '%i%' AND status = 'parsed' AND color IS NULL AND is_removal AND NOT is_land ORDER BY name, card_id LIMIT 200)")
def search(t: Tables) -> DataFrame:
    return C.search(t.cards, {"removal": F.col("is_removal") & ~F.col("is_land")}, contains="I", status="parsed", colors=["C"], having=["removal", "no such flag"]).select("card_id", "name", "total")


@query("b20_filter_raw", "SELECT card_id FROM cards WHERE kind IN ('ECONOMY', 'PROMO') AND set_code IN ('Brand#1', 'Brand#2', 'Brand#3') AND card_id % 4 <> 2")
def filter_raw(t: Tables) -> DataFrame:
    raw = t.cards.withColumn("lang", F.when(F.col("card_id") % 4 == 2, "ja").when(F.col("card_id") % 4 == 1, "de").otherwise("en"))
    return C.filter_raw(raw, ["ECONOMY", "PROMO"], ["en", "de"], ["Brand#1", "Brand#2", "Brand#3"], layout="kind").select("card_id")


@query("b21_encoding_offenders", """
WITH bad AS (SELECT card_id, concat(name, CASE WHEN status LIKE 'needs%' THEN concat(': status ', status) ELSE ': no modes' END) AS message FROM cards WHERE status LIKE 'needs%' OR (NOT is_land AND card_id % 21 = 4)),
d AS (SELECT DISTINCT game_id, message FROM deck_cards JOIN bad USING (card_id))
SELECT game_id, string_agg(message, '; ' ORDER BY message) AS offenders FROM d GROUP BY game_id""")
def offenders(t: Tables) -> DataFrame:
    cards = t.cards.withColumn("mana_value", F.when(F.col("card_id") % 21 != 4, F.col("mana_value")))
    return C.encoding_offenders(cards, t.deck_cards)


@query("b30_d24_keep_rate_by_lands", """
WITH l AS (SELECT game_id, count(*) FILTER (WHERE is_land) AS lands FROM hand_cards JOIN cards USING (card_id) GROUP BY game_id)
SELECT expansion, on_play, coalesce(CAST(lands AS STRING), 'ALL') AS lands, count(*) AS n, round(avg(CASE WHEN was_kept THEN 1.0 ELSE 0.0 END), 6) AS keep_rate
FROM decisions JOIN l USING (game_id) WHERE mulligan_number = 0 GROUP BY GROUPING SETS ((expansion, on_play, lands), (expansion, on_play))""")
def keep_rate_by_lands(t: Tables) -> DataFrame:
    lands = t.hand_cards.join(t.cards, "card_id").groupBy("game_id").agg(F.count_if("is_land").alias("lands"))
    rows = t.decisions.filter("mulligan_number = 0").join(lands, "game_id")
    out = rows.groupingSets([["expansion", "on_play", "lands"], ["expansion", "on_play"]], "expansion", "on_play", "lands").agg(F.grouping("lands").alias("g"), F.count("*").alias("n"), F.avg(F.col("was_kept").cast("double")).alias("keep_rate"))
    return out.select("expansion", "on_play", F.when(F.col("g") == 1, "ALL").otherwise(F.col("lands").cast("string")).alias("lands"), "n", F.round("keep_rate", 6).alias("keep_rate"))


RATED = "(SELECT name, sum(pick_count) AS picks FROM ratings GROUP BY name)"


@query("c1_name_join", f"""
SELECT c.card_id, CASE WHEN a.name IS NOT NULL THEN 'full' WHEN b.name IS NOT NULL THEN 'front' END AS matched_by, CAST(coalesce(a.picks, b.picks) AS BIGINT) AS picks
FROM cards c LEFT JOIN {RATED} a ON a.name = c.name LEFT JOIN {RATED} b ON b.name = split_part(c.name, ' // ', 1)""")
def name_join(t: Tables) -> DataFrame:
    stats = t.ratings.groupBy("name").agg(F.sum("pick_count").alias("picks"))
    return C.join_by_name(t.cards, stats).select("card_id", "matched_by", "picks")


@query("c2_c11_three_tier_match", """
WITH r AS (SELECT p_partkey + 90000 AS arena_id, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name, p_retailprice AS price FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT NULL, concat(p_name, ' ', CAST(p_partkey AS STRING)), p_retailprice + 1 FROM part WHERE p_partkey % 3 = 1)
SELECT c.card_id, CASE WHEN i.price IS NOT NULL THEN 'id' WHEN n.price IS NOT NULL THEN 'name' WHEN f.price IS NOT NULL THEN 'front' END AS tier, round(coalesce(i.price, n.price, f.price), 2) AS price
FROM cards c LEFT JOIN r i ON i.arena_id = c.arena_id LEFT JOIN r n ON n.name = c.name LEFT JOIN r f ON f.name = split_part(c.name, ' // ', 1)""")
def three_tier(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    with_id = t.part.filter("p_partkey % 3 = 0").select((F.col("p_partkey") + 90000).alias("arena_id"), name.alias("name"), F.col("p_retailprice").alias("price"))
    without = t.part.filter("p_partkey % 3 = 1").select(F.lit(None).cast("long").alias("arena_id"), name.alias("name"), (F.col("p_retailprice") + 1).alias("price"))
    return C.three_tier_match(t.cards, with_id.unionByName(without), "price").select("card_id", "tier", F.round("price", 2).alias("price"))


@query("c3_name_lookup", """
WITH u AS (SELECT name AS lookup, card_id, 0 AS pr FROM cards UNION ALL SELECT split_part(name, ' // ', 1), card_id, 1 FROM cards WHERE name LIKE '% // %'
  UNION ALL SELECT x, NULL, 2 FROM (VALUES ('Plains'), ('Island'), ('Swamp'), ('Mountain'), ('Forest')) v(x)),
r AS (SELECT *, row_number() OVER (PARTITION BY lookup ORDER BY pr, card_id) AS rk FROM u)
SELECT lookup, card_id, CASE pr WHEN 0 THEN 'name' WHEN 1 THEN 'front' ELSE 'basic' END AS source FROM r WHERE rk = 1""")
def name_lookup(t: Tables) -> DataFrame:
    return C.name_lookup(t.cards)


@query("a7_c4_resolve_ids", """
WITH n AS (SELECT card_id AS id, name FROM cards WHERE card_id % 50 <> 7)
SELECT game_id, string_agg(coalesce(n.name, concat('?', CAST(h.card_id AS STRING))), '|' ORDER BY slot) AS hand, count(*) FILTER (WHERE n.name IS NULL) AS unknown FROM hand_cards h LEFT JOIN n ON n.id = h.card_id GROUP BY game_id""")
def resolve_ids(t: Tables) -> DataFrame:
    ids = t.hand_cards.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("slot", "card_id"))).alias("x")).select("game_id", F.col("x.card_id").alias("ids"))
    names = t.cards.filter("card_id % 50 <> 7").select(F.col("card_id").alias("id"), "name")
    return C.resolve_ids(ids, "ids", names, ["game_id"]).select("game_id", F.array_join("hand", "|").alias("hand"), "unknown")


@query("c6_hand_join", """
WITH h AS (SELECT game_id, string_agg(concat(CAST(card_id AS STRING), ' x', CAST(n AS STRING)), ' | ' ORDER BY concat(CAST(card_id AS STRING), ' x', CAST(n AS STRING))) AS hand FROM deck_cards GROUP BY game_id),
u AS (SELECT hand FROM h GROUP BY hand HAVING count(*) = 1)
SELECT h.game_id, round(d.p_keep, 6) AS p_keep FROM h JOIN u USING (hand) JOIN decisions d USING (game_id)""")
def hand_join(t: Tables) -> DataFrame:
    deck = F.collect_list(F.struct(F.col("card_id").cast("string").alias("card"), "n"))
    decks = t.deck_cards.groupBy("game_id").agg(deck.alias("x")).select("game_id", K.encode_deck(F.col("x")).alias("hand"))
    scored = decks.join(t.decisions.select("game_id", "p_keep"), "game_id").select("hand", "p_keep")
    return C.one_to_one(decks, scored, "hand").select("game_id", F.round("p_keep", 6).alias("p_keep"))


@query("c10_bonus_sheet", """
WITH own AS (SELECT name FROM cards WHERE set_code = 'Brand#1' UNION SELECT split_part(name, ' // ', 1) FROM cards WHERE set_code = 'Brand#1'),
r AS (SELECT DISTINCT name FROM ratings WHERE expansion IN ('Brand#1', 'Brand#2')), m AS (SELECT name FROM r WHERE name NOT IN (SELECT name FROM own)),
p AS (SELECT name, set_code, card_id FROM cards WHERE card_id % 7 <> 0 UNION ALL SELECT split_part(name, ' // ', 1), set_code, card_id FROM cards WHERE card_id % 7 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY set_code, card_id) AS rk FROM p)
SELECT m.name, f.set_code AS from_set, f.card_id FROM m LEFT JOIN f ON f.name = m.name AND f.rk = 1""")
def bonus_sheet(t: Tables) -> DataFrame:
    found, missed = C.bonus_sheet(t.ratings.filter(F.col("expansion").isin("Brand#1", "Brand#2")), t.cards.filter("set_code = 'Brand#1'"), t.cards.filter("card_id % 7 <> 0"))
    return found.unionByName(missed, allowMissingColumns=True).select("name", "from_set", "card_id")


NEW_CARDS = "(SELECT card_id, name, set_code, kind, CASE WHEN card_id % 12 = 0 THEN 'parsed' ELSE status END AS status, mana_value + CASE WHEN card_id % 25 = 3 THEN 1 ELSE 0 END AS mana_value, coalesce(arena_id, CASE WHEN card_id % 8 = 0 THEN card_id + 70000 END) AS arena_id FROM cards WHERE card_id % 30 <> 11)"


def new_cards(t: Tables) -> DataFrame:
    c = F.col
    rows = t.cards.filter("card_id % 30 <> 11")
    return rows.select("card_id", "name", "set_code", "kind", F.when(c("card_id") % 12 == 0, "parsed").otherwise(c("status")).alias("status"), (c("mana_value") + F.when(c("card_id") % 25 == 3, 1).otherwise(0)).alias("mana_value"), F.coalesce("arena_id", F.when(c("card_id") % 8 == 0, c("card_id") + 70000)).alias("arena_id"))


@query("c12_u4_version_diff", f"""
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM cards WHERE card_id % 40 <> 5) a FULL JOIN {NEW_CARDS} b ON a.name = b.name
WHERE a.name IS NULL OR b.name IS NULL OR a.kind IS DISTINCT FROM b.kind OR a.mana_value IS DISTINCT FROM b.mana_value""")
def version_diff(t: Tables) -> DataFrame:
    return C.compare_versions(t.cards.filter("card_id % 40 <> 5"), new_cards(t), "name", ["kind", "mana_value"])


@query("c15_merge_catalogue", f"""
WITH m AS (SELECT n.card_id, CASE WHEN o.card_id IS NULL THEN 'added' WHEN o.status IN ('reviewed', 'needs_human') THEN 'kept' ELSE 'replaced' END AS action, n.status AS ns, o.status AS os, n.mana_value AS nm, o.mana_value AS om, n.arena_id AS na, o.arena_id AS oa
  FROM {NEW_CARDS} n LEFT JOIN (SELECT * FROM cards WHERE card_id % 40 <> 5) o USING (card_id))
SELECT card_id, action, coalesce(na, CASE WHEN action = 'kept' THEN oa END) AS arena_id, CASE WHEN action = 'kept' THEN os ELSE ns END AS status, CASE WHEN action = 'kept' THEN om ELSE nm END AS mana_value FROM m""")
def merge(t: Tables) -> DataFrame:
    fresh = new_cards(t)
    prior = t.cards.filter("card_id % 40 <> 5").select(*fresh.columns)
    return C.merge_catalogue(prior, fresh, "card_id").select("card_id", "action", "arena_id", "status", "mana_value")


@query("c16_patch_merge", """
SELECT card_id, CASE WHEN card_id % 19 = 2 THEN 'patched' ELSE status END AS status, CASE WHEN card_id % 38 = 2 THEN 9 ELSE mana_value END AS mana_value FROM cards""")
def patches(t: Tables) -> DataFrame:
    p = t.cards.filter("card_id % 19 = 2").select("card_id", F.lit("patched").alias("status"), F.when(F.col("card_id") % 38 == 2, 9).alias("mana_value"))
    return C.apply_patches(t.cards, p, ["card_id"], ["status", "mana_value"])[0].select("card_id", "status", "mana_value")


@query("c16c_nested_patches", "SELECT card_id, CASE WHEN card_id % 19 = 2 THEN 'patched' ELSE status END AS status, CASE WHEN card_id % 38 = 2 THEN 9 ELSE mana_value END AS mana_value, kind FROM cards")
def nested_patches(t: Tables) -> DataFrame:
    """A patch of one field of a struct leaves the others."""
    info = lambda status, value, kind: F.struct(status.cast("string").alias("status"), value.cast("int").alias("mana_value"), kind.cast("string").alias("kind")).alias("info")
    cards = t.cards.select("card_id", info(F.col("status"), F.col("mana_value"), F.col("kind")))
    p = t.cards.filter("card_id % 19 = 2").select("card_id", info(F.lit("patched"), F.when(F.col("card_id") % 38 == 2, 9), F.lit(None)))
    return C.apply_patches(cards, p, ["card_id"], ["info"])[0].select("card_id", "info.*")


@query("c16b_patches_skipped", "SELECT card_id + 1 AS card_id FROM cards WHERE card_id % 19 = 2 AND card_id + 1 NOT IN (SELECT card_id FROM cards WHERE card_id % 2 = 1)")
def skipped(t: Tables) -> DataFrame:
    p = t.cards.filter("card_id % 19 = 2").select((F.col("card_id") + 1).alias("card_id"), F.lit("patched").alias("status"))
    return C.apply_patches(t.cards.filter("card_id % 2 = 1"), p, ["card_id"], ["status"])[1].select("card_id")


@query("c17_fill_ids", """
WITH u AS (SELECT arena_id AS id, name, 0 AS pr FROM cards UNION ALL SELECT card_id + 90000, concat('n ', name), 1 FROM cards WHERE card_id % 2 = 0 UNION ALL SELECT card_id + 90000, concat('b ', name), 2 FROM cards WHERE card_id % 4 = 0 OR card_id % 5 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pr, name) AS rk FROM u WHERE id IS NOT NULL)
SELECT id, name, CASE pr WHEN 0 THEN 'primary' WHEN 1 THEN 'number' ELSE 'name' END AS source FROM r WHERE rk = 1""")
def fill_ids(t: Tables) -> DataFrame:
    c = t.cards
    own = lambda cond, p: c.filter(cond).select((F.col("card_id") + 90000).alias("id"), F.concat(F.lit(p), "name").alias("name"))
    return C.fill_ids(c.select(F.col("arena_id").alias("id"), "name"), own("card_id % 2 = 0", "n "), own("card_id % 4 = 0 OR card_id % 5 = 0", "b "))


@query("d40_status_histogram", "SELECT s.status, count(c.card_id) AS n FROM (VALUES ('reviewed'), ('needs_human'), ('parsed'), ('needs_text')) s(status) LEFT JOIN cards c ON c.status = s.status GROUP BY s.status")
def status_histogram(t: Tables) -> DataFrame:
    return C.status_counts(t.cards, ["reviewed", "needs_human", "parsed", "needs_text"])


@query("d42_name_coverage", f"SELECT coalesce(set_code, 'ALL') AS set_code, count(*) AS n, count(r.name) AS matched, round(count(r.name) / count(*)::DOUBLE, 6) AS share FROM cards c LEFT JOIN {RATED} r ON r.name = split_part(c.name, ' // ', 1) GROUP BY ROLLUP (set_code)")
def name_coverage(t: Tables) -> DataFrame:
    joined = C.join_by_name(t.cards, t.ratings.groupBy("name").agg(F.sum("pick_count").alias("picks")))
    return C.name_coverage(joined, "set_code", F.col("matched_by").isNotNull()).withColumn("share", F.round("share", 6))


@query("d43_primary_set", """
WITH c AS (SELECT game_id, CASE WHEN set_code <> 'Brand#1' THEN set_code END AS set_code, sum(n) AS n FROM deck_cards JOIN cards USING (card_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY set_code IS NULL, n DESC, set_code) AS rk FROM c)
SELECT game_id, set_code FROM r WHERE rk = 1""")
def primary_set(t: Tables) -> DataFrame:
    return C.primary_set(t.deck_cards, t.cards, ["Brand#1"])


@query("d44_stats_coverage", f"""
SELECT game_id, CAST(sum(CASE WHEN r.name IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS matched, CAST(sum(n) AS BIGINT) AS total
FROM deck_cards JOIN cards c USING (card_id) LEFT JOIN (SELECT * FROM {RATED} WHERE picks > 25) r ON r.name = split_part(c.name, ' // ', 1) WHERE NOT is_land GROUP BY game_id""")
def stats_coverage(t: Tables) -> DataFrame:
    rated = t.ratings.groupBy("name").agg(F.sum("pick_count").alias("picks")).filter("picks > 25")
    cards = C.join_by_name(t.cards.filter("NOT is_land"), rated).select("card_id", F.col("matched_by").isNotNull().alias("has"))
    return t.deck_cards.join(cards, "card_id").groupBy("game_id").agg(F.sum(F.when(F.col("has"), F.col("n")).otherwise(0)).alias("matched"), F.sum("n").alias("total"))


AFFECTED = """
bad AS (SELECT DISTINCT game_id FROM deck_cards JOIN cards USING (card_id) WHERE split_part(name, ' // ', 1) IN (SELECT split_part(name, ' // ', 1) FROM cards WHERE card_id % 97 = 5))
"""


def affected_games(t: Tables) -> DataFrame:
    return C.games_with(t.deck_cards, t.cards, t.cards.filter("card_id % 97 = 5"))


def invalidated(t: Tables) -> tuple[str, DataFrame]:
    from ..sources import materialise as W

    path = W.scratch(t.spark, "shards")
    W.write_stamped(t.decisions.select("game_id", "expansion", "event_type"), path, W.Stamp("s1", "f1", 200), buckets=W.Buckets(("game_id",), 8))
    return path, W.invalidate(t.spark, path, affected_games(t), ["game_id"])


@query("c9_invalidation", f"WITH {AFFECTED} SELECT d.game_id FROM decisions d WHERE d.game_id NOT IN (SELECT game_id FROM bad)")
def invalidation(t: Tables) -> DataFrame:
    """What a stored dataset holds after the games with an affected card were deleted."""
    from ..sources.materialise import open_dataset

    return open_dataset(t.spark, invalidated(t)[0]).select("game_id")


@query("c9b_invalidation_report", f"WITH {AFFECTED} SELECT expansion, event_type, count(*) FILTER (WHERE b.game_id IS NOT NULL) AS deleted, count(*) FILTER (WHERE b.game_id IS NULL) AS kept FROM decisions d LEFT JOIN bad b USING (game_id) GROUP BY 1, 2 HAVING count(b.game_id) > 0")
def invalidation_report(t: Tables) -> DataFrame:
    return invalidated(t)[1]


@query("c7_c8_reuse_and_resume", """
WITH cache AS (SELECT game_id, mulligan_number, round(p_base, 6) AS feature FROM decisions WHERE game_id % 3 = 0), done AS (SELECT game_id FROM decisions WHERE game_id % 5 = 0)
SELECT d.game_id, CASE WHEN d.was_kept AND c.game_id IS NOT NULL THEN 'reused' ELSE 'computed' END AS path, CASE WHEN d.was_kept THEN c.feature END AS feature
FROM decisions d LEFT JOIN cache c USING (game_id, mulligan_number) WHERE d.game_id NOT IN (SELECT game_id FROM done)""")
def reuse(t: Tables) -> DataFrame:
    from ..sources.materialise import resume, reuse_or_compute

    cached = t.decisions.filter("game_id % 3 = 0").select("game_id", "mulligan_number", F.round("p_base", 6).alias("feature"))
    rows = resume(t.decisions.select("game_id", "mulligan_number", "was_kept"), t.decisions.filter("game_id % 5 = 0"), ["game_id"])
    hits, misses = reuse_or_compute(rows, cached, ["game_id", "mulligan_number"], F.col("was_kept"))
    return hits.withColumn("path", F.lit("reused")).unionByName(misses.withColumn("path", F.lit("computed")), allowMissingColumns=True).select("game_id", "path", "feature")


@query("c7b_c8b_stored_reuse", """
SELECT game_id, mulligan_number, CASE WHEN game_id % 5 = 0 THEN 'stored' WHEN was_kept AND game_id % 3 = 0 THEN 'reused' ELSE 'computed' END AS path, CASE WHEN game_id % 5 = 0 OR (was_kept AND game_id % 3 = 0) THEN round(p_base, 6) END AS feature FROM decisions""")
def stored_reuse(t: Tables) -> DataFrame:
    """A stored dataset, bucketed by game, resumed with all decisions: features reused from a second bucketed one where it has them."""
    from ..sources import materialise as W

    stamp, buckets, key = W.Stamp("s1", "f1", 200), W.Buckets(("game_id", "mulligan_number"), 8), ["game_id", "mulligan_number"]
    out, cache = W.scratch(t.spark, "features"), W.scratch(t.spark, "cache")
    rows = t.decisions.select(*key, *W.PARTITION, "was_kept")
    feature = t.decisions.select(*key, *W.PARTITION, F.round("p_base", 6).alias("feature"))
    W.write_stamped(feature.filter("game_id % 5 = 0").withColumn("path", F.lit("stored")), out, stamp, buckets=buckets)
    W.write_stamped(feature.filter("game_id % 3 = 0"), cache, stamp, buckets=buckets)
    hits, misses = W.reuse_or_compute(W.resume(rows, W.open_dataset(t.spark, out), key), W.open_dataset(t.spark, cache).select(*key, "feature"), key, F.col("was_kept"))
    found = hits.withColumn("path", F.lit("reused")).unionByName(misses.withColumn("path", F.lit("computed")), allowMissingColumns=True)
    W.write_stamped(found.select(*key, *W.PARTITION, "feature", "path"), out, stamp, "resume", key)
    return W.open_dataset(t.spark, out).select(*key, "path", "feature")


@query("d41_dropped_text_census", r"""
WITH p AS (SELECT source AS site, doc_id, unnest(string_split(coalesce(text, ''), '.')) AS piece FROM documents),
r AS (SELECT site, regexp_replace(trim(regexp_replace(piece, '\s+', ' ', 'g')), '^ +| +$', '', 'g') AS c, doc_id FROM p),
k AS (SELECT site, CASE WHEN length(c) > 100 THEN substr(c, 1, 99) || '…' ELSE c END AS chunk, CAST(doc_id AS STRING) AS name FROM r),
o AS (SELECT site, chunk, name, count(*) AS n, row_number() OVER (PARTITION BY site, chunk ORDER BY name) AS rk FROM k GROUP BY 1, 2, 3)
SELECT site, chunk, CAST(sum(n) AS BIGINT) AS n, string_agg(name, '; ' ORDER BY name) FILTER (WHERE rk <= 3) AS examples FROM o GROUP BY 1, 2""")
def census(t: Tables) -> DataFrame:
    """All sentences of all texts."""
    rows = t.documents.select("source", F.explode(F.split(F.coalesce("text", F.lit("")), "\\.", -1)).alias("piece"), F.col("doc_id").cast("string").alias("name"))
    return C.dropped_text_census(rows, "source", "piece", "name")
