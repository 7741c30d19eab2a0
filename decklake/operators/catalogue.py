"""The card catalogue: predicates, joins by name, search, merges, comparison of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.cards import fold_name, front_face
from .ranks import clustered


#: Roles that a flat catalogue has as boolean columns, and the field of the nested role features that each comes from.
ROLES = ("destroy_or_exile", "burn", "bounce", "top_library", "removal_aura", "counterspell", "punch_fight", "trick", "pump_aura", "equipment", "vehicle", "saga", "class_card", "planeswalker", "draw", "makes_creatures")
#: Ways in which a mode puts a land onto the battlefield.
ONTO_BATTLEFIELD = ("battlefield_tapped", "battlefield_untapped")


def flat_roles(cards: DataFrame) -> DataFrame:
    """A nested catalogue with the flat columns that ``categories`` reads.

    Nested are types and supertypes (arrays), mana_cost (cmc, color_pips: a
    map), modes (arrays of effects with kind and destination), mana_abilities
    (an array) and role_features: flags, and numbers and lists that count as
    set if they aren't null, 0 or empty.
    """
    role = lambda name: F.coalesce(F.col(f"role_features.{name}"), F.lit(False))
    amount = lambda name: F.coalesce(F.col(f"role_features.{name}") > 0, F.lit(False))
    given = lambda name: F.col(f"role_features.{name}").isNotNull()
    some = lambda name: F.coalesce(F.size(f"role_features.{name}") > 0, F.lit(False))
    fetches = F.exists("modes", lambda m: F.exists(m.effects, lambda e: (e.kind == "fetch_land") & e.destination.isin(*ONTO_BATTLEFIELD)))
    pips = F.col("mana_cost.color_pips")
    flags = {
        "is_land": F.array_contains("types", "Land"), "is_basic": F.array_contains("supertypes", "Basic"), "is_creature": role("is_creature"),
        "destroy_or_exile": role("removal_destroy_or_exile"), "burn": given("removal_burn_damage"), **{r: role(f"is_{r}") for r in ("bounce", "top_library", "removal_aura", "counterspell", "punch_fight", "pump_aura", "equipment", "vehicle", "saga", "planeswalker")},
        "class_card": role("is_class"), "trick": given("combat_trick_power") | given("combat_trick_toughness") | some("combat_trick_granted_keywords"), "draw": amount("cards_drawn") | amount("cards_manipulated"),
        "makes_creatures": some("creates_creatures"), "alt_mode": F.coalesce(F.size("modes") > 1, F.lit(False)), "mana_ability": F.coalesce(F.size("mana_abilities") > 0, F.lit(False)), "fetches_land": F.coalesce(fetches, F.lit(False)), "is_other": role("is_other"),
    }
    colors = F.coalesce(F.array_sort(F.map_keys(pips)), F.array().cast("array<string>"))
    return cards.withColumns({**flags, "mana_value": F.col("mana_cost.cmc"), "colors": colors, "double_pip": F.coalesce(F.exists(F.map_values(pips), lambda n: n >= 2), F.lit(False))})


def categories(c=F.col) -> dict[str, Column]:
    """Boolean columns of a flat catalogue (see ``flat_roles``); a card's own ``is_other`` says that it is none of the others."""
    land = c("is_land")
    removal = c("destroy_or_exile") | c("burn") | c("bounce") | c("top_library") | c("removal_aura") | c("counterspell")
    return {
        "land": land, "spell": ~land, "nonbasic_land": land & ~c("is_basic"), "creature": c("is_creature"), "creature_or_tokens": c("is_creature") | c("makes_creatures"), "removal": removal,
        "trick": c("trick"), "pump": c("trick") | c("pump_aura"), "equipment_or_vehicle": c("equipment") | c("vehicle"), "card_manipulation": c("draw"), "alt_mode": c("alt_mode"),
        "mana_ability": c("mana_ability"), "fetches_land": c("fetches_land"), "ramp": c("mana_ability") | c("fetches_land"), "other": c("is_other"),
    }


# Buckets of the mana value, both ends included.
MANA_BUCKETS = {"mv_le2": (0, 2), "mv_3": (3, 3), "mv_4_5": (4, 5), "mv_ge6": (6, 99), "mv_0_2": (0, 2), "mv_ge3": (3, 99), "mv_ge4": (4, 99)}


def mana_buckets(value: Column) -> dict[str, Column]:
    """Membership in each bucket; a card without a cost counts as 0."""
    v = F.coalesce(value, F.lit(0))
    return {name: v.between(low, high) for name, (low, high) in MANA_BUCKETS.items()}


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the order given."""
    return df.withColumn("own_first", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("own_first = 1").drop("own_first")


def join_by_name(cards: DataFrame, stats: DataFrame, name: str = "name", values: list[str] | None = None) -> DataFrame:
    """Left join by folded name, then by the folded front face; ``matched_by`` is full, front or null."""
    values = values or [c for c in stats.columns if c != name]
    keyed = first_by(stats.withColumn("own_key", fold_name(F.col(name))), ["own_key"], [F.col(name)])
    side = lambda p: keyed.select(F.col("own_key").alias(f"{p}_key"), F.struct(*values).alias(p))
    rows = cards.withColumns({"full_key": fold_name(F.col(name)), "front_key": fold_name(front_face(F.col(name)))})
    rows = rows.join(side("full"), "full_key", "left").join(side("front"), "front_key", "left")
    found = F.coalesce("full", "front")
    return rows.withColumn("matched_by", F.when(F.col("full").isNotNull(), "full").when(F.col("front").isNotNull(), "front")).select(*cards.columns, "matched_by", *[found[v].alias(v) for v in values])


def three_tier_match(cards: DataFrame, ratings: DataFrame, value: str) -> DataFrame:
    """Rating by id, else by name, else by front face; on the right the first row of each key counts."""
    order = [F.col("name"), F.col(value)]
    by_id = first_by(ratings.filter("arena_id IS NOT NULL"), ["arena_id"], order).select("arena_id", F.col(value).alias("by_id"))
    by_name = first_by(ratings, ["name"], order).select(F.col("name").alias("own_name"), F.col(value).alias("by_name"))
    by_front = by_name.select(F.col("own_name").alias("own_front"), F.col("by_name").alias("by_front"))
    rows = cards.join(by_id, "arena_id", "left").join(by_name, F.col("name") == F.col("own_name"), "left").join(by_front, front_face(F.col("name")) == F.col("own_front"), "left")
    tier = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").when(F.col("by_front").isNotNull(), "front")
    return rows.select(*cards.columns, tier.alias("tier"), F.coalesce("by_id", "by_name", "by_front").alias(value))


# Fixed values of the game: the five basic lands.
BASICS = ("Plains", "Island", "Swamp", "Mountain", "Forest")


def name_lookup(cards: DataFrame, key: str = "card_id") -> DataFrame:
    """(lookup, card_id, source): full names, then front faces that no card has as its name, then basics that are missing (id null)."""
    full = cards.select(F.col("name").alias("lookup"), key, F.lit(0).alias("priority"))
    front = cards.filter(F.col("name").contains(" // ")).select(front_face(F.col("name")).alias("lookup"), key, F.lit(1).alias("priority"))
    basics = cards.sparkSession.createDataFrame([(b, None, 2) for b in BASICS], f"lookup string, {key} long, priority int")
    rows = first_by(full.unionByName(front).unionByName(basics), ["lookup"], [F.col("priority"), F.col(key)])
    return rows.select("lookup", key, F.element_at(F.array(F.lit("name"), F.lit("front"), F.lit("basic")), F.col("priority") + 1).alias("source"))


def resolve_ids(rows: DataFrame, ids: str, names: DataFrame, key: list[str], most_unknown: float = 1.0) -> DataFrame:
    """``key``, ``hand`` (names in order, ``?<id>`` for unknown ids), ``unknown``; fails above ``most_unknown`` of all ids.

    ``names``: (id, name), the last by name of each id.
    """
    one = names.groupBy("id").agg(F.max("name").alias("name"))
    placed = rows.select(*key, F.posexplode(ids).alias("pos", "id")).join(one, "id", "left")
    out = placed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.concat(F.lit("?"), F.col("id").cast("string"))).alias("name")))).alias("x"), F.count_if(F.col("name").isNull()).alias("unknown"), F.count("*").alias("own_n"))
    if most_unknown < 1.0:
        share = out.agg(F.sum("unknown") / F.sum("own_n")).first()[0] or 0.0
        if share > most_unknown:
            raise ValueError(f"{share:.1%} of the ids are unknown; {most_unknown:.1%} are allowed")
    return out.select(*key, F.col("x.name").alias("hand"), "unknown")


def search(cards: DataFrame, flags: dict[str, Column], *, contains: str = "", status: str | None = None, sets: list[str] = (), colors: list[str] = (), kind: str | None = None, having: list[str] = (), limit: int = 200) -> DataFrame:
    """Catalogue search: all conditions hold; unknown flags are ignored; ``total`` counts before the limit.

    Colour ``C`` asks for cards without one.
    """
    cond = F.lit(True)
    if contains:
        cond &= F.lower("name").contains(contains.lower())
    if status:
        cond &= F.col("status") == status
    if sets:
        cond &= F.col("set_code").isin(*sets)
    for color in colors:
        cond &= F.col("color").isNull() if color == "C" else F.coalesce(F.col("color") == color, F.lit(False))
    if kind:
        cond &= F.col("kind") == kind
    for flag in having:
        if flag in flags:
            cond &= flags[flag]
    rows = cards.filter(cond)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy("name", "card_id").limit(limit).crossJoin(F.broadcast(total))  # one row


def filter_raw(cards: DataFrame, layouts: list[str] | None = None, languages: list[str] | None = None, sets: list[str] | None = None, layout: str = "layout", language: str = "lang", set_code: str = "set_code") -> DataFrame:
    """Raw cards of the given layouts, languages and sets; what isn't given lets all through, null is in no list."""
    asked = {layout: layouts, language: languages, set_code: sets}
    cond = F.lit(True)
    for column, values in asked.items():
        if values is not None:
            cond &= F.col(column).isin(*values)
    return cards.filter(cond)


def encoding_offenders(cards: DataFrame, decks: DataFrame) -> DataFrame:
    """(game_id, offenders): decks with a card that isn't ready, and why."""
    why = F.when(F.col("status").startswith("needs_"), F.concat(F.lit("status "), F.col("status"))).when(~F.col("is_land") & F.col("mana_value").isNull(), "no modes")
    bad = cards.withColumn("why", why).filter("why IS NOT NULL").select("card_id", F.concat_ws(": ", "name", "why").alias("message"))
    return decks.join(bad, "card_id").groupBy("game_id").agg(F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("offenders"))


# The flag that a type or subtype stands for.
TYPE_FLAGS = {"is_creature": ("types", "Creature"), "planeswalker": ("types", "Planeswalker"), "is_land": ("types", "Land"), "equipment": ("subtypes", "Equipment"), "vehicle": ("subtypes", "Vehicle")}


def with_invariants(cards: DataFrame, roles: list[str], flags: dict[str, tuple[str, str]] = TYPE_FLAGS) -> DataFrame:
    """Flags that follow from ``types`` and ``subtypes`` are forced on; ``is_other`` holds where none of ``roles`` and of these flags does; costed cards without modes get one.

    A flag that is already on stays on whatever the type; null counts as off,
    and so does a null list.  The same again if run twice.
    """
    on = {f: F.coalesce(F.col(f), F.lit(False)) | F.coalesce(F.array_contains(column, value), F.lit(False)) for f, (column, value) in flags.items()}
    on |= {r: F.coalesce(F.col(r), F.lit(False)) for r in roles if r not in on}
    rows = cards.withColumns(on)
    other = ~F.array_contains(F.array(*[F.col(f) for f in on]), True)
    have = F.col("modes") if "modes" in cards.columns else F.array().cast("array<string>")
    have = F.coalesce(have, F.array().cast("array<string>"))
    return rows.withColumns({"is_other": other, "modes": F.when(~F.col("is_land") & (F.size(have) == 0), F.array(F.lit("cast"))).otherwise(have)})


def merge_catalogue(prior: DataFrame, fresh: DataFrame, key: str, reparse: bool = False, force: bool = False) -> DataFrame:
    """Fresh rows, but reviewed prior ones stay (with a newer id, if there is one); ``action`` is kept, replaced or added; orphans go.

    ``reparse`` replaces what needs a human, which stays otherwise; ``force`` replaces all.
    """
    old = prior.select(F.col(key), F.struct("*").alias("old"))
    stays = F.col("old.status") == "reviewed"
    if not reparse:
        stays |= F.col("old.status") == "needs_human"
    if force:
        stays = F.lit(False)
    rows = fresh.select(F.col(key), F.struct("*").alias("new")).join(old, key, "left")
    action = F.when(F.col("old").isNull(), "added").when(stays, "kept").otherwise("replaced")
    pick = lambda c: F.when(action == "kept", F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    others = [c for c in fresh.columns if c not in (key, "arena_id")]
    return rows.select(key, action.alias("action"), F.coalesce("new.arena_id", F.when(action == "kept", F.col("old.arena_id"))).alias("arena_id"), *[pick(c).alias(c) for c in others])


def _merged(old: Column, new: Column, kind) -> Column:
    """``new`` over ``old``: structs field by field, anything else whole, null changes nothing."""
    if not isinstance(kind, StructType):
        return F.coalesce(new, old)
    fields = [F.coalesce(new[f.name], old[f.name]).alias(f.name) for f in kind]
    return F.when(new.isNull(), old).otherwise(F.struct(*fields))


def apply_patches(cards: DataFrame, patches: DataFrame, key: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Patched cards (a patch's non-null fields replace the card's, one level deep in structs), and patches without a card."""
    p = patches.select(*key, *[F.col(f).alias(f"own_{f}") for f in fields])
    rows = cards.join(p, key, "left").withColumns({f: _merged(F.col(f), F.col(f"own_{f}"), cards.schema[f].dataType) for f in fields}).select(*cards.columns)
    return rows, patches.join(cards, key, "left_anti")


def fill_ids(primary: DataFrame, by_number: DataFrame, by_name: DataFrame) -> DataFrame:
    """(id, name, source): ids of the first table that has them win."""
    union = primary.withColumn("priority", F.lit(0)).unionByName(by_number.withColumn("priority", F.lit(1))).unionByName(by_name.withColumn("priority", F.lit(2)))
    rows = first_by(union.filter("id IS NOT NULL"), ["id"], [F.col("priority"), F.col("name")])
    return rows.select("id", "name", F.element_at(F.array(F.lit("primary"), F.lit("number"), F.lit("name")), F.col("priority") + 1).alias("source"))


def compare_versions(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): names whose fields differ, or that one version lacks."""
    side = lambda df, n: df.select(F.col(key), F.struct(*fields).alias(n))
    rows = side(old, "a").join(side(new, "b"), key, "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return rows.select(key, change.alias("change")).filter("change IS NOT NULL")


def bonus_sheet(ratings: DataFrame, cards: DataFrame, all_cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rated names that the set lacks (front faces too): found among all cards (first by set), and not found."""
    own = cards.select("name").union(cards.select(front_face(F.col("name")).alias("name"))).distinct()
    missing = ratings.select("name").distinct().join(own, "name", "left_anti")
    pool = first_by(all_cards.select("name", F.col("set_code").alias("from_set"), "card_id").unionByName(all_cards.select(front_face(F.col("name")).alias("name"), F.col("set_code").alias("from_set"), "card_id")), ["name"], [F.col("from_set"), F.col("card_id")])
    return missing.join(pool, "name"), missing.join(pool, "name", "left_anti")


def status_counts(cards: DataFrame, statuses: list[str]) -> DataFrame:
    """All statuses, 0 where there is none."""
    listed = cards.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return F.broadcast(listed).join(cards.groupBy("status").agg(F.count("*").alias("n")), "status", "left").fillna(0, ["n"])


def games_with(decks: DataFrame, cards: DataFrame, affected: DataFrame) -> DataFrame:
    """(game_id): games whose deck holds a card with the front face of an affected one."""
    fronts = affected.select(front_face(F.col("name")).alias("front")).distinct()
    named = decks.join(cards.select("card_id", front_face(F.col("name")).alias("front")), "card_id")
    return named.join(fronts, "front", "left_semi").select("game_id").distinct()


def primary_set(decks: DataFrame, cards: DataFrame, basic_sets: list[str]) -> DataFrame:
    """(game_id, set_code): the set of most copies outside ``basic_sets``, of ties the first by name; null if none."""
    counted = clustered(decks.join(cards.select("card_id", "set_code"), "card_id").drop("card_id"), "game_id").groupBy("game_id", "set_code").agg(F.sum("n").alias("n"))
    rows = counted.withColumn("set_code", F.when(~F.col("set_code").isin(*basic_sets), F.col("set_code")))
    return first_by(rows, ["game_id"], [F.col("set_code").isNull(), F.col("n").desc(), F.col("set_code")]).select("game_id", "set_code")


def name_coverage(joined: DataFrame, by: str, matched: Column) -> DataFrame:
    """Share of names that were matched, by set and overall."""
    rolled = joined.rollup(by).agg(F.grouping(by).alias("g"), F.count("*").alias("n"), F.count_if(matched).alias("matched"))
    return rolled.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(by)).alias(by), "n", "matched", F.try_divide("matched", "n").alias("share"))


def dropped_text_census(chunks: DataFrame, site: str, text: str, name: str) -> DataFrame:
    """(site, chunk, n, examples): how often a chunk was dropped, with its first three names.

    Names are cut to three in each partial state: nothing grows with a group.
    """
    from ..functions.cards import clipped

    rows = chunks.select(F.col(site).alias("site"), clipped(F.col(text)).alias("chunk"), F.col(name).alias("name"))
    one = rows.groupBy("site", "chunk", "name").agg(F.count("*").alias("n"))
    three = Window.partitionBy("site", "chunk").orderBy("name")
    placed = one.withColumn("rk", F.row_number().over(three))
    out = placed.groupBy("site", "chunk").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rk") <= 3, F.col("name")))), "; ").alias("examples"))
    return out.orderBy(F.desc("n"), "site", "chunk")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of the keys that both sides have exactly once."""
    once = lambda df: df.groupBy(key).count().filter("count = 1").select(key)
    return left.join(once(left), key).join(right.join(once(right), key), key)
