"""Card statistics, deck and hand features, trace roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .catalogue import categories, mana_buckets
from .ranks import clustered

FORMAT = ["expansion", "event_type"]


def format_priors(ratings: DataFrame, fields: list[str]) -> DataFrame:
    """Mean of each rate in each format; null where every rate is."""
    return ratings.groupBy(*FORMAT).agg(*[F.avg(f).alias(f"{f}_mean") for f in fields])


def rate_bins(ratings: DataFrame, field: str, bins: int = 10) -> DataFrame:
    """(format, bin, edge, mean, n): equal-count bins by play rate, then name; the first bins take the remainder."""
    known = ratings.filter(F.col(field).isNotNull() & F.col("play_rate").isNotNull())
    binned = known.withColumn("bin", F.ntile(bins).over(Window.partitionBy(*FORMAT).orderBy("play_rate", "name")))
    return binned.groupBy(*FORMAT, "bin").agg(F.min("play_rate").alias("edge"), F.avg(field).alias("mean"), F.count("*").alias("n"))


def prior_at(edges: Column, means: Column, rate: Column) -> Column:
    """The mean of the bin that a play rate falls in: a rate equal to an edge belongs to the upper bin, one below all to the first."""
    at = F.greatest(F.size(F.filter(edges, lambda e: e <= rate)) - 1, F.lit(0))
    return F.get(means, at)


def shrunk(ratings: DataFrame, fields: list[str], k: float = 50.0) -> DataFrame:
    """Rates pulled to the mean of cards that are played as much: w = picks / (picks + k).

    A card without a play rate gets its format's mean as prior, a card without
    a rate the prior itself.
    """
    if k < 0:
        raise ValueError("k is negative")
    rows = ratings.join(format_priors(ratings, fields), FORMAT, "left")
    for field in fields:
        bins = rate_bins(ratings, field).groupBy(*FORMAT).agg(F.array_sort(F.collect_list(F.struct("bin", "edge", "mean"))).alias("b")).select(*FORMAT, F.col("b.edge").alias(f"{field}_edges"), F.col("b.mean").alias(f"{field}_means"))
        rows = rows.join(bins, FORMAT, "left")
        prior = F.coalesce(F.when(F.col("play_rate").isNotNull(), prior_at(F.col(f"{field}_edges"), F.col(f"{field}_means"), F.col("play_rate"))), F.col(f"{field}_mean"))
        w = F.coalesce(F.try_divide(F.col("pick_count").cast("double"), F.col("pick_count") + F.lit(float(k))), F.lit(0.0))
        rows = rows.withColumn(f"shrunk_{field}", F.coalesce(w * F.col(field) + (1 - w) * prior, prior))
    return rows.select(*FORMAT, "name", *[f"shrunk_{f}" for f in fields])


def z_scores(rates: DataFrame, fields: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation in each format; null where the deviation is 0."""
    w = Window.partitionBy(*FORMAT)
    return rates.withColumns({f"z_{f}": F.try_divide(F.col(f) - F.avg(f).over(w), F.nullif(F.stddev_pop(f).over(w), F.lit(0.0))) for f in fields})


def library_of(decks: DataFrame, hands: DataFrame) -> DataFrame:
    """Deck minus hand as multisets: (game_id, card_id, n) of what is left."""
    drawn = hands.groupBy("game_id", "card_id").agg(F.count("*").cast("int").alias("drawn"))
    return decks.join(drawn, ["game_id", "card_id"], "left").withColumn("n", F.greatest(F.col("n") - F.coalesce("drawn", F.lit(0)), F.lit(0))).filter("n > 0").select("game_id", "card_id", "n")


def _flags(cards: DataFrame, wanted: dict[str, Column], values: list[str]) -> DataFrame:
    """``card_id``, ``values`` and the flags ``is_<name>``: worked out once for each card, before the long join."""
    return cards.select("card_id", *values, *[F.coalesce(c, F.lit(False)).alias(f"is_{n}") for n, c in wanted.items()])


COLORS = ("W", "U", "B", "R", "G")
CURVE = ("mv_le2", "mv_3", "mv_4_5", "mv_ge6")
RATES = ("oh", "gd", "gih")


def deck_features(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """Sixteen features of each deck, and its size: lands, roles and curve as shares, colours, mean rates of spells.

    ``decks``: game_id, card_id, n.  ``cards``: a flat catalogue with its
    colours and the rates ``RATES``; a rate that is null doesn't count.
    Shares but that of lands are of spells.  A main colour is required by more
    than three copies.
    """
    cat, buckets = categories(), mana_buckets(F.col("mana_value"))
    spell, creature = cat["spell"], cat["creature"] & cat["spell"]
    wanted = {"land": cat["land"], "spell": spell, "creature": creature, "removal": cat["removal"] & spell, **{f"{b}_spell": buckets[b] & spell for b in CURVE}, **{f"{b}_creature": buckets[b] & creature for b in CURVE}, **{f"color_{c}": F.array_contains("colors", c) & spell for c in COLORS}}
    rows = clustered(decks.join(_flags(cards, wanted, list(RATES)), "card_id").drop("card_id"), "game_id")
    n, flag = F.col("n"), lambda name: F.col(f"is_{name}")
    count = lambda name: F.coalesce(F.sum(F.when(flag(name), n)), F.lit(0))
    share = lambda name: F.coalesce(F.try_divide(count(name).cast("double"), count("spell")), F.lit(0.0))
    colors = lambda more: sum((F.when(count(f"color_{c}") > more, 1).otherwise(0) for c in COLORS), F.lit(0))
    mean = lambda r: F.coalesce(F.try_divide(F.sum(F.when(flag("spell"), F.col(r) * n)), F.sum(F.when(flag("spell") & F.col(r).isNotNull(), n))), F.lit(0.0))
    return rows.groupBy("game_id").agg(
        F.sum("n").alias("cards"), F.coalesce(F.try_divide(count("land").cast("double"), F.sum("n")), F.lit(0.0)).alias("pct_lands"), share("creature").alias("pct_creatures"), share("removal").alias("pct_removal"),
        *[share(f"{b}_spell").alias(f"pct_{b}") for b in CURVE], *[share(f"{b}_creature").alias(f"pct_creatures_{b}") for b in CURVE], colors(3).alias("main_colors"), colors(0).alias("colors"), *[mean(r).alias(f"mean_{r}") for r in RATES],
    )


#: Roles and buckets of the hand's grid.
GRID_ROLES = ("destroy_or_exile", "burn", "bounce", "top_library", "removal_aura", "punch_fight", "trick", "pump_aura", "equipment", "vehicle", "saga", "class_card", "planeswalker", "card_manipulation")
GRID = ("mv_0_2", "mv_3", "mv_4_5")
# Bands of z-scores, lower ends included but for the top one.
Z_BANDS = {"bomb": (1.3, None), "good": (0.4, 1.3), "average": (-0.7, 0.4), "poor": (None, -0.7)}


def z_band(z: Column, name: str) -> Column:
    low, high = Z_BANDS[name]
    cond = F.lit(True)
    if low is not None:
        cond &= (z > low) if high is None else (z >= low)
    if high is not None:
        cond &= (z <= high) if name == "good" else (z < high)
    return cond


def hand_features(hands: DataFrame, cards: DataFrame) -> DataFrame:
    """Seventy-one features of each hand: counts, a role by mana-value grid, z bands, rates and colours; the mulligan number is the caller's.

    ``hands``: game_id and card_id, a row a copy.  ``cards``: a flat catalogue
    with colours, double_pip, rates, weight, z_oh and z_gd.  One aggregate
    over the long hand; means, maxima and sums of nothing are 0, and null
    rates and z-scores don't count.
    """
    cat, buckets, value = categories(), mana_buckets(F.col("mana_value")), F.coalesce("mana_value", F.lit(0))
    spell = cat["spell"]
    creature = cat["creature"] & spell
    role = {r: cat.get(r, F.col(r)) & spell for r in GRID_ROLES}
    wanted = {
        "land": cat["land"], "nonbasic_land": cat["nonbasic_land"], "spell": spell, "ramp": cat["ramp"] & spell, "multi_modal": cat["alt_mode"] & spell, "heavy_one_mode": buckets["mv_ge6"] & spell & ~cat["alt_mode"], "heavy_alt_mode": buckets["mv_ge6"] & spell & cat["alt_mode"],
        "creature_mv_le2": creature & buckets["mv_le2"], "creature_mv_3": creature & buckets["mv_3"], "creature_mv_4": creature & (value == 4), "creature_mv_5": creature & (value == 5), "creature_mv_ge6": creature & buckets["mv_ge6"],
        **{f"{r}_{b}": role[r] & buckets[b] for r in GRID_ROLES for b in GRID}, **{f"{z}_{b}": z_band(F.col(z), b) & spell for z in ("z_oh", "z_gd") for b in Z_BANDS}, "double_pip": F.col("double_pip") & spell,
    }
    names = {"land": "lands", "nonbasic_land": "nonbasic_lands", "spell": "spells", "ramp": "ramp_spells"}
    wanted |= {f"color_{c}": F.array_contains("colors", c) & spell for c in COLORS}
    packed, count = _packed(list(wanted))
    values = {"gih": "gih", "oh": "oh", "gd": "gd", "early": "oh - gd", "weight": "weight"}
    per_card = _flags(cards, wanted, [*RATES, "weight"]).selectExpr("card_id", *packed, *[f"CASE WHEN is_spell THEN {c} END AS own_{v}" for v, c in values.items()])
    sums = [f"sum(own_packed{i}) AS own_packed{i}" for i in range(len(packed))]
    rates = [("avg", "gih", "avg_gih"), ("max", "oh", "max_oh"), ("max", "gd", "max_gd"), ("sum", "gih", "sum_gih"), ("avg", "early", "avg_earliness"), ("max", "gih", "max_gih"), ("avg", "weight", "avg_weight")]
    folded = clustered(hands.select("game_id", "card_id").join(per_card, "card_id").drop("card_id"), "game_id").groupBy("game_id").agg(F.expr("count(*) AS own_n"), *[F.expr(f"{x}") for x in sums], *[F.expr(f"coalesce({f}(own_{v}), 0D) AS {name}") for f, v, name in rates])
    checked = f"CASE WHEN own_n <= {MOST_COPIES} THEN game_id ELSE raise_error(concat('too many cards: game ', CAST(game_id AS STRING))) END AS game_id"
    colors = " + ".join(f"CASE WHEN {count[f'color_{c}']} > 0 THEN 1 ELSE 0 END" for c in COLORS)
    return folded.selectExpr(checked, *[f"{count[w]} AS {names.get(w, w)}" for w in wanted if not w.startswith("color_")], *[name for _, _, name in rates], f"{colors} AS distinct_colors")


#: Bits of a counter, counters of a long, and what a counter can hold.
COUNTER_BITS, COUNTERS, MOST_COPIES = 12, 5, (1 << 12) - 1


def _packed(names: list[str]) -> tuple[list[str], dict[str, str]]:
    """Flags ``is_<name>`` as counters in a few longs of a card, and each counter out of their sums: five counts are one addition."""
    columns, count = [], {}
    for i in range(0, len(names), COUNTERS):
        own, part = f"own_packed{i // COUNTERS}", list(enumerate(names[i : i + COUNTERS]))
        columns.append(" + ".join(f"CASE WHEN is_{n} THEN {1 << COUNTER_BITS * k}L ELSE 0L END" for k, n in part) + f" AS {own}")
        count |= {n: f"(shiftright({own}, {COUNTER_BITS * k}) & {MOST_COPIES}L)" for k, n in part}
    return columns, count


def context_features(df: DataFrame, on_play: str, event: str, expansion: str, events: list[str], sets: list[str]) -> DataFrame:
    """One-hot columns; a value outside the vocabulary is all zeros."""
    hot = lambda c, v: F.when(F.col(c) == v, 1.0).otherwise(0.0)
    return df.withColumns({"on_the_play": F.col(on_play).cast("double"), **{f"event_{e}": hot(event, e) for e in events}, **{f"set_{s}": hot(expansion, s) for s in sets}})


#: z-score of the opening-hand rate above which a card counts as strong.
STRONG = 0.5


def castable_sets(turn: int, cat: dict[str, Column], buckets: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
    """The sets of spells whose odds a turn has: broad ones, also for strong cards alone, and narrow ones, from turn 2 on."""
    creature, spell = cat["creature_or_tokens"], F.lit(True)
    cuts = {1: {"": None}, 2: {"": None}, 3: {"_mv_0_2": "mv_0_2", "_mv_3p": "mv_ge3"}, 4: {"_mv_0_2": "mv_0_2", "_mv_3": "mv_3", "_mv_4p": "mv_ge4"}}[turn]
    broad = {f"{n}{suffix}": c if b is None else c & buckets[b] for n, c in (("spell", spell), ("creature", creature)) for suffix, b in cuts.items()} | {"removal": cat["removal"]}
    narrow = {n: cat[n] for n in ("pump", "equipment_or_vehicle", "card_manipulation", "other", "alt_mode")} if turn > 1 else {}
    return broad, narrow


def castability_features(decks: DataFrame, cards: DataFrame, key: str = "name", mean: str | None = None, more: DataFrame | None = None) -> DataFrame:
    """Ninety-six features of each deck: by turn and set of spells, the odds that any can be cast, and the mean number that can.

    ``decks``: game_id and card_id.  ``cards``: a flat catalogue with z_oh and
    the odds ``c1`` to ``c4`` of a game in which some copy could be cast by
    that turn; null odds are 0.  Copies of a name count once, with the odds of
    its least card_id; names are taken as independent: 1 - the product of
    1 - p, 0 for an empty set.  ``mean``: also the mean ``c4`` of spells by
    copies (``decks`` with n), under that name.  ``more``: doubles of a game
    (game_id once) that go on with its features.

    A deck's card brings its four odds and a whole number of flags; only such
    short rows are shuffled.  Products and sums are worked out over rows in
    order of games, a batch at a time, and wide rows are never moved or held.
    """
    cat, buckets = categories(), mana_buckets(F.col("mana_value"))
    flags = {"strong": F.col("z_oh") > STRONG}
    sets: list[tuple[str, int, list[str]]] = []
    for turn in (1, 2, 3, 4):
        broad, narrow = castable_sets(turn, cat, buckets)
        flags |= broad | narrow
        sets += [("_".join(need) + f"_t{turn}", turn, need) for need in [[n, *s] for n in broad for s in ((), ("strong",))] + [[n] for n in narrow]]
    bit = {name: 1 << k for k, name in enumerate(flags)}
    packed = sum((F.when(c, F.lit(bit[n])).otherwise(F.lit(0)) for n, c in flags.items()), F.lit(0))
    spells = cards.filter(cat["spell"])
    odds = spells.select(F.col("card_id").alias("own_first"), *[F.coalesce(f"c{t}", F.lit(0.0)).alias(f"own_c{t}") for t in (1, 2, 3, 4)], packed.alias("own_flags"))
    first = spells.groupBy(key).agg(F.min("card_id").alias("own_first"))
    names = cards.select("card_id", F.when(cat["spell"], F.col(key)).alias(key), F.when(~F.col("is_land"), F.coalesce("c4", F.lit(0.0))).alias("own_p")).join(first, key, "left").drop(key).join(odds, "own_first", "left")
    rows = decks.select("game_id", "card_id", (F.col("n") if mean else F.lit(1)).cast("double").alias("own_n")).join(names, "card_id", "left").drop("card_id").repartition("game_id")
    extra = [c for c in more.columns if c != "game_id"] if more is not None else []
    if extra:
        rows = rows.join(more, "game_id", "left")
    wanted = [c for name, turn, _ in sets for c in ((f"any_{name}", f"count_{name}") if turn > 1 else (f"any_{name}",))] + ([mean] if mean else []) + extra
    schema = T.StructType([decks.schema["game_id"], *[T.StructField(c, T.DoubleType()) for c in wanted]])
    masks = [(turn, sum(bit[n] for n in need)) for _, turn, need in sets]
    return rows.sortWithinPartitions("game_id", "own_first").mapInArrow(_by_game(lambda table, starts: _castable(table, starts, masks, bool(mean), extra), schema.names), schema)


def _by_game(work, names: list[str]):
    """``work(table, starts)`` over whole games of rows in order of game_id: ``starts`` are their first rows; of a batch, the last game waits for the next."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            starts = begins(table)
            if len(starts) > 1:
                yield from done(table.slice(0, starts[-1]), starts[:-1])
            rest = table.slice(starts[-1])
        if rest is not None:
            yield from done(rest, np.zeros(1, dtype=np.int64))

    def begins(table):
        ids = table["game_id"].combine_chunks()
        here, before = ids.slice(1), ids.slice(0, len(ids) - 1)
        same = pc.or_(pc.fill_null(pc.equal(here, before), False), pc.and_(pc.is_null(here), pc.is_null(before)))
        return np.concatenate([[0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1])

    def done(table, starts):
        columns = [table["game_id"].take(pa.array(starts)), *work(table, starts)]
        yield from pa.Table.from_arrays(columns, names=names).to_batches()

    return run


def _castable(table, starts, masks: list[tuple[int, int]], mean: bool, extra: list[str]) -> list:
    """The columns of ``castability_features`` for the games of ``table``."""
    import numpy as np
    import pyarrow as pa

    def of(name: str, missing):
        return table[name].combine_chunks().fill_null(missing).to_numpy(zero_copy_only=False)

    first, spell = of("own_first", 0), table["own_first"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    # In order of names within a game, nulls before them: a name counts at its first row.
    again = np.zeros(len(first), dtype=bool)
    again[1:] = (first[1:] == first[:-1]) & spell[:-1]
    again[starts] = False
    flags = np.where(spell & ~again, of("own_flags", 0), 0)
    p, out = {t: of(f"own_c{t}", 0.0) for t in (1, 2, 3, 4)}, []
    for turn, mask in masks:
        own = np.where((flags & mask) == mask, p[turn], 0.0)
        out.append(pa.array(1 - np.multiply.reduceat(1 - own, starts)))
        if turn > 1:
            out.append(pa.array(np.add.reduceat(own, starts)))
    if mean:
        known, n = table["own_p"].combine_chunks().is_valid().to_numpy(zero_copy_only=False), of("own_n", 0.0)
        copies = np.add.reduceat(np.where(known, n, 0.0), starts)
        out.append(pa.array(np.add.reduceat(np.where(known, of("own_p", 0.0) * n, 0.0), starts) / np.where(copies == 0, 1.0, copies)))
    return out + [table[c].take(pa.array(starts)) for c in extra]


def castable_by_turn_four(rows: DataFrame, cards: DataFrame, n: Column, name: str) -> DataFrame:
    """Mean odds ``c4`` over the spells of each game's cards, ``n`` copies a row; null odds are 0."""
    spells = cards.select("card_id", F.when(~F.col("is_land"), F.coalesce("c4", F.lit(0.0))).alias("p"))
    return rows.join(spells, "card_id").groupBy("game_id").agg(F.coalesce(F.try_divide(F.sum(F.col("p") * n), F.sum(F.when(F.col("p").isNotNull(), n))), F.lit(0.0)).alias(name))


def simulation_features(decks: DataFrame, hands: DataFrame, cards: DataFrame, games: DataFrame) -> DataFrame:
    """The ninety-six odds, the two means by turn 4, and the seven of lands and mana (``games``: game_id beside ``game_rollup``'s columns)."""
    more = castable_by_turn_four(hands, cards, F.lit(1), "hand_castable_t4").join(games, "game_id", "full")
    return castability_features(decks, cards, mean="deck_castable_t4", more=more)


def hand_explanation(hands: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a verdict on a hand rests on: a row for each card, and one for each hand.

    Cards: land or not, mana value, odds by turn, opening-hand rate.  Hands:
    by turn, the odds of casting a creature, another spell, and any spell, put
    together from both by 1 - the product of 1 - p.
    """
    rows = hands.join(cards, "card_id")
    shown = rows.select("game_id", "card_id", "name", "is_land", F.coalesce("mana_value", F.lit(0)).alias("mana_value"), *[F.coalesce(f"c{t}", F.lit(0.0)).alias(f"castable_t{t}") for t in (1, 2, 3, 4)], "oh")
    creature, spell = F.col("is_creature") | F.col("makes_creatures"), ~F.col("is_land")
    miss = lambda cond, t: F.coalesce(F.product(F.when(cond, 1 - F.coalesce(f"c{t}", F.lit(0.0)))), F.lit(1.0))
    odds = rows.dropDuplicates(["game_id", "name"]).groupBy("game_id").agg(*[m.alias(n) for t in (1, 2, 3, 4) for n, m in ((f"a{t}", miss(spell & creature, t)), (f"b{t}", miss(spell & ~creature, t)))])
    lands = rows.groupBy("game_id").agg(F.count_if("is_land").alias("lands"))
    return shown, lands.join(odds, "game_id").select("game_id", "lands", *[c for t in (1, 2, 3, 4) for c in ((1 - F.col(f"a{t}")).alias(f"creature_t{t}"), (1 - F.col(f"b{t}")).alias(f"other_t{t}"), (1 - F.col(f"a{t}") * F.col(f"b{t}")).alias(f"spell_t{t}"))])


def trace_rollup(instances: DataFrame, by: list[str], turns=(1, 2, 3, 4)) -> DataFrame:
    """Of each card: P(in hand by T), P(castable by T | in hand by T), first castable turn's distribution."""
    hand, cast = F.col("first_in_hand"), F.col("first_castable")
    out = [F.count("*").alias("instances")]
    for t in turns:
        seen = F.count_if(hand <= t)
        out += [(seen / F.count("*")).alias(f"in_hand_t{t}"), F.coalesce(F.try_divide(F.count_if((hand <= t) & (cast <= t)), seen), F.lit(0.0)).alias(f"castable_t{t}")]
    out += [(F.count_if(cast == t) / F.count("*")).alias(f"first_t{t}") for t in turns] + [(F.count_if(cast > max(turns)) / F.count("*")).alias("first_later")]
    return instances.groupBy(*by).agg(*out)


def snapshot_marginal(castability: DataFrame, turns=(1, 2, 3, 4)) -> DataFrame:
    """Share of games in which a card could be cast by each turn: once castable, always counted."""
    first = castability.groupBy("run", "name").agg(F.min("first_castable").alias("turn"))
    games = castability.agg(F.count_distinct("run").alias("games"))
    return first.crossJoin(F.broadcast(games)).groupBy("name").agg(*[(F.count_if(F.col("turn") <= t) / F.max("games")).alias(f"by_t{t}") for t in turns])


def game_rollup(turns: DataFrame, by: list[str] = ()) -> DataFrame:
    """P(at least N lands after turn N), and mean mana of turns 2 to 4, overall or by ``by``; turns that a game lacks don't count."""
    at = lambda n, c: F.avg(F.when(F.col("turn") == n, c))
    return turns.groupBy(*by).agg(*[at(n, (F.col("lands") >= n).cast("double")).alias(f"lands_t{n}") for n in (2, 3, 4, 5)], *[at(n, F.col("mana").cast("double")).alias(f"mana_t{n}") for n in (2, 3, 4)])


def smoothed_hands(decks: DataFrame, cards: DataFrame, candidates: int = 3, hand: int = 7, seed: int = 0, strength: float = 0.015) -> DataFrame:
    """For each deck, ``candidates`` hands by seeded hashes, one picked by weight exp(-(land share difference)² / strength).

    Draws depend on the game, candidate and copy alone, so that any
    partitioning gives the same hands.  Decks are shuffled once, as a row a
    card; copies are counted out, hashed and, but for those that a hand may
    take, dropped in one step over the shuffled rows, so that no copy is shuffled.
    A short row of a deck is long work, so its shuffle has all partitions that
    the session sets, not as few as its bytes would fill.

    A draw orders copies by a number of 53 bits, then by card and copy.  Of a
    deck about ``LIKELY`` copies have a number below a bound; if the last of the
    hand lies below it, no other copy can come before it, and a
    deck of which too few do is drawn from all its copies.
    """
    from ..functions.numbers import hash_unit, unit_of

    deck = decks.filter("n > 0").join(cards.select("card_id", F.col("is_land").cast("int").alias("land")), "card_id").select("game_id", F.struct("card_id", "n", "land").alias("card"))
    total = lambda xs, of: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + of(x))
    decked = clustered(deck, "game_id").groupBy("game_id").agg(F.collect_list("card").alias("deck")).withColumn("copies", total(F.col("deck"), lambda x: x.n))
    bits = lambda start, copy: F.sha2(F.concat(start, copy.cast("string")).cast("binary"), 256)
    start = lambda c, card_id: F.concat(F.lit(f"{seed}:"), F.col("game_id").cast("string"), F.lit(":"), c.cast("string"), F.lit(":"), card_id.cast("string"), F.lit(":"))
    picked = F.array(*[F.lit(c) for c in range(1, candidates + 1)])
    # The bound is a number of 24 bits, all 53 of which a draw's number is rounded to hold; beyond all numbers for a small deck.
    bound = F.when(F.col("copies") > LIKELY, F.floor(F.lit(float(LIKELY << 24)) / F.col("copies")))
    rows = decked.select("game_id", F.coalesce(F.lower(F.lpad(F.hex(bound), 6, "0")), F.lit("g")).alias("below"), F.explode("deck").alias("card")).select("game_id", "below", "card.*")
    rows = rows.select("*", F.explode(picked).alias("candidate")).withColumn("start", start(F.col("candidate"), F.col("card_id")))
    rows = rows.select("game_id", "below", "candidate", "card_id", "land", "start", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    # Exploded, a hash is worked out once for both its uses.
    rows = rows.select("game_id", "below", "candidate", "card_id", "land", "copy", F.explode(F.array(bits(F.col("start"), F.col("copy")))).alias("bits")).filter("bits < below")
    likely = rows.groupBy("game_id").agg(F.collect_list(F.struct("candidate", unit_of(F.substring("bits", 1, 16)).alias("u"), "card_id", "copy", "land")).alias("likely"))
    own = lambda c: F.transform(F.filter("likely", lambda x: x.candidate == c), lambda x: F.struct(x.u.alias("u"), x.card_id.alias("card_id"), x.copy.alias("copy"), x.land.alias("land")))
    every = lambda c: F.flatten(F.transform("deck", lambda x: F.transform(F.sequence(F.lit(1), x.n), lambda k: F.struct(unit_of(F.substring(bits(start(c, x.card_id), k), 1, 16)).alias("u"), x.card_id.alias("card_id"), k.alias("copy"), x.land.alias("land")))))
    first = lambda xs: F.slice(F.sort_array(xs), 1, hand)
    share = F.try_divide(total(F.col("deck"), lambda x: x.land * x.n), F.col("copies"))
    hands = likely.join(decked, "game_id", "right").select("game_id", share.alias("deck_share"), "deck", "copies", bound.alias("bound"), "likely", F.explode(picked).alias("candidate"))
    hands = hands.withColumn("drawn", first(own(F.col("candidate"))))
    enough = F.col("bound").isNull() | (F.get("drawn", F.lit(hand - 1)).u < F.col("bound") / float(1 << 24))
    hands = hands.withColumn("drawn", F.when(F.coalesce(enough, F.lit(False)), F.col("drawn")).otherwise(first(every(F.col("candidate")))))
    hands = hands.select("game_id", "deck_share", "candidate", total(F.col("drawn"), lambda x: x.land).alias("lands"), F.size("drawn").alias("size"), F.array_sort(F.transform("drawn", lambda x: x.card_id)).alias("hand"))
    gap = F.col("lands") / F.col("size") - F.col("deck_share")
    hands = hands.withColumn("weight", F.exp(-(gap * gap) / F.lit(strength)))
    w = Window.partitionBy("game_id").orderBy("candidate")
    hands = hands.withColumns({"upto": F.sum("weight").over(w), "total": F.sum("weight").over(Window.partitionBy("game_id"))}).withColumn("pick", hash_unit(F.concat_ws(":", F.lit(str(seed)), F.col("game_id").cast("string"))) * F.col("total"))
    chosen = hands.filter((F.col("upto") > F.col("pick")) & (F.col("upto") - F.col("weight") <= F.col("pick")))
    return chosen.select("game_id", "candidate", "lands", "hand")


#: Copies of a deck that a hand is looked for among, about.
LIKELY = 16


def mono_color_decks(cards: DataFrame, size: int = 23, most_cost: int = 6) -> DataFrame:
    """For each colour with enough spells: the first ``size`` by (cost, name)."""
    spells = cards.filter(~F.col("is_land") & F.col("color").isNotNull() & (F.col("mana_value") <= most_cost))
    w = Window.partitionBy("color").orderBy("mana_value", "name", "card_id")
    placed = spells.withColumns({"rk": F.row_number().over(w), "all": F.count("*").over(Window.partitionBy("color"))})
    return placed.filter((F.col("rk") <= size) & (F.col("all") >= size)).select("color", "rk", "card_id", "name")
