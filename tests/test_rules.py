"""Null, edge and order rules that the tables do not reach."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from decklake.functions import cards as K, numbers as N, text as X
from decklake.operators import catalogue as C, features as E, metrics as M, models as L, ranks, reports as R


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column.alias("x")).first().x


@pytest.mark.parametrize("rate, label", [(0.44, "<45%"), (0.45, "45-50%"), (0.4999, "45-50%"), (0.5, "50-55%"), (0.6, ">=60%"), (float("nan"), "unknown"), (None, "unknown")])
def test_win_rate_label(spark, rate, label):
    assert one(spark, N.win_rate_label(F.lit(rate).cast("double"))) == label


@pytest.mark.parametrize("n, label", [(1, "<10"), (10, "10-49"), (1000, "500+"), (7, "unknown"), (None, "unknown")])
def test_n_games_label(spark, n, label):
    assert one(spark, N.n_games_label(F.lit(n).cast("int"))) == label


@pytest.mark.parametrize("n, rate, keep", [(None, None, True), (None, 0.3, True), (100, None, True), (100, float("nan"), True), (10, 0.2, True), (49, 0.3, True), (50, 0.5, True), (100, 0.55, True), (50, 0.49, False)])
def test_known_bad_player(spark, n, rate, keep):
    assert one(spark, N.keeps_player(F.lit(n).cast("int"), F.lit(rate).cast("double"))) is keep


@pytest.mark.parametrize("p, verdict", [(0.85, "marginal_keep"), (0.8501, "clear_keep"), (0.65, "borderline"), (0.45, "marginal_mulligan"), (0.25, "clear_mulligan"), (None, None)])
def test_verdict_edges(spark, p, verdict):
    assert one(spark, N.banded(F.lit(p).cast("double"))) == verdict


def test_hash_unit_and_seed(spark):
    import hashlib

    for text in ("17:d1", "é", ""):
        assert one(spark, N.hash_unit(F.lit(text))) == int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") / 2**64
    assert one(spark, N.row_seed(F.lit("d"), F.lit(1))) == int.from_bytes(hashlib.sha256(b"d\x001").digest()[:4], "big")


def test_ratio_whole_any_of(spark):
    assert one(spark, N.ratio(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, N.whole(F.lit(float("nan")))) == 0
    assert one(spark, N.any_of(F.array(F.lit(0.5), F.lit(0.5)))) == 0.75
    assert one(spark, N.any_of(F.array().cast("array<double>"))) == 0.0


def test_names(spark):
    rows = spark.createDataFrame([("Lim-Dûl",), ("Māui // Back",), ("Søren",), (None,)], "name string").select(K.fold_name("name").alias("f"), K.front_face(F.col("name")).alias("b")).collect()
    assert [r.f for r in rows] == ["Lim-Dul", "Maui // Back", "Søren", None]
    assert rows[1].b == "Māui"


def test_join_by_name_falls_back_to_front(spark):
    cards = spark.createDataFrame([("Ālpha",), ("Beta // Gamma",), ("Nothing",)], "name string")
    stats = spark.createDataFrame([("Alpha", 1), ("Beta", 2)], "name string, v int")
    got = {r.name: (r.matched_by, r.v) for r in C.join_by_name(cards, stats).collect()}
    assert got == {"Ālpha": ("full", 1), "Beta // Gamma": ("front", 2), "Nothing": (None, None)}


def test_decks_round_trip(spark):
    df = spark.createDataFrame([("Beast x2 x3 | Axe x1",), ("Swamp",), ("",)], "deck string").withColumn("d", K.decode_deck(F.col("deck")))
    rows = df.select("d", K.encode_deck(F.col("d")).alias("e")).collect()
    assert [(c.card, c.n) for c in rows[0].d] == [("Beast x2", 3), ("Axe", 1)] and rows[0].e == "Axe x1 | Beast x2 x3"
    assert rows[1].d[0].n is None and rows[2].d == []


@pytest.mark.parametrize("cost, cmc, bad", [("{2}{W}{U/B}", 4, False), ("{2/W}{X}", 2, False), ("{G/P}", 1, False), ("", 0, False), ("{Q}", None, True), ("2{W}", None, True)])
def test_mana_cost(spark, cost, cmc, bad):
    x = one(spark, K.decode_cost(F.lit(cost)))
    assert (x.cmc, x.bad) == (cmc, bad)


def test_deck_lines(spark):
    text = "Deck\n4 Island (SET) 12\n0 Island\nwhat\n3x Gone\n\nSideboard\n9 Island"
    names = spark.createDataFrame([("Island", 1)], "lookup string, card_id long")
    lists = spark.createDataFrame([(1, text), (2, None), (3, "\n".join(["99 Island"] * 3))], "list_id int, text string")
    rows = X.deck_lines(lists, names).orderBy("list_id", "line").collect()
    assert [(r.list_id, r.n, r.issue) for r in rows] == [(1, 4, None), (1, 0, "bad_count"), (1, None, "unreadable"), (1, 3, "unknown_card"), (3, 99, None), (3, 99, None), (3, 99, "too_many")]


def _deck(value):
    """What a list under the key holds, by plain rules; None for no such list."""

    def whole(x):
        if isinstance(x, bool) or not isinstance(x, (int, str)):
            return None
        return int(x) if re.fullmatch(r"\s*[+-]?[0-9]+\s*", str(x)) else None

    if not isinstance(value, list) or not value:
        return None
    if all(isinstance(x, dict) for x in value):
        pairs = [(whole(x.get("cardId", x.get("id"))), whole(x.get("quantity", x.get("Quantity", 1)))) for x in value]
        return None if any(i is None or n is None or n < 1 for i, n in pairs) else [i for i, n in pairs for _ in range(n)]
    ids = [whole(x) for x in value]
    return None if None in ids else ids


def _walk(value, path=()):
    if isinstance(value, dict):
        if _deck(value.get("MainDeck")) is not None:
            yield path, _deck(value["MainDeck"])
        value = [value[k] for k in sorted(value)]
    elif isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            value = [json.loads(value)]
        except ValueError:
            return
    if isinstance(value, list):
        for i, v in enumerate(value):
            yield from _walk(v, (*path, i))


def test_json_search_against_a_plain_walk(spark):
    rng = random.Random(11)

    def any_json(depth):
        pick = rng.randrange(10 if depth else 4)
        if pick < 4:
            return rng.choice([None, True, 7, -3, 2.5, "x", " 12 ", "{", "[1", '{"MainDeck": [1]} {}', '{"MainDeck": [1]}}', '["a"]]'])
        if pick < 6:
            return [any_json(depth - 1) for _ in range(rng.randrange(4))]
        if pick < 7:
            return " " * rng.randrange(2) + json.dumps(any_json(depth - 1))
        made = {k: any_json(depth - 1) for k in rng.sample(["a", "b", "MainDeck", "zz", "\u00e9"], rng.randrange(1, 4))}
        if rng.random() < 0.6:
            one = lambda: rng.choice([{"cardId": rng.randrange(9), "quantity": rng.randrange(1, 4)}, {"id": str(rng.randrange(9)), "Quantity": "2"}, {"cardId": 4}])
            made["MainDeck"] = rng.choice([[rng.randrange(99) for _ in range(rng.randrange(4))], [one() for _ in range(rng.randrange(1, 4))], [1, {"id": 1}], [{"cardId": 1, "quantity": 0}], [{"quantity": 1}], ["5", 6], [True], [1.5], 3])
        return made

    values = [any_json(rng.randrange(7)) for _ in range(2_000)]
    values = [v for v in values if isinstance(v, (dict, list))]
    want = [[ids for _, ids in sorted(_walk(v), key=lambda x: x[0])] for v in values]
    assert sum(map(len, want)) > 100
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)], "i int, t string")
    found = rows.select("i", X.nested_lists(F.col("t"), "MainDeck").alias("x"))
    assert [r.x for r in sorted(found.collect(), key=lambda r: r.i)] == want
    arrow = rows.select("i", X.search_json("MainDeck")("t").alias("x"))
    assert [r.x for r in sorted(arrow.collect(), key=lambda r: r.i)] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_json_search_of_odd_texts(spark):
    deep = '{"x":' * 400 + '{"MainDeck":[8]}' + "}" * 400
    text_in_text = '{"MainDeck":[3]}'
    for _ in range(6):
        text_in_text = json.dumps({"p": text_in_text})
    hidden = '{"p": "\\u007b\\"MainDeck\\": \\u005b6]}"}'
    wide = json.dumps([{"a": [i]} for i in range(20_000)] + [{"MainDeck": [2, 2]}])
    cases = {
        None: [], "": [], "{": [], "[]": [], "7": [], '{"MainDeck":[9]} x': [], '{"MainDeck":[1],"MainDeck":[2]}': [],
        '{"MainDeck":[99999999999999999999]}': [], '{"MainDeck":[{"cardId":1,"quantity":3000000000}]}': [], '{"MainDeck":[{"cardId":1,"quantity":6000},{"cardId":2,"quantity":6000}]}': [],
        '{"b":{"MainDeck":[1]},"a":{"MainDeck":[2]},"MainDeck":[3]}': [[3], [2], [1]], deep: [[8]], text_in_text: [[3]], hidden: [[6]], wide: [[2, 2]],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", X.nested_lists(F.col("t"), "MainDeck").alias("x"), X.search_json("MainDeck")("t").alias("y"))
    for r in sorted(rows.collect(), key=lambda r: r.i):
        assert r.x == r.y == list(cases.values())[r.i]


def test_positions_and_ranks(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice([0.1, 0.2, 0.2, 0.7, rng.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, p double")
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.i: r.position for r in ranks.positions(df, "p", ["i"], bucket_rows=40).collect()} == want
    got = {r.p: r["rank"] for r in ranks.average_ranks(df, "p", bucket_rows=40).collect()}
    for p in (0.1, 0.2, 0.7):
        places = [want[i] + 1 for i, q in rows if q == p]
        assert got[p] == sum(places) / len(places)


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "p double, y int")
    assert M.auc(df, "p", "y").first().auc is None
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.2, 0)], "p double, y int")
    assert M.auc(df, "p", "y").first().auc == 0.75


def test_shrinkage_rules(spark):
    rows = [("S", "E", f"c{i:02d}", 10**9 if i == 0 else 0, (i + 0.5) / 50, 0.4 + 0.3 * (i + 0.5) / 50) for i in range(50)]
    rows += [("S", "E", "norate", 5, 0.5, None), ("S", "E", "noplay", 0, None, 0.9)]
    df = spark.createDataFrame(rows, "expansion string, event_type string, name string, pick_count long, play_rate double, gih double")
    got = {r.name: r.shrunk_gih for r in E.shrunk(df, ["gih"]).collect()}
    assert got["c00"] == pytest.approx(rows[0][5], abs=1e-6)  # many picks: the rate itself
    low = sum(r[5] for r in rows[:5]) / 5
    assert got["c01"] == pytest.approx(low)  # no picks: the mean of its bin
    known = [r[5] for r in rows if r[5] is not None]
    assert got["noplay"] == pytest.approx(sum(known) / len(known))
    with pytest.raises(ValueError):
        E.shrunk(df, ["gih"], k=-1)


def test_z_of_no_spread_is_null(spark):
    df = spark.createDataFrame([("S", "E", 1.0), ("S", "E", 1.0)], "expansion string, event_type string, x double")
    assert [r.z_x for r in E.z_scores(df, ["x"]).collect()] == [None, None]


def role_cards(spark, rows):
    """A flat catalogue: (card_id, name, is_land, is_creature, z_oh, c1 to c4), all other roles false."""
    roles = ("is_basic", "makes_creatures", "destroy_or_exile", "burn", "bounce", "top_library", "removal_aura", "counterspell", "punch_fight", "trick", "pump_aura", "equipment", "vehicle", "saga", "class_card", "planeswalker", "draw", "alt_mode", "mana_ability", "fetches_land", "is_other")
    df = spark.createDataFrame(rows, "card_id long, name string, is_land boolean, is_creature boolean, z_oh double, c1 double, c2 double, c3 double, c4 double")
    return df.withColumns({r: F.lit(False) for r in roles} | {"mana_value": F.lit(2)})


def test_product_with_certainty(spark):
    """Odds of 1, of 0 and null; copies of a name count once; a deck without spells has zeros."""
    cards = role_cards(spark, [(1, "sure", False, True, 0.9, 1.0, 1.0, 1.0, 1.0), (2, "half", False, False, None, 0.5, 0.5, 0.5, 0.5), (3, "half", False, False, 0.1, 0.5, 0.5, 0.5, 0.5), (4, "never", False, False, 0.9, 0.0, 0.0, 0.0, 0.0), (5, "unknown", False, True, 0.9, None, None, None, None), (6, "other half", False, False, 0.1, 0.5, 0.5, 0.5, 0.5), (7, "land", True, False, None, 1.0, 1.0, 1.0, 1.0)])
    decks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("b", 6), ("c", 4), ("c", 5), ("d", 7)], "game_id string, card_id long")
    got = {r.game_id: r for r in E.castability_features(decks, cards).collect()}
    assert {g: (r.any_spell_t1, r.any_spell_t2, r.count_spell_t2, r.any_spell_strong_t2, r.any_creature_t2) for g, r in got.items()} == {
        "a": (1.0, 1.0, 1.5, 1.0, 1.0), "b": (0.75, 0.75, 1.0, 0.0, 0.0), "c": (0.0, 0.0, 0.0, 0.0, 0.0), "d": (0.0, 0.0, 0.0, 0.0, 0.0),
    }
    assert len(got["a"].asDict()) == 97


def test_split_fractions(spark):
    with pytest.raises(ValueError):
        L.split_of(F.lit("d"), 0.5, 0.5)
    df = spark.range(0).select(F.col("id").cast("string").alias("d"))
    with pytest.raises(ValueError):
        L.checked_split(df, L.split_of(F.col("d"), 0.1, 0.1))


def test_baseline_recovers_log_odds(spark):
    rates = {("a", True): 0.4, ("a", False): 0.38, ("b", True): 0.62, ("b", False): 0.58}
    rows = [(wr, "n", play, 0, int(i < rate * 1000)) for (wr, play), rate in rates.items() for i in range(1000)]
    df = spark.createDataFrame(rows, "wr string, ng string, on_play boolean, opp int, label int")
    margins = L.baseline_margin(L.baseline(df, ["wr", "ng", "on_play"], "opp", "label"), df, ["wr", "ng", "on_play"], "opp").groupBy("wr", "on_play").agg(F.avg("margin").alias("m")).collect()
    for r in margins:
        rate = rates[r.wr, r.on_play]
        assert r.m == pytest.approx(math.log(rate / (1 - rate)), abs=0.2)


def test_left_join_guard(spark):
    left, right = spark.range(10).withColumnRenamed("id", "k"), spark.createDataFrame([(i, f"r{j}") for i in range(9) for j in (2, 1)], "k long, r string")
    assert {r.k: r.r for r in R.left_join_guarded(left, right, ["k"], 0.2).collect()}[3] == "r1"
    with pytest.raises(ValueError):
        R.left_join_guarded(left, right, ["k"], 0.05)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 20)
    a, b = (sorted(r.id for r in R.sample_groups(x, "g", 5, 1).collect()) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 50


def test_counters_of_a_hand_hold_up_to_their_bound(spark):
    """As many cards as a counter holds are counted; one more is an error, not a carry into the next counter."""
    from decklake.operators import features as E
    from decklake.sources.adapters import ROLE_CARDS

    spark.range(1, 41).selectExpr("id AS p_partkey", "id AS p_size").createOrReplaceTempView("part")
    flat = spark.sql(ROLE_CARDS)
    cards = flat.withColumns({"colors": F.array(F.lit("W")), "double_pip": F.lit(True)})
    hand = lambda n: spark.range(n).select(F.lit(1).cast("long").alias("game_id"), F.lit(1).cast("long").alias("card_id"))
    spark.catalog.dropTempView("part")
    got = E.hand_features(hand(E.MOST_COPIES), cards).first()
    assert (got.spells, got.lands, got.double_pip, got.distinct_colors, len(got)) == (E.MOST_COPIES, 0, E.MOST_COPIES, 1, 72)
    with pytest.raises(Exception, match="too many cards: game 1"):
        E.hand_features(hand(E.MOST_COPIES + 1), cards).collect()


def test_feature_coverage(spark):
    from decklake.operators import reports as R

    df = spark.createDataFrame([("A", 1.0, "x"), ("A", None, "y"), ("B", float("nan"), None), ("B", 2.0, "z"), (None, 3.0, "z")], "d string, f double, s string")
    got = {r.feature: tuple(r)[1:] for r in R.feature_coverage(df, ["f", "s", "gone"], "d", "A").collect()}
    assert got == {"f": (True, 1, 1, 2, 2), "s": (True, 2, 1, 2, 2), "gone": (False, 0, 0, 2, 2)}
    assert math.isnan(R.with_features(df, ["f", "gone"]).first().gone)


def test_smoothed_hands_count_copies_out_within_a_game(spark):
    """No copy of a card is shuffled or sorted with other games', and a card without copies is in no hand."""
    from decklake.operators import features as E

    decks = spark.createDataFrame([(1, 10, 0), (1, 11, 5), (1, 12, 4), (2, 11, 2)], "game_id long, card_id long, n int")
    cards = spark.createDataFrame([(10, True), (11, False), (12, True)], "card_id long, is_land boolean")
    out = E.smoothed_hands(decks, cards)
    got = {r.game_id: r for r in out.collect()}
    assert len(got[1].hand) == 7 and set(got[1].hand) == {11, 12} and got[1].lands == got[1].hand.count(12) and got[2].hand == [11, 11]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert max(i for i, line in enumerate(plan) if "Generate" in line) < min(i for i, line in enumerate(plan) if "Repartition" in line)


@pytest.mark.parametrize("likely", [1, 7, 16])
def test_smoothed_hands_are_the_first_copies_by_their_numbers(spark, monkeypatch, likely):
    """Against plain hashes, whether most hands, some or next to none need all copies of their deck; only likely copies are kept, and hashed once, in generated code."""
    import hashlib

    from decklake.operators import features as E

    monkeypatch.setattr(E, "LIKELY", likely)
    decks = [(g, g * 10 + k, 1 + (g * 7 + k * 5) % 30) for g in range(40) for k in range(1 + g % 5)]
    out = E.smoothed_hands(spark.createDataFrame(decks, "game_id long, card_id long, n int").repartition(3), spark.range(500).select(F.col("id").alias("card_id"), (F.col("id") % 3 == 0).alias("is_land")))
    unit = lambda *parts: float(int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16], 16)) / 2.0**64
    want = {}
    for game in range(40):
        deck = [(card, n) for g, card, n in decks if g == game]
        share = sum(n for card, n in deck if card % 3 == 0) / sum(n for _, n in deck)
        hands = [[card for _, card, _ in sorted((unit(0, game, c, card, copy), card, copy) for card, n in deck for copy in range(1, n + 1))[:7]] for c in (1, 2, 3)]
        weights = [math.exp(-((sum(card % 3 == 0 for card in h) / len(h) - share) ** 2) / 0.015) for h in hands]
        at = next(i for i in range(3) if sum(weights[: i + 1]) > sum(weights) * unit(0, game))
        want[game] = (at + 1, sorted(hands[at]))
    assert {r.game_id: (r.candidate, r.hand) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(array(sha2(") == 1 and "(bits" in plan.split("explode(array(sha2(")[0].splitlines()[-2]


def test_value_equal_to_its_floor_is_never_below(spark):
    """Seven rates whose mean is 2/3, summed in any order, and a rate of 2/3 beside them."""
    from decklake.operators import reports as R

    rates = [305, 369, 472, 450, 199, 366, 177]
    assert 3 * sum(rates) == 2 * 501 * len(rates)
    for turn in range(len(rates)):
        rows = [("d", n / 501, 326 / 489) for n in rates[turn:] + rates[:turn]]
        df = spark.createDataFrame(rows, "draft string, deeper double, p double").coalesce(1)
        assert R.floored_mean(df, ["draft"], "p", "deeper").first()["below"] == 0
        assert R.floor_diagnostics(df, ["draft"], ["draft"], "draft", "deeper", "p").first()["clamped"] == 0


def test_castability_moves_short_rows_only(spark):
    """No shuffle of the plan holds a feature, and a name's copies, lands and unknown cards count as before."""
    from decklake.sources.adapters import Tables

    cards = Tables(spark, "/root/testdata/sf0.001").role_cards.filter("card_id < 12").withColumn("name", F.expr("CASE WHEN card_id IN (1, 2) THEN 'same' ELSE name END"))
    decks = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 5, 3), (2, 5, 1), (3, 999, 1), (4, 3, 1), (4, 4, 1)], "game_id long, card_id long, n int")
    out = E.castability_features(decks, cards, mean="deck_mean")
    c = {r.card_id: r for r in cards.collect()}
    got = {r.game_id: r.asDict() for r in out.collect()}
    assert len(got[1]) == 98 and sorted(got) == [1, 2, 3, 4]
    assert abs(got[1]["any_spell_t2"] - c[1].c2) < 1e-12 and abs(got[1]["deck_mean"] - (2 * c[1].c4 + c[2].c4) / 3) < 1e-12
    assert not any(v for g in (2, 3) for k, v in got[g].items() if k != "game_id")
    assert abs(got[4]["any_spell_t2"] - (1 - (1 - c[3].c2) * (1 - c[4].c2))) < 1e-12 and abs(got[4]["count_spell_t2"] - c[3].c2 - c[4].c2) < 1e-12
    wide = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "any_spell_t2" in line]
    assert wide and all("MapInArrow" in line for line in wide)


def test_wide_aggregates_take_all_partitions(spark):
    """The rows of a game's wide aggregate are not put together by their bytes: the shuffle before it has a set number of partitions."""
    from decklake.plans import features as P, catalogue as Q
    from decklake.sources.adapters import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for build in (P.deck_features, P.hand_features, P.hand_slices, Q.primary_set):
        assert "REPARTITION_BY_NUM" in build(t)._jdf.queryExecution().executedPlan().toString()
