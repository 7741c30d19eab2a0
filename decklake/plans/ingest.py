"""Queries: gates, unpivots, decision rows, migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cards as K
from ..sources import ingest as I, materialise as W
from ..sources.adapters import Tables
from .registry import query


@query("a1_a2_marker_gate", "SELECT count(*) AS total, count(*) FILTER (WHERE expansion IS NULL) AS null_expansion, count(*) FILTER (WHERE event_type IS NULL) AS null_event_type, count(*) FILTER (WHERE expansion <> 'BUILDING') AS other_expansion, count(*) FILTER (WHERE event_type <> 'PremierDraft') AS other_event_type FROM decisions")
def marker_gate(t: Tables) -> DataFrame:
    return I.marker_counts(t.decisions, "BUILDING", "PremierDraft")


GAME = ["game_id", "expansion", "event_type", "on_play", "won", "win_rate"]


@query("a1_a3_games_round_trip", "SELECT game_id, expansion, event_type, on_play, won, round(win_rate, 6) AS win_rate FROM decisions WHERE expansion = 'BUILDING' AND event_type = 'PremierDraft'")
def games_round_trip(t: Tables) -> DataFrame:
    """Games as gz CSV, read with inferred types, checked, stored as zstd Parquet."""
    csv, stored = W.scratch(t.spark, "games-csv"), W.scratch(t.spark, "games")
    t.decisions.filter("expansion = 'BUILDING' AND event_type = 'PremierDraft'").select(*GAME).write.option("header", True).option("compression", "gzip").csv(csv)
    I.store_games(I.read_games(t.spark, csv), stored, "BUILDING", "PremierDraft")
    return t.spark.read.parquet(stored).select("game_id", "expansion", "event_type", "on_play", "won", F.round("win_rate", 6).alias("win_rate"))


@query("a4_ratings_array", "SELECT name, round(gih, 6) AS gih, 'Brand#1' AS expansion, 'PremierDraft' AS event_type FROM ratings WHERE expansion = 'Brand#1' AND event_type = 'PremierDraft'")
def ratings_array(t: Tables) -> DataFrame:
    """A JSON array of ratings, with the format's markers added when it is read."""
    path = W.scratch(t.spark, "ratings")
    rows = t.ratings.filter("expansion = 'Brand#1' AND event_type = 'PremierDraft'").select("name", "gih")
    # The file is one array, as it is published: a format's cards, some hundreds.
    rows.agg(F.to_json(F.collect_list(F.struct("name", "gih"))).alias("value")).write.text(path)
    return I.read_ratings(t.spark, path, rows.schema, "Brand#1", "PremierDraft").select("name", F.round("gih", 6).alias("gih"), "expansion", "event_type")


@query("a5_u2_union_by_name", "SELECT game_id, p_keep IS NULL AS no_p, won IS NULL AS no_won FROM (SELECT game_id, CAST(NULL AS DOUBLE) AS p_keep, won FROM decisions WHERE on_play UNION ALL SELECT game_id, p_keep, NULL FROM decisions WHERE NOT on_play)")
def union_by_name(t: Tables) -> DataFrame:
    paths = [W.scratch(t.spark, "part") for _ in range(2)]
    t.decisions.filter("on_play").select("game_id", "won").write.parquet(paths[0])
    t.decisions.filter("NOT on_play").select("game_id", "p_keep").write.parquet(paths[1])
    I.union_view(t.spark, "decklake_union", paths)
    return t.spark.table("decklake_union").select("game_id", F.col("p_keep").isNull().alias("no_p"), F.col("won").isNull().alias("no_won"))


@query("a8_bulk_cards", "SELECT card_id, name, set_code FROM cards WHERE card_id % 3 <> 0")
def bulk_cards(t: Tables) -> DataFrame:
    """gz JSON lines of the newest of two dated snapshots."""
    root = W.scratch(t.spark, "bulk")
    for day, rows in (("20240101", t.cards.limit(5)), ("20240301", t.cards.filter("card_id % 3 <> 0"))):
        rows.select("card_id", "name", "set_code").write.option("compression", "gzip").json(f"{root}/cards-{day}.jsonl.gz")
    return I.read_json_lines(t.spark, I.newest_snapshot(t.spark, root), t.cards.select("card_id", "name", "set_code").schema)


@query("a12_a14_stamped", "SELECT expansion, event_type, count(*) AS n, 'same' AS state FROM decisions WHERE mulligan_number < 2 GROUP BY 1, 2")
def stamped(t: Tables) -> DataFrame:
    """Features written by partition with stamps, resumed with more rows, and what the stamps then say."""
    path, stamp = W.scratch(t.spark, "features"), W.Stamp("s1", "f1", 200)
    rows = t.decisions.select("game_id", "mulligan_number", "expansion", "event_type", "p_base")
    W.write_stamped(rows.filter("mulligan_number = 0"), path, stamp)
    W.write_stamped(rows.filter("mulligan_number < 2"), path, stamp, "resume", ["game_id"])
    counts = t.spark.read.parquet(f"{path}/data").groupBy("expansion", "event_type").agg(F.count("*").alias("n"))
    return counts.join(W.stamp_report(t.spark, path, stamp).select(*W.PARTITION, "state"), W.PARTITION)


@query("a13_u1_shard_read", "SELECT game_id, round(p_keep, 6) AS p_keep FROM decisions WHERE mulligan_number = 0 AND n_games >= 100")
def shard_read(t: Tables) -> DataFrame:
    path = W.scratch(t.spark, "shards")
    for k in range(3):
        t.decisions.filter(F.col("game_id") % 3 == k).write.parquet(f"{path}/chunk_{k:05d}")
    keep = (F.col("mulligan_number") == 0) & (F.col("n_games") >= 100)
    return W.read_shards(t.spark, path, ["game_id", "p_keep"], keep).select("game_id", F.round("p_keep", 6).alias("p_keep"))


@query("a19_csv_export", "SELECT game_id, expansion, round(p_keep, 6) AS p_keep FROM decisions")
def csv_export(t: Tables) -> DataFrame:
    path = W.scratch(t.spark, "export")
    rows = t.decisions.select("game_id", "expansion", F.round("p_keep", 6).alias("p_keep"), "won")
    names = I.export_csv(rows, path, ["game_id", "no such column", "expansion", "p_keep"])
    return t.spark.read.option("header", True).schema(rows.select(*names).schema).csv(path)


@query("l7_limits", f"""
WITH w AS (SELECT d.game_id, d.win_rate IS NULL OR d.n_games IS NULL AS bad FROM decisions d), p AS (SELECT *, row_number() OVER (ORDER BY game_id) AS k FROM w), q AS (SELECT *, row_number() OVER (ORDER BY game_id) AS k FROM w WHERE NOT bad)
SELECT 'games' AS limit_of, game_id FROM p WHERE k <= 300 AND NOT bad UNION ALL SELECT 'decisions', game_id FROM q WHERE k <= 300""")
def limits(t: Tables) -> DataFrame:
    """The first 300 games, of which those pass; and the first 300 that pass."""
    reasons = {"missing_context": F.col("win_rate").isNull() | F.col("n_games").isNull()}
    parts = [I.gated_with_limit(t.decisions, reasons, 300, ["game_id"], before).select(F.lit(name).alias("limit_of"), "game_id") for name, before in (("games", True), ("decisions", False))]
    return parts[0].unionByName(parts[1])


@query("b3_unpivot", """
WITH w AS (SELECT game_id, sum(CASE WHEN k = 0 THEN n END) AS d0, sum(CASE WHEN k = 1 THEN n END) AS d1, sum(CASE WHEN k = 2 THEN n END) AS d2, sum(CASE WHEN k = 3 THEN n END) AS d3 FROM (SELECT game_id, card_id % 4 AS k, n FROM deck_cards) GROUP BY 1)
SELECT game_id, 'deck' AS zone, card, CAST(n AS INT) AS n FROM (SELECT game_id, 'c0' AS card, d0 AS n FROM w UNION ALL SELECT game_id, 'c1', d1 FROM w UNION ALL SELECT game_id, 'c2', d2 FROM w UNION ALL SELECT game_id, 'c3', d3 FROM w) WHERE n > 0""")
def unpivot(t: Tables) -> DataFrame:
    wide = t.deck_cards.withColumn("k", F.concat(F.lit("deck_c"), (F.col("card_id") % 4).cast("string"))).groupBy("game_id").pivot("k", [f"deck_c{i}" for i in range(4)]).agg(F.sum("n"))
    return I.long_cards(wide, ["game_id"], {"deck": "deck_", "hand": "opening_hand_"})


GATE = """
WITH d AS (SELECT game_id, sum(n) AS deck_n, count(*) FILTER (WHERE card_id % 50 = 7) AS unknown_cards FROM deck_cards GROUP BY 1),
h AS (SELECT game_id, count(*) AS hand_n FROM hand_cards WHERE NOT (slot = 7 AND game_id % 9 = 0) GROUP BY 1),
x AS (SELECT game_id, CASE WHEN win_rate IS NULL OR n_games IS NULL OR player_rank IS NULL THEN 'missing_context' WHEN mulligan_number NOT BETWEEN 0 AND 6 OR opp_mulligans NOT BETWEEN 0 AND 6 THEN 'mulligans_out_of_range'
  WHEN hand_n <> 7 THEN 'hand_size' WHEN deck_n NOT BETWEEN 40 AND 42 THEN 'deck_size' WHEN unknown_cards > 0 THEN 'unknown_card' END AS reject_reason FROM decisions LEFT JOIN d USING (game_id) LEFT JOIN h USING (game_id))
"""


def gated(t: Tables) -> DataFrame:
    decks = t.deck_cards.groupBy("game_id").agg(F.sum("n").alias("deck_n"), F.count_if(F.col("card_id") % 50 == 7).alias("unknown_cards"))
    hands = t.hand_cards.filter("NOT (slot = 7 AND game_id % 9 = 0)").groupBy("game_id").agg(F.count("*").alias("hand_n"))
    return I.ordered_gate(t.decisions.join(decks, "game_id", "left").join(hands, "game_id", "left"), I.game_reasons())


@query("b4_game_gate_counts", GATE + "SELECT coalesce(reject_reason, 'kept') AS reason, count(*) AS n FROM x GROUP BY 1")
def gate_counts(t: Tables) -> DataFrame:
    return gated(t).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("b4b_game_gate_rows", GATE + "SELECT game_id FROM x WHERE reject_reason IS NULL")
def gate_rows(t: Tables) -> DataFrame:
    return gated(t).filter("reject_reason IS NULL").select("game_id")


@query("b5_decision_gate", """
WITH x AS (SELECT game_id, CASE WHEN player_rank IS NULL THEN 'missing_context' WHEN NOT (mulligan_number BETWEEN 0 AND 6 AND opp_mulligans BETWEEN 0 AND 6) THEN 'mulligans_out_of_range' WHEN game_id % 9 = 0 THEN 'hand_size'
  WHEN coalesce(n_games >= 50 AND win_rate < 0.5, false) THEN 'known_bad_player' WHEN game_id % 31 = 4 THEN 'malformed_deck' END AS reason FROM decisions WHERE expansion = 'BUILDING' AND event_type = 'PremierDraft')
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM x GROUP BY 1""")
def decision_gate(t: Tables) -> DataFrame:
    from ..functions.numbers import keeps_player

    c = F.col
    deck = F.when(c("game_id") % 31 == 4, F.lit("Island x3 | Swamp")).otherwise(F.lit("Island x3 | Swamp x2"))
    rows = t.decisions.filter("expansion = 'BUILDING' AND event_type = 'PremierDraft'").withColumns({"hand_size": F.when(c("game_id") % 9 == 0, 6).otherwise(7), "decoded": K.decode_deck(deck)})
    out = I.ordered_gate(rows, {
        "missing_context": c("player_rank").isNull(), "mulligans_out_of_range": ~(c("mulligan_number").between(0, 6) & c("opp_mulligans").between(0, 6)), "hand_size": c("hand_size") != 7,
        "known_bad_player": ~keeps_player(c("n_games"), c("win_rate")), "malformed_deck": F.exists("decoded", lambda e: e.n.isNull()),
    }, "reason")
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("a6_w7_candidate_hands", """
WITH r AS (SELECT game_id, mulligan_number AS k, concat('h', CAST(game_id AS STRING)) AS h FROM decisions)
SELECT game_id, CAST(i AS INT) AS mulligan_number, concat(h, '-', CAST(i AS STRING)) AS hand, i = k AS was_kept FROM r, range(0, 7) g(i) WHERE i <= k""")
def candidate_hands(t: Tables) -> DataFrame:
    slots = {f"candidate_hand_{i + 1}": F.when(F.col("mulligan_number") >= i, F.concat(F.lit("h"), F.col("game_id").cast("string"), F.lit(f"-{i}"))) for i in range(7)}
    replays = t.decisions.select("game_id", F.col("mulligan_number").alias("num_mulligans"), *[c.alias(n) for n, c in slots.items()])
    return I.candidate_hands(replays, ["game_id"], list(slots), "num_mulligans")


@query("a6b_replay_scan", """
WITH d AS (SELECT game_id, sum(n) FILTER (WHERE card_id % 3 = 0) AS c0, sum(n) FILTER (WHERE card_id % 3 = 1) AS c1, sum(n) FILTER (WHERE card_id % 3 = 2) AS c2 FROM deck_cards GROUP BY 1),
r AS (SELECT game_id, draft_id, mulligan_number AS k, concat('h', CAST(game_id AS STRING)) AS h, c0, c1, c2 FROM decisions LEFT JOIN d USING (game_id))
SELECT game_id, draft_id, CAST(i AS INT) AS mulligan_number, concat(h, '|', CAST(i AS STRING)) AS hand, i = k AS was_kept, card, CAST(n AS INT) AS n
FROM r, range(0, 7) g(i), (SELECT 'c0' AS card UNION ALL SELECT 'c1' UNION ALL SELECT 'c2') f, LATERAL (SELECT CASE card WHEN 'c0' THEN c0 WHEN 'c1' THEN c1 ELSE c2 END AS n) v WHERE i <= k AND n > 0""")
def replay_scan(t: Tables) -> DataFrame:
    """Replays as gz CSV, of which the slots, ids and deck columns are scanned: each hand that was offered beside its deck."""
    csv = W.scratch(t.spark, "replays")
    k, slots = F.col("mulligan_number"), [f"candidate_hand_{i + 1}" for i in range(7)]
    decks = t.deck_cards.groupBy("game_id").agg(*[F.sum(F.when(F.col("card_id") % 3 == i, F.col("n"))).alias(f"deck_c{i}") for i in range(3)])
    hands = [F.when(k >= i, F.concat(F.lit("h"), F.col("game_id").cast("string"), F.lit(f"|{i}"))).alias(slot) for i, slot in enumerate(slots)]
    rows = t.decisions.select("game_id", "draft_id", k.alias("num_mulligans"), "player_rank", *hands).join(decks, "game_id", "left")
    rows.write.option("header", True).option("compression", "gzip").csv(csv)
    scanned = I.scan_replays(t.spark, csv, ["game_id", "draft_id", "num_mulligans", *slots])
    found = I.candidate_hands(scanned, ["game_id", "draft_id", *[c for c in scanned.columns if c.startswith("deck_")]], slots, "num_mulligans")
    ids = ["game_id", "draft_id", "mulligan_number", "hand", "was_kept"]
    return I.long_cards(found, ids, {"deck": "deck_"}).drop("zone").withColumn("game_id", F.col("game_id").cast("long"))


@query("a10_id_index", "WITH r AS (SELECT card_id, concat('o', CAST(card_id % 60 AS STRING)) AS oracle_id, set_code, arena_id, row_number() OVER (PARTITION BY card_id % 60, set_code ORDER BY lpad(CAST(card_id AS STRING), 9, '0')) AS rk FROM cards WHERE arena_id IS NOT NULL) SELECT oracle_id, set_code, arena_id FROM r WHERE rk = 1")
def id_index(t: Tables) -> DataFrame:
    c = F.col
    record = F.struct(F.concat(F.lit("o"), (c("card_id") % 60).cast("string")).alias("oracle_id"), c("set_code").alias("set"), c("arena_id").cast("string").alias("arena_id"))
    maps = t.cards.select(F.to_json(F.create_map(F.lpad(c("card_id").cast("string"), 9, "0"), record)).alias("value"))
    return I.id_index(maps)


@query("a8_a11_tolerant_load", "SELECT event_type, count(*) FILTER (WHERE event_id % 7 <> 0) AS good, count(*) FILTER (WHERE event_id % 7 = 0) AS skipped FROM events GROUP BY event_type")
def tolerant(t: Tables) -> DataFrame:
    lines = t.events.select("event_type", F.when(F.col("event_id") % 7 == 0, F.lit('{"k": ')).otherwise(F.col("props")).alias("value"))
    good, skipped = I.tolerant_split(lines, "k long", "event_type")
    return good.groupBy("event_type").agg(F.count("*").alias("good")).join(skipped, "event_type")


@query("a17_g5_migration", """
SELECT coalesce(expansion, '<null>') AS value, count(*) AS n, CAST(sum(CASE WHEN expansion = 'BUILDING' THEN 1 ELSE 0 END) AS DOUBLE) AS set_code_BUILDING, CAST(sum(CASE WHEN expansion = 'MACHINERY' THEN 1 ELSE 0 END) AS DOUBLE) AS set_code_MACHINERY, expansion NOT IN ('BUILDING', 'MACHINERY') AS out_of_vocabulary FROM decisions GROUP BY expansion""")
def migration(t: Tables) -> DataFrame:
    before = t.decisions.select("game_id", "expansion", F.lit(0.0).alias("set_code_BUILDING"))
    after = W.migrate_one_hots(before, "expansion", ["BUILDING", "MACHINERY"])
    return after.groupBy(F.coalesce("expansion", F.lit("<null>")).alias("value")).agg(F.count("*").alias("n"), F.sum("set_code_BUILDING").alias("set_code_BUILDING"), F.sum("set_code_MACHINERY").alias("set_code_MACHINERY"), F.max(~F.col("expansion").isin("BUILDING", "MACHINERY")).alias("out_of_vocabulary"))
