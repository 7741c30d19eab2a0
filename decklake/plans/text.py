"""Queries: names, decks, costs, types, tags, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cards as K, numbers as N, text as X
from ..sources.adapters import Tables
from .registry import query


@query("x1_x2_names", "SELECT DISTINCT source, strip_accents(lang) AS folded, split_part(concat(lang, ' // ', source), ' // ', 1) AS front FROM documents")
def names(t: Tables) -> DataFrame:
    return t.documents.select("source", K.fold_name("lang").alias("folded"), K.front_face(F.concat("lang", F.lit(" // "), "source")).alias("front")).distinct()


@query("x3_hand_split", "SELECT game_id, count(*) AS n, count(DISTINCT card_id) AS distinct_names FROM hand_cards GROUP BY game_id")
def hand_split(t: Tables) -> DataFrame:
    hands = t.hand_cards.groupBy("game_id").agg(F.array_join(F.collect_list(F.col("card_id").cast("string")), "|").alias("hand"))
    return hands.select("game_id", F.size(K.split_hand(F.col("hand"))).cast("long").alias("n"), F.size(F.array_distinct(K.split_hand(F.col("hand")))).cast("long").alias("distinct_names"))


DECKS = "d AS (SELECT game_id, concat(name, ' x', CAST(n AS STRING)) AS e, n FROM deck_cards JOIN cards USING (card_id))"


@query("x5_deck_encode", f"WITH {DECKS} SELECT game_id, string_agg(e, ' | ' ORDER BY e) AS deck FROM d GROUP BY game_id")
def deck_encode(t: Tables) -> DataFrame:
    return encoded(t)


def encoded(t: Tables) -> DataFrame:
    rows = t.deck_cards.join(t.cards.select("card_id", F.col("name").alias("card")), "card_id")
    return rows.groupBy("game_id").agg(F.collect_list(F.struct("card", "n")).alias("x")).select("game_id", K.encode_deck(F.col("x")).alias("deck"))


@query("x4_deck_decode", f"WITH {DECKS} SELECT game_id, CAST(sum(n) AS BIGINT) AS copies, count(*) AS entries, 0 AS malformed FROM d GROUP BY game_id")
def deck_decode(t: Tables) -> DataFrame:
    decoded = encoded(t).withColumn("x", K.decode_deck(F.col("deck")))
    return decoded.select("game_id", F.size(K.deck_copies(F.col("x"))).cast("long").alias("copies"), F.size("x").cast("long").alias("entries"), F.size(F.filter("x", lambda e: e.n.isNull())).alias("malformed"))


@query("x8_clipped", r"WITH r AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents) SELECT doc_id, CASE WHEN length(c) > 100 THEN substr(c, 1, 99) || '…' ELSE c END AS clipped FROM r")
def clipped(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", K.clipped(F.col("text")).alias("clipped"))


@query("x9_deck_lines", """
WITH l AS (SELECT game_id, 'Deck' AS line, 0 AS p FROM (SELECT DISTINCT game_id FROM deck_cards) UNION ALL
  SELECT game_id, concat(CAST(n AS STRING), ' ', name), row_number() OVER (PARTITION BY game_id ORDER BY card_id) FROM deck_cards JOIN cards USING (card_id)),
x AS (SELECT game_id, name, n, card_id, row_number() OVER (PARTITION BY game_id ORDER BY card_id) AS p FROM deck_cards JOIN cards USING (card_id)),
u AS (SELECT *, sum(CASE WHEN n <= 99 THEN n ELSE 0 END) OVER (PARTITION BY game_id ORDER BY p) AS upto FROM x)
SELECT game_id, CAST(p AS INT) AS line, name AS card, n, CASE WHEN card_id % 50 <> 7 THEN card_id END AS card_id, CASE WHEN n NOT BETWEEN 1 AND 99 THEN 'bad_count' WHEN upto > 250 THEN 'too_many' WHEN card_id % 50 = 7 THEN 'unknown_card' END AS issue FROM u""")
def deck_lines(t: Tables) -> DataFrame:
    rows = t.deck_cards.join(t.cards.select("card_id", "name"), "card_id")
    entry = F.struct("card_id", F.concat(F.col("n").cast("string"), F.lit(" "), "name").alias("line"))
    lists = rows.groupBy("game_id").agg(F.array_sort(F.collect_list(entry)).alias("x")).select("game_id", F.concat(F.lit("Deck\n"), F.array_join("x.line", "\n"), F.lit("\nSideboard\n1 Island")).alias("text"))
    known = t.cards.filter("card_id % 50 <> 7").select(F.col("name").alias("lookup"), "card_id")
    return X.deck_lines(lists, known, "game_id").select("game_id", "line", "card", "n", "card_id", "issue")


@query("x10_x21_mana_cost", """
SELECT p_partkey AS card_id, CAST(p_size % 7 + 1 + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS cmc, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS blue, p_partkey % 3 = 0 AS double_pip, p_partkey % 3 = 1 AS has_x, p_partkey % 3 <> 0 AS has_hybrid FROM part WHERE p_partkey % 10 <> 9
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 10 = 9""")
def mana_cost(t: Tables) -> DataFrame:
    c = F.col
    tail = F.when(c("p_partkey") % 3 == 0, "{U}{U}").when(c("p_partkey") % 3 == 1, "{X}{W/B}").otherwise("{G/U}")
    cost = F.when(c("p_partkey") % 10 == 9, "{Q}").otherwise(F.concat(F.lit("{"), (c("p_size") % 7 + 1).cast("string"), F.lit("}"), tail))
    rows = t.part.select(c("p_partkey").alias("card_id"), K.decode_cost(cost).alias("m"))
    return rows.select("card_id", "m.cmc", F.when(~c("m.bad"), F.coalesce(F.element_at("m.color_pips", F.lit("U")), F.lit(0))).alias("blue"), F.when(~c("m.bad"), F.coalesce(K.double_pip(c("m.color_pips")), F.lit(False))).alias("double_pip"), "m.has_x", "m.has_hybrid")


@query("x11_type_line", "SELECT p_partkey AS card_id, CASE WHEN p_partkey % 2 = 0 THEN 'Legendary' ELSE '' END AS supertypes, 'Creature' AS types, CASE WHEN p_partkey % 3 = 0 THEN concat('Elf|', p_type) ELSE '' END AS subtypes FROM part")
def type_lines(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat(F.when(k % 2 == 0, "Legendary ").otherwise(""), F.lit("Creature"), F.when(k % 3 == 0, F.concat(F.lit(" — Elf "), F.col("p_type"))).otherwise(F.lit("")))
    rows = t.part.select(k.alias("card_id"), K.type_line(line).alias("l"))
    return rows.select("card_id", *[F.array_join(f"l.{c}", "|").alias(c) for c in ("supertypes", "types", "subtypes")])


RULES = [(r"(?i)idiot|stupid|moron", "insult"), (r"\d{3}", "number"), (r"(?i)(^|[^\p{L}])the($|[^\p{L}])", "article"), (r"(?i)(^|[^\p{L}])(der|die|das)($|[^\p{L}])", "artikel")]


@query("x12_rule_tags", r"""
WITH c AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.\n]'))) AS chunk FROM documents),
g AS (SELECT doc_id, CASE WHEN regexp_matches(chunk, '(?i)idiot|stupid|moron') THEN 'insult' WHEN regexp_matches(chunk, '\d{3}') THEN 'number' WHEN regexp_matches(chunk, '(?i)(^|[^\p{L}])the($|[^\p{L}])') THEN 'article' WHEN regexp_matches(chunk, '(?i)(^|[^\p{L}])(der|die|das)($|[^\p{L}])') THEN 'artikel' END AS tag FROM c WHERE chunk <> '')
SELECT doc_id, bool_or(coalesce(tag = 'insult', false)) AS insult, bool_or(coalesce(tag = 'number', false)) AS number, bool_or(coalesce(tag = 'article', false)) AS article, bool_or(coalesce(tag = 'artikel', false)) AS artikel, count(*) FILTER (WHERE tag IS NULL) AS untagged FROM g GROUP BY doc_id""")
def rule_tags(t: Tables) -> DataFrame:
    return X.role_flags(X.tag_chunks(t.documents, RULES, "doc_id", "text"), "doc_id", [n for _, n in RULES])


@query("x13_hash_unit", "SELECT draft_id, round(CAST('0x' || substr(sha256(concat('17:', draft_id)), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE, 12) AS u FROM (SELECT DISTINCT draft_id FROM decisions)")
def hash_unit(t: Tables) -> DataFrame:
    return t.decisions.select("draft_id").distinct().select("draft_id", F.round(N.hash_unit(F.concat(F.lit("17:"), "draft_id")), 12).alias("u"))


@query("x14_row_seed", "SELECT game_id, CAST('0x' || substr(sha256(concat_ws(chr(0), draft_id, CAST(match_number AS STRING), CAST(game_number AS STRING))), 1, 8) AS BIGINT) AS seed FROM decisions")
def row_seed(t: Tables) -> DataFrame:
    return t.decisions.select("game_id", N.row_seed(F.col("draft_id"), F.col("match_number"), F.col("game_number")).alias("seed"))


@query("x15_deck_signature", "SELECT game_id, sha256(string_agg(e, '|' ORDER BY e)) AS signature FROM (SELECT game_id, concat(set_code, ':', CAST(card_id AS STRING)) AS e FROM deck_cards JOIN cards USING (card_id)) GROUP BY game_id")
def signature(t: Tables) -> DataFrame:
    rows = t.deck_cards.join(t.cards, "card_id").groupBy("game_id").agg(F.collect_list(F.concat("set_code", F.lit(":"), F.col("card_id").cast("string"))).alias("x"))
    return rows.select("game_id", K.deck_signature(F.col("x")).alias("signature"))


@query("x16_x17_x19_math", """
SELECT game_id, round(1 / (1 + exp(-(arm_keep - arm_mull))), 9) AS sigmoid, round(ln(p_keep / (1 - p_keep)), 9) AS logit, round(least(greatest(p_keep, 0.2), 0.8)::DOUBLE, 9) AS clipped,
  round(coalesce(p_keep / nullif(mulligan_number, 0), 0), 9) AS ratio, CAST(coalesce(n_games, 0) AS BIGINT) AS games, round(arm_keep - win_rate, 9) AS earliness FROM decisions""")
def math(t: Tables) -> DataFrame:
    c = F.col
    return t.decisions.select("game_id", *[x.alias(n) if n == "games" else F.round(x, 9).alias(n) for n, x in {"sigmoid": N.sigmoid(c("arm_keep") - c("arm_mull")), "logit": N.logit(c("p_keep")), "clipped": N.clip(c("p_keep"), 0.2, 0.8), "ratio": N.ratio(c("p_keep"), c("mulligan_number")), "games": N.whole(c("n_games")), "earliness": c("arm_keep") - c("win_rate")}.items()])


@query("x23_active_flags", "SELECT card_id, concat_ws(',', CASE WHEN is_creature THEN 'creature' END, CASE WHEN is_removal THEN 'removal' END, CASE WHEN is_ramp THEN 'ramp' END) AS flags FROM cards")
def flags(t: Tables) -> DataFrame:
    return t.cards.select("card_id", F.array_join(K.active_flags({"creature": F.col("is_creature"), "removal": F.col("is_removal"), "ramp": F.col("is_ramp")}), ",").alias("flags"))


@query("x25_json_search", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS first, 2 AS copies FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_search(t: Tables) -> DataFrame:
    inner = F.concat(F.lit('{"a": {"MainDeck": [{"cardId": '), F.get_json_object("props", "$.k"), F.lit(', "quantity": 2}]}}'))
    outer = F.to_json(F.struct(F.struct(inner.alias("payload")).alias("request")))
    found = t.events.filter(F.get_json_object("props", "$.k").isNotNull()).select("event_id", X.nested_lists(outer, "MainDeck").alias("x"))
    return found.select("event_id", F.col("x")[0][0].alias("first"), F.size(F.col("x")[0]).alias("copies"))
