"""Views that give the given tables the shape of the operators' inputs.

Each view is one SQL text that both Spark and the checking engine read, so
that queries and their checks start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: One row per candidate hand: an order is a game, its customer the draft.
DECISIONS = """
SELECT o.o_orderkey AS game_id, c.c_mktsegment AS expansion,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'TradDraft' ELSE 'PremierDraft' END AS event_type,
  concat('d', CAST(o.o_custkey AS STRING)) AS draft_id, o.o_orderkey % 3 + 1 AS match_number, o.o_orderkey AS game_number,
  (o.o_orderkey % 2 = 0) AS on_play,
  CASE o.o_custkey % 6 WHEN 0 THEN 'mythic' WHEN 1 THEN 'diamond' WHEN 2 THEN 'platinum' WHEN 3 THEN NULL ELSE 'gold' END AS player_rank,
  CASE o.o_custkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 10 WHEN 3 THEN 50 WHEN 4 THEN 100 WHEN 5 THEN 500 WHEN 6 THEN 1000 ELSE NULL END AS n_games,
  CASE WHEN o.o_custkey % 13 = 0 THEN NULL ELSE CAST(40 + (o.o_custkey * 7) % 35 AS DOUBLE) / 100 END AS win_rate,
  CASE WHEN CAST(floor(o.o_totalprice) AS BIGINT) % 10 < 7 THEN 0 WHEN CAST(floor(o.o_totalprice) AS BIGINT) % 10 < 9 THEN 1 ELSE 2 END AS mulligan_number,
  CAST((o.o_custkey + o.o_orderkey) % 4 AS INT) AS opp_mulligans,
  (o.o_orderstatus <> 'F') AS was_kept, ((o.o_orderkey * 31 + o.o_custkey) % 7 < 4) AS won,
  CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 997 + 1 AS DOUBLE) / 999 AS p_keep,
  CAST((o.o_orderkey * 131) % 991 + 1 AS DOUBLE) / 993 AS p_base,
  CAST((o.o_orderkey * 37 + o.o_custkey) % 499 + 1 AS DOUBLE) / 501 AS arm_keep,
  CAST((o.o_orderkey * 53 + o.o_custkey) % 487 + 1 AS DOUBLE) / 489 AS arm_mull
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

#: One row per hand and slot: 7 cards by formula from the game's id.
HAND_CARDS = """
SELECT o.o_orderkey AS game_id, s.slot AS slot, (o.o_orderkey * 7 + o.o_custkey + s.slot * s.slot * 13) % 170 AS card_id
FROM orders o CROSS JOIN (SELECT 1 AS slot UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) s
"""

#: One row per game and card of its deck, with copies.
DECK_CARDS = """
SELECT l_orderkey AS game_id, l_partkey AS card_id, CAST(sum(l_quantity) AS INT) AS n FROM lineitem GROUP BY l_orderkey, l_partkey
"""

#: The card catalogue.
CARDS = """
SELECT p_partkey AS card_id,
  CASE WHEN p_partkey % 10 = 0 THEN concat(p_name, ' ', CAST(p_partkey AS STRING), ' // ', p_brand) ELSE concat(p_name, ' ', CAST(p_partkey AS STRING)) END AS name,
  p_brand AS set_code, p_type AS kind, (p_partkey % 5 = 0) AS is_land, CAST(p_size % 8 AS INT) AS mana_value,
  CASE p_partkey % 6 WHEN 0 THEN 'W' WHEN 1 THEN 'U' WHEN 2 THEN 'B' WHEN 3 THEN 'R' WHEN 4 THEN 'G' ELSE NULL END AS color,
  (p_partkey % 3 = 1) AS is_creature, (p_partkey % 7 = 2) AS is_removal, (p_partkey % 11 = 3) AS is_trick, (p_partkey % 13 = 4) AS is_ramp,
  CASE p_partkey % 9 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'needs_human' ELSE 'parsed' END AS status,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey + 90000 END AS arena_id
FROM part
"""

#: The catalogue's flat roles, statistics and odds of being castable by turn (``c1`` to ``c4``; parts of a prime, so that no product or mean of them ends on half a decimal).
ROLE_CARDS = """
SELECT k AS card_id, concat('card ', CAST(k AS STRING)) AS name, (k % 5 = 0) AS is_land, (k % 10 = 0) AS is_basic, CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(p_size % 8 AS INT) END AS mana_value,
  (k % 3 = 1 AND k % 5 <> 0) AS is_creature, (k % 11 = 2) AS makes_creatures, (k % 7 = 2) AS destroy_or_exile, (k % 13 = 5) AS burn, (k % 17 = 3) AS bounce, (k % 19 = 7) AS top_library, (k % 23 = 4) AS removal_aura, (k % 29 = 6) AS counterspell,
  (k % 31 = 8) AS punch_fight, (k % 11 = 3) AS trick, (k % 37 = 9) AS pump_aura, (k % 12 = 7) AS equipment, (k % 41 = 1) AS vehicle, (k % 43 = 2) AS saga, (k % 47 = 3) AS class_card, (k % 53 = 4) AS planeswalker,
  (k % 8 = 3) AS draw, (k % 9 = 4) AS alt_mode, (k % 13 = 4) AS mana_ability, (k % 16 = 5) AS fetches_land, (k % 6 = 5) AS is_other,
  CASE WHEN k % 6 = 0 THEN k % 3 + 1 ELSE 0 END AS pip_w, CASE WHEN k % 6 = 1 OR k % 17 = 0 THEN 1 ELSE 0 END AS pip_u, CASE WHEN k % 6 = 2 THEN k % 4 ELSE 0 END AS pip_b, CASE WHEN k % 6 = 3 OR k % 19 = 0 THEN 2 ELSE 0 END AS pip_r, CASE WHEN k % 6 = 4 THEN 1 ELSE 0 END AS pip_g,
  CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(k * 37 % 100 AS DOUBLE) / 499 + 0.45 END AS oh, CASE WHEN k % 31 = 0 THEN NULL ELSE CAST(k * 53 % 100 AS DOUBLE) / 499 + 0.44 END AS gd, CASE WHEN k % 37 = 0 THEN NULL ELSE CAST(k * 71 % 100 AS DOUBLE) / 499 + 0.46 END AS gih,
  CASE WHEN k % 41 = 0 THEN NULL ELSE CAST(k % 50 AS DOUBLE) / 53 END AS weight, CASE WHEN k % 29 = 0 THEN NULL ELSE CAST(k * 37 % 100 AS DOUBLE) / 25 - 2 END AS z_oh, CASE WHEN k % 31 = 0 THEN NULL ELSE CAST(k * 53 % 100 AS DOUBLE) / 25 - 2 END AS z_gd,
  CAST(k * 131 % 601 AS DOUBLE) / 997 AS c1, CAST(k * 131 % 601 + 97 AS DOUBLE) / 997 AS c2, CAST(k * 131 % 601 + 230 AS DOUBLE) / 997 AS c3, CAST(k * 131 % 601 + 310 AS DOUBLE) / 997 AS c4
FROM (SELECT p_partkey AS k, p_size FROM part) q
"""

#: Ratings of a card in a format.
RATINGS = """
SELECT p.p_brand AS expansion, CASE WHEN l.l_suppkey % 2 = 0 THEN 'PremierDraft' ELSE 'TradDraft' END AS event_type,
  concat(p.p_name, ' ', CAST(p.p_partkey AS STRING)) AS name, count(*) AS pick_count,
  CAST(sum(CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS play_rate,
  CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) END AS gih,
  CAST(sum(CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS oh
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY p.p_brand, CASE WHEN l.l_suppkey % 2 = 0 THEN 'PremierDraft' ELSE 'TradDraft' END, p.p_name, p.p_partkey
"""

#: Simulation traces: a user's day is a game, the hour a turn, the event type a card.
TRACES = """
SELECT user_id AS run, event_id AS instance_id, event_type AS name, CAST(event_id % 6 AS INT) AS first_in_hand,
  CAST(event_id % 6 + (event_id * 7) % 3 AS INT) AS first_castable, CAST(event_id % 5 + 1 AS INT) AS turn,
  CAST((event_id * 3) % 7 AS INT) AS lands, CAST((event_id * 5) % 6 AS INT) AS mana, CAST(event_id % 2 AS INT) AS mode_index
FROM events
"""

VIEWS = {"decisions": DECISIONS, "hand_cards": HAND_CARDS, "deck_cards": DECK_CARDS, "cards": CARDS, "role_cards": ROLE_CARDS, "ratings": RATINGS, "traces": TRACES}


class Tables:
    """The tables of a folder and the views over them, as DataFrames: ``t.orders``, ``t.decisions``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        used = {n for n in TABLES if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)}
        for n in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in used})


def with_views(text: str) -> str:
    """SQL over the views: those that ``text`` names go before it as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", text)]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    if not used:
        return text
    own = re.match(r"\s*WITH\s", text)
    return f"WITH {ctes}, {text[own.end() :]}" if own else f"WITH {ctes} {text}"
