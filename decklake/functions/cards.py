"""Predicates and text functions on cards and decks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.StringType())
def fold_name(names: pd.Series) -> pd.Series:
    """NFKD without combining marks; for the card table, which is small beside the rows that use it."""
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def front_face(name: Column) -> Column:
    return F.substring_index(name, " // ", 1)


def split_hand(hand: Column) -> Column:
    """``A|B|...`` to an array; an empty text to an empty one."""
    return F.filter(F.split(hand, r"\|"), lambda x: x != "")


def decode_deck(deck: Column) -> Column:
    """``Name xN | ...`` to an array of (card, n); n is null where an entry is malformed."""
    entries = F.filter(F.split(deck, r" \| "), lambda x: x != "")
    pattern = r"^(.+) x(\d+)$"
    return F.transform(entries, lambda e: F.struct(F.regexp_extract(e, pattern, 1).alias("card"), F.when(e.rlike(pattern), F.regexp_extract(e, pattern, 2).cast("int")).alias("n")))


def encode_deck(cards: Column) -> Column:
    """An array of (card, n) to sorted ``Name xN`` entries joined by `` | ``."""
    return F.array_join(F.array_sort(F.transform(cards, lambda c: F.concat(c["card"], F.lit(" x"), c["n"].cast("string")))), " | ")


def deck_copies(decoded: Column) -> Column:
    """Each card as often as it is in the deck."""
    return F.flatten(F.transform(decoded, lambda c: F.array_repeat(c["card"], c["n"])))


def clipped(text: Column, width: int = 100) -> Column:
    """White space collapsed, and longer texts cut to ``width`` with an ellipsis at the end."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def deck_signature(cards: Column) -> Column:
    """The same for any order: SHA-256 of the sorted entries."""
    return F.sha2(F.array_join(F.array_sort(cards), "|").cast("binary"), 256)


# Colours of mana, and what makes a symbol generic, variable or colourless.
COLORS = ("W", "U", "B", "R", "G")


def decode_cost(cost: Column) -> Column:
    """(cmc, pips, color_pips, has_x, has_hybrid, bad) of a mana cost such as ``{2}{W}{U/B}``.

    Hybrid symbols count for the cost, with 2 for ``{2/W}``, but not as pips
    of a colour; Phyrexian ones count as their colour.  ``bad`` marks unknown
    symbols and text outside braces; all else is then null.
    """
    symbols = F.regexp_extract_all(cost, F.lit(r"\{([^{}]+)\}"), F.lit(1))
    outside = F.length(F.regexp_replace(cost, r"\{[^{}]+\}", "")) > 0
    one = r"^[WUBRGCS]$"
    phyrexian, hybrid, twobrid = r"^[WUBRG]/P$", r"^[WUBRG]/[WUBRG](/P)?$", r"^2/[WUBRG]$"
    known = lambda s: s.rlike(r"^\d+$") | s.rlike(one) | s.rlike(phyrexian) | s.rlike(hybrid) | s.rlike(twobrid) | s.isin("X", "Y", "Z")
    worth = lambda s: F.when(s.rlike(r"^\d+$"), s.try_cast("int")).when(s.isin("X", "Y", "Z"), 0).when(s.rlike(twobrid), 2).otherwise(1)
    bad = outside | F.exists(symbols, lambda s: ~known(s))
    colored = F.filter(symbols, lambda s: s.rlike(r"^[WUBRG]$") | s.rlike(phyrexian))
    of = lambda color: F.size(F.filter(colored, lambda s: F.substring(s, 1, 1) == color))
    pips = F.map_from_entries(F.array(*[F.struct(F.lit(color), of(color)) for color in COLORS]))
    value = F.struct(
        F.aggregate(symbols, F.lit(0), lambda n, s: n + worth(s)).alias("cmc"), F.size(symbols).alias("symbols"), F.map_filter(pips, lambda _, n: n > 0).alias("color_pips"),
        F.exists(symbols, lambda s: s.isin("X", "Y", "Z")).alias("has_x"), F.exists(symbols, lambda s: s.rlike(hybrid) | s.rlike(twobrid)).alias("has_hybrid"), F.lit(False).alias("bad"),
    )
    empty = F.struct(F.lit(None).cast("int").alias("cmc"), F.lit(None).cast("int").alias("symbols"), F.lit(None).cast("map<string,int>").alias("color_pips"), F.lit(None).cast("boolean").alias("has_x"), F.lit(None).cast("boolean").alias("has_hybrid"), F.lit(True).alias("bad"))
    return F.when(cost.isNull(), F.lit(None)).when(bad, empty).otherwise(value)


# Fixed values of the game: words of a type line that come before the types.
SUPERTYPES = ("Basic", "Legendary", "Snow", "World", "Ongoing", "Token")


def type_line(line: Column) -> Column:
    """(supertypes, types, subtypes) of ``Legendary Creature — Elf Druid``; of the front face only."""
    face = F.split(line, " // ")[0]
    halves = F.split(face, r"\s+[—-]\s+")
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    left = words(halves[0])
    listed = F.array(*map(F.lit, SUPERTYPES))
    right = F.when(F.size(halves) > 1, words(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.struct(F.array_intersect(left, listed).alias("supertypes"), F.array_except(left, listed).alias("types"), right.alias("subtypes"))


def double_pip(pips: Column) -> Column:
    return F.exists(F.map_values(pips), lambda n: n >= 2)


def active_flags(flags: dict[str, Column]) -> Column:
    """Names of the flags that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in flags.items()]))


def kinds_in_order(modes: Column) -> Column:
    """Distinct kinds of modes, in the order met."""
    return F.array_distinct(F.transform(modes, lambda m: m["kind"]))
