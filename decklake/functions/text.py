"""Text tables: pasted deck lists, rule tags, JSON inside events."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values of the list format: lines that are headings, lines at which the main deck ends, most copies in a line and in all.
HEADINGS = ("deck", "main", "maindeck", "main deck", "commander", "companion")
STOPS = ("sideboard", "maybeboard")
MOST_IN_LINE, MOST_COPIES = 99, 250
LINE = r"^(\d+)[xX]?\s+(.+?)(?:\s+\([A-Za-z0-9]+\).*)?$"


def deck_lines(lists: DataFrame, names: DataFrame, key: str = "list_id", text: str = "text") -> DataFrame:
    """(key, line, card, n, card_id, issue): what pasted lists say, line by line.

    Empty lines and headings are skipped; a stop line ends the list.  Issues:
    ``unreadable``, ``bad_count`` (not 1 to 99), ``too_many`` (beyond 250
    copies in all), ``unknown_card``.  ``names``: (lookup, card_id).
    """
    lines = lists.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r?\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    word = F.rtrim(F.regexp_replace(F.lower("raw"), ":$", ""))
    stop = F.min(F.when(word.isin(*STOPS), F.col("line"))).over(Window.partitionBy(key))
    kept = lines.withColumn("stop", stop).filter((F.col("stop").isNull() | (F.col("line") < F.col("stop"))) & (F.col("raw") != "") & ~word.isin(*HEADINGS))
    count, card = F.regexp_extract("raw", LINE, 1), F.regexp_extract("raw", LINE, 2)
    rows = kept.withColumns({"n": count.try_cast("int"), "card": F.when(card != "", card)})
    good = F.col("card").isNotNull() & F.col("n").between(1, MOST_IN_LINE)
    upto = F.sum(F.when(good, F.col("n")).otherwise(0)).over(Window.partitionBy(key).orderBy("line"))
    rows = rows.withColumn("upto", upto).join(names.select(F.col("lookup").alias("card"), "card_id", F.lit(True).alias("known")), "card", "left")
    issue = F.when(F.col("card").isNull(), "unreadable").when(~good | F.col("n").isNull(), "bad_count").when(F.col("upto") > MOST_COPIES, "too_many").when(F.col("known").isNull(), "unknown_card")
    return rows.select(key, "line", "card", "n", "card_id", issue.alias("issue"))


def tag_chunks(texts: DataFrame, rules: list[tuple[str, str]], key: str, text: str, cut: str = r"[.\n]") -> DataFrame:
    """(key, chunk, tag): each chunk with the tag of the first rule that matches; null where none does.

    The rules become one expression, so that a text is read once.
    """
    chunks = texts.select(key, F.explode(F.split(F.coalesce(text, F.lit("")), cut)).alias("chunk")).withColumn("chunk", F.trim("chunk")).filter("chunk <> ''")
    tag = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        tag = F.when(F.col("chunk").rlike(pattern), name).otherwise(tag)
    return chunks.withColumn("tag", tag)


def role_flags(tagged: DataFrame, key: str, tags: list[str]) -> DataFrame:
    """One row a text: whether any chunk has each tag, and how many have none."""
    return tagged.groupBy(key).agg(*[F.coalesce(F.bool_or(F.col("tag") == t), F.lit(False)).alias(t) for t in tags], F.count_if(F.col("tag").isNull()).alias("untagged"))


#: Keys of the entries of a deck, the first that is there counts; most copies in one list; steps between two looks whether a walk is at its end.
CARD_KEYS, COUNT_KEYS = ("cardId", "id"), ("quantity", "Quantity")
MOST_LISTED = 10_000
STRIDE = 32


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _whole(value: Column) -> Column:
    """A whole number of 64 bits, or a text of one; null for all else, truth values and fractions included."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return F.when(kind.isin("BIGINT", "STRING") & text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))


def _keyed(entry: Column, keys: tuple[str, ...], otherwise: Column) -> Column:
    found = otherwise
    for key in reversed(keys):
        found = F.when(F.map_contains_key(entry, F.lit(key)), _whole(F.element_at(entry, F.lit(key)))).otherwise(found)
    return found


def listed_ids(value: Column, most: int = MOST_LISTED) -> Column:
    """Ids of a list in JSON (variant), one for each copy; null for what is no such list.

    A list holds ids, or objects with an id (``cardId``, else ``id``) and a
    count of 1 or more (``quantity``, else ``Quantity``, else 1); numbers may
    be texts.  Empty and mixed lists, lists with anything else in them and
    lists of over ``most`` copies are null.
    """

    def read(items: Column) -> Column:
        entries = F.transform(items, lambda i: F.try_variant_get(i, "$", "map<string,variant>"))
        counted = F.transform(entries, lambda e: F.when(e.isNotNull(), F.struct(_keyed(e, CARD_KEYS, F.lit(None).cast("bigint")).alias("id"), _keyed(e, COUNT_KEYS, F.lit(1).cast("bigint")).alias("n"))))
        whole = lambda c: F.forall(c, lambda x: F.coalesce(x.id.isNotNull() & x.n.between(1, most), F.lit(False)))
        copies = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + x.n)
        spread = lambda c: F.when(whole(c), F.when(copies(c) <= most, F.flatten(F.transform(c, lambda x: F.array_repeat(x.id, x.n.cast("int"))))))
        flat = lambda ids: F.when(F.forall(ids, lambda i: i.isNotNull()), ids)
        return F.when(F.size(items).between(1, most), F.coalesce(_let(F.transform(items, _whole), flat), _let(counted, spread)))

    return _let(F.try_variant_get(value, "$", "array<variant>"), read)


def _strict(text: Column) -> Column:
    """The JSON of a text that holds one object or list and no more, else null.

    The parser stops behind the first value, so the text is read as the first
    item of a list whose second is the text's own hash: whatever else the text
    holds behind its first value breaks the list, or moves the hash.
    """
    mark = F.xxhash64(text)
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]"))), "$", "array<variant>")
    first = lambda i: F.when((F.size(i) == 2) & (F.try_variant_get(F.get(i, F.lit(1)), "$", "bigint") == mark), F.get(i, F.lit(0)))
    return F.when(text.rlike(r"^[ \t\r\n]*[{\[]"), _let(items, first))


def nested_lists(text: Column, name: str, most: int = MOST_LISTED) -> Column:
    """Lists (``listed_ids``) under the key ``name`` anywhere in a JSON text, and in JSON texts inside it, at any depth.

    An array of arrays of long, outer before inner, fields of an object by
    name, items of a list in order.  Null, empty and broken texts give none;
    so do texts with a key twice in one object, or over 1,000 levels deep,
    which the parser takes for broken.

    The walk is a fold over levels, within the row: all values of a level are
    opened at once.  A level needs a bracket of its own, or the backslash of an
    escaped one, so their number bounds the levels; a walk that is at
    its end leaves out the rest, ``STRIDE`` steps at a time.
    """
    place, kept = "array<struct<path:array<int>,value:variant>>", "array<struct<path:array<int>,ids:array<bigint>>>"

    def opened(at: Column) -> Column:
        return F.struct(at.path.alias("path"), at.value.alias("value"), F.try_variant_get(at.value, "$", "map<string,variant>").alias("fields"), F.try_variant_get(at.value, "$", "array<variant>").alias("items"))

    def inside(o: Column) -> Column:
        text_in = _let(F.try_variant_get(o.value, "$", "string"), lambda t: F.when(t.isNotNull(), F.array(_strict(t))))
        values = F.when(o.fields.isNotNull(), F.map_values(o.fields)).when(o["items"].isNotNull(), o["items"]).otherwise(text_in)
        children = F.transform(values, lambda v, i: F.struct(F.concat(o.path, F.array(i)).alias("path"), v.alias("value")))
        return F.coalesce(F.filter(children, lambda c: c.value.isNotNull()), F.array().cast(place))

    def step(state: Column) -> Column:
        def go(level: Column) -> Column:
            lists = F.transform(F.filter(level, lambda o: F.map_contains_key(o.fields, F.lit(name))), lambda o: F.struct(o.path.alias("path"), listed_ids(F.element_at(o.fields, F.lit(name)), most).alias("ids")))
            return F.struct(F.flatten(F.transform(level, inside)).alias("todo"), F.concat(state.found, F.filter(lists, lambda f: f.ids.isNotNull())).alias("found"))

        return F.when(F.size(state.todo) == 0, state).otherwise(_let(F.transform(state.todo, opened), go))

    def stride(state: Column) -> Column:
        return F.when(F.size(state.todo) == 0, state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STRIDE)), state, lambda s, _: step(s)))

    def walk(text: Column) -> Column:
        whole = F.filter(F.array(_strict(text)), lambda v: v.isNotNull())
        start = F.struct(F.transform(whole, lambda v: F.struct(F.array().cast("array<int>").alias("path"), v.alias("value"))).cast(place).alias("todo"), F.array().cast(kept).alias("found"))
        brackets = F.length(text) - F.length(F.translate(text, "{[\\", ""))
        done = F.aggregate(F.sequence(F.lit(0), F.floor(2 * brackets / STRIDE).cast("int")), start, lambda s, _: stride(s), lambda s: s.found)
        return F.transform(F.array_sort(done), lambda f: f.ids)

    return _let(F.coalesce(text, F.lit("")), walk)


WHOLE = re.compile(r"[ \t\r\n\f\v]*[+-]?[0-9]+[ \t\r\n\f\v]*")


def _once(pairs: list) -> dict:
    fields = dict(pairs)
    if len(fields) < len(pairs):
        raise ValueError("a key twice")
    return fields


def _refused(constant: str):
    raise ValueError(constant)


def _number(value) -> int | None:
    if type(value) in (int, str) and WHOLE.fullmatch(str(value)) and -(2**63) <= int(value) < 2**63:
        return int(value)
    return None


def _listed(value, most: int) -> list[int] | None:
    if not isinstance(value, list) or not 1 <= len(value) <= most:
        return None
    if not any(isinstance(v, dict) for v in value):
        pairs = [(_number(v), 1) for v in value]
    elif all(isinstance(v, dict) for v in value):
        first = lambda v, keys, otherwise: _number(next((v[k] for k in keys if k in v), otherwise))
        pairs = [(first(v, CARD_KEYS, None), first(v, COUNT_KEYS, 1)) for v in value]
    else:
        return None
    if any(i is None or n is None or n < 1 for i, n in pairs) or sum(n for _, n in pairs) > most:
        return None
    return [i for i, n in pairs for _ in range(n)]


def listed_in(name: str, most: int = MOST_LISTED):
    """Function with the results of ``nested_lists`` of one text."""

    def search(text: str | None) -> list[list[int]]:
        found, todo = [], [text]
        while todo:
            value = todo.pop()
            if isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("{", "["):
                try:
                    value = json.loads(value, object_pairs_hook=_once, parse_constant=_refused)
                except (ValueError, RecursionError):
                    continue
            if isinstance(value, dict):
                ids = _listed(value.get(name), most)
                found += [] if ids is None else [ids]
                value = [value[k] for k in sorted(value)]
            if isinstance(value, list):
                todo += reversed(value)
        return found

    return search


def search_json(name: str, most: int = MOST_LISTED):
    """Column function with the results of ``nested_lists``, in batches of Arrow: about a third of its time, at the price of a Python worker."""
    search = listed_in(name, most)
    return F.pandas_udf(lambda texts: pd.Series([search(t) for t in texts]), "array<array<bigint>>")
