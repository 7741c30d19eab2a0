"""How filters interact, by the potential of the removal game (operator 12).

Players are filters, the worth of a coalition is the number of documents that
at least one of its filters fails.  One pass counts documents by the set of
filters that they fail: 32 numbers a part of the table for five filters, and as
many for good and for toxic ones.  Worths of all coalitions follow by sums over
sets.  The potential of Hart and Mas-Colell, P(S) = (v(S) + sum of P(S - i)) /
|S|, is worked out recursively over the coalitions; a filter's Shapley value is
the grand potential minus the potential without it.  What a step of an order
removes is a difference of two coalitions' worths.

Everything is DataFrame functions.  The only shuffles carry ids, digests and
counts, never texts.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACE


def standard_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text; words are runs without the white space of ``common.SPACE``, case-sensitive."""
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    n, distinct, chars = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long"), F.length(text).cast("long")
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 200, "B": distinct * 100 < n * 50, "C": capitals * 100 > chars * 3, "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, filters: dict[str, Column], id_col: str, text_col: str, part: Column) -> DataFrame:
    """(id, part, mask, digest): the bits of the filters that each document fails, and its text's digest."""
    bits = sum((F.when(F.coalesce(fails, F.lit(False)), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), part.alias("part"), bits.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _marks(labels: DataFrame) -> DataFrame:
    """(id, good, toxic), one row for each labelled id: 1 if any of its rows says so."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


COUNTS = ("n", "good", "toxic")


def coalition_counts(failed: DataFrame, labels: DataFrame, copies_bit: int | None) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail.

    ``copies_bit`` is the filter that fails every text that a smaller id has
    as well; None leaves it out.  Of a text, rows go by (digest, mask, part)
    after each task has added up its own, so that copies, however many, are
    one row a part; the row with the smallest id is told apart by its count.
    """
    known = failed.filter("id is not null").join(_marks(labels), "id", "left").fillna(0, ["good", "toxic"])
    none = [F.lit(0).alias(c) for c in ("good", "toxic")]
    nameless = failed.filter("id is null").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", *none)  # no id is smaller or larger
    if copies_bit is None:
        merged = known.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in COUNTS[1:]))
    else:
        # Partitioned by id already: rows that repeat an id are one here.
        by_id = known.groupBy("id", "digest", "mask", "part").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in COUNTS[1:]))
        sums = [F.sum(c).alias(c) for c in COUNTS]
        texts = by_id.groupBy("digest", "mask", "part").agg(*sums, F.min(F.struct("id", *COUNTS)).alias("first"))
        least = F.min("first.id").over(Window.partitionBy("digest"))  # a text has a row a part
        first = lambda c: F.when(F.col("first.id") == F.col("least"), F.col(f"first.{c}")).otherwise(F.lit(0))
        split = texts.withColumn("least", least).select("part", F.explode(F.array(
            F.struct("mask", *(first(c).alias(c) for c in COUNTS)),
            F.struct(F.col("mask").bitwiseOR(F.lit(1 << copies_bit)).alias("mask"), *((F.col(c) - first(c)).alias(c) for c in COUNTS)),
        )).alias("x")).select("part", "x.*")
        merged = split.filter("n > 0").groupBy("part", "mask").agg(*sums)
    return merged.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def worths(counts: DataFrame, filters: int) -> DataFrame:
    """(part, n, worth, good, toxic): documents, and for each coalition, by its bits, the number of documents that it removes."""
    coalitions = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    each = F.explode(F.transform(coalitions, lambda s: F.struct(s.alias("s"), s.bitwiseAND(F.col("mask")).cast("boolean").cast("long").alias("hit")))).alias("x")
    rows = counts.select("part", *COUNTS, each).select("part", "x.s", F.col("n").alias("all"), *((F.col(c) * F.col("x.hit")).alias(c) for c in COUNTS))
    sums = rows.groupBy("part", "s").agg(F.sum("all").alias("all"), *(F.sum(c).alias(c) for c in COUNTS))
    listed = F.array_sort(F.collect_list(F.struct("s", *COUNTS)))  # 2 ** filters entries
    return sums.groupBy("part").agg(F.max("all").alias("n"), listed.alias("x")).select("part", "n", F.col("x.n").alias("worth"), F.col("x.good").alias("good"), F.col("x.toxic").alias("toxic"))


def potential(worth: Column, filters: int, scale: int) -> Column:
    """``scale`` times the potential of every coalition, from the worths by coalition; exact, as ``filters``! times a potential is a whole number."""
    bits = F.array(*[F.lit(1 << k) for k in range(filters)])

    def step(done: Column, s: Column) -> Column:
        own = F.filter(bits, lambda b: s.bitwiseAND(b) != 0)
        without = F.aggregate(own, F.lit(0).cast("long"), lambda total, b: total + F.get(done, s - b))
        # The cast of a quotient of whole numbers that divide is exact beyond what a double holds only by div.
        return F.concat(done, F.array(F.call_function("div", F.get(worth, s) * F.lit(scale) + without, F.size(own))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), step)


def _orders(names: list[str]) -> tuple[str, str]:
    """All orders with their steps, and the coalition before each, as JSON of a fixed size, and its type."""
    bit = {name: 1 << k for k, name in enumerate(names)}
    steps = [{"filter_order": "".join(o), "step": k + 1, "bit": bit[o[k]], "before": sum(bit[x] for x in o[:k])} for o in permutations(names) for k in range(len(names))]
    return json.dumps(steps), "array<struct<filter_order:string,step:int,bit:int,before:int>>"


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part: Column | None = None) -> DataFrame:
    """One row for each part, order of the filters and step of the order.

    ``filters``: failure conditions by one-letter name, over ``docs`` (default:
    ``standard_filters``; a null condition doesn't fail); ``copies`` names the
    filter that fails every text which a smaller id has too, anywhere in the
    table (texts are told by SHA-256).  ``part``: null is the empty string
    (default: the column ``lang``).  ``labels``: doc_id, quality, toxic.
    Columns: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, and shapley, the filter's Shapley
    value times the number of orders.

    Null texts are empty.  Rows that repeat an id are counted each and don't
    fail for one another; rows without an id have no label, are no one's copy
    and have none.  An id with several labels is good, or toxic, if any says
    so.  An empty table gives an empty result.  Columns of other names play no
    part.
    """
    filters = standard_filters(F.coalesce(F.col(text_col), F.lit(""))) if filters is None else filters
    names = [*filters, *([copies] if copies else [])]
    part = F.coalesce(F.col("lang") if part is None else part, F.lit(""))
    failed = failures(docs, filters, id_col, text_col, part)
    counts = coalition_counts(failed, labels, len(filters) if copies else None)
    games = worths(counts, len(names)).withColumn("potential", potential(F.col("worth"), len(names), factorial(len(names))))
    grand = F.lit((1 << len(names)) - 1)
    steps, kind = _orders(names)
    rows = games.select("*", F.explode(F.from_json(F.lit(steps), kind)).alias("x")).select("*", "x.*")
    after = F.col("before") + F.col("bit")
    lost = lambda c: F.get(c, after) - F.get(c, F.col("before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - F.get("worth", after)).alias("kept"), lost("worth").alias("removed"), (F.get("worth", F.col("bit")) - lost("worth")).alias("redundant"),
        (F.get("worth", grand) - F.get("worth", grand - F.col("bit"))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        (F.get("potential", grand) - F.get("potential", grand - F.col("bit"))).alias("shapley"),
    )
