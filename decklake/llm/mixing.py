"""Mixing sources to target weights by a time-varying curriculum (operator 1).

Each source has a weight schedule over the training's course from 0 to 1,
linear between knots.  Its integral gives the source's share of the words; the
inverse of its running integral gives the position at which the source has
used up any given number of its words, and so the position of each document.
Documents are range-sorted by position.

No source is one group: documents go to buckets by a hash, the buckets' sums
are added up over each source, and only the running sum within a bucket needs
a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, make_room, written

#: Rows of a bucket, about.
BUCKET_ROWS = 2000
#: The table of sources, one row each, is broadcast up to so many rows.
MOST_BROADCAST = 10_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame, source_col: str, size_col: str) -> DataFrame:
    """(source, source_size, source_rows); null is a source of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"), F.count("*").alias("source_rows"))


def ranked(sizes: DataFrame, cycle: list[float], ramp: float = 0.5) -> DataFrame:
    """``sizes`` with weights from ``cycle`` by the sources' code points (null last), as schedules.

    A schedule is an array of knots (at, weight).  Odd sources fade from 1 +
    ``ramp`` to 1 - ``ramp`` times their weight, even ones rise, so that each
    integral is the weight itself.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (rank % len(cycle) + 1).cast("int"))
    slope = F.when(rank % 2 == 0, F.lit(-ramp)).otherwise(F.lit(ramp))
    knot = lambda at, w: F.struct(F.lit(at).alias("at"), w.alias("weight"))
    return sizes.withColumn("schedule", F.array(knot(0.0, weight * (1 - slope)), knot(1.0, weight * (1 + slope))))


def pieces(schedule: Column) -> Column:
    """The schedule's pieces between knots (start, end, from, to, before): ``before`` is the integral up to the start."""
    following = F.slice(schedule, F.lit(2), F.greatest(F.size(schedule) - 1, F.lit(0)))
    piece = lambda a, b: F.struct(a.at.alias("start"), b.at.alias("end"), a.weight.alias("from"), b.weight.alias("to"))
    pairs = F.filter(F.zip_with(schedule, following, piece), lambda p: p.end.isNotNull())
    area = lambda p: (p["from"] + p.to) / 2 * (p.end - p.start)
    add = lambda done, p: F.array_append(done, F.struct(p.start.alias("start"), p.end.alias("end"), p["from"].alias("from"), p.to.alias("to"), F.coalesce(F.element_at(done, -1)["before"] + area(F.element_at(done, -1)), F.lit(0.0)).alias("before")))
    empty = F.array().cast("array<struct<start:double,end:double,from:double,to:double,before:double>>")
    return F.aggregate(pairs, empty, lambda done, p: F.when(F.size(done) > 0, add(done, p)).otherwise(F.array(F.struct(p.start.alias("start"), p.end.alias("end"), p["from"].alias("from"), p.to.alias("to"), F.lit(0.0).alias("before")))))


def integral(parts: Column) -> Column:
    """Of the whole schedule, from its ``pieces``."""
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + (p["from"] + p.to) / 2 * (p.end - p.start))


def inverse(parts: Column, area: Column) -> Column:
    """The point up to which the schedule's integral is ``area``: a piece is found, then a quadratic solved."""
    piece = F.element_at(F.filter(parts, lambda p: (p.before <= area) | (p.before == 0)), -1)
    left = F.greatest(area - piece.before, F.lit(0.0))
    grade = (piece.to - piece["from"]) / (piece.end - piece.start)
    # The root that stays finite as the grade goes to 0.
    root = 2 * left / (piece["from"] + F.sqrt(F.greatest(piece["from"] * piece["from"] + 2 * grade * left, F.lit(0.0))))
    return F.least(piece.end, piece.start + F.coalesce(root, F.lit(0.0)))


def targets(sources: DataFrame, max_repeats: float, budget: Column | None = None) -> DataFrame:
    """``sources`` with ``target``: words by weight, at most ``max_repeats`` times the source, the excess reshared.

    The final state of resharing is a level L with target = min(cap, L x
    weight).  Sources in order of cap / weight are capped as long as the level
    that the others then get is above; the row that is first not to be capped
    gives L.  ``sources`` has one row a source.
    """
    cap, weight = F.col("source_size") * F.lit(float(max_repeats)), F.col("weight")
    everyone = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = sources.withColumn("ratio", F.when(weight > 0, cap / weight).otherwise(F.lit(float("inf"))))
    total = F.sum("source_size").over(whole).cast("double") if budget is None else budget
    rows = rows.withColumns({"capped": F.coalesce(F.sum(cap).over(everyone), F.lit(0.0)), "heavier": F.coalesce(F.sum(weight).over(everyone), F.lit(0.0)), "words": total, "weights": F.sum(weight).over(whole)})
    level = F.when(F.col("weights") - F.col("heavier") > 1e-12, (F.col("words") - F.col("capped")) / (F.col("weights") - F.col("heavier")))
    rows = rows.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return rows.withColumn("target", F.when(found.isNull(), cap).otherwise(F.least(cap, F.greatest(found, F.lit(0.0)) * weight))).drop("ratio", "capped", "heavier", "words", "weights", "level")


def mix(docs: DataFrame, schedules, size_col: str = "size", source_col: str = "source", id_col: str = "doc_id", max_repeats: int = 3, seed: int = 0, in_order: bool = True) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``taken``, ``copies`` and ``positions``, range-sorted by first position.

    ``schedules`` takes the table (source, source_size, source_rows), null a
    source like any other, and adds ``schedule``: knots (at, weight) from 0 to
    1.  A source's words are laid out in an order by a seeded hash, again and
    again up to ``max_repeats`` times, and cut at the target: ``taken`` counts
    a document's words before the cut, over all repeats; ``copies`` counts the
    repeats of which more than half lies before it; ``positions`` are where
    the repeats begin.  Documents without words take nothing and stand at the
    end of their source's first pass.

    A null size is 0.  Null and repeated ids are rows like any other, ordered
    by hash, id, size and a hash of the other columns.  An empty table gives an
    empty result.  Columns of ``docs`` with the name of a new one go on as
    ``<name>_in``.
    Reruns agree: nothing depends on partitions.  ``in_order`` false leaves out
    the range sort, for ``materialise`` sorts anyway.
    """
    docs = make_room(docs, "source_size", "target", "taken", "copies", "positions", "mix_source", "mix_number", "mix_bucket", "mix_at", "mix_order", "mix_first", "source_rows", "weight", "parts", "bucket_start")
    docs = docs.withColumn(size_col, F.coalesce(F.col(size_col), F.lit(0)).cast("long"))
    size = F.col(size_col)
    sources = schedules(source_sizes(docs, source_col, size_col)).withColumn("parts", pieces(F.col("schedule"))).withColumn("weight", integral(F.col("parts")))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("mix_number")
    sources, _ = written(targets(sources, max_repeats).select(number, F.col("source").alias("mix_source"), "source_size", "source_rows", "target", "weight", "parts"), "sources")
    few = sources.count() <= MOST_BROADCAST
    # 60 bits of a hash that SQL engines share.
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col), size)), 1, 15), 16, 10).cast("long")
    rows = docs.withColumn("mix_order", order).join(F.broadcast(sources) if few else sources, F.col(source_col).eqNullSafe(F.col("mix_source")))
    buckets = F.ceil(F.col("source_rows") / BUCKET_ROWS)
    rows = rows.withColumn("mix_bucket", F.pmod(F.col("mix_order"), buckets))
    sums = rows.groupBy("mix_number", "mix_bucket").agg(F.sum(size_col).alias("bucket_size"))
    before = Window.partitionBy("mix_number").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("mix_number", "mix_bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    known = {size_col, id_col, source_col}
    others = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns if c not in known], F.lit(0))
    within = Window.partitionBy("mix_number", "mix_bucket").orderBy("mix_order", id_col, size_col, *([others] if set(docs.columns) - known else [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mix_at", F.coalesce(F.sum(size_col).over(within), F.lit(0)))
    rows = rows.join(starts, ["mix_number", "mix_bucket"]).withColumn("mix_at", F.col("mix_at") + F.col("bucket_start"))
    passes = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    start = lambda k: F.col("mix_at") + k * F.col("source_size")
    cut = F.round("target").cast("long")
    taken = F.aggregate(passes, F.lit(0).cast("long"), lambda s, k: s + F.greatest(F.lit(0).cast("long"), F.least(start(k) + size, cut) - start(k)))
    copies = F.size(F.filter(passes, lambda k: (size > 0) & (start(k) + size / 2 < F.col("target"))))
    where = lambda k: inverse(F.col("parts"), start(k) / F.col("target") * F.col("weight"))
    rows = rows.withColumns({"taken": taken, "copies": copies})
    positions = F.when((F.col("target") > 0) & (F.col("taken") > 0), F.transform(F.filter(passes, lambda k: start(k) < cut), where)).otherwise(F.array(F.lit(1.0)))
    rows = rows.withColumn("positions", positions).withColumn("mix_first", F.element_at("positions", 1))
    if in_order:
        rows = rows.repartitionByRange(F.col("mix_first"), F.col("mix_order")).sortWithinPartitions("mix_first", "mix_order")
    return rows.select(*docs.columns, "source_size", "target", "taken", "copies", "positions")


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each copy that the mix takes, with ``columns``, range-sorted by the copies' own positions.

    The copies are a document's first passes, each at the position at which it begins.
    """
    taken = F.slice("positions", F.lit(1), F.col("copies"))
    copies = mixed.filter("copies > 0").select(F.struct(*columns).alias("own"), F.explode(taken).alias("at"), F.xxhash64(*columns).alias("tie"))
    return copies.repartitionByRange(F.col("at"), F.col("tie")).sortWithinPartitions("at", "tie").select("own.*")
