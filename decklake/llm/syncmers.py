"""Document fingerprints from closed syncmers (operator 10), in DataFrame functions only.

A text is a sequence of pieces: words cut every ``PIECE`` code points from the
word's start.  Of ``k`` neighbouring pieces the inner runs of ``s`` pieces are
hashed; the k-mer is a closed syncmer if the smallest hash is that of its
first or last inner run.  Whether a k-mer is chosen depends on the k-mer
alone, so an edit changes no anchor that doesn't overlap it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PIECE = r"[^\x20\x09-\x0D]{1,4}"
#: Pieces of a k-mer, and pieces of an inner run.
K, S = 4, 2
#: A fingerprint holds so many anchors at least, if there are so many, and one of so many of a text's.
SKETCH, SHARE = 64, 8
#: Rows of a bucket of the order by id, about, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 1500, 65_536
FIRST = -(1 << 63)


def piece_hashes(text: Column, pads: int = K - 1) -> Column:
    """Hashes of the pieces after ``pads`` fixed ones, so that short texts and beginnings have anchors."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p))
    return F.concat(F.array(*[F.lit(j).cast("bigint") for j in range(pads)]), pieces)


def inner_hashes(hashes: Column, s: int = S) -> Column:
    """Hashes of the runs of ``s`` pieces; of shorter texts, of all pieces."""
    runs = F.sequence(F.lit(0), F.greatest(F.size(hashes) - s, F.lit(0)))
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(runs, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(s)])))


def anchor_places(inner: Column, k: int = K, s: int = S) -> Column:
    """Places (from 0) of the closed syncmers; a text shorter than a k-mer has one at 0 if it has a piece."""
    last = k - s
    starts = F.sequence(F.lit(0), F.greatest(F.size(inner) - 1 - last, F.lit(0)))
    middle = [F.get(inner, F.lit(0))] if last < 2 else None

    def closed(i: Column) -> Column:
        edge = F.least(F.get(inner, i), F.get(inner, i + last))
        between = [F.get(inner, i + j) for j in range(1, last)]
        return F.coalesce(edge <= (F.least(*between) if len(between) > 1 else between[0]), F.lit(True)) if middle is None else F.lit(True)

    return F.when(F.size(inner) == 0, F.array().cast("array<int>")).otherwise(F.filter(starts, closed))


def anchor_hashes(inner: Column, places: Column, k: int = K, s: int = S) -> Column:
    """32-bit hashes of the k-mers at ``places``."""
    steps = sorted({*range(0, k - s + 1, s), k - s})
    return F.transform(places, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(inner, i + j) for j in steps]), 32))


def with_anchors(docs: DataFrame, text_col: str, inner_col: str, places_col: str, k: int = K, s: int = S) -> DataFrame:
    """``docs`` with the inner runs' hashes and the places of the closed syncmers; null counts as empty."""
    docs = docs.withColumn(inner_col, piece_hashes(F.coalesce(F.col(text_col), F.lit("")), k - 1))
    docs = docs.withColumn(inner_col, F.when(F.size(inner_col) >= k, F.col(inner_col)).otherwise(F.array().cast("array<bigint>")))
    docs = docs.withColumn(inner_col, inner_hashes(F.col(inner_col), s))
    return docs.withColumn(places_col, anchor_places(F.col(inner_col), k, s))


def with_sketch(docs: DataFrame, text_col: str, sketch_col: str, k: int = K, s: int = S, keep: int = SKETCH, share: int = SHARE) -> DataFrame:
    """``docs`` with the smallest distinct anchor hashes: one of ``share``, but ``keep`` at least."""
    anchored = with_anchors(docs, text_col, "own_inner", "own_places", k, s)
    hashes = F.array_sort(F.array_distinct(anchor_hashes(F.col("own_inner"), F.col("own_places"), k, s)))
    anchored = anchored.withColumn(sketch_col, hashes).drop("own_inner", "own_places")
    return anchored.withColumn(sketch_col, F.slice(sketch_col, F.lit(1), F.greatest(F.lit(keep), F.ceil(F.size(sketch_col) / share).cast("int"))))


def fingerprint(sketch: Column) -> Column:
    """Eight hex digits for each hash of a sketch."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column, keep: int = SKETCH) -> Column:
    """Share of the smallest hashes of both sketches that both hold, as many as the smaller sketch could; 1 for two empty ones."""
    room = lambda x: F.greatest(F.lit(keep), F.size(x))
    both = F.slice(F.array_sort(F.array_union(a, b)), F.lit(1), F.least(room(a), room(b)))
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def matched_places(left: DataFrame, right: DataFrame, on: str, inner_a: str = "inner", places_a: str = "places") -> DataFrame:
    """Anchors that the texts of two tables with equal ``on`` share, with both places: for positional matching.

    Both tables come from ``with_anchors``.  A long run of equal differences
    ``place_b - place_a`` is a passage in common.
    """
    rows = lambda df, name: df.select(on, F.explode(F.arrays_zip(anchor_hashes(F.col(inner_a), F.col(places_a)).alias("h"), F.col(places_a).alias("p"))).alias("x")).select(on, F.col("x.h").alias("anchor"), F.col("x.p").alias(name))
    return rows(left, "place_a").join(rows(right, "place_b"), [on, "anchor"])


def with_next(docs: DataFrame, id_col: str, order: Column, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` of the following row by descending id, after the last one the first; null ids come last.

    Rows of equal ids go by ``order``, a column of longs; ids are whole numbers above
    -2 ** 62, and null ones stand below, also by ``order``.  The order is cut at ids that exist, so
    a bucket's first row is known before anything is sorted; it also goes, as
    a guard, to the end of the bucket above.  So no bucket needs another one.
    """
    # Falling in the key is rising in the order.
    rows = docs.withColumn("own_key", F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST) + F.shiftrightunsigned(F.bitwise_not(order.bitwiseXOR(F.lit(FIRST))), 2)))
    n = rows.agg(F.count("*")).first()[0]
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    shares = [(i + 1) / buckets for i in range(buckets)]
    cuts = rows.agg(F.percentile_approx("own_key", F.array(*map(F.lit, shares)), max(10_000, 20 * buckets)), F.max("own_key")).first()
    rough = sorted({*(cuts[0] or []), *([cuts[1]] if cuts[1] is not None else [])})

    def below(bounds: list[int]) -> Column:
        """Binary search: the number of bounds below the id."""
        held = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
        steps = [1 << i for i in reversed(range(max(1, len(bounds)).bit_length()))]
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, step: F.when(F.coalesce(F.get(held, lo + step - 1) < F.col("own_key"), F.lit(False)), lo + step).otherwise(lo))

    # Quantiles are worked out in floating point: each bound becomes the largest id that is there.
    bounds = sorted(r[0] for r in rows.groupBy(below(rough).alias("bucket")).agg(F.max("own_key").alias("bound")).select("bound").collect())
    held = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("own_bucket", below(bounds))
    is_bound = F.get(held, F.col("own_bucket")) == F.col("own_key")
    at = lambda bucket, guard: F.struct(bucket.alias("bucket"), F.lit(guard).alias("guard"))
    here, above = at(F.col("own_bucket"), 0), at((F.col("own_bucket") + 1) % max(1, len(bounds)), 1)
    rows = rows.withColumn("own_at", F.explode(F.when(is_bound, F.array(here, above)).otherwise(F.array(here)))).withColumns({"own_bucket": F.col("own_at.bucket"), "own_guard": F.col("own_at.guard")})
    window = Window.partitionBy("own_bucket").orderBy("own_guard", F.col("own_key").desc(), order)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})
    return rows.filter("own_guard = 0").select(*docs.columns, *[f"next_{c}" for c in columns])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the
    first as many (or all) of the next document, by descending id; after the
    last comes the first, so a single document follows itself.  Null texts
    count as empty, with an empty fingerprint; two empty fingerprints are
    alike.  Repeated ids are ordered by a hash of the text; null ids come
    last, by that hash too.  An empty table gives an empty result.  Other columns are dropped.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_sketch(rows, "text", "sketch")
    rows = with_next(rows, "doc_id", F.xxhash64("text"), ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))}).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
