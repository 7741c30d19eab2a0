"""Product quantization of vectors, with Orchard's search for the nearest entry (operator 13).

A vector is cut into parts; each part is replaced by the number of the nearest
entry of its position's codebook.  Codebooks come of rounds of k-means in whole
numbers: tasks assign the parts of their rows and send sums and counts of each
entry, so a round moves a few numbers a task however many rows there are, and
its result is the same for any cut of the rows into tasks.

Orchard's search knows, for every entry, the others by rising distance.  From
an entry at distance d, one that is nearer to the query lies within 2d of it:
the entry's list is followed that far, skipping what was looked at before, and
as soon as a better entry turns up the search goes on in that one's list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_path, make_room, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components are kept within this, so that sums of squares and of rows stay whole numbers of 64 bits.
LARGEST = 1 << 26
#: Parts that go through a search together.
AT_ONCE = 1 << 16
#: Labels up to this number are broadcast with their sums; beyond, they are joined by a shuffle.
MOST_BROADCAST = 500_000


class Codebooks:
    """``entries[part, entry, position]``, whole numbers, and each entry's neighbours by rising distance, then index."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(-1)
        gaps[:, np.arange(entries.shape[1]), np.arange(entries.shape[1])] = -1  # an entry heads its own list
        self.lists = np.argsort(gaps, axis=2, kind="stable")[:, :, 1:]
        self.gaps = np.take_along_axis(gaps, self.lists, axis=2)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part of ``vectors[row, part, position]``; of ties the smaller index."""
        rows, parts, _ = vectors.shape
        entry, error = np.zeros((rows, parts), dtype=np.int64), np.zeros((rows, parts), dtype=np.int64)
        step = max(1, AT_ONCE // max(1, parts))
        for at in range(0, rows, step):
            block = vectors[at : at + step]
            best, away = self._search(block.reshape(len(block) * parts, block.shape[2]), np.tile(np.arange(parts), len(block)))
            entry[at : at + step], error[at : at + step] = best.reshape(-1, parts), away.reshape(-1, parts)
        return entry, error

    def _search(self, x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All queries take one step of their lists at a time; those whose list has nothing nearer left drop out."""
        best = np.zeros(len(x), dtype=np.int64)
        away = ((x - self.entries[part, best]) ** 2).sum(-1)
        place = np.zeros(len(x), dtype=np.int64)
        seen = np.zeros((len(x), self.entries.shape[1]), dtype=bool)
        seen[:, 0] = True
        alive = np.arange(len(x) if self.lists.shape[2] else 0)
        while len(alive):
            p, e, k = part[alive], best[alive], place[alive]
            # Beyond twice the distance (four times its square) nothing is nearer; at twice it, something may be as near.
            going = self.gaps[p, e, k] <= 4 * away[alive]
            alive = alive[going]
            p, other = p[going], self.lists[p[going], e[going], k[going]]
            place[alive] += 1
            fresh = ~seen[alive, other]
            row, other, p = alive[fresh], other[fresh], p[fresh]
            seen[row, other] = True
            found = ((x[row] - self.entries[p, other]) ** 2).sum(-1)
            better = (found < away[row]) | (found == away[row]) & (other < best[row])
            row = row[better]
            best[row], away[row], place[row] = other[better], found[better], 0
            alive = alive[place[alive] < self.lists.shape[2]]
        return best, away

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position, in decimals with commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down, within ``LARGEST``; null for vectors that are null or have a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return F.when(embedding.isNotNull() & ~bad, whole)


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Lists of equal lengths as ``[row, part, position]``."""
    flat = np.asarray(column.flatten(), dtype=np.int64)
    return flat.reshape(len(column), parts, len(flat) // len(column) // parts)


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the ``entries`` rows with the smallest ids (null ids last, then by components); None without rows."""
    first = [r[0] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()]
    return np.array(first, dtype=np.int64).reshape(len(first), parts, len(first[0]) // parts).transpose(1, 0, 2) if first else None


def refine(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, every entry to the floor of its parts' mean; unused ones stay."""
    parts, size, width = entries.shape
    shared = rows.sparkSession.sparkContext.broadcast(Codebooks(entries))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * size, width), dtype=np.int64), np.zeros(parts * size, dtype=np.int64)
        for batch in batches:
            if len(batch):
                vectors = _matrix(batch.column(0), parts)
                found, _ = shared.value.nearest(vectors)
                slot = (found + np.arange(parts) * size).reshape(-1)
                counts += np.bincount(slot, minlength=len(counts))
                order = np.argsort(slot, kind="stable")
                used, start = np.unique(slot[order], return_index=True)
                if width:
                    sums[used] += np.add.reduceat(vectors.reshape(len(slot), width)[order], start, axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"slot": used.astype(np.int32), "n": counts[used], "total": pa.array(list(sums[used]), type=pa.list_(pa.int64()))})

    partial = rows.select("whole").mapInArrow(add, "slot int, n long, total array<long>")
    # A task's sums stay below 2 ** 63 for 2 ** 37 rows; added up they are decimals, so that no table is too large.
    totals = [F.sum(F.get("total", F.lit(k)).cast("decimal(20,0)")).alias(f"t{k}") for k in range(width)]
    after = entries.copy()
    for r in partial.groupBy("slot").agg(F.sum("n").alias("n"), *totals).collect():  # parts x entries rows at most
        after[r.slot // size, r.slot % size] = [int(r[f"t{k}"]) // r.n for k in range(width)]
    return after


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` with ``code`` (an index of two hexadecimal digits for each part) and ``error``, the squared distances added up over the parts."""
    parts = books.entries.shape[0]
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            if not len(column):
                yield pa.array([], type=pa.struct([("code", pa.string()), ("error", pa.int64())]))
                continue
            found, away = shared.value.nearest(_matrix(column, parts))
            codes = [bytes(x).hex() for x in found.astype(np.uint8)]
            yield pa.StructArray.from_arrays([pa.array(codes, type=pa.string()), pa.array(away.sum(axis=1))], names=["code", "error"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, "code string, error long")
    return rows.withColumn("found", found("whole")).select(*rows.columns, "found.code", "found.error")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """``vectors`` with ``code``, ``error``, ``label_error`` and ``codebooks_sha256``; without ``vector_col``.

    Rows whose vector is null, or has a null or non-finite component, are
    dropped.  Components count as floor(``scale`` * x), beyond ``LARGEST`` as
    that.  The codebook of each part position starts as that part of the
    ``entries`` rows with the smallest ids (null ids last, ties by components)
    and goes through ``rounds`` rounds; a table of fewer rows has fewer
    entries.  Of entries as near as each other the first is taken.
    ``label_error`` adds ``error`` up over rows of equal labels, null being
    one (``label_col`` None: no such column).  Rows that repeat stay and count
    each.  Vectors whose length differs from the first row's, or isn't a
    multiple of ``parts``, are an error.  At most 256 entries.  An empty table
    gives an empty one.  Other columns go on; one with a new name goes on as
    ``<name>_in``.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have 1 to 256 entries")
    spark = vectors.sparkSession
    names = ["code", "error", *(["label_error"] if label_col else []), "codebooks_sha256"]
    own = make_room(vectors.withColumn("decklake whole", scaled(F.col(vector_col), scale)).drop(vector_col).filter(F.col("decklake whole").isNotNull()), *names)
    kept = [c for c in own.columns if c != "decklake whole"]
    rows, path = written(own, "whole")
    small = rows.select(F.col(id_col).alias("vec_id"), F.col("decklake whole").alias("whole"))
    books = first_codebooks(small, parts, entries)
    if books is None:
        none = {"code": F.lit(""), "error": F.lit(0).cast("long"), "label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")}
        return rows.select(*kept, *(none[n].alias(n) for n in names))
    width = books.shape[0] * books.shape[2]
    if not rows.filter(F.size("decklake whole") != width).isEmpty():
        raise ValueError(f"vectors of other lengths than {width}")
    for _ in range(rounds):
        books = refine(small, books)
    final = Codebooks(books)
    coded, _ = written(encode(rows.withColumnRenamed("decklake whole", "whole"), final).drop("whole"), "codes")
    drop_path(spark, path)
    out = coded
    if label_col:
        sums = coded.groupBy(F.col(label_col).alias("own label")).agg(F.sum("error").alias("label_error"))
        sums = F.broadcast(sums) if coded.agg(F.approx_count_distinct(label_col)).first()[0] <= MOST_BROADCAST else sums
        out = coded.join(sums, F.col(label_col).eqNullSafe(F.col("own label"))).drop("own label")
    return out.withColumn("codebooks_sha256", F.lit(final.digest())).select(*kept, *names)


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE, code_col: str = "code", result_col: str = "vector") -> DataFrame:
    """``codes`` with the vector that each code stands for, array<double>."""
    shared = codes.sparkSession.sparkContext.broadcast(books / scale)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            table = shared.value
            found = np.frombuffer(b"".join(bytes.fromhex(c) for c in column.to_pylist()), dtype=np.uint8).reshape(len(column), len(table))
            yield pa.array([row.reshape(-1) for row in table[np.arange(len(table)), found]], type=pa.list_(pa.float64()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return codes.withColumn(result_col, F.arrow_udf(run, "array<double>")(code_col))
