"""Exact deduplication by Grace hashing (operator 8).

Every task partitions its records into spill files by digits of the content's
digest, again and again, until a bucket fits in memory; a bucket then goes
through an open-addressing table that compares complete contents.  This runs
twice: over each input partition, so that copies met by one task cross the
shuffle as one record, and over each shuffled partition of those records.  A
group that holds a third of all rows is thus at most one record a map task.
Documents then find their group by the digest alone, in a join whose hot keys
adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import make_room, written

DELETED = b" \t\n\x0b\x0c\r"
#: A group of equal contents: digest, content, code points and id of the row that stays, rows.
GROUP = "digest binary, content binary, best_chars long, best_id long, rows long"
NO_ID = np.iinfo(np.int64).max


class OpenTable:
    """Linear probing over numpy slots; a slot's group is equal only if the complete content is."""

    def __init__(self, size: int):
        self.slots = np.full(1 << max(4, (2 * size - 1).bit_length()), -1, dtype=np.int64)
        self.groups: list[list] = []

    def add(self, digest: bytes, content: bytes, chars: int, doc_id: int, rows: int) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (held := self.slots[at]) >= 0:
            group = self.groups[held]
            if group[0] == digest and group[1] == content:
                group[4] += rows
                if chars > group[2] or chars == group[2] and doc_id < group[3]:
                    group[2], group[3] = chars, doc_id
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.groups)
        self.groups.append([digest, content, chars, doc_id, rows])


def grace(records: Iterable[tuple], max_bytes: int, fan_out: int = 16, level: int = 0) -> Iterator[list[list]]:
    """Buckets of groups of equal contents among (digest, content, chars, id, rows), in memory of about ``max_bytes``.

    A bucket is grouped as it is read, so only distinct contents count against
    the bound.  Beyond it, all go to ``fan_out`` spill files by the digest,
    salted with the level, and each file is taken on its own.  The files are
    the task's own and go with it; a task that is run again writes its own.
    """
    table, held, distinct = OpenTable(1 << 12), 0, 0
    records = iter(records)
    for record in records:
        table.add(*record)
        if len(table.groups) > distinct:
            distinct, held = len(table.groups), held + len(record[1]) + 200
            if 2 * distinct > len(table.slots):
                larger = OpenTable(2 * distinct)
                for group in table.groups:
                    larger.add(*group)
                table = larger
            if held > max_bytes and distinct > 1:
                break
    else:
        yield table.groups
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        names = [Path(folder, str(k)) for k in range(fan_out)]
        files = [name.open("wb") for name in names]

        def deal(rows: Iterable) -> None:
            for row in rows:
                salted = hashlib.blake2b(row[0], digest_size=4, salt=level.to_bytes(16, "little")).digest()
                pickle.dump(tuple(row), files[int.from_bytes(salted, "little") % fan_out], -1)

        deal(table.groups)
        del table
        deal(records)  # copies of what is in the files already meet them again when a file is read
        for file in files:
            file.close()
        for name in names:
            with name.open("rb") as file:
                # Digests that stay together through all levels are equal: no hash parts them.
                yield from grace(_read(file), max_bytes if level < 12 else 1 << 62, fan_out, level + 1)
            name.unlink()


def _read(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _frames(groups: Iterable[list], max_bytes: int = 8 << 20) -> Iterator[pd.DataFrame]:
    names, rows, held = GROUP.replace(" binary", "").replace(" long", "").split(", "), [], 0
    for group in groups:
        rows.append(group)
        held += len(group[1] or b"") + 100
        if held > max_bytes:
            yield pd.DataFrame(rows, columns=names)
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=names)


def sha256_of(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def sha256_column(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def content_of(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), DELETED.decode(), "").cast("binary")


def groups_of(docs: DataFrame, id_col: str, text_col: str, digest=sha256_of, max_bytes: int = 48 << 20) -> DataFrame:
    """One row a group of equal normalised texts (``GROUP``); ``content`` is null where no other content has the digest."""

    def local(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for batch in batches:
                for doc_id, text in zip(batch["i"], batch["t"]):
                    content = text.encode("utf-8").translate(None, DELETED)
                    yield digest(content), content, len(text), doc_id, 1

        yield from _frames(g for bucket in grace(rows(), max_bytes) for g in bucket)

    def merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def bare():
            for bucket in grace((row for batch in batches for row in batch.itertuples(index=False, name=None)), max_bytes):
                sharing = Counter(group[0] for group in bucket)
                for group in bucket:
                    yield group if sharing[group[0]] > 1 else [group[0], None, *group[2:]]

        yield from _frames(bare())

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(local, GROUP).repartition(F.col("digest")).mapInPandas(merge, GROUP)


def _with_groups(members: DataFrame, groups: DataFrame, text_col: str, on: list[str]) -> DataFrame:
    """``members`` beside their groups, by the columns ``on``; digests that several contents share also by content."""
    lone, shared = groups.filter("content is null").drop("content"), groups.filter("content is not null")
    joined = members.join(lone, on)
    if not shared.isEmpty():
        digests = shared.select("digest").distinct()
        few = members.join(digests, "digest", "left_semi").withColumn("content", content_of(F.col(text_col)))
        joined = joined.unionByName(few.join(shared, [*on, "content"]).drop("content"))
    return joined


NAMES = ("keep_id", "group_size", "kept", "digest", "content", "best_id", "best_chars", "best_first", "own_best_id", "own_best_chars")


def _prepared(docs: DataFrame, id_col: str, text_col: str, digest, digest_column, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Documents (with room for ``NAMES``) with their digest, and with ``best_first``: 1 but for rows that repeat id, length and content; and the groups."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    members = docs.withColumns({"best_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "best_chars": F.length(text), "digest": digest_column(content_of(F.col(text_col)))})
    others = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns if c != text_col], F.lit(0))
    members = members.withColumn("best_first", F.row_number().over(Window.partitionBy("digest", "best_id", "best_chars").orderBy(others)))
    groups, _ = written(groups_of(docs, id_col, text_col, digest, max_bytes).withColumnRenamed("rows", "group_size"), "groups")
    return members, groups


def assign_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_of, digest_column=sha256_column, max_bytes: int = 48 << 20) -> DataFrame:
    """``docs`` with ``digest`` and the ``keep_id``, ``group_size`` and ``kept`` of their groups of equal texts.

    Texts are equal when identical after the white space of ``common.SPACE``
    is deleted; null counts as empty, and all empty texts are one group.  The
    row with the most code points in the original text stays, then the
    smallest id, ids that are null last (``keep_id`` is then null).  Of rows
    that repeat the id and length of the one that stays, the first by a hash
    of the other columns stays.  An empty table gives an empty result.  Columns
    of ``docs`` with the name of a new one go on as ``<name>_in``.  Ids are
    whole numbers; others are an error of the cast.

    A digest that several contents share (``digest`` and ``digest_column`` are
    one function, weak in tests) is told apart by the complete contents.
    """
    members, groups = _prepared(make_room(docs, *NAMES), id_col, text_col, digest, digest_column, max_bytes)
    found = groups.withColumnsRenamed({"best_id": "own_best_id", "best_chars": "own_best_chars"})
    joined = _with_groups(members, found, text_col, ["digest"])
    best = (F.col("best_id") == F.col("own_best_id")) & (F.col("best_chars") == F.col("own_best_chars")) & (F.col("best_first") == 1)
    return joined.withColumns({"kept": best, "keep_id": F.when(F.col("own_best_id") != NO_ID, F.col("own_best_id"))}).drop("best_id", "best_chars", "best_first", "own_best_id", "own_best_chars")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_of, digest_column=sha256_column, max_bytes: int = 48 << 20) -> DataFrame:
    """The rows of ``docs`` that stay (see ``assign_groups``), with its columns.

    The join is by digest, id and length, so that a large group of copies
    sends no more than its own rows to any task.
    """
    room = make_room(docs, *NAMES)
    members, groups = _prepared(room, id_col, text_col, digest, digest_column, max_bytes)
    return _with_groups(members, groups.drop("group_size"), text_col, ["digest", "best_id", "best_chars"]).filter("best_first = 1").select(*room.columns).toDF(*docs.columns)
