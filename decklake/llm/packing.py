"""Best-fit packing of token sequences with Martello and Toth's dominance reduction (operator 11).

Tasks tokenize and cut documents into pieces of at most ``capacity`` tokens.
What a packing depends on is how many pieces there are of each length, so the
instance that is solved has ``capacity`` item types at most, whatever the size
of the input.  The reduction fixes every set of one, two or three pieces that
provably dominates all others a piece could be packed in; best fit, longest
first, packs the rest.  Both work on whole counts: bins that are alike are one
row of a plan.  A piece then finds its place in the plan by its length and its
rank among the pieces of that length; ranks are counted by hashed buckets, so a
length that a third of the pieces have is spread over tasks.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import drop_path, written

#: Tokens that are put out at a time, and rows of a bucket in which ranks are counted, about.
TOKENS_AT_ONCE, BUCKET = 1 << 20, 20_000


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _as_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a plain byte-level BPE whose merges stand in the order of their ids; None for any other tokenizer."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return None
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        return None
    if any(a.get(k) for a in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    added, vocabulary = {a["content"] for a in spec.get("added_tokens", [])}, model["vocab"]
    merged = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if merged != sorted(set(merged)) or merged[:1] == [-1] or len(merged) + 256 + len(added & vocabulary.keys()) != len(vocabulary):
        return None
    letters = _byte_letters()
    return {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in added}


def id_function(path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text by the ``tokenizers`` file at ``path``, without special tokens added; special strings inside a text are what the file makes of them.

    Where the file is a plain byte-level BPE, ``tiktoken`` runs it with the
    same ranks, several times as fast; what it can't take (runs of white space
    too long for its pattern) and all other files go through ``tokenizers``.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    whole = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
    ranks = _as_ranks(spec)
    if ranks is None:
        return whole
    # Fixed value: the pattern of the byte-level pre-tokenizer.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in spec.get("added_tokens", [])})

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except ValueError:
            return whole(text)

    return ids


def _ids(path: str, held: dict = {}) -> Callable[[str], np.ndarray]:  # noqa: B006  one a worker
    if path not in held:
        held[path] = id_function(path)
    return held[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, but that the first is what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end: int | None, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            held: list[np.ndarray] = []
            tokens = 0

            def made() -> pa.RecordBatch:
                table = np.array(rows, dtype=np.int64).reshape(-1, 5).T
                columns = [batch.column(0).take(pa.array(table[0])), pa.array(table[1].astype(np.int32)), *map(pa.array, table[2:])]
                if with_ids:
                    flat = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(table[3]))).astype(np.int32)), pa.array(flat)))
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

            for k, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "")
                if end is not None:
                    ids = np.append(ids, np.array([end], dtype="<u4"))
                for number, (at, n) in enumerate(cuts(len(ids), capacity) if len(ids) else [(0, 0)]):
                    part = ids[at : at + n]
                    rows.append((k, number, at, n, zlib.crc32(part.tobytes())))
                    if with_ids:
                        held.append(part)
                        tokens += n
                        if tokens >= TOKENS_AT_ONCE:
                            yield made()
                            rows, held, tokens = [], [], 0
            yield made()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


class Plan:
    """Where the pieces of each length go: runs of equal placements.

    A run of (first rank, first sequence, copies, offset) puts ``copies``
    pieces of the length side by side at ``offset`` of each sequence from the
    first on, in order of rank.
    """

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.used: dict[int, int] = {}
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}

    def place(self, length: int, sequence: int, bins: int, copies: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.setdefault(length, []).append((rank, sequence, copies, offset))
        self.used[length] = rank + bins * copies

    def open(self, bins: int) -> int:
        self.sequences += bins
        return self.sequences - bins

    def fix(self, lengths: tuple[int, ...], times: int) -> None:
        """``times`` sequences of one piece of each of ``lengths``."""
        first, offset = self.open(times), 0
        self.fixed += times
        for length in lengths:
            self.place(length, first, times, 1, offset)
            offset += length


def dominant(count: dict[int, int], order: list[int], length: int, capacity: int) -> tuple[int, ...] | None:
    """A set of pieces with one of ``length`` that dominates every other set that fits and holds it, or None.

    ``order``: the lengths at hand, rising; ``count``: how many there are of
    each.  A set dominates another if its pieces can be parted so that each
    piece of the other, or some of them together, is no longer than one of
    its own: whatever a solution packs with ``length`` can then be swapped for
    the set without a further sequence.
    """
    room = capacity - length
    own = lambda x: count[x] - (x == length)  # noqa: E731  copies beside the piece itself
    small: list[int] = []
    for x in order:
        small += [x] * min(3 - len(small), own(x))
        if len(small) == 3:
            break
    if not small or small[0] > room:
        return (length,)
    at = bisect_left(order, room + 1) - 1
    if not own(order[at]):  # the largest that fits is the piece itself; a shorter one is there, as small[0] fits
        at -= 1
    best = order[at]
    if best == room or len(small) < 2 or small[0] + small[1] > room:
        return (length, best)
    if len(small) == 3 and sum(small) <= room:
        return None
    # At most two more fit: (second, first) with second <= first, of all such pairs the largest sum and the largest second.
    most, widest = 0, 0
    for second in order[: bisect_left(order, room // 2 + 1)]:
        if not own(second):
            continue
        k = bisect_left(order, room - second + 1) - 1
        while k >= 0 and order[k] >= second and own(order[k]) < 1 + (order[k] == second):
            k -= 1
        if k >= 0 and order[k] >= second:
            most, widest = max(most, second + order[k]), second
    if best >= most:
        return (length, best)
    third = room - best
    k = bisect_left(order, third + 1) - 1
    while k >= 0 and own(order[k]) < 1 + (order[k] == best):
        k -= 1
    if k >= 0 and order[k] >= widest:
        return (length, best, order[k])
    return None


def reduce(count: dict[int, int], plan: Plan) -> None:
    """Fix dominating sets, longest pieces first, until there is none; ``count`` keeps the rest.

    A set that dominates goes on doing so while its pieces last, for taking
    pieces away only takes alternatives away: it is fixed as often as there
    are pieces for it.
    """
    changed = True
    while changed and count:
        changed = False
        for length in sorted(count, reverse=True):
            while length in count:
                found = dominant(count, sorted(count), length, plan.capacity)
                if found is None:
                    break
                need = {x: found.count(x) for x in found}
                times = min(count[x] // n for x, n in need.items())
                plan.fix(found, times)
                for x, n in need.items():
                    count[x] -= n * times
                    if not count[x]:
                        del count[x]
                changed = True


def best_fit(count: dict[int, int], plan: Plan) -> None:
    """Best fit, longest first: each piece goes where the least room is left that holds it; bins alike move together."""
    groups: list[tuple[int, int, int]] = []  # (room, first sequence, bins), rising
    for length in sorted(count, reverse=True):
        left = count[length]
        at = bisect_left(groups, (length, 0, 0))
        filled: list[tuple[int, int, int]] = []

        def put(room: int, first: int, bins: int, copies: int) -> None:
            plan.place(length, first, bins, copies, plan.capacity - room)
            if room > copies * length:
                filled.append((room - copies * length, first, bins))

        while left and at < len(groups):
            room, first, bins = groups.pop(at)
            each = room // length
            full = min(bins, left // each)
            if full:
                put(room, first, full, each)
                left -= full * each
            if full < bins and left:
                put(room, first + full, 1, left)
                left, full = 0, full + 1
            if full < bins:
                insort(groups, (room, first + full, bins - full))
        each = plan.capacity // length
        if left >= each:
            bins = left // each
            put(plan.capacity, plan.open(bins), bins, each)
            left -= bins * each
        if left:
            put(plan.capacity, plan.open(1), 1, left)
        for group in filled:
            insort(groups, group)


def plan_of(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for ``counts`` pieces of each length of 1 to ``capacity`` tokens."""
    plan, count = Plan(capacity), {n: c for n, c in counts.items() if c and n}
    reduce(count, plan)
    best_fit(count, plan)
    return plan


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """``pieces`` with their rank, from 0, among those of their length, by hashed buckets; repeated rows get different ranks."""
    buckets = max(1, -(-total // BUCKET))
    # Rows without an id go by the row's number in the written table, which stays the same.
    tied = F.when(F.col("doc_id").isNull(), F.col("row"))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", tied), F.lit(buckets)))
    sums = rows.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32", "row")
    return rows.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first")).drop("bucket", "first")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): all of ``docs`` in as few sequences of ``capacity`` tokens as reduction and best fit need.

    A document's tokens are those of ``tokenizer_path`` (a ``tokenizers``
    file on every worker) with ``end`` after them.  Only longer ones are cut,
    into full pieces, the first one shorter.  Null texts are empty, and have
    the end alone; without an end they are one piece of length 0, whose
    sequence is null.  Rows that repeat, with or without an id, are packed
    each; other columns than the id are left behind, so none can clash.  An
    empty table gives an empty one.  Sequences are numbered from 0; their
    pieces lie without gaps from offset 0.  ``with_ids`` adds the tokens
    themselves (see ``assemble``).
    """
    spark = docs.sparkSession
    pieces, path = written(pieces_of(docs, tokenizer_path, capacity, end, id_col, text_col, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity + 1 rows at most
    plan = plan_of(counts, capacity)
    placed = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*runs)) for n, runs in plan.runs.items()}
    shared = spark.sparkContext.broadcast(placed)

    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        where = {"sequence_id": np.full(len(length), -1, dtype=np.int64), "offset": np.zeros(len(length), dtype=np.int64)}
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths).tolist():
            if n:
                rows = np.flatnonzero(lengths == n)
                first, sequence, copies, offset = shared.value[n]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                inside = ranks[rows] - first[k]
                where["sequence_id"][rows] = sequence[k] + inside // copies[k]
                where["offset"][rows] = offset[k] + inside % copies[k] * n
        return pd.DataFrame(where)

    at = F.pandas_udf(find, "sequence_id long, offset long")("length", "rank")
    # Ranks come of the small columns alone; tokens, where they are asked for, join by the row's number.
    small = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = _ranked(pieces.select(*small, "row"), sum(counts.values())).withColumn("at", at)
    out = ranked.select(*small, "row", F.when(F.col("at.sequence_id") >= 0, F.col("at.sequence_id")).alias("sequence_id"), F.when(F.col("at.sequence_id") >= 0, F.col("at.offset")).alias("offset"))
    if with_ids:
        out = out.join(pieces.select("row", "ids"), "row")
    return out.drop("row")


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts) of ``pack``'s pieces with their ids: each sequence's tokens, and where its documents begin; one row is ``capacity`` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.filter("sequence_id is not null").groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"))
