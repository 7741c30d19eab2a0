"""SimHash near-duplicates through a hierarchical index in Gray order (operator 6).

Two fingerprints that differ in at most 3 of 64 bits agree on one of four
blocks of 16: rows are dealt out by block and value, and within such a group
the rest of the bits go through the index.  A group of more than ``GROUP``
distinct fingerprints is not joined but dealt out once more, by four blocks of
the bits that are left, and so on; when 56 bits are fixed, no group can be
larger.  A task sorts its groups' fingerprints by Gray rank, so that
neighbours share most bits; each upper node holds the bits that all below it
share and its parent doesn't, and a walk from the top adds up the differences
and leaves a whole node as soon as they exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop_path, written, written_in_parts
from .graph import components

BITS, BLOCKS = 64, 4
#: Distinct fingerprints of a group that a task joins; children of an upper node.
GROUP, FAN_OUT = 1000, 16


def shingles(text: str | None, k: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``k`` words, A-Z in lower case, joined by spaces; of all words if there are fewer."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(b" ".join(words), 42)]
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def simhash(hashes: list[int] | np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none.  Signed, as Spark's longs are."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, k: int) -> Column:
    return F.pandas_udf(lambda texts: pd.Series([simhash(shingles(t, k)) for t in texts], dtype="int64"), "long")(text)


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def block_masks(depth: int) -> list[int]:
    """For each path of ``depth`` choices among four blocks of the bits that are left, all bits that it fixes."""
    masks = [0]
    for _ in range(depth):
        deeper = []
        for fixed in masks:
            left = [b for b in range(BITS) if not fixed >> b & 1]
            cuts = [round(i * len(left) / BLOCKS) for i in range(BLOCKS + 1)]
            deeper += [fixed | sum(1 << b for b in left[cuts[i] : cuts[i + 1]]) for i in range(BLOCKS)]
        masks = deeper
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, bits shared) of the nodes of each level, leaves first; ``codes`` are in Gray order."""
    levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
    while len(levels[-1][0]) > FAN_OUT:
        pattern, mask = levels[-1]
        starts = np.arange(0, len(pattern), FAN_OUT)
        ones, union = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
        shared = np.bitwise_and.reduceat(mask, starts) & ~(ones ^ union)
        levels.append((ones & shared, shared))
    return levels


def linked_pairs(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of ``codes`` (in Gray order) that differ in at most ``radius`` bits, the first before the second."""
    levels = _levels(codes)
    top = len(levels[-1][0])
    found_a, found_b = [], []
    for at in range(0, len(codes), 256):
        query = np.repeat(np.arange(at, min(at + 256, len(codes))), top)
        node = np.tile(np.arange(top), len(query) // top)
        above = np.zeros(len(query), dtype=np.uint64)  # bits that the parents have dealt with
        differ = np.zeros(len(query), dtype=np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            pattern, mask = levels[depth]
            span = FAN_OUT**depth
            differ = differ + np.bitwise_count((codes[query] ^ pattern[node]) & mask[node] & ~above)
            keep = (differ <= radius) & ((node + 1) * span - 1 > query)
            query, node, differ = query[keep], node[keep], differ[keep]
            if depth:
                above = mask[node]
                below = len(levels[depth - 1][0])
                children = node[:, None] * FAN_OUT + np.arange(FAN_OUT)[None, :]
                real = children < below
                query, differ, above = (np.repeat(x, FAN_OUT)[real.ravel()] for x in (query, differ, above))
                node = children[real]
        found_a.append(query)
        found_b.append(node)
    return np.concatenate(found_a), np.concatenate(found_b)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index in each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _join_groups(radius: int):
    """Rows (path, value, code) sorted by group to links of a spanning forest of each group."""

    def linked(path: np.ndarray, value: np.ndarray, code: np.ndarray) -> pd.DataFrame:
        codes = code.view(np.uint64)
        order = np.lexsort((gray_rank(codes), value, path))
        path, value, codes = path[order], value[order], codes[order]
        edge = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (value[1:] != value[:-1]), [True])))
        size = np.diff(edge)
        group = np.repeat(np.arange(len(size)), size)
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        # A group of up to one node's children has no upper node: its leaves are compared straight away, all groups at a time.
        small = np.flatnonzero((size[group] <= FAN_OUT) & (size[group] > 1))
        for gap in range(1, FAN_OUT):
            first = small[small + gap < len(codes)]
            first = first[group[first] == group[first + gap]]
            first = first[np.bitwise_count(codes[first] ^ codes[first + gap]) <= radius]
            a.append(first)
            b.append(first + gap)
        for g in np.flatnonzero(size > FAN_OUT):
            x, y = linked_pairs(codes[edge[g] : edge[g + 1]], radius)
            a.append(x + edge[g])
            b.append(y + edge[g])
        root = _roots(len(codes), np.concatenate(a), np.concatenate(b))
        hung = np.flatnonzero(root != np.arange(len(root)))
        signed = codes.view(np.int64)
        return pd.DataFrame({"a": signed[hung], "b": signed[root[hung]]})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            # The last group of a batch may go on in the next one.
            path, value = batch["path"].to_numpy(), batch["value"].to_numpy()
            open_from = int(np.flatnonzero((path != path[-1]) | (value != value[-1]))[-1]) + 1 if ((path != path[-1]) | (value != value[-1])).any() else 0
            if open_from:
                rows = pd.concat([*held, batch.iloc[:open_from]])
                yield linked(*(np.ascontiguousarray(rows[c].to_numpy()) for c in ("path", "value", "code")))
                held = [batch.iloc[open_from:]]
            else:
                held.append(batch)
        if held:
            rows = pd.concat(held)
            yield linked(*(np.ascontiguousarray(rows[c].to_numpy()) for c in ("path", "value", "code")))

    return run


def hamming_links(codes: DataFrame, radius: int = 3, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct ``code`` values whose components are those of all pairs within ``radius`` (3 at most)."""
    if not 0 <= radius < BLOCKS:
        raise ValueError("the radius must be less than the number of blocks")
    joined, depth = [], 0
    rows = codes.select("code", F.lit(0).alias("path"))
    while True:
        depth += 1
        masks = F.array(*[F.lit(_signed(m)) for m in block_masks(depth)])
        rows = rows.select("code", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda j: F.col("path") * BLOCKS + j)).alias("path"))
        rows = rows.withColumn("value", F.col("code").bitwiseAND(F.get(masks, F.col("path"))))
        if depth == 7:  # 57 bits or more are fixed
            joined.append(rows.withColumn("depth", F.lit(depth)))
            break
        large, _ = written(rows.groupBy("path", "value").count().filter(F.col("count") > group).select("path", "value"), "large-groups")
        if large.isEmpty():
            joined.append(rows.withColumn("depth", F.lit(depth)))
            break
        joined.append(rows.join(large, ["path", "value"], "left_anti").withColumn("depth", F.lit(depth)))
        rows, _ = written(rows.join(large, ["path", "value"], "left_semi").select("code", "path"), "large-rows")
    union = joined[0]
    for more in joined[1:]:
        union = union.unionByName(more)
    union = union.select((F.col("path") + F.col("depth") * BLOCKS**7).cast("long").alias("path"), "value", "code")
    return union.repartition("path", "value").sortWithinPartitions("path", "value").mapInPandas(_join_groups(radius), "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3, group: int = GROUP) -> DataFrame:
    """(doc_id, code, component_id) for each document: fingerprints link at ``radius`` or fewer differing bits.

    Words are runs without the white space of ``common.SPACE``; a text of
    fewer than ``k`` words is one shingle, and one of none (null too) has
    fingerprint 0, which links like any other.  ``component_id`` is the
    smallest id that can be reached; null ids are reached but never the
    smallest.  Repeated rows stay.  An empty table gives an empty result.
    """
    fps, _ = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), k).alias("code")), "fingerprints")
    codes, codes_path = written(fps.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    rooted, rooted_path = written(components(hamming_links(codes.select("code"), radius, group), "a", "b").withColumnRenamed("node", "code"), "roots")
    known = codes.join(rooted, "code", "left").withColumn("root", F.coalesce("root", "code"))
    # Most roots have one code: only the others are added up.
    least, least_path = written(known.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id")), "least")
    paths = (codes_path, rooted_path, least_path)
    placed, _ = written(known.select("code", "root").join(least, "root").select("code", "component_id"), "placed")
    for done in paths:
        drop_path(docs.sparkSession, done)
    return fps.join(placed, "code").select("doc_id", "code", "component_id")


#: First candidates for similar texts: bands of this many min-hashes each.  At similarity 0.8 one of 12 bands of 5 agrees with probability 0.99.
BANDS, BAND_ROWS = 12, 5
#: Words that are hashed at a time, bytes of words that go through numpy together, and of a longer word at a time.
WORDS_AT_ONCE, BYTES_AT_ONCE, SPAN = 20_000, 1 << 20, 1 << 16
_BASE = 0x9E3779B97F4A7C15
_OF_BYTE = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
_UP, _DOWN = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BYTES_AT_ONCE + SPAN, x, np.uint64))), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ values >> np.uint64(29)


def _long_word(word: bytes) -> int:
    """The sum of ``word_hashes`` for a word of any length, a span at a time."""
    total, power, step = 0, 1, pow(_BASE, SPAN, 1 << 64)
    for at in range(0, len(word), SPAN):
        letters = np.frombuffer(word[at : at + SPAN], dtype=np.uint8)
        total += power * int((_OF_BYTE[letters] * _UP[: len(letters)]).sum(dtype=np.uint64))
        power = power * step % (1 << 64)
    return total % (1 << 64)


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word's bytes, and their number: numbers of the bytes times powers of an odd number, modulo 2 ** 64, mixed.

    Short words go through running sums together, a stretch at a time; a
    word's hash doesn't depend on where it stands in its stretch.
    """
    run = b" ".join(words)
    if len(run) <= BYTES_AT_ONCE:
        return _run_hashes(run)
    hashes, sizes, at = np.zeros(len(words), dtype=np.uint64), np.fromiter(map(len, words), dtype=np.int64, count=len(words)), 0
    while at < len(words):
        if sizes[at] > SPAN:
            hashes[at] = _mixed(np.array([_long_word(words[at])], dtype=np.uint64))[0]
            at += 1
            continue
        end, held = at, 0
        while end < len(words) and sizes[end] <= SPAN and held < BYTES_AT_ONCE - SPAN:
            held, end = held + int(sizes[end]) + 1, end + 1
        hashes[at:end] = _run_hashes(b" ".join(words[at:end]))[0]
        at = end
    return hashes, sizes


def _run_hashes(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    letters = np.frombuffer(run, dtype=np.uint8)
    sums = np.zeros(len(letters) + 1, dtype=np.uint64)
    np.cumsum(_OF_BYTE[letters] * _UP[: len(letters)], out=sums[1:])
    gaps = np.flatnonzero(letters == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(letters)]))
    return _mixed((sums[ends] - sums[starts]) * _DOWN[starts]), ends - starts


def shingle_set(text: str, k: int) -> np.ndarray:
    """The distinct shingles of ``shingles``, by 64-bit hashes of their words, sorted."""
    return sized_shingles(text, k)[0]


def sized_shingles(text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles, by 64-bit hashes of their words, sorted, and their lengths in bytes.

    One hash for words of every length: a shingle has the same value wherever
    it stands and whatever stands beside it.
    """
    words = text.encode("utf-8").lower().split()
    n, found, sizes = min(k, len(words)), [], []
    for at in range(0, len(words) - n + 1 if words else 0, WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + n - 1]
        (hashes, length), many = word_hashes(part), len(part) - n + 1
        mixed = np.zeros(many, dtype=np.uint64)
        for j in range(n):
            mixed = mixed * np.uint64(_BASE) + hashes[j : j + many]
        found.append(_mixed(mixed))
        until = np.concatenate(([0], np.cumsum(length)))
        sizes.append(until[n:] - until[:-n] + n - 1)
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    values, first = np.unique(np.concatenate(found), return_index=True)
    return values, np.concatenate(sizes)[first]


@lru_cache
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(6).integers(0, 1 << 63, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(values: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """The least value of all shingles under each of ``bands * rows`` multiplications; the same for all texts without shingles."""
    factor = _factors(bands * rows)
    least = np.full(bands * rows, ~np.uint64(0))
    for at in range(0, len(values), 256):  # small enough for the caches
        mixed = values[None, at : at + 256] * factor
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(axis=1))
    return least


def band_values(least: np.ndarray, rows: int = BAND_ROWS) -> list[int]:
    return [_signed(xxhash.xxh64_intdigest(least[at : at + rows].tobytes(), at)) for at in range(0, len(least), rows)]


def similarity(a: str, b: str, k: int) -> float:
    """Jaccard similarity of the two texts' shingles; 1 for two texts without words."""
    x, y = set(shingles(a, k)), set(shingles(b, k))
    return len(x & y) / len(x | y) if x or y else 1.0


#: A block of a group holds about so many rows, and shingles, at most.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 600_000
#: Rows of a unit whose prefixes are compared as matrices.
SMALL = 64
#: Rows that are broadcast to find their texts, at most; beyond, texts are shuffled.
MOST_BROADCAST = 3_000_000
#: Shingles of prefixes that are grouped in a pass, about, and passes over all prefixes at most: one pass's shuffle files are on disk at a time.
PASS_VALUES, PASSES = 10_000_000, 8
#: Shingles that are dealt out to units at a time: so many, or a share of those of all texts if that is more.
DEALT, DEALT_SHARE = 30_000_000, 0.25
#: Texts whose shingles are counted, about, and shingles called common at most: both only decide in which order shingles are taken.
COUNTED, COMMON = 10_000, 50_000


def _common(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of some ``COUNTED`` texts have, sorted, and how many have them."""
    step = max(1, round(texts.count() / COUNTED))

    def each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                found = [shingle_set(t, k) for t in batch["text"].iloc[at : at + 256]]
                yield pd.DataFrame({"shingle": np.concatenate(found).view(np.int64)})

    counted = texts.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(step)) == 0).select("text").mapInPandas(each, "shingle long")
    top = counted.groupBy("shingle").count().filter("count > 2").orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    value, count = np.array([r[0] for r in top], dtype=np.int64).view(np.uint64), np.array([r[1] for r in top], dtype=np.int64)
    order = np.argsort(value)
    return value[order], count[order]


def prefix(values: np.ndarray, least: float, common: np.ndarray, count: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """So many of the distinct shingles, rare ones first, that texts ``least`` alike must share one.

    Rare are those that few of the counted texts have; of the others, which
    next to none has, the longest, for they are the least likely to be shared
    by chance.
    Of n shingles at least ceil(least * n) are shared; the first of the shared
    ones in an order that holds for all texts is then among the first
    n - ceil(least * n) + 1 of both.
    """
    if len(common) and len(values):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        values = values[np.lexsort((values, -sizes, np.where(common[at] == values, count[at], 0)))]
    elif len(values):
        values = values[np.lexsort((values, -sizes))]
    return values[: int(prefix_size(np.array(len(values)), least))]


def prefix_size(size: np.ndarray, least: float) -> np.ndarray:
    return np.minimum(size, size - np.ceil(least * size - 1e-9).astype(np.int64) + 1)


def _by_unit(work, names: tuple[str, ...], out: list[str]):
    """``work`` over the arrays ``names`` of each unit; rows come sorted by unit, which may go over several batches."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = []
        open_unit = None
        for batch in batches:
            if not len(batch):
                continue
            unit, columns = batch["unit"].to_numpy(), [batch[c].to_numpy() for c in names]
            edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            found = []
            for a, b in zip(edges[:-1], edges[1:]):
                if held and unit[a] != open_unit:
                    found += work(open_unit, *(np.concatenate(c) for c in zip(*held)))
                    held = []
                open_unit = unit[a]
                held.append([c[a:b] for c in columns])
            yield pd.DataFrame(found, columns=out, dtype="int64")
        if held:
            yield pd.DataFrame(work(open_unit, *(np.concatenate(c) for c in zip(*held))), columns=out, dtype="int64")

    return run


class _Shared:
    """Counts how many values each of some sets shares with another set."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.holder = np.repeat(np.arange(len(sets)), self.size)[order]
        self.known, self.start = np.unique(flat[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(flat)))

    def _common(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, value) of all values that a set shares."""
        if not len(self.known) or not len(values):
            return np.zeros(0, dtype=np.int64), self.known[:0]
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        at = at[self.known[at] == values]
        reach = self.count[at]
        where = np.repeat(self.start[at] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
        return self.holder[where], np.repeat(self.known[at], reach)

    def with_(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self._common(values)[0], minlength=len(self.size))

    def least_with(self, values: np.ndarray, salt: int) -> np.ndarray:
        """The least shared value after ``salt`` is added bit by bit."""
        holder, value = self._common(values)
        out = np.full(len(self.size), np.iinfo(np.int64).max)
        np.minimum.at(out, holder, value ^ np.int64(salt))
        return out


def _others(side: np.ndarray, node: np.ndarray, root: np.ndarray, i: int, right: np.ndarray) -> np.ndarray:
    """Which of the right side row ``i`` has to meet: other roots, each pair of a block once."""
    other = root[right] != root[i]
    return other & (node[right] > node[i]) if side[i] == 2 else other


def _live(least: float):
    """Rows (unit, value, side, node, root, size, length, prefix) to those (unit, side, node, root) that some other root's row may be alike to, by their prefixes.

    ``prefix`` may lack what no other root's row has.  What two sets share is
    either in both prefixes, or in the rest of the one whose prefix ends first.
    A pair that shares several values is taken up in
    the group of the least one alone.
    """

    def small(value: np.ndarray, side: np.ndarray, root: np.ndarray, size: np.ndarray, length: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """``work`` for few rows: all pairs at once, as a product of 0 and 1 matrices."""
        n = len(side)
        known, at = np.unique(np.concatenate(prefix), return_inverse=True)
        holds = np.zeros((n, len(known)), dtype=np.float32)
        holds[np.repeat(np.arange(n), [len(p) for p in prefix]), at] = 1
        rest = size - prefix_size(size, least)
        most = holds @ holds.T + np.maximum(rest[:, None], rest[None, :])
        meet = (root[:, None] != root[None, :]) & ((side[:, None] != side[None, :]) | (side == 2)[:, None]) & (np.arange(n)[:, None] < np.arange(n)[None, :])
        live = np.zeros(n, dtype=bool)
        for i, j in np.argwhere(meet & (most * (1 + least) + 1e-6 >= least * (size[:, None] + size[None, :]))).tolist():
            both = known[(holds[i] + holds[j]) == 2]
            met = {int(length[i]), int(length[i]) + 1} & {int(length[j]), int(length[j]) + 1}
            if len(both) and met and value[0] == min(int((both ^ np.int64(m << 56)).min()) for m in met):
                live[[i, j]] = True
        return live

    def work(unit: int, value: np.ndarray, side: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, length: np.ndarray, prefix: np.ndarray) -> list[tuple[int, ...]]:
        if len(side) <= SMALL:
            return [(unit, int(side[i]), int(node[i]), int(root[i])) for i in np.flatnonzero(small(value, side, root, size, length, prefix))]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return []
        shared = _Shared([prefix[i] for i in right])
        rest = size - prefix_size(size, least)
        live = np.zeros(len(side), dtype=bool)
        for i in left.tolist():
            other = _others(side, node, root, i, right)
            if not other.any():
                continue
            most = shared.with_(prefix[i]) + np.maximum(rest[i], rest[right])
            hit = other & (most * (1 + least) + 1e-6 >= least * (size[i] + size[right]))
            if hit.any():
                first = np.full(len(right), np.iinfo(np.int64).max)
                for met in (length[i], length[i] + 1):
                    np.minimum(first, shared.least_with(prefix[i], int(met) << 56), out=first, where=(length[right] == met) | (length[right] + 1 == met))
                hit &= first == value[0]
            if hit.any():
                live[i] = True
                live[right[hit]] = True
        return [(unit, int(side[i]), int(node[i]), int(root[i])) for i in np.flatnonzero(live)]

    return _by_unit(work, ("value", "side", "node", "root", "size", "length", "prefix"), ["unit", "side", "node", "root"])


def _unit_links(least: float, k: int):
    """Rows (unit, side, node, root, text) sorted by unit to links between its two sides that join different roots.

    The shingles shared with each text of the right side are counted at once;
    a pair whose roots are joined by then is passed over, so that a unit gives
    fewer links than it has rows.
    """

    def links(unit: int, side: np.ndarray, node: np.ndarray, root: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right):
            return []
        sets = [shingle_set(text[i], k) for i in right]
        shared, own = _Shared(sets), {int(i): x for i, x in zip(right, sets)}
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        found = []
        for i in left.tolist():
            other = _others(side, node, root, i, right)
            if not other.any():
                continue
            mine = own[i] if i in own else shingle_set(text[i], k)
            both = shared.with_(mine)
            either = len(mine) + shared.size - both
            alike = np.where(either > 0, both / np.maximum(either, 1), 1.0) >= least
            for j in np.flatnonzero(other & alike).tolist():
                x, y = find(int(root[i])), find(int(root[right[j]]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    found.append((int(node[i]), int(node[right[j]])))
        return found

    return _by_unit(links, ("side", "node", "root", "text"), ["a", "b"])


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast unless it has too many rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _passes(rows: DataFrame, shingles: int | None, most: int) -> list[DataFrame]:
    """``rows`` by unit, in parts that deal out about ``most`` of ``shingles`` each."""
    passes = 1 + (shingles or 0) // most
    return [rows.filter(F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(passes)) == i) for i in range(passes)]


def _compared(rows: DataFrame, sizes: DataFrame, texts: DataFrame, least: float, k: int, most: int) -> DataFrame:
    """Links (a, b) within the units of ``rows`` (unit, side, node, root), each unit in one task.

    Only texts that a unit needs cross the shuffle, about ``most`` shingles
    of them at a time: the rows are broadcast to the texts unless there are too
    many, and then their nodes.
    """
    spark = rows.sparkSession
    rows, path = written(rows, "units")
    paths, texts = [path], texts.select("node", "text")
    if rows.count() > MOST_BROADCAST:
        needed, path = written(rows.select("node").distinct(), "needed")
        paths, texts = [*paths, path], texts.join(_small(needed), "node", "left_semi")
    shingles = rows.join(sizes, "node").agg(F.sum("size")).first()[0]
    dealt = (texts.join(_small(part), "node").repartition("unit").sortWithinPartitions("unit") for part in _passes(rows, shingles, most))
    found, path = written_in_parts((d.mapInPandas(_unit_links(least, k), "a long, b long") for d in dealt), "found")
    links, _ = written(found.distinct(), "links")
    for done in (*paths, path):
        drop_path(spark, done)
    return links


def _stars(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, least: float, k: int, most: int) -> DataFrame:
    """Links among ``pairs`` (a, b) of nodes: each b meets its a's, in blocks of a bounded number of shingles."""
    pairs, path = written(pairs.filter("a <> b").distinct(), "pairs")
    sized = pairs.join(sizes.withColumnsRenamed({"node": "a"}), "a")
    blocks = sized.groupBy("b").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    blocks, blocks_path = written(blocks.withColumn("blocks", F.greatest("blocks", F.lit(1))), "blocks")
    unit = lambda block: F.xxhash64("b", block).alias("unit")
    members = pairs.join(blocks, "b").select(unit(F.pmod(F.hash("a"), F.col("blocks"))), F.lit(0).alias("side"), F.col("a").alias("node"), F.col("a").alias("root"))
    centres = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(unit(F.col("block")), F.lit(1).alias("side"), F.col("b").alias("node"), F.col("b").alias("root"))
    links = _compared(members.unionByName(centres), sizes, texts, least, k, most)
    for done in (path, blocks_path):
        drop_path(pairs.sparkSession, done)
    return links


def _shared_prefixes(sketched: DataFrame, roots: DataFrame, passes: int) -> tuple[DataFrame, str]:
    """(node, shingle): of each prefix what several roots have; a part of all shingles at a time."""
    spark, roots = sketched.sparkSession, _small(roots)

    def parts() -> Iterator[DataFrame]:
        for i in range(passes):
            rows = sketched.select("node", F.explode("prefix").alias("shingle")).filter(F.pmod("shingle", F.lit(passes)) == i)
            rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            several = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
            several, path = written(several, "several")
            # What every row has of its node comes back only to the rows that are left.
            yield rows.join(_small(several), "shingle", "left_semi").select("node", "shingle")
            drop_path(spark, path)

    return written_in_parts(parts(), "left")


def _several_roots(left: DataFrame, sizes: DataFrame, roots: DataFrame, passes: int) -> tuple[DataFrame, str]:
    """(value, node, root, length, blocks): of ``left`` (node, shingle) the groups of like sizes that hold more than one root; of groups of the same nodes, one."""
    met = left.join(sizes, "node").join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Lengths that differ by one at most meet under the greater one.
    met = met.withColumn("length", F.explode(F.array("length", F.col("length") + 1))).select("node", "root", "size", "length", F.col("shingle").bitwiseXOR(F.shiftleft(F.col("length").cast("long"), 56)).alias("value"))
    met, met_path = written(met, "met")
    total = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(20,0)"))
    sets = (met.filter(F.pmod("value", F.lit(passes)) == i).groupBy("value").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), total(1).alias("x"), total(2).alias("y"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high") for i in range(passes))
    sets, sets_path = written_in_parts(sets, "sets")
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("shingles") / BLOCK_SHINGLES)).cast("int"))
    once, once_path = written(sets.groupBy("n", "shingles", "x", "y").agg(F.min("value").alias("value")).select("value", blocks.alias("blocks")), "once")
    out, out_path = written(met.join(once, "value").drop("size"), "grouped")
    for done in (met_path, sets_path, once_path):
        drop_path(left.sparkSession, done)
    return out, out_path


def _blockwise(sketched: DataFrame, sizes: DataFrame, roots: DataFrame, texts: DataFrame, least: float, k: int, most: int) -> DataFrame:
    """Links (a, b) between different roots whose prefixes in ``sketched`` share a value: each group's blocks meet two at a time, in tasks of their own.

    They first meet by their prefixes, about ``most`` shingles of them at a time;
    only texts that may be alike to another one of the unit are then compared.
    """
    spark = texts.sparkSession
    passes = min(PASSES, 1 + (sketched.agg(F.sum(F.size("prefix"))).first()[0] or 0) // PASS_VALUES)
    left, left_path = _shared_prefixes(sketched, roots, passes)
    shared, shared_path = written(left.groupBy("node").agg(F.collect_list("shingle").alias("prefix")).join(sizes, "node"), "shared")
    rows, grouped_path = _several_roots(left, sizes, roots, passes)
    drop_path(spark, left_path)
    rows = rows.withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    unit = F.xxhash64("value", F.least("own", "other"), F.greatest("own", "other"))
    rows, path = written(rows.select(unit.alias("unit"), "value", side.alias("side"), "node", "root"), "met-units")
    drop_path(spark, grouped_path)
    shingles = rows.join(shared.select("node", F.size("prefix").alias("n")), "node").agg(F.sum("n")).first()[0]
    dealt = (shared.join(_small(part), "node").repartition("unit").sortWithinPartitions("unit") for part in _passes(rows, shingles, most))
    live, live_path = written_in_parts((d.mapInPandas(_live(least), "unit long, side int, node long, root long") for d in dealt), "live")
    for done in (shared_path, path):
        drop_path(spark, done)
    links = _compared(live, sizes, texts, least, k, most)
    drop_path(spark, live_path)
    return links


def similar_links(docs: DataFrame, node_col: str, text_col: str, k: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """Links (a, b) between nodes of ``docs`` whose texts' shingles are ``least`` alike; their components are those of all such pairs.

    Candidates are fingerprints within ``radius``, and, because texts that are
    only just alike differ in some ten bits of 64, texts that share a band of
    min-hashes.  Each is compared with the least node of its group, which
    joins most of what belongs together but not all: texts that share a
    shingle of their prefixes, as all pairs that are ``least`` alike do, are
    then compared in blocks unless they are one component by now.  Every link
    is checked on the whole texts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(node_col).alias("node"), F.col(text_col).alias("text"))
    common, count = _common(texts, k)
    width = -np.log(least) * (1 + 1e-9) or 1.0

    def sketch(texts: pa.Array) -> pa.Array:
        columns: dict[str, list] = {"code": [], "bands": [], "size": [], "length": [], "prefix": []}
        for text in texts:
            values, sizes = sized_shingles(text.as_py(), k)
            columns["code"].append(simhash(values))
            columns["bands"].append(band_values(min_hashes(values)))
            columns["size"].append(len(values))
            # The length is the shingles' number in steps of 1 / ``least``: of texts that are alike it differs by one at most.
            columns["length"].append(int(np.log(max(len(values), 1)) / width))
            columns["prefix"].append(prefix(values, least, common, count, sizes).view(np.int64))
        ends = np.cumsum([0, *map(len, columns["prefix"])]).astype(np.int32)
        prefixes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *columns["prefix"]])))
        return pa.StructArray.from_arrays([pa.array(columns["code"], pa.int64()), pa.array(columns["bands"], pa.list_(pa.int64())), pa.array(columns["size"], pa.int32()), pa.array(columns["length"], pa.int32()), prefixes], list(columns))

    sketched = texts.select("node", F.arrow_udf(sketch, "code long, bands array<long>, size int, length int, prefix array<long>")("text").alias("s"))
    sketched, sketched_path = written(sketched.select("node", "s.*"), "sketches")
    sizes = sketched.select("node", "size", "length")
    most = max(DEALT, int((sizes.agg(F.sum("size")).first()[0] or 0) * DEALT_SHARE))
    codes, codes_path = written(sketched.groupBy("code").agg(F.min("node").alias("least")), "codes")
    by_code = hamming_links(codes.select("code"), radius).join(codes.withColumnsRenamed({"code": "a", "least": "x"}), "a").join(codes.withColumnsRenamed({"code": "b", "least": "y"}), "b")
    pairs = by_code.select(F.col("x").alias("a"), F.col("y").alias("b"))
    rows = sketched.select("node", F.posexplode("bands").alias("band", "value")).unionByName(sketched.select("node", F.lit(-1).alias("band"), F.col("code").alias("value")))
    groups, groups_path = written(rows.groupBy("band", "value").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1").drop("n"), "groups")
    first = rows.join(groups, ["band", "value"]).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = _stars(first.unionByName(pairs), sizes, texts, least, k, most)
    roots, roots_path = written(components(found, "a", "b"), "roots")
    found = found.unionByName(_blockwise(sketched, sizes, roots, texts, least, k, most))
    for done in (sketched_path, codes_path, groups_path, roots_path):
        drop_path(spark, done)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: of each component of ``similar_links`` the smallest id stays (null ids last).

    Null texts count as empty, and texts without words are alike.  Rows that
    repeat both id and text are one node: all of them stay or go.  An empty
    table gives an empty result; any other columns are passed on.
    """
    node = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(node.alias("node"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rooted, _ = written(components(similar_links(rows, "node", "text", k, least, radius), "a", "b"), "roots")
    ranked = rooted.join(rows.select("node", "id"), "node").select("node", "root", F.struct(F.col("id").isNull().alias("none"), "id", "node").alias("rank"))
    ranked, _ = written(ranked, "ranked")
    best, _ = written(ranked.groupBy("root").agg(F.min("rank").alias("best")), "best")
    gone, _ = written(ranked.join(best, "root").filter(F.col("node") != F.col("best.node")).select(F.col("node").alias("gone_node")).distinct(), "gone")
    return docs.join(_small(gone), node == F.col("gone_node"), "left_anti")
