"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 7).

Of all token sequences that spell a byte string, the one that the merges give
is the only one in which every two neighbours would stay apart if merged on
their own.  So each prefix has exactly one valid last token: the one that ends
the prefix, and that keeps apart from the valid last token of what is before
it.  These last tokens are all that is stored; the encoding is read off
backwards.  A longer text only adds entries, and an edit changes entries from
its place on until they agree again with those from before.

Texts in bulk go through the same entries in numpy: all words of a batch that
aren't known yet move on by one byte at a time, with the tokens' beginnings as
an automaton and the pairs of tokens known so far as a hash table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .common import make_room
from .token_counts import UNIT

#: Encoded units, and pairs of tokens known to stay apart or not, that a worker keeps; longest unit kept, and longest piece, in bytes, that goes with others.
CACHED, PAIRS, LONGEST, TOGETHER = 120_000, 300_000, 48, 32
#: Characters of text that are encoded and handed back at a time; pieces that go through the entries together.
SLICE, PIECES = 1 << 20, 32_768


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def _halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens whose merge makes each token of two bytes or more, by merging its bytes below its own rank."""
    made = {}
    for whole, rank in ranks.items():
        if len(whole) < 2:
            continue
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            made[rank] = (ranks[parts[0]], ranks[parts[1]])
    return made


class Vocabulary:
    """Ranks, which tokens end a prefix, and which tokens stay apart as neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.spelt: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.spelt[rank] = token
        self.size = [len(x) for x in self.spelt]
        self.first, self.second = [-1] * len(self.spelt), [-1] * len(self.spelt)
        for rank, (a, b) in _halves(ranks).items():
            self.first[rank], self.second[rank] = a, b
        # The token that is the longest proper suffix of each token: the tokens that end a prefix are a chain of these.
        self.shorter = [-1] * len(self.spelt)
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[i:]] for i in range(1, len(token)) if token[i:] in ranks), -1)
        # Of everything that some token begins with, the longest token at its end.
        begun = sorted({token[:i] for token in ranks for i in range(1, len(token) + 1)}, key=len)
        self.ending: dict[bytes, int] = {}
        for x in begun:
            found = ranks.get(x)
            self.ending[x] = next((self.ending[x[i:]] for i in range(1, len(x)) if x[i:] in self.ending), -1) if found is None else found
        self.known: dict[int, bool] = {}

    def own(self, token: int) -> bool:
        """Whether the token's bytes are encoded as this token."""
        return self.size[token] == 1 or self.first[token] >= 0

    def apart(self, left: int, right: int) -> bool:
        """``separate``, remembered."""
        if len(self.known) >= 20_000:
            self.known.clear()
        found = self.known[left << 32 | right] = self.separate(left, right)
        return found

    def separate(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens that stand side by side.

        The two are taken apart along the border in the reverse order of the
        merges that made them; a merge across the border is done if it comes
        before the merge last taken back.
        """
        a, b, spelt, ranks, first, second = left, right, self.spelt, self.ranks, self.first, self.second
        bound, found = len(spelt) + 1, None
        while found is None:
            across = ranks.get(spelt[a] + spelt[b])
            if across is not None and across < bound:
                found = False
            elif first[a] < 0 and first[b] < 0:
                found = True
            elif first[b] < 0 or first[a] >= 0 and a > b:
                bound, a = a, second[a]  # among equal ranks the left one is merged first
            else:
                bound, b = b + 1 if a != b else b, first[b]
        return found


class PrefixEncoding:
    """The valid last token of every prefix of some bytes.

    ``reach`` is how many bytes at the end some token begins with: the tokens
    that end a prefix are found from these in one lookup.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", last: list[int] | tuple[int, ...] = (), reach: int = 0):
        """``last`` and ``reach`` may be those of a text that ``data`` goes on from."""
        self.vocabulary, self.data, self.last, self.reach = vocabulary, data, list(last), reach
        self._extend(len(data))

    def _extend(self, stop: int) -> None:
        """Add the entries up to that of ``data[:stop]``."""
        v, data, last, reach = self.vocabulary, self.data, self.last, self.reach
        ending, known, size, shorter, add = v.ending.get, v.known.get, v.size, v.shorter, last.append
        for end in range(len(last) + 1, stop + 1):
            reach += 1
            token = ending(data[end - reach : end])
            while token is None:
                reach -= 1
                if not reach:
                    raise ValueError("a byte without a token")
                token = ending(data[end - reach : end])
            while token >= 0:
                start = end - size[token]
                if start:
                    pair = last[start - 1] << 32 | token
                    fits = known(pair)
                    if fits or fits is None and v.apart(pair >> 32, token):
                        break
                elif v.own(token):
                    break
                token = shorter[token]
            else:
                raise ValueError("a byte without a token")
            add(token)
        self.reach = reach

    def append(self, more: bytes) -> None:
        """Nothing that is stored changes."""
        self.data += more
        self._extend(len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of data[start:end]; the number of entries that were worked out."""
        before, v = self.last, self.vocabulary
        self.data = self.data[:start] + new + self.data[end:]
        self.last = before[:start]
        self.reach = next((n for n in range(min(start, v.longest), 0, -1) if self.data[start - n : start] in v.ending), 0)
        same, edge = 0, start + len(new)
        for at in range(start + 1, len(self.data) + 1):
            self._extend(at)
            # An entry depends on the bytes and entries of one longest token before it.
            same = same + 1 if at > edge and before[at - 1 - len(new) + end - start] == self.last[-1] else 0
            if same >= v.longest:
                self.last += before[at - len(new) + end - start :]
                size = len(self.data)
                self.reach = next(n for n in range(min(size, v.longest), 0, -1) if self.data[size - n :] in v.ending)
                return at - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, at, last, size = [], len(self.data), self.last, self.vocabulary.size
        while at:
            token = last[at - 1]
            out.append(token)
            at -= size[token]
        return out[::-1]


class IntTable:
    """Open addressing from distinct whole numbers to whole numbers from 0 on, many at a time."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if self.held + len(keys) > len(self.keys) // 2:
            raise ValueError("the table is full")
        self.held += len(keys)
        at, last = self._slot(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], at[~won] + 1 & last

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        at, last = self._slot(keys), len(self.keys) - 1
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & last
            held = self.keys[at[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (held >= 0)]
        return out


class Automaton:
    """The entries of many short byte strings at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        node = {x: k + 1 for k, x in enumerate(v.ending)}
        node[b""] = 0
        self.longest = np.array([-1, *v.ending.values()], dtype=np.int32)
        self.back = np.zeros(len(node), dtype=np.int32)  # the node of the longest proper suffix that is one
        below: dict[tuple[int, int], int] = {(node[x[:-1]], x[-1]): k for x, k in node.items() if k}
        for x, k in node.items():  # shorter ones come first
            if len(x) > 1:
                at = int(self.back[node[x[:-1]]])
                while (at, x[-1]) not in below and at:
                    at = int(self.back[at])
                self.back[k] = below.get((at, x[-1]), 0)
        self.step = IntTable(max(4, len(below).bit_length() + 2))
        self.step.put(np.array([a << 8 | b for a, b in below], dtype=np.int64), np.array(list(below.values()), dtype=np.int32))
        self.size, self.shorter = np.array(v.size, dtype=np.int32), np.array(v.shorter, dtype=np.int32)
        self.own = np.array([v.own(k) for k in range(len(v.size))])
        self.pairs = IntTable((2 * PAIRS).bit_length())

    def fits(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the tokens stay apart; what isn't known yet is worked out once for each pair."""
        keys = left.astype(np.int64) << 32 | token
        found = self.pairs.get(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            pairs, where = np.unique(keys[new], return_inverse=True)
            apart = np.array([self.vocabulary.separate(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()], dtype=np.int32)
            if self.pairs.held + len(pairs) > PAIRS:
                self.pairs = IntTable(max(self.pairs.bits, (2 * len(pairs)).bit_length()))
            self.pairs.put(pairs, apart)
            found[new] = apart[where]
        return found == 1

    def encode(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings of ``sizes`` bytes that ``data`` consists of, one after the other, and the number of each one's ids."""
        order = np.argsort(-sizes, kind="stable")
        start, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        longest = int(size[0])
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        letters = np.frombuffer(data, dtype=np.uint8)
        last = np.zeros((len(size), longest), dtype=np.int32)
        node = np.zeros(len(size), dtype=np.int64)
        for t, n in enumerate(alive.tolist()):
            letter, at = letters[start[:n] + t].astype(np.int64), node[:n]
            after = self.step.get(at << 8 | letter)
            todo = np.flatnonzero(after < 0)
            at = at[todo]
            while len(todo):
                if not at.all():
                    raise ValueError("a byte without a token")
                at = self.back[at].astype(np.int64)
                after[todo] = found = self.step.get(at << 8 | letter[todo])
                todo, at = todo[found < 0], at[found < 0]
            node[:n] = after
            token = self.longest[after]
            todo = np.arange(n)
            while len(todo):
                own = token[todo]
                begin = t + 1 - self.size[own]
                good = self.own[own]
                inner = np.flatnonzero(begin)
                good[inner] = self.fits(last[todo[inner], begin[inner] - 1], own[inner])
                todo = todo[~good]
                token[todo] = self.shorter[token[todo]]
                if (token[todo] < 0).any():
                    raise ValueError("a byte without a token")
            last[:n, t] = token
        out, count, left = np.zeros((len(size), longest), dtype=np.uint32), np.zeros(len(size), dtype=np.int64), size.copy()
        todo = np.arange(len(size))
        while len(todo):
            token = last[todo, left[todo] - 1]
            count[todo] += 1
            out[todo, longest - count[todo]] = token
            left[todo] -= self.size[token]
            todo = todo[left[todo] > 0]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        out, count = out[back], count[back]
        return out[np.arange(longest) >= longest - count[:, None]], count


class Encoder:
    """Texts to ids and back: each match of ``pattern`` is encoded on its own; units are remembered.

    When what is remembered is full, what wasn't asked for since it was last
    half full goes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.automaton = Automaton(self.vocabulary)
        self.split = regex.compile(pattern)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _together(self, units: list[str]) -> list[bytes]:
        """Ids of ``units``, as bytes."""
        pieces = [[p.encode("utf-8") for p in found] for found in map(self.split.findall, units)]
        out: list[bytes] = []
        short = [not found or max(map(len, found)) <= TOGETHER for found in pieces]
        flat = [p for found, few in zip(pieces, short) if few for p in found]
        ids, counts = [b""], [np.zeros(1, dtype=np.int64)]
        for at in range(0, len(flat), PIECES):
            part = flat[at : at + PIECES]
            some, count = self.automaton.encode(b"".join(part), np.fromiter(map(len, part), dtype=np.int64, count=len(part)))
            ids.append(some.astype("<u4").tobytes())
            counts.append(count)
        joined, ends, at = b"".join(ids), (4 * np.cumsum(np.concatenate(counts))).tolist(), 0
        for found, few in zip(pieces, short):
            if few:
                out.append(joined[ends[at] : ends[at + len(found)]])
                at += len(found)
            else:
                out.append(np.array([i for p in found for i in PrefixEncoding(self.vocabulary, p).ids()], dtype="<u4").tobytes())
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [UNIT.findall(text) for text in texts]
        found = [list(map(self.new.get, p)) for p in parts]
        open_ = [k for k, ids in enumerate(found) if None in ids]
        missing = dict.fromkeys(u for k in open_ for u, ids in zip(parts[k], found[k]) if ids is None)
        fresh = {u: ids for u in missing if (ids := self.old.get(u)) is not None}
        units = [u for u in missing if u not in fresh]
        for at in range(0, len(units), PIECES):
            some = units[at : at + PIECES]
            fresh.update(zip(some, self._together(some)))
        for k in open_:
            found[k] = [fresh[u] if ids is None else ids for u, ids in zip(parts[k], found[k])]
        kept = {u: ids for u, ids in fresh.items() if len(u) <= LONGEST}
        if len(self.new) + len(kept) > CACHED // 2:
            self.new, self.old = kept, self.new
        else:
            self.new.update(kept)
        return [b"".join(ids) for ids in found]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.spelt.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _encoder(path: str, pattern: str, held: dict = {}) -> Encoder:  # noqa: B006  one a worker
    if (path, pattern) not in held:
        held[path, pattern] = Encoder(read_ranks(path), pattern)
    return held[path, pattern]


def _sliced(texts: pa.Array, encoder: Encoder) -> Iterator[tuple[list[str], list[bytes]]]:
    """Texts and their ids, some ``SLICE`` characters at a time."""
    at, sizes = 0, pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    while at < len(texts):
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE)))
        some = texts.slice(at, end - at).to_pylist()
        yield some, encoder.encode_all(some)
        at = end


def _lists(parts: list[bytes]) -> pa.Array:
    """Ids as lists of 32-bit integers."""
    ends = np.cumsum([0, *(len(x) // 4 for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def _joined(chunks: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(chunks) if chunks else pa.array([], kind)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: array<int>, empty for null and empty texts.

    Units (see ``token_counts``) are encoded one by one; this needs a pattern
    whose matches never reach from other characters over into white space.
    Repeated rows are encoded each; an empty table gives an empty one.  A
    column of ``docs`` with the new one's name goes on as ``<name>_in``.
    """
    docs = make_room(docs, ids_col)

    def run(texts: pa.Array) -> pa.Array:
        encoder = _encoder(ranks_path, pattern)
        return _joined([_lists(ids) for _, ids in _sliced(texts, encoder)], pa.list_(pa.int32()))

    return docs.withColumn(ids_col, F.arrow_udf(run, "array<int>")(F.coalesce(F.col(text_col), F.lit(""))))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with ``bytes_col``: what the ids spell, null for null; clashing names as in ``encode``."""
    docs = make_room(docs, bytes_col)

    def run(ids: pa.Array) -> pa.Array:
        encoder = _encoder(ranks_path, pattern)
        return pa.array([None if x is None else encoder.decode(np.asarray(x, dtype="<u4").tobytes()) for x in ids.to_pylist()], pa.binary())

    return docs.withColumn(bytes_col, F.arrow_udf(run, "binary")(F.col(ids_col)))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", same_col: str = "round_trip") -> DataFrame:
    """``docs`` with ``ids_col`` as ``encode`` gives it in place of the text, and whether the ids decode to that text.

    Both in one pass: no decoded text leaves the worker, and rows leave it some
    ``SLICE`` characters of text at a time.
    """
    docs = make_room(docs, ids_col, same_col)
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            at = 0
            for some, coded in _sliced(batch.column("own_text"), encoder):
                part, at = batch.slice(at, len(some)), at + len(some)
                same = [encoder.decode(x) == text.encode("utf-8") for text, x in zip(some, coded)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), _lists(coded), pa.array(same, pa.bool_())], [*others, ids_col, same_col])

    rows = docs.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias("own_text"))
    schema = StructType([*docs.select(*others).schema, StructField(ids_col, ArrayType(IntegerType())), StructField(same_col, BooleanType())])
    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the round trip through ids; null counts as empty.

    Repeated rows are encoded each; an empty table gives an empty one;
    clashing names as in ``encode``.
    """
    docs = make_room(docs, "n_tokens", "ids_sha256", "decoded_sha256", "bpe")

    def run(texts: pa.Array) -> pa.Array:
        encoder, rows = _encoder(ranks_path, pattern), []
        for _, coded in _sliced(texts, encoder):
            rows += [{"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(encoder.decode(ids)).hexdigest()} for ids in coded]
        return pa.array(rows, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    coded = docs.withColumn("bpe", F.arrow_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.coalesce(F.col(text_col), F.lit(""))))
    return coded.select(*docs.columns, "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")
