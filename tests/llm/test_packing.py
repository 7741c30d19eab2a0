"""Packing: dominance against exhaustive search, pieces against the library, places without gaps."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from decklake.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths: list[int], capacity: int) -> int:
    """The least number of bins, by trying every set that holds the longest piece."""

    @lru_cache(None)
    def solve(left: tuple[int, ...]) -> int:
        if not left:
            return 0
        sets: set[tuple[int, ...]] = set()

        def grow(at: int, room: int, taken: tuple[int, ...]) -> None:
            sets.add(taken)
            for k in range(at, len(left)):
                if left[k] <= room:
                    grow(k + 1, room - left[k], (*taken, k))

        grow(1, capacity - left[0], (0,))
        rests = {tuple(x for k, x in enumerate(left) if k not in s) for s in sets}
        return 1 + min(map(solve, rests))

    return solve(tuple(sorted(lengths, reverse=True)))


def spread(plan: packing.Plan) -> list[list[tuple[int, int]]]:
    """(offset, length) of all pieces, sequence by sequence."""
    out = [[] for _ in range(plan.sequences)]
    for length, runs in plan.runs.items():
        for k, (rank, sequence, copies, offset) in enumerate(runs):
            end = runs[k + 1][0] if k + 1 < len(runs) else plan.used[length]
            for r in range(rank, end):
                out[sequence + (r - rank) // copies].append((offset + (r - rank) % copies * length, length))
    return out


def checked(counts: dict[int, int], capacity: int) -> packing.Plan:
    plan = packing.plan_of(dict(counts), capacity)
    found: Counter = Counter()
    for pieces in spread(plan):
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
            found[length] += 1
        assert 0 < at <= capacity
    assert found == Counter({n: c for n, c in counts.items() if c})
    return plan


def test_reduction_loses_no_bin():
    rng, fixed, small = random.Random(5), 0, 0
    for case in range(400):
        capacity = rng.choice([10, 20, 37])
        low = rng.choice([1, 2, capacity // 4, capacity // 3])
        lengths = [rng.randint(low, capacity) for _ in range(rng.randint(1, 9))]
        plan, count = packing.Plan(capacity), Counter(lengths)
        packing.reduce(count, plan)
        assert plan.sequences + fewest(list(count.elements()), capacity) == fewest(lengths, capacity), lengths
        fixed, small = fixed + plan.sequences, small + (len(list(count.elements())) < len(lengths))
        assert checked(Counter(lengths), capacity).sequences >= fewest(lengths, capacity)
    assert fixed > 400 and small > 300


def test_triples_are_fixed():
    assert packing.dominant({50: 1, 30: 1, 20: 1, 15: 1}, [15, 20, 30, 50], 50, 100) == (50, 30, 20)  # an exact pair would be one piece
    assert packing.dominant({60: 1, 25: 1, 14: 2, 13: 1}, [13, 14, 25, 60], 60, 100) == (60, 25, 14)
    assert packing.dominant({60: 1, 30: 1, 15: 1, 14: 1, 13: 1}, [13, 14, 15, 30, 60], 60, 100) == (60, 30)
    assert packing.dominant({60: 1, 20: 3, 10: 9}, [10, 20, 60], 60, 100) is None


def test_best_fit_by_whole_counts_is_best_fit():
    """Against best fit one piece at a time."""
    rng = random.Random(8)
    for _ in range(150):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(0, 120)))
        plan = packing.Plan(40)
        packing.best_fit(dict(counts), plan)
        rooms: list[int] = []
        for length in sorted(counts.elements(), reverse=True):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 40) - length)
        assert sorted(40 - sum(n for _, n in s) for s in spread(plan)) == sorted(rooms)


def test_large_counts_take_no_longer():
    rng = random.Random(2)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 1025)}
    plan = packing.plan_of(counts, 1024)
    least = max(sum(n * c for n, c in counts.items()) / 1024, sum(c for n, c in counts.items() if n > 512))
    assert plan.sequences <= least * 1.01 and sum(map(len, plan.runs.values())) < 200_000
    assert plan.used == counts


def test_ids_are_the_librarys():
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "　", " ", "<|endoftext|>", "'s", "é", "é", "12", "٣", "漢字", "😀", "_", "...", "\x00", "Zz"]
    encode, library = packing.id_function(JSON), Tokenizer.from_file(JSON)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["x" * 50_000, " " * 300_000, "\n " * 150_000]
    for text in texts:
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "The Quick brown fox, <|endoftext|> 42"
    assert packing.id_function(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "x1", "delta."]
    long = " ".join(rng.choice(words) for _ in range(40_000))
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 900)))) for k in range(150)]
    rows += [(200, long), (201, None), (202, ""), (203, "<|endoftext|>"), (3, "same id, another text"), (None, "no id"), (None, "no id"), (None, None), (7, rows[7][1])]
    return spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, piece int, sequence_id string").repartition(5)


def test_pack_whole_texts(spark, docs):
    got = packing.pack(docs, JSON, with_ids=True).collect()
    library = Tokenizer.from_file(JSON)
    wanted: Counter = Counter()
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(1024, len(ids))
        ends = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            wanted[r.doc_id, k, a, tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == wanted
    places = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
    assert sorted(places) == list(range(len(places)))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] and sum(n for _, n in p) <= 1024
    assert len(places) <= sum(r.length for r in got) / 1024 + 2
    assembled = {r.sequence_id: r for r in packing.assemble(packing.pack(docs, JSON, with_ids=True)).collect()}
    assert sum(len(r.ids) for r in assembled.values()) == sum(r.length for r in got) and max(len(r.ids) for r in assembled.values()) <= 1024
    assert all(r.starts[0] == 0 and r.starts == sorted(set(r.starts)) for r in assembled.values())


def test_pack_edges(spark, docs):
    none = packing.pack(docs.limit(0), JSON)
    assert none.count() == 0 and none.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    bare = packing.pack(spark.createDataFrame([("a", ""), ("b", "one")], "doc_id string, text string"), JSON, end=None).collect()
    assert {(r.doc_id, r.length, r.sequence_id) for r in bare} == {("a", 0, None), ("b", 1, 0)}


def test_ranks_of_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 5).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"), F.col("id").alias("row"))
    got = packing._ranked(rows, 3000).groupBy("length").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.count_distinct("rank").alias("d"), F.count("*").alias("n")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 and r.d == r.n for r in got) and sum(r.n for r in got) == 3000
