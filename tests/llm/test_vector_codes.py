"""Vector codes against plain k-means in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from decklake.llm import vector_codes


def plain(rows, parts, entries, rounds):
    """rows: (id, label, vector), in the order of ids; code, error of each and all entries."""
    whole = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in rows]
    width = len(whole[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, _, v in whole[:entries]] for p in range(parts)]
    best = lambda v, p: min((away(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        after = []
        for p in range(parts):
            groups = {}
            for _, _, v in whole:
                groups.setdefault(best(v, p)[1], []).append(cut(v, p))
            after.append([[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])])
        books = after
    coded = []
    for i, lab, v in whole:
        found = [best(v, p) for p in range(parts)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    return coded, hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()


def test_search_is_exact():
    rng = np.random.default_rng(1)
    for size, width, high in ((16, 4, 1000), (16, 2, 4), (1, 3, 50), (2, 1, 3), (40, 8, 3), (16, 0, 5)):
        entries = rng.integers(-high, high, (5, size, width))
        entries[2] = entries[2, 0]  # equal entries: the first is taken
        x = rng.integers(-high, high, (700, 5, width))
        all_gaps = ((x[:, :, None, :] - entries[None]) ** 2).sum(-1)
        found, away = vector_codes.Codebooks(entries).nearest(x)
        assert (found == all_gaps.argmin(-1)).all() and (away == all_gaps.min(-1)).all()


def test_search_looks_at_few_entries(monkeypatch):
    """Clustered queries: most entries lie beyond twice the distance and are never compared."""
    rng = np.random.default_rng(2)
    entries = rng.integers(-100_000, 100_000, (1, 64, 4))
    x = entries[0, rng.integers(0, 64, 2000)][:, None, :] + rng.integers(-50, 50, (2000, 1, 4))
    books, looked = vector_codes.Codebooks(entries), 0
    plain_nearest = books._search

    class Counting(np.ndarray):
        def __getitem__(self, key):
            nonlocal looked
            if isinstance(key, tuple) and len(key) == 2 and isinstance(key[0], np.ndarray):
                looked += len(key[0])
            return np.asarray(super().__getitem__(key))

    books.entries = entries.view(Counting)
    found, _ = plain_nearest(x.reshape(-1, 4), np.zeros(2000, dtype=np.int64))
    assert (found == ((x - entries) ** 2).sum(-1).argmin(-1)).all()
    assert looked < 2000 * 64 / 2


KIND = "vec_id long, embedding array<float>, label int, code string, error int"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, lab, "own", 1) for i, lab, v in rows], KIND).repartition(parts)


@pytest.mark.parametrize("n, wide, spread", [(300, 16, 1.0), (40, 8, 0.001), (9, 24, 2.0)])
def test_against_plain_rounds(spark, n, wide, spread):
    rng = random.Random(n)
    centres = [[rng.gauss(0, 1) for _ in range(wide)] for _ in range(6)]
    single = lambda x: float(np.float32(x))
    rows = [(3 * i, rng.choice([0, 1, None]), [single(c + rng.gauss(0, spread)) for c in rng.choice(centres)]) for i in range(n)]
    odd = [(1, 0, None), (2, 1, [None] * wide), (4, 1, [float("nan")] + [0.0] * (wide - 1)), (5, None, [float("-inf")] * wide)]
    coded, digest = plain(rows, 8, 16, 6)
    found = vector_codes.compress(table(spark, rows + odd))
    assert found.columns == ["vec_id", "label", "code_in", "error_in", "code", "error", "label_error", "codebooks_sha256"]
    sums = {lab: sum(e for _, _, e, x in coded if x == lab) for lab in {x for *_, x in coded}}
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()) == [(i, c, e, sums[lab], digest) for i, c, e, lab in coded]
    again = vector_codes.compress(table(spark, rows[::-1] + odd, 11)).first()
    assert again.codebooks_sha256 == digest


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(k, 1, [float(k % 5)] * 8) for k in range(30)] * 3 + [(None, None, [9.0] * 8)] * 40
    found = vector_codes.compress(table(spark, rows), label_col=None).collect()
    assert len(found) == 130 and "label_error" not in found[0].asDict()
    assert len({r.code for r in found}) == 6 and sum(r.error for r in found if r.vec_id is not None) == 0
    none = vector_codes.compress(table(spark, [(1, 1, None)]))
    assert none.count() == 0 and none.dtypes[-4:] == [("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]


def test_lengths_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, 1, [0.5] * 8), (2, 1, [0.5] * 16)]))
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, 1, [0.5] * 9)]))
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, 1, [0.5] * 8)]), entries=300)


def test_huge_components_stay_whole_numbers(spark):
    found = vector_codes.compress(table(spark, [(k, 0, [3.0e38 * (-1) ** k] * 8) for k in range(40)])).collect()
    assert {r.error for r in found} == {0} and len({r.code for r in found}) == 2


def test_decode(spark):
    books = np.arange(8 * 16 * 2).reshape(8, 16, 2)
    df = spark.createDataFrame([("00" * 8,), ("0f" * 8,)], "code string")
    got = [r.vector for r in vector_codes.decode(df, books, 4).orderBy("code").collect()]
    assert got == [(books[:, k] / 4).reshape(-1).tolist() for k in (0, 15)]
