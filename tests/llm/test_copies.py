"""Exact and near duplicates against brute force."""

import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from decklake.llm import common, exact_dedup as E, graph, simhash as S
from decklake.llm.common import SPACE

SCHEMA = "doc_id long, text string"


def squeezed(text):
    return (text or "").encode().translate(None, E.DELETED)


def brute_groups(rows):
    out = {}
    for i, t in rows:
        same = [(len(u or ""), -j, j) for j, u in rows if squeezed(u) == squeezed(t)]
        out[i] = (max(same)[2], len(same))
    return out


ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \r\n"), (7, "x" * 5000), (8, "x" * 5000 + " "), (9, "é b"), (10, "éb"), (11, "a b"), (12, "z")]


@pytest.mark.parametrize("max_bytes", [48 << 20, 300])  # the second one spills at every level
def test_exact_groups(spark, max_bytes):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.assign_groups(docs, max_bytes=max_bytes).collect()}
    assert got == brute_groups(ROWS)
    kept = sorted(r.doc_id for r in E.assign_groups(docs, max_bytes=max_bytes).filter("kept").collect())
    assert kept == sorted({k for k, _ in got.values()}) == sorted(r.doc_id for r in E.keep_one(docs).collect())


def test_colliding_digests_compare_contents(spark):
    weak = lambda content: bytes([zlib.crc32(content) % 3])
    column = lambda content: F.unhex(F.lpad(F.hex(F.crc32(content) % 3), 2, "0"))
    rows = [(i, f"text {i % 17}") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.assign_groups(docs, digest=weak, digest_column=column, max_bytes=400).collect()}
    assert got == brute_groups(rows)
    assert E.keep_one(docs, digest=weak, digest_column=column).count() == 17


def test_grace_spills_and_agrees():
    rng = random.Random(1)
    records = [((h := hashlib.sha256(c := bytes([rng.randrange(9)]) * rng.randrange(1, 40)).digest()), c, rng.randrange(5), i, 1) for i in range(2000)]
    whole, spilt = (sorted(map(tuple, (g for bucket in E.grace(iter(records), m) for g in bucket))) for m in (1 << 30, 2000))
    assert whole == spilt and sum(g[4] for g in whole) == 2000
    del h, c


def test_repeated_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a", "p"), (1, "a", "q"), (None, "a", "r"), (None, "b", "s")], "doc_id long, text string, source string")
    rows = E.assign_groups(docs).collect()
    assert sum(r.kept for r in rows) == 2 and {(r.text, r.keep_id, r.group_size) for r in rows} == {("a", 1, 3), ("b", None, 1)}
    assert E.keep_one(docs).count() == 2
    assert E.assign_groups(docs.limit(0)).count() == 0
    own = docs.withColumn("Kept", F.lit(1)).withColumn("digest", F.lit("d"))
    found = E.assign_groups(own)
    assert {"Kept_in", "digest_in", "kept", "digest"} <= set(found.columns) and {(r.Kept_in, r.digest_in) for r in found.collect()} == {(1, "d")}
    assert E.keep_one(own).columns == own.columns and E.keep_one(own).count() == 2


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    counts = [sum(xxh64_intdigest(p, 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def brute_components(prints, radius=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def texts(rng, n):
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            t = (rng.choice(rows)[1] or "").split(" ")
            t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))))
    return rows


@pytest.mark.parametrize("group", [1000, 3])  # the second one deals groups out again and again
def test_near_components(spark, group):
    rows = [*texts(random.Random(5), 120), (200, None), (201, ""), (202, "One"), (203, "one"), (204, "ONE TWO"), (205, "É é"), (206, "x " * 3000)]
    got = {r.doc_id: (r.code & (2**64 - 1), r.component_id) for r in S.near_components(spark.createDataFrame(rows, SCHEMA).repartition(3), group=group).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: p for i, (p, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == brute_components(prints)


def test_dense_cluster_of_fingerprints(spark):
    rng = np.random.default_rng(2)
    center = int(rng.integers(0, 2**63))
    codes = {center}
    while len(codes) < 400:  # within four bits of one centre: every block's value is common
        codes.add(center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    codes |= {int(x) for x in rng.integers(0, 2**63, 100)}
    df = spark.createDataFrame([(S._signed(c),) for c in codes], "code long")
    want = {S._signed(c): None for c in codes}
    roots = brute_components({S._signed(c): c for c in codes})
    for group in (1000, 60):
        links = S.hamming_links(df, 3, group)
        assert group < 1000 or links.count() <= 4 * len(codes)  # a forest a group, not all pairs
        got = {r.node: r.root for r in graph.components(links, "a", "b").collect()}
        assert {c: got.get(c, c) for c in want} == roots


def test_linked_pairs_are_all_pairs():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**64, 600, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, codes[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))]))
    codes = codes[np.argsort(S.gray_rank(codes))]
    assert (np.bitwise_count(np.diff(np.sort(S.gray_rank(codes)).astype(object)).astype(np.uint64)) >= 0).all()
    a, b = S.linked_pairs(codes, 3)
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(edges.limit(0), "a", "b").count() == 0


def test_one_of_near_stays(spark):
    rng = random.Random(9)
    base = [f"t{rng.randrange(10**6)}" for _ in range(200)]
    near = [list(base) for _ in range(30)]
    for k, t in enumerate(near):
        t[k * 5 % 200] = f"edit{k}"
    rows = [(i + 10, " ".join(t)) for i, t in enumerate(near)] + [(i + 100, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for i in range(20)] + [(5, None), (6, ""), (7, "short"), (8, "short")]
    # A passage that others share doesn't make them alike.
    rows += [(i + 200, " ".join(base[:60]) + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(200))) for i in range(10)]
    kept = sorted(r.doc_id for r in S.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    want = {i for i, _ in rows}
    sets = {i: set(S.shingles(t, 5)) for i, t in rows}
    root = {i: i for i in want}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in want:
        for b in want:
            x, y = sets[a], sets[b]
            if a < b and (len(x & y) / len(x | y) if x or y else 1) >= 0.8 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert kept == sorted({find(i) for i in want})
    assert SPACE


@pytest.mark.parametrize("block, small", [(1000, 64), (5, 64), (1000, 0), (5, 0)])
def test_families_that_are_hardly_alike(spark, monkeypatch, block, small):
    """Copies with one to six edits: many are alike only through others, or not at all."""
    monkeypatch.setattr(S, "BLOCK_ROWS", block)
    monkeypatch.setattr(S, "SMALL", small)
    rng = random.Random(12)
    rows = []
    for family in range(3):
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(25):
            copy = list(base)
            for at in rng.sample(range(200), rng.randrange(3, 7)):
                copy[at] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    links = S.similar_links(docs, "doc_id", "text")
    sets = [set(S.shingles(t, 5)) for _, t in rows]
    alike = {(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = [(r.a, r.b) for r in links.collect()]
    assert {(max(p), min(p)) for p in got} <= alike and len(got) < 6 * len(rows)
    roots = {}
    for pairs, name in ((alike, "all"), (got, "found")):
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        roots[name] = [find(i) for i in range(len(rows))]
    assert 3 < len(set(roots["all"])) and roots["all"] == roots["found"]


@pytest.mark.parametrize("most", [0, 20])
def test_passes_find_the_same_and_bound_what_is_dealt_out(spark, monkeypatch, most):
    """Links between texts that share a part only, in passes by shingle and by unit, joined by shuffle, and by a broadcast of the small tables alone."""
    rng = random.Random(12)
    rows = []
    for family in range(3):
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(12):
            copy = list(base)
            for at in rng.sample(range(200), rng.randrange(3, 7)):
                copy[at] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    root_of = lambda: {r.node: r.root for r in graph.components(S.similar_links(docs, "doc_id", "text"), "a", "b").collect()}
    want, parts = root_of(), {}
    for name, value in (("MOST_BROADCAST", most), ("PASS_VALUES", 1000), ("DEALT", 4000), ("DEALT_SHARE", 0.01)):
        monkeypatch.setattr(S, name, value)

    def counted(dfs, name):
        dfs = list(dfs) if name in ("live", "found") else dfs  # the others' parts are made one after the other
        parts[name] = len(dfs) if isinstance(dfs, list) else parts.get(name)
        return common.written_in_parts(dfs, name)

    monkeypatch.setattr(S, "written_in_parts", counted)
    assert root_of() == want
    assert parts["live"] > 1 and parts["found"] > 1


def test_a_written_table_leaves_no_shuffle_files(spark):
    def shuffled():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in top for f in Path(d).rglob("shuffle_*.data")}

    before = shuffled()
    df = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    for table in (common.written(df, "one")[0], common.written_in_parts([df, df.filter("k > 2")], "two")[0]):
        assert {r.k for r in table.collect()} == set(range(7))
    assert spark.conf.get(common.CLEANUP, None) is None
    for _ in range(50):  # they go a little later
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left


def edited(rng, words, edits):
    copy = list(words)
    for at in rng.sample(range(len(copy)), edits):
        copy[at] = f"e{rng.randrange(10**9)}"
    return copy


def sketch_of(words):
    values = S.shingle_set(" ".join(words), 5)
    return set(enumerate(S.band_values(S.min_hashes(values)))), S.simhash(values), set(values.tolist())


def jaccard(x, y):
    return len(x[2] & y[2]) / len(x[2] | y[2])


def test_link_through_a_text_that_left_its_group(spark):
    """A is like both L and B, B isn't like L, and wherever A and B share a band the least node L is in it."""
    rng = random.Random(3)
    rows = []
    while len(rows) < 9:
        middle = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        l, b = (edited(rng, middle, rng.randrange(3, 5)) for _ in range(2))
        x, y, z = (sketch_of(t) for t in (l, middle, b))
        far = min((p[1] ^ q[1]).bit_count() for p, q in ((x, y), (y, z), (x, z))) > 3
        if far and jaccard(x, y) >= 0.8 and jaccard(y, z) >= 0.8 > jaccard(x, z) and x[0] & y[0] and y[0] & z[0] and y[0] & z[0] <= x[0]:
            rows += [(len(rows), " ".join(l)), (len(rows) + 1, " ".join(middle)), (len(rows) + 2, " ".join(b))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    roots = {r.node: r.root for r in graph.components(S.similar_links(docs, "doc_id", "text"), "a", "b").collect()}
    assert roots == {i: i // 3 * 3 for i in range(9)}


def test_pairs_without_a_common_band(spark):
    """Texts 0.8 alike or a little more of which no band agrees, nor nearly the fingerprints; 28 of 35 shingles count as 0.8."""
    rng = random.Random(4)
    rows = []
    while len(rows) < 12:
        a = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        b = edited(rng, a, 4)
        x, y = sketch_of(a), sketch_of(b)
        if 0.8 <= jaccard(x, y) and not x[0] & y[0] and (x[1] ^ y[1]).bit_count() > 3:
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    longer = [f"v{n}" for n in range(39)]
    rows += [(12, " ".join(longer)), (13, " ".join(longer[7:]))]
    got = {r.node: r.root for r in graph.components(S.similar_links(spark.createDataFrame(rows, SCHEMA).repartition(3), "doc_id", "text"), "a", "b").collect()}
    assert got == {i: i // 2 * 2 for i in range(14)}


def test_prefixes_of_alike_sets_meet():
    rng = random.Random(5)
    for n in range(1, 60):
        x = rng.sample(range(10**9), n)
        common = np.unique(np.array(rng.sample(x, n // 2), dtype=np.uint64))
        count = np.array([rng.randrange(3, 9) for _ in common], dtype=np.int64)
        gone = rng.randrange(0, n // 5 + 1)
        y = rng.sample(x, n - gone)
        x, y = (np.unique(np.array(v, dtype=np.uint64)) for v in (x, y))
        cut = lambda v: S.prefix(v, 0.8, common, count, (v % np.uint64(7)).astype(np.int64))  # noqa: E731  sizes depend on the shingle alone
        assert set(cut(x).tolist()) & set(cut(y).tolist())
        assert len(cut(x)) == n - -(-4 * n // 5) + 1
    assert len(cut(np.zeros(0, np.uint64))) == 0


def test_shingle_sets_are_those_of_the_words():
    rng = random.Random(8)
    texts = ["", " \t", "a", "A b", "a b c d", *(" ".join(rng.choice(["a", "B", "b", "é", "c\x0bd"]) for _ in range(rng.randrange(1, 40))) for _ in range(60))]
    for a in texts:
        assert len(S.shingle_set(a, 5)) == len(set(S.shingles(a, 5)))
        for b in texts:
            assert len(np.intersect1d(S.shingle_set(a, 5), S.shingle_set(b, 5))) == len(set(S.shingles(a, 5)) & set(S.shingles(b, 5)))


def test_long_words_hash_like_any_other(spark):
    """Words on each side of every limit: the shingles beside a long word are those of a text without it."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    for size in (10, S.SPAN - 1, S.SPAN, S.SPAN + 1, S.BYTES_AT_ONCE, 5_000_000):
        x, y = (S.shingle_set(" ".join(words), 5) for words in (base, [*base, "x" * size]))
        assert len(np.intersect1d(x, y)) == len(x) == len(y) - 1
    words = [b"ab" * n for n in (1, S.SPAN // 2, S.SPAN // 2 + 1, 3 * S.SPAN)]
    words += [b"c" * (S.BYTES_AT_ONCE - 1), b"d" * S.BYTES_AT_ONCE, b"e"]
    together, sizes = S.word_hashes(words)
    assert [int(S.word_hashes([w])[0][0]) for w in words] == together.tolist() and len(set(together.tolist())) == 7 and sizes.tolist() == [len(w) for w in words]
    assert int(S._mixed(np.array([S._long_word(b"short")], dtype=np.uint64))[0]) == int(S.word_hashes([b"x", b"short"])[0][1])
    rows = [(0, " ".join(base)), (1, " ".join([*base, "x" * 5_000_000])), (2, " ".join([*base, "y" * 70_000])), (3, "z" * 5_000_000)]
    got = {r.node: r.root for r in graph.components(S.similar_links(spark.createDataFrame(rows, SCHEMA), "doc_id", "text"), "a", "b").collect()}
    assert got == {0: 0, 1: 0, 2: 0}
