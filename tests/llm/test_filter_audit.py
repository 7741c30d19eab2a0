"""The filter audit against counting each order document by document."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from decklake.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """The set of letters that each (doc_id, text, lang) fails."""
    least: dict[str, int] = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        one = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        out.append(set(one + "E" * (doc_id is not None and doc_id > least.get(text, doc_id))))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for (doc_id, _, lang), f in zip(rows, fails(rows)):
        parts[lang or ""].append((doc_id, f))
    out, shapley = {}, Counter()
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = list(members)
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                failing = [m for m in members if x in m[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(m[1] == {x} for m in members), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone)]
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(80):
        pool = rng.sample(words, rng.choice([20, 90, 300]))
        text = " ".join(rng.choice(pool) for _ in range(rng.choice([0, 50, 199, 200, 201, 400])))
        texts.append(text + rng.choice(["", " #", " A|B", " SHOUTING" * 12, "\x0b\x0cx\x85é"]))
    texts += [None, "", "a b a b", "AAA"]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, "", "x y"])) for k in range(400)]
    rows += [(k, "copied everywhere", "en") for k in range(1000, 1300)]
    rows += [rows[3], rows[3], (5, "copied everywhere", "de"), (1000, "copied everywhere", "en"), (None, "copied everywhere", "de"), (None, None, None), (None, None, None)]
    return rows


LABELS = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 1300, 3)] + [(0, 0, 1), (7, None, 1), (8, 1, None), (None, 1, 1), (99999, 1, 1)]


def test_every_order_by_hand(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, lang string, n int, part string").repartition(7)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in NAMES) for r in found} == brute(rows, LABELS)
    assert len(found) == 600 * len({r[2] or "" for r in rows})
    total = {(r.part, r.filter_order[r.step - 1]): r.shapley for r in found}
    for part in {r.part for r in found}:  # efficiency: the values share out all that is removed
        last = next(r for r in found if r.part == part and r.step == 5)
        first = next(r for r in found if r.part == part and r.step == 1)
        assert sum(v for (p, _), v in total.items() if p == part) == 120 * (first.kept + first.removed - last.kept)


def test_own_filters_without_copies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "bb")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, labels, {"X": F.col("text") == "a", "Y": F.length("text") > 0}, None, part=F.lit("all")).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found} == {
        ("XY", 1): (3, 1, 0, 0, 1), ("XY", 2): (1, 2, 1, 2, 5), ("YX", 1): (1, 3, 0, 2, 5), ("YX", 2): (1, 0, 1, 0, 1),
    }


def test_long_and_no_rows(spark):
    kinds = "doc_id long, text string, lang string"
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], kinds), none).count() == 0
    long = [(1, "x y " * 2_000_000, "en"), (2, "Ab" * 3_000_000, "en"), (3, "x y " * 2_000_000, "en")]
    found = filter_audit.audit(spark.createDataFrame(long, kinds), none).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant) for r in found] == [(2, 1, 0), (0, 2, 0), (0, 0, 1), (0, 0, 0), (0, 0, 1)]


def test_copies_are_one_row_a_part(spark):
    """A text that most documents share reaches the last aggregate once for each task and part."""
    docs = spark.range(0, 60_000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    found = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("filter_order = 'EABCD' AND step = 1").first()
    assert (found.removed, found.kept) == (40_000 - 1, 20_001)
