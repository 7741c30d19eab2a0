"""The corpus pipeline against a brute-force version of each stage, on odd rows."""

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from decklake.llm import byte_bpe, simhash
from decklake.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def rows():
    rng = random.Random(21)
    word = {"aa": lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))), "bb": lambda: "".join(rng.choice("vwxyz") for _ in range(rng.randrange(2, 7)))}
    out = []
    for k in range(60):
        lang = "ab"[k % 2] * 2
        out.append((k, " ".join(word[lang]() for _ in range(rng.randrange(20, 90))), lang, f"s{k % 3}"))
    out += [(100 + k, out[k][1].replace(" ", "  ", 3), "aa", "s0") for k in range(5)]  # equal but for white space
    for k in range(6):  # near copies
        words = out[10 + k][1].split()
        words[0] = "edited"
        out.append((200 + k, " ".join(words), out[10 + k][2], "s1"))
    out += [(300, None, "aa", "s0"), (301, "", None, None), (302, "12 34 ...", "aa", "s0"), (303, "\u4f60\u597d" * 20, None, "s1"), (304, out[0][1], "aa", None), (304, out[0][1], "aa", None)]
    out += [(305, out[20][1] + " " + out[21][1], None, "s2"), (None, "abab cdcd eaea baba", "aa", "s1"), (306, " ".join(word["aa"]() for _ in range(30_000)), "aa", "s2")]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in out]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into and come out of each stage, with two columns of clashing names."""
    docs = spark.createDataFrame(rows(), SCHEMA).withColumn("kept", F.lit("own")).withColumn("Size", F.col("n_chars")).repartition(3)
    docs, _ = written(docs, "documents")
    seen = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = written(stage(spark, docs, ""), name)
        seen[name] = docs
    return seen


def key(r):
    return r.doc_id, r.text, r.source


def test_columns_pass(stages):
    assert len({tuple(stages[n].columns) for n in ("start", "language", "exact_dedup", "near_dedup", "mixing")}) == 1
    for name, docs in stages.items():
        assert {(r.kept, r.Size == r.n_chars or r.n_chars is None) for r in docs.collect()} == {("own", True)}, name


def test_language_rejects_what_no_language_was_learnt_for(stages):
    gone = Counter(map(key, stages["start"].collect())) - Counter(map(key, stages["language"].collect()))
    assert sorted(k[0] for k in gone) == [300, 301, 302, 303]


def test_one_of_equal_texts(stages):
    best = {}
    for r in stages["language"].collect():
        squeezed = "".join(c for c in r.text if c not in " \t\n\x0b\x0c\r")
        rank = (-len(r.text), float("inf") if r.doc_id is None else r.doc_id)
        best[squeezed] = min(best.get(squeezed, (rank, r.doc_id)), (rank, r.doc_id), key=lambda x: x[0])
    assert sorted(map(str, (i for _, i in best.values()))) == sorted(str(r.doc_id) for r in stages["exact_dedup"].collect())


def test_one_of_near_copies(stages):
    docs = stages["exact_dedup"].collect()
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if simhash.similarity(docs[a].text, docs[b].text, 5) >= 0.8:
                root[find(a)] = find(b)
    order = lambda i: float("inf") if docs[i].doc_id is None else docs[i].doc_id
    best = {}
    for i in range(len(docs)):
        best[find(i)] = min(best.get(find(i), i), i, key=order)
    assert len(best) < len(docs)
    assert sorted(str(docs[i].doc_id) for i in best.values()) == sorted(str(r.doc_id) for r in stages["near_dedup"].collect())


def test_mixing_takes_words_by_weight(stages):
    given, taken = stages["near_dedup"].collect(), stages["mixing"].collect()
    size = Counter()
    for r in given:
        size[r.source] += len(r.text.split())
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, rest, free = {}, sum(size.values()), set(sources)
    while free:
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        rest -= sum(3 * size[s] for s in over)
        free -= over
    got, longest = Counter(), Counter()
    for r in given:
        longest[r.source] = max(longest[r.source], len(r.text.split()))
    for r in taken:
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - target[s]) <= longest[s] for s in sources), (got, target)
    assert max(Counter(map(key, taken)).values()) <= 3 and set(map(key, taken)) <= set(map(key, given))


def test_ids_are_the_librarys_in_order(stages):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mixed, coded = stages["mixing"].collect(), stages["byte_bpe"].orderBy("training_file", "training_row").collect()
    assert len(mixed) == len(coded) and len({(r.training_file, r.training_row) for r in coded}) == len(coded)
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text))) for r in mixed)
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded) == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in coded)
    files = {f: [x.doc_id for x in g] for f, g in ((f, [r for r in coded if r.training_file == f]) for f in {r.training_file for r in coded})}
    assert sum(map(len, files.values())) == len(mixed)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and {"doc_id", "ids", "round_trip"} <= set(found.columns)
