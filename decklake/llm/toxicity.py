"""Toxicity from the nearest labelled examples by exact TF-IDF cosine (operator 2).

Terms are all words of the examples; no word is left out.  A term's weight is
its inverse document frequency among all labelled texts times what the word
tells about the label there (its information gain, with a prior count), so that
neighbours are alike in what matters and not just in language.  Examples are
stored in a block-max inverted index: each term's postings are cut into blocks
of examples, with the largest weight of each block.  A query adds up these
largest weights into a bound for each block and opens blocks from the highest
bound down, until no bound reaches the k-th similarity found.  The votes of
the nearest examples, weighted by similarity, are calibrated on the examples
themselves, each left out of its own vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import drop_path, fold_of, make_room, written

WORDS = re.compile(r"\w+")
#: Examples of each class in the index at most (drawn by a hash of the id), nearest ones that vote, examples of a block.
EXAMPLES, NEAREST, BLOCK = 1_000, 25, 64
#: Texts that a word is taken to have been in besides, labelled as all are.
PRIOR = 2.0
#: Labelled ids up to this number are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 2_000_000


def _bag(text: str) -> Counter:
    return Counter(WORDS.findall(text.lower()))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, t, y) of the texts that may be learnt from."""
    rows = labels.filter((fold_of("doc_id") != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    rows = F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows
    return docs.filter(fold_of("i") != 0).join(rows, F.col("i") == F.col("doc_id")).select("i", F.coalesce("t", F.lit("")).alias("t"), "y")


def _word_texts(rows: DataFrame) -> DataFrame:
    """(word, a, b): texts of class 1 and of class 0 with each word, added up in each task first."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pd.DataFrame:
            words = list(seen[0].keys() | seen[1].keys())
            return pd.DataFrame({"word": pd.Series(words, dtype=object), "a": pd.Series([seen[1][w] for w in words], dtype="int64"), "b": pd.Series([seen[0][w] for w in words], dtype="int64")})

        for batch in batches:
            for text, y in zip(batch["t"], batch["y"]):
                seen[y].update(set(WORDS.findall(text.lower())))
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield rows()
                    seen[0].clear()
                    seen[1].clear()
        yield rows()

    return rows.select("t", "y").mapInPandas(count, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def term_weights(a: np.ndarray, b: np.ndarray, ones: int, zeros: int) -> np.ndarray:
    """Inverse document frequency times information gain of words that ``a`` texts of class 1 and ``b`` of class 0 have, of ``ones`` and ``zeros`` in all.

    The gain is the divergence of the word's labels from all texts' labels,
    by text; ``PRIOR`` texts with the common share of labels go with each
    word's, so that a word of one text says little.
    """
    n, total = a + b, ones + zeros
    share = min(max(ones / max(1, total), 0.5 / (total + 1)), 1 - 0.5 / (total + 1))
    p = (a + PRIOR * share) / (n + PRIOR)
    gain = n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
    return (np.log((1 + total) / (1 + n)) + 1) * gain


class Index:
    """Block-max inverted index over unit vectors (terms, weights); examples in order of id."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, terms: int):
        self.ids, self.labels, self.weights, self.size = ids, labels, weights, len(ids)
        self.blocks = -(-max(1, self.size) // BLOCK)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, dtype=np.int64)
        doc = np.repeat(np.arange(self.size), [len(t) for t, _ in vectors])
        order = np.lexsort((doc, term))
        self.doc = doc[order].astype(np.int32)
        self.w = (np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0))[order]
        self.until = np.searchsorted(term[order], np.arange(terms), side="right").astype(np.int32)
        self._cells()

    def _cells(self) -> None:
        """Of each term and block, where its postings begin (they are neighbours), and its largest weight."""
        terms = len(self.until)
        cell = np.repeat(np.arange(terms), np.diff(self.until, prepend=0)) * self.blocks + self.doc // BLOCK
        self.first = np.searchsorted(cell, np.arange(terms * self.blocks + 1)).astype(np.int32)
        self.most = np.zeros(terms * self.blocks)
        np.maximum.at(self.most, cell, self.w)
        self.most = self.most.reshape(terms, self.blocks)

    def __getstate__(self) -> dict:
        """Postings alone are sent; each worker makes its own table of blocks."""
        return {k: v for k, v in self.__dict__.items() if k not in ("first", "most")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._cells()

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(similarity, example) of the ``k`` most similar ones, of ties the smallest id; only similarities above 0."""
        if not len(terms) or not self.size:
            return []
        bound = np.round(weights @ self.most[terms], 9)
        order = np.lexsort((np.arange(self.blocks), -bound))
        order = order[bound[order] > 0]
        sims, ids = np.zeros(0), np.zeros(0, dtype=np.int64)
        at, step = 0, 8
        while at < len(order):
            if len(ids) == k:
                # Blocks of equal bounds stand in order of their examples.
                best, block = bound[order[at]], order[at]
                if best < sims[-1] or best == sims[-1] and block * BLOCK > ids[-1]:
                    break
            opened = order[at : at + step]
            at, step = at + step, step * 2
            cell = (terms[:, None] * self.blocks + opened).reshape(-1)
            start = self.first[cell]
            size = self.first[cell + 1] - start
            used = np.flatnonzero(size)
            start, size = start[used], size[used]
            here = np.repeat(start - np.cumsum(size, dtype=np.int32) + size, size) + np.arange(size.sum(), dtype=np.int32)
            sums = np.bincount(self.doc[here], weights=np.repeat(weights[used // len(opened)], size) * self.w[here], minlength=self.size)
            # Of what is new, only what reaches the k-th of it and of what is held can stay; equals do.
            sums = np.round(sums, 9)
            least = sims[-1] if len(ids) == k else 0.0
            if np.count_nonzero(sums > least) > k:
                least = max(least, np.partition(sums, -k)[-k])
            hit = np.flatnonzero((sums >= least) & (sums > 0))
            sims, ids = np.concatenate((sims, sums[hit])), np.concatenate((ids, hit))
            first = np.lexsort((ids, -sims))[:k]
            sims, ids = sims[first], ids[first]
        return [(s, i) for s, i in zip(sims.tolist(), ids.tolist()) if s > 0]


def unit(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights) of length 1, terms rising; a text whose terms all weigh nothing has none."""
    order = np.argsort(terms)
    terms, raw = terms[order], (1 + np.log(counts[order])) * weight[terms[order]]
    terms, raw = terms[raw > 0], raw[raw > 0]
    return terms, raw / np.sqrt((raw * raw).sum()) if len(raw) else raw


class Model:
    def __init__(self, terms: list[str], weight: np.ndarray, index: Index, steps: tuple[np.ndarray, np.ndarray], without: float):
        self.at = {w: k for k, w in enumerate(terms)}
        self.weight, self.index, self.steps, self.without = weight, index, steps, without

    def vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        """What of a text the index knows; words of no labelled text tell nothing of the label, and weigh nothing."""
        get = self.at.get
        terms = np.array([get(w, -1) for w in bag], dtype=np.int64)
        known = terms >= 0
        return unit(terms[known], np.fromiter(bag.values(), dtype=np.int64, count=len(bag))[known], self.weight)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of class 1 among the nearest, weighted by similarity and by how many texts an example stands for."""
        s = np.array([x for x, _ in near])
        i = np.array([j for _, j in near])
        w = s * self.index.weights[i]
        return float((w * self.index.labels[i]).sum() / w.sum())

    def score(self, bag: Counter) -> tuple[float, list[tuple[float, int]], np.ndarray]:
        terms, weights = self.vector(bag)
        near = self.index.nearest(terms, weights, NEAREST)
        if not near:
            return self.without, near, terms
        return float(np.interp(self.vote(near), *self.steps)), near, terms[np.argsort(-weights, kind="stable")]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising function."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    table = np.array(pools)
    return table[:, 0] / table[:, 2], (table[:, 1] + 0.5 * table[:, 1] / table[:, 2]) / (table[:, 2] + 0.5)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """``docs``: i (id), t (text); ``labels``: doc_id, toxic.  Rows of fold 0 are never looked at.

    The index holds up to ``EXAMPLES`` texts of each class, drawn by a hash,
    and weights them by how many they stand for.  Its terms are all words of
    these texts, with their frequencies in all labelled texts.
    """
    spark, rows = docs.sparkSession, _labelled(docs, labels)
    sizes = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    without = (ones + 0.05) / (ones + zeros + 1.0)
    share = F.when(F.col("y") == 1, F.lit(min(1.0, EXAMPLES / max(1, ones)))).otherwise(F.lit(min(1.0, EXAMPLES / max(1, zeros))))

    def bags(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, y, list(bag), list(bag.values())) for i, y, bag in ((i, y, _bag(t)) for i, t, y in zip(batch["i"], batch["t"], batch["y"]))]
            yield pd.DataFrame(out, columns=["i", "y", "words", "n"])

    drawn = rows.filter(F.pmod(F.xxhash64("i", F.lit("toxic")), F.lit(1 << 30)) < share * (1 << 30))
    # Rows that repeat an id are one example: the first by its label and text.
    drawn = drawn.groupBy("i").agg(F.min(F.struct("y", "t")).alias("x")).select("i", "x.*")
    examples, path = written(drawn.mapInPandas(bags, "i long, y int, words array<string>, n array<long>"), "examples")
    words = examples.select(F.explode("words").alias("word")).distinct()
    counted = _word_texts(rows).join(words, "word", "left_semi").toArrow().to_pandas().sort_values("word")
    terms = counted["word"].tolist()
    weight = term_weights(counted["a"].to_numpy(float), counted["b"].to_numpy(float), ones, zeros)
    found = examples.toArrow().to_pandas().sort_values("i")
    drop_path(spark, path)
    labels_of, weights = found["y"].to_numpy(float), np.ones(len(found))
    for y, n in ((0, zeros), (1, ones)):
        weights[labels_of == y] = n / max(1, (labels_of == y).sum())
    model = Model(terms, weight, None, (np.array([0.0, 1.0]), np.array([0.0, 1.0])), without)
    vectors = [model.vector(Counter(dict(zip(w, n)))) for w, n in zip(found["words"], found["n"])]
    model.index = Index(vectors, found["i"].to_numpy(np.int64), labels_of, weights, len(terms))
    if len(found):
        votes = _left_out_votes(spark, vectors, model).toArrow().to_pandas()
        votes = votes[votes["vote"].notna()].sort_values(["vote", "label", "weight"])
        if len(votes):
            model.steps = isotonic(votes["vote"].to_numpy(), votes["label"].to_numpy(), votes["weight"].to_numpy())
    return model


def _left_out_votes(spark, vectors: list[tuple[np.ndarray, np.ndarray]], model: Model) -> DataFrame:
    """(vote, label, weight): what an example's nearest others say of it."""
    shared = spark.sparkContext.broadcast((model, vectors))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, vectors = shared.value
        for batch in batches:
            out = []
            for k in batch["id"].tolist():
                near = [x for x in model.index.nearest(*vectors[k], NEAREST + 1) if x[1] != k][:NEAREST]
                out.append((model.vote(near) if near else None, float(model.index.labels[k]), float(model.index.weights[k])))
            yield pd.DataFrame(out, columns=["vote", "label", "weight"], dtype=float)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, len(vectors), 1, tasks).mapInPandas(run, "vote double, label double, weight double")


def score(docs: DataFrame, model: Model, text_col: str = "t", result_col: str = "toxicity", evidence: int = 5) -> DataFrame:
    """``docs`` with ``result_col``: score (0 to 1), and the evidence: the ``evidence`` heaviest terms, and ids and similarities of the nearest examples.

    A text without any term, empty and null ones too, has no neighbour and
    scores as labelled texts are labelled on the whole; with no labelled text
    of both classes all terms weigh nothing, and every text does.  Repeated
    rows are scored each; an empty table gives an empty one.  A column of
    ``docs`` with the new one's name goes on as ``<name>_in``.
    """
    docs = make_room(docs, result_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.DataFrame:
        model, out = shared.value, []
        words, known = list(model.at), {}  # copies in a batch are scored once
        for text in texts:
            if text not in known:
                value, near, terms = model.score(_bag(text))
                known[text] = (value, [words[t] for t in terms[:evidence].tolist()], [{"doc_id": int(model.index.ids[i]), "similarity": s} for s, i in near[:evidence]])
            out.append(known[text])
        return pd.DataFrame(out, columns=["score", "terms", "nearest"])

    kind = "score double, terms array<string>, nearest array<struct<doc_id:long,similarity:double>>"
    return docs.withColumn(result_col, F.pandas_udf(run, kind)(F.coalesce(F.col(text_col), F.lit(""))))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, terms, nearest) of each row of ``docs`` (doc_id, text); see ``learn`` and ``score``.

    Repeated rows are scored each; of repeated labels the larger counts.
    """
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"))
    found = score(rows, learn(rows, labels))
    return found.select(F.col("i").alias("doc_id"), (fold_of("i") == 0).alias("held_out"), "toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), "toxicity.terms", "toxicity.nearest")
