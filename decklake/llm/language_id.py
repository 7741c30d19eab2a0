"""Language identification with spans (operator 4).

A word is a run of letters.  Its script, from ranges of code points, narrows
the languages to those that use it; pairs and triples of its letters, hashed
into bins, score each of them; Viterbi with a penalty for each switch labels
the words of a text, so that texts of several languages fall into spans.  All
of it runs over numpy arrays of whole batches: letters are looked up at once,
and at each step Viterbi moves all texts on by one word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fold_of, make_room

# First code points of ranges and their scripts, after Unicode's blocks.
SCRIPTS = (
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"),
    (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"),
    (0x2E00, "han"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})
STARTS = np.array([a for a, _ in SCRIPTS], dtype=np.uint32)
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS], dtype=np.uint8)

#: Bins of letter pairs and triples; learning texts of each language, about; cost of a switch; least share of its letters that makes a script one of a language's.
BINS, LEARN_ROWS, SWITCH, SCRIPT_SHARE = 1 << 16, 4000, 12.0, 0.005
#: Evidence of a word against a language that doesn't use its script.
NOT_ITS_SCRIPT = -1e4
#: Code points that are scored at a time.
CHUNK = 400_000


def _tables(held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  once a worker
    """Whether each code point is a letter, and its lower case where that is one code point."""
    if not held:
        letter, low = np.zeros(0x110000, dtype=bool), np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                letter[i], small = True, c.lower()
                low[i] = ord(small) if len(small) == 1 else i
        held["t"] = (letter, low)
    return held["t"]


def _words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Letters of all texts in a row, in lower case, with the bins of their pairs and triples, and where words begin.

    Returns (pair bins, triple bins, scripts, starts of words among letters,
    texts of words, places of words in their texts).
    """
    letter_of, lower = _tables()
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offset = np.concatenate(([0], np.cumsum(sizes + 1)))
    letter = letter_of[points]
    low = np.where(letter, lower[points], 0).astype(np.uint32)
    before = np.concatenate((np.zeros(1, np.uint32), low[:-1]))
    before2 = np.where(before > 0, np.concatenate((np.zeros(2, np.uint32), low[:-2]))[: len(low)], 0)
    at = np.flatnonzero(letter)
    begins = np.flatnonzero(before[at] == 0)
    pair = (low * np.uint32(0x9E3779B1) ^ before * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
    triple = pair ^ (before2 + np.uint32(1)) * np.uint32(0x27D4EB2F)
    triple = (triple ^ triple >> np.uint32(15)) * np.uint32(0x165667B1)
    bins = np.uint32(BINS - 1)
    place = at[begins]
    text = np.searchsorted(offset, place, side="right") - 1
    script = SCRIPT_OF[np.searchsorted(STARTS, low[at], side="right") - 1]
    return (pair[at] >> np.uint32(9)) & bins, (triple[at] >> np.uint32(9)) & bins, script, begins, text, place - offset[text]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = LEARN_ROWS) -> "Model":
    """A model from ``docs`` (all of them are learnt from): about ``rows`` texts of each language, by a hash of id and text.

    Each task adds up the bins of its texts; only the sums are shuffled and
    collected, ``2 * BINS`` numbers a language at most.
    """
    known = docs.filter(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((2 * BINS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    share = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))]), F.col(lang_col))
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("language")), F.lit(1 << 30)) < share * (1 << 30)
    number = {lang: k for k, lang in enumerate(langs)}

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(langs), 2 * BINS + len(NAMES)), dtype=np.int64)
        for batch in batches:
            for lang, part in batch.groupby("l"):
                for texts in _chunks(part["t"].tolist()):
                    pair, triple, script, *_ = _words([part["t"].iat[k] for k in texts])
                    sums[number[lang]] += np.concatenate((np.bincount(pair, minlength=BINS), np.bincount(triple, minlength=BINS), np.bincount(script, minlength=len(NAMES))))
        lang, at = np.nonzero(sums)
        yield pd.DataFrame({"lang": lang, "at": at, "n": sums[lang, at]})

    drawn_rows = known.filter(drawn).select(F.col(lang_col).alias("l"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = drawn_rows.mapInPandas(count, "lang long, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    sums = np.zeros((len(langs), 2 * BINS + len(NAMES)))
    sums[found["lang"], found["at"]] = found["n"]
    log = [np.log((sums[:, a : a + BINS] + 0.1) / (sums[:, a : a + BINS].sum(axis=1, keepdims=True) + 0.1 * BINS)) for a in (0, BINS)]
    scripts = sums[:, 2 * BINS :]
    return Model(langs, np.concatenate(log, axis=1).T.astype(np.float32), (scripts >= SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True)).T & (scripts.T > 0))


def _chunks(texts: list[str]) -> Iterator[list[int]]:
    """Indices of texts, the shortest first, in parts of about CHUNK code points: texts of a part are about as long."""
    part, held = [], 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if part and held + len(texts[k]) > CHUNK:
            yield part
            part, held = [], 0
        part.append(k)
        held += len(texts[k]) + 1
    if part:
        yield part


class Model:
    """Languages, log probabilities (bins x languages) and scripts (scripts x languages)."""

    def __init__(self, langs: list[str], log: np.ndarray, uses: np.ndarray):
        self.langs, self.log, self.uses = langs, log, uses

    def label(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(text, place, letters, language) of each word, and each text's total evidence."""
        pair, triple, script, begins, text, place = _words(texts)
        letters = np.diff(np.concatenate((begins, [len(pair)])))
        n = len(self.langs)
        emit = np.empty((len(begins), n), dtype=np.float32)
        for lang in range(n):
            one = self.log[:, lang]
            emit[:, lang] = np.add.reduceat(one[pair] + one[BINS + triple], begins) if len(begins) else 0
        allowed = self.uses[script[begins]]
        none = ~allowed.any(axis=1)
        emit -= np.where(allowed, emit, -np.inf).max(axis=1, initial=-1e30, keepdims=True) if len(begins) else 0
        emit = np.where(allowed, emit, NOT_ITS_SCRIPT).astype(np.float32)
        emit[none] = 0  # no language that was learnt uses the script: no evidence
        count = np.bincount(text, minlength=len(texts))
        return text, place, letters, _viterbi(emit, count, SWITCH), ~none


def _viterbi(emit: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; ``count`` has the words of each text, whose rows follow each other."""
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    # The number of texts that have a t-th word; they stand in front.
    alive = np.searchsorted(-count, -np.arange(1, (count[0] if len(count) else 0) + 1), side="right")
    moved = np.zeros(emit.shape, dtype=bool)
    source = np.zeros(len(emit), dtype=np.int16)
    best = np.zeros((len(count), emit.shape[1]), dtype=np.float32)
    for t, n in enumerate(alive):
        rows = start[:n] + t
        now = best[:n]
        if t:
            top = now.argmax(axis=1)
            other = now[np.arange(n), top] - switch
            moved[rows] = now < other[:, None]
            source[rows] = top
            now = np.maximum(now, other[:, None])
        best[:n] = now + emit[rows]
    label = np.zeros(len(emit), dtype=np.int16)
    state = best.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        rows = start[:n] + t
        label[rows] = state[:n]
        state[:n] = np.where(moved[rows, state[:n]], source[rows], state[:n])
    return label


RESULT = "lang_pred string, score double, known double"


def identify(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False, result_col: str = "language") -> DataFrame:
    """``docs`` with ``result_col``: lang_pred, score, known and, if asked for, spans (start, end, lang) in code points.

    The language is the one of most letters, of ties the first by name; the
    score is its share of the letters.  Letters of scripts that no language
    uses follow their neighbours; a text of nothing else scores 1 / languages.
    ``known`` is the share of letters in scripts that some language uses.
    Null, and texts without a letter, are ``und`` with score 0.  Repeated rows
    are labelled each; an empty table gives an empty one.  A column of ``docs``
    with the new one's name goes on as ``<name>_in``.
    """
    docs = make_room(docs, result_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pd.Series) -> pd.DataFrame:
        model, texts = shared.value, column.tolist()
        lang, score, known = np.full(len(texts), "und", dtype=object), np.zeros(len(texts)), np.zeros(len(texts))
        marks: list = [[] for _ in texts]
        for part in _chunks(texts) if model.langs else []:
            text, place, letters, label, evident = model.label([texts[k] for k in part])
            n = len(model.langs)
            share = np.bincount(text * n + label, weights=letters, minlength=len(part) * n).reshape(-1, n)
            total, seen = share.sum(axis=1), np.bincount(text, weights=evident * letters, minlength=len(part))
            top = share.argmax(axis=1)
            for i, k in enumerate(part):
                if total[i]:
                    lang[k] = model.langs[top[i]]
                    score[k] = share[i, top[i]] / total[i] if seen[i] else 1 / n
                    known[k] = seen[i] / total[i]
            if spans and len(text):
                cut = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (label[1:] != label[:-1]))))
                ends = np.concatenate((cut[1:], [len(text)])) - 1
                for a, b in zip(cut, ends):
                    marks[part[text[a]]].append((int(place[a]), int(place[b] + letters[b]), model.langs[label[a]]))
        out = {"lang_pred": lang, "score": score, "known": known}
        return pd.DataFrame(out | ({"spans": marks} if spans else {}))

    kind = RESULT + (", spans array<struct<start:int,end:int,lang:string>>" if spans else "")
    return docs.withColumn(result_col, F.pandas_udf(run, kind)(F.coalesce(F.col(text_col), F.lit(""))))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, known, spans): learnt from the rows of fold 1 to 4 whose language is known."""
    fold = fold_of(id_col)
    model = learn(docs.filter(fold != 0), id_col, text_col, lang_col)
    found = identify(docs.select(F.col(id_col).alias("doc_id"), (fold == 0).alias("held_out"), F.col(text_col).alias("text")), model, spans=True)
    return found.select("doc_id", "held_out", "language.*")
