"""Personal data: fixed patterns, and more spans from a linear-chain CRF (operator 5).

The patterns find e-mail and IP addresses, card and phone numbers.  A
conditional random field over word shapes adds kinds that no fixed pattern
tells apart by itself: phone numbers without a country code, identity numbers,
handles, and secrets such as keys and passwords.  It is trained from a small
labelled table (``pii_examples``), whose lines are repeated with other digits
and letters.  The model labels words with a digit, ``@`` or 16 capitals in a row and words
that name a secret, with ``BEFORE`` words before and ``AFTER`` words after them; all
others are O by definition, so a text's best path falls apart into those of
such runs.  All runs of a batch go through Viterbi together, those of one
length at a time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import make_room
from .pii_examples import LINES

# Fixed values of the contract.
LISTED = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Kinds that the model adds, after the listed ones.
ADDED = ("local_phone", "id_number", "handle", "secret")
KINDS = LISTED + ADDED
#: B- and I- of each added kind; what the patterns find is one more kind to the model, so that it isn't taken for another.
TAGS = ("O", *(f"{p}-{k}" for k in (*ADDED, "listed") for p in "BI"))
SPACES = " \t\n\x0b\x0c\r"
DIGIT = re.compile(r"[0-9]")
# Words that name a secret, in the languages of the labelled table.
NAMES = "password passwd passwort pwd passphrase kennwort contraseña mot de passe secret token api key api_key api-key bearer pin"
MARK = re.compile(r"[0-9@]|(?-i:[A-Z]{16,})|\b(?:" + "|".join(sorted({re.escape(w) for w in NAMES.split() if w not in ("mot", "de", "api", "key")} | {"api.?key", "mot de passe", "key"}, key=lambda w: (-len(w), w))) + r")\b", re.I)
BEFORE, AFTER = 2, 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Tokens of the model: words, cut at = and :.
TOKEN = re.compile(r"[=:]|[^\x20\x09-\x0D=:]+")
EDGE = ".,;!?\"'<>[]{}"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: for each @ the longest run before it and the domain after it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start, in code points."""
    found = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return found


def _word_at(text: str, at: int) -> tuple[int, int]:
    """The word around ``at``, which is none of white space."""
    start = at
    while start and text[start - 1] not in SPACES:
        start -= 1
    return start, WORD.match(text, at).end()


def _stretch(text: str, start: int, end: int) -> tuple[int, int]:
    """From ``BEFORE`` words before to ``AFTER`` words after text[start:end]."""
    for _ in range(BEFORE):
        while start and text[start - 1] in SPACES:
            start -= 1
        while start and text[start - 1] not in SPACES:
            start -= 1
    for _ in range(AFTER):
        following = WORD.search(text, end)
        end = following.end() if following else end
    return start, end


def runs_of(text: str) -> Iterator[list[tuple[int, int]]]:
    """Tokens of each run that the model labels: start and end, without punctuation at the edges."""
    hit, held = MARK.search(text), None
    while hit or held:
        reach = None
        if hit:
            start, end = _word_at(text, hit.start())
            end = max(end, hit.end())
            reach = _stretch(text, start, end)
            hit = MARK.search(text, end)
        if held and reach and reach[0] <= held[1]:
            held = held[0], max(held[1], reach[1])
            continue
        if held:
            run = []
            for m in TOKEN.finditer(text, *held):
                a, b = m.span()
                while a < b and text[a] in EDGE:
                    a += 1
                while b > a and text[b - 1] in EDGE:
                    b -= 1
                if a < b:
                    run.append((a, b))
            if run:
                yield run
        held = reach


def _bucket(n: int) -> int:
    """Up to 4 as it is, then the next power of two."""
    return n if n <= 4 else 1 << (n - 1).bit_length()


@lru_cache(maxsize=50_000)
def shapes(word: str) -> tuple[str, str, int]:
    """The runs of letters (A, a), digits (d) and others with their lengths, the runs alone, and how many there are."""
    runs = [(k, len(list(g))) for k, g in groupby("d" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)]
    return "".join(f"{k}{_bucket(n)}" for k, n in runs), "".join(k for k, _ in runs), len(runs)


def _beside(word: str) -> str:
    """What a neighbour sees of a word: the word itself if it has no digit."""
    if not DIGIT.search(word):
        return word.lower()
    long, short, runs = shapes(word)
    return short if runs <= 6 else f"{runs > 6}{''.join(sorted(set(short)))}"


@lru_cache(maxsize=50_000)
def features(word: str) -> tuple[str, ...]:
    long, short, runs = shapes(word)
    kinds, digits = "".join(sorted(set(short))), len(_digits(word))
    out = [f"k={kinds}", f"l={_bucket(len(word))}", f"n={_bucket(digits)}", f"r={_bucket(runs)}{kinds}", f"@={word[:1] == '@'}{word.count('@') if word.count('@') < 2 else 2}"]
    if runs <= 12:
        out += [f"s={long}", f"c={short}"]
    if not digits:
        out.append(f"w={word.lower()}")
    if len(word) >= 8 and not word.strip("0123456789abcdef"):
        out.append(f"h={_bucket(len(word))}{digits > 0}")
    if len(word) >= 12 and kinds in ("A", "Ad"):
        out += [f"u={_bucket(len(word))}", f"b={word[:4]}"]
    return tuple(out)


class Crf:
    """Weights of a linear chain: features of each word and of its neighbours, and pairs of tags."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(TAGS)))
        for k in range(len(words)):
            for name in _around(words, k):
                at = self.names.get(name)
                if at is not None:
                    out[k] += self.emit[at]
        return out

    def decode(self, runs: list[list[str]]) -> list[np.ndarray]:
        """Best tags of each run; runs of one length go through Viterbi in one batch."""
        out: list = [None] * len(runs)
        by_length: dict[int, list[int]] = {}
        for k, run in enumerate(runs):
            by_length.setdefault(len(run), []).append(k)
        for length, members in by_length.items():
            for at in range(0, len(members), 4096):
                part = members[at : at + 4096]
                for k, tags in zip(part, _viterbi(np.stack([self.scores(runs[k]) for k in part]), self.move)):
                    out[k] = tags
        return out


def _around(words: list[str], k: int) -> list[str]:
    own = features(words[k])
    before = _beside(words[k - 1]) if k else "^"
    before2 = _beside(words[k - 2]) if k > 1 else "^"
    after = _beside(words[k + 1]) if k + 1 < len(words) else "$"
    about = f"{own[0]}{own[1]}"
    return [*own, f"p={before}", f"q={before2}|{before}", f"f={after}", f"p={before}|{about}", f"q={before2}|{before}|{own[0]}", f"f={after}|{own[0]}", f"p={before in '=:'}|{about}"]


def _viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """emit: (runs, length, tags).  O stands before and after each run."""
    n, length, _ = emit.shape
    best = emit[:, 0] + move[0]
    back = np.zeros(emit.shape, dtype=np.int8)
    for t in range(1, length):
        through = best[:, :, None] + move[None]
        back[:, t] = through.argmax(axis=1)
        best = through.max(axis=1) + emit[:, t]
    tags = np.zeros((n, length), dtype=np.int8)
    tags[:, -1] = (best + move[:, 0]).argmax(axis=1)
    for t in range(length - 1, 0, -1):
        tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
    return tags


SPAN = re.compile(r"\{(\w+)\|([^}]*)\}")


def parsed(line: str) -> list[list[tuple[str, str]]]:
    """The runs of a marked line as (token, tag)."""
    text, spans, at = "", [], 0
    for m in SPAN.finditer(line):
        text += line[at : m.start()]
        spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
        text, at = text + m.group(2), m.end()
    text += line[at:]
    tagged = []
    for run in runs_of(text):
        tags = []
        for a, b in run:
            kind, start = next(((k, x) for k, x, y in spans if a < y and x < b), ("", 0))
            tags.append((text[a:b], f"{'B' if a <= start else 'I'}-{kind}" if kind else "O"))
        tagged.append(tags)
    return tagged


def varied(line: str, rng: np.random.Generator) -> str:
    """``line`` with other digits, and with other letters in its words that have digits."""
    draw = lambda letters: letters[rng.integers(0, len(letters))]
    digits, low, high = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def other(m: re.Match) -> str:
        word = m.group()
        if not DIGIT.search(word):
            return word
        if len(word) >= 16 and not word.strip(digits + "abcdef"):
            return "".join(draw(digits + "abcdef") for _ in word)
        if len(word) >= 16 and not word.strip(digits + high):
            return word[:4] + "".join(draw(high + digits) for _ in word[4:])
        return "".join(draw(digits) if c in digits else draw(low) if c in low and len(word) >= 16 else draw(high) if c in high and len(word) >= 16 else c for c in word)

    return re.sub(r"[0-9A-Za-z]+", other, line)


def labelled_table(lines: list[str] | tuple[str, ...] = tuple(LINES), copies: int = 4, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The runs of the labelled lines, and of ``copies - 1`` variations of each."""
    rng = np.random.default_rng(seed)
    return [run for line in lines for k in range(copies) for run in parsed(varied(line, rng) if k else line)]


def train(table: list[list[tuple[str, str]]], rounds: int = 100, ridge: float = 0.02) -> Crf:
    """Maximum likelihood with a ridge, by AdaGrad over the whole table: gradients from forward and backward sums."""
    words = [[w for w, _ in row] for row in table]
    names = {n: i for i, n in enumerate(sorted({n for run in words for k in range(len(run)) for n in _around(run, k)}))}
    n, length, tags = len(table), max(map(len, table)), len(TAGS)
    width = max(len(_around(run, k)) for run in words for k in range(len(run)))
    used = np.full((n, length, width), len(names))
    gold, real = np.zeros((n, length), dtype=int), np.zeros((n, length), dtype=bool)
    for i, row in enumerate(table):
        for k, (_, tag) in enumerate(row):
            own = [names[x] for x in _around(words[i], k)]
            used[i, k, : len(own)] = own
            gold[i, k], real[i, k] = TAGS.index(tag), True
    gold_one = np.eye(tags)[gold] * real[..., None]
    emit, move = np.zeros((len(names) + 1, tags)), np.zeros((tags, tags))
    sums_e, sums_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    for i in range(tags):  # an I follows a B or I of its own kind only
        for j in range(tags):
            if TAGS[j][0] == "I" and (i == 0 or TAGS[i][2:] != TAGS[j][2:]):
                move[i, j] = -1e4
    fixed = move < -1e3
    last = real.sum(axis=1) - 1
    for _ in range(rounds):
        score = emit[used].sum(axis=2)
        ahead, behind = np.zeros((n, length, tags)), np.zeros((n, length, tags))
        ahead[:, 0] = score[:, 0] + move[0]
        for t in range(1, length):
            x = ahead[:, t - 1][:, :, None] + move[None]
            top = x.max(axis=1)
            step = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + score[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        end = ahead[:, -1] + move[:, 0]
        whole = np.logaddexp.reduce(end, axis=1)
        behind[:, -1] = move[:, 0]
        for t in range(length - 2, -1, -1):
            x = move[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :]
            behind[:, t] = np.where(real[:, t + 1, None], np.logaddexp.reduce(x, axis=2), behind[:, t + 1])
        node = np.exp(ahead + behind - whole[:, None, None]) * real[..., None]
        grad_m = np.zeros_like(move)
        for t in range(1, length):
            on = real[:, t]
            pair = np.exp(ahead[on, t - 1][:, :, None] + move[None] + (score[on, t] + behind[on, t])[:, None, :] - whole[on, None, None])
            grad_m += np.einsum("ni,nj->ij", gold_one[on, t - 1], gold_one[on, t]) - pair.sum(axis=0)
        grad_m[0] += (gold_one[:, 0] - node[:, 0]).sum(axis=0)
        rows = np.arange(n)
        grad_m[:, 0] += (gold_one[rows, last] - node[rows, last]).sum(axis=0)
        grad_e = np.zeros_like(emit)
        np.add.at(grad_e, used[real].ravel(), np.repeat((gold_one - node)[real], width, axis=0))
        grad_e -= ridge * emit
        grad_m = np.where(fixed, 0, grad_m - ridge * move)
        sums_e += grad_e**2
        sums_m += grad_m**2
        emit += 0.5 * grad_e / np.sqrt(sums_e)
        move += 0.5 * grad_m / np.sqrt(sums_m)
        emit[-1] = 0
    return Crf(names, emit[:-1], move)


class Covered:
    """What a list of spans covers, as stretches apart from each other: an overlap is found by bisection."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda x: x[1:]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start


def added_spans(model: Crf, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The model's spans of each text, without those that overlap a base span."""
    runs, where = [], []
    for k, text in enumerate(texts):
        for run in runs_of(text):
            runs.append([text[a:b] for a, b in run])
            where.append((k, run))
    out: list = [[] for _ in texts]
    covered = [Covered(spans) for spans in base]
    for (k, words), tags in zip(where, model.decode(runs)):
        at = 0
        while at < len(words):
            kind = TAGS[tags[at]][2:]
            end = at + 1
            while kind and end < len(words) and TAGS[tags[end]] == f"I-{kind}":
                end += 1
            if kind in ADDED:
                span = (words[at][0], words[end - 1][1])
                if span[0] < span[1] and not covered[k].meets(*span):
                    out[k].append((kind, *span))
            at = end
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, text_col: str = "text", model: Crf | None = None, result_col: str = "pii") -> DataFrame:
    """``docs`` with ``result_col``: n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_added, the number of the model's spans.

    Base spans come from the patterns of the contract; the model's are of
    kinds of their own, follow in ``spans`` and never overlap a base span, so
    the four counts are those of base spans and of ``spans`` alike.  Null
    counts as empty: no spans, the hash of ''.  Repeated rows are read each; an
    empty table gives an empty one.  A column of ``docs`` with the new one's
    name goes on as ``<name>_in``.
    """
    docs = make_room(docs, result_col)
    crf = docs.sparkSession.sparkContext.broadcast(model or train(labelled_table()))

    def run(texts: pd.Series) -> pd.DataFrame:
        whole = texts.tolist()
        base = [base_spans(t) for t in whole]
        more = added_spans(crf.value, whole, base)
        rows = []
        for own, new in zip(base, more):
            row = {f"n_{kind}": sum(k == kind for k, _, _ in own) for kind in LISTED}
            listed = _joined(own)
            new.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
            rows.append(row | {"base_sha256": hashlib.sha256(listed.encode()).hexdigest(), "spans": _joined(own + new), "n_added": len(new)})
        return pd.DataFrame(rows)

    result = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.withColumn(result_col, F.pandas_udf(run, result)(F.coalesce(F.col(text_col), F.lit(""))))
