"""Token counts by a map-side two-tier lookup (operator 3).

The unit that is looked up is a run of white space with the characters up to
the next white space: with a byte-level pre-tokenizer no pre-token crosses its
ends, so a text's count is the sum over its units.  The first tier is a
broadcast table of the lengths of the most frequent units, the second a cache
of each worker; what neither has is encoded by the library, all such units of a
text in one string.  Units never cross a shuffle: to find the frequent ones, each task counts its own and only a
bounded summary of each is added up.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import make_room

#: White space of Unicode, so without U+001C to U+001F, which Python's \s has.
UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
SPACE = re.compile(r"[^\S\x1c-\x1f]")
#: Units in a task's summary, in the broadcast table, and in a worker's cache.
SUMMARY, FREQUENT, CACHED = 2000, 20_000, 150_000


def frequent_units(docs: DataFrame, text_col: str, summary: int = SUMMARY, frequent: int = FREQUENT) -> list[str]:
    """The most frequent units over all texts, ``frequent`` at most.

    A task's counter is cut to its larger half whenever it holds too many, so
    a unit may be undercounted: this only decides what is looked up first.
    """

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["t"]:
                seen.update(UNIT.findall(text))
                if len(seen) > 20 * summary:
                    seen = Counter(dict(seen.most_common(5 * summary)))
        rows = [(u, n) for u, n in seen.most_common(summary) if n > 1]
        yield pd.DataFrame(rows, columns=["unit", "n"]).astype({"unit": object, "n": "int64"})

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(count, "unit string, n long")
    top = rows.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(frequent)
    return [r.unit for r in top.select("unit").collect()]


def _json_counter(path: str):
    """(count the tokens of each string of a list, count them for units, which may be null, strings that are special)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    apart = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    special = [x["content"] for x in spec.get("added_tokens", [])]
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    def count(texts: list[str]) -> list[int]:
        return [len(x) for x in batch(texts, add_special_tokens=False)]

    def count_units(units: list[str]) -> dict[str, int]:
        """Units that begin with white space and don't end with it stay apart in one string: their tokens are told by where they start."""
        joined = [u for u in units if SPACE.match(u) and not SPACE.match(u[-1])]
        others = [u for u in units if not SPACE.match(u) or SPACE.match(u[-1])]
        found = dict(zip(others, count(others))) if others else {}
        if joined:
            starts = np.array([a for a, _ in tokenizer.encode("".join(joined), add_special_tokens=False).offsets], dtype=np.int64)
            ends = np.cumsum(np.fromiter(map(len, joined), dtype=np.int64, count=len(joined)))
            found.update(zip(joined, np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(joined)).tolist()))
        return found

    return count, count_units if apart and not any(SPACE.search(x) for x in special) else None, special


def _model_counter(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], None, []


def _counter(path: str, held: dict = {}):  # noqa: B006  one library object a worker
    if path not in held:
        held[path] = (_model_counter if path.endswith(".model") else _json_counter)(path)
    return held[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer_path`` is a .json of ``tokenizers`` or a .model of
    ``sentencepiece``, on every worker.  Counts are those of the library over
    the whole text without special tokens added; special strings in a text are
    what the library makes of them.  Null counts as empty: no bytes, no
    tokens.  Texts that hold a special string, and all texts where the
    library's pre-tokenizer isn't byte-level, are encoded whole.  Repeated rows
    are counted each; an empty table gives an empty one.  Columns of ``docs``
    with the name of a new one go on as ``<name>_in``; ``prefix`` stands
    before the new names.
    """
    names = [prefix + x for x in ("n_bytes", "n_tokens", "over_limit")]
    docs = make_room(docs, *names)
    _, count_units, _ = _counter(tokenizer_path)
    table = count_units(frequent_units(docs, text_col)) if count_units else {}
    first = docs.sparkSession.sparkContext.broadcast(table)

    def lengths(texts: pd.Series) -> pd.Series:
        count, count_units, special = _counter(tokenizer_path)
        out = np.zeros(len(texts), dtype=np.int64)
        known, cache = first.value, _cache(tokenizer_path)
        for k, text in enumerate(texts):
            if not text:
                continue
            if count_units is None or any(s in text for s in special):
                out[k] = count([text])[0]
                continue
            parts = UNIT.findall(text)
            found = list(map(known.get, parts))
            if None in found:
                rest = [u for u, n in zip(parts, found) if n is None]
                lengths = cache.lengths(rest, count_units)
                out[k] = sum(n for n in found if n is not None) + sum(map(lengths.__getitem__, rest))
            else:
                out[k] = sum(found)
        return pd.Series(out)

    count = F.pandas_udf(lengths, "long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(names[1], count(text)).withColumns({names[0]: F.octet_length(text).cast("long"), names[2]: F.col(names[1]) > limit})


class _Cache:
    """The second tier: lengths of units; when it is full, what wasn't asked for since it was last half full goes."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def lengths(self, units: list[str], count_units) -> dict[str, int]:
        """A dictionary that has all of ``units``."""
        missing = {u for u in units if u not in self.new}
        if not missing:
            return self.new
        fresh = {u: n for u in missing if (n := self.old.get(u)) is not None}
        unknown = [u for u in missing if u not in fresh]
        if unknown:
            fresh |= count_units(unknown)
        if len(self.new) + len(fresh) > self.half:
            self.new, self.old = {u: self.new[u] for u in units if u in self.new}, self.new
        self.new.update(fresh)
        return self.new


def _cache(path: str, held: dict = {}) -> _Cache:  # noqa: B006  one a worker
    if path not in held:
        held[path] = _Cache(CACHED)
    return held[path]
