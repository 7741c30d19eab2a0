"""The stages of the corpus pipeline; each takes and, but for the last, returns rows of ``documents``.

Columns beside those of ``documents`` pass through all stages, whatever their
names: a stage sees them under names that no operator uses.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, exact_dedup, language_id, mixing, simhash
from .common import fold_of, make_room
from .queries import bpe_pattern, tokenizer

#: Columns of ``documents``.
OWN = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents go if less than this share of their letters is in scripts and words of languages that were learnt.
LEAST_SHARE = 0.4
#: Bytes of a batch that goes to a Python worker, about.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Python workers get texts some megabytes at a time, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def passing_others(stage: Callable) -> Callable:
    """``stage`` over documents whose other columns are named ``other_0``, ``other_1``, ... meanwhile."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        names = [c if c in OWN else f"other_{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@passing_others
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of whose letters less than ``LEAST_SHARE`` are of scripts that a language was learnt for; texts of several languages stay."""
    model = language_id.learn(docs.filter(fold_of("doc_id") != 0))
    found = language_id.identify(docs, model)
    return found.filter((F.col("language.lang_pred") != "und") & (F.col("language.known") >= LEAST_SHARE))


@passing_others
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_one(docs)


@passing_others
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays."""
    return simhash.keep_one(docs)


@passing_others
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to 3 times, in the order of training."""
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    mixed = mixing.mix(sized, lambda s: mixing.ranked(s, [5, 2, 1]), max_repeats=3, in_order=False)
    return mixing.materialise(mixed, docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document without its text, with its ids, their number, and whether they decode to the text.

    The place in training order is carried as ``training_file`` and
    ``training_row``: the number of the file that the mixing stage wrote, which
    is that of its range, and the row within.  Columns with the name of a new
    one go on as ``<name>_in``.
    """
    bound_batches(spark)
    path, pattern = tokenizer("byte_bpe_50k.tiktoken"), bpe_pattern()
    docs = make_room(docs, "n_tokens", "ids", "round_trip", "training_file", "training_row", "bpe")
    others = [c for c in docs.columns if c != "text"]
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    placed = docs.select(*docs.columns, file.alias("training_file"), F.col("_metadata.row_index").alias("training_row"))
    coded = byte_bpe.round_trip(placed, path, pattern)
    return coded.select(*others, "training_file", "training_row", F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("byte_bpe", tokens)]
