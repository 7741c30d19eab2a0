"""Readers with gates: CSV games, ratings, card dumps, id tables, replays."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.catalogue import first_by

MARKERS = ("expansion", "event_type")


def read_games(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV (gz too) with a header; types are inferred unless given.

    A gz file is one task's: the rows are dealt out before anything wide is done.
    """
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return rows.repartition(spark.sparkContext.defaultParallelism)


def marker_counts(rows: DataFrame, expansion: str, event_type: str) -> DataFrame:
    """total, rows without a marker, and rows of another format: one pass."""
    e, v = F.col("expansion"), F.col("event_type")
    return rows.agg(F.count("*").alias("total"), F.count_if(e.isNull()).alias("null_expansion"), F.count_if(v.isNull()).alias("null_event_type"), F.count_if(e != expansion).alias("other_expansion"), F.count_if(v != event_type).alias("other_event_type"))


def check_markers(rows: DataFrame, expansion: str, event_type: str, may_be_empty: bool = False) -> int:
    """Rows of the table; raises if a marker column is missing, null or of another format, or if there are no rows."""
    missing = [c for c in MARKERS if c not in rows.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    counts = marker_counts(rows, expansion, event_type).first().asDict()
    total = counts.pop("total")
    wrong = {k: n for k, n in counts.items() if n}
    if wrong or not total and not may_be_empty:
        raise ValueError(f"{total} rows; {wrong}")
    return total


def store_games(rows: DataFrame, path: str, expansion: str, event_type: str) -> int:
    """Checked rows as zstd Parquet, visible only when complete (Spark's commit protocol)."""
    n = check_markers(rows, expansion, event_type)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return n


def read_ratings(spark: SparkSession, path: str, schema: T.StructType, expansion: str, event_type: str) -> DataFrame:
    """A JSON array of ratings with the format's markers added; an empty array gives no rows, anything else is refused."""
    whole = spark.read.text(path, wholetext=True)
    start = F.substring(F.ltrim(F.regexp_replace("value", r"^[\s\uFEFF]+", "")), 1, 1)
    if not whole.filter(start != "[").isEmpty():
        raise ValueError(f"{path}: not a JSON array")
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = rows.withColumns({"expansion": F.lit(expansion), "event_type": F.lit(event_type)})
    check_markers(rows, expansion, event_type, may_be_empty=True)
    return rows


def union_view(spark: SparkSession, name: str, paths: list[str]) -> int:
    """View over all files, columns by name, null where a file lacks one; without files there is no view.  Rows."""
    if not paths:
        spark.catalog.dropTempView(name)
        return 0
    rows = spark.read.option("mergeSchema", True).parquet(*paths)
    rows.createOrReplaceTempView(name)
    return rows.count()


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """gz JSON lines, each an object; fails with the file and number of the first bad line, or if there are none.

    A gz file is one task's, from its first line on, so the part of the row's
    number below the partition's counts the lines of the files before it in
    that task too; a file's own count starts at its least.
    """
    lines = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("line"), F.col("_metadata.file_path").alias("file"))
    kept = lines.filter(F.trim("value") != "")
    parsed = kept.withColumn("row", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = ~F.trim("value").startswith("{") | F.col("row._bad").isNotNull()
    n, first = parsed.agg(F.count("*"), F.min(F.when(bad, F.struct("file", "line")))).first()
    if first is not None:
        begin = lines.filter(F.col("file") == first.file).agg(F.min("line")).first()[0]
        raise ValueError(f"{first.file}: line {first.line - begin + 1} is not an object")
    if not n:
        raise ValueError(f"{path}: no lines")
    return parsed.select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])


def newest_snapshot(spark: SparkSession, folder: str, suffix: str = ".jsonl.gz") -> str:
    """The path in ``folder`` with the latest date (yyyymmdd or more digits) in its name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    dated = [(m.group(), name) for name in names if name.endswith(suffix) and (m := re.search(r"\d{8,}", name))]
    if not dated:
        raise ValueError(f"{folder}: no dated snapshot")
    return f"{folder}/{max(dated)[1]}"


def scan_replays(spark: SparkSession, path: str, columns: list[str], prefix: str = "deck_") -> DataFrame:
    """Replay CSV: ``columns`` that exist and every column that begins with ``prefix``, found from the header alone; counts as whole numbers.

    Nothing but these columns is parsed.
    """
    names = spark.read.option("header", True).csv(path).columns
    decks = [c for c in names if c.startswith(prefix)]
    if not decks:
        raise ValueError(f"{path}: no column begins with {prefix}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return rows.select(*[F.col(f"`{c}`") for c in columns if c in names], *[F.col(f"`{c}`").try_cast("int").alias(c) for c in decks])


def gated_with_limit(rows: DataFrame, reasons: dict[str, Column], limit: int, order: list[str], before: bool) -> DataFrame:
    """Rows that pass the gate, of the first ``limit`` rows (``before``), or the first ``limit`` of those that pass."""
    passing = lambda df: ordered_gate(df, reasons).filter("reject_reason IS NULL").drop("reject_reason")
    return passing(rows.orderBy(*order).limit(limit)) if before else passing(rows).orderBy(*order).limit(limit)


def id_index(maps: DataFrame) -> DataFrame:
    """(oracle_id, set_code, arena_id) from a column ``value`` of JSON objects {uuid: record}.

    Records without either key or with an id that is no integer are skipped;
    of repeated keys the first by uuid counts.
    """
    kind = "map<string,struct<oracle_id:string,`set`:string,arena_id:string>>"
    records = maps.select(F.explode(F.from_json("value", kind)).alias("uuid", "r"))
    rows = records.select("uuid", "r.oracle_id", F.col("r.set").alias("set_code"), F.col("r.arena_id").try_cast("long").alias("arena_id"))
    return first_by(rows.dropna(subset=["oracle_id", "set_code", "arena_id"]), ["oracle_id", "set_code"], [F.col("uuid")]).drop("uuid")


def tolerant_split(lines: DataFrame, schema: str, by: str, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good records, and how many were skipped by ``by``, a column beside the text."""
    parsed = lines.withColumn("row", F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return parsed.filter(~bad).select(by, "row.*").drop("_bad"), parsed.filter(bad).groupBy(by).agg(F.count("*").alias("skipped"))


def long_cards(wide: DataFrame, ids: list[str], families: dict[str, str]) -> DataFrame:
    """(ids, zone, card, n) from families of columns by prefix: counts above 0 only.

    The families are unpivoted together, in one pass over the wide rows.
    """
    columns = [(prefix, zone, c) for zone, prefix in families.items() for c in wide.columns if c.startswith(prefix)]
    entries = F.array(*[F.struct(F.lit(zone).alias("zone"), F.lit(c[len(prefix) :]).alias("card"), F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0)).alias("n")) for prefix, zone, c in columns])
    return wide.select(*ids, F.explode(F.filter(entries, lambda e: e.n > 0)).alias("e")).select(*ids, "e.*")


def candidate_hands(replays: DataFrame, key: list[str], slots: list[str], mulligans: str) -> DataFrame:
    """One row for each hand that was offered: its number from 0, and whether it was kept."""
    hands = replays.select(*key, mulligans, F.posexplode(F.array(*slots)).alias("mulligan_number", "hand"))
    kept = hands.filter(F.col("hand").isNotNull() & (F.col("hand") != ""))
    return kept.withColumn("was_kept", F.col("mulligan_number") == F.col(mulligans)).drop(mulligans)


def ordered_gate(rows: DataFrame, reasons: dict[str, Column], name: str = "reject_reason") -> DataFrame:
    """``rows`` with the first reason that holds, in the order given; null for rows that pass."""
    found = F.lit(None).cast("string")
    for reason, cond in reversed(reasons.items()):
        found = F.when(F.coalesce(cond, F.lit(False)), reason).otherwise(found)
    return rows.withColumn(name, found)


def game_reasons(hand: str = "hand_n", deck: str = "deck_n", unknown: str = "unknown_cards") -> dict[str, Column]:
    """Why a game is no training row, in order."""
    c = F.col
    return {
        "missing_context": c("win_rate").isNull() | c("n_games").isNull() | c("player_rank").isNull(), "mulligans_out_of_range": ~c("mulligan_number").between(0, 6) | ~c("opp_mulligans").between(0, 6),
        "hand_size": c(hand) != 7, "deck_size": ~c(deck).between(40, 42), "unknown_card": c(unknown) > 0,
    }


def export_csv(rows: DataFrame, path: str, columns: list[str]) -> list[str]:
    """CSV with a header of the listed columns that exist; which these are."""
    there = [c for c in columns if c in rows.columns]
    rows.select(*there).write.mode("overwrite").option("header", True).csv(path)
    return there
