"""Feature datasets on disk: stamped partitions, resume, reuse, migration of vocabularies.

What a write or an invalidation changes is staged whole beside the data, in
``_staged-<id>``, which readers pass over; then a note of all moves is put
there, then the moves are made.  A run that is lost before the note changed
nothing, one that is lost after it is finished by whoever opens the dataset
next: no reader of ``open_dataset`` sees a hole.  One writer at a time.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PARTITION = ["expansion", "event_type"]


@dataclass(frozen=True)
class Stamp:
    """What a partition was made with."""

    simulation: str
    features: str
    runs: int

    def row(self) -> dict[str, str]:
        return {"simulation": self.simulation, "features": self.features, "runs": str(self.runs)}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary folder only where there is no other machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="decklake-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def held(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and reread: what several jobs use isn't worked out again for each, and survives lost executors."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_shards(spark: SparkSession, path: str, columns: list[str], keep: Column | None = None) -> DataFrame:
    """Columns of the shards ``chunk_*`` of a dataset, and only rows that ``keep`` holds for: both reach the scan."""
    rows = spark.read.parquet(f"{path}/chunk_*")
    return (rows if keep is None else rows.filter(keep)).select(*columns)


def invalidate(spark: SparkSession, path: str, gone: DataFrame, key: list[str]) -> DataFrame:
    """Delete the rows whose key is in ``gone`` from the dataset at ``path``; by partition, the rows that went and that stay.

    ``path`` is what ``write_stamped`` wrote, or a plain folder of partitions.
    Only partitions that lose rows are written again, whole, and all of them
    are put in place together.  Where the dataset is bucketed by ``key``, its
    rows aren't shuffled for the join.
    """
    settle(spark, path, undo=True)
    layout = _layout(spark, path)
    prefix = "data/" if _exists(spark, f"{path}/data") else ""
    rows = open_dataset(spark, path)
    keys = gone.select(*key).distinct().withColumn("own_gone", F.lit(True))
    marked = rows.join(keys, key, "left").withColumn("own_gone", F.coalesce("own_gone", F.lit(False)))
    report = held(marked.groupBy(*PARTITION).agg(F.count_if("own_gone").alias("deleted"), F.count_if(~F.col("own_gone")).alias("kept")).filter("deleted > 0"), "report")
    stays = joined_or_null(marked, report.select(*PARTITION), PARTITION).filter(~F.col("own_gone")).select(*rows.columns)
    staged = _new_stage(path)
    _write(stays, f"{staged}/{prefix}", layout)
    # The folders of this small table are named as Spark names those of the data, whatever their values hold.
    report.write.partitionBy(*PARTITION).parquet(f"{staged}/touched")
    there = set(_folders(spark, f"{staged}/{prefix}"))
    _publish(spark, path, staged, {prefix + f: "put" if f in there else "drop" for f in _folders(spark, f"{staged}/touched")} | ({f"stamps/{f}": "drop" for f in _folders(spark, f"{staged}/touched") if f not in there} if prefix else {}))
    return report


def joined_or_null(rows: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` is in ``wanted``, where null is a value like any other."""
    right = wanted.withColumnsRenamed({c: f"own_{c}" for c in by})
    return rows.join(right, [rows[c].eqNullSafe(right[f"own_{c}"]) for c in by], "left_semi")


@dataclass(frozen=True)
class Buckets:
    """Rows lie in ``count`` files of each partition by the hash of ``key``, sorted by it."""

    key: tuple[str, ...]
    count: int

    def text(self) -> str:
        return json.dumps([list(self.key), self.count])

    @staticmethod
    def of(text: str) -> "Buckets":
        key, count = json.loads(text)
        return Buckets(tuple(key), count)


def open_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a dataset, after a write that was cut short while it put its files in place is finished.

    If all partitions were written with the same buckets, joins and
    aggregates by their key read them without a shuffle.
    """
    settle(spark, path)
    data = f"{path}/data" if _exists(spark, f"{path}/data") else path
    rows, buckets = spark.read.parquet(data), _layout(spark, path)
    if buckets is None:
        return rows
    name = f"own_{uuid.uuid4().hex}"
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({quoted(PARTITION)}) CLUSTERED BY ({quoted(buckets.key)}) SORTED BY ({quoted(buckets.key)}) INTO {buckets.count} BUCKETS LOCATION '{data}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def settle(spark: SparkSession, path: str, undo: bool = False) -> None:
    """Finish writes whose moves were noted; with ``undo`` (writers only) also clear away those that never came so far."""
    for name in _names(spark, path):
        if name.startswith("_staged-"):
            staged = f"{path}/{name}"
            if _exists(spark, f"{staged}/ready"):
                _finish(spark, path, staged)
            elif undo:
                _delete(spark, staged)


def _new_stage(path: str) -> str:
    return f"{path}/_staged-{uuid.uuid4().hex}"


def _publish(spark: SparkSession, path: str, staged: str, moves: dict[str, str]) -> None:
    """Note the moves, then make them: ``put`` a staged folder in place of the old one, ``add`` its files to it, ``drop`` the old one."""
    fs, at = _at(spark, f"{staged}/noted")
    out = fs.create(at, True)
    out.write(json.dumps(moves).encode())
    out.close()
    _rename(spark, f"{staged}/noted", f"{staged}/ready")
    _finish(spark, path, staged)


def _finish(spark: SparkSession, path: str, staged: str) -> None:
    """Make the noted moves that aren't made yet: each can be repeated, as what was moved isn't staged any more."""
    fs, at = _at(spark, f"{staged}/ready")
    source = fs.open(at)
    moves = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    source.close()
    for folder, how in moves.items():
        old, new = f"{path}/{folder}", f"{staged}/{folder}"
        if how == "drop":
            _delete(spark, old)
        elif how == "put" and _exists(spark, new):
            _delete(spark, old)
            _rename(spark, new, old)
        elif how == "add":
            for name in _names(spark, new):
                _rename(spark, f"{new}/{name}", f"{old}/{name}")
    _delete(spark, staged)


def _layout(spark: SparkSession, path: str) -> Buckets | None:
    """The buckets that all partitions of a dataset share, if their stamps name any."""
    data, stamps = _folders(spark, f"{path}/data"), _folders(spark, f"{path}/stamps")
    if not data or set(data) - set(stamps):
        return None
    rows = _stamps(spark, path)
    if "buckets" not in rows.columns:
        return None
    found = [r[0] for r in rows.select("buckets").distinct().limit(2).collect()]
    return Buckets.of(found[0]) if len(found) == 1 and found[0] else None


def _stamps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{path}/stamps")


def _write(rows: DataFrame, path: str, buckets: Buckets | None, rows_per_file: int = 1_000_000) -> None:
    """Partitions at a new path; with buckets, a file for each bucket of a partition."""
    spark = rows.sparkSession
    if buckets is None:
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).partitionBy(*PARTITION).parquet(path)
        return
    name = f"own_{uuid.uuid4().hex}"
    rows.repartition(buckets.count, *buckets.key).write.format("parquet").option("compression", "zstd").option("path", path).partitionBy(*PARTITION).bucketBy(buckets.count, *buckets.key).sortBy(*buckets.key).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, as they have a path of their own


def resume(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't there yet."""
    return rows.join(done.select(*key), key, "left_anti")


def reuse_or_compute(rows: DataFrame, cached: DataFrame, key: list[str], may_reuse: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with their cached features (own columns win), and those that must be computed."""
    extra = [c for c in cached.columns if c in key or c not in rows.columns]
    hits = rows.filter(may_reuse).join(cached.select(*extra), key)
    misses = rows.filter(~may_reuse | may_reuse.isNull()).unionByName(rows.filter(may_reuse).join(cached.select(*key), key, "left_anti"))
    return hits, misses


def write_stamped(rows: DataFrame, path: str, stamp: Stamp, mode: str = "error", key: list[str] | None = None, rows_per_file: int = 1_000_000, buckets: Buckets | None = None) -> dict[str, int]:
    """Write by partition, with a metadata table of stamps beside the data; counts of rows written by partition count.

    ``mode``: ``error`` refuses an existing dataset; ``overwrite`` replaces
    the partitions that ``rows`` has; ``resume`` appends rows whose ``key`` is
    new, and refuses partitions whose stamp or buckets differ, naming every
    difference.  Partitions without a stamp are listed as unverified by
    ``stamp_report``.  Partitions and stamps are put in place together.  An
    existing dataset's buckets go on where ``buckets`` is None.
    """
    spark = rows.sparkSession
    data = f"{path}/data"
    settle(spark, path, undo=True)
    there = _exists(spark, data)
    if mode == "error" and there:
        raise FileExistsError(path)
    layout = buckets or (_layout(spark, path) if there else None)
    if mode == "resume" and there:
        parts = rows.select(*PARTITION).distinct()
        wrong = joined_or_null(stamp_report(spark, path, stamp).filter("state = 'differs'"), parts, PARTITION).select("message").orderBy("message").collect()
        if wrong:
            raise ValueError("; ".join(r[0] for r in wrong))
        if layout != _layout(spark, path):
            raise ValueError(f"{path} has other buckets than {layout}")
        rows = resume(rows, open_dataset(spark, path), key or [])
    staged = _new_stage(path)
    _write(rows, f"{staged}/data", layout, rows_per_file)
    written = spark.read.schema(rows.schema).parquet(f"{staged}/data").groupBy(*PARTITION).agg(F.count("*").alias("rows"))
    counts = written.agg(F.sum("rows"), F.count("*")).first()
    stamps = written.select(*[F.lit(v).alias(k) for k, v in stamp.row().items()], F.lit(layout.text() if layout else None).cast("string").alias("buckets"), *PARTITION)
    stamps.coalesce(1).write.partitionBy(*PARTITION).parquet(f"{staged}/stamps")
    added = "add" if mode == "resume" and there else "put"
    folders = _folders(spark, f"{staged}/data")
    _publish(spark, path, staged, {f"data/{f}": added for f in folders} | {f"stamps/{f}": "put" for f in folders})
    return {"rows": counts[0] or 0, "partitions": counts[1]}


def stamp_report(spark: SparkSession, path: str, stamp: Stamp) -> DataFrame:
    """(partition, state, message): same, differs (with each difference) or unverified."""
    parts = spark.read.parquet(f"{path}/data").select(*PARTITION).distinct()
    fields = stamp.row()
    if _exists(spark, f"{path}/stamps"):
        held = _stamps(spark, path)
    else:
        held = parts.limit(0).select(*[F.lit("").alias(k) for k in fields], *PARTITION)
    rows = parts.join(held.withColumnsRenamed({c: f"own_{c}" for c in PARTITION}), [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in PARTITION], "left")
    differ = F.array_compact(F.array(*[F.when(F.col(k) != v, F.concat(F.lit(f"{k} "), F.col(k), F.lit(f" is not {v}"))) for k, v in fields.items()]))
    state = F.when(F.col("simulation").isNull(), "unverified").when(F.size(differ) > 0, "differs").otherwise("same")
    return rows.select(*PARTITION, state.alias("state"), F.concat_ws(": ", F.concat_ws("/", *PARTITION), F.array_join(differ, ", ")).alias("message"))


def migrate_one_hots(rows: DataFrame, source: str, vocabulary: list[str], prefix: str = "set_code_") -> DataFrame:
    """One-hot columns rebuilt from ``source``: existing ones in their place, new ones after; the same again if run twice."""
    known = [c[len(prefix) :] for c in rows.columns if c.startswith(prefix)]
    hot = {f"{prefix}{v}": F.when(F.col(source) == v, 1.0).otherwise(0.0) for v in [*known, *[v for v in vocabulary if v not in known]]}
    order = [*rows.columns, *[c for c in hot if c not in rows.columns]]
    return rows.withColumns(hot).select(*order)


def migration_check(before: DataFrame, after: DataFrame, source: str, vocabulary: list[str], prefix: str = "set_code_") -> dict[str, int]:
    """Counts that must hold after a migration; raises if they don't."""
    hot = [c for c in after.columns if c.startswith(prefix)]
    ones = sum((F.col(c) for c in hot), F.lit(0.0))
    known = F.col(source).isin(*[c[len(prefix) :] for c in hot])
    wrong, n, outside = after.agg(F.count_if(F.when(known, ones != 1).otherwise(ones != 0)), F.count("*"), F.count_if(~known)).first()
    if wrong or n != before.count() or after.columns[: len(before.columns)] != before.columns:
        raise ValueError(f"{wrong} rows without exactly one set; {n} rows; columns {after.columns}")
    return {"rows": n, "out_of_vocabulary": outside, "columns": len(hot)}


def classify_for_migration(stamps: DataFrame, target: str, accepted: list[str]) -> DataFrame:
    """State of each partition: at target, patched (to be), legacy (no stamp) or refused."""
    v = F.col("features")
    state = F.when(v.isNull(), "skipped_legacy").when(v == target, "skipped_at_target").when(v.isin(*accepted), "patched").otherwise("refused")
    return stamps.withColumn("state", state)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, at = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The partitions' folders below ``path``."""
    found = [""]
    for column in PARTITION:
        found = [f"{f}/{n}".lstrip("/") for f in found for n in _names(spark, f"{path}/{f}" if f else path) if n.startswith(f"{column}=")]
    return found


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, to = _at(spark, new)
    fs.mkdirs(to.getParent())
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(old), to):
        raise OSError(f"{old} can't be moved to {new}")
