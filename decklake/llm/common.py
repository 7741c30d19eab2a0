"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space of the contracts: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is configured (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if found is None and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if found is None:
        found = "file://" + tempfile.mkdtemp(prefix="decklake-")
        sc.setCheckpointDir(found)
    return found


#: Shuffle files go at the end of a query, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, reread: its lineage is cut and survives lost executors, and its shuffle files are gone."""
    return written_in_parts([df], name)


def written_in_parts(parts: Iterable[DataFrame], name: str) -> tuple[DataFrame, str]:
    """The rows of all ``parts`` (one at least) as one table as ``written`` makes it; one part's shuffle files are on disk at a time."""
    path, schema = None, None
    for df in parts:
        spark = df.sparkSession
        path, schema = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", schema or df.schema
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that ``written`` made and that no later plan reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold_of(doc_id: str | Column) -> Column:
    """crc32 of the id's text modulo 5; 0 is held out.  A null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with every column that has one of ``names`` (in any case) under ``<name>_in``, or the first free ``<name>_in2``, ``_in3``, ..."""
    taken, wanted = {c.lower() for c in df.columns}, {n.lower() for n in names}
    moved = {}
    for column in df.columns:
        if column.lower() in wanted:
            tries = (f"{column}_in{k if k > 1 else ''}" for k in range(1, len(df.columns) + len(names) + 2))
            moved[column] = next(x for x in tries if x.lower() not in taken | wanted)
            taken.add(moved[column].lower())
    return df.withColumnsRenamed(moved) if moved else df
