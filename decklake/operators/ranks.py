"""Global positions, ranks and quantiles without a window over all rows.

The order is cut into buckets at keys drawn from the data; windows stay within
a bucket, and each bucket starts where the counts of those before it end.
What depends on values alone is worked out on distinct values with their
counts, so that a value that a third of all rows share is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.materialise import held

#: Rows of a bucket, about; the most buckets; keys drawn for each.
BUCKET_ROWS, MOST_BUCKETS, DRAWN = 50_000, 8192, 20


def _bucket(df: DataFrame, keys: list[str], bucket_rows: int) -> Column | None:
    """The number of cuts at or below a row's keys: rows with the same keys share a bucket.  None where one bucket holds all rows."""
    n = df.count()
    buckets = min(MOST_BUCKETS, n // bucket_rows)
    if buckets < 2:
        return None
    drawn = df.select(*keys).sample(min(1.0, DRAWN * buckets / n), seed=1).orderBy(*keys).collect()
    cuts = list(dict.fromkeys(drawn[len(drawn) * i // buckets] for i in range(1, buckets))) if drawn else []
    kinds = {f.name: f.dataType for f in df.select(*keys).schema}
    if not cuts:
        return None
    at = F.array(*[F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(keys, row)]) for row in cuts])
    own = F.struct(*[F.col(k).alias(k) for k in keys])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(cuts)).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(at, low + step - 1) <= own, F.lit(False)), low + step).otherwise(low))


def running(df: DataFrame, keys: list[str], amounts: dict[str, Column], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with, for each name of ``amounts``, its sum over all rows before by ``keys``, nulls first."""
    bucket = _bucket(df, keys, bucket_rows)
    if bucket is None:
        whole = Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(whole), F.lit(0)) for n, c in amounts.items()})
    rows = df.withColumn("own_bucket", bucket)
    sums = rows.groupBy("own_bucket").agg(*[F.sum(c).alias(f"own_{n}") for n, c in amounts.items()])
    before = Window.partitionBy(F.lit(0)).orderBy("own_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("own_bucket", *[F.coalesce(F.sum(f"own_{n}").over(before), F.lit(0)).alias(f"own_{n}") for n in amounts])
    within = Window.partitionBy("own_bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in amounts.items()})
    rows = rows.join(F.broadcast(starts), "own_bucket")  # a row a bucket at most
    return rows.withColumns({n: F.col(n) + F.col(f"own_{n}") for n in amounts}).drop("own_bucket", *[f"own_{n}" for n in amounts])


def positions(df: DataFrame, by: str, ties: list[str], name: str = "position", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with each row's place from 0 by ``by``, then ``ties``."""
    return running(df, [by, *ties], {name: F.lit(1)}, bucket_rows)


def joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Both tables side by side by ``by``, where null is a key like any other."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    right = right.withColumnsRenamed({k: f"own_{i}" for i, k in enumerate(by)})
    return left.join(right, [left[k].eqNullSafe(right[f"own_{i}"]) for i, k in enumerate(by)]).drop(*[f"own_{i}" for i in range(len(by))])


def beside(df: DataFrame, by: list[str], **values: Column) -> DataFrame:
    """``df`` with aggregates of each row's group: a group with most rows is a partial sum in each task, then a join whose hot keys can be split."""
    return joined(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in values.items()]), by)


def clustered(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by its keys into all partitions that the session sets.

    Short rows compress well, and partitions put together by their bytes hold so many
    groups that wide aggregates of them don't fit a task; these are taken as they are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ranked_values(df: DataFrame, value: str, by: list[str] | None = None, bucket_rows: int = BUCKET_ROWS, **sums: Column) -> DataFrame:
    """Distinct values of each group: how many rows have them (n), how many of the group come before, and the group's total; and ``sums`` by value."""
    by = by or []
    # Written once: they are counted, sampled, summed and placed.
    values = held(df.groupBy(*by, value).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in sums.items()]), "values")
    rows = running(values, [*by, value], {"before": F.col("n")}, bucket_rows)
    rows = beside(rows, by, own_start=F.min("before"), total=F.sum("n"))
    return rows.withColumn("before", F.col("before") - F.col("own_start")).drop("own_start")


def average_ranks(df: DataFrame, by: str, name: str = "rank", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(``by``, ``name``, n): the average rank from 1 of each distinct value, and how many rows have it."""
    return ranked_values(df, by, None, bucket_rows).select(by, (F.col("before") + (F.col("n") + 1) / 2).alias(name), "n")


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, name: str = "q", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row a group: ``name``, the exact quantiles at ``shares``, between neighbouring values in proportion; null values don't count."""
    rows = ranked_values(df.filter(F.col(value).isNotNull()), value, by, bucket_rows)
    place = [F.col("total") - 1] * len(shares)
    place = [p * F.lit(float(s)) for p, s in zip(place, shares)]
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))
    parts = [c for i, p in enumerate(place) for c in (at(F.floor(p)).alias(f"low{i}"), at(F.ceil(p)).alias(f"high{i}"), F.max(p - F.floor(p)).alias(f"part{i}"))]
    found = rows.groupBy(*(by or [])).agg(*parts)
    # As Spark's percentile does it.
    between = [F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}")).otherwise((1 - F.col(f"part{i}")) * F.col(f"low{i}") + F.col(f"part{i}") * F.col(f"high{i}")) for i in range(len(shares))]
    return found.select(*(by or []), F.array(*between).alias(name))
