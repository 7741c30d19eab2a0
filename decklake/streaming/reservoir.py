"""A uniform sample of a stream: the rows with the smallest hashed priorities.

Whether a row belongs to the sample of ``n`` depends on priorities alone, so
any cut into batches, and any dealing out over keys, gives the same rows.  Each
of several shards keeps the ``n`` smallest priorities that it has seen as its
state, and passes on the rows that get among them: some n * log(rows / n) a
shard in all.  The sample is the ``n`` first of what was passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor


class _Smallest(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", "priorities array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = np.array(self.kept.get()[0] if self.kept.exists() else [], dtype=np.int64)
        for frame in rows:
            new = frame["own_priority"].to_numpy(dtype=np.int64)
            held = np.sort(np.concatenate((held, new)))[: self.n]
            # Equal priorities all pass: which of them stay is settled by the rows themselves.
            inside = new <= held[-1] if len(held) == self.n else np.ones(len(new), dtype=bool)
            yield frame[inside].drop(columns="own_shard")
        self.kept.update((held.tolist(),))

    def close(self) -> None:
        pass


def candidates(stream: DataFrame, n: int, key: list[str], seed: int = 17, shards: int = 16) -> DataFrame:
    """Rows of ``stream``, with ``own_priority``, that may be in its sample of ``n``; for any sink in append mode.

    ``key`` tells rows apart; rows with equal keys have equal priorities.
    """
    if n < 1:
        raise ValueError("a sample has one row at least")
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    marked = stream.withColumn("own_priority", F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in key]))
    # The shard is other bits than those that order the rows, so each shard has its part of the smallest.
    marked = marked.withColumn("own_shard", F.pmod(F.xxhash64("own_priority", F.lit("shard")), F.lit(shards)))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name != "own_shard")
    return marked.groupBy("own_shard").transformWithStateInPandas(_Smallest(n), out, "append", "none")


def sample(passed: DataFrame, n: int, key: list[str]) -> DataFrame:
    """The sample of all that ``candidates`` passed on so far, read back from its sink."""
    return passed.orderBy("own_priority", *key).limit(n).drop("own_priority")
