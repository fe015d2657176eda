"""Streams of evaluation rows and training histories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHECKED = "key string, epoch long, expected long, accepted boolean"


def confusion_stream(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Running (weighted) confusion counts of a stream of (t, p): state is one row a cell."""
    n = F.sum(weight) if weight else F.count("*")
    return rows.groupBy("t", "p").agg(n.alias("n"))


def macro_f1(cells: DataFrame, classes: int) -> DataFrame:
    """Macro F1 of confusion counts over all classes, absent ones as zero."""
    true = cells.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    pred = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    f1 = F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)) * 2.0, F.coalesce("support", F.lit(0)) + F.coalesce("predicted", F.lit(0))), F.lit(0.0))
    return true.join(pred, "c", "full_outer").agg((F.coalesce(F.sum(f1), F.lit(0.0)) / classes).alias("macro_f1"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sequence_checked(rows: DataFrame) -> DataFrame:
    """Each (key, epoch) of a stream with the epoch that its key was to bring next, and whether it did.

    An epoch out of turn is rejected and leaves the key's place as it is.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected = state.get[0] if state.exists else 1
        out = []
        for epoch in sorted(int(e) for pdf in frames for e in pdf["epoch"]):
            accepted = epoch == expected
            out.append((key[0], epoch, expected, accepted))
            expected += accepted
        state.update((expected,))
        yield pd.DataFrame(out, columns=["key", "epoch", "expected", "accepted"])

    keyed = rows.select(F.col("key").cast("string").alias("key"), F.col("epoch").cast("long").alias("epoch"))
    return keyed.groupBy("key").applyInPandasWithState(step, CHECKED, "next long", "append", GroupStateTimeout.NoTimeout)


def append_history(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what a stream has now to a Parquet history, each row once, and stops."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
