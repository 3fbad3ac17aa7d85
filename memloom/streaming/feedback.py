"""Feedback and append logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
DELTAS = {"accepted": 0.2, "dismissed": -0.3, "rejected": -0.6}


def running_weights(events: DataFrame, *, rule: str = "rule_id", feedback: str = "feedback", order: str = "id") -> DataFrame:
    """(rule, weight, n) after every batch that touches a rule: max(0, w + delta) folded into one small state a rule."""

    def fold(key, batches: Iterator[pd.DataFrame], state):
        w, n = state.get if state.exists else (1.0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for f in rows[feedback]:
            w, n = max(0.0, w + DELTAS.get(f, 0.0)), n + 1
        state.update((w, n))
        yield pd.DataFrame({rule: [key[0]], "weight": [w], "n": [n]})

    kind = events.schema[rule].dataType.simpleString()
    return events.groupBy(rule).applyInPandasWithState(fold, f"{rule} {kind}, weight double, n long", "weight double, n long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, *, time: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events a window and type; rows later than the watermark are dropped."""
    w = F.window(time, window)
    return events.withWatermark(time, late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Write-behind: each micro-batch is appended once; the batch id makes a repeated batch overwrite itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def index_rows(stream: DataFrame, index, checkpoint: str, **names):
    """Keep a stored index (``operators.index.TermIndex``) beside an append log: each micro-batch is one batch of changes.

    The batch id makes a repeated micro-batch count once; ``names`` say which columns hold the key, text, part and deletions.
    """
    return stream.writeStream.foreachBatch(lambda batch, n: index.apply(batch, n, **names) and None).option("checkpointLocation", checkpoint)


def refresh_rollups(stream: DataFrame, rows: str, path: str, checkpoint: str):
    """Keep session rollups up to date: a micro-batch is appended to ``rows``, and the projects it touches are built again.

    Whole projects, since where a run of turns ends depends on the turns of other sessions between.  Rollups are stored a
    batch; the newest batch of a project holds (``current_rollups``).
    """
    from ..functions import text as texts
    from ..operators import rollups

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        named = batch.withColumn("session_id", texts.session(F.coalesce("content", F.lit(""))))
        named.write.mode("overwrite").parquet(f"{rows}/batch={n}")
        touched = named.select(F.col("project").alias("p")).distinct()
        every = spark.read.parquet(rows).where(F.col("batch") <= n).drop("batch").join(touched, F.col("project").eqNullSafe(F.col("p")), "left_semi")
        rollups.build(every).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_rollups(stored: DataFrame) -> DataFrame:
    """The rollups of each project's newest batch."""
    newest = stored.groupBy(F.col("project").alias("p")).agg(F.max("batch").alias("b"))
    return stored.join(newest, F.col("project").eqNullSafe(F.col("p")) & (F.col("batch") == F.col("b"))).drop("p", "b", "batch")
