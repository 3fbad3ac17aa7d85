"""Session runs of dialogue turns, their windows, and smoothing of scores between neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task sorts at once, about.
TASK_ROWS = 250_000


def session_windows(turns: DataFrame, *, session: str = "session_id", order: str = "id", size: int = 64) -> DataFrame:
    """``turns`` with position (in the session), window_index and n_in_window: at most ``size`` turns a window."""
    by = W.partitionBy(session).orderBy(order)
    t = turns.withColumn("position", F.row_number().over(by) - 1)
    t = t.withColumn("window_index", F.floor(F.col("position") / size))
    return t.withColumn("n_in_window", F.count("*").over(W.partitionBy(session, "window_index")))


def runs(turns: DataFrame, *, session: str = "session_id", order: str = "id", partition: str) -> DataFrame:
    """(partition, run, session, first, last, n): contiguous turns of one session, within each ``partition``."""
    by = W.partitionBy(partition).orderBy(order)
    change = (~F.col(session).eqNullSafe(F.lag(session).over(by)) | (F.row_number().over(by) == 1)).cast("int")
    t = turns.withColumn("run", F.sum(change).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return t.groupBy(partition, "run", session).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def smooth(scored: DataFrame, *, session: str = "session_id", order: str = "id", score: str = "score", radius: int = 2) -> DataFrame:
    """``scored`` with smoothed: the larger of the score and its blends with decayed neighbours within ``radius``."""
    by = W.partitionBy(session).orderBy(order)
    near = []
    for d in range(1, radius + 1):
        decay = max(0.68, 0.94 - 0.035 * d)
        near += [F.lag(score, d).over(by) * decay, F.lead(score, d).over(by) * decay]
    known = F.filter(F.array(*near), lambda x: x.isNotNull())
    top = F.coalesce(F.array_max(known), F.lit(0.0))
    mean = F.avg(score).over(by.rowsBetween(-radius, radius))
    s = F.col(score)
    return scored.withColumn("smoothed", F.greatest(s, 0.5 * s + 0.5 * top, 0.58 * s + 0.42 * mean))


def ranges(lines: DataFrame, *, key: str, line: str = "line") -> DataFrame:
    """(key, first, last): maximal runs of consecutive line numbers.

    Rows are dealt out once, by key, to one task for about ``TASK_ROWS`` of them, so that a task's memory doesn't grow with the table.
    """
    d = lines.select(key, line)
    d = d.repartition(max(1, -(-d.count() // TASK_ROWS)), key).distinct()
    return d.withColumn("island", F.col(line) - F.row_number().over(W.partitionBy(key).orderBy(line))).groupBy(key, "island").agg(F.min(line).alias("first"), F.max(line).alias("last")).drop("island")
