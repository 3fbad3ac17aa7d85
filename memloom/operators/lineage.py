"""Chains of rows that supersede one another, and the state that a log of changes leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chains(rows: DataFrame, *, hops: int = 8) -> DataFrame:
    """(id, terminal_id, depth): follow superseded_by from every row, at most ``hops`` steps."""
    return paths(rows, hops=hops).select("id", F.element_at("path", -1).alias("terminal_id"), (F.size("path") - 1).alias("depth"))


def paths(rows: DataFrame, *, hops: int = 8) -> DataFrame:
    """(id, path): the ids from each row along superseded_by; a cycle, or an id that no row has, ends the walk.

    Each join doubles the walks: a row's path is joined with the path of its last row, so eight hops take three joins of
    arrays of at most nine ids.
    """
    ids = rows.select(F.col("id").alias("next")).distinct()
    edges = rows.where(F.col("superseded_by").isNotNull()).select("id", F.col("superseded_by").alias("next")).join(ids, "next")
    walk = rows.select("id").join(edges, "id", "left").select("id", F.filter(F.array("id", "next"), lambda x: x.isNotNull()).alias("path"))
    length = 1
    while length < hops:
        ahead = walk.select(F.col("id").alias("last"), F.slice("path", 2, hops).alias("more"))
        met = walk.withColumn("last", F.element_at("path", -1)).join(ahead, "last", "left")
        # A path that has ended has itself as its last row's path: nothing is added.
        walk = met.select("id", F.concat("path", F.when(F.size("path") == length + 1, F.coalesce("more", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>"))).alias("path"))
        length *= 2
    path = F.slice("path", 1, hops + 1)
    again = F.filter(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_position(path, F.get(path, i - 1)) < i)
    n = F.when(F.size(again) > 0, F.get(again, F.lit(0)) - 1).otherwise(F.size(path))
    return walk.select("id", F.slice(path, F.lit(1), n).alias("path"))


def active_terminals(rows: DataFrame, *, hops: int = 8) -> DataFrame:
    """(id, terminal_id): the end of each row's chain, null where that row isn't active."""
    ends = chains(rows, hops=hops).join(rows.select(F.col("id").alias("terminal_id"), "status"), "terminal_id")
    return ends.select("id", F.when(F.col("status") == "ACTIVE", F.col("terminal_id")).alias("terminal_id"))


def histories(rows: DataFrame, *, hops: int = 8) -> DataFrame:
    """(id, step, step_id, status): every row's whole chain, oldest first, both ways along its links.

    rows: id, superseded_by, supersedes_id, status; a link given on one side only is followed all the same (back to the row
    with the smallest id that names it, forward to the child with the largest).
    """
    back = rows.where("supersedes_id is not null").select("id", F.col("supersedes_id").alias("older"))
    told = rows.where("superseded_by is not null").groupBy(F.col("superseded_by").alias("id")).agg(F.min("id").alias("older"))
    older = rows.select("id").join(back, "id", "left").join(told.withColumnRenamed("older", "o"), "id", "left").select("id", F.coalesce("older", "o").alias("superseded_by"))
    child = rows.where("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("id")).agg(F.max("id").alias("newer"))
    newer = rows.select("id", "superseded_by").join(child, "id", "left").select("id", F.coalesce("superseded_by", "newer").alias("superseded_by"))
    first = chains(older, hops=hops).select("id", F.col("terminal_id").alias("root"))
    steps = paths(newer, hops=hops).select(F.col("id").alias("root"), F.posexplode("path").alias("step", "step_id"))
    return first.join(steps, "root").join(rows.select(F.col("id").alias("step_id"), "status"), "step_id").select("id", (F.col("step") + 1).alias("step"), "step_id", "status")


def current(log: DataFrame) -> DataFrame:
    """State of every id after its last change; ``log``: id, seq, op, content, target. Deleted ids are gone."""
    last = log.groupBy("id").agg(
        F.max_by("op", "seq").alias("op"),
        F.max_by("content", F.when(F.col("op").isin("insert", "update"), F.col("seq"))).alias("content"),
        F.max_by("target", F.when(F.col("op") == "supersede", F.col("seq"))).alias("superseded_by"),
    )
    status = F.when(F.col("op") == "supersede", "SUPERSEDED").when(F.col("op") == "invalidate", "INVALIDATED").otherwise("ACTIVE")
    return last.where("op != 'delete'").select("id", "content", status.alias("status"), "superseded_by")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key (partial maxima on the map side, no window)."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in others if c != order])).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def weights(events: DataFrame, *, rule: str = "rule_id", order: str = "id", feedback: str = "feedback") -> DataFrame:
    """(rule, weight, n): a fold of max(0, w + delta) over each rule's feedback in order, from 1.0.

    A run of deltas acts as w -> max(floor, w + shift), and such maps compose: with prefix sums S the weight is
    max(1 + S, S - min prefix S).  A rule's events are cut into stretches by order (as many as the shuffle has partitions);
    each stretch gives its sum and least prefix, and the few stretches of a rule are put together, so no rule needs one task.
    """
    from pyspark.sql import Window as W

    # Fixed values.
    delta = F.when(F.col(feedback) == "accepted", 0.2).when(F.col(feedback) == "dismissed", -0.3).when(F.col(feedback) == "rejected", -0.6).otherwise(0.0)
    each = events.select(F.col(rule), F.col(order), delta.cast("decimal(18,1)").alias("d"))
    dealt = each.repartitionByRange(rule, order).withColumn("stretch", F.spark_partition_id())
    w = W.partitionBy(rule, "stretch").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = dealt.withColumn("s", F.sum("d").over(w)).groupBy(rule, "stretch").agg(F.sum("d").alias("s"), F.min("s").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("s").over(W.partitionBy(rule).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    end = sums.withColumn("low", F.col("low") + before).groupBy(rule).agg(F.sum("s").alias("s"), F.min("low").alias("low"), F.sum("n").alias("n"))
    return end.select(rule, F.greatest(1 + F.col("s"), F.col("s") - F.col("low")).cast("double").alias("weight"), "n")
