"""Nuggets: key/value facts that steer answers; the last value of a key holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors, words
from ..sources import staging

# Fixed values.
KINDS = ["project", "user", "agent"]


def current(log: DataFrame) -> DataFrame:
    """(key, value, kind) after the last change of every key; ``log``: key, seq, op (set or forget), value, kind.

    Secrets and unknown kinds never become values: see ``refused``.
    """
    log = staging.once(log)  # values are read by many patterns
    sound = log.where(~refusal(log).isNotNull())
    last = sound.groupBy("key").agg(F.max_by(F.struct("op", "value", "kind"), "seq").alias("r"))
    return last.where("r.op != 'forget'").select("key", "r.value", "r.kind")


def refusal(log: DataFrame) -> Column:
    found = words.secret(F.concat_ws("\n", F.coalesce("key", F.lit("")), F.coalesce("value", F.lit(""))))
    kind = F.when((F.col("op") != "forget") & ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
    return F.coalesce(F.when(F.coalesce(F.trim("key"), F.lit("")) == "", "no key"), F.when(found.isNotNull(), F.concat(F.lit("secret: "), found)), kind)


def refused(log: DataFrame) -> DataFrame:
    return log.withColumn("reason", refusal(log)).where("reason is not null")


def scored(nuggets: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key, score): nuggets whose words a question has; the whole question inside a nugget scores most, ``*`` takes all."""
    q = F.lower("query")
    asked = queries.select("query_id", q.alias("q"), words.domain_terms(q).alias("terms"))
    # One row a key, read for stems, for scores and for ``*``: the log behind it is gone through once.
    hay = staging.staged(nuggets.select("key", F.lower(F.concat_ws(" ", "key", "value")).alias("hay")))
    each = asked.select("query_id", F.explode("terms").alias("term"))
    stems = hay.select("key", F.explode(F.array_distinct(F.concat(words.tokens(F.col("hay")), words.query_terms(F.col("hay"))))).alias("w")).select("key", words.stem(F.col("w")).alias("stem")).distinct()
    hits = each.withColumn("stem", words.stem(F.col("term"))).join(stems, "stem").groupBy("query_id", "key").agg(F.count_distinct("term").alias("hits"))
    met = hits.join(asked, "query_id").join(hay.select("key", "hay"), "key")
    share = F.col("hits") / F.size("terms")
    score = F.when(F.contains("hay", "q"), 0.88).when((F.size("terms") <= 2) | (F.col("hits") >= 2) | (share >= 0.25), 0.52 + 0.36 * share)
    every = asked.where("trim(q) = '*'").select("query_id").join(hay.select("key")).select("query_id", "key", F.lit(0.85).alias("score"))
    return met.select("query_id", "key", F.round(score, 6).alias("score")).where("score is not null").unionByName(every)


def nearest(nuggets: DataFrame, queries: DataFrame, *, k: int = 3) -> DataFrame:
    """(query_id, key, distance, rank): by vectors where both have one (a stated question set against all), else by the share of words not held."""
    asked = queries.select("query_id", "embedding", F.filter(F.split(F.lower("query"), "[^a-z0-9_]+"), lambda w: F.length(w) >= 3).alias("ws"))
    both = nuggets.withColumn("hay", F.lower(F.concat_ws(" ", "key", "value"))).withColumnRenamed("embedding", "v").join(F.broadcast(asked))  # questions: a stated set
    held = F.size(F.filter("ws", lambda w: F.contains(F.col("hay"), w)))
    by_words = F.when((F.size("ws") > 0) & (held > 0), F.greatest(F.lit(0.05), 1 - held / F.size("ws")))
    distance = F.when(F.col("v").isNotNull() & F.col("embedding").isNotNull(), 1 - vectors.cosine(F.col("v"), F.col("embedding"))).otherwise(by_words)
    d = both.select("query_id", "key", F.round(distance, 6).alias("distance")).where("distance is not null")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "key"))).where(F.col("rank") <= k)
