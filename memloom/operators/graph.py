"""Related rows: anchors that rows share (ids, rule codes, files, tags), and second hops to other sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import words

# Strength of an edge by its kind, and the share of rows (and least number) beyond which a key says nothing.
STRENGTH = {"id": 0.92, "reverse": 0.84, "code": 0.88, "file": 0.80, "tag": 0.68}
COMMON = {"file": (5, 0.18), "tag": (4, 0.12)}


def anchors(text: Column, tags: Column) -> Column:
    """array<struct<kind, key>>: #id references, rule codes such as ABC-12, file paths, tags."""
    found = lambda kind, pattern, group: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    paths = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./-]*[A-Za-z0-9_-]\.[a-z]{1,4}(?![A-Za-z0-9])"), F.lit(0)), lambda k: F.struct(F.lit("file").alias("kind"), F.lower(F.element_at(F.split(k, "/"), -1)).alias("key")))
    named = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda k: F.struct(F.lit("tag").alias("kind"), F.lower(k).alias("key")))
    return F.array_distinct(F.concat(found("id", r"(?<![A-Za-z0-9])#([0-9]+)", 1), found("code", r"(?<![A-Za-z0-9])([A-Z]{2,}-[0-9]+)(?![A-Za-z0-9])", 1), paths, named))


def related(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, id, strength, edges): rows (id, content, tags) that share an anchor with, or refer to, a seed (query_id, id).

    Anchors are exploded and joined by (kind, key); keys that too many rows have are dropped by their kind's rule before
    the join, so no key brings a large group together; id references are joined as they are.
    """
    a = rows.select("id", F.explode(anchors(F.coalesce("content", F.lit("")), F.col("tags"))).alias("a")).select("id", "a.kind", "a.key")
    n = rows.agg(F.count("*").alias("n"))  # one row
    df = a.groupBy("kind", "key").agg(F.count("*").alias("df")).join(F.broadcast(n))
    most = F.when(F.col("kind") == "file", F.greatest(F.lit(COMMON["file"][0]), COMMON["file"][1] * F.col("n"))).when(F.col("kind") == "tag", F.greatest(F.lit(COMMON["tag"][0]), COMMON["tag"][1] * F.col("n")))
    telling = df.where(most.isNull() | (F.col("df") <= most)).select("kind", "key")
    shared = a.where("kind != 'id'").join(telling, ["kind", "key"], "left_semi")
    of_seeds = shared.join(seeds, "id").select("query_id", "kind", "key", F.col("id").alias("seed"))
    by_key = shared.join(of_seeds, ["kind", "key"]).where("id != seed").select("query_id", "id", "kind")
    refs = a.where("kind = 'id'").select("id", F.col("key").cast("long").alias("to"))
    ahead = refs.join(seeds, "id").select("query_id", F.col("to").alias("id"), F.lit("id").alias("kind")).join(rows.select("id"), "id", "left_semi").select("query_id", "id", "kind")
    back = refs.join(seeds.withColumnRenamed("id", "to"), "to").select("query_id", "id", F.lit("reverse").alias("kind"))
    edges = by_key.unionByName(ahead).unionByName(back).join(seeds, ["query_id", "id"], "left_anti")
    strength = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])
    return edges.groupBy("query_id", "id").agg(F.max(strength[F.col("kind")]).alias("strength"), F.array_sort(F.collect_set("kind")).alias("edges"))


def bridges(rows: DataFrame, seeds: DataFrame, queries: DataFrame, *, terms: int = 6, k: int = 12) -> DataFrame:
    """(query_id, id, shared, rank): rows of other sessions that hold the seeds' telling stems.

    rows: id, session_id, content; seeds: query_id, id (bounded by the search's k).  A stem tells when the question lacks
    it, it has four letters or more, and at most 15 % of the rows (or four) have it; the best ``terms`` a question are used.
    """
    s = rows.select("id", "session_id", F.explode(words.stems(F.coalesce("content", F.lit("")))).alias("term")).where(F.length("term") >= 4)
    n = rows.agg(F.count("*").alias("n"))
    df = s.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).where(F.col("df") <= F.greatest(F.lit(4), 0.15 * F.col("n")))
    asked = queries.select("query_id", F.explode(words.stems(F.col("query"))).alias("term"))
    held = s.join(seeds, "id").groupBy("query_id", "term").agg(F.count("*").alias("hits")).join(asked, ["query_id", "term"], "left_anti").join(df, "term")
    weight = F.round((F.col("hits") + 0.5) * F.log1p(F.col("n") / (1 + F.col("df"))), 6)
    best = held.withColumn("w", weight).withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("w"), "term"))).where(F.col("r") <= terms).select("query_id", "term", "w")
    home = seeds.join(rows.select("id", "session_id"), "id").select("query_id", "session_id").distinct()
    hop = s.join(best, "term").join(home, ["query_id", "session_id"], "left_anti").groupBy("query_id", "id").agg(F.count("*").alias("shared"), F.round(F.sum("w"), 6).alias("w"))
    return hop.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("w"), "id"))).where(F.col("rank") <= k).select("query_id", "id", "shared", "rank")
