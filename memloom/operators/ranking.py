"""Scores of candidates, their fusion, greedy selection and packing into a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import words

RRF_K = 60


def fuse(arms: dict[str, DataFrame], *, k: int = 100) -> DataFrame:
    """(query_id, id, fused, n_arms, rank): reciprocal-rank fusion of (query_id, id, score) frames.

    Fused scores are normalised by the best possible sum; only positive scores take a rank; ties keep the smaller id.
    """
    ranked = None
    for name, arm in arms.items():
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        r = arm.where(F.col("score") > 1e-6).select("query_id", "id", F.lit(name).alias("arm"), place.alias("place"))
        ranked = r if ranked is None else ranked.unionByName(r)
    total = ranked.groupBy("query_id", "id").agg(F.sum(1 / (RRF_K + F.col("place"))).alias("s"), F.count("*").alias("n_arms"))
    fused = total.select("query_id", "id", F.round(F.col("s") / (len(arms) / (RRF_K + 1)), 6).alias("fused"), "n_arms")
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("fused"), "id"))).where(F.col("rank") <= k)


def z_unit(score, by):
    """Logistic-like unit of a score against its query's candidates; deviations under 0.04 count as 0.04."""
    mean, sd = F.avg(score).over(by), F.greatest(F.stddev_pop(score).over(by), F.lit(0.04))
    return 0.5 * (F.tanh((score - mean) / (2 * sd)) + 1)


def pack(items: DataFrame, *, budget: int, by: str = "query_id", order: str = "rank", text: str = "content") -> DataFrame:
    """``items`` with n_tokens and used, cut at the first item that overflows the budget.

    A group of many items needs no task of its own: each of a row's tokens counts at least once, so only the first ``budget``
    items with tokens can fit, and every task cuts to as many before the running sum.
    """
    t = items.withColumn("n_tokens", words.token_estimate(F.coalesce(F.col(text), F.lit(""))))
    place = F.row_number().over(W.partitionBy(by).orderBy(order))
    some = t.where("n_tokens > 0").withColumn("__place", place).where(F.col("__place") <= budget + 1).drop("__place")
    summed = some.unionByName(t.where("n_tokens = 0")).withColumn("used", F.sum("n_tokens").over(W.partitionBy(by).orderBy(order)))
    return summed.where(F.col("used") <= budget)


TIERS = [(8, 680), (20, 440)]  # fixed values: places, and characters of a body up to there; 320 beyond


def tiered(items: DataFrame, *, budget: int, by: str = "query_id", order: str = "rank", text: str = "content") -> DataFrame:
    """``items`` whose bodies are cut by their place, where there are 30 items or more and the budget is 4,000 tokens or more."""
    place = F.row_number().over(W.partitionBy(by).orderBy(order))
    many = (F.count("*").over(W.partitionBy(by)) >= 30) & F.lit(budget >= 4000)
    most = F.when(~many, 4000).when(place <= TIERS[0][0], TIERS[0][1]).when(place <= TIERS[1][0], TIERS[1][1]).otherwise(320)
    return items.withColumn(text, F.substr(F.coalesce(F.col(text), F.lit("")), F.lit(1), most))


def round_robin(items: DataFrame, *, by: str = "query_id", session: str = "session_id", order: str = "rank") -> DataFrame:
    """``items`` with turn: the first of each session, then the second of each, and so on."""
    t = items.withColumn("nth", F.row_number().over(W.partitionBy(by, session).orderBy(order)))
    return t.withColumn("turn", F.row_number().over(W.partitionBy(by).orderBy("nth", order))).drop("nth")


def suppress(pool: DataFrame, *, by: str = "query_id", order: str = "rank", text: str = "content", threshold: float = 0.88, exempt: str | None = None) -> DataFrame:
    """The pool without items whose words (over two letters) match an earlier kept item's; pools are bounded by their k.

    Of a dialogue turn only the USER clause counts, and only if it has six such words; ``exempt`` names a boolean column of
    items that always stay and suppress nothing.
    """
    clause = words.user_clause(F.coalesce(F.col(text), F.lit("")))
    of = F.when(clause != "", clause).otherwise(F.coalesce(F.col(text), F.lit("")))
    ws = F.array_distinct(F.filter(F.split(F.lower(of), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    free = F.col(exempt) if exempt else F.lit(False)
    t = pool.withColumns({"__words": ws, "__least": F.when(clause != "", 6).otherwise(1), "__free": free})

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, keep = [], []
        for r in (pdf := pdf.sort_values(order))[["__words", "__least", "__free"]].itertuples(index=False):
            s = set(r[0])
            same = not r[2] and len(s) >= r[1] and any(len(s & k) > threshold * len(s | k) for k in kept)
            keep.append(not same)
            if not same and not r[2]:
                kept.append(s)
        return pdf[keep].drop(columns=["__words", "__least", "__free"])

    return t.groupBy(by).applyInPandas(greedy, pool.schema)


def recall(found: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (10, 20, 30, 50)) -> DataFrame:
    """(query_id, recall_at_k ..., reciprocal_rank): found has (query_id, id, rank), truth (query_id, id)."""
    t = truth.select("query_id", "id").distinct().join(found.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    return t.groupBy("query_id").agg(*[F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias(f"recall_at_{k}") for k in ks], F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))
