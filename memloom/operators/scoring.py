"""Stages of a candidate's score, each a Column over one candidate frame keyed (query_id, id)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import words


def overlap(stems: Column, wanted: Column) -> Column:
    """Share of the wanted stems that a row has."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(stems, wanted)) / F.size(wanted)).otherwise(0.0)


def base(semantic: Column, direct: Column, total: Column, idf: Column, *, exact: Column, n_terms: Column, n_hits: Column, n_distinctive: Column, n_distinctive_hits: Column) -> Column:
    """Hybrid of meaning and words, held down where a single common word is all that matches."""
    blended = F.greatest(0.65 * direct + 0.35 * total, idf)
    lexical = 0.50 + 0.42 * blended
    hybrid = F.when(semantic > 0, 0.48 * semantic + 0.52 * idf + 0.16 * F.least(semantic, idf)).otherwise(lexical)
    return (
        F.when(exact, F.greatest(semantic, F.lit(0.92)))
        .when(n_hits == 0, F.when(semantic >= 0.68, semantic).otherwise(0.45 * semantic))
        .when((n_distinctive > 0) & (n_distinctive_hits == 0) & (semantic < 0.68), F.least(F.lit(0.35), 0.5 * semantic))
        .when((n_distinctive >= 4) & (n_distinctive_hits == 1) & (semantic < 0.66), F.least(F.lit(0.38), 0.55 * semantic))
        .when((n_terms >= 4) & (n_hits == 1) & (total < 0.25) & (semantic < 0.66), F.least(F.lit(0.38), 0.55 * semantic))
        .otherwise(F.least(F.lit(0.99), F.greatest(semantic, lexical, hybrid)))
    )


def recency(created: Column, now: Column) -> Column:
    """Small bonus that fades by 1 % a day."""
    days = (F.unix_micros(now) - F.unix_micros(created)) / 86_400_000_000
    return 0.02 * F.exp(-0.01 * days)


def feedback_terms(scored: DataFrame, *, seeds: int = 8, least: float = 0.52, most: int = 6) -> DataFrame:
    """(query_id, term, weight): stems that two or more of a query's best candidates share, none in over half of all its candidates.

    ``scored``: query_id, id, score, stems (array); pools are bounded by their k.
    """
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    t = scored.withColumn("seed", (place <= seeds) & (F.col("score") >= least)).withColumn("n", F.count("*").over(W.partitionBy("query_id")))
    per = t.select("query_id", "n", "seed", F.explode(F.array_distinct("stems")).alias("term")).groupBy("query_id", "term").agg(F.first("n").alias("n"), F.count_if("seed").alias("hits"), F.count("*").alias("df"))
    w = per.where("hits >= 2 and df * 2 <= n").select("query_id", "term", F.round(F.col("hits") * F.log1p(F.col("n") / (1 + F.col("df"))), 6).alias("weight"))
    return w.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weight"), "term"))).where(F.col("r") <= most).drop("r")


def span_tightness(text: Column, wanted: Column) -> Column:
    """coverage / (1 + 0.16 slack) of the shortest token window that holds every wanted stem the text has."""

    @F.pandas_udf("double")
    def tight(rows: pd.DataFrame) -> pd.Series:
        out = []
        for ws, q in zip(rows["ws"], rows["q"]):
            want = set(q) if q is not None else set()
            hits = [(i, w) for i, w in enumerate(ws if ws is not None else []) if w in want]
            have = {w for _, w in hits}
            if not have:
                out.append(0.0)
                continue
            seen: dict[str, int] = {}
            best = None
            for i, w in hits:  # positions ascend: the window ends here and begins at the least last-seen place
                seen[w] = i
                if len(seen) == len(have):
                    width = i - min(seen.values()) + 1
                    best = width if best is None else min(best, width)
            coverage = len(have) / len(want)
            out.append(0.45 * coverage if len(have) == 1 and len(want) > 1 else coverage / (1 + 0.16 * (best - len(have))))
        return pd.Series(out)

    return tight(F.struct(F.transform(words.tokens(F.coalesce(text, F.lit(""))), words.stem).alias("ws"), wanted.alias("q")))


def grounding(turns: DataFrame, queries: DataFrame, *, order: str = "id", session: str = "session_id", text: str = "content") -> DataFrame:
    """(query_id, n_terms, joint, status): whether any turn, with its two neighbours, holds all of a question's terms.

    Only terms of the question are joined; GROUNDED needs all in one window, UNATTESTED_ATTRIBUTE some, else UNSUPPORTED.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform(words.distinctive_terms(F.col("query")), words.stem))).alias("term"))
    n = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    by = W.partitionBy(session).orderBy(order)
    s = words.stems(F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<string>")
    near = turns.select(session, order, s.alias("s")).withColumn("before", F.lag("s").over(by)).withColumn("after", F.lead("s").over(by))
    around = near.select(order, F.explode(F.array_union(F.array_union(F.coalesce("before", none), "s"), F.coalesce("after", none))).alias("term"))
    joint = around.join(asked, "term").groupBy("query_id", order).agg(F.count("*").alias("k")).groupBy("query_id").agg(F.max("k").alias("joint"))
    k = F.coalesce("joint", F.lit(0))
    status = F.when(k == F.col("n_terms"), "GROUNDED").when(k > 0, "UNATTESTED_ATTRIBUTE").otherwise("UNSUPPORTED")
    return n.join(joint, "query_id", "left").select("query_id", "n_terms", k.alias("joint"), status.alias("status"))
