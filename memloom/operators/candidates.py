"""Candidates of questions: scans, lookups, merges of several sources, pools and orders of priority."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, words
from . import ordered as numbers


def newest(rows: DataFrame, *, order: str = "created_at", key: str = "id", limit: int = 250) -> DataFrame:
    """The newest rows; equal times go by the larger key."""
    return rows.orderBy(F.desc(order), F.desc(key)).limit(limit)


def wildcard(rows: DataFrame, *, key: str = "id", limit: int = 250) -> DataFrame:
    """All questions in one: the newest rows with one score."""
    return rows.orderBy(F.desc(key)).limit(limit).withColumn("score", F.lit(0.85))


def by_ids(rows: DataFrame, ids: DataFrame, *, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def by_file_names(rows: DataFrame, names: list[str], *, file: str = "file", key: str = "id", limit: int = 24) -> DataFrame:
    """The newest rows whose file path holds one of the names."""
    low = F.lower(F.coalesce(F.col(file), F.lit("")))
    hit = F.exists(F.array(*[F.lit(n.lower()) for n in names]).cast("array<string>"), lambda n: F.contains(low, n))
    return rows.where(hit).orderBy(F.desc(key)).limit(limit)


def stale(rows: DataFrame, now: Column, *, days: int = 30, limit: int = 30) -> DataFrame:
    """Rows that nothing has touched for ``days``: invariants last, oldest first."""
    last = F.coalesce("last_accessed_at", "updated_at", "created_at")
    old = rows.withColumn("touched", last).where(F.col("touched") < now - F.make_dt_interval(F.lit(days)))
    return old.orderBy((F.col("category") == "invariant").cast("int"), "touched", "id").limit(limit)


def by_affinity(rows: DataFrame, project: str, *, file: str = "file", text: str = "content", order: str = "rank") -> DataFrame:
    """``rows`` with affinity and place: rows of the project first, in their order otherwise."""
    a = rows.withColumn("affinity", paths.affinity(F.col(file), F.col(text), project).cast("int")).withColumn("__far", -F.col("affinity"))
    return numbers.running(a, ["__far"], [order]).join(F.broadcast(_before(a)), "__far").withColumn("place", F.col("place") + F.col("__before") + 1).drop("__far", "__before")


def _before(a: DataFrame) -> DataFrame:
    """(__far, __before): rows of nearer affinities; affinities are a handful of values."""
    n = a.groupBy("__far").agg(F.count("*").alias("n"))
    return n.select("__far", (F.sum("n").over(W.orderBy("__far")) - F.col("n")).alias("__before"))


def merge_chunks(found: DataFrame, remote: DataFrame, *, text: str = "content") -> DataFrame:
    """``found`` and the remote texts that it lacks, whatever their case and outer blanks; remote scores lie between 0.55 and 0.95."""
    same = lambda c: F.lower(F.trim(c))
    known = found.select(same(F.col(text)).alias("__same")).distinct()
    new = remote.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").withColumn("__same", same(F.col(text)))
    score = F.greatest(F.lit(0.55), F.least(F.lit(0.95), F.coalesce(F.col("score").cast("double"), F.lit(0.72))))
    once = new.withColumn("score", score).groupBy("__same").agg(F.max(F.struct("score", text)).alias("r"))
    return found.select(text, "score").unionByName(once.join(known, "__same", "left_anti").select(F.col(f"r.{text}").alias(text), F.col("r.score").alias("score")))


def union(sources: list[DataFrame], *, keys: tuple[str, ...] = ("query_id", "id")) -> DataFrame:
    """One row a key, from the first source that has it; ``sources`` lists all that do."""
    parts = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    others = [c for c in every.columns if c not in (*keys, "__source")]
    out = every.groupBy(*keys).agg(F.min(F.struct("__source", *others)).alias("r"), F.array_sort(F.collect_set("__source")).alias("sources"))
    return out.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others], "sources")


def forwarded(hits: DataFrame, terminals: DataFrame, *, temporal: bool = False) -> DataFrame:
    """Hits (query_id, id, score) moved to the end of their chains (id, terminal_id); rows without an end stay in temporal mode only."""
    t = hits.join(terminals.select("id", "terminal_id"), "id", "left")
    t = t if temporal else t.where(F.col("terminal_id").isNotNull())
    return t.groupBy("query_id", F.coalesce("terminal_id", "id").alias("id")).agg(F.max("score").alias("score"))


def ordered(scored: DataFrame) -> DataFrame:
    """``scored`` with rank: by score, unclamped score (both to 6 places) and newest id."""
    by = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), F.desc(F.round(F.coalesce("unclamped", "score"), 6)), F.desc("id"))
    return scored.withColumn("rank", F.row_number().over(by))


def kept(scored: DataFrame) -> DataFrame:
    """Rows above the score that their kind needs: dialogue turns 0.25, others 0.4."""
    return scored.where(F.col("score") > F.when(F.col("dialogue"), 0.25).otherwise(0.4))


#: Rows that each arm brings into the pool besides the best by score. Fixed values.
ARMS = {"semantic": 24, "idf": 24, "user": 28}


def pool(scored: DataFrame, *, budget: int = 4000) -> DataFrame:
    """The best rows of each question by score (budget / 20, 160 at least), and the best by each arm that its columns have."""
    best = ordered(scored)
    keep = F.col("rank") <= max(160, -(-budget // 20))
    for arm, k in ARMS.items():
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(arm), "rank"))
        best = best.withColumn(f"__{arm}", place)
        keep |= F.col(f"__{arm}") <= k
    return best.where(keep).drop(*[f"__{a}" for a in ARMS])


def by_priority(lists: list[DataFrame], *, keys: tuple[str, ...] = ("query_id", "id")) -> DataFrame:
    """(keys, place): the lists (keys, rank) one after the other, each row where it comes first."""
    slots = None
    for i, part in enumerate(lists):
        p = part.select(*keys, F.struct(F.lit(i).alias("list"), F.col("rank").cast("long").alias("rank")).alias("slot"))
        slots = p if slots is None else slots.unionByName(p)
    first = slots.groupBy(*keys).agg(F.min("slot").alias("slot")).select(*keys, F.col("slot.list").alias("__list"), F.col("slot.rank").alias("__rank"))
    return numbers.running(first, [keys[0]], ["__list", "__rank", *keys[1:]]).withColumn("place", F.col("place") + 1).drop("__list", "__rank")


def facet_cover(pools: DataFrame, *, rounds: int = 2, least: float = 0.50) -> DataFrame:
    """(query_id, id, place): rows that cover a question's stems one after the other, new sessions preferred.

    ``pools``: query_id, id, rank, score, session_id, stems, wanted; bounded by the search's k.  Greedy, so in one task a question.
    """

    def cover(pdf: pd.DataFrame) -> pd.DataFrame:
        left = [(r.id, r.score, r.session_id, set(r.stems)) for r in pdf.sort_values("rank").itertuples()]
        wanted, out = set(pdf["wanted"].iat[0]), []
        for _ in range(rounds):
            open_, seen = set(wanted), set()
            while left and open_:
                gains = []
                for i, (_, score, session, stems) in enumerate(left):
                    new = len(open_ & stems)
                    fresh = 0.08 if session == session and session is not None and session not in seen else 0.0
                    if score >= least and new:
                        gains.append((score + 0.32 * new / len(open_) + fresh, -i))
                if not gains:
                    break
                key, _, session, stems = left.pop(-max(gains)[1])
                out.append(key)
                open_ -= stems
                seen.add(session)
        return pd.DataFrame({"query_id": [pdf["query_id"].iat[0]] * len(out), "id": out, "place": range(1, len(out) + 1)})

    kind = pools.schema
    return pools.groupBy("query_id").applyInPandas(cover, f"query_id {kind['query_id'].dataType.simpleString()}, id {kind['id'].dataType.simpleString()}, place int")


def covering_set(pools: DataFrame, *, target: int = 5, redundancy: float = 0.6) -> DataFrame:
    """(query_id, id, place): at most ``target`` rows by score, each unlike those before; filled up by score where too few differ."""

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples())
        sets = [{w for w in "".join(c if c.isalnum() or c == "_" else " " for c in (r.content or "").lower()).split() if len(w) > 2} for r in rows]
        chosen: list[int] = []
        for i, s in enumerate(sets):
            if len(chosen) < target and all(not (s and sets[j]) or len(s & sets[j]) < redundancy * len(s | sets[j]) for j in chosen):
                chosen.append(i)
        chosen += [i for i in range(len(rows)) if i not in chosen][: target - len(chosen)]
        return pd.DataFrame({"query_id": [rows[i].query_id for i in chosen], "id": [rows[i].id for i in chosen], "place": range(1, len(chosen) + 1)})

    kind = pools.schema
    return pools.groupBy("query_id").applyInPandas(select, f"query_id {kind['query_id'].dataType.simpleString()}, id {kind['id'].dataType.simpleString()}, place int")


def both_packed(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """Pairs (query_id, older, newer) whose two rows are packed (query_id, id)."""
    ids = packed.select("query_id", "id")
    return pairs.join(ids.withColumnRenamed("id", "older"), ["query_id", "older"], "left_semi").join(ids.withColumnRenamed("id", "newer"), ["query_id", "newer"], "left_semi")


def progress(rows: DataFrame, *, by: str = "query_id", order: str = "id", most: float = 0.035) -> DataFrame:
    """``rows`` with boost: from 0 for the first row of each group to ``most`` for the last."""
    return rows.withColumn("boost", F.percent_rank().over(W.partitionBy(by).orderBy(order)) * most)


def nth_best(scored: DataFrame, n: int, *, by: str = "query_id", score: str = "score", otherwise: float = 0.78) -> DataFrame:
    """(by, ceiling): a little under the n-th best score of each group, or ``otherwise`` where there are fewer."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(score)))
    top = scored.withColumn("__place", place).where(F.col("__place") <= n)
    return top.groupBy(by).agg(F.when(F.max("__place") == n, F.min(score) - 0.002).otherwise(otherwise).alias("ceiling"))


def unattested(queries: DataFrame, rows: DataFrame, *, text: str = "content") -> DataFrame:
    """(query_id, term): distinctive terms of questions whose stems no row holds."""
    asked = queries.select("query_id", F.explode(words.distinctive_terms(F.col("query"))).alias("term")).withColumn("stem", words.stem(F.col("term")))
    each = rows.select(F.explode(words.tokens(F.coalesce(F.col(text), F.lit("")))).alias("w")).select(words.stem(F.col("w")).alias("stem"))
    held = each.join(asked.select("stem").distinct(), "stem", "left_semi").distinct()
    return asked.join(held, "stem", "left_anti").select("query_id", "term")


def plurality_sessions(hits: DataFrame) -> DataFrame:
    """(query_id, session_id, n): the session with strictly the most hits of each question, where there is one."""
    n = hits.where(F.col("query_id").isNotNull() & F.col("session_id").isNotNull()).groupBy("query_id", "session_id").agg(F.count("*").alias("n"))
    # The hits, a whole search, stand in the plan once.
    top = n.withColumn("place", F.rank().over(W.partitionBy("query_id").orderBy(F.desc("n")))).where("place = 1")
    return top.groupBy("query_id").agg(F.max("session_id").alias("session_id"), F.max("n").alias("n"), F.count("*").alias("ties")).where("ties = 1").drop("ties")
