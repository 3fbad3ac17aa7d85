"""Session rollups: windows of dialogue turns with their stems, centroid and summary, and a coarse-to-fine search over them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors, words
from . import ordered, search

#: Rows below which a store has no rollups; rows of a window; stems and characters of a rollup.
LEAST_ROWS, WINDOW, STEMS, SUMMARY = 240, 64, 16, 420
MARKERS = "user assistant turn date".split()
EXCLUDED = sorted({*words.STOP_WORDS, *words.TEMPORAL_CUES, *words.GENERIC_WORDS, *words.META_WORDS, *MARKERS})


def told(rows: DataFrame, *, content: str = "content") -> DataFrame:
    """``rows`` with session_id, body, user_clause, date_label, directive and transition."""
    t = F.coalesce(F.col(content), F.lit(""))
    body = text.strip_citations(F.regexp_replace(t, r"^\[[^\]]+\]\s*", ""))
    user = words.user_clause(body)
    rows = rows.withColumn("session_id", text.session(t) if "session_id" not in rows.columns else F.col("session_id"))
    rows = rows.withColumn("body", body).withColumn("user_clause", F.when(user != "", user).otherwise(body)).withColumn("date_label", text.date_label(t))
    rule = F.col("category") == "invariant" if "category" in rows.columns else F.lit(False)
    return rows.withColumn("directive", F.coalesce(rule | ((user != "") & text.directive(user)), F.lit(False))).withColumn("transition", text.transition(F.col("user_clause")))


def turns(rows: DataFrame, *, order: str = "id", content: str = "content") -> DataFrame:
    """``rows`` with session_id, position, run, window_index, body, user_clause, directive, transition and date_label.

    A run is a stretch of turns of one session; runs are cut into windows of WINDOW turns, and a session's windows are
    numbered through; rows without a session form runs of their own kind.
    """
    rows = told(rows, content=content)
    rows = ordered.running(rows, ["session_id"], [order]).withColumnRenamed("place", "position")
    # A session's rows that stand together in the whole order have one difference of the two numbers.
    if "project" in rows.columns:
        rows = ordered.running(rows, ["project"], [order]).withColumn("run", F.col("place") + 1 - F.col("position")).drop("place")
    else:
        rows = rows.withColumn("run", F.col(order) - F.col("position"))
    # One line a run: where it starts in its session, and how many windows the session's runs before it fill.
    runs = rows.groupBy("session_id", "run").agg(F.min("position").alias("start"), F.ceil(F.count("*") / WINDOW).cast("long").alias("windows"))
    runs = ordered.running(runs, ["session_id"], ["run"], sums={"earlier": "windows"}).select(F.col("session_id").alias("__s"), F.col("run").alias("__r"), "start", "earlier")
    rows = rows.join(runs, F.col("session_id").eqNullSafe(F.col("__s")) & (F.col("run") == F.col("__r")))
    return rows.withColumn("window_index", F.col("earlier") + F.floor((F.col("position") - F.col("start")) / WINDOW)).drop("__s", "__r", "start", "earlier")


def salience() -> Column:
    return F.when(F.col("directive"), 1.40).when(F.col("position") <= 1, 1.35).when(F.col("transition"), 1.30).otherwise(1.0)


def informative(clause: Column) -> Column:
    """Stems of a clause's first 1,600 and last 800 characters without words that say nothing."""
    bounded = F.when(F.length(clause) <= 2400, clause).otherwise(F.concat_ws(" ", F.substring(clause, 1, 1600), F.substr(clause, F.length(clause) - 799)))
    telling = lambda a: F.filter(a, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~w.isin(*EXCLUDED))
    return telling(F.transform(telling(F.split(F.lower(bounded), "[^a-z0-9_]+")), words.stem))


def stem_counts(turns_: DataFrame) -> DataFrame:
    """(stem, df): rows that hold a telling stem."""
    return turns_.select(F.explode(F.array_distinct(informative(F.col("user_clause")))).alias("stem")).groupBy("stem").agg(F.count("*").alias("df"))


def window_stems(turns_: DataFrame, *, most: int = STEMS, counts: DataFrame | None = None) -> DataFrame:
    """(session_id, window_index, stems): the window's best stems by frequency, raised in directives and state changes, times idf over rows.

    ``counts`` (stem, df, n) stands for other rows than these alone.
    """
    boost = F.when(F.col("directive"), 1.35).when(F.col("transition"), 1.25).otherwise(1.0)
    each = turns_.select("session_id", "window_index", "id", (1.5 * boost).alias("w"), F.explode(informative(F.col("user_clause"))).alias("stem"))
    df = counts if counts is not None else stem_counts(turns_).join(F.broadcast(turns_.agg(F.count("*").alias("n"))))  # one row
    idf = df.select("stem", F.log1p(F.col("n") / (1 + F.col("df"))).alias("idf"))
    tf = each.groupBy("session_id", "window_index", "stem").agg(F.sum("w").alias("tf")).join(idf, "stem")
    place = F.row_number().over(W.partitionBy("session_id", "window_index").orderBy(F.desc(F.round(F.col("tf") * F.col("idf"), 9)), "stem"))
    best = tf.withColumn("place", place).where(F.col("place") <= most)
    return best.groupBy("session_id", "window_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "stem"))), lambda x: x["stem"]).alias("stems"))


def summaries(turns_: DataFrame, idf: DataFrame) -> DataFrame:
    """(session_id, window_index, summary): opener, two salient sentences, then clauses by the idf of stems not yet told.

    Greedy over at most WINDOW turns, so one task a window; turns come with their stems' weights, cut to what a clause needs.
    """
    each = turns_.select("session_id", "window_index", "id", F.explode_outer(F.array_distinct(informative(F.col("user_clause")))).alias("stem"))
    weights = each.join(idf, "stem", "left").groupBy("session_id", "window_index", "id").agg(F.collect_list(F.struct("stem", F.coalesce("idf", F.lit(1.0)).alias("idf"))).alias("weights"))
    marked = F.coalesce(F.get(F.filter(text.sentences(F.col("user_clause")), lambda s: text.transition(s) | text.directive(s)), F.lit(0)), F.col("user_clause"))
    rows = turns_.select("session_id", "window_index", "id", F.substring("user_clause", 1, 400).alias("clause"), F.substring(marked, 1, 118).alias("marked"), (F.col("directive") | F.col("transition")).alias("salient"))
    rows = rows.join(weights, ["session_id", "window_index", "id"]) if "session_id" not in _nullable(turns_) else rows.join(weights.select(*[F.col(c).alias(f"__{c}") for c in ("session_id", "window_index", "id")], "weights"), F.col("session_id").eqNullSafe(F.col("__session_id")) & (F.col("window_index") == F.col("__window_index")) & (F.col("id") == F.col("__id"))).drop("__session_id", "__window_index", "__id")

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        rows_ = list(pdf.sort_values("id").itertuples())
        said, sets, told = [], [], set()

        def add(clause: str, stems: set, most: int) -> bool:
            clause = clause if len(clause) <= most else clause[: most - 3].rsplit(" ", 1)[0] + "..."
            if len(clause) < 4 or any(len(stems) >= 3 and s and len(stems & s) >= 0.72 * min(len(stems), len(s)) for s in sets):
                return False
            if len(" | ".join([*said, clause])) > SUMMARY:
                return False
            said.append(clause)
            sets.append(stems)
            told.update(stems)
            return True

        stems = {r.id: {w["stem"]: w["idf"] for w in r.weights if w["stem"] is not None} for r in rows_}
        used = set()
        opener = next((r for r in rows_[:3] if len(r.clause) >= 12), rows_[0])
        if add(f"USER: {opener.clause}", set(stems[opener.id]), 155):
            used.add(opener.id)
        for r in [r for r in reversed(rows_) if r.salient and r.id not in used]:
            if len(used) < 3 and add(r.marked, set(stems[r.id]), 118):
                used.add(r.id)
        left = [r for r in rows_ if r.id not in used]
        news = lambda r: 0.75 * sum(v for k, v in stems[r.id].items() if k not in told) + 0.25 * sum(stems[r.id].values())
        for r in sorted(left, key=lambda r: (-round(news(r), 9), r.id)):
            if len(" | ".join(said)) >= SUMMARY - 45:
                break
            add(r.clause, set(stems[r.id]), 115)
        return pd.DataFrame({"session_id": [rows_[0].session_id], "window_index": [rows_[0].window_index], "summary": [" | ".join(said) or "Episode window"]})

    kind = turns_.schema
    return rows.groupBy("session_id", "window_index").applyInPandas(tell, f"session_id {kind['session_id'].dataType.simpleString()}, window_index {kind['window_index'].dataType.simpleString()}, summary string")


def _nullable(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if f.nullable}


def build(rows: DataFrame, *, order: str = "id") -> DataFrame:
    """One rollup a window: session_id, window_index, first, last, n, children, directives, date range, stems, and the digest of its turns."""
    return of_windows(turns(rows, order=order))


def of_windows(t: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The same from turns that know their windows; ``counts`` as in ``window_stems``."""
    if "project" not in t.columns:
        t = t.withColumn("project", F.lit(None).cast("string"))
    listed = lambda c: F.array_sort(F.collect_list(c))
    label = F.col("date_label").isNotNull()
    windows = t.groupBy("session_id", "window_index").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), listed("id").alias("children"), listed(F.when(F.col("directive"), F.col("id"))).alias("directives"),
        F.min_by("date_label", F.when(label, F.col("id"))).alias("first_date"), F.max_by("date_label", F.when(label, F.col("id"))).alias("last_date"),
        F.bit_xor(F.xxhash64("id", "body")).alias("digest"), F.min("project").alias("project"),
    )
    stems = window_stems(t, counts=counts).select(F.col("session_id").alias("s"), F.col("window_index").alias("w"), "stems")
    out = windows.join(stems, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("window_index") == F.col("w")), "left").drop("s", "w")
    both = F.when(F.col("first_date") == F.col("last_date"), F.col("first_date")).otherwise(F.concat_ws(" -> ", "first_date", "last_date"))
    return out.withColumn("dates", both).drop("first_date", "last_date")


def fingerprint(rows: DataFrame, *, content: str = "content") -> DataFrame:
    """One row (n, mark) that differs whenever a row does, whatever the order of the rows."""
    return rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id", content)).alias("mark"))


def episode_scores(rollups: DataFrame, queries: DataFrame, *, macro: bool = False) -> DataFrame:
    """(query_id, session_id, window_index, score, lexical, semantic): every rollup for every question of the stated set.

    Words by idf over rollups and by BM25 over stems and summary; meaning by the cosine of the centroids where both have vectors.
    """
    r = rollups.withColumn("id", F.xxhash64("session_id", "window_index"))
    body = F.concat_ws(" ", *[c for c in ("summary",) if c in r.columns], F.array_join("stems", " "))
    docs = r.select("id", body.alias("content"))
    hits = search.matches(docs, queries)
    best = hits.groupBy("query_id").agg(F.max("score").alias("top"))
    asked = search.query_stems(queries)
    n = r.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    held = search.postings(docs).select("id", "term").join(asked.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    weight = asked.join(df, "term", "left").join(F.broadcast(n)).select("query_id", "term", F.log1p(F.col("n") / (1 + F.coalesce("df", F.lit(0)))).alias("w"))
    total = weight.groupBy("query_id").agg(F.sum("w").alias("total"))
    overlap = held.join(weight, "term").groupBy("query_id", "id").agg(F.sum("w").alias("w")).join(total, "query_id").select("query_id", "id", (F.col("w") / F.col("total")).alias("overlap"))
    words_ = overlap.join(hits, ["query_id", "id"]).join(best, "query_id").withColumn("bm25", F.col("score") / F.col("top"))
    o, b = F.col("overlap"), F.col("bm25")
    lexical = words_.select("query_id", "id", F.least(F.lit(1.0), F.greatest(o, 0.64 * o + 0.36 * b, 0.72 * b)).alias("lexical"))
    out = lexical.join(r.select("id", "session_id", "window_index", *[c for c in ("first", "centroid") if c in r.columns]), "id")
    if "centroid" in r.columns and "embedding" in queries.columns:
        near = search.nearest(r.select("id", F.col("centroid").alias("embedding")), queries.select(F.col("query_id").alias("id"), "embedding"), k=100)
        out = out.join(near.select("query_id", "id", vectors.calibrate(F.col("similarity")).alias("semantic")), ["query_id", "id"], "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
        s, x = F.col("semantic"), F.col("lexical")
        mixed = F.greatest(s * 0.92, x * 0.88, 0.54 * s + 0.46 * x + 0.14 * F.least(s, x))
        out = out.withColumn("score", F.when((s > 0) & (x > 0), mixed).otherwise(F.greatest(s, 0.90 * x)))
    else:
        out = out.withColumn("semantic", F.lit(0.0)).withColumn("score", F.col("lexical"))
    if macro:
        out = out.withColumn("score", F.col("score") + F.when(F.col("window_index") == 0, 0.035).otherwise(0.0))
    return out.withColumn("score", F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.0), "score")), 6))


def select_episodes(scored: DataFrame, *, macro: bool = False) -> DataFrame:
    """The best 8 episodes a question; in macro mode 18: ten by score, then the best of sessions not yet there, then by score."""
    by = W.partitionBy("query_id")
    s = scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "id")))
    if not macro:
        return s.where("rank <= 8")
    anchored = F.max(F.when(F.col("rank") <= 10, 1).otherwise(0)).over(W.partitionBy("query_id", "session_id"))
    first = F.row_number().over(W.partitionBy("query_id", "session_id").orderBy("rank"))
    slot = F.when(F.col("rank") <= 10, 0).when((anchored == 0) & (first == 1) & F.col("session_id").isNotNull(), 1).otherwise(2)
    s = s.withColumn("slot", slot).withColumn("place", F.row_number().over(by.orderBy("slot", "rank")))
    return s.where("place <= 18").drop("slot", "place")


def children(selected: DataFrame, rollups: DataFrame, *, macro: bool = False, most: int | None = None) -> DataFrame:
    """(query_id, id, parent, place): turns of the selected episodes, each with its best episode's score.

    Pinpoint: directives and openers first and all turns of the first three episodes, every second turn of the others.
    Macro: opener, directives, middle, tail and thirds of each.
    """
    r = selected.join(rollups.select("session_id", "window_index", "children", "directives"), ["session_id", "window_index"])
    each = r.select("query_id", "rank", "score", "directives", F.size("children").alias("n"), F.posexplode("children").alias("pos", "id"))
    rule = F.array_contains("directives", F.col("id"))
    if macro:
        n, pos = F.col("n"), F.col("pos")
        anchor = (pos == 0) | (pos == F.floor(n / 2)) | (pos == n - 1) | (pos == F.floor(n / 3)) | (pos == F.floor(2 * n / 3))
        each = each.where(anchor | rule | (n <= 4)).withColumn("kind", F.when(pos == 0, 0).when(rule, 1).otherwise(2))
    else:
        far = F.col("rank") > 3
        kind = F.when(rule, 0).when(F.col("pos") == 0, 1).when(~far, 2).when(F.col("pos") % 2 == 0, 3).otherwise(9)
        each = each.withColumn("kind", kind).where("kind < 9")
    one = each.groupBy("query_id", "id").agg(F.max("score").alias("parent"), F.min(F.struct("rank", "kind", "pos")).alias("slot"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("slot", "id"))
    return one.withColumn("place", place).where(F.col("place") <= (most or (96 if macro else 180))).select("query_id", "id", "parent", "place")


def standing(selected: DataFrame, rollups: DataFrame, *, most: int = 240) -> DataFrame:
    """(query_id, id, place): directives of the selected episodes, best episode first."""
    each = selected.join(rollups.select("session_id", "window_index", "directives"), ["session_id", "window_index"]).select("query_id", "rank", F.explode("directives").alias("id"))
    one = each.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    return one.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "id"))).where(F.col("place") <= most).select("query_id", "id", "place")


def refreshed(stored: DataFrame, rows: DataFrame, *, order: str = "id") -> DataFrame:
    """Sessions (session_id) whose rollups no longer fit their turns: only these need building again."""
    now = build(rows, order=order).groupBy("session_id").agg(F.bit_xor("digest").alias("now"), F.sum("n").alias("n_now"))
    then = stored.groupBy("session_id").agg(F.bit_xor("digest").alias("then"), F.sum("n").alias("n_then"))
    both = now.join(then.withColumnRenamed("session_id", "s"), F.col("session_id").eqNullSafe(F.col("s")), "full_outer")
    return both.where(~F.col("now").eqNullSafe(F.col("then")) | ~F.col("n_now").eqNullSafe(F.col("n_then"))).select(F.coalesce("session_id", "s").alias("session_id"))
