"""Scores of a question's candidates: overlap of words, boosts, and the calibrated fusion of four arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors, words
from . import scoring
from .ranking import RRF_K, z_unit

#: The score under which no row is lifted, and the weights of the fusion with and without vectors.
FLOOR = 0.46
WITH_VECTORS = {"rrf": 0.26, "z_semantic": 0.22, "z_idf": 0.16, "span": 0.20, "concordance": 0.12, "prior": 0.04}
WORDS_ONLY = {"rrf": 0.32, "z_semantic": 0.0, "z_idf": 0.26, "span": 0.32, "concordance": 0.0, "prior": 0.10}


def word_overlap(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """``candidates`` (query_id, id, content, tags) with stems, n_terms, hits, direct, total, idf, user, distinctive and distinctive_hits.

    A term is hit by its stem or as a substring; a stem's weight is ln(1 + N / (1 + df)) over the question's candidates.
    """
    q = F.lower("query")
    stemmed = lambda a: F.transform(a, lambda t: F.struct(t.alias("t"), words.stem(t).alias("s")))
    # Stems are worked out once a question; a row only looks them up.
    asked = queries.select("query_id", q.alias("q"), stemmed(words.domain_terms(q)).alias("terms"), stemmed(words.distinctive_terms(q)).alias("special"))
    asked = asked.withColumn("wanted", F.array_distinct(F.transform("terms", lambda p: p["s"]))).withColumn("n_distinctive", F.size(F.array_distinct(F.transform("special", lambda p: p["s"]))))
    body, tags = F.lower(F.coalesce("content", F.lit(""))), F.lower(F.coalesce(F.array_join("tags", " "), F.lit("")))
    texts = candidates.select("id", "content", "tags").dropDuplicates(["id"]).withColumn("low", body).withColumn("all", F.concat(body, F.lit(" "), tags))
    texts = texts.withColumn("stems", words.stems(F.col("all"))).withColumn("user_stems", words.stems(words.user_clause(F.coalesce("content", F.lit("")))))
    rows = candidates.join(texts.drop("content", "tags"), "id").join(asked, "query_id")
    hit = lambda p, where: F.array_contains(F.col("stems"), p["s"]) | F.contains(where, p["t"])
    rows = rows.withColumn("held", F.filter("wanted", lambda s: F.array_contains(F.col("stems"), s) | F.contains(F.col("all"), s)))
    n = F.greatest(F.size("terms"), F.lit(1))
    rows = rows.withColumns({
        "n_terms": F.size("terms"),
        "hits": F.size(F.filter("terms", lambda p: hit(p, F.col("all")))),
        "direct": F.size(F.filter("terms", lambda p: hit(p, F.col("low")))) / n,
        "distinctive_hits": F.size(F.array_distinct(F.transform(F.filter("special", lambda p: hit(p, F.col("all"))), lambda p: p["s"]))),
        "exact": F.contains("low", "q"),
    }).withColumn("total", F.col("hits") / n)
    size = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted"))
    df = rows.select("query_id", F.explode("held").alias("stem")).groupBy("query_id", "stem").agg(F.count("*").alias("df"))
    each = size.select("query_id", "n", F.explode("wanted").alias("stem")).join(df, ["query_id", "stem"], "left")
    weights = each.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("stem", F.log1p(F.col("n") / (1 + F.coalesce("df", F.lit(0))))))).alias("weights"))
    weigh = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(F.col("weights")[x], F.lit(0.0)))
    rows = rows.join(weights, "query_id", "left").withColumn("of", weigh(F.col("wanted")))
    share = lambda a: F.when(F.col("of") > 0, weigh(a) / F.col("of")).otherwise(0.0)
    rows = rows.withColumn("full", share(F.col("held"))).withColumn("user", share(F.array_intersect("wanted", "user_stems")))
    dialogue = F.size("user_stems") > 0
    large = F.count("*").over(W.partitionBy("query_id")) >= 20
    rows = rows.withColumn("dialogue", dialogue).withColumn("idf", F.when(dialogue & large, 0.68 * F.col("user") + 0.32 * F.col("full")).otherwise(F.col("full")))
    return rows.drop("low", "all", "held", "weights", "of", "full", "q", "terms", "special")


def semantic(candidates: DataFrame, queries: DataFrame, *, steps: DataFrame | None = None) -> DataFrame:
    """``candidates`` with raw and semantic: the best cosine of the row and of its chain's rows (id, step_id, embedding)."""
    q = queries.select("query_id", F.col("embedding").alias("__q"))
    rows = candidates.join(q, "query_id", "left")
    raw = lambda v: F.when(vectors.valid(v) & vectors.valid(F.col("__q")), vectors.cosine(v, F.col("__q"))).otherwise(0.0)
    out = rows.withColumn("raw", F.coalesce(raw(F.col("embedding")), F.lit(0.0)))
    if steps is not None:
        chain = rows.select("query_id", "id", "__q").join(steps.select("id", "step_id", F.col("embedding").alias("__v")), "id")
        best = chain.groupBy("query_id", "id").agg(F.max(raw(F.col("__v"))).alias("__best"))
        out = out.join(best, ["query_id", "id"], "left").withColumn("raw", F.greatest("raw", F.coalesce("__best", F.lit(0.0)))).drop("__best")
    out = out.withColumn("raw", F.greatest("raw", F.lit(0.0)))
    return out.withColumn("semantic", F.when(vectors.sparse(F.col("__q")), F.col("raw")).otherwise(vectors.calibrate(F.col("raw")))).drop("__q")


def damped(candidates: DataFrame) -> DataFrame:
    """``candidates`` with neighbour (a near vector that shares hardly a telling word) and meaning, its semantic score held down."""
    few = ((F.col("n_distinctive") >= 3) & (F.col("distinctive_hits") <= 1)) | ((F.col("n_distinctive") == 2) & (F.col("distinctive_hits") == 0) & (F.col("raw") < 0.44))
    lone = F.col("dialogue") & (F.col("raw") > 0) & (F.col("raw") < 0.48) & few
    share = F.col("distinctive_hits") / F.greatest(F.col("n_distinctive"), F.lit(1))
    return candidates.withColumn("neighbour", lone).withColumn("meaning", F.when(lone, F.col("semantic") * (0.64 + 0.16 * share)).otherwise(F.col("semantic")))


def base_score(candidates: DataFrame) -> DataFrame:
    """``candidates`` with score and unclamped from the columns of the functions above."""
    c = F.col
    s = scoring.base(c("meaning"), c("direct"), c("total"), c("idf"), exact=c("exact"), n_terms=c("n_terms"), n_hits=c("hits"), n_distinctive=c("n_distinctive"), n_distinctive_hits=c("distinctive_hits"))
    s = F.when(c("dialogue"), F.greatest(s, c("meaning"))).otherwise(s)
    return candidates.withColumn("score", s).withColumn("unclamped", s)


def boosted(candidates: DataFrame, queries: DataFrame, *, now: Column | None = None) -> DataFrame:
    """``candidates`` after the boosts: shared phrases, state changes, standing directives, openers, chains, age.

    Columns that a boost needs and the table lacks (position, n_versions, parent, created_at) leave it out.
    """
    flags = text.intents(F.col("query"))
    q = queries.select("query_id", text.phrases(F.col("query")).alias("__phrases"), *[flags[k].alias(f"__{k}") for k in flags])
    rows, has = candidates.join(q, "query_id"), candidates.columns
    low, user = F.lower(F.coalesce("content", F.lit(""))), words.user_clause(F.coalesce("content", F.lit("")))
    mine = F.when(user != "", user).otherwise(F.coalesce("content", F.lit("")))
    rows = rows.withColumn("directive", (F.col("category") == "invariant") | (F.col("dialogue") & text.directive(mine))).withColumn("transition", text.transition(mine))
    broad = F.lit(False)
    c, up, seq, temporal, advisory = F.col, F.col("__update"), F.col("__sequence"), F.col("__temporal"), F.col("__advisory")
    steps: list[tuple[Column, Column, float]] = []  # condition, what is added, ceiling
    if "parent" in has:
        ok = (c("parent") >= 0.48) & (c("score") > 0.36) & ~c("neighbour") & (seq | (c("idf") >= 0.15) | (c("semantic") >= 0.56))
        steps.append((ok, F.when(seq, F.least(F.lit(0.05), 0.05 * c("parent"))).otherwise(F.least(F.lit(0.02), 0.024 * c("parent"))), 0.99))
    said = F.size(F.filter("__phrases", lambda p: F.contains(low, p)))
    steps.append(((c("score") > 0.42) & (said > 0), F.least(F.lit(0.12), said * 0.05), 0.99))
    close = (c("idf") >= 0.16) | (c("user") >= 0.16) | (c("semantic") >= 0.56)
    steps.append((~seq & up & (c("score") > 0.46) & c("transition") & close, F.lit(0.07), 0.99))
    along = F.percent_rank().over(W.partitionBy("query_id").orderBy("id"))
    rows = rows.withColumn("__along", along)
    steps.append((~seq & up & (c("score") > 0.46) & ((c("idf") >= 0.20) | (c("semantic") >= 0.58)), 0.035 * c("__along"), 0.99))
    steps.append((~seq & ~up & (c("score") > 0.46) & c("transition") & ((c("user") >= 0.24) | ((c("idf") >= 0.24) & (c("semantic") >= 0.58))), F.lit(0.04), 0.99))
    rows = rows.withColumn("__n", F.count("*").over(W.partitionBy("query_id")))
    strong = F.when((c("__n") < 30) | (c("idf") >= 0.25) | (c("semantic") >= 0.66), 0.14).otherwise(0.06)
    steps.append(((c("raw") > 0) & ~broad & (~temporal | advisory) & c("directive") & (c("score") > 0.42), strong, 0.98))
    if "position" in has:
        steps.append((c("dialogue") & (c("position") <= 2) & (c("score") > 0.30) & ~c("neighbour"), F.lit(0.06), 0.99))
    if "n_versions" in has:
        steps.append((temporal & (c("n_versions") > 1) & (c("score") > 0.45), F.lit(0.06), 0.99))
    if "created_at" in has and now is not None:
        steps.append(((c("score") > 0.4) & c("created_at").isNotNull() & ~c("neighbour"), scoring.recency(F.least("created_at", now), now), 0.995))
    for ok, add, most in steps:
        rows = rows.withColumn("__add", F.when(ok, add).otherwise(0.0))
        rows = rows.withColumn("unclamped", c("unclamped") + c("__add")).withColumn("score", F.when(c("__add") > 0, F.greatest("score", F.least(F.lit(most), c("score") + c("__add")))).otherwise(c("score")))
    return rows.drop("__add", "__along", "__n", "__phrases", *[f"__{k}" for k in flags])


def calibrated(candidates: DataFrame, *, with_vectors: bool = True, update: bool = False, broad: bool = False) -> DataFrame:
    """``candidates`` with fused, and score and unclamped moved by it.

    Columns: query_id, id, score, unclamped, raw, semantic, user, idf, span, prior, neighbour, transition.  Four arms rank the
    positive values (equal ones by id); units are z-scores against the question's candidates.  Rows under the floor, and
    mere neighbours, keep their scores.
    """
    by, c = W.partitionBy("query_id"), F.col
    arms = {"raw": F.col("raw") if with_vectors else F.lit(0.0), "user": c("user"), "idf": c("idf"), "span": c("span")}
    rows = candidates
    total, active = F.lit(0.0), F.lit(0)
    for name, value in arms.items():
        v = F.when(value > 1e-6, F.round(value, 9))
        rows = rows.withColumn(f"__{name}", F.when(v.isNotNull(), F.row_number().over(by.orderBy(F.desc_nulls_last(v), "id"))))
        total += F.coalesce(1 / (RRF_K + c(f"__{name}")), F.lit(0.0))
        active += F.max(c(f"__{name}").isNotNull().cast("int")).over(by)
    weights = WITH_VECTORS if with_vectors else WORDS_ONLY
    lexical = F.greatest("idf", "span", "user")
    parts = {
        "rrf": F.when(active > 0, F.least(F.lit(1.0), total / (active / (RRF_K + 1)))).otherwise(0.0),
        "z_semantic": z_unit(c("raw"), by),
        "z_idf": z_unit(c("idf"), by),
        "span": 0.68 * c("span") + 0.32 * z_unit(c("span"), by),
        "concordance": F.sqrt(F.greatest(c("semantic"), F.lit(0.0)) * F.greatest(lexical, F.lit(0.0))),
        "prior": F.least(F.lit(1.0), c("prior")),
    }
    rows = rows.withColumn("fused", sum((parts[k] * w for k, w in weights.items() if w), F.lit(0.0)))
    free = (c("score") < FLOOR) | c("neighbour")
    top = F.coalesce(F.max(F.when(~free, c("fused"))).over(by), F.lit(0.0))
    gap = F.greatest(F.lit(0.0), top - c("fused"))
    delta = F.least(F.lit(0.082), F.greatest(F.lit(-0.022), (c("fused") - (0.44 if broad else 0.46)) * 0.16))
    relief = F.when(c("score") >= 0.85, F.least(F.lit(0.045), gap * 0.11)).otherwise(0.0)
    ceiling = F.when(F.lit(update) & c("transition"), 1.0).otherwise(0.995)
    moved = F.greatest(F.lit(FLOOR), F.least(ceiling, c("score") + delta) - relief)
    one = F.count("*").over(by) < 2
    rows = rows.withColumn("__moved", F.when(free | one, c("score")).otherwise(moved))
    rows = rows.withColumn("unclamped", F.when(free | one, c("unclamped")).otherwise(c("unclamped") + delta + 0.22 * c("fused") - 0.14 * gap))
    return rows.withColumn("score", c("__moved")).drop("__moved", *[f"__{a}" for a in arms])


def prior(candidates: DataFrame, *, update: bool = False) -> Column:
    """What a row's kind says for it: standing rules, state changes, chains."""
    versions = F.col("n_versions") if "n_versions" in candidates.columns else F.lit(1)
    return F.least(F.lit(1.0), F.when(F.col("directive"), 0.35).otherwise(0.0) + F.when(F.lit(update) & F.col("transition"), 0.40).otherwise(0.0) + F.when(versions > 1, 0.25).otherwise(0.0))
