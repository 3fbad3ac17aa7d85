"""Whether a store attests what a question asks about: terms found together in neighbouring turns, anchors, and ceilings.

Terms of the questions meet rows by an equi-join on stems; only (question, row, term) hits go on.  A row's window is the row with
its neighbours in the session, found by joins on places, so a session of any length is dealt out.  All that follows is a
small table a question, one line a term.

Defined cases: questions with fewer than two telling terms or stems, and stores without rows, are GROUNDED; a null text has no
words; rows without a session have no neighbours; ids name rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words
from ..sources import staging
from . import ordered

# Ceilings and their growth with the number of rows, coverages, and lengths of terms.
UNSUPPORTED, UNATTESTED = (0.42, 0.032), (0.50, 0.045)
FEW_ROWS, SCALE, MOST_SCALE = 50, 25, 3.5
NO_ANCHOR, TWO_UNKNOWN, LINKED = 0.25, 0.34, 0.65
COMMON, COMMON_SHARE = 3, 0.40
NEAR_IDS = 8
COMPOUND = "[._-]"


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, p, term, stem) of ``terms`` (an array): lower-cased, three signs at least, no plain numbers, each once."""
    clean = F.array_distinct(F.filter(F.transform("terms", lambda t: F.lower(F.trim(t))), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$")))
    return queries.select("query_id", F.posexplode(clean).alias("p", "term")).withColumn("stem", words.stem(F.col("term")))


def told(rows: DataFrame, *, text: str = "content", tags: str | None = "tags", lineage: str | None = None) -> Column:
    """What a row's user says, with its tags and its lineage's texts, lower-cased."""
    whole = F.coalesce(F.col(text), F.lit(""))
    user = words.user_clause(whole)
    parts = [F.when(user != "", user).otherwise(whole)]
    for c in (tags, lineage):
        if c and c in rows.columns:
            parts.append(F.coalesce(F.array_join(c, " ") if rows.schema[c].dataType.typeName() == "array" else F.col(c).cast("string"), F.lit("")))
    return F.lower(F.concat_ws(" ", *parts))


def hits_of(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, id, stem): rows (id, told) that hold a stem, or a compound term as it is."""
    stems = terms.select("query_id", "stem").distinct()
    found = rows.select("id", F.explode(F.array_distinct(F.transform(words.tokens(F.col("told")), words.stem))).alias("stem")).join(stems, "stem").select("query_id", "id", "stem")
    compound = terms.where(F.col("term").rlike(COMPOUND))
    if compound.isEmpty():
        return found
    three = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("told") - 2), lambda i: F.substr("told", i, F.lit(3))))
    pieces = rows.where(F.length("told") >= 3).select("id", "told", F.explode(three).alias("three"))
    held = pieces.join(compound.withColumn("three", F.substring("term", 1, 3)), "three").where(F.contains("told", F.col("term")))
    return found.unionByName(held.select("query_id", "id", "stem")).distinct()


def neighbours(rows: DataFrame) -> DataFrame:
    """(id, centre): each row, and for rows that follow one another in a session each for the other.

    With turn spans on both sides, spans that touch; else ids at most NEAR_IDS apart between which all ids are known rows of
    other sessions.
    """
    s = rows.where("session_id IS NOT NULL").select("id", "session_id", "first", "last", F.coalesce("first", "id").alias("o"))
    every = ordered.running(rows.select("id", F.lit(0).alias("all")), ["all"], ["id"]).select("id", F.col("place").alias("among"))
    inside = ordered.running(s.select("id", "session_id"), ["session_id"], ["id"]).select("id", F.col("place").alias("within"))
    placed = staging.staged(ordered.running(s, ["session_id"], ["o", "id"]).join(every, "id").join(inside, "id"))
    b = placed.select(F.col("session_id").alias("s"), (F.col("place") - 1).alias("p"), *[F.col(c).alias(f"b_{c}") for c in ("id", "first", "last", "among", "within")])
    both = placed.join(b, (F.col("session_id") == F.col("s")) & (F.col("place") == F.col("p")))
    spans = F.greatest("first", "b_first") - F.least("last", "b_last") <= 1
    apart = F.abs(F.col("b_id") - F.col("id"))
    ids = (apart <= NEAR_IDS) & (F.abs(F.col("b_among") - F.col("among")) == apart) & (F.abs(F.col("b_within") - F.col("within")) == 1)
    near = both.where(F.when(F.col("first").isNotNull() & F.col("b_first").isNotNull(), spans).otherwise(ids)).select("id", F.col("b_id").alias("centre"))
    return rows.select("id", F.col("id").alias("centre")).unionByName(near).unionByName(near.select(F.col("centre").alias("id"), F.col("id").alias("centre")))


def grounded(rows: DataFrame, queries: DataFrame, packed: DataFrame, **texts) -> DataFrame:
    """(query_id, status, anchors, unattested, unlinked, joint) of questions (query_id, terms[, raw]) against a store.

    rows: id, content, session_id, first, last (turn span, may be null)[, tags]; packed: query_id, id, rank, what the answer holds.
    ``raw`` is the best raw cosine of the question (1 where none is given).
    """
    terms = staging.staged(asked_terms(queries))
    store = staging.staged(rows.select("id", "session_id", "first", "last", told(rows, **texts).alias("told")))
    hits = staging.staged(hits_of(store, terms))
    n = store.agg(F.count("*").alias("rows"))  # one row
    window = staging.staged(hits.join(neighbours(store), "id").select("query_id", "centre", "stem").distinct())
    joint = window.groupBy("query_id", "centre").agg(F.count("*").alias("k")).groupBy("query_id").agg(F.max("k").alias("k"))
    # Which stems share a window: a stem's partners are at most the question's stems.
    linked = window.join(window.withColumnRenamed("stem", "other"), ["query_id", "centre"]).select("query_id", "stem", "other").distinct().groupBy("query_id", "stem").agg(F.collect_set("other").alias("linked"))
    df = hits.groupBy("query_id", "stem").agg(F.count("*").alias("df"))
    order = packed.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    first = order.join(hits, ["query_id", "id"]).groupBy("query_id", "stem").agg(F.min("rank").alias("rank"))
    least = order.groupBy("query_id").agg(F.min("rank").alias("top"))
    each = terms.join(df, ["query_id", "stem"], "left").join(first, ["query_id", "stem"], "left").join(linked, ["query_id", "stem"], "left")
    line = F.struct("p", "term", "stem", F.coalesce("df", F.lit(0)).alias("df"), "rank", F.coalesce("linked", F.array().cast("array<string>")).alias("linked"))
    listed = each.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("t"), F.count_distinct("stem").alias("stems"))
    raw = (F.col("raw") if "raw" in queries.columns else F.lit(1.0)).cast("double")
    # One row joined to all: the number of rows of the store.
    q = queries.select("query_id", F.coalesce(raw, F.lit(1.0)).alias("raw")).join(listed, "query_id", "left").join(joint, "query_id", "left").join(least, "query_id", "left").crossJoin(F.broadcast(n))
    q = q.withColumn("stems", F.coalesce("stems", F.lit(0))).withColumn("joint", F.coalesce(F.col("k") / F.col("stems"), F.lit(0.0)))
    return _judged(q)


def _judged(q: DataFrame) -> DataFrame:
    """Anchors, links and status from (raw, t, stems, joint, rows, top); arrays hold a question's terms."""
    none = F.array().cast("array<string>")
    names = lambda a: F.coalesce(F.transform(a, lambda x: x["term"]), none)
    distinct = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["stem"])))
    anchor = lambda x: (x["df"] >= 1) & x["rank"].isNotNull()
    keyed = F.transform(F.filter("t", anchor), lambda x: F.struct(x["df"].alias("df"), x["rank"].alias("rank"), (-F.length(x["term"])).alias("len"), x["p"].alias("p"), x["term"].alias("term"), x["stem"].alias("stem"), x["linked"].alias("linked")))
    q = q.withColumn("anchors", F.array_sort(keyed)).withColumn("ceiling", F.greatest(F.lit(float(COMMON)), F.col("rows") * COMMON_SHARE))
    q = q.withColumn("rare", F.filter("anchors", lambda x: x["df"] <= F.col("ceiling")))
    q = q.withColumn("pool", F.when(F.size("rare") > 0, F.col("rare")).otherwise(F.col("anchors"))).withColumn("one", F.get("pool", F.lit(0)))
    # The rarest anchor, or one of the first packed row where the two never stand together.
    top = F.get(F.filter("pool", lambda x: x["rank"] == F.col("top")), F.lit(0))
    apart = (F.col("one.rank") > F.col("top")) & top.isNotNull() & (top["stem"] != F.col("one.stem")) & ~F.array_contains("one.linked", top["stem"])
    q = q.withColumn("one", F.when(F.coalesce(apart, F.lit(False)), top).otherwise(F.col("one")))
    second = F.get(F.filter("pool", lambda x: (x["stem"] != F.col("one.stem")) & F.array_contains("one.linked", x["stem"])), F.lit(0))
    q = q.withColumn("two", F.when((F.col("stems") >= 3) & (F.size("pool") >= 2), second))
    primary = F.array_compact(F.array("one.stem", "two.stem"))
    loose = lambda x: (F.length(x["term"]) >= 4) & (x["df"] >= 1) & ~F.array_contains(primary, x["stem"]) & ~F.arrays_overlap(x["linked"], primary)
    q = q.withColumn("unlinked", F.when(F.size("anchors") > 0, F.filter("t", loose)).otherwise(F.filter("t", lambda x: F.lit(False))))
    q = q.withColumn("unknown", F.filter("t", lambda x: (F.length(x["term"]) >= 4) & (x["df"] == 0)))
    scale = F.when(F.col("rows") >= FEW_ROWS, F.least(F.lit(MOST_SCALE), F.log10(F.col("rows") / SCALE))).otherwise(0.0)
    low, high = (base + growth * scale for base, growth in (UNSUPPORTED, UNATTESTED))
    no_anchor = (distinct(F.col("anchors")) == 0) & (F.col("joint") <= NO_ANCHOR)
    unknown = (distinct(F.col("unknown")) >= 2) & (F.col("joint") <= TWO_UNKNOWN)
    missing = (distinct(F.col("unknown")) >= 1) | (distinct(F.col("unlinked")) >= 1)
    status = F.when((F.col("stems") >= 3) & (F.col("raw") < low) & (no_anchor | unknown), "UNSUPPORTED").when((distinct(F.col("anchors")) >= 1) & (F.col("raw") < high) & (F.col("joint") < LINKED) & missing, "UNATTESTED_ATTRIBUTE").otherwise("GROUNDED")
    skip = F.col("t").isNull() | (F.size("t") < 2) | (F.col("stems") < 2) | (F.col("rows") == 0)
    unless = lambda c, other: F.when(skip, other).otherwise(c)
    return q.select(
        "query_id", unless(status, "GROUNDED").alias("status"), unless(names(F.col("anchors")), none).alias("anchors"), unless(names(F.col("unknown")), none).alias("unattested"),
        unless(names(F.col("unlinked")), none).alias("unlinked"), unless(F.round("joint", 4), F.lit(1.0)).alias("joint"),
    )
