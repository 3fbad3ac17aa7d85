"""The answer to a question as one text within a budget of tokens: entries packed in order, and what goes first when it is too long.

A question's entries are at most its budget long, so they are one array a question; how many stay follows from their running
lengths, not from trying one text after another.

Defined cases: a null section is an empty one; a question without entries has a text of its sections alone; budgets lie
between 100 and 32,000 tokens, and a null budget is 4,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.condense import condensed

# Signs of a token, bounds of a budget, lengths of bodies by place, and what is reserved for heads.
SIGNS, LEAST, MOST, USUAL = 4, 100, 32_000, 4000
TIERS, LOWEST, WHOLE = ((8, 680), (20, 440)), 320, 4000
MANY, LARGE = 30, 4000
SECTIONS = ("state", "timeline", "status_text", "badge")


def tokens_of(length: Column) -> Column:
    return F.ceil(length / SIGNS).cast("long")


def budget_of(limit: Column) -> Column:
    return F.least(F.greatest(F.coalesce(limit, F.lit(USUAL)), F.lit(LEAST)), F.lit(MOST)).cast("long")


def room(limit: Column, state: Column, n_rows: Column, *, temporal: Column, panorama: Column) -> Column:
    """Tokens left for entries, after the state and what is kept for head and timeline."""
    left = F.greatest(F.lit(40), limit - state)
    share = lambda x: F.floor(left * x)
    least = F.least(F.greatest(F.lit(42), share(0.36)), F.lit(180))
    large = F.least(share(0.50), F.when(temporal, 980).when(panorama, 400).otherwise(280))
    middle = F.greatest(least, F.when(temporal, F.least(F.lit(450), share(0.30))).when(panorama, F.least(F.lit(220), share(0.22))).otherwise(F.least(F.lit(140), share(0.16))))
    reserve = F.when((limit >= 2000) & (n_rows >= 30), large).when((limit >= 400) & (limit < 2000), middle).otherwise(least)
    return F.greatest(F.lit(24), left - reserve).cast("long")


def entries(items: DataFrame, *, by: str = "query_id", order: str = "rank") -> DataFrame:
    """``items`` (by, order, kind, title, content, score, room) with ``entry`` and ``used``: those that fit in ``room`` tokens, in order.

    Bodies are shortened by their place where there is much to pack; the first that doesn't fit ends the packing, but the very
    first is cut to the room instead.
    """
    place, n = F.row_number().over(W.partitionBy(by).orderBy(order)), F.count("*").over(W.partitionBy(by))
    most = F.when(~((n >= MANY) & (F.col("room") >= LARGE)), WHOLE).when(place <= TIERS[0][0], TIERS[0][1]).when(place <= TIERS[1][0], TIERS[1][1]).otherwise(LOWEST)
    head = F.format_string("### [%s] %s (Score: %.1f%%)\n", F.upper("kind"), "title", F.col("score") * 100)
    t = items.withColumn("__place", place).withColumn("__head", head).withColumn("__body", F.trim(condensed(F.col("content"), most)))
    t = t.withColumn("entry", F.concat("__head", "__body", F.lit("\n\n---\n")))
    left = F.greatest(F.lit(12), F.col("room") * SIGNS - 2) - F.length("__head") - 6
    cut = F.when(left >= 8, F.concat("__head", F.rtrim(F.substr("__body", F.lit(1), left.cast("int"))), F.lit("\n\n---\n"))).otherwise(F.col("entry"))
    short = F.when(tokens_of(F.length(cut)) > F.col("room"), F.rtrim(F.substr(cut, F.lit(1), (F.col("room") * SIGNS - 2).cast("int")))).otherwise(cut)
    t = t.withColumn("entry", F.when((F.col("__place") == 1) & (tokens_of(F.length("entry")) > F.col("room")), short).otherwise(F.col("entry")))
    used = F.sum(tokens_of(F.length("entry"))).over(W.partitionBy(by).orderBy(order))
    return t.withColumn("used", used).where((F.col("used") <= F.col("room")) | (F.col("__place") == 1)).drop("__place", "__head", "__body")


def assembled(packed: DataFrame, heads: DataFrame, *, by: str = "query_id", order: str = "rank") -> DataFrame:
    """(by, text, tokens, n_packed, shed): one text a question that is never longer than its budget.

    heads: by, query, budget, epistemic_status, n_candidates, state, timeline, status_text, badge.  What goes, until it fits: the
    timeline; entries from the last, but one; the badge; the status section, shortened or all; the last entry, shortened or all;
    the state, shortened or all; and in the end the text is cut.  ``shed`` lists what went or was cut.
    """
    listed = packed.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "entry"))), lambda x: x["entry"]).alias("entries"))
    q = heads.join(listed, by, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in SECTIONS} | {"entries": F.coalesce("entries", F.array().cast("array<string>")), "budget": budget_of(F.col("budget")), "shed": F.array().cast("array<string>")})
    lengths = F.transform("entries", lambda e: F.length(e))
    sums = F.transform(F.sequence(F.lit(0), F.size("entries")), lambda m: F.aggregate(F.slice(lengths, F.lit(1), m), F.lit(0), lambda a, x: a + x))
    q = q.withColumn("sums", sums).withColumn("kept", F.size("entries"))

    def top(m: Column) -> Column:
        counts = F.concat(F.lit("**Status**: "), "epistemic_status", F.lit(" | **Items**: "), m.cast("string"), F.lit(" / "), F.col("n_candidates").cast("string"))
        return F.concat(F.lit('# Context for "'), "query", F.lit('"\n'), counts, F.when(F.col("badge") != "", F.concat(F.lit(" | "), "badge")).otherwise(""), F.lit("\n\n"))

    def length(m: Column) -> Column:
        return F.length("state") + F.length(top(m)) + F.length("status_text") + F.length("timeline") + F.get("sums", m)

    def over() -> Column:
        return tokens_of(length(F.col("kept"))) - F.col("budget")

    def step(q: DataFrame, name: str, when: Column, **to: Column) -> DataFrame:
        """Replace columns where the text is too long; what changes is noted."""
        q = q.withColumn("__now", (over() > 0) & when)
        return q.withColumns({c: F.when(F.col("__now"), x).otherwise(F.col(c)) for c, x in to.items()} | {"shed": F.when(F.col("__now"), F.array_append("shed", F.lit(name))).otherwise(F.col("shed"))})

    def shortened(c: Column, spare: int, least: int, end: str) -> Column:
        left = tokens_of(F.length(c)) - over() - spare
        return F.when(left >= least, F.concat(F.rtrim(clamped(c, left), F.lit(" \n\t\r")), F.lit(end))).otherwise("")

    fits = F.filter(F.sequence(F.lit(1), F.greatest(F.size("entries"), F.lit(1))), lambda m: tokens_of(length(m)) <= F.col("budget"))
    some = lambda c: F.col(c) != ""
    q = step(q, "timeline", some("timeline"), timeline=F.lit(""))
    q = step(q, "entries", F.col("kept") > 1, kept=F.coalesce(F.array_max(fits), F.lit(1)))
    q = step(q, "badge", some("badge"), badge=F.lit(""))
    q = step(q, "status", some("status_text"), status_text=shortened(F.col("status_text"), 4, 12, "\n\n"))
    one = F.get("entries", F.lit(0))
    q = step(q, "last entry", F.col("kept") == 1, entries=F.array(shortened(one, 3, 10, "\n")))
    q = q.withColumn("entries", F.filter("entries", lambda e: e != "")).withColumn("kept", F.least("kept", F.size("entries"))).withColumn("sums", sums)
    q = step(q, "state", some("state"), state=shortened(F.col("state"), 3, 12, "\n\n"))
    whole = F.concat("state", top(F.col("kept")), "status_text", "timeline", F.array_join(F.slice("entries", F.lit(1), F.col("kept")), ""))
    q = q.withColumn("text", whole).withColumn("shed", F.when(over() > 0, F.array_append("shed", F.lit("end"))).otherwise(F.col("shed")))
    q = q.withColumn("text", clamped(F.col("text"), F.col("budget")))
    return q.select(by, "text", tokens_of(F.length("text")).alias("tokens"), F.col("kept").cast("long").alias("n_packed"), "shed")


def clamped(t: Column, tokens: Column) -> Column:
    """At most ``tokens`` tokens of a text: two signs fewer than they hold, without blanks at the end."""
    return F.when(tokens_of(F.length(t)) <= tokens, t).otherwise(F.rtrim(F.substr(t, F.lit(1), F.greatest(F.lit(1), tokens * SIGNS - 2).cast("int")), F.lit(" \n\t\r")))
