"""Contradictions and state changes between the rows of a pool.

Pools are the bounded candidate lists of queries (their k is a feature of the search), so pairs are formed within a pool
by an equi-join on (pool, stem), never over a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions import vectors, words

# Cue words, units, words beside which a number is a mere label, and lengths.
NEGATIVE = r"(?i)\b(never|must\s+not|do\s+not|don't|forbid|forbidden|prohibit|prohibited|disabled|disable|false|disallow|ban|banned|reject|deprecated)\b"
EXPERIENCE = r"(?i)\b(?:never\s+(?:(?:actually|really|previously|personally|ever|even|yet)\s+)?[a-z]{2,}(?:ed|en|t|d|ne)\b|starting\s+from\s+scratch|(?:have\s+not|haven't)\s+(?:(?:ever|yet|actually|personally)\s+)?[a-z]{2,}(?:ed|en|t|d|ne)\b)"
CLAUSE = EXPERIENCE + r"(?:(?!,\s*(?:but|so|and\s+i|however|although|though)\b)[^.;!?\n]){0,150}"
AFFIRMATIVE = r"(?i)\b(always|must|required|mandatory|enabled|enable|true|allow|allowed|standard|active)\b"
NUMBER = r"(?:([a-z0-9_]+)\s+)?\b(\d+(?:\.\d+)?)(ms|s|m|h|d|gb|mb|kb|tb|%|px|v|usd|eur|hrs|mins|kg|lbs|mph|km)?(?![a-z0-9_])(?:\s+([a-z0-9_]+))?"
LABELS = [
    r"\b(?:v|version|note|log|step|milestone|batch|slot|tier|turn|session|sprint|week|day|phase|part|id)\s*#?\d+(?:/\d+)?\b",
    r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d+(?:,\s*\d{4})?\b",
    r"\b(?:19|20)\d{2}\b",
    r"\b(?:exactly|strictly|only|just|about|around|roughly|approximately|nearly|almost|set\s+to|of)\b",
]
ORDINALS = """turn session sprint week weeks day days phase part item step note log milestone batch slot tier id january february march april
may june july august september october november december line page section user asst assistant date conv window""".split()
LONG = 260
SILENT = sorted({*words.STOP_WORDS, *words.TEMPORAL_CUES, *words.GENERIC_WORDS, *words.META_WORDS, *ORDINALS})


def subjects(text: Column) -> Column:
    """Stems of three letters and more that say what a text is about."""
    known = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*SILENT) & ~w.rlike("^[0-9]+$"))
    return F.array_distinct(F.transform(known, words.stem))


def measures(text: Column) -> Column:
    """Numbers of a text as array<struct<raw, unit, context>>: labels, dates and years aside; the words beside a number are its context."""
    low = F.lower(text)
    for p in LABELS:
        low = F.regexp_replace(low, p, " ")
    part = lambda g: F.regexp_extract_all(F.regexp_replace(low, r"\s+", " "), F.lit(NUMBER), F.lit(g))
    each = F.arrays_zip(part(1).alias("prev"), part(2).alias("n"), part(3).alias("unit"), part(4).alias("next"))
    telling = lambda w: (F.length(w) >= 3) & ~w.isin(*words.STOP_WORDS, *words.GENERIC_WORDS, *ORDINALS)
    sound = F.filter(each, lambda m: (m["unit"] != "") | ~(m["prev"].isin(*ORDINALS) | m["next"].isin(*ORDINALS)))
    return F.transform(sound, lambda m: F.struct(F.concat(m["n"], m["unit"]).alias("raw"), m["unit"].alias("unit"), F.transform(F.filter(F.array(m["prev"], m["next"]), telling), words.stem).alias("context")))


def comparable(a: Column, b: Column, jaccard: Column, *, unit_from: float, alone_from: float, shared_from: float) -> Column:
    """Whether two lists of measures give one thing different values: no equal value, one unit, and enough in common."""
    raws = lambda m: F.transform(m, lambda x: x["raw"])
    alike = lambda x, y: (x["unit"] == y["unit"]) & (((x["unit"] != "") & (jaccard >= unit_from)) | (F.arrays_overlap(x["context"], y["context"]) & (jaccard >= shared_from)) | (jaccard >= alone_from))
    return F.coalesce(~F.arrays_overlap(raws(a), raws(b)) & F.exists(a, lambda x: F.exists(b, lambda y: F.coalesce(alike(x, y), F.lit(False)))), F.lit(False))


def pairs(pool: DataFrame, *, by: str = "query_id", key: str = "id", text: str = "content", shared: int = 2, told: Column | None = None) -> DataFrame:
    """(by, older, newer, subjects, n_shared, jaccard, a, b): pairs of a pool that share at least ``shared`` subjects; a and b are their flags.

    ``told`` gives the text that the subjects come from, if other than the row's own.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    user = words.user_clause(whole)
    long = F.length(whole) > LONG
    said = F.when(long & (user != ""), user).otherwise(whole)
    strong = said.rlike(EXPERIENCE)
    claim = F.array_join(F.regexp_extract_all(said, F.lit(CLAUSE), F.lit(0)), " ")
    about = F.when(long & strong, claim).otherwise(said) if told is None else told
    clause = F.when(user != "", user).otherwise(whole)
    flags = F.struct(
        long.alias("long"), strong.alias("strong"), (~long & whole.rlike(NEGATIVE)).alias("negative"), (~long & whole.rlike(AFFIRMATIVE)).alias("affirmative"),
        texts.transition(clause).alias("changed"), measures(F.when(long, clause).otherwise(whole)).alias("measures"),
    )
    rows = pool.select(F.col(by), F.col(key).alias("id"), subjects(about).alias("s"), flags.alias("f"))
    one = rows.select(by, "id", F.size("s").alias("n"), "f", F.explode("s").alias("stem"))
    a = one.select(by, "stem", F.col("id").alias("older"), F.col("n").alias("na"), F.col("f").alias("a"))
    b = one.select(by, "stem", F.col("id").alias("newer"), F.col("n").alias("nb"), F.col("f").alias("b"))
    both = a.join(b, [by, "stem"]).where("older < newer")
    n = both.groupBy(by, "older", "newer").agg(F.array_sort(F.collect_set("stem")).alias("subjects"), F.count("*").alias("n_shared"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.first("a").alias("a"), F.first("b").alias("b"))
    return n.where(F.col("n_shared") >= shared).withColumn("jaccard", F.col("n_shared") / (F.col("na") + F.col("nb") - F.col("n_shared"))).drop("na", "nb")


def on_topic(pairs_: DataFrame, queries: DataFrame | None, *, by: str = "query_id", long: Column | None = None, update: bool = False) -> DataFrame:
    """Pairs whose shared subjects hold enough of the question's own stems; all pairs where there is no question."""
    if queries is None:
        return pairs_
    terms = words.without(words.domain_terms(F.col("query")), words.GENERIC_WORDS)
    asked = queries.select(F.col("query_id").alias(by), F.array_distinct(F.transform(terms, words.stem)).alias("topic"))
    close = lambda s, t: (s == t) | ((F.length(t) >= 5) & (F.startswith(s, t) | F.startswith(t, s)))
    p = pairs_.join(asked, by, "left").withColumn("hits", F.size(F.filter("topic", lambda t: F.exists("subjects", lambda s: close(s, t)))))
    n, hits, j = F.size("topic"), F.col("hits"), F.col("jaccard")
    if update:
        ok = (hits >= 1) & ~((n >= 3) & (hits < 2) & (j < 0.22))
    else:
        far = F.coalesce(long, F.lit(False))
        ok = (hits >= F.when(far & (n >= 2), 2).otherwise(1)) & ~(far & (n < 2) & ((F.col("n_shared") < 3) | (j < 0.25))) & ~(far & (hits < 3) & (hits / n < 0.5))
    return p.where(F.col("topic").isNull() | (n == 0) | ok).drop("topic", "hits")


def conflicts(pool: DataFrame, queries: DataFrame | None = None, *, by: str = "query_id", chains: DataFrame | None = None, **names) -> DataFrame:
    """(by, older, newer, subjects, n_shared, jaccard, conflict_type): pairs that contradict each other.

    Short rows: opposite polarity, or other values of one thing on much the same subjects.  Long dialogue: one denies an
    experience and the other doesn't; each denial keeps its best partner, three a pool.  Rows of one chain (id, chain) don't
    contradict each other.
    """
    a, b = F.col("a"), F.col("b")
    long = a["long"] | b["long"]
    p = on_topic(pairs(pool, by=by, **names).withColumn("long", long), queries, by=by, long=F.col("long"))
    if chains is not None:
        one, other = chains.select(F.col("id").alias("older"), F.col("chain").alias("__a")), chains.select(F.col("id").alias("newer"), F.col("chain").alias("__b"))
        p = p.join(one, "older", "left").join(other, "newer", "left").where(~F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))).drop("__a", "__b")
    no_a, no_b = (F.when(F.col("long"), x["strong"]).otherwise(x["negative"] | x["strong"]) for x in (a, b))
    short = (no_a & ~no_b & b["affirmative"]) | (no_b & ~no_a & a["affirmative"]) | ((no_a != no_b) & (F.col("n_shared") >= 3))
    value = ~F.col("long") & comparable(a["measures"], b["measures"], F.col("jaccard"), unit_from=0.0, alone_from=0.45, shared_from=0.0) & ((F.col("jaccard") >= 0.35) | (F.col("n_shared") >= 3))
    polarity = F.when(F.col("long"), no_a != no_b).otherwise(short)
    p = p.withColumn("conflict_type", F.when(polarity, "polarity_contradiction").when(value, "value_contradiction")).where("conflict_type is not null")
    p = p.withColumn("__no", F.when(no_a, F.col("older")).otherwise(F.col("newer"))).withColumn("__s", F.round(F.col("jaccard") * 2 + F.col("n_shared") * 0.15, 9)).drop("a", "b")
    best = F.row_number().over(W.partitionBy(by, "__no", "long").orderBy(F.desc("__s"), "older", "newer"))
    p = p.withColumn("__r", best).where(~F.col("long") | (F.col("__r") == 1))
    top = F.row_number().over(W.partitionBy(by, "long").orderBy(F.desc("__s"), "older", "newer"))
    return p.withColumn("__t", top).where(~F.col("long") | (F.col("__t") <= 3)).drop("long", "__no", "__s", "__r", "__t")


def updates(pool: DataFrame, queries: DataFrame | None = None, *, by: str = "query_id", text: str = "content", **names) -> DataFrame:
    """(by, newer, older, strength): for each row that tells a change, or another value of one thing, its strongest older partner; the three newest of each pool."""
    whole = F.coalesce(F.col(text), F.lit(""))
    user = words.user_clause(whole)
    told = F.regexp_replace(F.when(user != "", user).otherwise(whole), r"(?i)\[[^\]]*\b(?:session|turn)\b[^\]]*\]\s*", "")
    p = on_topic(pairs(pool, by=by, text=text, told=told, **names), queries, by=by, update=True)
    shift = comparable(F.col("a.measures"), F.col("b.measures"), F.col("jaccard"), unit_from=0.28, alone_from=2.0, shared_from=0.0)
    p = p.withColumn("shift", shift).where(F.col("b.changed") | F.col("shift"))
    strength = F.round(F.when(F.col("b.changed"), 0.5).otherwise(0.0) + F.when(F.col("shift"), 0.45).otherwise(0.0) + 1.6 * F.col("jaccard") + 0.12 * F.col("n_shared"), 6)
    best = p.withColumn("strength", strength).groupBy(by, "newer").agg(F.max(F.struct("strength", "older")).alias("m"))
    out = best.select(by, "newer", F.col("m.older").alias("older"), F.col("m.strength").alias("strength"))
    return out.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("newer")))).where("r <= 3").drop("r")


def consolidated(close: DataFrame) -> DataFrame:
    """(id, superseded_by) from pairs (older, newer) of close rows: the newest of the older partners wins."""
    return close.groupBy(F.col("newer").alias("id")).agg(F.max("older").alias("superseded_by"))
