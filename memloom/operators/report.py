"""Reports: the compiled state of a project, Markdown of packed rows, and figures of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import words
from . import ordered

# Sections, their rows and characters in the three passes.
SECTIONS = {"decision": "Decisions & Priorities", "invariant": "Project Invariants", "blocker": "Known Bugs & Blockers", "bug": "Known Bugs & Blockers", "lesson": "Core Lessons"}
PASSES = [
    ({"decision": 5, "invariant": 5, "bug": 5, "lesson": 5}, {}),
    ({"decision": 5, "invariant": 5, "bug": 5, "lesson": 5}, {"invariant": 420, "blocker": 420, "decision": 300, "lesson": 280, "bug": 210}),
    ({"decision": 3, "invariant": 4, "bug": 3, "lesson": 3}, {"invariant": 220, "blocker": 220, "decision": 160, "lesson": 150, "bug": 130}),
]


def sections(rows: DataFrame, *, newest: int = 250, level: int = 0) -> DataFrame:
    """(project, section, place, id, category, entry): the first rows of every section of each project's newest rows.

    rows: id, project, category, content, status, affinity; blockers go before bugs, rows of the project first, then the newest.
    """
    counts, chars = PASSES[level]
    recent = rows.withColumn("__n", F.row_number().over(W.partitionBy("project").orderBy(F.desc("id")))).where((F.col("__n") <= newest) & (F.col("status") == "ACTIVE"))
    name = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    kind = F.when(F.col("category").isin(*SECTIONS), F.col("category")).otherwise("lesson")
    t = recent.withColumn("category", kind).withColumn("section", name[kind])
    late = (F.col("category") == "bug").cast("int")
    t = t.withColumn("place", F.row_number().over(W.partitionBy("project", "section").orderBy(late, F.desc("affinity"), F.desc("id"))))
    most = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (SECTIONS[k], v)])
    entry = F.col("content")
    for k, n in chars.items():
        entry = F.when(F.col("category") == k, words.compact(F.col("content"), n)).otherwise(entry)
    return t.where(F.col("place") <= most[F.col("section")]).select("project", "section", "place", "id", "category", entry.alias("entry"))


def state(rows: DataFrame, *, tokens: int = 2400) -> DataFrame:
    """(project, text, level): each project's state as Markdown, from the first of three ever tighter passes that fits the budget."""
    most, out = max(300, tokens) * 4, None
    order = F.create_map(*[F.lit(x) for i, s in enumerate(dict.fromkeys(SECTIONS.values())) for x in (s, i)])
    for level in range(len(PASSES)):
        s = sections(rows, level=level).withColumn("line", F.concat(F.lit("- **#"), "id", F.lit("**: "), "entry"))
        lists = s.groupBy("project", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))
        part = F.concat(F.lit("## "), "section", F.lit("\n"), "lines", F.lit("\n"))
        whole = lists.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order[F.col("section")].alias("o"), part.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
        text = whole.select("project", F.concat(F.lit("# Compiled Project State: "), "project", F.lit("\n\n"), "body").alias("text"), F.lit(level).alias("level"))
        last = level == len(PASSES) - 1
        text = text.withColumn("text", F.substring("text", 1, most)) if last else text.where(F.length("text") <= most)
        out = text if out is None else out.unionByName(text)
    return out.groupBy("project").agg(F.min_by("text", "level").alias("text"), F.min("level").alias("level"))


def markdown(packed: DataFrame) -> DataFrame:
    """(query_id, text, citations): packed rows (query_id, rank, id, title, score, content) as one Markdown text with its manifest."""
    entry = F.concat(F.lit("### "), F.col("title"), F.lit(" (Score: "), F.format_number(F.col("score") * 100, 1), F.lit("%)\n"), F.col("content"), F.lit("\n\n---\n"))
    each = packed.select("query_id", F.struct("rank", entry.alias("entry"), F.struct("id", "title", F.round("score", 3).alias("score")).alias("c")).alias("x"))
    rows = each.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select("query_id", F.array_join(F.transform("xs", lambda x: x["entry"]), "").alias("text"), F.transform("xs", lambda x: x["c"]).alias("citations"))


def means(results: DataFrame, measures: list[str], *, by: str = "category") -> DataFrame:
    """(by, n, measures): the mean of each measure a category, and in the row ``macro`` the mean of these means, in ``all`` that of all questions."""
    per = results.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in measures])
    macro = per.agg(F.lit("macro").alias(by), F.sum("n").alias("n"), *[F.avg(m).alias(m) for m in measures])
    whole = results.agg(F.lit("all").alias(by), F.count("*").alias("n"), *[F.avg(m).alias(m) for m in measures])
    return per.unionByName(macro.select(per.columns)).unionByName(whole.select(per.columns))


def nth_latency(runs: DataFrame, *, by: str, value: str, share: float = 0.95) -> DataFrame:
    """(by, p): the value at place floor(share * n), counted from 0, of each group's sorted values."""
    sizes = runs.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n")).withColumn("__at", F.least(F.floor(F.col("__n") * share), F.col("__n") - 1))
    placed = ordered.running(runs.select(by, value), [by], [value])
    return placed.join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("place") == F.col("__at"))).select(by, F.col(value).alias("p"))


def agreement(ratings: DataFrame, a: str, b: str, *, by: str) -> DataFrame:
    """(by, n, binary, near, exact): how often two ratings from 0 to 1 agree: on one half, within a quarter, to the letter."""
    share = lambda c: F.avg(c.cast("int"))
    return ratings.groupBy(by).agg(F.count("*").alias("n"), share((F.col(a) >= 0.5) == (F.col(b) >= 0.5)).alias("binary"), share(F.abs(F.col(a) - F.col(b)) <= 0.25).alias("near"), share(F.col(a) == F.col(b)).alias("exact"))
