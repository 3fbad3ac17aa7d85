"""Blame text, commits and the memories they speak of; code that outlived its decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from . import reasons
from .episodes import ranges

# Subjects of mechanical commits, and pull requests in subjects.
MECHANICAL = r"(?i)^(style|docs|chore|ci|build|test)(\([^)]*\))?!?:\s"
PR = r"(?i)\(#(\d+)\)\s*$|^Merge pull request #(\d+)\b|\bPR\s*#(\d+)\b"


def blamed(porcelain: DataFrame, *, key: str = "file", text: str = "porcelain") -> DataFrame:
    """(key, sha, line, summary, mechanical, prs): each blamed line with its commit; lines not yet committed are left out."""
    lines = porcelain.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("n", "l"))
    head = r"^([0-9a-f]{40})\s+\d+\s+(\d+)(\s+\d+)?$"
    sha = F.when(F.col("l").rlike(head), F.regexp_extract("l", head, 1))
    # A file's blame is one text, so its lines are one row's; only that file's lines are numbered together.
    t = lines.withColumn("sha", F.last(sha, ignorenulls=True).over(W.partitionBy(key).orderBy("n"))).where(F.col("sha").isNotNull() & ~F.col("sha").rlike("^0{40}$"))
    said = t.where(F.col("l").startswith("summary ")).groupBy(key, "sha").agg(F.min_by(F.trim(F.substring("l", 9, 10_000)), "n").alias("summary"))
    hits = t.where(F.col("l").rlike(head)).select(key, "sha", F.regexp_extract("l", head, 2).cast("long").alias("line"))
    numbers = lambda g: F.regexp_extract_all("summary", F.lit(PR), F.lit(g))
    prs = F.array_distinct(F.filter(F.concat(numbers(1), numbers(2), numbers(3)), lambda x: x != ""))
    out = hits.join(said, [key, "sha"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))
    return out.select(key, "sha", "line", "summary", F.col("summary").rlike(MECHANICAL).alias("mechanical"), prs.alias("prs"))


def commit_of(commit: Column, content: Column) -> Column:
    """The commit that a record names: in its provenance, else as ``commit <sha>`` in its text."""
    own, told = F.regexp_extract(F.lower(F.trim(commit)), "([0-9a-f]{7,40})$", 1), F.lower(F.regexp_extract(content, r"(?i)\bcommit\s+`?([0-9a-f]{7,40})`?\b", 1))
    return F.coalesce(F.when(own != "", own), F.when(told != "", told))


def pr_of(pr: Column) -> Column:
    n = F.regexp_extract(F.trim(pr), r"(?i)(?:#|/pull/|^)(\d+)\b", 1)
    return F.when(n != "", n)


def commits_named(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """(id, sha): rows (id, ref) whose reference is a prefix of a commit's sha, or the other way round: an equi-join on seven signs first."""
    a = rows.where(F.length("ref") >= 7).withColumn("__p", F.substring("ref", 1, 7))
    b = commits.select("sha").distinct().withColumn("__p", F.substring("sha", 1, 7))
    return a.join(b, "__p").where(F.startswith("sha", "ref") | F.startswith("ref", "sha")).select("id", "sha")


def label(file: Column, spans: Column) -> Column:
    """``file#L1-L2,L5 (+n more)`` of array<struct<first, last>>."""
    one = F.transform(F.slice(spans, 1, 3), lambda r: F.when(r["first"] == r["last"], F.concat(F.lit("L"), r["first"])).otherwise(F.concat(F.lit("L"), r["first"], F.lit("-L"), r["last"])))
    more = F.when(F.size(spans) > 3, F.concat(F.lit(" (+"), F.size(spans) - 3, F.lit(" more)"))).otherwise("")
    return F.when(F.size(spans) == 0, file).otherwise(F.concat(file, F.lit("#"), F.array_join(one, ","), more))


def line_labels(blamed_: DataFrame, *, key: str = "file") -> DataFrame:
    """(key, sha, label): the lines that each commit wrote in a file."""
    named = blamed_.withColumn("__k", F.concat_ws("\x1f", key, "sha"))
    spans = ranges(named.select("__k", "line"), key="__k").groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    return spans.join(named.select("__k", key, "sha").distinct(), "__k").select(key, "sha", label(F.col(key), F.col("spans")).alias("label"))


def attributed(memories: DataFrame, blamed_: DataFrame, hunks: DataFrame, *, key: str = "file") -> DataFrame:
    """(id, citation): active memories (id, status, content, file, start_line, end_line, commit, pr) that blamed lines speak of.

    By commit first, then by pull request (not of mechanical commits), then by overlapping lines of the hunks (file, first, last).
    """
    live = memories.where("status = 'ACTIVE'")
    told = line_labels(blamed_, key=key).withColumn("text", F.concat("label", F.lit(" @ "), F.substring("sha", 1, 7)))
    by_sha = commits_named(live.select("id", commit_of(F.col("commit"), F.col("content")).alias("ref")).where("ref is not null"), blamed_).join(told, "sha")
    numbers = blamed_.where("not mechanical").select("sha", F.explode("prs").alias("pr")).distinct()
    own = live.select("id", pr_of(F.col("pr")).alias("pr")).where("pr is not null")
    inside = live.select("id", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)(?:\bPR\s*#|/pull/)(\d+)\b"), F.lit(1))).alias("pr"))
    by_pr = own.unionByName(inside).distinct().join(numbers, "pr").join(told, "sha")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    spans = live.where("file is not null and start_line is not null").select("id", paths.relative(F.col("file")).alias("__f"), "start_line", F.coalesce("end_line", "start_line").alias("end_line")).withColumn("__b", base(F.col("__f")))
    h = hunks.select(F.col(key).alias("__h"), "first", "last").withColumn("__b", base(F.col("__h")))
    hit = spans.join(h, "__b").where(paths.same_file(F.col("__f"), F.col("__h")) & (F.col("start_line") <= F.col("last")) & (F.col("end_line") >= F.col("first")))
    lines = F.concat(F.lit("#L"), F.col("start_line"), F.when(F.col("end_line") != F.col("start_line"), F.concat(F.lit("-L"), F.col("end_line"))).otherwise(""))
    by_span = hit.select("id", F.concat("__h", lines).alias("text"))
    each = [p.select("id", F.lit(i).alias("kind"), "text") for i, p in enumerate((by_sha, by_pr, by_span))]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("id").agg(F.min(F.struct("kind", "text")).alias("m")).select("id", F.concat(F.lit("Blame "), F.col("m.text")).alias("citation"))


def uncovered(blamed_: DataFrame, memories: DataFrame, commits: DataFrame, *, key: str = "file", most: int = 3) -> DataFrame:
    """(key, sha, content): reasons of blamed commits (sha, subject, body) that no memory names, whatever the memory's status."""
    named = commits_named(memories.select("id", commit_of(F.col("commit"), F.col("content")).alias("ref")).where("ref is not null"), blamed_)
    free = blamed_.where("not mechanical").join(named, "sha", "left_anti").groupBy(key, "sha").agg(F.min("line").alias("line"))
    told = free.join(commits.select("sha", "subject"), "sha").join(reasons.reasons(commits, key="sha"), "sha")
    place = F.row_number().over(W.partitionBy(key).orderBy("line", "sha"))
    return told.withColumn("place", place).where(F.col("place") <= most).select(key, "sha", F.concat("subject", F.lit(" ("), "why", F.lit(")")).alias("content"))


def outlived(memories: DataFrame, terminals: DataFrame, blamed_: DataFrame, *, key: str = "file") -> DataFrame:
    """(id, replacement_id, file, sha, label): superseded memories whose commit's lines still stand.

    memories: id, status, content, commit, file, anchor_hash, quote; terminals: id, terminal_id (active).  A replacement that
    names the same file's hash or quote, or the same commit, has ratified the code.
    """
    ref = commit_of(F.col("commit"), F.col("content"))
    old = memories.where("status = 'SUPERSEDED'").select("id", ref.alias("ref"), paths.relative(F.col("file")).alias("f"), "anchor_hash", F.trim("quote").alias("quote")).join(terminals.where("id != terminal_id"), "id").where("ref is not null")
    new = memories.where("status = 'ACTIVE'").select(F.col("id").alias("terminal_id"), ref.alias("new_ref"), paths.relative(F.col("file")).alias("g"), F.col("anchor_hash").alias("new_hash"), F.trim("quote").alias("new_quote"))
    both = old.join(new, "terminal_id")
    ratified = F.coalesce(paths.same_file(F.col("f"), F.col("g")) & (F.coalesce(F.col("anchor_hash") == F.col("new_hash"), F.lit(False)) | F.coalesce(F.col("quote") == F.col("new_quote"), F.lit(False))), F.lit(False))
    again = F.coalesce(F.startswith("new_ref", "ref") | F.startswith("ref", "new_ref"), F.lit(False))
    left = both.where(~ratified & ~again).select("id", F.col("terminal_id").alias("replacement_id"), "ref")
    return left.join(commits_named(left.select("id", "ref"), blamed_), "id").join(line_labels(blamed_, key=key), "sha").select("id", "replacement_id", key, "sha", "label")
