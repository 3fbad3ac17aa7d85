"""Rules over changes: files that must change together, and patterns that added lines should avoid."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str | None:
    """A regular expression of a glob with *, ** and ?, matched from the start or after any slash; null for other signs."""
    if not glob or re.search(r"[{}\[\]!\\]", glob):
        return None
    part = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(part.get(t, re.escape(t)) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob))
    return f"(?:^|/){body}$"


def _matched(value: Column, patterns: list[tuple[int, str]]) -> Column:
    """Numbers of the patterns that a value matches: one expression, however many patterns there are."""
    if not patterns:
        return F.array().cast("array<int>")
    known = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in patterns])
    return F.array_distinct(F.transform(F.filter(known, lambda x: F.rlike(value, x["p"])), lambda x: x["i"]))


def missing_companions(touched: DataFrame, rules: list[dict], *, key: str = "diff_id") -> DataFrame:
    """(key, rule, required): rules {id, when, require} whose ``when`` globs a change touches while it touches no ``require`` glob.

    Each file meets all globs in one expression; a change keeps the numbers of the rules it meets, at most twice the rules.
    """
    sides = {side: [(i, p) for i, r in enumerate(rules) for p in map(glob_pattern, r[side]) if p] for side in ("when", "require")}
    file = F.coalesce("file", F.lit(""))
    each = touched.select(key, _matched(file, sides["when"]).alias("w"), _matched(file, sides["require"]).alias("r")).where("size(w) > 0 OR size(r) > 0")
    per = each.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("w"))).alias("w"), F.array_distinct(F.flatten(F.collect_set("r"))).alias("r"))
    named = F.array(*[F.struct(F.lit(r["id"]).alias("rule"), F.lit(", ".join(r["require"])).alias("required")) for r in rules])
    broken = per.select(key, F.explode(F.array_except("w", "r")).alias("i"))
    return broken.select(key, F.get(named, F.col("i")).alias("x")).select(key, "x.rule", "x.required")


def pattern_findings(added: DataFrame, patterns: list[tuple[str, str]], *, key: str = "diff_id", most: int = 2, exempt: str = r"(^|/)(tests?|fixtures?|vendor|node_modules)/") -> DataFrame:
    """(key, file, rule): at most ``most`` of the patterns (rule, regex), in their order, that added lines of a file match."""
    rows = added.where(~F.coalesce(F.col("file"), F.lit("")).rlike(exempt))
    each = rows.select(key, "file", _matched(F.coalesce("line", F.lit("")), [(i, p) for i, (_, p) in enumerate(patterns)]).alias("hits")).where("size(hits) > 0")
    per = each.groupBy(key, "file").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"))
    named = F.array(*[F.lit(rule) for rule, _ in patterns])
    return per.select(key, "file", F.explode(F.slice("hits", 1, most)).alias("i")).select(key, "file", F.get(named, F.col("i")).alias("rule"))


def first_findings(sources: list[DataFrame], *, key: str = "diff_id", most: int = 3) -> DataFrame:
    """The first ``most`` findings (key, rule) of each change; earlier frames go first."""
    union = None
    for i, s in enumerate(sources):
        part = s.select(key, "rule").withColumn("source", F.lit(i))
        union = part if union is None else union.unionByName(part)
    return union.distinct().withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("source", "rule"))).where(F.col("place") <= most)
