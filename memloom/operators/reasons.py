"""Reasons that commit messages give: messages as lines, paragraphs and sentences, and the best two sentences of each.

A message is at most ``LENGTH`` signs, so its lines and sentences are few; messages are what is dealt out.

Defined cases: a null or empty body, a version bump, and a message without a telling sentence have no row; a null subject has no
words; ids name messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Which lines, paragraphs and sentences of a message count, and lengths.
TRAILER = r"(?i)^\s*(?:co-authored-by|signed-off-by|reviewed-by|reviewed-on|acked-by|tested-by|reported-by|suggested-by|helped-by|change-id|pr-url|cc|bug|ticket|tracker|issue)\s*:"
FIXES_ONLY = r"(?i)^\s*(?:fix(?:e[sd])?|close[sd]?|resolve[sd]?|refs?|see|related to|part of)\b:?\s*(?:#\d+|gh-\d+|[\w.-]+\/[\w.-]+#\d+|https?:\/\/\S+)(?:[\s,;&]+(?:and\s+)?(?:#\d+|gh-\d+|[\w.-]+\/[\w.-]+#\d+|https?:\/\/\S+))*\s*[.]?\s*$"
BUMP = r"(?im)^\s*(?:bumps?|updates?|upgrades?)\s+(?:\[?`?[\w@/.-]+`?\]?(?:\([^)]*\))?\s+)?(?:from|to)\b|this pr contains the following updates|^\s*dependabot will resolve"
DUMP_HEADING = r"(?im)^\s{0,3}(?:#{1,6}\s*)?(?:\*\*)?(?:what'?s changed|release notes?|changelog|full changelog|commits|sourced from)\b"
WHY_LABEL = r"(?i)^(?:why|reason|rationale|motivation)\s*:\s*"
EMPTY_LABEL = r"(?i)^(?:n\/?a|none|see\b|tbd|todo|-)\b"
NOT_BECAUSE = r"(?i)(?:\bnot|\bnever|n't)\s+(?:just\s+|only\s+|simply\s+)?because\b"
SUBJECT_KIND = r"(?i)^[a-z]+(?:\([^)]*\))?!?:\s+"
STRONG = [
    r"(?i)\bbecause\b",
    r"(?i)\bso that\b",
    r"(?i)\bin order to\b",
    r"(?i)\bto avoid\b",
    r"(?i)\bto prevent\b",
    r"(?i)\bdue to\b",
    r"(?i)\bas a result\b",
    r"(?i)\bwas causing\b",
    r"(?i)\bcaused by\b",
    r"(?i)\bsince\s+(?:(?:the|it|its|this|that|there|a|an|these|those|all|both|each|every|no|not|only)\b(?!\s+(?:last|first|previous|beginning|start|release|version|v?\d))|[\w.:/#-]+\s+(?:is|are|was|were|has|have|had|does|do|can|could|will|would|must|should|may|might|needs?|uses?|stores?|ignores?|supports?|reads?|runs?|returns?|calls?|requires?|handles?|caches?)\b)",
]
MEDIUM = [r"(?i)\binstead of\b", r"(?i)\brather than\b", r"(?i)\bpreviously\b", r"(?i)\bno longer\b", r"(?i)\botherwise\b", r"(?i)\bto fix\b", r"(?i)\bregression\b"]
PROBLEM = r"(?i)\b(?:break(?:s|ing)?|broke|broken|fail(?:s|ed|ing|ure)?|crash(?:es|ed|ing)?|leak(?:s|ed|ing)?|corrupt(?:s|ed|ion)?|deadlock(?:s|ed)?|race\b|timeout(?:s)?|hang(?:s|ing)?|bug(?:s)?|error(?:s)?|wrong(?:ly)?|incorrect(?:ly)?|vulnerab\w*|cache[sd]?)\b"
LENGTH, SENTENCES, SENTENCE, LEAST_WORDS, TITLE_WORDS, SAME = 6000, 2, 180, 5, 3, 0.8

ITEM = r"^(?:[-*+]|\d+[.)])\s+"
TABLE_ROW = r"^\|.*\|$"
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
FENCE = r"(?m)^\s*(```|~~~)[\s\S]*?(?:^\s*\1|\z)"
#: What an inline mark leaves behind.
MARKS = [(r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?i)</?[a-z][a-z0-9]*\b[^>]*>", " "), (r"(\*\*|__)(.+?)\1", "$2"), (r"`([^`]*)`", "$1"), (r"\s+", " ")]
ENDS = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])"
BLANKS = " \t\n\r\x0b\x0c"


def _any(text: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))


def paragraphs(commits: DataFrame, *, key: str = "id") -> DataFrame:
    """(key, title, p, text): each message's paragraphs in order; list items stand alone, trailers and tables part paragraphs."""
    body = F.substring(F.regexp_replace("body", "\r\n?", "\n"), 1, LENGTH)
    told = commits.select(key, F.trim(F.regexp_replace(F.coalesce("subject", F.lit("")), r"\s+", " ")).alias("title"), body.alias("body")).where(~F.col("body").rlike(BUMP))
    kept = F.regexp_replace(F.regexp_replace(F.get(F.split("body", DUMP_HEADING, 2), F.lit(0)), COMMENT, "\n"), FENCE, "\n")
    lines = told.select(key, "title", F.posexplode(F.split(kept, "\n")).alias("n", "line")).withColumn("line", F.trim("line", F.lit(BLANKS)))
    item = F.col("line").rlike(ITEM)
    gap = (F.col("line") == "") | F.col("line").rlike(TRAILER) | F.col("line").rlike(FIXES_ONLY) | F.col("line").rlike(TABLE_ROW)
    # Every gap and item ends what came before; an item and the lines behind it share a number and differ in ``rest``.
    ends = F.sum((gap | item).cast("int")).over(W.partitionBy(key).orderBy("n"))
    lines = lines.withColumns({"p": ends, "rest": (~item).cast("int"), "gap": gap}).where("NOT gap")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.regexp_replace("line", ITEM, "").alias("l")))), lambda x: x["l"]), " ")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ")
    out = lines.groupBy(key, "title", "p", "rest").agg(F.when(F.col("rest") == 0, whole).otherwise(joined).alias("text"))
    return out.select(key, "title", F.struct("p", "rest").alias("p"), F.trim(_replaced(F.col("text"), MARKS)).alias("text")).where("text != '' AND text != title")


def sentences(paragraphs_: DataFrame, *, key: str = "id") -> DataFrame:
    """(key, p, i, text, score): sentences that give a reason: 4 behind a label, 3 by a strong word, 2 by a weaker word and a problem."""
    label = F.col("text").rlike(WHY_LABEL)
    bare = paragraphs_.withColumns({"labelled": label, "text": F.trim(F.regexp_replace("text", WHY_LABEL, ""))}).where("NOT labelled OR text != ''")
    bare = bare.where(~(F.col("labelled") & F.col("text").rlike(EMPTY_LABEL)))
    each = bare.select(key, "title", "p", "labelled", F.posexplode(F.split("text", ENDS)).alias("i", "text")).withColumn("text", F.trim("text"))
    first = F.col("labelled") & (F.col("i") == 0)
    title, mine = F.array_distinct(_words(F.regexp_replace("title", SUBJECT_KIND, ""))), _words(F.col("text"))
    held = F.size(F.filter(mine, lambda w: F.array_contains(title, w)))
    repeats = (F.size(title) >= TITLE_WORDS) & (F.size(mine) <= F.size(title) + 3) & (held >= SAME * F.size(mine))
    unquoted = F.regexp_replace("text", '"[^"]*"', " ")
    score = F.when(first, 4).when(_any(unquoted, STRONG), 3).when(_any(unquoted, MEDIUM) & unquoted.rlike(PROBLEM), 2).otherwise(0)
    sound = (F.size(F.split("text", r"\s+")) >= LEAST_WORDS) & ~F.endswith("text", F.lit("?")) & (first | ~repeats) & ~unquoted.rlike(NOT_BECAUSE)
    return each.withColumn("score", score).where(sound & (F.col("score") >= 2)).select(key, "p", "i", "text", "score")


def reasons(commits: DataFrame, *, key: str = "id") -> DataFrame:
    """(key, why) of commits (key, subject, body): the best sentences in the order of the message, each cut at a blank."""
    found = sentences(paragraphs(commits, key=key), key=key)
    best = found.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "p", "i"))).where(F.col("place") <= SENTENCES)
    head = F.substring("text", 1, SENTENCE - 3)
    whole = F.regexp_replace(head, r" [^ ]*$", "")
    cut = F.concat(F.rtrim(F.when(F.length(whole) > SENTENCE // 2, whole).otherwise(head)), F.lit("..."))
    short = best.withColumn("text", F.when(F.length("text") > SENTENCE, cut).otherwise(F.col("text")))
    return short.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "i", "text"))), lambda x: x["text"]), " ").alias("why"))
