"""Source text without comments, and calls inside brackets: code as a table of tokens.

A small UDF cuts a text into tokens, since how a sign is read depends on what stands open (strings, templates and the code
inside them, regular expressions).  All else are joins and windows over tokens: comments go by their kind, brackets match by
nesting depth, which is a prefix sum.

Defined cases: null and empty texts have no tokens; what is never closed runs to the end of its line or text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and signs that a regular expression can follow, and its flags.
BEFORE_LITERAL = frozenset("return throw case typeof void delete in of instanceof yield await else do".split())
OPENERS = "(,[=:{;!&|?+-*~^%>"
FLAGS = "dgimsuvy"

_STRING = r"""(?P<string>'(?:\\[\s\S]|[^'\n])*'?|"(?:\\[\s\S]|[^"\n])*"?)"""
_REST = r"(?P<word>[A-Za-z0-9_$.]+)|(?P<space>\s+)|(?P<sign>[\s\S])"
SCRIPT = re.compile(rf"(?P<block>/\*[\s\S]*?(?:\*/|\Z))|(?P<line>//[^\n]*)|{_STRING}|(?P<tick>`)|{_REST}")
PYTHON = re.compile(rf"""(?P<line>\#[^\n]*)|(?P<triple>'''(?:\\[\s\S]|(?!''')[\s\S])*(?:'''|\Z)|\"\"\"(?:\\[\s\S]|(?!\"\"\")[\s\S])*(?:\"\"\"|\Z))|{_STRING}|{_REST}""")
TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`$])*(?P<end>`|\$\{|\Z)")
LITERAL = re.compile(rf"/(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\[\n\r])*/[{FLAGS}]*")


def tokens(text: str, python: bool) -> Iterator[tuple[str, str]]:
    """(kind, signs) in order, all of the text.  Kinds: block, line (comments), string, template, literal, word, space, sign."""
    at, last, word = 0, "", ""
    braces: list[int] = []  # of each template that is open: braces open in its code
    if not python and text.startswith("#!"):
        at = len(text.split("\n", 1)[0])
        yield "line", text[:at]
    while at < len(text):
        m = (PYTHON if python else SCRIPT).match(text, at)
        kind, signs, begin = m.lastgroup, m[0], at
        at = m.end()
        if kind in ("block", "line"):
            pass
        elif kind == "tick" or (signs == "}" and braces and not braces[-1]):
            if kind == "sign":
                braces.pop()
                yield "sign", "}"
            body = TEMPLATE.match(text, at)
            at = body.end()
            kind, signs, last, word = "template", text[begin if kind == "tick" else m.end() : at], "`", ""
            if body["end"] == "${":
                braces.append(0)
                last = "{"
        elif kind in ("string", "triple"):
            kind, last, word = "string", signs[0], ""
        elif kind == "word":
            last, word = signs[-1], signs
        elif kind == "sign":
            free = not last or last in OPENERS or ((last.isascii() and last.isalpha() or last in "_$") and word in BEFORE_LITERAL)
            if signs == "/" and not python and text[begin - 1 : begin] != "<" and free and (whole := LITERAL.match(text, begin)):
                kind, signs, at, last, word = "literal", whole[0], whole.end(), "/", ""
            else:
                last = signs
                if braces and signs in "{}":
                    braces[-1] += 1 if signs == "{" else -1
        yield kind, signs


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("signs", T.StringType())])))
def _tokens(texts: pd.Series, python: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "signs": s} for k, s in tokens(t or "", bool(p))] for t, p in zip(texts, python)])


def tokenised(text: Column, python: Column | bool = False) -> Column:
    """array<struct<kind, signs>>"""
    return _tokens(text, python if isinstance(python, Column) else F.lit(python))


def without_comments(tokens_: Column) -> Column:
    """The text again: line comments go, block comments leave their line feeds."""
    kept = F.transform(tokens_, lambda t: F.when(t["kind"] == "line", "").when(t["kind"] == "block", F.regexp_replace(t["signs"], "[^\n]+", "")).otherwise(t["signs"]))
    return F.array_join(kept, "")


def stripped(rows: DataFrame, *, text: str = "text", python: Column | bool = False) -> DataFrame:
    """``rows`` with the comments of ``text`` taken out; a null text stays null."""
    return rows.withColumn(text, F.when(F.col(text).isNotNull(), without_comments(tokenised(F.col(text), python))))


def calls_inside(rows: DataFrame, *, key: str = "id", text: str = "text", outer: str = "useEffect", inner: str = "fetch", owners: tuple[str, ...] = ("window", "globalThis", "self")) -> DataFrame:
    """(key, line): lines of calls of ``inner``, bare or on one of its owners, between the brackets of calls of ``outer``.

    A bracket's depth is the sum of the brackets before it; the bracket that closes it is the next one that comes back to that
    depth.  A bracket that is never closed holds all that follows.  Strings, templates and regular expressions hold no calls.
    """
    t = rows.select(F.col(key), F.posexplode(tokenised(F.col(text))).alias("n", "t")).select(key, "n", "t.kind", "t.signs")
    by = W.partitionBy(key).orderBy("n")  # the tokens of one row's text
    feeds = F.length("signs") - F.length(F.replace(F.col("signs"), F.lit("\n"), F.lit("")))
    t = t.withColumn("line", 1 + F.coalesce(F.sum(feeds).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # Blanks, and comments and strings that stand for blanks, don't part a name from its bracket.
    t = t.where(~F.col("kind").isin("space", "line", "block", "string", "literal", "template"))
    up, down = (F.col("kind") == "sign") & (F.col("signs") == "("), (F.col("kind") == "sign") & (F.col("signs") == ")")
    depth = F.sum(F.when(up, 1).when(down, -1).otherwise(0)).over(by)
    t = t.withColumn("depth", depth - up.cast("int")).withColumn("name", F.lag(F.when(F.col("kind") == "word", F.col("signs"))).over(by)).withColumn("told", F.lag("line").over(by))
    brackets = t.where(up | down).withColumn("closes", F.lead(F.when(down, F.col("n"))).over(W.partitionBy(key, "depth").orderBy("n")))
    opened = brackets.where(up)
    named = lambda w: F.coalesce(F.col("name").rlike(rf"(?:^|[^A-Za-z0-9_]){re.escape(w)}$"), F.lit(False))
    outside = opened.where(named(outer)).select(key, F.col("n").alias("from"), F.coalesce("closes", F.lit(2**31 - 1)).alias("to"))
    mine = F.coalesce(F.col("name") == inner, F.lit(False))
    for o in owners:
        mine |= named(f"{o}.{inner}")
    calls = opened.where(mine).select(key, "n", F.col("told").alias("line"))
    return calls.join(outside, key).where("n > from AND n < to").select(key, "line").distinct()
