"""Turns of a dialogue cut to a budget of characters: the two speakers share it, code shrinks to signatures, dates stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as texts

# Patterns, shares of the budget and numbers of lines.
TURN = r"(?is)^(.*?\bUSER:\s*)(.*?)\s*\|\s*ASSISTANT:\s*(.*)$"
BLOCK = r"(?s)```([\w-]*)\n(.*?)```"
SIGNATURE = r"(?i)^(CREATE|ALTER|ADD COLUMN|DROP|INSERT|SELECT|def |class |@app\.|revision|op\.|git |const |function |export )"
DATE = r"(?i)\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}"
HEADING, LISTED = r"^#{1,6}\s", r"(?i)^(\d+\.\s+|-\s+[A-Z])"
SHORT, BRIEF, DATED = 260, 360, 220
SHARE, SHORT_SHARE, HEAD_SHARE, TAIL_SHARE = 0.62, 0.68, 0.78, 0.18
HEADINGS, LISTINGS, OTHERS = 14, 12, 3


def _head(t: Column, n: Column) -> Column:
    """The first ``n`` signs; with less than none, all but so many."""
    return F.substr(t, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(t) + n, F.lit(0))).cast("int"))


def _tail(t: Column, n: Column) -> Column:
    return F.when(n <= 0, t).otherwise(F.substr(t, F.greatest(F.length(t) - n + 1, F.lit(1)).cast("int")))


def signatures(text: Column, most: int) -> Column:
    """Code blocks as ``[lang code: line; line]`` of their first ``most`` telling lines."""
    blocks = [F.regexp_extract_all(text, F.lit(BLOCK), F.lit(g)) for g in (1, 2)]
    between = F.split(text, BLOCK, -1)

    def short(lang: Column, code: Column) -> Column:
        label = F.when(lang != "", F.concat(lang, F.lit(" code"))).otherwise("code")
        keep = F.slice(F.filter(F.transform(F.split(code, "\n"), lambda s: F.trim(s)), lambda s: s.rlike(SIGNATURE)), 1, most)
        return F.when(F.size(keep) > 0, F.concat(F.lit("["), label, F.lit(": "), F.array_join(keep, "; "), F.lit("]"))).otherwise(F.concat(F.lit("["), label, F.lit(" block]")))

    told = F.concat(F.zip_with(*blocks, short), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, told, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _asked(raw: Column, budget: Column, most: Column) -> Column:
    """What the user said, within ``budget``: all of it, or its head with the dates it names, or head and tail."""
    plain = F.when(most <= BRIEF, F.regexp_replace(raw, r"(?s)```.*?```", " ")).otherwise(signatures(raw, 5))
    flat = F.trim(F.regexp_replace(plain, r"\s+", " "))
    bare = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(s), r"^[-*]\s*", ""), r"\*\*", ""), r"\s*\([^)]*\)", "")
    dates = F.filter(F.transform(F.split(plain, "\n"), bare), lambda s: s.rlike(DATE))
    dated = F.array_join(dates, " | ")
    room = budget - F.length(dated) - 3
    with_dates = F.when(room >= 16, F.concat(_head(flat, room), F.lit(" | "), dated)).otherwise(_tail(dated, budget))
    parts = F.concat(_head(flat, F.floor(budget * HEAD_SHARE)), F.lit(" ... "), _tail(flat, F.floor(budget * TAIL_SHARE)))
    return F.when(F.length(flat) <= budget, flat).when((F.size(dates) >= 2) & (budget >= DATED), with_dates).otherwise(parts)


def _answered(raw: Column, budget: Column) -> Column:
    """What the assistant said, within ``budget``: headings and dates first, then listed lines, then a few others."""
    lines = F.filter(F.transform(F.split(signatures(raw, 4), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    first = lambda s: s.rlike(DATE) | s.rlike(HEADING)
    sorts = [(first, HEADINGS), (lambda s: ~first(s) & s.rlike(LISTED), LISTINGS), (lambda s: ~first(s) & ~s.rlike(LISTED), OTHERS)]
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"^#{1,6}\s*", ""), r"\*\*", "")
    kept = F.transform(F.concat(*[F.slice(F.filter(lines, f), 1, n) for f, n in sorts]), bare)
    return _head(F.trim(F.regexp_replace(F.array_join(kept, " | "), r"\s{2,}", " ")), budget)


def condensed(text: Column, most: Column | int) -> Column:
    """A text without boilerplate, cut to about ``most`` characters (0: not cut); of a dialogue turn both sides stay.

    Null is the empty text.  The user gets 62 % of the room (68 % of short ones), the assistant the rest.
    """
    most = most if isinstance(most, Column) else F.lit(most)
    clean = texts.without_boilerplate(text)
    prefix, user, other = (F.regexp_extract(clean, TURN, g) for g in (1, 2, 3))
    room = F.greatest(F.lit(80), most - F.length(prefix) - 15)
    share = F.floor(room * F.when(most <= SHORT, SHORT_SHARE).otherwise(SHARE))
    rest = F.greatest(F.lit(30), room - share)
    turn = F.concat(prefix, _asked(user, share, most), F.lit(" | ASSISTANT: "), _answered(other, rest))
    return F.when((most <= 0) | (F.length(clean) <= most), clean).when(clean.rlike(TURN), turn).otherwise(F.substr(clean, F.lit(1), most.cast("int")))
