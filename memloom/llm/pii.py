"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Built-in functions only.  A kind's matches and the text between them come from ``regexp_extract_all`` and ``split`` with
the same pattern; running lengths of the two give code-point positions.  The patterns are the contracts' own, written so
that Java's matcher takes linear time and no recursion on long texts: possessive repeats, and a look-behind that starts a
match only where a run starts (or where the last match ended).

Kinds: email, ip, card (Luhn), phone, and two that the method adds: iban (mod 97) and ssn (kept only with a word of
its kind nearby).  Scores start at the kind's own and gain ``CONTEXT_GAIN`` when a context word stands within
``CONTEXT`` characters before or behind the span; spans under ``MIN_SCORE`` are dropped.  The first four always stay.

Defined cases: null is the empty text; no span gives empty lists; repeated rows are judged one by one; empty tables give
no rows; other columns are kept as they are, and a table that has a column named like ``into`` is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, table

BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole chains of 13 to 19 digits with at most one blank or hyphen between two of them.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without the sign or digits a kind needs isn't searched for it; every hint is implied by the kind's pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
HINTS = {"card": r"[0-9][\x20-]?[0-9]", "iban": "[0-9]{2}"}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
WORDS = {
    "email": "e-?mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|mastercard|amex|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social security",
}
CONTEXT, CONTEXT_GAIN, MIN_SCORE = 40, 0.2, 0.5
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def mod97(m: Column) -> Column:
    """Remainder of an IBAN: four signs go to the end, letters count as 10 to 35."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    step = lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m) == 1
    return F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of one kind; end is exclusive."""
    pattern = F.lit(PATTERNS[kind])
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,start:int,end:int>>").alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        lo = acc["at"] + F.length(pair["b"])
        hi = lo + F.length(pair["m"])
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(F.struct(pair["m"].alias("m"), lo.alias("start"), hi.alias("end")))).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    placed = F.filter(F.aggregate(pairs, start, add, lambda acc: acc["out"]), lambda x: valid(kind, x["m"]))

    def scored(x: Column) -> Column:
        # The match itself is no context: a blank stands for it.
        lo = F.greatest(x["start"] - CONTEXT, F.lit(0))
        around = F.concat(F.substr(text, lo + 1, x["start"] - lo), F.lit(" "), F.substr(text, x["end"] + 1, F.lit(CONTEXT)))
        gain = F.when(around.rlike(rf"(?i)(?<![A-Za-z])(?:{WORDS[kind]})(?![A-Za-z])"), CONTEXT_GAIN + 0.1 * (kind == "ssn")).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.round(SCORES[kind] + gain, 2).alias("score"))

    none = F.array().cast(SPANS)
    spans = F.filter(F.transform(placed, scored), lambda s: F.lit(kind in BASE) | (s["score"] >= MIN_SCORE)).cast(SPANS)
    hint = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike(HINTS[kind])
    return F.when(hint & text.rlike(PATTERNS[kind]), spans).otherwise(none)


def find(docs: DataFrame, *, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with a column ``into``: all spans, by kind and then by start."""
    t = F.coalesce(F.col(text), F.lit(""))
    return added(docs, into, F.concat(*[matches(t, k) for k in PATTERNS]))


def redact(docs: DataFrame, *, text: str = "text", spans: str = "pii") -> DataFrame:
    """``docs`` with every span of ``spans`` replaced by its kind in brackets; overlapping spans become one."""
    t = F.col(text)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.array(F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    clean = F.aggregate(ordered, begin, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(t, acc["at"] + 1)))
    return docs.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(t))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_checked_patterns(spark, sf_dir: str) -> DataFrame:
    docs = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return docs.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def _found(kind: str, pattern: str, valid_: str) -> str:
    """SQL for the spans of one kind: matches and the text between them come from one pattern."""
    return (
        f"{kind} AS (SELECT r, '{kind}' AS kind, m, CAST(coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS lo "
        f"FROM (SELECT r, f, b, f[i] AS m, i FROM (SELECT r, f, b, unnest(range(1, len(f) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS f, regexp_split_to_array(t, '{pattern}') AS b FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {valid_})"
    )


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INT) ELSE (CAST({_DIGITS}[i] AS INT) * 2) // 10 + (CAST({_DIGITS}[i] AS INT) * 2) % 10 END)) % 10 = 0"
_BYTE = "len(list_filter(string_split(m, '.'), lambda p: NOT regexp_matches(regexp_replace(p, '^0+([0-9])', '\\1'), '^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$'))) = 0"
_MOD97 = "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, x: (a * (CASE WHEN x >= 10 THEN 100 ELSE 10 END) + x) % 97) = 1"
_IBAN = r"^([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?:[^A-Za-z0-9]|$)"

#: The contract's own patterns; the method's two kinds by candidate starts and by whole runs, as this SQL has no look-around.
SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), "
    + ", ".join(
        [
            _found("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _found("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", _BYTE),
            _found("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
            _found("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
            _found("ssn", "[0-9-]+", "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"),
        ]
    )
    + f""", q AS (SELECT r, i, regexp_extract(substr(t, i, 48), '{_IBAN}', 1) AS m FROM (SELECT r, t, unnest(range(1, length(t) + 1)) AS i FROM d WHERE regexp_matches(t, '[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}'))
  WHERE regexp_matches(substr(t, i, 4), '^[A-Z]{{2}}[0-9]{{2}}') AND NOT regexp_matches(substr(t, greatest(i - 1, 1), CASE WHEN i > 1 THEN 1 ELSE 0 END), '[A-Za-z0-9]')),
iban AS (SELECT r, 'iban' AS kind, m, i - 1 AS lo FROM q WHERE m <> '' AND {_MOD97}),
near AS (SELECT ssn.* FROM ssn JOIN d USING (r) WHERE regexp_matches(substr(t, CAST(greatest(lo - 40, 0) AS INT) + 1, CAST(lo - greatest(lo - 40, 0) AS INT)) || ' ' || substr(t, CAST(lo AS INT) + length(m) + 1, 40), '(?i)(^|[^A-Za-z])(ssn|social security)([^A-Za-z]|$)')),
a AS (SELECT *, 1 AS o FROM email UNION ALL SELECT *, 2 FROM ip UNION ALL SELECT *, 3 FROM card UNION ALL SELECT *, 4 FROM phone UNION ALL SELECT *, 5 FROM iban UNION ALL SELECT *, 6 FROM near),
s AS (SELECT r, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone,
  string_agg(kind || ':' || lo || ':' || (lo + length(m)), ',' ORDER BY o, lo) FILTER (o <= 4) AS base, string_agg(kind || ':' || lo || ':' || (lo + length(m)), ',' ORDER BY o, lo) AS spans FROM a GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (r)"""
)
