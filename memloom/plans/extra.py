"""Queries on commits, rules, conflicts, nuggets, code and answers, over rows of the given tables, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import condense as condensing
from ..functions import text, words
from ..operators import blame, code, conflicts, grounding, nuggets, payload, reasons, relevance, search, snippets
from ..sources.tables import table
from .more import ASCII, BLAMED, TERMS, ascii_text, blamed, lists, minus
from .queries import QUERIES, SQL, STEMMED, query, stem_sql  # noqa: F401


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def hit(column: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{quoted(p)}')" for p in patterns) + ")"


# Commits.

LINES = "regexp_replace(coalesce(text, ''), '[^ -~\\n]+', ' ', 'g')"
#: Words with which each document's text begins, as a topic of its own.
FIRST = f"lower(regexp_extract({ASCII}, '[A-Za-z]+ [A-Za-z]+'))"
COMMITS = f"""(SELECT doc_id AS id, 'feat(' || source || '): ' || {FIRST} AS subject, CASE doc_id % 6 WHEN 0 THEN 'We cap ' || {FIRST} || ' because unbounded writers broke the exporter.' || chr(10) || chr(10) || 'Signed-off-by: x'
WHEN 1 THEN 'Bumps [lib] from 1.0 to 2.0 because it is old and nobody likes ' || {FIRST} || '.' WHEN 2 THEN 'Fixes #12' || chr(10) || chr(10) || '- Retries of ' || {FIRST} || ' are now bounded, so that a dead worker frees its slot.' || chr(10) || '- Why not?'
WHEN 3 THEN 'Why: ' || {FIRST} || ' must be read twice here.' || chr(10) || 'It was slow. Previously the cache failed for large inputs.' WHEN 4 THEN {LINES} || chr(10) || 'This is due to ' || left({ASCII}, 300) ELSE '| a | because b |' || chr(10) || 'Plain summary of ' || {FIRST} || ' and no more.' END AS body FROM documents)"""


def commits(spark, sf_dir) -> DataFrame:
    d, m = table(spark, sf_dir, "documents"), F.col("doc_id") % 6
    first = F.lower(F.regexp_extract(ascii_text(), "[A-Za-z]+ [A-Za-z]+", 0))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    lines = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~\n]+", " ")
    body = F.when(m == 0, say("We cap ", first, " because unbounded writers broke the exporter.\n\nSigned-off-by: x")).when(m == 1, say("Bumps [lib] from 1.0 to 2.0 because it is old and nobody likes ", first, "."))
    body = body.when(m == 2, say("Fixes #12\n\n- Retries of ", first, " are now bounded, so that a dead worker frees its slot.\n- Why not?"))
    body = body.when(m == 3, say("Why: ", first, " must be read twice here.\nIt was slow. Previously the cache failed for large inputs.")).when(m == 4, say(lines, "\nThis is due to ", F.substring(ascii_text(), 1, 300)))
    return d.select(F.col("doc_id").alias("id"), say("feat(", F.col("source"), "): ", first).alias("subject"), body.otherwise(say("| a | because b |\nPlain summary of ", first, " and no more.")).alias("body"))


#: Marks with one pattern for each sign, as this SQL has no references back.
MARKED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(?i)</?[a-z][a-z0-9]*\\b[^>]*>', ' ', 'g'), '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '__(.+?)__', '\\1', 'g'), '`([^`]*)`', '\\1', 'g'), '\\s+', ' ', 'g')"
WORDS3 = "regexp_extract_all(lower({}), '[a-z0-9]{{3,}}')"


@query(
    f"""WITH b AS (SELECT id, trim(regexp_replace(subject, '\\s+', ' ', 'g')) AS title, left(body, 6000) AS body FROM {COMMITS} WHERE NOT {hit('left(body, 6000)', reasons.BUMP)}),
k AS (SELECT id, title, string_split(regexp_replace(regexp_replace(regexp_split_to_array(body, '{quoted(reasons.DUMP_HEADING)}')[1], '(?s)<!--.*?(?:-->|$)', chr(10), 'g'), '(?ms)^\\s*```.*?(?:^\\s*```|\\z)|^\\s*~~~.*?(?:^\\s*~~~|\\z)', chr(10), 'g'), chr(10)) AS a FROM b),
l AS (SELECT id, title, n, trim(a[n], ' ' || chr(9) || chr(13)) AS line FROM (SELECT *, unnest(range(1, len(a) + 1)) AS n FROM k)),
g AS (SELECT *, {hit('line', reasons.ITEM)} AS item, line = '' OR {hit('line', reasons.TRAILER, reasons.FIXES_ONLY, reasons.TABLE_ROW)} AS gap FROM l),
p AS (SELECT *, sum((gap OR item)::INT) OVER (PARTITION BY id ORDER BY n) AS p, (NOT item)::INT AS rest FROM g),
q AS (SELECT id, title, p, rest, string_agg(CASE WHEN rest = 0 THEN regexp_replace(line, '{reasons.ITEM}', '') ELSE line END, ' ' ORDER BY n) AS t FROM p WHERE NOT gap GROUP BY ALL),
m AS (SELECT id, title, p, rest, trim({MARKED}) AS t FROM q), w AS (SELECT *, {hit('t', reasons.WHY_LABEL)} AS lab, trim(regexp_replace(t, '{reasons.WHY_LABEL}', '')) AS s FROM m WHERE t <> '' AND t <> title),
e AS (SELECT id, title, p, rest, lab, i, trim(x[i]) AS s FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM (SELECT *, string_split(regexp_replace(s, '([.!?])\\s+([A-Z0-9"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS x FROM w WHERE NOT lab OR (s <> '' AND NOT {hit('s', reasons.EMPTY_LABEL)})))),
u AS (SELECT *, lab AND i = 1 AS first, regexp_replace(s, '"[^"]*"', ' ', 'g') AS u, list_distinct({WORDS3.format(f"regexp_replace(title, '{quoted(reasons.SUBJECT_KIND)}', '')")}) AS tw, {WORDS3.format('s')} AS sw FROM e),
c AS (SELECT *, CASE WHEN first THEN 4 WHEN {hit('u', *reasons.STRONG[:-1])} THEN 3 WHEN {hit('u', *reasons.MEDIUM)} AND {hit('u', reasons.PROBLEM)} THEN 2 ELSE 0 END AS score FROM u WHERE len(regexp_split_to_array(s, '\\s+')) >= 5 AND NOT suffix(s, '?') AND NOT {hit('u', reasons.NOT_BECAUSE)}
  AND (first OR NOT (len(tw) >= 3 AND len(sw) <= len(tw) + 3 AND len(list_filter(sw, lambda w: list_contains(tw, w))) >= 0.8 * len(sw)))),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, p, rest, i) AS place, left(s, 177) AS head, regexp_replace(left(s, 177), ' [^ ]*$', '') AS whole FROM c WHERE score >= 2)
SELECT id, string_agg(CASE WHEN length(s) <= 180 THEN s ELSE rtrim(CASE WHEN length(whole) > 90 THEN whole ELSE head END) || '...' END, ' ' ORDER BY p, rest, i) AS why FROM r WHERE place <= 2 GROUP BY id"""
)
def commit_reasons(spark, sf_dir):
    return reasons.reasons(commits(spark, sf_dir))


#: Documents as memories that name a commit, a pull request, or lines of a file.
NAMING = """(SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, CASE doc_id % 4 WHEN 0 THEN 'limits set in commit ' || left(md5(CAST(doc_id // 100 AS VARCHAR)), 9) WHEN 1 THEN 'see PR #' || doc_id // 50 ELSE 'nothing named' END AS content,
CASE WHEN doc_id % 4 = 2 THEN 'src/' || doc_id % 45 || '.py' END AS file, doc_id % 30 AS start_line, doc_id % 30 + 2 AS end_line FROM documents)"""


@query(
    f"""WITH b AS (SELECT 'src/' || f || '.py' AS file, sha, line, summary, regexp_matches(summary, '{quoted(blame.MECHANICAL)}') AS mech FROM {BLAMED} WHERE NOT regexp_matches(sha, '^0+$')),
i AS (SELECT file, sha, line, line - row_number() OVER (PARTITION BY file, sha ORDER BY line) AS g FROM (SELECT DISTINCT file, sha, line FROM b)), s AS (SELECT file, sha, min(line) AS a, max(line) AS z FROM i GROUP BY file, sha, g),
o AS (SELECT *, row_number() OVER (PARTITION BY file, sha ORDER BY a) AS k, count(*) OVER (PARTITION BY file, sha) AS n FROM s),
t AS (SELECT sha, file || '#' || string_agg('L' || a || CASE WHEN z <> a THEN '-L' || z ELSE '' END, ',' ORDER BY a) FILTER (k <= 3) || CASE WHEN any_value(n) > 3 THEN ' (+' || any_value(n) - 3 || ' more)' ELSE '' END || ' @ ' || left(sha, 7) AS text FROM o GROUP BY file, sha),
m AS (SELECT * FROM {NAMING} WHERE status = 'ACTIVE'), c AS (SELECT id, regexp_extract(content, 'commit ([0-9a-f]{{7,40}})', 1) AS ref FROM m), p AS (SELECT id, regexp_extract(content, 'PR #(\\d+)', 1) AS pr FROM m),
e AS (SELECT DISTINCT sha, regexp_extract(summary, '\\(#(\\d+)\\)', 1) AS pr FROM b WHERE NOT mech), h AS (SELECT DISTINCT 'src/' || f || '.py' AS file, 5 AS first, 9 AS last FROM {BLAMED}),
a AS (SELECT id, 0 AS kind, text FROM c JOIN t ON ref <> '' AND starts_with(sha, ref) UNION ALL SELECT id, 1, text FROM p JOIN e USING (pr) JOIN t USING (sha) WHERE pr <> ''
  UNION ALL SELECT id, 2, file || '#L' || start_line || '-L' || end_line FROM m JOIN h USING (file) WHERE start_line <= last AND end_line >= first)
SELECT id, 'Blame ' || min_by(text, (kind, text)) AS citation FROM a GROUP BY id"""
)
def attributed_memories(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    content = F.when(i % 4 == 0, say("limits set in commit ", F.substring(F.md5(F.floor(i / 100).cast("string")), 1, 9))).when(i % 4 == 1, say("see PR #", F.floor(i / 50))).otherwise("nothing named")
    none = F.lit(None).cast("string")
    m = d.select(i.alias("id"), F.when(i % 9 == 0, "SUPERSEDED").otherwise("ACTIVE").alias("status"), content.alias("content"), F.when(i % 4 == 2, say("src/", i % 45, ".py")).alias("file"), (i % 30).alias("start_line"), (i % 30 + 2).alias("end_line"), none.alias("commit"), none.alias("pr"))
    hunks = d.select(F.concat(F.lit("src/"), i % 40, F.lit(".py")).alias("file"), F.lit(5).cast("long").alias("first"), F.lit(9).cast("long").alias("last")).distinct()
    return blame.attributed(m, blamed(spark, sf_dir), hunks)


# Rules.

NAMES = "'flush_' || source || '_' || doc_id % 50"
VARIANTS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains({1}, w))"


def variants(column: str) -> str:
    return f"list_distinct(list_filter(list_transform({VARIANTS.format(column, lists(relevance.NOISE))}, lambda w: {stem_sql('w')}), lambda w: length(w) >= 4 AND NOT list_contains(list_transform({lists(relevance.NOISE)}, lambda x: {stem_sql('x')}), w)))"


@query(
    f"""WITH l AS (SELECT doc_id AS id, any_value(CASE WHEN toxic = 1 THEN 0.1 ELSE 0.5 + 0.5 * quality END) AS weight FROM labels GROUP BY doc_id),
r AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'blocker' WHEN 1 THEN 'invariant' WHEN 2 THEN 'decision' ELSE 'bug' END AS category, coalesce(weight, 1.0) AS weight, {NAMES} AS name, {variants(f"lower(regexp_replace({ASCII}, '[^A-Za-z]+', ' ', 'g'))[1:400] || ' Never call `' || {NAMES} || '` again'")} AS s FROM documents LEFT JOIN l ON l.id = doc_id WHERE coalesce(weight, 1.0) > 0.2),
q AS (SELECT item_id, lower('then flush_src' || item_id % 20 || '_' || item_id % 50 || '() is called: ' || {ASCII}) AS low FROM benchmark), qs AS (SELECT item_id, {variants('low')} AS s FROM q), n AS (SELECT count(*) AS n FROM r),
e AS (SELECT id, unnest(s) AS stem FROM r), f AS (SELECT stem, ln(1 + (SELECT n FROM n) / (1.0 + count(*))) AS idf FROM e GROUP BY stem), w AS (SELECT id, stem, idf FROM e JOIN f USING (stem)),
x AS (SELECT id, sum(idf) AS six FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY idf DESC, stem) AS p FROM w) WHERE p <= 6 GROUP BY id),
h AS (SELECT item_id, id, count(*) AS n_stems, sum(idf) AS s, any_value(b) AS b FROM (SELECT item_id, len(s) AS b, unnest(s) AS stem FROM qs) JOIN w USING (stem) GROUP BY ALL),
o AS (SELECT item_id, id, n_stems, least(1, s / six) * CASE WHEN b > 25 THEN 1 / (1 + 0.12 * log2(b / 25.0)) ELSE 1 END AS overlap FROM h JOIN x USING (id)),
y AS (SELECT item_id, r.id, 1 AS n_symbols FROM q JOIN r ON regexp_matches(low, '(^|[^a-z0-9_])' || name || '([^a-z0-9_]|$)')),
z AS (SELECT coalesce(o.item_id, y.item_id) AS item_id, coalesce(o.id, y.id) AS id, coalesce(n_symbols, 0) AS symbols, coalesce(n_stems, 0) AS stems, coalesce(overlap, 0) AS overlap FROM o FULL JOIN y ON o.item_id = y.item_id AND o.id = y.id)
SELECT item_id AS query_id, id, symbols, stems, round(round(least(1, greatest(CASE WHEN symbols > 0 THEN 0.75 ELSE 0 END, CASE WHEN stems >= 2 AND overlap >= 0.28 THEN overlap ELSE 0 END) + CASE WHEN symbols > 0 AND stems >= 2 AND overlap >= 0.28 THEN 0.08 ELSE 0 END) * weight + CASE category WHEN 'blocker' THEN 0.08 WHEN 'invariant' THEN 0.05 ELSE 0 END, 6), 4) AS score
FROM z JOIN r USING (id) WHERE symbols > 0 OR (stems >= 2 AND overlap >= 0.28)"""
)
def relevant_rules(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    bare = F.lower(text.letters(F.col("text"), 400))
    content = F.concat(bare, F.lit(" Never call `flush_"), "source", F.lit("_"), i % 50, F.lit("` again"))
    category = F.when(i % 4 == 0, "blocker").when(i % 4 == 1, "invariant").when(i % 4 == 2, "decision").otherwise("bug")
    weight = F.when(F.col("toxic") == 1, 0.1).otherwise(0.5 + 0.5 * F.col("quality"))
    weights = table(spark, sf_dir, "labels").groupBy(i.alias("id")).agg(F.any_value(weight).alias("weight"))
    b = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select(b.alias("query_id"), F.concat(F.lit("then flush_src"), b % 20, F.lit("_"), b % 50, F.lit("() is called: "), ascii_text()).alias("query"))
    got = relevance.scored(d.select(i.alias("id"), category.alias("category"), content.alias("content")), asked, weights)
    return got.select("query_id", "id", "symbols", "stems", F.round("score", 4).alias("score"))


# Conflicts and updates.

#: Ten documents are a pool: statements about its topic that agree, contradict or change, and words of a text.
STATED = f"""(SELECT doc_id // 10 AS query_id, doc_id AS id, CASE doc_id % 10 WHEN 0 THEN 'The lamp' || doc_id // 10 || ' ' || source || 'x desk must always be enabled' WHEN 1 THEN 'Never enable the lamp' || doc_id // 10 || ' desk' WHEN 2 THEN 'lamp' || doc_id // 10 || ' desk timeout is 30s'
WHEN 3 THEN 'lamp' || doc_id // 10 || ' desk timeout changed and is 45s' WHEN 4 THEN NULL WHEN 5 THEN left(regexp_replace({ASCII}, '[^A-Za-z]+', ' ', 'g'), 80) WHEN 6 THEN 'Backups of lamp' || doc_id // 10 || ' ' || lang || 'y are required' WHEN 7 THEN 'Backups of lamp' || doc_id // 10 || ' are forbidden'
WHEN 8 THEN 'lamp' || doc_id // 10 || ' quota 20gb for backups' ELSE 'lamp' || doc_id // 10 || ' quota 40gb for backups' END AS content FROM documents)"""


def stated(spark, sf_dir) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    g = F.floor(i / 10)
    lamp = F.concat(F.lit("lamp"), g)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    lines = [
        say("The ", lamp, " ", F.col("source"), "x desk must always be enabled"), say("Never enable the ", lamp, " desk"), say(lamp, " desk timeout is 30s"), say(lamp, " desk timeout changed and is 45s"), F.lit(None).cast("string"),
        text.letters(F.col("text"), 80), say("Backups of ", lamp, " ", F.col("lang"), "y are required"), say("Backups of ", lamp, " are forbidden"), say(lamp, " quota 20gb for backups"), say(lamp, " quota 40gb for backups"),
    ]
    content = F.when(i % 10 == 0, lines[0])
    for k, line in enumerate(lines[1:], 1):
        content = content.when(i % 10 == k, line)
    return d.select(g.alias("query_id"), i.alias("id"), content.alias("content"))


#: Pairs of a pool on much the same subjects; measures are numbers with their units.
SAME = f"""WITH p AS (SELECT query_id, id, coalesce(content, '') AS t FROM {STATED}),
f AS (SELECT *, list_distinct(list_transform(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9_]+'), lambda w: length(w) >= 3 AND NOT list_contains({lists(conflicts.SILENT)}, w) AND NOT regexp_matches(w, '^[0-9]+$')), lambda w: {stem_sql('w')})) AS s,
  {hit('t', conflicts.EXPERIENCE)} AS strong, {hit('t', conflicts.NEGATIVE)} AS no, {hit('t', conflicts.AFFIRMATIVE)} AS yes, regexp_matches(t, '(?i)' || '{quoted(text.TRANSITION)}') AS moved, regexp_extract_all(lower(t), '\\b(\\d+(?:s|gb))\\b') AS raws, list_distinct(regexp_extract_all(lower(t), '\\b\\d+(s|gb)\\b', 1)) AS units FROM p),
j AS (SELECT a.query_id, a.id AS older, b.id AS newer, len(list_intersect(a.s, b.s)) AS n, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE AS jac, a.no OR a.strong AS na, b.no OR b.strong AS nb, a.yes AS ya, b.yes AS yb, b.moved AS moved,
  len(list_intersect(a.raws, b.raws)) = 0 AND len(list_intersect(a.units, b.units)) > 0 AS other FROM f a JOIN f b ON a.query_id = b.query_id AND a.id < b.id WHERE len(list_intersect(a.s, b.s)) >= 2)"""


@query(
    SAME
    + """, c AS (SELECT query_id, older, newer, CASE WHEN (na AND NOT nb AND yb) OR (nb AND NOT na AND ya) OR (na <> nb AND n >= 3) THEN 'polarity_contradiction' WHEN other AND (jac >= 0.35 OR n >= 3) THEN 'value_contradiction' END AS conflict_type FROM j) SELECT * FROM c WHERE conflict_type IS NOT NULL"""
)
def found_conflicts(spark, sf_dir):
    return conflicts.conflicts(stated(spark, sf_dir)).select("query_id", "older", "newer", "conflict_type")


@query(
    SAME
    + """, u AS (SELECT query_id, older, newer, round(CASE WHEN moved THEN 0.5 ELSE 0 END + CASE WHEN other AND jac >= 0.28 THEN 0.45 ELSE 0 END + 1.6 * jac + 0.12 * n, 6) AS strength FROM j WHERE moved OR (other AND jac >= 0.28)),
b AS (SELECT query_id, newer, max(older) FILTER (strength = top) AS older FROM (SELECT *, max(strength) OVER (PARTITION BY query_id, newer) AS top FROM u) GROUP BY ALL) SELECT query_id, newer, older FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY newer DESC) AS r FROM b) WHERE r <= 3"""
)
def found_updates(spark, sf_dir):
    return conflicts.updates(stated(spark, sf_dir)).select("query_id", "newer", "older")


# Nuggets.

FACTS = f"(SELECT 'fact ' || source || ' ' || doc_id % 5 AS key, doc_id AS seq, CASE WHEN doc_id % 17 = 0 THEN 'forget' ELSE 'set' END AS op, left(lower(regexp_replace({ASCII}, '[^A-Za-z]+', ' ', 'g')), 120) AS value, 'project' AS kind FROM documents)"
WANTED = f"(SELECT item_id AS query_id, CASE WHEN item_id % 10 = 7 THEN '*' WHEN item_id % 10 = 3 THEN 'Fact SRC' || item_id % 20 || ' ' || item_id % 5 ELSE left(regexp_replace({ASCII}, '[^A-Za-z]+', ' ', 'g'), 60) END AS text FROM benchmark)"


@query(
    f"""WITH k AS (SELECT key, lower(key || ' ' || max_by(value, seq)) AS hay FROM {FACTS} GROUP BY key HAVING max_by(op, seq) <> 'forget'),
t1 AS (SELECT query_id, lower(text) AS q, list_distinct({TERMS}) AS a FROM {WANTED}), t2 AS (SELECT query_id, q, {minus("a", words.TEMPORAL_CUES)} AS a FROM t1), t AS (SELECT query_id, q, {minus("a", words.META_WORDS)} AS a FROM t2),
h AS (SELECT DISTINCT key, {stem_sql('w')} AS stem FROM (SELECT key, unnest(list_concat(list_filter(regexp_split_to_array(hay, '[^a-z0-9_]+'), lambda x: length(x) >= 2), list_filter(list_transform(regexp_split_to_array(hay, '[^a-z0-9_.-]+'), lambda x: regexp_replace(x, '^[.-]+|[.-]+$', '', 'g')), lambda x: length(x) > 2 OR regexp_matches(x, '[0-9]') OR list_contains({lists(words.TECH_TOKENS)}, x)))) AS w FROM k)),
m AS (SELECT query_id, key, count(DISTINCT term) AS hits FROM (SELECT query_id, term, {stem_sql('term')} AS stem FROM (SELECT query_id, unnest(a) AS term FROM t)) JOIN h USING (stem) GROUP BY ALL),
s AS (SELECT query_id, key, CASE WHEN contains(hay, q) THEN 0.88 WHEN len(a) <= 2 OR hits >= 2 OR hits / len(a) >= 0.25 THEN 0.52 + 0.36 * hits / len(a) END AS score FROM m JOIN t USING (query_id) JOIN k USING (key))
SELECT query_id, key, round(score, 4) AS score FROM s WHERE score IS NOT NULL UNION ALL SELECT query_id, key, 0.85 FROM t, k WHERE trim(q) = '*'"""
)
def scored_nuggets(spark, sf_dir):
    d, i, b = table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("item_id")
    plain = functools.partial(text.letters, F.col("text"))  # as of the ASCII text, whose blanks are no letters either
    log = d.select(F.concat(F.lit("fact "), "source", F.lit(" "), i % 5).alias("key"), i.alias("seq"), F.when(i % 17 == 0, "forget").otherwise("set").alias("op"), F.lower(plain(120)).alias("value"), F.lit("project").alias("kind"))
    query_ = F.when(b % 10 == 7, "*").when(b % 10 == 3, F.concat(F.lit("Fact SRC"), b % 20, F.lit(" "), b % 5)).otherwise(plain(60))
    got = nuggets.scored(nuggets.current(log), table(spark, sf_dir, "benchmark").select(b.alias("query_id"), query_.alias("query")))
    return got.withColumn("score", F.round("score", 4))


# Code.

#: Lines of a document as a file's, and what an editor would hand over of them.
PIECES = """(SELECT doc_id, coalesce(text, '') AS t, a, CASE doc_id % 4 WHEN 0 THEN array_to_string(a[2:4], chr(10)) WHEN 1 THEN chr(10) || '  ' || trim(array_to_string(a[2:3], chr(10))) || '   ' WHEN 2 THEN array_to_string(list_concat(list_concat(a[1:1], ['put in its place']), a[3:]), chr(10)) ELSE 'no such line' || chr(10) || '   ' || coalesce(a[3], '') || chr(10) || 'nor this' || chr(10) || coalesce(a[1], '') END AS snip
FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))"""


@query(
    f"""WITH p AS (SELECT doc_id AS id, t, rtrim(replace(snip, chr(13) || chr(10), chr(10)), chr(10)) AS s FROM {PIECES} WHERE t <> '' AND trim(snip, ' ' || chr(9) || chr(10)) <> ''),
n AS (SELECT *, CASE WHEN contains(t, s) THEN s WHEN contains(t, trim(s, ' ' || chr(9) || chr(10))) THEN trim(s, ' ' || chr(9) || chr(10)) END AS needle FROM p),
x AS (SELECT id, needle, k, list_sum(list_transform(parts[1:k], lambda y: length(y))) + (k - 1) * length(needle) AS place, t FROM (SELECT *, unnest(range(1, least(len(parts), 4))) AS k FROM (SELECT *, string_split(t, needle) AS parts FROM n WHERE needle IS NOT NULL))),
e AS (SELECT DISTINCT id, 'exact' AS kind, length(left(t, CAST(place AS INT))) - length(replace(left(t, CAST(place AS INT)), chr(10), '')) + 1 AS first, length(needle) - length(replace(needle, chr(10), '')) AS more FROM x),
o AS (SELECT id, string_split(rtrim(t, chr(10)), chr(10)) AS old, string_split(s, chr(10)) AS new FROM n WHERE needle IS NULL),
h AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(old), len(new)) + 1), lambda i: old[i] <> new[i])) - 1, least(len(old), len(new))) AS head, coalesce(list_min(list_filter(range(1, least(len(old), len(new)) + 1), lambda i: old[len(old) + 1 - i] <> new[len(new) + 1 - i])) - 1, least(len(old), len(new))) AS back FROM o),
r AS (SELECT *, least(back, len(old) - head, len(new) - head) AS tail FROM h), m AS (SELECT id, 'replaced' AS kind, head + 1 AS first, least(len(old) - tail, head + 200) AS last FROM r WHERE len(old) >= 2 AND len(new) >= 2 AND (head > 0 OR tail > 0) AND len(old) - tail >= head + 1),
w AS (SELECT id, old, list_transform(old, lambda y: trim(y, ' ' || chr(9) || chr(13))) AS bare, list_filter(list_transform(new, lambda y: trim(y, ' ' || chr(9) || chr(13))), lambda y: length(y) >= 12) AS told FROM r WHERE id NOT IN (SELECT id FROM m)),
l AS (SELECT DISTINCT id, list_position(bare, y) AS line FROM (SELECT id, bare, unnest(list_filter(told, lambda y: list_contains(bare, y))[1:200]) AS y FROM w)), g AS (SELECT id, min(line) AS first, max(line) AS last FROM (SELECT *, line - row_number() OVER (PARTITION BY id ORDER BY line) AS island FROM l) GROUP BY id, island)
SELECT id, kind, first, first + least(more, 199) AS last FROM e UNION ALL SELECT * FROM m UNION ALL SELECT id, 'lines', first, last FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first) AS k FROM g) WHERE k <= 3"""
)
def located_snippets(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    a = F.split(F.coalesce("text", F.lit("")), "\n")
    part = lambda lo, n: F.array_join(F.slice(a, F.lit(lo), F.lit(n)), "\n")
    at = lambda k: F.coalesce(F.get(a, F.lit(k)), F.lit(""))
    whole = F.array_join(F.concat(F.slice(a, 1, 1), F.array(F.lit("put in its place")), F.slice(a, F.lit(3), F.greatest(F.size(a) - 2, F.lit(0)))), "\n")
    snip = F.when(i % 4 == 0, part(2, 3)).when(i % 4 == 1, F.concat(F.lit("\n  "), F.trim(part(2, 2)), F.lit("   "))).when(i % 4 == 2, whole).otherwise(F.concat(F.lit("no such line\n   "), at(2), F.lit("\nnor this\n"), at(0)))
    path = F.concat(F.lit("src/"), i, F.lit(".txt"))
    return snippets.located(d.select(path.alias("path"), "text"), d.select(i.alias("id"), path.alias("path"), snip.alias("text")))


#: A page's script with comments around its own words; its words are letters alone.
SCRIPTS = "(SELECT page_id AS id, left(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^A-Za-z]+', ' ', 'g'), 400) AS w FROM pages)"
SOURCE = "'#!run' || chr(10) || 'const a = \"' || w || ' // kept\"; // ' || w || chr(10) || '/* ' || w || chr(10) || w || ' */ let b = `x ${{ f(a /* ' || w || ' */) }} // kept`;' || chr(10) || 'let r = /[/*]\\/' || left(w, 9) || '/g; ' || CASE WHEN id % 3 = 0 THEN 'useEffect(() => {{' || chr(10) || ' fetch(a); }})' WHEN id % 3 = 1 THEN 'useEffect(() => {{ go(\")\") /* fetch(b) */ }}); fetch(a)' ELSE 'load(`${{fetch(a)}}`)' END".replace("{{", "{").replace("}}", "}")


def scripts(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    w = F.substring(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[^A-Za-z]+", " "), 1, 400)
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    i = F.col("page_id")
    tail = F.when(i % 3 == 0, "useEffect(() => {\n fetch(a); })").when(i % 3 == 1, 'useEffect(() => { go(")") /* fetch(b) */ }); fetch(a)').otherwise("load(`${fetch(a)}`)")
    body = say("#!run\nconst a = \"", w, " // kept\"; // ", w, "\n/* ", w, "\n", w, " */ let b = `x ${ f(a /* ", w, " */) } // kept`;\nlet r = /[/*]\\/", F.substring(w, 1, 9), "/g; ", tail)
    return p.select(i.alias("id"), body.alias("text"))


@query(
    f"""WITH s AS (SELECT id, {SOURCE} AS t FROM {SCRIPTS}), a AS (SELECT id, regexp_replace(t, '^#![^\\n]*', '') AS t FROM s), b AS (SELECT id, regexp_replace(t, '(// kept"; )//[^\\n]*', '\\1') AS t FROM a),
c AS (SELECT id, regexp_replace(t, '/\\* [A-Za-z ]*(\\n?)[A-Za-z ()]*\\*/', '\\1', 'g') AS t FROM b) SELECT id, t AS text FROM c"""
)
def stripped_scripts(spark, sf_dir):
    return code.stripped(scripts(spark, sf_dir))


@query(f"WITH s AS (SELECT id, {SOURCE} AS t FROM {SCRIPTS}) SELECT id, length(regexp_extract(t, '(?s)^(.*)fetch\\(a\\)', 1)) - length(replace(regexp_extract(t, '(?s)^(.*)fetch\\(a\\)', 1), chr(10), '')) + 1 AS line FROM s WHERE regexp_matches(t, 'useEffect\\(\\(\\) => \\{{\\n fetch\\(')")
def effects_with_calls(spark, sf_dir):
    return code.calls_inside(scripts(spark, sf_dir))


# Answers.

_BLOCK = "(?s)```([\\w-]*)\\n(.*?)```"
#: Turns that both sides take up, with dates, headings, lists and code.
DIALOGUE = f"""(SELECT conv_id * 10000 + turn AS id, CASE conv_id % 4 WHEN 0 THEN 240 WHEN 1 THEN 420 WHEN 2 THEN 680 ELSE 0 END AS most, '[Session ' || conv_id || ' | Turn #' || turn || '] USER: ' || CASE WHEN conv_id % 3 = 0 THEN '- **Plan** March 12 (draft)' || chr(10) ELSE '' END || {LINES} || CASE WHEN conv_id % 3 = 0 THEN chr(10) || '* May 5 review' ELSE '' END
|| ' | ASSISTANT: ' || CASE WHEN turn % 2 = 0 THEN '# Heading **one**' || chr(10) || '- Point one' || chr(10) || '2. point two' || chr(10) ELSE '' END || {LINES} || chr(10) || '```py' || chr(10) || 'def f():' || chr(10) || ' x = 1' || chr(10) || '```' || chr(10) || 'Due December 3' AS content FROM conversations)"""


def dialogue(spark, sf_dir) -> DataFrame:
    t, c = table(spark, sf_dir, "conversations"), F.col("conv_id")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    lines = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~\n]+", " ")
    dated = c % 3 == 0
    head = F.when(F.col("turn") % 2 == 0, "# Heading **one**\n- Point one\n2. point two\n").otherwise("")
    content = say("[Session ", c, " | Turn #", F.col("turn"), "] USER: ", F.when(dated, "- **Plan** March 12 (draft)\n").otherwise(""), lines, F.when(dated, "\n* May 5 review").otherwise(""), " | ASSISTANT: ", head, lines, "\n```py\ndef f():\n x = 1\n```\nDue December 3")
    most = F.when(c % 4 == 0, 240).when(c % 4 == 1, 420).when(c % 4 == 2, 680).otherwise(0)
    return t.select((c * 10_000 + F.col("turn")).alias("id"), most.alias("most"), content.alias("content"))


def signed(x: str, most: int) -> str:
    lines = f"list_filter(list_transform(string_split(regexp_extract_all({x}, '{_BLOCK}', 2)[i], chr(10)), lambda y: trim(y)), lambda y: regexp_matches(y, '{condensing.SIGNATURE}'))[1:{most}]"
    label = f"CASE WHEN regexp_extract_all({x}, '{_BLOCK}', 1)[i] <> '' THEN regexp_extract_all({x}, '{_BLOCK}', 1)[i] || ' code' ELSE 'code' END"
    told = f"CASE WHEN i > len(regexp_extract_all({x}, '{_BLOCK}')) THEN '' WHEN len({lines}) > 0 THEN '[' || {label} || ': ' || array_to_string({lines}, '; ') || ']' ELSE '[' || {label} || ' block]' END"
    return f"array_to_string(list_transform(range(1, len(regexp_split_to_array({x}, '{_BLOCK}')) + 1), lambda i: regexp_split_to_array({x}, '{_BLOCK}')[i] || {told}), '')"


_CLEAN = "content"
for _p in text.BOILERPLATE:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"
_FIRST = f"(regexp_matches(y, '{condensing.DATE}') OR regexp_matches(y, '{condensing.HEADING}'))"
_LISTED = f"regexp_matches(y, '{condensing.LISTED}')"


@query(
    f"""WITH c AS (SELECT id, most, {_CLEAN} AS t FROM {DIALOGUE}), s AS (SELECT *, regexp_extract(t, '{condensing.TURN}', 1) AS prefix, regexp_extract(t, '{condensing.TURN}', 2) AS u, regexp_extract(t, '{condensing.TURN}', 3) AS a FROM c),
b AS (SELECT *, CAST(floor(greatest(80, most - length(prefix) - 15) * CASE WHEN most <= 260 THEN 0.68 ELSE 0.62 END) AS INT) AS ub, greatest(80, most - length(prefix) - 15) AS room FROM s),
d AS (SELECT *, greatest(30, room - ub) AS ab, CASE WHEN most <= 360 THEN regexp_replace(u, '(?s)```.*?```', ' ', 'g') ELSE {signed('u', 5)} END AS said, list_filter(list_transform(string_split({signed('a', 4)}, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS l FROM b),
e AS (SELECT *, trim(regexp_replace(said, '\\s+', ' ', 'g')) AS flat, list_filter(list_transform(string_split(said, chr(10)), lambda y: regexp_replace(regexp_replace(regexp_replace(trim(y), '^[-*]\\s*', ''), '\\*\\*', '', 'g'), '\\s*\\([^)]*\\)', '', 'g')), lambda y: regexp_matches(y, '{condensing.DATE}')) AS dates,
  list_concat(list_concat(list_filter(l, lambda y: {_FIRST})[1:14], list_filter(l, lambda y: NOT {_FIRST} AND {_LISTED})[1:12]), list_filter(l, lambda y: NOT {_FIRST} AND NOT {_LISTED})[1:3]) AS kept FROM d),
f AS (SELECT *, array_to_string(dates, ' | ') AS dated, CAST(floor(ub * 0.78) AS INT) AS h, CAST(floor(ub * 0.18) AS INT) AS z FROM e)
SELECT id, CASE WHEN most <= 0 OR length(t) <= most THEN t ELSE prefix || CASE WHEN length(flat) <= ub THEN flat WHEN len(dates) >= 2 AND ub >= 220 THEN CASE WHEN ub - length(dated) - 3 >= 16 THEN left(flat, ub - length(dated) - 3) || ' | ' || dated ELSE right(dated, ub) END ELSE left(flat, h) || ' ... ' || right(flat, z) END
  || ' | ASSISTANT: ' || left(trim(regexp_replace(array_to_string(list_transform(kept, lambda y: regexp_replace(regexp_replace(y, '^#{{1,6}}\\s*', ''), '\\*\\*', '', 'g')), ' | '), '\\s{{2,}}', ' ', 'g')), ab) END AS content FROM f"""
)
def condensed_turns(spark, sf_dir):
    return dialogue(spark, sf_dir).select("id", condensing.condensed(F.col("content"), F.col("most")).alias("content"))


#: Questions of a few of a benchmark item's words and one that no turn holds, with a cosine of their own.
TELLING = f"(SELECT item_id AS query_id, list_concat(list_filter(a, lambda w, i: list_position(a, w) = i AND NOT list_contains({lists(words.STOP_WORDS)}, w))[1:4], ['zyx' || item_id]) AS terms, 0.30 + item_id % 5 / 20.0 AS raw FROM (SELECT item_id, regexp_extract_all(lower({ASCII}), '[a-z]{{4,}}') AS a FROM benchmark))"


@query(
    f"""WITH t AS (SELECT conv_id * 10000 + turn AS id, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id * 10000 + turn) AS k, {ASCII} AS text FROM conversations), w AS (SELECT id, conv_id, turn, k, list_distinct({STEMMED}) AS s FROM t), n AS (SELECT count(*) AS n FROM t),
q AS (SELECT query_id, raw, list_distinct(list_transform(terms, lambda x: x)) AS u, terms, list_transform(terms, lambda x: {stem_sql('x')}) AS st FROM {TELLING}), qs AS (SELECT *, list_distinct(st) AS ds FROM q),
h AS (SELECT query_id, id, conv_id, turn, k, list_intersect(ds, s) AS got FROM qs, w),
v AS (SELECT query_id, id, got, list_distinct(list_concat(list_concat(got, CASE WHEN turn - lag(turn) OVER o <= 1 THEN lag(got) OVER o ELSE [] END), CASE WHEN lead(turn) OVER o - turn <= 1 THEN lead(got) OVER o ELSE [] END)) AS win FROM h WINDOW o AS (PARTITION BY query_id, conv_id ORDER BY k)),
j AS (SELECT query_id, max(len(win)) AS k FROM v GROUP BY query_id), df AS (SELECT query_id, stem, count(*) AS df FROM (SELECT query_id, unnest(got) AS stem FROM h) GROUP BY ALL),
p AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY len(got) DESC, id) AS rank FROM h WHERE len(got) > 0), pk AS (SELECT * FROM p WHERE rank <= 5), fr AS (SELECT query_id, stem, min(rank) AS rank FROM (SELECT query_id, rank, unnest(got) AS stem FROM pk JOIN h USING (query_id, id)) GROUP BY ALL),
e AS (SELECT query_id, term, {stem_sql('term')} AS stem, pos FROM (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM q)),
a AS (SELECT e.*, coalesce(df, 0) AS df, rank FROM e LEFT JOIN df USING (query_id, stem) LEFT JOIN fr USING (query_id, stem)),
pool0 AS (SELECT *, df <= greatest(3, (SELECT n FROM n) * 0.4) AS rare, bool_or(df <= greatest(3, (SELECT n FROM n) * 0.4)) OVER (PARTITION BY query_id) AS any_rare FROM a WHERE df >= 1 AND rank IS NOT NULL), pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df, rank, -length(term), pos) AS o FROM pool0 WHERE rare OR NOT any_rare),
sh AS (SELECT DISTINCT query_id, x AS stem, y AS other FROM (SELECT query_id, x, unnest(win) AS y FROM (SELECT query_id, win, unnest(win) AS x FROM v))),
f1 AS (SELECT * FROM pool WHERE o = 1), f2 AS (SELECT query_id, min_by(stem, o) AS stem FROM pool WHERE rank = 1 GROUP BY query_id),
pr AS (SELECT f1.query_id, CASE WHEN f1.rank > 1 AND f2.stem IS NOT NULL AND f2.stem <> f1.stem AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.query_id = f1.query_id AND sh.stem = f1.stem AND sh.other = f2.stem) THEN f2.stem ELSE f1.stem END AS one FROM f1 LEFT JOIN f2 USING (query_id)),
se AS (SELECT pr.query_id, min_by(pool.stem, pool.o) AS two FROM pr JOIN pool USING (query_id) JOIN sh ON sh.query_id = pr.query_id AND sh.stem = pr.one AND sh.other = pool.stem WHERE pool.stem <> pr.one GROUP BY pr.query_id),
pa AS (SELECT pr.query_id, one, CASE WHEN len(ds) >= 3 AND (SELECT count(*) FROM pool WHERE pool.query_id = pr.query_id) >= 2 THEN two END AS two FROM pr JOIN qs USING (query_id) LEFT JOIN se USING (query_id)),
ul AS (SELECT a.query_id, count(DISTINCT a.stem) AS n FROM a JOIN pa USING (query_id) WHERE length(term) >= 4 AND df >= 1 AND a.stem <> one AND a.stem IS DISTINCT FROM two AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.query_id = a.query_id AND sh.stem = a.stem AND (sh.other = one OR sh.other = two)) GROUP BY ALL),
g AS (SELECT query_id, count(DISTINCT stem) FILTER (df >= 1 AND rank IS NOT NULL) AS na, count(DISTINCT stem) FILTER (length(term) >= 4 AND df = 0) AS nu FROM a GROUP BY query_id),
z AS (SELECT qs.query_id, raw, len(ds) AS stems, coalesce(k, 0) / len(ds) AS joint, na, nu, coalesce(ul.n, 0) AS nl, CASE WHEN n.n >= 50 THEN least(3.5, log10(n.n / 25.0)) ELSE 0 END AS sc FROM qs JOIN j USING (query_id) JOIN g USING (query_id) LEFT JOIN ul USING (query_id), n)
SELECT query_id, round(joint, 4) AS joint, na AS anchors, nu AS unattested, nl AS unlinked, CASE WHEN stems >= 3 AND raw < 0.42 + 0.032 * sc AND ((na = 0 AND joint <= 0.25) OR (nu >= 2 AND joint <= 0.34)) THEN 'UNSUPPORTED' WHEN na >= 1 AND raw < 0.50 + 0.045 * sc AND joint < 0.65 AND (nu >= 1 OR nl >= 1) THEN 'UNATTESTED_ATTRIBUTE' ELSE 'GROUNDED' END AS status FROM z"""
)
def attribute_grounding(spark, sf_dir):
    """Questions against all turns; the five turns that hold most of a question's stems stand for its answer."""
    t, b = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "benchmark")
    turn = F.col("turn").cast("long")
    rows = t.select((F.col("conv_id") * 10_000 + turn).alias("id"), F.col("conv_id").alias("session_id"), turn.alias("first"), turn.alias("last"), ascii_text().alias("content"))
    own = F.filter(F.array_distinct(F.regexp_extract_all(F.lower(ascii_text()), F.lit("[a-z]{4,}"), F.lit(0))), lambda w: ~w.isin(*words.STOP_WORDS))
    asked = b.select(F.col("item_id").alias("query_id"), F.concat(F.slice(own, 1, 4), F.array(F.concat(F.lit("zyx"), "item_id"))).alias("terms"), (0.30 + F.col("item_id") % 5 / 20.0).alias("raw"))
    stems = asked.select("query_id", F.explode(F.array_distinct(F.transform("terms", words.stem))).alias("stem"))
    hits = rows.select("id", F.explode(words.stems(F.col("content"))).alias("stem")).join(stems, "stem").groupBy("query_id", "id").agg(F.count("*").alias("score"))
    packed = search.best(hits, "score", 5, "id")
    got = grounding.grounded(rows, asked, packed)
    kinds = lambda c: F.size(F.array_distinct(F.transform(c, words.stem))).cast("long").alias(c)
    return got.select("query_id", "joint", kinds("anchors"), kinds("unattested"), kinds("unlinked"), "status")


#: Each source's documents as the entries of an answer; what stands around them has a length of its own.
HEADS = "(SELECT source, 'what does ' || source || ' hold' AS query, CASE count(*) % 3 WHEN 0 THEN 400 WHEN 1 THEN 900 ELSE 2500 END AS budget, count(*) AS n, repeat('state of it. ', CAST(count(*) % 40 AS INT)) AS state, repeat('then this. ', CAST(count(*) % 20 AS INT)) AS timeline, repeat('a note. ', CAST(count(*) % 30 AS INT)) AS note FROM documents GROUP BY source)"


@query(
    f"""WITH h AS (SELECT * FROM {HEADS}), d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, '### [MEMORY] #' || doc_id || ' (Score: 50.0%)' || chr(10) || trim(left({ASCII}, 1 + doc_id % 400)) || chr(10) || chr(10) || '---' || chr(10) AS e FROM documents),
u AS (SELECT *, sum(CAST(ceil(length(e) / 4.0) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM d), p AS (SELECT u.* FROM u JOIN h USING (source) WHERE used <= budget),
c AS (SELECT h.*, coalesce(m, 0) AS m, sums FROM h LEFT JOIN (SELECT source, count(*) AS m, list_prepend(0, list(total ORDER BY k)) AS sums FROM (SELECT source, k, sum(length(e)) OVER (PARTITION BY source ORDER BY k) AS total FROM p) GROUP BY source) USING (source)),
x AS (SELECT *, length(state) + length('# Context for "' || query || '"' || chr(10) || '**Status**: SUPPORTED | **Items**: ' || ' / ' || n || chr(10) || chr(10)) + length(note) AS fixed FROM c),
t AS (SELECT *, CAST(ceil((fixed + length(CAST(m AS VARCHAR)) + length(timeline) + coalesce(sums[m + 1], 0)) / 4.0) AS BIGINT) > budget AND timeline <> '' AS late FROM x),
f AS (SELECT *, CASE WHEN late THEN 0 ELSE length(timeline) END AS tl FROM t),
g AS (SELECT *, CASE WHEN CAST(ceil((fixed + length(CAST(m AS VARCHAR)) + tl + coalesce(sums[m + 1], 0)) / 4.0) AS BIGINT) <= budget OR m <= 1 THEN m ELSE coalesce(list_max(list_filter(range(1, m + 1), lambda i: CAST(ceil((fixed + length(CAST(i AS VARCHAR)) + tl + sums[i + 1]) / 4.0) AS BIGINT) <= budget)), 1) END AS kept FROM f)
SELECT source, kept AS n_packed, CAST(ceil((fixed + length(CAST(kept AS VARCHAR)) + tl + coalesce(sums[kept + 1], 0)) / 4.0) AS BIGINT) AS tokens, late AS without_timeline, kept < m AS without_entries FROM g"""
)
def packed_answers(spark, sf_dir):
    """Every source as a question, its documents in order as entries; bodies of many lengths."""
    d = table(spark, sf_dir, "documents")
    n = F.count("*")
    heads = d.groupBy("source").agg(n.alias("n_candidates"), F.when(n % 3 == 0, 400).when(n % 3 == 1, 900).otherwise(2500).alias("budget"), (n % 40).cast("int").alias("a"), (n % 20).cast("int").alias("b"), (n % 30).cast("int").alias("c"))
    heads = heads.select("source", F.concat(F.lit("what does "), "source", F.lit(" hold")).alias("query"), "budget", F.lit("SUPPORTED").alias("epistemic_status"), "n_candidates", F.repeat(F.lit("state of it. "), F.col("a")).alias("state"), F.repeat(F.lit("then this. "), F.col("b")).alias("timeline"), F.repeat(F.lit("a note. "), F.col("c")).alias("status_text"), F.lit(None).cast("string").alias("badge"))
    body = F.substr(ascii_text(), F.lit(1), (1 + F.col("doc_id") % 400).cast("int"))
    items = d.select("source", F.col("doc_id").alias("rank"), F.lit("memory").alias("kind"), F.concat(F.lit("#"), "doc_id").alias("title"), body.alias("content"), F.lit(0.5).alias("score")).join(heads.select("source", F.col("budget").cast("long").alias("room")), "source")
    got = payload.assembled(payload.entries(items, by="source"), heads, by="source")
    return got.select("source", "n_packed", "tokens", F.array_contains("shed", "timeline").alias("without_timeline"), F.array_contains("shed", "entries").alias("without_entries"))
