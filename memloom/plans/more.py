"""More queries over the driver's tables and small fixtures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text, vectors, words
from ..operators import anchoring, blame, candidates, conflicts, consolidate, diffs, episodes, fusion, graph, lineage, nuggets, ranking, relevance, report, rollups, rules, scoring, search
from ..sources import imports, staging, tables
from ..sources.tables import memories, table, turns
from . import fixtures as fx
from .queries import BM25, QUERIES, SQL, STEMMED, diff_of, query, stem_sql  # noqa: F401


def values(spark, fixture: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {fixture}")


def sql_values(fixture: str) -> str:
    return fixture.replace("STRING", "VARCHAR")


# Tables whose rows carry the cue words of the fixtures: each row of a given table takes the fixture's line that its id names.
# Signs beyond ASCII become blanks, as word boundaries at other letters differ between the two engines.
ASCII = "regexp_replace(coalesce(text, ''), '[^ -~]+', ' ', 'g')"
ASKED = f"(SELECT conv_id * 10000 + turn AS query_id, query || ' ' || left({ASCII}, 120) AS query FROM conversations JOIN {sql_values(fx.QUESTIONS).replace('q(query_id', 'q(k')} ON k = (conv_id + turn) % 9 + 1)"
SPOKEN = f"(SELECT conv_id * 10000 + turn AS id, category, content || ' ' || {ASCII} AS content FROM conversations JOIN {sql_values(fx.TURNS).replace('t(id', 't(k')} ON k = (conv_id + turn) % 9 + 1)"
PLACED = f"(SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN path ELSE 'p' || page_id || '/' || path END AS path FROM pages JOIN {sql_values(fx.PATHS).replace('p(id', 'p(k')} ON k = page_id % 18 + 1)"
CHANGED = """(SELECT user_id * 100 + event_id % 7 AS id, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN 'delete' WHEN event_id % 11 = 0 THEN 'supersede' WHEN event_id % 9 = 0 THEN 'invalidate' WHEN event_id % 2 = 0 THEN 'update' ELSE 'insert' END AS op,
CASE WHEN event_id % 13 <> 0 AND event_id % 11 <> 0 AND event_id % 9 <> 0 THEN event_type || ' ' || event_id END AS content, CASE WHEN event_id % 13 <> 0 AND event_id % 11 = 0 THEN user_id * 100 END AS target FROM events)"""
NOTED = """(SELECT CASE WHEN event_id % 19 = 0 THEN '' ELSE 'key ' || user_id || ' ' || event_type END AS key, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'forget' ELSE 'set' END AS op, CASE WHEN event_id % 5 <> 0 THEN 'value ' || event_id END AS value,
CASE WHEN event_id % 5 <> 0 THEN CASE event_id % 4 WHEN 0 THEN 'project' WHEN 1 THEN 'user' WHEN 2 THEN 'agent' ELSE 'nonsense' END END AS kind FROM events)"""
BLAMED = f"(SELECT doc_id % 40 AS f, doc_id // 40 + 1 AS line, CASE WHEN doc_id % 7 = 3 THEN repeat('0', 40) ELSE md5(CAST(doc_id // 160 AS VARCHAR)) || '00000000' END AS sha, CASE WHEN doc_id % 7 = 3 THEN 'Not Committed Yet' ELSE CASE (doc_id // 160) % 4 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'docs(x): ' WHEN 2 THEN 'chore: ' ELSE 'plain ' END || source || ' (#' || doc_id // 160 || ')' END AS summary FROM documents)"


def ascii_text(c: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^ -~]+", " ")


def asked(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("k", ((F.col("conv_id") + F.col("turn")) % 9 + 1).cast("int"))
    q = values(spark, fx.QUESTIONS).withColumnRenamed("query_id", "k")
    return t.join(q, "k").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("query_id"), F.concat("query", F.lit(" "), F.substring(ascii_text(), 1, 120)).alias("query"))


def spoken(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("k", ((F.col("conv_id") + F.col("turn")) % 9 + 1).cast("int"))
    told = values(spark, fx.TURNS).withColumnRenamed("id", "k")
    return t.join(told, "k").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), "category", F.concat("content", F.lit(" "), ascii_text()).alias("content"))


def placed(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("k", (F.col("page_id") % 18 + 1).cast("int")).join(values(spark, fx.PATHS).withColumnRenamed("id", "k"), "k")
    return p.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("p"), "page_id", F.lit("/"), "path")).alias("path"))


def changed(spark, sf_dir) -> DataFrame:
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    op = F.when(i % 13 == 0, "delete").when(i % 11 == 0, "supersede").when(i % 9 == 0, "invalidate").when(i % 2 == 0, "update").otherwise("insert")
    return e.select((u * 100 + i % 7).alias("id"), i.alias("seq"), op.alias("op"), F.when(op.isin("update", "insert"), F.concat_ws(" ", "event_type", i.cast("string"))).alias("content"), F.when(op == "supersede", u * 100).alias("target"))


def noted(spark, sf_dir) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(i % 4 == 0, "project").when(i % 4 == 1, "user").when(i % 4 == 2, "agent").otherwise("nonsense")
    told = i % 5 != 0
    key = F.when(i % 19 == 0, "").otherwise(F.concat_ws(" ", F.lit("key"), F.col("user_id").cast("string"), "event_type"))
    return e.select(key.alias("key"), i.alias("seq"), F.when(told, "set").otherwise("forget").alias("op"), F.when(told, F.concat(F.lit("value "), i)).alias("value"), F.when(told, kind).alias("kind"))


def lists(words_: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words_) + "]"


# Scans, lookups, merges.


@query("SELECT event_id AS id, ts AS created_at, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 250")
def newest_events(spark, sf_dir):
    return candidates.newest(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type"))


@query("SELECT doc_id AS id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def rows_by_id(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return candidates.by_ids(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang"), ids)


@query("SELECT page_id AS id, url AS file FROM pages WHERE contains(lower(url), '/1') OR contains(lower(url), 'page2') ORDER BY page_id DESC LIMIT 24")
def rows_by_file_name(spark, sf_dir):
    return candidates.by_file_names(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("file")), ["/1", "PAGE2"])


@query(
    """WITH e AS (SELECT event_id AS id, user_id % 7 AS k, ts, CASE WHEN event_id % 3 = 0 THEN 'invariant' ELSE 'lesson' END AS category FROM events)
SELECT id, category, ts AS touched FROM e WHERE ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY ORDER BY (category = 'invariant')::INT, ts, id LIMIT 30"""
)
def stale_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "invariant").otherwise("lesson").alias("category"), F.col("ts").alias("created_at"))
    e = e.withColumns({c: F.lit(None).cast("timestamp") for c in ("last_accessed_at", "updated_at")})
    return candidates.stale(e, F.lit("2024-01-31 00:00:00").cast("timestamp"), days=10).select("id", "category", "touched")


@query(
    """WITH f AS (SELECT text AS content, 0.5::DOUBLE AS score FROM documents WHERE doc_id % 2 = 0), r AS (SELECT CASE WHEN doc_id % 3 = 0 THEN '  ' || text ELSE text END AS content, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 11) / 10.0 END::DOUBLE AS score FROM documents),
n AS (SELECT lower(trim(content)) AS k, greatest(0.55, least(0.95, coalesce(score, 0.72))) AS score, content FROM r WHERE trim(coalesce(content, '')) <> '' AND lower(trim(content)) NOT IN (SELECT lower(trim(content)) FROM f WHERE content IS NOT NULL)),
o AS (SELECT score, sha256(k) AS mark FROM (SELECT k, max(score) AS score FROM n GROUP BY k)) SELECT mark, round(score, 6) AS score, 'remote' AS origin FROM o UNION ALL SELECT sha256(lower(trim(coalesce(content, '')))), score, 'own' FROM f"""
)
def merged_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    own = d.where("doc_id % 2 = 0").select(F.col("text").alias("content"), F.lit(0.5).alias("score"))
    remote = d.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), "text")).otherwise(F.col("text")).alias("content"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 11) / 10).alias("score"))
    out = candidates.merge_chunks(own, remote)
    return out.select(F.sha2(F.lower(F.trim(F.coalesce("content", F.lit("")))), 256).alias("mark"), F.round("score", 6).alias("score"), F.when(F.col("score") == 0.5, "own").otherwise("remote").alias("origin"))


@query("SELECT conv_id AS conversation_id, 0 AS session, lower(trim(role)) AS role, text AS content FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def flattened_chats(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    one = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    nested = one.select(F.col("conv_id").alias("conversation_id"), F.array("m").alias("chat"))
    return imports.flatten_chats(nested).select("conversation_id", "session", "role", "content")


@query("SELECT doc_id AS id, lang AS category, NULL::TIMESTAMP AS created_at FROM documents")
def evolved_rows(spark, sf_dir):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("category", T.StringType()), T.StructField("created_at", T.TimestampType())])
    return imports.evolved(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), "n_chars"), schema)


@query(
    """WITH l AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id END AS remote_id, source || ' ' || lang AS content, doc_id % 3 <> 0 AS synced FROM documents WHERE lang <> 'fr'),
r AS (SELECT 'r' || doc_id AS remote_id, 'new ' || source || ' ' || lang AS content, doc_id FROM documents WHERE lang <> 'es' ORDER BY doc_id DESC LIMIT 500),
k AS (SELECT l.id, l.remote_id, CASE WHEN r.content IS NOT NULL AND l.synced THEN r.content ELSE l.content END AS content FROM l LEFT JOIN r USING (remote_id))
SELECT * FROM k UNION ALL SELECT NULL, remote_id, content FROM r WHERE remote_id NOT IN (SELECT remote_id FROM l WHERE remote_id IS NOT NULL) AND content NOT IN (SELECT content FROM l WHERE content IS NOT NULL)"""
)
def pulled_rows(spark, sf_dir):
    """The local copy lacks one language and the remote copy another."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    own = d.where("lang != 'fr'").select(i.alias("id"), F.when(i % 2 == 0, F.concat(F.lit("r"), i)).alias("remote_id"), F.concat_ws(" ", "source", "lang").alias("content"), F.lit("ACTIVE").alias("status"), (i % 3 != 0).alias("synced"))
    remote = d.where("lang != 'es'").select(F.concat(F.lit("r"), i).alias("remote_id"), F.concat_ws(" ", F.lit("new"), "source", "lang").alias("content"), F.lit("ACTIVE").alias("status"), i.alias("created_at"))
    return imports.pulled(own, remote).select("id", "remote_id", "content")


@query(
    """SELECT vec_id AS id, CASE WHEN len(embedding) = 64 AND vec_id % 4 <> 0 THEN list_transform(embedding[1:2], lambda x: round(x::DOUBLE, 5)) END AS head FROM embeddings"""
)
def vector_dimensions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 4 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    out = imports.new_dimension(e, 64).withColumn("embedding", tables.decode_vector(tables.encode_vector("embedding")))
    return out.select("id", F.transform(F.slice("embedding", 1, 2), lambda x: vectors.rounded(x.cast("double"), 5)).alias("head"))


# Text.


def flags_sql() -> str:
    q = "regexp_matches(coalesce(query, ''), '(?i)' || '{}')"
    hit = {k: q.format(p.replace("'", "''")) for k, p in text.INTENTS.items()}
    advice = f"NOT {hit['update']} AND NOT {hit['sequence']} AND NOT {q.format(text.RECALL.replace(chr(39), chr(39) * 2))} AND regexp_matches(ltrim(coalesce(query, '')), '(?i)' || '{text.ADVICE}')"
    return ", ".join(f"{v} AS {k}" for k, v in (hit | {"advisory": advice}).items())


@query(f"SELECT query_id, {flags_sql()} FROM (SELECT query_id, query FROM {sql_values(fx.QUESTIONS)} UNION ALL SELECT 1000 + item_id, text FROM benchmark)")
def query_intents(spark, sf_dir):
    q = values(spark, fx.QUESTIONS).unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), F.col("text").alias("query")))
    flags = text.intents(F.col("query"))
    return q.select("query_id", *[v.alias(k) for k, v in flags.items()])


CLEANED = "query"
for _p in text.FILLERS:
    CLEANED = f"regexp_replace({CLEANED}, '{_p}', '', 'gi')"


@query(f"WITH c AS (SELECT query_id, query, trim(regexp_replace({CLEANED}, '\\s+', ' ', 'g')) AS clean FROM {ASKED}) SELECT query_id, CASE WHEN clean = '' THEN query ELSE clean END AS clean FROM c")
def cleaned_questions(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", text.clean_query(F.col("query")).alias("clean"))


@query(
    f"""WITH q AS (SELECT query_id, list_filter(regexp_split_to_array(lower(query), '[^a-z0-9_.-]+'), lambda w: length(w) >= 3 AND NOT list_contains({lists(words.STOP_WORDS)}, w) AND NOT list_contains({lists(words.META_WORDS)}, w)) AS w FROM {ASKED} WHERE query IS NOT NULL),
s AS (SELECT query_id, w FROM q UNION ALL SELECT query_id, list_transform(w, lambda x: {stem_sql("x")}) FROM q),
p AS (SELECT query_id, w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT query_id, w, unnest(range(1, len(w))) AS i FROM s) UNION SELECT query_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT query_id, w, unnest(range(1, len(w) - 1)) AS i FROM s))
SELECT query_id, phrase FROM p"""
)
def query_phrases(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", F.explode(text.phrases(F.col("query"))).alias("phrase"))


STRIPPED = "coalesce(content, '')"
for _p, _by in text.CITATIONS:
    STRIPPED = f"regexp_replace({STRIPPED}, '{_p}', '{_by}', 'gi')"
STRIPPED = f"trim(regexp_replace({STRIPPED}, '\\s+', ' ', 'g'))"


@query(
    f"""SELECT id, try_cast(coalesce(nullif(regexp_extract(content, '(?i)^\\[[^\\]]*\\bSession[\\s_-]*(\\d+)\\b[^\\]]*\\]', 1), ''), nullif(regexp_extract(content, '(?i)\\[[^\\]]*\\bSession[\\s_-]*(\\d+)\\b[^\\]]*\\]', 1), '')) AS BIGINT) AS session_id,
try_cast(nullif(regexp_extract(content, '(?i)\\bTurn\\s*#\\s*(\\d+)', 1), '') AS BIGINT) AS turn, CASE WHEN NOT regexp_matches(coalesce(trim(regexp_extract(regexp_extract(content, '^\\[([^\\]]+)\\]', 1), '(?i)\\bDate:\\s*([^|\\]]+)', 1)), ''), '(?i)^session\\s+\\d+$') THEN nullif(trim(regexp_extract(regexp_extract(content, '^\\[([^\\]]+)\\]', 1), '(?i)\\bDate:\\s*([^|\\]]+)', 1)), '') END AS date_label,
{STRIPPED} AS body, coalesce(regexp_matches(content, '(?i){text.DIRECTIVE.replace("'", "''")}'), false) AS directive, coalesce(regexp_matches(content, '(?i){text.TRANSITION.replace("'", "''")}'), false) AS transition FROM {SPOKEN}"""
)
def dialogue_headers(spark, sf_dir):
    t = spoken(spark, sf_dir)
    c, no = F.col("content"), F.lit(False)
    return t.select("id", text.session(c).alias("session_id"), text.turn_span(c)["first"].alias("turn"), text.date_label(c).alias("date_label"), text.strip_citations(c).alias("body"), F.coalesce(text.directive(c), no).alias("directive"), F.coalesce(text.transition(c), no).alias("transition"))


@query(
    f"""WITH c AS (SELECT doc_id, {ASCII} AS t FROM documents),
m AS (SELECT doc_id, list_concat(list_concat(list_filter(list_transform(regexp_extract_all(t, '{text.TAG_PATTERNS[0]}'), lambda w: lower(w)), lambda w: length(w) >= 3), list_transform(regexp_extract_all(t, '{text.TAG_PATTERNS[1]}'), lambda w: lower(w))), regexp_extract_all(lower(t), '{text.TAG_PATTERNS[2]}')) AS a FROM c),
f AS (SELECT doc_id, list_filter(a, lambda w: NOT list_contains({lists(text.TAG_STOP_WORDS)}, w)) AS a FROM m)
SELECT doc_id AS id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:5], ' ') AS tags FROM f"""
)
def heuristic_tags(spark, sf_dir):
    d = memories(spark, sf_dir).withColumn("content", ascii_text("content"))
    return d.select("id", F.array_join(text.heuristic_tags(F.col("content")), " ").alias("tags"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT *, greatest(1, CAST(ceil((length(t) - 1800) / 1550.0) AS BIGINT) + 1) AS n FROM d),
w AS (SELECT doc_id, i, n, CASE WHEN length(t) <= 2000 THEN t WHEN i = 7 AND n > 8 THEN substr(t, length(t) - 1800 + 1, 1800) ELSE substr(t, i * 1550 + 1, 1800) END AS c, t FROM (SELECT *, unnest(range(0, CASE WHEN length(t) <= 2000 THEN 1 ELSE least(n, 8) END)) AS i FROM n))
SELECT doc_id AS id, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS chars, max(sha256(c)) AS mark FROM w WHERE length(t) <= 2000 OR trim(c) <> '' GROUP BY doc_id"""
)
def chunk_windows(spark, sf_dir):
    c = memories(spark, sf_dir).select("id", F.explode(text.chunks(F.col("content"))).alias("c"))
    return c.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("c")).alias("chars"), F.max(F.sha2("c", 256)).alias("mark"))


@query(
    """SELECT id, sensitive, prose, clean FROM (SELECT id, path, coalesce(list_contains(['credentials.json', 'id_ed25519', 'id_ecdsa', 'id_dsa', '.env'], b) OR (starts_with(b, '.env.') AND NOT regexp_matches(b, '\\.(example|sample|template|schema|dist)$')) OR starts_with(b, 'id_rsa') OR suffix(b, '.pem') OR suffix(b, '.key'), true) AS sensitive,
coalesce(regexp_matches(b, '\\.(md|mdx|markdown|txt|rst|adoc)$') OR b IN ('package-lock.json', 'uv.lock') OR suffix(b, '.lock') OR regexp_matches(b, '^(readme|licen[sc]e|changelog)$') OR (regexp_matches(b, '^(readme|licen[sc]e|changelog)([-.].+)?$') AND NOT regexp_matches(b, '\\.[a-z][a-z0-9]*$')), true) AS prose,
CASE WHEN path NOT IN ('/dev/null') AND NOT regexp_matches('/' || r || '/', '/(\\.|\\.\\.|)/') THEN r END AS clean FROM (SELECT *, lower(split_part(path, '/', -1)) AS b, regexp_replace(regexp_replace(regexp_replace(path, '^[ab]/', ''), '^(\\./)+', ''), '^/+', '') AS r FROM """
    + PLACED
    + "))"
)
def path_checks(spark, sf_dir):
    p = placed(spark, sf_dir)
    return p.select("id", paths.sensitive(F.col("path")).alias("sensitive"), paths.prose_or_generated(F.col("path")).alias("prose"), paths.relative(F.col("path")).alias("clean"))


@query(
    """WITH p AS (SELECT id, coalesce(path, '') AS path, CASE WHEN id % 3 = 0 THEN 'about Loom and projects/other' WHEN id % 3 = 1 THEN 'see projects/other/x' ELSE 'nothing' END AS t FROM """
    + PLACED
    + """), s AS (SELECT *, lower(regexp_extract(regexp_replace(path, '^\\./', ''), '(?i)^projects/([^/]+)/', 1)) AS sib FROM p)
SELECT id, CASE WHEN sib <> '' THEN CASE WHEN sib = 'loom' THEN 3 ELSE 0 END WHEN regexp_matches(regexp_replace(path, '^\\./', ''), '(?i)^(src|bin|tests|benchmarks|db|docs|templates|scripts)/') THEN 3 WHEN contains(lower(t), 'loom') THEN 2 WHEN contains(t, 'projects/other') THEN 0 ELSE 1 END AS affinity,
NOT (sib <> '' AND sib <> 'loom') AND (contains(lower(t), 'loom') OR NOT contains(t, 'projects/other')) AS in_scope FROM s"""
)
def project_affinity(spark, sf_dir):
    t = F.when(F.col("id") % 3 == 0, "about Loom and projects/other").when(F.col("id") % 3 == 1, "see projects/other/x").otherwise("nothing")
    return placed(spark, sf_dir).withColumn("t", t).select("id", paths.affinity(F.col("path"), F.col("t"), "loom").cast("int").alias("affinity"), paths.in_scope(F.col("path"), F.col("t"), "loom").alias("in_scope"))


@query(
    """WITH p AS (SELECT page_id, '# ' || url || chr(10) || replace(html, '<', chr(10) || '<') AS t, '<h1>' AS q FROM pages), a AS (SELECT *, instr(t, q) AS pos FROM p)
SELECT page_id AS id, CASE WHEN pos > 0 THEN pos - 1 END AS char_start, CASE WHEN pos > 0 THEN length(substr(t, 1, pos - 1)) - length(replace(substr(t, 1, pos - 1), chr(10), '')) + 1 END AS start_line, pos = 0 AS is_drifted,
'p' || page_id || '.html' || CASE WHEN pos > 0 THEN '#L' || CAST(length(substr(t, 1, pos - 1)) - length(replace(substr(t, 1, pos - 1), chr(10), '')) + 1 AS VARCHAR) ELSE '' END || ' [head]' AS citation FROM a"""
)
def anchored_quotes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    files = p.select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.concat(F.lit("# "), "url", F.lit("\n"), F.replace("html", F.lit("<"), F.lit("\n<"))).alias("text"))
    rows = p.select(F.col("page_id").alias("id"), F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("file"), F.lit("<h1>").alias("quote"), F.lit("head").alias("locator"))
    return anchoring.anchored(rows, files).select("id", F.col("char_start").cast("int").alias("char_start"), "start_line", "is_drifted", "citation")


@query(
    """WITH p AS (SELECT page_id, url, html FROM pages), r AS (SELECT page_id AS id, page_id % 4 AS k, url AS quote FROM p)
SELECT id, k IN (0, 1, 2) AS is_drifted, CASE k WHEN 0 THEN 'file_missing' WHEN 1 THEN 'quoted_span_mutated' WHEN 2 THEN 'file_hash_mutated' END AS drift_reason, k = 3 AS healed FROM r"""
)
def drifted_rows(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % 4)
    name = F.concat(F.lit("f"), "page_id")
    files = p.where("k != 0").select(name.alias("path"), F.concat(F.lit("head\n"), F.when(F.col("k") == 1, F.lit("other")).otherwise(F.col("url"))).alias("text"))
    rows = p.select(F.col("page_id").alias("id"), name.alias("file"), F.when(F.col("k") != 2, F.col("url")).alias("quote"), F.lit("0000").alias("anchor_hash"), F.lit(False).alias("is_drifted"), F.lit(None).cast("string").alias("drift_reason"))
    return anchoring.drifted(rows, files).select("id", "is_drifted", "drift_reason", "healed")


@query(
    """WITH p AS (SELECT page_id, url FROM pages WHERE page_id % 5 <> 0) SELECT page_id AS id, 'moved/' || page_id || '/f.txt' AS path, 2 AS start_line, 'moved/' || page_id || '/f.txt#L2' AS citation, 1 AS candidate_count FROM p"""
)
def relocated_quotes(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    quote = F.concat(F.lit("the page "), "url", F.lit(" moved to folder number "), "page_id", F.lit(" today"))
    files = p.where("page_id % 5 != 0").select(F.concat(F.lit("moved/"), "page_id", F.lit("/f.txt")).alias("path"), F.concat(F.lit("first line\nwe note "), quote, F.lit(".\nlast")).alias("text"))
    rows = p.select(F.col("page_id").alias("id"), F.concat(F.lit("old/"), "page_id", F.lit(".txt")).alias("file"), quote.alias("quote"))
    return anchoring.relocated(rows, files).select("id", "path", "start_line", "citation", F.col("candidate_count").cast("int").alias("candidate_count"))


# Chains, conflicts, state.


@query(
    """WITH RECURSIVE e AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 4 AND doc_id < (SELECT max(doc_id) FROM documents) THEN doc_id + 1 END AS nxt FROM documents),
w AS (SELECT id AS root, id AS here, 1 AS step FROM e WHERE id % 5 = 0 UNION ALL SELECT root, e.nxt, step + 1 FROM w JOIN e ON e.id = here WHERE e.nxt IS NOT NULL AND step <= 8)
SELECT e.id, w.step, w.here AS step_id FROM e JOIN w ON w.root = e.id - e.id % 5"""
)
def lineage_histories(spark, sf_dir):
    rows = memories(spark, sf_dir).select("id")
    last = rows.agg(F.max("id").alias("last"))  # one row
    linked = rows.join(F.broadcast(last)).withColumn("next", F.when((F.col("id") % 5 != 4) & (F.col("id") < F.col("last")), F.col("id") + 1))
    # Every other link is known from one side alone.
    both = linked.select("id", F.when(F.col("id") % 2 == 0, F.col("next")).alias("superseded_by"), F.when((F.col("id") % 5 != 0) & (F.col("id") % 2 == 0), F.col("id") - 1).alias("supersedes_id"), F.lit("ACTIVE").alias("status"))
    return lineage.histories(both).select("id", "step", "step_id")


@query(
    f"""WITH c AS (SELECT * FROM {CHANGED}), l AS (SELECT id, max_by(op, seq) AS op FROM c GROUP BY id)
SELECT l.id, (SELECT max_by(content, seq) FROM c WHERE c.id = l.id AND op IN ('insert', 'update')) AS content, CASE op WHEN 'supersede' THEN 'SUPERSEDED' WHEN 'invalidate' THEN 'INVALIDATED' ELSE 'ACTIVE' END AS status, (SELECT max_by(target, seq) FROM c WHERE c.id = l.id AND op = 'supersede') AS superseded_by FROM l WHERE op <> 'delete'"""
)
def folded_state(spark, sf_dir):
    return lineage.current(changed(spark, sf_dir))


@query(
    """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_max(embedding) - list_min(embedding) >= 1e-9)
SELECT b.id, max(a.id) AS superseded_by FROM e a JOIN e b ON a.id < b.id AND 1 - list_cosine_similarity(a.v, b.v) <= 0.15 GROUP BY b.id"""
)
def consolidated_rows(spark, sf_dir):
    return consolidate.consolidation(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


# Ranking.


RANKED = BM25 + ", c AS (SELECT item_id, doc_id, score, rank, doc_id % 9 AS session_id FROM r WHERE rank <= 50)"


def ranked(spark, sf_dir, k=50):
    found = search.bm25(memories(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=k, query_key="item_id", query_text="text")
    return found.withColumn("session_id", F.col("id") % 9)


@query(RANKED + "SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY nth, rank) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY item_id, session_id ORDER BY rank) AS nth FROM c)")
def round_robin_order(spark, sf_dir):
    return ranking.round_robin(ranked(spark, sf_dir)).select("query_id", "id", "turn")


@query(RANKED + ", ns AS (SELECT item_id, session_id, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT item_id, max(n) AS n FROM ns GROUP BY item_id) SELECT item_id AS query_id, max(session_id) AS session_id, n FROM ns JOIN m USING (item_id, n) GROUP BY item_id, n HAVING count(*) = 1")
def plurality_session(spark, sf_dir):
    return candidates.plurality_sessions(ranked(spark, sf_dir))


@query(RANKED + "SELECT item_id AS query_id, round(CASE WHEN count(*) >= 12 THEN min(score) - 0.002 ELSE 0.78 END, 5) AS ceiling FROM c WHERE rank <= 12 GROUP BY item_id")
def twelfth_score(spark, sf_dir):
    return candidates.nth_best(ranked(spark, sf_dir), 12).withColumn("ceiling", F.round("ceiling", 5))


@query(RANKED + "SELECT item_id AS query_id, doc_id AS id, round(0.035 * percent_rank() OVER (PARTITION BY item_id ORDER BY doc_id), 6) AS boost FROM c")
def progress_boost(spark, sf_dir):
    return candidates.progress(ranked(spark, sf_dir)).select("query_id", "id", F.round("boost", 6).alias("boost"))


ARMS = ", fa AS (SELECT *, ((doc_id * 37 + item_id) % 101) / 100.0 AS semantic, ((doc_id * 53 + item_id) % 97) / 96.0 AS idf, ((doc_id * 11 + item_id) % 89) / 88.0 AS usr, ((doc_id * 7 + item_id) % 61) / 60.0 AS span, 0.3 + ((doc_id * 29 + item_id) % 71) / 100.0 AS s FROM c)"


def with_arms(df):
    i, q = F.col("id"), F.col("query_id")
    share = lambda a, m, d: F.pmod(i * a + q, F.lit(m)) / d
    return df.drop("score", "rank").withColumns({"semantic": share(37, 101, 100.0), "idf": share(53, 97, 96.0), "user": share(11, 89, 88.0), "span": share(7, 61, 60.0), "score": 0.3 + share(29, 71, 100.0)})


@query(
    RANKED + ARMS + """, g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id DESC) AS r FROM fa),
h AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY semantic DESC, r) AS a, row_number() OVER (PARTITION BY item_id ORDER BY idf DESC, r) AS b, row_number() OVER (PARTITION BY item_id ORDER BY usr DESC, r) AS c FROM g)
SELECT item_id AS query_id, doc_id AS id, r AS rank FROM h WHERE r <= 160 OR a <= 24 OR b <= 24 OR c <= 28"""
)
def candidate_pool(spark, sf_dir):
    return candidates.pool(with_arms(ranked(spark, sf_dir)).withColumn("unclamped", F.col("score"))).select("query_id", "id", "rank")


@query(
    RANKED + ARMS + """, a AS (SELECT *, 'x' AS one, CASE WHEN semantic > 1e-6 THEN row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN semantic > 1e-6 THEN round(semantic, 9) END DESC NULLS LAST, doc_id) END AS r1, CASE WHEN usr > 1e-6 THEN row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN usr > 1e-6 THEN round(usr, 9) END DESC NULLS LAST, doc_id) END AS r2,
CASE WHEN idf > 1e-6 THEN row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN idf > 1e-6 THEN round(idf, 9) END DESC NULLS LAST, doc_id) END AS r3, CASE WHEN span > 1e-6 THEN row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN span > 1e-6 THEN round(span, 9) END DESC NULLS LAST, doc_id) END AS r4 FROM fa),
z AS (SELECT *, least(1, (coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0) + coalesce(1.0 / (60 + r3), 0) + coalesce(1.0 / (60 + r4), 0)) / ((max((r1 IS NOT NULL)::INT) OVER w + max((r2 IS NOT NULL)::INT) OVER w + max((r3 IS NOT NULL)::INT) OVER w + max((r4 IS NOT NULL)::INT) OVER w) / 61.0)) AS rrf,
0.5 * (tanh((semantic - avg(semantic) OVER w) / (2 * greatest(0.04, stddev_pop(semantic) OVER w))) + 1) AS zs, 0.5 * (tanh((idf - avg(idf) OVER w) / (2 * greatest(0.04, stddev_pop(idf) OVER w))) + 1) AS zi, 0.5 * (tanh((span - avg(span) OVER w) / (2 * greatest(0.04, stddev_pop(span) OVER w))) + 1) AS zp FROM a WINDOW w AS (PARTITION BY item_id)),
u AS (SELECT *, 0.26 * rrf + 0.22 * zs + 0.16 * zi + 0.20 * (0.68 * span + 0.32 * zp) + 0.12 * sqrt(semantic * greatest(idf, span, usr)) + 0.04 * (doc_id % 2) * 0.35 AS fused FROM z),
v AS (SELECT *, coalesce(max(CASE WHEN s >= 0.46 AND doc_id % 13 <> 0 THEN fused END) OVER (PARTITION BY item_id), 0) AS top, count(*) OVER (PARTITION BY item_id) AS n FROM u),
k AS (SELECT *, greatest(0, top - fused) AS gap, least(0.082, greatest(-0.022, (fused - 0.46) * 0.16)) AS delta FROM v)
SELECT item_id AS query_id, doc_id AS id, round(fused, 5) AS fused, round(CASE WHEN s < 0.46 OR doc_id % 13 = 0 OR n < 2 THEN s ELSE greatest(0.46, least(0.995, s + delta) - CASE WHEN s >= 0.85 THEN least(0.045, gap * 0.11) ELSE 0 END) END, 5) AS score FROM k"""
)
def calibrated_fusion(spark, sf_dir):
    rows = with_arms(ranked(spark, sf_dir)).withColumns({"raw": F.col("semantic"), "unclamped": F.col("score"), "prior": (F.col("id") % 2) * 0.35, "neighbour": F.col("id") % 13 == 0, "transition": F.lit(False)})
    return fusion.calibrated(rows).select("query_id", "id", F.round("fused", 5).alias("fused"), F.round("score", 5).alias("score"))


TERMS = f"list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_.-]+'), lambda w: regexp_replace(w, '^[.-]+|[.-]+$', '', 'g')), lambda w: (length(w) > 2 OR regexp_matches(w, '[0-9]') OR list_contains({lists(words.TECH_TOKENS)}, w)) AND NOT list_contains({lists(words.STOP_WORDS)}, w))"


def minus(a: str, words_: list[str]) -> str:
    fewer = f"list_filter({a}, lambda w: NOT list_contains({lists(words_)}, w))"
    return f"CASE WHEN len({fewer}) > 0 THEN {fewer} ELSE {a} END"


HYBRID = (
    BM25
    + f""", b AS (SELECT item_id, doc_id FROM r WHERE rank <= 25), t1 AS (SELECT item_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a, lower(text) AS q FROM (SELECT item_id, text, {TERMS} AS a FROM benchmark)),
t2 AS (SELECT item_id, q, {minus("a", words.TEMPORAL_CUES)} AS a FROM t1), t3 AS (SELECT item_id, q, {minus("a", words.META_WORDS)} AS a FROM t2), t4 AS (SELECT item_id, q, a, {minus("a", words.GENERIC_WORDS)} AS sp FROM t3),
tt AS (SELECT item_id, q, a, list_transform(a, lambda w: {stem_sql("w")}) AS st, list_distinct(list_transform(sp, lambda w: {stem_sql("w")})) AS special FROM t4),
x AS (SELECT b.item_id, b.doc_id, q, a, st, special, lower(coalesce(text, '')) AS low, list_distinct({STEMMED}) AS stems FROM b JOIN documents USING (doc_id) JOIN tt USING (item_id)),
y AS (SELECT *, list_filter(a, lambda w, i: list_contains(stems, st[i]) OR contains(low, w)) AS hit, list_filter(list_distinct(st), lambda s: list_contains(stems, s) OR contains(low || ' ', s)) AS held FROM x),
df AS (SELECT item_id, s, count(*) AS df FROM (SELECT item_id, unnest(held) AS s FROM y) GROUP BY ALL), nn AS (SELECT item_id, count(*) AS n FROM y GROUP BY item_id),
wt AS (SELECT item_id, s, ln(1 + n / (1.0 + coalesce(df, 0))) AS w FROM (SELECT DISTINCT item_id, unnest(st) AS s FROM tt) JOIN nn USING (item_id) LEFT JOIN df USING (item_id, s)),
ov AS (SELECT item_id, doc_id, sum(w) AS got FROM (SELECT item_id, doc_id, unnest(held) AS s FROM y) JOIN wt USING (item_id, s) GROUP BY ALL), tot AS (SELECT item_id, sum(w) AS total FROM wt GROUP BY item_id),
z AS (SELECT y.*, coalesce(got, 0) / total AS idf, len(hit) / greatest(len(a), 1) AS share, len(list_filter(special, lambda s: list_contains(stems, s) OR list_contains(list_transform(hit, lambda w: {stem_sql("w")}), s))) AS dh FROM y JOIN tot USING (item_id) LEFT JOIN ov USING (item_id, doc_id))
SELECT item_id AS query_id, doc_id AS id, len(hit) AS hits, round(idf, 5) AS idf, round(CASE WHEN contains(low, q) THEN 0.92 WHEN len(hit) = 0 THEN 0 WHEN len(special) > 0 AND dh = 0 THEN 0 WHEN len(special) >= 4 AND dh = 1 THEN 0 WHEN len(a) >= 4 AND len(hit) = 1 AND share < 0.25 THEN 0 ELSE least(0.99, 0.50 + 0.42 * greatest(share, idf)) END, 5) AS score FROM z"""
)


@query(HYBRID)
def hybrid_scores(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = memories(spark, sf_dir)
    # A written table's size is known, so the few rows found go to the texts, not all texts to them; they are read three times.
    best = staging.staged(search.bm25(rows, q, k=25).select("query_id", "id"))
    found = staging.staged(best.join(rows.select("id", "content"), "id")).withColumn("tags", F.array().cast("array<string>"))
    scored = fusion.word_overlap(found, q).withColumns({"raw": F.lit(0.0), "semantic": F.lit(0.0)})
    scored = fusion.base_score(fusion.damped(scored.withColumn("dialogue", F.lit(False))))
    return scored.select("query_id", "id", "hits", F.round("idf", 5).alias("idf"), F.round("score", 5).alias("score"))


@query(
    BM25.replace("WITH q AS", "WITH RECURSIVE q AS")
    + """, c AS (SELECT item_id, doc_id, rank, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 2))) AS w FROM r JOIN documents USING (doc_id) WHERE rank <= 20),
g AS (SELECT item_id, rank, doc_id, [w] AS kept, true AS keep FROM c WHERE rank = 1 UNION ALL SELECT c.item_id, c.rank, c.doc_id, CASE WHEN same THEN kept ELSE list_append(kept, c.w) END, NOT same FROM
(SELECT c.*, g.kept, len(c.w) >= 1 AND len(list_filter(g.kept, lambda k: len(list_intersect(k, c.w)) > 0.88 * (len(k) + len(c.w) - len(list_intersect(k, c.w))))) > 0 AS same FROM g JOIN c ON c.item_id = g.item_id AND c.rank = g.rank + 1) c)
SELECT item_id AS query_id, doc_id AS id, rank FROM g WHERE keep"""
)
def suppressed_pools(spark, sf_dir):
    """The twenty best rows of each query without near-duplicates of better ones."""
    rows = memories(spark, sf_dir)
    best = search.bm25(rows, table(spark, sf_dir, "benchmark"), k=20, query_key="item_id", query_text="text")
    return ranking.suppress(best.join(rows.select("id", "content"), "id").select("query_id", "id", "rank", "content")).select("query_id", "id", "rank")


@query(
    f"""WITH q AS (SELECT query_id, unnest(a) AS term FROM (SELECT query_id, list_distinct(a) AS a FROM (SELECT query_id, {minus("a", words.GENERIC_WORDS)} AS a FROM (SELECT query_id, {minus("a", words.META_WORDS)} AS a FROM (SELECT query_id, {minus("a", words.TEMPORAL_CUES)} AS a FROM (SELECT query_id, {TERMS.replace("text", "query")} AS a FROM {ASKED} WHERE query IS NOT NULL)))))),
h AS (SELECT DISTINCT unnest({STEMMED.replace("text", "content")}) AS s FROM {SPOKEN})
SELECT query_id, term FROM q WHERE {stem_sql("term")} NOT IN (SELECT s FROM h)"""
)
def unattested_terms(spark, sf_dir):
    return candidates.unattested(asked(spark, sf_dir).where("query is not null"), spoken(spark, sf_dir))


# Rollups, vectors, nuggets, reports.


@query(
    """WITH t AS (SELECT conv_id * 10000 + turn AS id, conv_id AS session_id, text FROM conversations), p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 AS position FROM t)
SELECT session_id, CAST(position // 64 AS BIGINT) AS window_index, min(id) AS first, max(id) AS last, count(*) AS n, array_to_string(list(id ORDER BY id), ',') AS children FROM p GROUP BY ALL"""
)
def episode_windows(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("category", F.lit("lesson")).withColumn("project", F.lit("p"))
    r = rollups.build(rows)
    return r.select("session_id", "window_index", "first", "last", "n", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


INFORMATIVE = f"list_filter(list_transform(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9_]+'), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains({lists(rollups.EXCLUDED)}, w)), lambda w: {stem_sql('w')}), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains({lists(rollups.EXCLUDED)}, w))"


@query(
    f"""WITH t AS (SELECT conv_id * 10000 + turn AS id, conv_id AS session_id, {STRIPPED.replace("content", "regexp_replace(coalesce(text, ''), '^\\[[^\\]]+\\]\\s*', '')")} AS body0 FROM conversations),
b AS (SELECT id, session_id, CASE WHEN length(body0) <= 2400 THEN body0 ELSE substr(body0, 1, 1600) || ' ' || substr(body0, length(body0) - 799) END AS body, CASE WHEN regexp_matches(body0, '(?i){text.TRANSITION.replace("'", "''")}') THEN 1.25 ELSE 1.0 END * 1.5 AS w FROM t),
e AS (SELECT session_id, id, w, unnest({INFORMATIVE}) AS stem FROM b), d AS (SELECT stem, count(DISTINCT id) AS df FROM e GROUP BY stem),
f AS (SELECT session_id, stem, sum(w) * ln(1 + (SELECT count(*) FROM t) / (1.0 + any_value(df))) AS s FROM e JOIN d USING (stem) GROUP BY session_id, stem), g AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(s, 9) DESC, stem) AS p FROM f)
SELECT session_id, string_agg(stem, ' ' ORDER BY p) AS stems FROM g WHERE p <= 16 GROUP BY session_id"""
)
def window_top_stems(spark, sf_dir):
    rows = turns(spark, sf_dir).withColumn("project", F.lit("p"))
    return rollups.window_stems(rollups.turns(rows)).select("session_id", F.array_join("stems", " ").alias("stems"))


@query(
    f"""WITH s AS (SELECT conv_id AS session_id, {STEMMED} AS s FROM conversations), d AS (SELECT session_id, list_filter(flatten(list(s)), lambda x: length(x) >= 6) AS s0 FROM s GROUP BY session_id), d1 AS (SELECT session_id, list_transform(list_filter(s0, lambda x: length(x) >= 2), lambda x: {stem_sql("x")}) AS s FROM d), n AS (SELECT count(*) AS n, avg(len(s)) AS avgdl FROM d1),
q AS (SELECT item_id, unnest(s[1:14]) AS term FROM (SELECT item_id, list_filter(s, lambda x, i: list_position(s, x) = i) AS s FROM (SELECT item_id, {STEMMED} AS s FROM benchmark))),
p AS (SELECT term, session_id, len(s) AS dl, count(*) AS tf FROM (SELECT session_id, s, unnest(s) AS term FROM d1) WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
m AS (SELECT item_id, session_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY ALL),
w AS (SELECT item_id, term, ln(1 + n / (1.0 + coalesce(df, 0))) AS w FROM q LEFT JOIN f USING (term), n), t AS (SELECT item_id, sum(w) AS total FROM w GROUP BY item_id),
o AS (SELECT item_id, session_id, sum(w) / any_value(total) AS o FROM (SELECT DISTINCT term, session_id FROM p) JOIN w USING (term) JOIN t USING (item_id) GROUP BY item_id, session_id),
b AS (SELECT item_id, max(score) AS top FROM m GROUP BY item_id)
SELECT item_id AS query_id, session_id, round(least(0.99, least(1, greatest(o, 0.64 * o + 0.36 * score / top, 0.72 * score / top))), 4) AS score FROM m JOIN o USING (item_id, session_id) JOIN b USING (item_id)"""
)
def episode_search(spark, sf_dir):
    t = turns(spark, sf_dir).select("session_id", F.transform(words.tokens(F.coalesce("content", F.lit(""))), words.stem).alias("s"))
    r = t.groupBy("session_id").agg(F.filter(F.flatten(F.collect_list("s")), lambda x: F.length(x) >= 6).alias("stems")).withColumn("window_index", F.lit(0))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rollups.episode_scores(r, q).select("query_id", "session_id", F.round("score", 4).alias("score"))


@query(
    """WITH e AS (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE * (1 + label % 3) AS x FROM embeddings WHERE embedding IS NOT NULL AND list_max(embedding) - list_min(embedding) >= 1e-9),
s AS (SELECT label, i, sum(x) AS s, count(*) AS n FROM e GROUP BY ALL), z AS (SELECT label, sqrt(sum(s * s)) AS z FROM s GROUP BY label)
SELECT label, i AS place, round(s / z, 5) AS value, n FROM s JOIN z USING (label)"""
)
def weighted_centroids(spark, sf_dir):
    c = vectors.centroids(table(spark, sf_dir, "embeddings"), by="label", weight=1.0 + F.col("label") % 3)
    return c.select("label", "n", F.posexplode("centroid").alias("p", "value")).select("label", (F.col("p") + 1).cast("long").alias("place"), vectors.rounded(F.col("value"), 5).alias("value"), "n")


@query(
    """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS d FROM documents), r AS (SELECT doc_id, t, list_transform(range(0, 8), lambda i: CAST('0x' || substr(d, CAST(i % 16 AS INT) * 4 + 1, 4) AS INT) / 65535.0 * 2 - 1) AS v FROM h)
SELECT doc_id AS id, CASE WHEN t = '' THEN 0 ELSE round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) END::DOUBLE AS first, CASE WHEN t = '' THEN 0 ELSE round(v[8] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) END::DOUBLE AS last FROM r"""
)
def hashed_vectors(spark, sf_dir):
    v = memories(spark, sf_dir).select("id", vectors.hashed(F.col("content"), 8).alias("v"))
    return v.select("id", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(7)).alias("last"))


@query(f"SELECT key, max_by(value, seq) AS value, max_by(kind, seq) AS kind FROM {NOTED} WHERE key <> '' AND (op = 'forget' OR kind IN ('project', 'user', 'agent')) GROUP BY key HAVING max_by(op, seq) <> 'forget'")
def current_nuggets(spark, sf_dir):
    return nuggets.current(noted(spark, sf_dir))


@query(
    """WITH d AS (SELECT doc_id AS id, source AS project, CASE doc_id % 6 WHEN 0 THEN 'decision' WHEN 1 THEN 'invariant' WHEN 2 THEN 'blocker' WHEN 3 THEN 'bug' ELSE 'lesson' END AS category, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents),
s AS (SELECT *, CASE category WHEN 'decision' THEN 'Decisions & Priorities' WHEN 'invariant' THEN 'Project Invariants' WHEN 'lesson' THEN 'Core Lessons' ELSE 'Known Bugs & Blockers' END AS section FROM d WHERE n <= 250),
p AS (SELECT *, row_number() OVER (PARTITION BY project, section ORDER BY (category = 'bug')::INT, id % 3 DESC, id DESC) AS place FROM s) SELECT project, section, place, id, category FROM p WHERE place <= 5"""
)
def state_sections(spark, sf_dir):
    m = F.col("id") % 6
    d = memories(spark, sf_dir).withColumn("category", F.when(m == 0, "decision").when(m == 1, "invariant").when(m == 2, "blocker").when(m == 3, "bug").otherwise("lesson")).withColumns({"status": F.lit("ACTIVE"), "affinity": F.col("id") % 3})
    return report.sections(d).select("project", "section", "place", "id", "category")


@query(
    """WITH d AS (SELECT source AS category, n_chars % 7 / 7.0 AS a, (n_chars % 3)::DOUBLE AS b FROM documents), p AS (SELECT category, count(*) AS n, avg(a) AS a, avg(b) AS b FROM d GROUP BY category)
SELECT category, n, round(a, 6) AS a, round(b, 6) AS b FROM p UNION ALL SELECT 'macro', CAST(sum(n) AS BIGINT), round(avg(a), 6), round(avg(b), 6) FROM p UNION ALL SELECT 'all', count(*), round(avg(a), 6), round(avg(b), 6) FROM d"""
)
def benchmark_means(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("category"), (F.col("n_chars") % 7 / 7.0).alias("a"), (F.col("n_chars") % 3).cast("double").alias("b"))
    return report.means(d, ["a", "b"]).select("category", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("WITH s AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, n_chars AS p FROM s WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)")
def p95_lengths(spark, sf_dir):
    return report.nth_latency(table(spark, sf_dir, "documents"), by="source", value="n_chars")


@query("WITH r AS (SELECT doc_id % 4 AS k, (doc_id * 7 % 11) / 10.0 AS a, (doc_id * 3 % 11) / 10.0 AS b FROM documents) SELECT k, count(*) AS n, round(avg(((a >= 0.5) = (b >= 0.5))::INT), 6) AS binary, round(avg((abs(a - b) <= 0.25)::INT), 6) AS near, round(avg((a = b)::INT), 6) AS exact FROM r GROUP BY k")
def rater_agreement(spark, sf_dir):
    i = F.col("doc_id")
    r = table(spark, sf_dir, "documents").select((i % 4).alias("k"), (i * 7 % 11 / 10).alias("a"), (i * 3 % 11 / 10).alias("b"))
    return report.agreement(r, "a", "b", by="k").select("k", "n", *[F.round(c, 6).alias(c) for c in ("binary", "near", "exact")])


# Diffs, blame, rules.


@query("SELECT page_id AS diff_id, 'src/page' || page_id || '.html' AS file, url AS line FROM pages")
def added_lines(spark, sf_dir):
    return diffs.added(diff_of(table(spark, sf_dir, "pages"))).select("diff_id", "file", "line")


@query("SELECT page_id AS diff_id, 'src/page' || page_id || '.html' AS file FROM pages")
def touched_files(spark, sf_dir):
    return diffs.touched(diff_of(table(spark, sf_dir, "pages")))


@query("SELECT page_id AS diff_id, 'docs' AS rule, 'docs/**' AS required FROM pages WHERE page_id % 10 = 3 OR length(CAST(page_id AS VARCHAR)) = 1")
def missing_companions(spark, sf_dir):
    found = diffs.touched(diff_of(table(spark, sf_dir, "pages")))
    both = [{"id": "docs", "when": ["src/page?.html", "src/*3.html"], "require": ["docs/**"]}, {"id": "self", "when": ["src/*"], "require": ["*.html"]}]
    return rules.missing_companions(found, both)


@query("SELECT page_id AS diff_id, 'src/page' || page_id || '.html' AS file, rule FROM (SELECT page_id, unnest(list_filter([CASE WHEN contains(url, '1') THEN 'one' END, CASE WHEN contains(url, '2') THEN 'two' END, CASE WHEN contains(url, '3') THEN 'three' END], lambda x: x IS NOT NULL)[1:2]) AS rule FROM pages)")
def pattern_findings(spark, sf_dir):
    a = diffs.added(diff_of(table(spark, sf_dir, "pages")))
    return rules.pattern_findings(a, [("one", "1"), ("two", "2"), ("three", "3")])


@query(f"SELECT 'src/' || f || '.py' AS file, sha, line, summary, regexp_matches(summary, '(?i)^(style|docs|chore|ci|build|test)(\\([^)]*\\))?!?:\\s') AS mechanical, regexp_extract(summary, '\\(#(\\d+)\\)\\s*$', 1) AS prs FROM {BLAMED} WHERE NOT regexp_matches(sha, '^0+$')")
def blamed_lines(spark, sf_dir):
    return blamed(spark, sf_dir).withColumn("prs", F.array_join("prs", ","))


def blamed(spark, sf_dir) -> DataFrame:
    """Files of porcelain text: the lines of file f are the documents whose id leaves f, of one commit for each 160 documents."""
    i = F.col("doc_id")
    commit, gone = F.floor(i / 160), i % 7 == 3
    kind = F.when(commit % 4 == 0, "feat: ").when(commit % 4 == 1, "docs(x): ").when(commit % 4 == 2, "chore: ").otherwise("plain ")
    sha = F.when(gone, F.lit("0" * 40)).otherwise(F.concat(F.md5(commit.cast("string")), F.lit("00000000")))
    summary = F.when(gone, "Not Committed Yet").otherwise(F.concat(kind, F.col("source"), F.lit(" (#"), commit, F.lit(")")))
    lines = table(spark, sf_dir, "documents").select((i % 40).alias("f"), (F.floor(i / 40) + 1).alias("line"), sha.alias("sha"), summary.alias("summary"))
    lines = lines.withColumn("t", F.concat_ws("\n", F.concat_ws(" ", "sha", "line", "line"), F.lit("author x"), F.concat(F.lit("summary "), "summary")))
    one = lines.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("a"))
    return blame.blamed(one.select(F.concat(F.lit("src/"), "f", F.lit(".py")).alias("file"), F.array_join(F.transform("a", lambda x: x["t"]), "\n").alias("porcelain")))


@query(
    f"""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, list_distinct({STEMMED}) AS s FROM conversations), n AS (SELECT *, list_distinct(list_concat(list_concat(s, coalesce(lag(s) OVER w, [])), coalesce(lead(s) OVER w, []))) AS a FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT item_id, list_distinct(list_transform(a, lambda w: {stem_sql("w")})) AS a FROM (SELECT item_id, {minus("a", words.GENERIC_WORDS)} AS a FROM (SELECT item_id, {minus("a", words.META_WORDS)} AS a FROM (SELECT item_id, {minus("a", words.TEMPORAL_CUES)} AS a FROM (SELECT item_id, {TERMS} AS a FROM benchmark))))),
j AS (SELECT q.item_id, any_value(len(q.a)) AS n_terms, max(len(list_intersect(q.a, n.a))) AS joint FROM q, n GROUP BY q.item_id)
SELECT item_id AS query_id, n_terms, joint, CASE WHEN joint = n_terms THEN 'GROUNDED' WHEN joint > 0 THEN 'UNATTESTED_ATTRIBUTE' ELSE 'UNSUPPORTED' END AS status FROM j"""
)
def grounding_status(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    g = scoring.grounding(turns(spark, sf_dir), q)
    return g.select("query_id", F.col("n_terms").cast("int").alias("n_terms"), F.col("joint").cast("int").alias("joint"), "status")


@query(
    """WITH n AS (SELECT count(*) AS n FROM documents), a AS (SELECT doc_id, 'S-' || (doc_id // 3) AS k FROM documents), s AS (SELECT 1 AS query_id, 5 AS id UNION ALL SELECT 2, 9)
SELECT DISTINCT s.query_id, b.doc_id AS id, 0.88 AS strength FROM s JOIN a ON a.doc_id = s.id JOIN a b ON a.k = b.k AND b.doc_id <> s.id"""
)
def related_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("see rule SX-"), F.floor(F.col("doc_id") / 3)).alias("content"), F.array().cast("array<string>").alias("tags"))
    seeds = spark.createDataFrame([(1, 5), (2, 9)], "query_id int, id long")
    return graph.related(d, seeds).select("query_id", "id", "strength")


@query("SELECT event_id AS id, event_type AS session, user_id FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)")
def last_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("session"), "user_id")
    return candidates.by_ids(e, e.groupBy("user_id").agg(F.max("id").alias("id")).select("id"))


@query("SELECT source AS k, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY list, rank, doc_id) AS place FROM (SELECT source, doc_id, min(list) AS list, min_by(rank, list) AS rank FROM (SELECT source, doc_id, 0 AS list, doc_id AS rank FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT source, doc_id, 1, -doc_id FROM documents WHERE doc_id % 3 = 0) GROUP BY ALL)")
def priority_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("k"), F.col("doc_id").alias("id"))
    return candidates.by_priority([d.where("id % 7 = 0").withColumn("rank", F.col("id")), d.where("id % 3 = 0").withColumn("rank", -F.col("id"))], keys=("k", "id"))
