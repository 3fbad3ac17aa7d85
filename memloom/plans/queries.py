"""Queries over the driver's tables with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors, words
from ..operators import diffs, episodes, index, lineage, ranking, search
from ..sources import staging
from ..sources.tables import memories, table, turns


def stem_sql(w: str) -> str:
    single = lambda x: f"CASE WHEN length({x}) > 1 AND right({x}, 1) = left(right({x}, 2), 1) THEN left({x}, length({x}) - 1) ELSE {x} END"
    cut = lambda k: f"left({w}, length({w}) - {k})"
    base = (
        f"CASE WHEN length({w}) > 4 AND suffix({w}, 'ies') THEN {cut(3)} || 'y' WHEN length({w}) > 5 AND suffix({w}, 'ing') THEN {single(cut(3))} "
        f"WHEN length({w}) > 4 AND suffix({w}, 'ed') THEN {single(cut(2))} WHEN length({w}) > 4 AND suffix({w}, 'es') AND NOT regexp_matches({w}, '(tes|les|res|ves)$') THEN {cut(2)} "
        f"WHEN suffix({w}, 's') AND NOT regexp_matches({w}, '(ss|us|is)$') THEN {cut(1)} ELSE {w} END"
    )
    return f"CASE WHEN length({w}) <= 3 THEN {w} WHEN length({base}) > 4 AND suffix({base}, 'e') AND NOT suffix({base}, 'ee') THEN left({base}, length({base}) - 1) ELSE {base} END"


TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: length(x) >= 2)"
STEMMED = f"list_transform({TOKENS}, lambda w: {stem_sql('w')})"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id AS id, source AS project, lang AS category FROM documents WHERE lang <> 'fr' ORDER BY doc_id DESC LIMIT 5000")
def active_recency_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).where("category != 'fr'").orderBy(F.desc("id")).limit(5000).select("id", "project", "category")


@query(f"SELECT w AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({STEMMED}) AS w FROM documents) GROUP BY w")
def term_statistics(spark, sf_dir):
    return search.postings(memories(spark, sf_dir)).groupBy("term").agg(F.sum("tf").cast("long").alias("tf"), F.count("*").alias("df"))


BM25 = f"""
WITH q AS (SELECT item_id, unnest(t) AS term FROM (SELECT item_id, list_distinct_keep[1:14] AS t FROM (SELECT item_id, list_filter(s, lambda x, i: list_position(s, x) = i) AS list_distinct_keep FROM (SELECT item_id, {STEMMED} AS s FROM benchmark)))),
d AS (SELECT doc_id, {STEMMED} AS s FROM documents), n AS (SELECT count(*) AS n, avg(len(s)) AS avgdl FROM d),
p AS (SELECT term, doc_id, len(s) AS dl, count(*) AS tf FROM (SELECT doc_id, s, unnest(s) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank FROM s)
"""


@query(BM25.replace("list_distinct_keep[1:14] AS t", "list_distinct_keep AS t") + "SELECT item_id AS query_id, doc_id AS id, round(score, 4) AS score, rank FROM r WHERE rank <= 10")
def bm25_top10(spark, sf_dir):
    """All words of each item's whole text are asked."""
    found = search.bm25(memories(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=10, query_key="item_id", query_text="text", most=None)
    # As in SQL the double is rounded; ``round`` would round its shortest decimal form, in which a half may be exact.
    return found.withColumn("score", F.floor(F.col("score") * 10000 + 0.5) / 10000)


@query(BM25 + "SELECT item_id AS query_id, doc_id AS id, round(score, 4) AS score, rank FROM r WHERE rank <= 10")
def indexed_bm25(spark, sf_dir):
    """The search for the first stems of each item by a stored index that went through inserts, updates, deletions and a fold of its batches."""
    rows = memories(spark, sf_dir).select("id", "content")
    built = index.TermIndex(spark, staging.new_path(spark, "index"))
    other = F.reverse(F.coalesce("content", F.lit("")))
    guests = rows.where("id % 11 = 0").select((-1 - F.col("id")).alias("id"), "content")
    built.apply(rows.where("id % 5 != 0").withColumn("content", F.when(F.col("id") % 7 == 3, other).otherwise(F.coalesce("content", F.lit("")))).unionByName(guests), 0)
    built.apply(rows.where("id % 5 = 0 OR id % 7 = 3").withColumn("content", F.coalesce("content", F.lit(""))), 1)
    built.compact()
    built.apply(guests.withColumn("gone", F.lit(True)), 2, deleted="gone")
    return built.bm25(table(spark, sf_dir, "benchmark"), k=10, query_key="item_id", query_text="text").withColumn("score", F.round("score", 4))


@query(
    f"""WITH q AS (SELECT DISTINCT unnest(s[1:14]) AS term FROM (SELECT list_filter(s, lambda x, i: list_position(s, x) = i) AS s FROM (SELECT {STEMMED} AS s FROM benchmark))),
p AS (SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({STEMMED}) AS w FROM documents) GROUP BY w)
SELECT term, coalesce(df, 0) AS df, round(ln(1 + (SELECT count(*) FROM documents) / (1 + coalesce(df, 0))), 6) AS idf FROM q LEFT JOIN p ON w = term"""
)
def query_term_idf(spark, sf_dir):
    out = search.idf(memories(spark, sf_dir), table(spark, sf_dir, "benchmark"), key="item_id", text="text")
    return out.withColumn("idf", F.round("idf", 6))


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10"""
)
def nearest_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.nearest(e, e.where("vec_id % 100 = 0"), k=10, key="vec_id")


@query(
    """WITH e AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings)
SELECT vec_id AS id, round(c, 6) AS raw, round(CASE WHEN c <= 0 THEN 0 WHEN c >= 1 THEN 1 WHEN c <= 0.12 THEN c * 3 WHEN c <= 0.38 THEN 0.36 + (c - 0.12) * (0.32 / 0.26) WHEN c <= 0.6 THEN 0.68 + (c - 0.38) * (0.16 / 0.22) ELSE 0.84 + (c - 0.6) * 0.4 END, 6) AS score FROM e"""
)
def calibrated_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    return e.join(F.broadcast(q)).select(F.col("vec_id").alias("id"), vectors.cosine("embedding", "q").alias("c")).select("id", vectors.rounded(F.col("c"), 6).alias("raw"), F.round(vectors.calibrate(F.col("c")), 6).alias("score"))


@query(
    """WITH t AS (SELECT conv_id AS session_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY conv_id * 10000 + turn) - 1 AS position FROM conversations)
SELECT session_id, position // 4 AS window_index, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM t GROUP BY ALL"""
)
def session_windows(spark, sf_dir):
    w = episodes.session_windows(turns(spark, sf_dir), size=4)
    return w.groupBy("session_id", "window_index").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT user_id, event_type, event_id, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(CASE WHEN k = 1 OR event_type IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM t)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY ALL"""
)
def event_runs(spark, sf_dir):
    return episodes.runs(table(spark, sf_dir, "events"), session="event_type", order="event_id", partition="user_id")


@query(
    """WITH t AS (SELECT conv_id * 10000 + turn AS id, conv_id, least(length(coalesce(text, '')), 1000)::DOUBLE / 1000 AS s FROM conversations),
l AS (SELECT *, lag(s, 1) OVER w AS a, lead(s, 1) OVER w AS b, lag(s, 2) OVER w AS c, lead(s, 2) OVER w AS d, avg(s) OVER (PARTITION BY conv_id ORDER BY id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY id))
SELECT id, round(greatest(s, 0.5 * s + 0.5 * coalesce(greatest(a * 0.905, b * 0.905, c * 0.87, d * 0.87), 0), 0.58 * s + 0.42 * m) + 1e-9, 5) AS smoothed FROM l"""
)
def smoothed_scores(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("score", F.least(F.length(F.coalesce("content", F.lit(""))), F.lit(1000)) / 1000)
    return episodes.smooth(t).select("id", F.round(F.col("smoothed") + 1e-9, 5).alias("smoothed"))


@query(
    BM25
    + """, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, count(*) AS c FROM q JOIN p USING (term) GROUP BY ALL)) WHERE rank <= 100),
a AS (SELECT item_id, doc_id, 1.0 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)) AS s FROM (SELECT * FROM r WHERE rank <= 100) WHERE score > 1e-6 UNION ALL SELECT item_id, doc_id, 1.0 / (60 + row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id)) FROM o),
g AS (SELECT item_id, doc_id, round(sum(s) / (2.0 / 61), 6) AS fused, count(*) AS n_arms FROM a GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, doc_id) AS rank FROM g)
SELECT item_id AS query_id, doc_id AS id, fused, n_arms, rank FROM k WHERE rank <= 20"""
)
def fused_ranking(spark, sf_dir):
    p = search.prepared(memories(spark, sf_dir), table(spark, sf_dir, "benchmark"), query_key="item_id", query_text="text")
    return ranking.fuse({"bm25": search.top(p, "score", 100), "overlap": search.top(p, "n_terms", 100, newest=False)}, k=20)


@query(
    """WITH t AS (SELECT source, doc_id, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS n_tokens FROM documents),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM t) SELECT source, doc_id, n_tokens, CAST(used AS BIGINT) AS used FROM u WHERE used <= 8000"""
)
def budget_packing(spark, sf_dir):
    return ranking.pack(table(spark, sf_dir, "documents"), budget=8000, by="source", order="doc_id", text="text").select("source", "doc_id", "n_tokens", "used")


@query("SELECT source AS project, lang AS category, count(*) AS n, count(*) FILTER (length(coalesce(text, '')) < 200) AS n_short, max(doc_id) AS newest FROM documents GROUP BY ALL")
def health_counts(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return rows.groupBy("project", "category").agg(F.count("*").alias("n"), F.count_if(F.length(F.coalesce("content", F.lit(""))) < 200).alias("n_short"), F.max("id").alias("newest"))


FEEDBACK = "CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'dismissed' WHEN 'purchase' THEN 'accepted' ELSE 'rejected' END"


@query(
    f"""WITH d AS (SELECT user_id, event_id, CASE {FEEDBACK} WHEN 'accepted' THEN 0.2 WHEN 'dismissed' THEN -0.3 ELSE -0.6 END::DECIMAL(18,1) AS d FROM events),
s AS (SELECT user_id, event_id, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM d)
SELECT user_id AS rule_id, round(CAST(greatest(1 + max_by(s, event_id), max_by(s, event_id) - min(s)) AS DOUBLE), 6) AS weight, count(*) AS n FROM s GROUP BY user_id"""
)
def feedback_weights(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rule_id"), F.col("event_id").alias("id"), F.expr(FEEDBACK).alias("feedback"))
    return lineage.weights(e).withColumn("weight", F.round("weight", 6))


@query(
    """WITH RECURSIVE e AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 4 AND doc_id < (SELECT max(doc_id) FROM documents) THEN doc_id + 1 END AS nxt FROM documents),
w AS (SELECT id, id AS here, 0 AS depth FROM e UNION ALL SELECT w.id, e.nxt, depth + 1 FROM w JOIN e ON e.id = w.here WHERE e.nxt IS NOT NULL AND depth < 8)
SELECT id, max_by(here, depth) AS terminal_id, max(depth) AS depth FROM w GROUP BY id"""
)
def lineage_terminals(spark, sf_dir):
    rows = memories(spark, sf_dir).select("id")
    last = rows.agg(F.max("id").alias("last"))  # one row
    return lineage.chains(rows.join(F.broadcast(last)).select("id", F.when((F.col("id") % 5 != 4) & (F.col("id") < F.col("last")), F.col("id") + 1).alias("superseded_by")))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_per_key(spark, sf_dir):
    return lineage.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query(
    """WITH d AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS n FROM lineitem), i AS (SELECT k, n, n - row_number() OVER (PARTITION BY k ORDER BY n) AS g FROM d)
SELECT k AS supplier, min(n) AS first, max(n) AS last FROM i GROUP BY k, g"""
)
def part_ranges(spark, sf_dir):
    return episodes.ranges(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("line")), key="supplier")


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    from ..streaming.feedback import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


def diff_of(pages: DataFrame) -> DataFrame:
    text = F.concat(F.lit("--- a/src/page"), F.col("page_id"), F.lit(".html\n+++ b/src/page"), F.col("page_id"), F.lit(".html\n@@ -"), F.col("page_id") % 50 + 1, F.lit(",3 +1,4 @@\n kept\n+"), F.col("url"), F.lit("\n-gone"))
    return pages.select(F.col("page_id").alias("diff_id"), text.alias("diff"))


@query("SELECT page_id AS id, 'web/src/page' || page_id || '.html' AS file, page_id % 50 + 1 AS first, page_id % 50 + 3 AS last FROM pages WHERE page_id % 40 + 1 <= page_id % 50 + 3 AND page_id % 40 + 4 >= page_id % 50 + 1")
def spans_touched_by_diffs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    spans = pages.select(F.col("page_id").alias("id"), F.concat(F.lit("web/src/page"), F.col("page_id"), F.lit(".html")).alias("file"), (F.col("page_id") % 40 + 1).alias("start_line"), (F.col("page_id") % 40 + 4).alias("end_line"))
    return diffs.overlapping(spans, diffs.hunks(diff_of(pages))).select("id", "file", "first", "last")


@query(
    f"""SELECT doc_id AS id, len(list_distinct({STEMMED})) AS n_stems, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS n_tokens FROM documents"""
)
def row_features(spark, sf_dir):
    t = F.coalesce("content", F.lit(""))
    return memories(spark, sf_dir).select("id", F.size(words.stems(t)).cast("long").alias("n_stems"), words.token_estimate(t).alias("n_tokens"))
