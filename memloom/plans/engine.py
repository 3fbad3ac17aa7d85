"""The five verbs over a folder of Parquet tables: remember, revise, retrieve, nudge, health.

Changes are an append-only log partitioned by project; the current state is a fold of it.  A batch of questions is one
job; nothing is answered row by row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text, words
from ..operators import candidates, conflicts, consolidate, fusion, lineage, nuggets, ranking, relevance, report, scoring, search
from ..operators.index import TermIndex
from ..sources import imports, staging

LOG = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("id", "seq")] + [T.StructField(n, T.StringType()) for n in ("op", "category", "content")] + [T.StructField("target", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("reason", "project")] + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("created_at", T.TimestampType())]
)
OPS = ["update", "supersede", "invalidate", "delete", "touch"]


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log_path, self.feedback_path, self.nugget_path = spark, f"{folder}/log", f"{folder}/feedback", f"{folder}/nuggets"
        self.scratch, self.index = f"{folder}/scratch", TermIndex(spark, f"{folder}/index")

    def _read(self, path: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _staged(self, df: DataFrame) -> DataFrame:
        """Candidates of a batch of questions, written and read back: later steps start from a table of k rows a question."""
        self._last = uuid.uuid4().hex
        return staging.staged(df, f"{self.scratch}/{self._last}")

    def _log(self) -> DataFrame:
        return self._read(self.log_path, T.StructType([*LOG.fields, T.StructField("batch", T.StringType())])).drop("batch")

    def _append(self, changes: DataFrame, batch: str | None) -> None:
        imports.evolved(changes, LOG).write.mode("overwrite").partitionBy("project").parquet(f"{self.log_path}/batch={batch or uuid.uuid4().hex}")

    def clear(self) -> None:
        """Delete the results of earlier retrievals."""
        staging.removed(self.spark, self.scratch)

    def remember(self, rows: DataFrame, *, batch: str | None = None) -> DataFrame:
        """Append rows (id, seq, category, content, project[, tags, embedding, created_at]).

        A batch with a name can be given again: it takes its own place.
        Returned are the rows that are refused: (id, secret, reason), for a secret in content, tags or project, or for no content.
        """
        every = F.concat_ws("\n", F.coalesce("content", F.lit("")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("project", "reason") if c in rows.columns], *[F.array_join("tags", "\n") for c in ("tags",) if c in rows.columns])
        checked = rows.withColumn("secret", words.secret(every))
        checked = checked.withColumn("why", F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "no content").when(F.col("secret").isNotNull(), "secret"))
        self._append(checked.where("why is null").withColumn("op", F.lit("insert")).withColumn("category", words.category(F.col("category"))), batch)
        return checked.where("why is not null").select("id", "secret", F.col("why").alias("reason"))

    def near_duplicates(self, rows: DataFrame, *, newest: int = 300, least: float = 0.82) -> DataFrame:
        """(id, duplicate_of): new rows whose words (three letters and more) are nearly those of one of the project's newest rows.

        A warning, never a refusal; the largest such id is named.
        """
        old = self.state().where("status = 'ACTIVE'")
        old = old.withColumn("r", F.row_number().over(W.partitionBy("project").orderBy(F.desc("id")))).where(F.col("r") <= newest)
        stems = F.array_distinct(F.transform(F.filter(words.tokens(F.coalesce("content", F.lit(""))), lambda w: F.length(w) >= 3), words.stem))
        one = lambda t, k, n: t.select("project", F.col("id").alias(k), F.size(stems).alias(n), F.explode(stems).alias("w"))
        both = one(rows, "id", "n").join(one(old, "duplicate_of", "m"), ["project", "w"]).where("id != duplicate_of")
        shared = both.groupBy("id", "duplicate_of", "n", "m").agg(F.count("*").alias("c"))
        return shared.where(F.col("c") >= least * (F.col("n") + F.col("m") - F.col("c"))).groupBy("id").agg(F.max("duplicate_of").alias("duplicate_of"))

    def revise(self, changes: DataFrame, *, batch: str | None = None) -> None:
        """Append changes (id, seq, op, ...): update, touch, supersede (target: the new row), invalidate (with a reason) or delete.

        Unknown operations, invalidations without a reason, secrets, and ids or targets that no row has are errors.
        """
        changes = imports.evolved(changes, LOG)
        reason, found = F.coalesce(F.trim("reason"), F.lit("")), words.secret(F.concat_ws("\n", "content", "reason"))
        fail = lambda what: F.raise_error(what).cast("string")
        checked = F.when(~F.coalesce(F.col("op").isin(*OPS), F.lit(False)), fail(F.concat(F.lit("unknown operation "), F.coalesce("op", F.lit("null")))))
        checked = checked.when((F.col("op") == "invalidate") & (reason == ""), fail(F.lit("an invalidation needs a reason"))).when(found.isNotNull(), fail(F.concat(F.lit("refused: "), found)))
        known = self._log().where("op = 'insert'").select("id").distinct()
        named = changes.select("id").unionByName(changes.where("op = 'supersede'").select(F.col("target").alias("id"))).distinct()
        if lost := named.join(known, "id", "left_anti").limit(5).collect():
            raise ValueError(f"no such rows: {[r.id for r in lost]}")
        self._append(changes.withColumn("op", checked.otherwise(F.col("op"))), batch)

    def synced(self) -> TermIndex:
        """The stored index, after the rows that the log changed since: rows with another number of log entries than the index has seen."""
        log, index = self._log(), self.index
        known = index.current().select("id", F.col("seen").alias("before"))
        touched = log.groupBy("id").agg(F.count("*").alias("seen")).join(known, "id", "left").where("before IS NULL OR before != seen").select("id", "seen")
        if not touched.isEmpty():
            now = touched.join(self._fold(log.join(touched.select("id"), "id", "left_semi")), "id", "left").withColumn("gone", F.coalesce(F.col("status") != "ACTIVE", F.lit(True)))
            index.apply(now, max(index.batches(), default=0) + 1, part="project", deleted="gone", seen="seen")
        return index

    def state(self, project: str | None = None) -> DataFrame:
        return self._fold(self._log() if project is None else self._log().where(F.col("project") == project))

    def _fold(self, log: DataFrame) -> DataFrame:
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
        kept = log.groupBy("id").agg(F.first("project", ignorenulls=True).alias("project"), *[last(c) for c in ("category", "tags", "embedding", "created_at", "reason")])
        return lineage.current(log).join(kept, "id")

    def retrieve(self, queries: DataFrame, *, project: str | None = None, k: int = 300, budget: int = 8000, now: Column | None = None) -> DataFrame:
        """(query_id, id, rank, score, content, used, epistemic_status) for a batch of questions (query_id, query[, embedding]).

        Candidates are the best rows by words, from the stored index, and by vectors; scores go through overlap, meaning, boosts and the fusion of four
        arms; near-duplicates go (rows in a conflict stay), and the rest is packed in order into the token budget.
        """
        queries = queries.withColumn("query", text.clean_query(F.col("query")))
        active = self.state(project).where("status = 'ACTIVE'").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        with_vectors = "embedding" in queries.columns
        began = set(staging.folders(self.spark, self.scratch))
        sources = [self.synced().bm25(queries, k=k, part=project).select("query_id", "id")]
        if with_vectors:
            sources.append(search.nearest(active, queries.select(F.col("query_id").alias("id"), "embedding"), k=k).select("query_id", "id"))
        found = self._staged(candidates.union(sources).drop("sources")).join(active.select("id", "category", "content", "tags", "created_at", "embedding"), "id")
        scored = fusion.word_overlap(found, queries)
        scored = fusion.semantic(scored, queries) if with_vectors else scored.withColumns({"raw": F.lit(0.0), "semantic": F.lit(0.0)})
        scored = self._staged(fusion.base_score(fusion.damped(scored)))
        scored = self._staged(fusion.boosted(scored, queries.select("query_id", "query"), now=now))
        terms = scoring.feedback_terms(scored).groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("__more"))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["weight"])
        scored = scored.join(terms, "query_id", "left").withColumn("__got", F.filter(F.coalesce("__more", F.array().cast("array<struct<term:string,weight:double>>")), lambda t: F.array_contains("stems", t["term"])))
        more = F.when((F.size("__got") > 0) & (F.col("score") > 0.36), 0.14 * total(F.col("__got")) / total(F.col("__more"))).otherwise(0.0)
        scored = scored.withColumn("unclamped", F.col("unclamped") + more).withColumn("score", F.least(F.lit(0.99), F.col("score") + more)).drop("__more", "__got")
        scored = scored.withColumn("span", scoring.span_tightness(F.col("content"), F.col("wanted")))
        scored = fusion.calibrated(scored.withColumn("prior", fusion.prior(scored)), with_vectors=with_vectors)
        ranked = self._staged(candidates.pool(candidates.kept(scored), budget=budget).select("query_id", "id", "rank", "score", "content"))
        disputed = self._staged(conflicts.conflicts(ranked, queries.select("query_id", "query")).select("query_id", "older", "newer", "conflict_type"))
        inside = disputed.select("query_id", F.explode(F.array("older", "newer")).alias("id")).distinct().withColumn("disputed", F.lit(True))
        pool = ranked.join(inside, ["query_id", "id"], "left").withColumn("disputed", F.coalesce("disputed", F.lit(False)))
        packed = ranking.pack(ranking.tiered(ranking.suppress(pool, threshold=0.92, exempt="disputed"), budget=budget), budget=budget).drop("disputed")
        open_ = candidates.both_packed(disputed, packed).groupBy("query_id").agg(F.count("*").alias("n_conflicts"))
        top = packed.groupBy("query_id").agg(F.max("score").alias("top"))
        status = F.when(F.col("id").isNull() | (F.col("top") < 0.50), "NO_KNOWN_SUPPORT").when(F.col("n_conflicts") > 0, "CONFLICTED").otherwise("SUPPORTED")
        out = queries.select("query_id").join(packed, "query_id", "left").join(top, "query_id", "left").join(open_, "query_id", "left")
        result = self._staged(out.withColumn("epistemic_status", status).drop("n_conflicts", "top", "n_tokens"))
        for name in set(staging.folders(self.spark, self.scratch)) - began - {self._last}:
            staging.removed(self.spark, f"{self.scratch}/{name}")
        return result

    def set_nuggets(self, changes: DataFrame) -> DataFrame:
        """Append changes (key, seq, op, value, kind) of nuggets; refused ones are returned with their reason."""
        changes.where(nuggets.refusal(changes).isNull()).select("key", "seq", "op", "value", "kind").write.mode("append").parquet(self.nugget_path)
        return nuggets.refused(changes).select("key", "reason")

    def nuggets(self) -> DataFrame:
        return nuggets.current(self._read(self.nugget_path, "key string, seq long, op string, value string, kind string"))

    def consolidate(self, project: str | None = None, *, distance: float = 0.15) -> DataFrame:
        """(id, superseded_by): active rows that nearly equal rows before them; give them to ``revise`` to apply them."""
        return consolidate.consolidation(self.state(project).where("status = 'ACTIVE'"), distance=distance)

    def compiled(self, project: str, *, tokens: int = 2400) -> DataFrame:
        """(project, text, level): the project's state as Markdown."""
        rows = self.state(project).withColumn("affinity", paths.affinity(F.lit(None).cast("string"), F.col("content"), project))
        return report.state(rows, tokens=tokens)

    def feedback(self, events: DataFrame) -> None:
        """Append feedback (rule_id, id, feedback)."""
        events.select("rule_id", "id", "feedback").write.mode("append").parquet(self.feedback_path)

    def nudge(self, texts: DataFrame, *, project: str | None = None, most: int = 3) -> DataFrame:
        """At most ``most`` rules (decisions, bugs, invariants, blockers) for each text (query_id, query), weighted by feedback."""
        rules = self.state(project).where("status = 'ACTIVE' and category in ('decision', 'bug', 'invariant', 'blocker')").drop("embedding")
        weights = lineage.weights(self._read(self.feedback_path, "rule_id long, id long, feedback string")).select(F.col("rule_id").alias("id"), "weight")
        # Rules that qualify by names, stems or vectors come first; then the best by words alone.
        told = relevance.scored(rules, texts, weights).select("query_id", "id", F.lit(0).alias("source"), F.col("score").alias("relevance"))
        live = rules.join(weights.where("weight <= 0.2").select("id"), "id", "left_anti")
        found = search.bm25(live, texts, k=50).join(weights, "id", "left").select("query_id", "id", F.lit(1).alias("source"), (F.col("score") * F.coalesce("weight", F.lit(1.0))).alias("relevance"))
        one = told.unionByName(found).groupBy("query_id", "id").agg(F.min(F.struct("source", (-F.col("relevance")).alias("r"))).alias("m"))
        place = F.row_number().over(W.partitionBy("query_id").orderBy("m.source", "m.r", "id"))
        first = one.withColumn("place", place).where(F.col("place") <= most)
        return first.join(rules.select("id", "category", "content"), "id").select("query_id", "id", "place", "category", "content", (-F.col("m.r")).alias("relevance"))

    def health(self) -> DataFrame:
        return self.state().groupBy("project", "category", "status").agg(F.count("*").alias("n"))
