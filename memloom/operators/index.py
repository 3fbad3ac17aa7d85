"""A stored inverted index that searches read instead of the texts.

Rows arrive in numbered batches of inserts, updates and deletions.  A batch adds its postings, dealt to folders by the hash
of the term and sorted by term; what it replaces is named in a list of dead postings, never rewritten; document frequencies and
sizes are kept as changes that readers add up.  The batch's own line in ``sizes`` is written last and makes it visible, so a
batch that failed half-way is invisible and one that is repeated is applied once.  ``compact`` folds all batches into one,
without dead postings, in a new generation of folders.

A search reads the folders of the asked terms only.  Scores equal those of ``search.matches`` over the live rows.

Rows may belong to parts (projects): statistics are kept by part, and a search of one part uses its own.

Defined cases: a null text, or a row given as deleted, takes the row out; several rows of one id in a batch count once, by the
largest ``seq`` where there is one; deleting an unknown id changes nothing; null ids are refused; a text without tokens
counts as a row; an index without rows matches nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import staging
from . import search

#: Terms that are sent into the scan as values; more of them are met by the join alone.
LITERALS = 2000
LONG, TEXT = T.LongType(), T.StringType()


class TermIndex:
    def __init__(self, spark: SparkSession, folder: str, *, buckets: int = 64, key_type: T.DataType = LONG):
        self.spark, self.folder, self.buckets, self.key_type = spark, folder, buckets, key_type
        f = T.StructField
        self.schemas = {
            "postings": T.StructType([f("term", TEXT), f("part", TEXT), f("id", key_type), f("tf", LONG), f("dl", LONG), f("batch", LONG), f("bucket", LONG)]),
            "rows": T.StructType([f("id", key_type), f("part", TEXT), f("dl", LONG), f("seen", LONG), f("terms", T.ArrayType(TEXT)), f("batch", LONG)]),
            "dead": T.StructType([f("id", key_type), f("dead", LONG), f("batch", LONG)]),
            "frequencies": T.StructType([f("term", TEXT), f("part", TEXT), f("change", LONG), f("batch", LONG), f("bucket", LONG)]),
            "sizes": T.StructType([f("part", TEXT), f("n", LONG), f("tokens", LONG), f("batch", LONG)]),
        }

    # Folders.

    def _generation(self) -> int:
        """The newest generation that is complete."""
        whole = [int(g[1:]) for g in staging.folders(self.spark, self.folder) if staging.folders(self.spark, f"{self.folder}/{g}/sizes")]
        return max(whole, default=0)

    def _path(self, table: str, generation: int | None = None) -> str:
        return f"{self.folder}/g{self._generation() if generation is None else generation}/{table}"

    def batches(self) -> list[int]:
        """Numbers of the batches that are whole; one where the index was just compacted."""
        return sorted(int(name.split("=")[1]) for name in staging.folders(self.spark, self._path("sizes")))

    def _read(self, table: str) -> DataFrame:
        path, schema = self._path(table), self.schemas[table]
        if not staging.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).where(F.col("batch").isin(self.batches()))

    def _write(self, df: DataFrame, table: str, batch: int, generation: int | None = None) -> None:
        out = df.drop("batch").select([c for c in self.schemas[table].names if c != "batch"]).write.mode("overwrite").option("compression", "zstd")
        out = out.partitionBy("bucket") if "bucket" in self.schemas[table].names else out
        out.parquet(f"{self._path(table, generation)}/batch={batch}")

    def _bucket(self, term: str = "term"):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("long")

    def _dealt(self, df: DataFrame) -> DataFrame:
        """Rows of a bucket together and in order of the term, so that row groups that lack a term are skipped.

        A large bucket, or a term that most rows hold, is dealt to several tasks and files of the session's advisory size.
        """
        return df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")

    # Changes.

    def apply(self, changes: DataFrame, batch: int, *, key: str = "id", text: str = "content", part: str | None = None, deleted: str | None = None, seq: str | None = None, seen: str | None = None) -> bool:
        """Apply one batch; False where it, or a later compacted one, was applied before."""
        if any(batch <= b for b in self.batches()):
            return False
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        given = changes.select(
            F.coalesce(F.col(key), F.raise_error("an index row needs an id").cast(self.key_type)).alias("id"), (F.col(part) if part else F.lit(None)).cast("string").alias("part"),
            F.when(~gone, F.col(text)).alias("text"), (F.col(seen) if seen else F.lit(1)).cast("long").alias("seen"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("seq"),
        )
        last = given.groupBy("id").agg(F.max(F.struct("seq", F.col("text").isNotNull().alias("has"), "text", "part", "seen")).alias("r"))
        stems = last.select("id", "r.part", "r.seen", search.stem_lists(F.lower("r.text")).alias("all"))
        listed = stems.select("id", "part", F.when(F.col("all").isNotNull(), F.size("all")).cast("long").alias("dl"), "seen", "all")
        # Terms with their counts once; postings, frequencies and the forward list are read from it.
        work = staging.new_path(self.spark, "index")
        now = staging.staged(listed, work)
        each = now.select("id", "part", "dl", F.explode("all").alias("term")).groupBy("term", "part", "id", "dl").agg(F.count("*").alias("tf"))
        self._write(self._dealt(each), "postings", batch)
        self._write(now.select("id", "part", "dl", "seen", F.array_distinct("all").alias("terms")), "rows", batch)
        before = self.current().join(now.select("id"), "id", "left_semi").where(F.col("dl").isNotNull())
        self._write(before.select("id", F.col("batch").alias("dead")), "dead", batch)
        fresh = now.where(F.col("dl").isNotNull()).select("part", "dl", F.array_distinct("all").alias("terms"), F.lit(1).cast("long").alias("sign"))
        both = fresh.unionByName(before.select("part", "dl", "terms", F.lit(-1).cast("long").alias("sign")))
        df = both.select("part", "sign", F.explode("terms").alias("term")).groupBy("term", "part").agg(F.sum("sign").alias("change")).where("change != 0")
        self._write(self._dealt(df), "frequencies", batch)
        sizes = both.groupBy("part").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("dl")).alias("tokens"))
        self._write(sizes.coalesce(1), "sizes", batch)
        staging.removed(self.spark, work)
        return True

    def current(self) -> DataFrame:
        """(id, part, dl, seen, terms, batch): the newest state of every id; ``dl`` is null where the row is gone."""
        rows = self._read("rows")
        newest = rows.groupBy("id").agg(F.max("batch").alias("batch"))
        return rows.join(newest, ["id", "batch"])

    def _live(self) -> DataFrame:
        return self._read("postings").join(self._read("dead").select("id", F.col("dead").alias("batch")), ["id", "batch"], "left_anti")

    def compact(self) -> None:
        """Fold all batches into one of a new generation; the one before stays for searches under way, older ones go."""
        if not (batches := self.batches()):
            return
        old, last = self._generation(), batches[-1]
        new = old + 1
        tables = {
            "postings": self._dealt(self._live().drop("bucket")),
            "rows": self.current(),
            "dead": self._read("dead").limit(0),
            "frequencies": self._dealt(self._read("frequencies").groupBy("term", "part").agg(F.sum("change").alias("change")).where("change != 0")),
            "sizes": self._read("sizes").groupBy("part").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).coalesce(1),
        }
        for name, df in tables.items():
            self._write(df, name, last, new)
        if old:
            staging.removed(self.spark, f"{self.folder}/g{old - 1}")

    # Searches.

    def _prepared(self, queries: DataFrame, *, part: str | None = None, query_key: str = "query_id", query_text: str = "query") -> list[search.Prepared]:
        """Blocks of questions with their terms' postings, gathered by row: a row then meets all questions in one task."""
        mine = (lambda df: df.where(F.col("part") == part)) if part is not None else (lambda df: df)
        asked = staging.staged(search.query_stems(queries, key=query_key, text=query_text))
        sizes = mine(self._read("sizes")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).head()
        dead = self._read("dead").select("id", F.col("dead").alias("batch"))
        out = []
        for block in search.asked_blocks(asked):
            # A block's terms, and at most one value a bucket, come to the driver.
            terms = self.spark.createDataFrame(list(block.terms.items()), "term string, t int")
            wanted = F.col("bucket").isin([r.bucket for r in terms.select(self._bucket().alias("bucket")).distinct().collect()])
            wanted = wanted & F.col("term").isin(list(block.terms)) if len(block.terms) <= LITERALS else wanted
            near = lambda df: mine(df).where(wanted).join(F.broadcast(terms), "term")  # noqa: B023, E731
            df = np.zeros(len(block.terms))
            for r in near(self._read("frequencies")).groupBy("t").agg(F.sum("change").alias("df")).collect():
                df[r.t] = r.df
            live = near(self._read("postings")).join(dead, ["id", "batch"], "left_anti").groupBy("id").agg(F.max("dl").alias("dl"), F.collect_list(F.struct("t", F.col("tf").cast("int").alias("c"))).alias("a"))  # at most a block's terms
            counts = live.select("id", "dl", F.transform("a", lambda x: x["t"]).alias("t"), F.transform("a", lambda x: x["c"]).alias("c"))
            out.append(search.Prepared(block, counts, search.weights(sizes.n, df), sizes.tokens / max(sizes.n, 1) or 1.0, asked))
        return out

    def _none(self, queries: DataFrame, query_key: str, *values) -> DataFrame:
        return search.empty(self._read("rows"), queries, "id", query_key, F.lit(0.0).alias("score"), *values)

    def matches(self, queries: DataFrame, *, query_key: str = "query_id", **names) -> DataFrame:
        """(query_id, id, score, n_terms) as ``search.matches``, from the postings of the asked terms."""
        blocks = self._prepared(queries, query_key=query_key, **names)
        return search.every(blocks) if blocks else self._none(queries, query_key, F.lit(0).cast("long").alias("n_terms"))

    def bm25(self, queries: DataFrame, *, k: int = 300, query_key: str = "query_id", **names) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` best live rows of every query; ties go to the larger id."""
        blocks = self._prepared(queries, query_key=query_key, **names)
        return search.top(blocks, "score", k) if blocks else self._none(queries, query_key, F.lit(0).alias("rank"))
