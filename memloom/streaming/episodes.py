"""Session rollups kept by a stream: a micro-batch writes the windows it touches and no others.

What a batch needs to know of all before it is small: of each project its last id and session, of each session its windows,
and the rows of its last run.  Kept are these (``tails``), the turns with their windows (``turns``), the stems' document
frequencies as changes (``stems``), and the rollups (``rollups``), each in folders named by the batch, so that a repeated batch
overwrites itself and reads only what came before it.

New rows must have ids above those of their project before; a batch with late rows builds its projects again, in the same
folders.  A window's stems are weighed by the frequencies at the time of its last batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ordered, rollups
from ..sources import staging

SESSION = ["project", "session_id"]


class Rollups:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _before(self, table: str, n: int) -> DataFrame | None:
        path = f"{self.folder}/{table}"
        if not any(int(b.split("=")[1]) < n for b in staging.folders(self.spark, path)):
            return None
        return self.spark.read.parquet(path).where(F.col("batch") < n)

    def _write(self, df: DataFrame, table: str, n: int) -> DataFrame:
        path = f"{self.folder}/{table}/batch={n}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _newest(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """The rows of each key's last batch."""
        last = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max("batch").alias("__batch"))
        same = F.col("batch") == F.col("__batch")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        return df.join(last, same, "left_semi")

    def current(self) -> DataFrame:
        """The rollups as they are now: of each window its last batch, of each project nothing from before it was built again."""
        every = self._before("rollups", 1 << 62)
        again = every.where("again").groupBy(F.col("project").alias("p")).agg(F.max("batch").alias("since"))
        live = every.join(again, F.col("project").eqNullSafe(F.col("p")), "left").where("since IS NULL OR batch >= since")
        return self._newest(live, [*SESSION, "window_index"]).drop("p", "since", "again", "batch")

    def add(self, batch: DataFrame, n: int) -> None:
        """Take up one batch of rows (id, project, category, content[, session_id])."""
        rows = staging.staged(rollups.told(batch))
        tails = self._before("tails", n)
        tails = self._newest(tails, SESSION).drop("batch") if tails is not None else self.spark.createDataFrame([], "project string, session_id long, last long, positions long, windows long, run_rows long").withColumn("session_id", F.col("session_id").cast(rows.schema["session_id"].dataType))
        projects = tails.groupBy(F.col("project").alias("p")).agg(F.max("last").alias("newest"), F.max_by("session_id", "last").alias("open"))
        late = rows.join(projects, F.col("project").eqNullSafe(F.col("p"))).where("id <= newest").select("project").distinct()
        late = staging.staged(late)
        fresh = rows.join(late, rows["project"].eqNullSafe(late["project"]), "left_anti")
        placed = self._placed(fresh, tails, projects)
        if not late.isEmpty():
            # Built again: all turns of these projects, numbered anew.
            old = self._before("turns", n)
            mine = lambda df: df.join(late.select(F.col("project").alias("p")), F.col("project").eqNullSafe(F.col("p")), "left_semi")
            every = mine(rows) if old is None else mine(self._newest(old, ["id"]).select(rows.columns)).unionByName(mine(rows))
            anew = rollups.turns(every.drop("body", "user_clause", "date_label", "directive", "transition"))
            first = anew.groupBy(*SESSION, "run").agg(F.min("position").alias("start"))
            tied = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*SESSION, "run")]
            anew = anew.join(first.select(*[F.col(c).alias(f"__{c}") for c in (*SESSION, "run")], "start"), tied).withColumn("run_place", F.col("position") - F.col("start"))
            placed = placed.unionByName(anew.withColumn("again", F.lit(True)).select(placed.columns))
        placed = self._write(placed, "turns", n)
        last = placed.groupBy(*SESSION).agg(F.max("id").alias("last"), (F.max("position") + 1).alias("positions"), (F.max("window_index") + 1).alias("windows"), (F.max_by("run_place", "id") + 1).alias("run_rows"))
        self._write(last, "tails", n)
        # The stems' frequencies: of new rows alone, as rows built again were counted before.
        counts = rollups.stem_counts(rows).select("stem", F.col("df").alias("change")).unionByName(rows.agg(F.lit("").alias("stem"), F.count("*").alias("change")))
        self._write(counts, "stems", n)
        known = self.spark.read.parquet(f"{self.folder}/stems").where(F.col("batch") <= n).groupBy("stem").agg(F.sum("change").alias("df"))
        total = known.where("stem = ''").select(F.col("df").alias("n"))  # one row
        self._write(self._touched(placed, n, known.where("stem != ''").join(F.broadcast(total))), "rollups", n)

    def _placed(self, rows: DataFrame, tails: DataFrame, projects: DataFrame) -> DataFrame:
        """New rows with position, window_index and run_place, behind what their sessions and projects hold."""
        t = ordered.running(rows, SESSION, ["id"]).withColumnRenamed("place", "own")
        t = ordered.running(t, ["project"], ["id"]).withColumnRenamed("place", "whole").withColumn("run", F.col("whole") - F.col("own"))
        runs = t.groupBy(*SESSION, "run").agg(F.min("own").alias("start"), F.min("whole").alias("began"), F.count("*").alias("n"))
        known = tails.select(*[F.col(c).alias(f"t_{c}") for c in SESSION], "positions", "windows", "run_rows")
        same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in SESSION]
        runs = runs.join(known, same, "left").join(projects, F.col("project").eqNullSafe(F.col("p")), "left").fillna(0, ["positions", "windows", "run_rows"])
        # The project's first new run goes on with the run that stood last.
        goes_on = (F.col("began") == 0) & F.col("p").eqNullSafe(F.col("project")) & F.col("newest").isNotNull() & F.col("open").eqNullSafe(F.col("session_id")) & (F.col("run_rows") > 0)
        runs = runs.withColumn("held", F.when(goes_on, F.col("run_rows")).otherwise(0).cast("long"))
        filled = lambda c: F.ceil(c / rollups.WINDOW).cast("long")
        runs = runs.withColumn("new", filled(F.col("held") + F.col("n")) - filled(F.col("held")))
        runs = ordered.running(runs, SESSION, ["run"], sums={"earlier": "new"}).withColumn("base", F.col("windows") - filled(F.col("held")) + F.col("earlier"))
        keyed = runs.select(*[F.col(c).alias(f"r_{c}") for c in (*SESSION, "run")], "start", "held", "base", "positions")
        t = t.join(keyed, [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in (*SESSION, "run")])
        place = F.col("held") + F.col("own") - F.col("start")
        t = t.withColumn("run_place", place).withColumn("window_index", (F.col("base") + F.floor(place / rollups.WINDOW)).cast("long"))
        return t.withColumn("position", (F.col("positions") + F.col("own")).cast("long")).withColumn("again", F.lit(False)).select(*rows.columns, "position", "window_index", "run_place", "again")

    def _touched(self, placed: DataFrame, n: int, counts: DataFrame) -> DataFrame:
        """Rollups of the windows that hold new rows, with the rows that stood in them."""
        keys = [*SESSION, "window_index"]
        touched = placed.groupBy(*[F.col(c).alias(f"k_{c}") for c in keys]).agg(F.max("again").alias("rebuilt"))
        every = placed
        if (old := self._before("turns", n)) is not None:
            met = old.drop("batch").join(touched.where("NOT rebuilt"), [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in keys], "left_semi")
            every = placed.unionByName(met.select(placed.columns)).dropDuplicates(["id"])
        built = rollups.of_windows(every, counts)
        flags = touched.select(F.col("k_session_id").alias("s"), F.col("k_window_index").alias("w"), F.col("k_project").alias("q"), F.col("rebuilt").alias("again"))
        return built.join(flags, [F.col("session_id").eqNullSafe(F.col("s")), F.col("window_index") == F.col("w"), F.col("project").eqNullSafe(F.col("q"))]).drop("s", "w", "q")


def keep_rollups(stream: DataFrame, kept: Rollups, checkpoint: str):
    """Feed a stream of rows to ``kept``, a micro-batch at a time."""
    return stream.writeStream.foreachBatch(kept.add).option("checkpointLocation", checkpoint)
