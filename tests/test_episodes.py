import random

from pyspark.sql import functions as F

from memloom.operators import rollups
from memloom.streaming.episodes import Rollups, keep_rollups

KIND = "id long, project string, session_id long, category string, content string"
SHOWN = ["project", "session_id", "window_index", "first", "last", "n", "children", "directives", "dates", "digest"]


def rows_of(rnd, ids, projects):
    out = []
    for i in ids:
        s = rnd.choice([1, 1, 1, 2, None])
        out.append((i, rnd.choice(projects), s, "invariant" if rnd.random() < 0.05 else "lesson", f"[Session {s} | Date: day {i // 40} | Turn #{i}] USER: always keep topic{i % 7} parsers {i} | ASSISTANT: yes"))
    # Sessions belong to one project.
    return [(i, p, None if s is None else s + 10 * projects.index(p), c, t) for i, p, s, c, t in out]


def shown(df):
    return sorted((str(tuple(r)) for r in df.select(SHOWN).collect()))


def built(spark, rows, projects):
    """All projects from scratch, each on its own, as windows of rows without a session are numbered a project."""
    return sorted(x for p in projects for x in shown(rollups.build(spark.createDataFrame([r for r in rows if r[1] == p], KIND))) if any(r[1] == p for r in rows))


def test_batches_give_what_one_build_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollups, "WINDOW", 5)
    rnd = random.Random(8)
    kept, every, at = Rollups(spark, f"{tmp_path}/r"), [], 0
    for n, size in enumerate([30, 1, 37]):
        new = rows_of(rnd, range(at, at + size), ["p", "q"])
        at += size
        every += new
        for _ in range(2 if n == 1 else 1):  # a batch that comes again
            kept.add(spark.createDataFrame(new, KIND).repartition(2), n)
    assert shown(kept.current()) == built(spark, every, ["p", "q"])
    # Only windows with new rows were written.
    written = spark.read.parquet(f"{tmp_path}/r/rollups").groupBy("batch").agg(F.count("*").alias("c")).collect()
    assert {r.batch: r.c for r in written}[1] == 1
    # Late rows: their project is built again, the other only goes on.
    late = [(1000, "p", 11, "lesson", "USER: newest | ASSISTANT: x"), (at, "q", 21, "lesson", "USER: newest | ASSISTANT: x")]
    kept.add(spark.createDataFrame(late, KIND), 3)
    last = [(at + 1, "p", 12, "lesson", "USER: late words | ASSISTANT: x"), (at + 2, "q", 21, "lesson", "USER: on time | ASSISTANT: x")]
    kept.add(spark.createDataFrame(last, KIND), 4)
    assert shown(kept.current()) == built(spark, every + late + last, ["p", "q"])
    more = [(2000, "p", 11, "lesson", "USER: goes on | ASSISTANT: x")]
    kept.add(spark.createDataFrame(more, KIND), 5)
    assert shown(kept.current()) == built(spark, every + late + last + more, ["p", "q"])


def test_a_stream_keeps_rollups(spark, tmp_path):
    rnd = random.Random(3)
    kept, every = Rollups(spark, f"{tmp_path}/r"), []
    for n in range(2):
        new = rows_of(rnd, range(n * 90, n * 90 + 90), ["p"])
        every += new
        spark.createDataFrame(new, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
        keep_rollups(stream, kept, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert shown(kept.current()) == built(spark, every, ["p"])
    assert all(r.stems for r in kept.current().collect())
