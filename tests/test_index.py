import random

from pyspark.sql import functions as F

from memloom.operators import search
from memloom.operators.index import TermIndex
from memloom.plans.engine import Engine
from memloom.sources import staging

KIND = "id long, content string, project string, gone boolean, seq long"
VOCAB = "cache caches caching queue exports export parser parsing upload retry timeout blue green harbour node policies policy".split()


def answers(found):
    return {(r.query_id, r.id, r.score, r.n_terms) for r in found.collect()}


def test_changes_give_the_scores_of_the_live_rows(spark, tmp_path):
    rnd = random.Random(3)
    index = TermIndex(spark, f"{tmp_path}/index", buckets=4)
    asked = spark.createDataFrame([(1, "caches for exports"), (2, "parser policy timeout blue"), (3, "zebra"), (4, None)], "query_id long, query string")
    assert index.matches(asked).count() == 0 and index.batches() == []
    live = {}
    for n in range(4):
        changes = {}
        for _ in range(40):
            i, gone = rnd.randrange(60), rnd.random() < 0.25
            text = None if rnd.random() < 0.1 else " ".join(rnd.choices(VOCAB, k=rnd.randint(0, 12)))
            changes.setdefault(i, []).append((i, text, rnd.choice("pq"), gone, len(changes.get(i, []))))
        batch = spark.createDataFrame([r for rows in changes.values() for r in rows], KIND)
        for _ in range(2):  # a batch given again counts once
            done = index.apply(batch, n, part="project", deleted="gone", seq="seq")
        assert not done
        for i, rows in changes.items():
            _, text, project, gone, _ = rows[-1]
            live.pop(i, None)
            if text is not None and not gone:
                live[i] = (i, text, project)
        if n == 2:
            index.compact()
            assert index.batches() == [2] and index._read("dead").count() == 0
            assert not index.apply(batch, 1, part="project", deleted="gone", seq="seq")
        rows = spark.createDataFrame(list(live.values()), "id long, content string, project string")
        assert answers(index.matches(asked)) == answers(search.matches(rows, asked))
        assert answers(index.matches(asked, part="p")) == answers(search.matches(rows.where("project = 'p'"), asked))
    assert [tuple(r) for r in index.bm25(asked, k=3).orderBy("query_id", "rank").collect()] == [tuple(r) for r in search.bm25(rows, asked, k=3).orderBy("query_id", "rank").collect()]
    index.compact()
    index.compact()
    assert staging.folders(spark, f"{tmp_path}/index") == ["g2", "g3"] and answers(index.matches(asked)) == answers(search.matches(rows, asked))


def test_unfinished_batches_are_not_seen(spark, tmp_path):
    index = TermIndex(spark, f"{tmp_path}/index", buckets=2)
    index.apply(spark.createDataFrame([(1, "blue harbour"), (None, "x")][:1], "id long, content string"), 0)
    index.apply(spark.createDataFrame([(1, "green harbour"), (2, "blue node")], "id long, content string"), 1)
    staging.removed(spark, f"{tmp_path}/index/g0/sizes/batch=1")
    asked = spark.createDataFrame([(1, "blue green")], "query_id long, query string")
    assert [(r.id, r.n_terms) for r in index.matches(asked).collect()] == [(1, 1)]


def test_only_folders_of_asked_terms_are_read(spark, tmp_path):
    index = TermIndex(spark, f"{tmp_path}/index", buckets=16)
    index.apply(spark.createDataFrame([(i, " ".join(VOCAB[i % 5 :])) for i in range(50)], "id long, content string"), 0)
    asked = spark.createDataFrame([(1, "harbour")], "query_id long, query string")
    bucket = asked.select(index._bucket(F.lit("harbour"))).head()[0]
    plan = index.matches(asked)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = [line for line in plan.splitlines() if line.startswith("PartitionFilters") and "bucket" in line]
    assert filters and all(f"IN ({bucket})" in line or f"= {bucket})" in line for line in filters)
    assert "In(term, [harbour])" in plan or "EqualTo(term,harbour)" in plan


def test_retrieval_reads_the_index(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    kind = "id long, seq long, category string, content string, project string"
    e.remember(spark.createDataFrame([(i, i, "lesson", f"harbour note {i} about {VOCAB[i % 5]}", "pq"[i % 2]) for i in range(1, 9)], kind), batch="first")
    e.remember(spark.createDataFrame([(i, i, "lesson", f"harbour note {i} about {VOCAB[i % 5]}", "pq"[i % 2]) for i in range(1, 9)], kind), batch="first")
    assert e.state().count() == 8
    asked = spark.createDataFrame([(1, "harbour queue")], "query_id long, query string")
    assert {r.id for r in e.retrieve(asked).collect()} <= set(range(1, 9)) and e.index.batches() == [1]
    e.revise(spark.createDataFrame([(3, 20, "delete", None)], "id long, seq long, op string, reason string"))
    e.retrieve(asked, project="q")
    assert e.index.batches() == [1, 2] and {r.id for r in e.index.matches(asked, part="q").collect()} == {1, 5, 7}
    e.retrieve(asked)
    assert e.index.batches() == [1, 2] and len(staging.folders(spark, f"{tmp_path}/scratch")) == 3
    e.clear()
    assert not staging.exists(spark, f"{tmp_path}/scratch")
