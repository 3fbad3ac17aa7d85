from memloom.operators.index import TermIndex
from memloom.streaming import feedback


def test_weights_follow_the_stream(spark, tmp_path):
    events = [("a", i, f) for i, f in enumerate(["accepted", "rejected", "rejected", "rejected", "accepted"])] + [("b", 9, "dismissed")]
    spark.createDataFrame(events, "rule_id string, id long, feedback string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("rule_id string, id long, feedback string").parquet(f"{tmp_path}/in")
    q = feedback.running_weights(stream).writeStream.outputMode("update").format("memory").queryName("weights").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        assert {r.rule_id: (round(r.weight, 6), r.n) for r in spark.table("weights").collect()} == {"a": (0.2, 5), "b": (0.7, 1)}
    finally:
        q.stop()


def test_append_is_idempotent_by_batch(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    q = feedback.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]


def test_index_and_rollups_follow_the_log(spark, tmp_path):
    kind = "id long, project string, category string, content string"
    say = lambda i, s: (i, "p", "lesson", f"[Session {s}] USER: words about topic{s} and parsers | ASSISTANT: ok")
    spark.createDataFrame([say(i, 1 + i // 3) for i in range(6)], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    index = TermIndex(spark, f"{tmp_path}/index", buckets=4)
    for _ in range(2):
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        feedback.index_rows(stream, index, f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination(90)
        feedback.refresh_rollups(stream, f"{tmp_path}/rows", f"{tmp_path}/rollups", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination(90)
        spark.createDataFrame([say(10, 2)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    asked = spark.createDataFrame([(1, "topic2")], "query_id long, query string")
    assert sorted(r.id for r in index.matches(asked).collect()) == [3, 4, 5, 10]
    now = feedback.current_rollups(spark.read.parquet(f"{tmp_path}/rollups")).collect()
    assert {r.session_id: r.children for r in now} == {1: [0, 1, 2], 2: [3, 4, 5, 10]}
