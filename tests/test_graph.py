from memloom.operators import graph


def test_related_rows(spark):
    rows = [(1, "see #4 and src/auth/login.ts for AUTH-12", ["api"]), (2, "AUTH-12 was raised", None), (3, "edit lib/login.ts", []), (4, "plain", ["api"]), (5, "follows #1", None), (6, "nothing", None), (7, None, None)]
    r = spark.createDataFrame(rows, "id long, content string, tags array<string>")
    got = {x.id: (x.strength, list(x.edges)) for x in graph.related(r, spark.createDataFrame([(9, 1)], "query_id long, id long")).collect()}
    assert got == {2: (0.88, ["code"]), 3: (0.80, ["file"]), 4: (0.92, ["id", "tag"]), 5: (0.84, ["reverse"])}


def test_bridges_leave_the_session(spark):
    rows = [(1, "a", "the parser meets zebra tables"), (2, "a", "zebra again"), (3, "b", "zebra tables elsewhere"), (4, "c", "unrelated words"), (5, "b", None)]
    r = spark.createDataFrame(rows, "id long, session_id string, content string")
    q = spark.createDataFrame([(1, "parser")], "query_id long, query string")
    got = graph.bridges(r, spark.createDataFrame([(1, 1)], "query_id long, id long"), q).collect()
    assert [(x.id, x.shared) for x in got] == [(3, 2)]
