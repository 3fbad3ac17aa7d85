import random

from memloom.operators import anchoring, candidates, report, rules


def test_percentile_of_a_hot_group(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.randint(0, 50)) for _ in range(400)] + [("one", 7)]
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g)
        want[g] = v[min(int(len(v) * 0.95), len(v) - 1)]
    got = report.nth_latency(spark.createDataFrame(rows, "g string, v long").repartition(5), by="g", value="v").collect()
    assert {r.g: r.p for r in got} == want and len(got) == len(want)


def test_priority_and_affinity_are_numbered_through(spark):
    a = spark.createDataFrame([("q", i, i) for i in range(0, 40, 7)], "query_id string, id long, rank long")
    b = spark.createDataFrame([("q", i, -i) for i in range(0, 40, 3)], "query_id string, id long, rank long")
    want = [*range(0, 40, 7), *[i for i in range(39, -1, -3) if i % 7]]
    assert [r.id for r in candidates.by_priority([a, b]).orderBy("place").collect()] == want
    rows = spark.createDataFrame([(i, ["src/a.py", "projects/other/x.py", None][i % 3], ["nothing", "about loom", "see projects/other"][i % 2]) for i in range(30)], "rank long, file string, content string").repartition(4)
    got = candidates.by_affinity(rows, "loom").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 31)) and [(-r.affinity, r["rank"]) for r in got] == sorted((-r.affinity, r["rank"]) for r in got)


def test_many_rules_make_one_short_plan(spark):
    files = spark.createDataFrame([(d, f"src/m{d % 7}/f{i}.py") for d in range(20) for i in range(3)] + [(99, "docs/x.md"), (98, None)], "diff_id long, file string")
    many = [{"id": f"r{i}", "when": [f"src/m{i % 9}/*"], "require": [f"src/**/f{i % 5}.py"]} for i in range(400)]
    found = rules.missing_companions(files, many)
    want = {(d, f"r{i}") for d in range(20) for i in range(400) if d % 7 == i % 9 and i % 5 > 2}
    assert {(r.diff_id, r.rule) for r in found.collect()} == want
    lines = spark.createDataFrame([(1, "a.py", "x alpha"), (1, "a.py", "beta gamma"), (1, "tests/a.py", "alpha"), (2, None, "gamma")], "diff_id long, file string, line string")
    got = rules.pattern_findings(lines, [("g", "gamma"), ("a", "alpha"), ("b", "beta")])
    assert {(r.diff_id, r.file, r.rule) for r in got.collect()} == {(1, "a.py", "g"), (1, "a.py", "a"), (2, None, "g")}


def test_quotes_without_a_whole_word_are_found(spark):
    files = spark.createDataFrame([("new/a.txt", "xx unbelievable yy"), ("new/b.txt", "nothing"), ("new/c.txt", "a\n== == == == ==\nb")], "path string, text string")
    rows = spark.createDataFrame([(1, "old.txt", "nbelievabl"), (2, "old.txt", "== == == == =="), (3, "old.txt", "not there at")], "id long, file string, quote string")
    got = {r.id: (r.path, r.start_line) for r in anchoring.relocated(rows, files).collect()}
    assert got == {1: ("new/a.txt", 1), 2: ("new/c.txt", 2)}
    plan = anchoring.relocated(rows, files)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
