from memloom.operators import rules


def test_globs():
    import re

    hits = lambda g, f: bool(re.search(rules.glob_pattern(g), f))
    assert hits("src/*.js", "src/a.js") and hits("src/*.js", "repo/src/a.js") and not hits("src/*.js", "src/b/a.js") and not hits("src/*.js", "mysrc/a.js")
    assert hits("src/**/x.py", "src/a/b/x.py") and hits("src/**/x.py", "src/x.py") and hits("a?.md", "ab.md") and not hits("a?.md", "a/.md")
    assert rules.glob_pattern("{a,b}") is None


def test_findings(spark):
    touched = spark.createDataFrame([(1, "db/schema.sql"), (2, "db/schema.sql"), (2, "db/migrations/1.sql"), (3, "x.py")], "diff_id long, file string")
    got = rules.missing_companions(touched, [{"id": "migrate", "when": ["db/schema.sql"], "require": ["db/migrations/*.sql"]}])
    assert [tuple(r) for r in got.collect()] == [(1, "migrate", "db/migrations/*.sql")]
    added = spark.createDataFrame([(1, "a.js", "eval(x); document.write(y)"), (1, "a.js", "innerHTML = z"), (1, "tests/a.js", "eval(x)"), (2, "b.js", "fine")], "diff_id long, file string, line string")
    found = rules.pattern_findings(added, [("no-eval", r"\beval\("), ("no-write", r"document\.write"), ("no-html", "innerHTML")])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a.js", "no-eval"), (1, "a.js", "no-write")]
    assert [(r.diff_id, r.rule) for r in rules.first_findings([found, got], most=2).orderBy("diff_id", "place").collect()] == [(1, "no-eval"), (1, "no-write")]
