from memloom.operators import blame, reasons

TOLD = "We cap the queue because unbounded writers broke the exporter."
CASES = [
    ("feat: queue limits", TOLD + "\n\nSigned-off-by: x", TOLD),
    ("build: bump", "Bumps [lib] from 1.0 to 2.0 because it is old and nobody likes it.", None),
    ("fix: retries", "Fixes #12\n\n- Retries are now bounded, so that a dead worker frees its slot.\n- Why not?", "Retries are now bounded, so that a dead worker frees its slot."),
    ("x", "Why: the old name was confusing to read.\nMore words that say nothing here.", "the old name was confusing to read."),
    ("x", "Why: n/a\n\nReason:\n\nNot because of the tests that we saw failing.", None),
    ("x", "Since parsers are slow on unicode, we cache the tables.\nSince the last release nothing else has changed here.", "Since parsers are slow on unicode, we cache the tables."),
    ("x", "This was previously wrong for all of the callers. It is otherwise a plain change to names. We no longer crash on empty input files.", "This was previously wrong for all of the callers. We no longer crash on empty input files."),
    ("x", "One plain line\nthat goes on because lines are joined.\n| a | because of b or c d |\nCC: because we must tell them all.\n```\nbecause code is not a reason at all\n```\n<!-- because hidden things are not one either -->", "One plain line that goes on because lines are joined."),
    ("feat(queue): cap unbounded writers", "Cap unbounded writers because writers.", None),
    ("x", 'The "because" in quotes is not a reason here. See [the page](http://x) and `code` because **bold** marks go away.', "See the page and code because bold marks go away."),
    ("x", "Plain words first because of one. \n\nWhat's changed\n\nThis was dropped because it is a dump of notes.", "Plain words first because of one."),
    ("x", "a " * 60 + "because " + "word " * 40 + "end.", None),
    (None, "", None),
    (None, None, None),
]


def test_reasons(spark):
    long = "a " * 60 + "because " + "word " * 40 + "end."
    want = {i: w for i, (_, _, w) in enumerate(CASES) if w}
    want[11] = long[:177].rsplit(" ", 1)[0].rstrip() + "..."
    rows = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(CASES)], "id int, subject string, body string").repartition(3)
    got = {r.id: r.why for r in reasons.reasons(rows).collect()}
    assert got == want


def test_blamed_commits_without_a_memory_and_code_that_outlived_one(spark):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    blamed = spark.createDataFrame([("f.py", a, 1, "feat: one", False, []), ("f.py", a, 2, "feat: one", False, []), ("f.py", b, 7, "feat: two", False, []), ("f.py", c, 9, "docs: x", True, [])], "file string, sha string, line long, summary string, mechanical boolean, prs array<string>")
    commits = spark.createDataFrame([(a, "feat: one", TOLD), (b, "feat: two", TOLD), (c, "docs: x", TOLD)], "sha string, subject string, body string")
    known = spark.createDataFrame([(1, None, f"set in commit {a[:9]}")], "id int, commit string, content string")
    assert [(r.file, r.sha, r.content) for r in blame.uncovered(blamed, known, commits).collect()] == [("f.py", b, f"feat: two ({TOLD})")]
    kind = "id long, status string, content string, commit string, file string, anchor_hash string, quote string"
    old = [(1, "SUPERSEDED", "x", a, "f.py", "h1", "q"), (2, "ACTIVE", "x", None, "f.py", "h2", "r"), (3, "SUPERSEDED", "x", b, "f.py", "h1", "q"), (4, "ACTIVE", "x", None, "f.py", "h1", None), (5, "SUPERSEDED", "x", a, "f.py", None, None), (6, "ACTIVE", "x", a[:8], "g.py", None, None)]
    chains = spark.createDataFrame([(1, 2), (3, 4), (5, 6), (2, 2)], "id long, terminal_id long")
    assert [(r.id, r.replacement_id, r.label) for r in blame.outlived(spark.createDataFrame(old, kind), chains, blamed).collect()] == [(1, 2, "f.py#L1-L2")]
