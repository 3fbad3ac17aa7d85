import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import words
from memloom.operators import consolidate, ordered, rollups, search


def test_running_numbers_sums_and_maxima(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None, "hot", "hot", "hot"]), i, rnd.randint(-5, 5) if rnd.random() < 0.8 else None) for i in rnd.sample(range(1000), 400)]
    got = ordered.running(spark.createDataFrame(rows, "g string, o long, v long").repartition(7), ["g"], ["o"], sums={"before": "v"}, highest={"top": "v"}).collect()
    want = []
    for g, o, v in rows:
        ahead = [x for h, p, x in rows if h == g and p < o]
        told = [x for x in ahead if x is not None]
        want.append((g, o, v, len(ahead), sum(told), max(told, default=None)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert ordered.running(spark.createDataFrame([], "g string, o long"), ["g"], ["o"]).collect() == []


@pytest.mark.parametrize("hot", [False, True])
def test_consolidation_of_copies_and_clusters(spark, monkeypatch, hot):
    monkeypatch.setattr(consolidate, "SHARE", 8)
    monkeypatch.setattr(consolidate, "CHUNK", 16 if hot else 2048)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 24))
    x[200:] = x[rng.integers(0, 60, size=100)] + rng.normal(size=(100, 24)) * rng.uniform(0, 0.7, size=(100, 1))
    if hot:  # a dense cluster beyond one chunk, and one vector with a third of all rows
        x[40:100] = x[0] + rng.normal(size=(60, 24)) * 0.05
        x[100:200] = x[1]
    else:
        x[100:130] = x[2]
        x[150:180] = x[2] + 0.001
    x = x[rng.permutation(300)]
    rows = [(i * 3 - 100, v.tolist()) for i, v in enumerate(x)] + [(5000, [1.0, 2.0]), (5001, [1.0, 2.1]), (5002, None), (5003, [1.0] * 24), (5004, [float("nan")] * 23 + [1.0]), (None, x[0].tolist())]
    sound = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) in (2, 24) and not np.isnan(v).any() and max(v) - min(v) > 1e-9]
    want = {}
    for j, b in sound:
        near = [i for i, a in sound if i < j and len(a) == len(b) and 1 - a @ b / np.sqrt((a @ a) * (b @ b)) <= 0.15]
        if near:
            want[j] = max(near)
    got = {r.id: r.superseded_by for r in consolidate.consolidation(spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)).collect()}
    assert got == want and len(want) > 80


def test_hashes_grow_with_the_table():
    widths = [consolidate.hashes(n, 0.85) for n in (10, 10_000, 1_000_000, 100_000_000)]
    buckets = [(2 * d) ** w for d, w, _ in widths]
    assert buckets[0] <= 16 and all(n / b <= 3 * consolidate.SHARE for n, b in zip((10, 10_000, 1_000_000, 100_000_000), buckets))
    # A pair at the threshold misses all tables less than once in a million.
    assert all((1 - consolidate.meeting_chance(0.85, d) ** w) ** t <= 1e-6 for d, w, t in widths)


def test_blocks_and_cells_give_what_one_block_gives(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(150)] + [(500 + i, [1.0, float(i), 0.0]) for i in range(9)] + [(900, None), (901, []), (None, [1.0] * 8), (902, [0.0] * 8)]
    table = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)
    asked = table.where("id % 10 = 0 OR id IN (501, 900, 902)")
    whole = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in search.nearest(table, asked, k=4).collect()}
    parts = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in search.nearest(table, asked, k=4, block=5, cell=20, step=3).collect()}
    assert whole == parts and len([q for q, _ in whole if q == 501]) == 4 and not any(q == 900 for q, _ in whole)
    assert search.nearest(table, asked.limit(0), k=4).collect() == []


def test_windows_of_one_hot_session_and_project(spark):
    # Sessions interleaved in one project: runs of one turn each, beside a run of many.
    rows = [(i, "p", (i % 3 if i < 90 else 7) if i % 11 else None, "lesson", f"[x] USER: turn {i}") for i in range(400)]
    t = spark.createDataFrame(rows, "id long, project string, session_id int, category string, content string").repartition(6)
    got = {r.id: (r.session_id, r.position, r.window_index) for r in rollups.turns(t).collect()}
    want, place, window, last, inside = {}, {}, {}, "none yet", 0
    for i, _, s, _, _ in rows:
        place[s] = place.get(s, -1) + 1
        if s != last:
            inside = 0
            window[s] = window.get(s, -1) + 1
        elif inside % rollups.WINDOW == 0:
            window[s] += 1
        inside, last = inside + 1, s
        want[i] = (s, place[s], window[s])
    assert got == want
    assert "SinglePartition" not in rollups.turns(t.withColumn("project", F.lit("p")))._jdf.queryExecution().toString()


def test_rows_meet_questions_in_their_own_task(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 40)
    rnd = random.Random(4)
    words_ = ["flies", "running", "stopped", "boxes", "values", "trees", "glass", "note", "agreed", "x_1", "é", "A"]
    rows = spark.createDataFrame([(f"d{i}", " ".join(rnd.choices(words_, k=rnd.randint(0, 9))) if i % 17 else None) for i in range(120)], "id string, content string").repartition(5)
    asked = spark.createDataFrame([(q, " ".join(rnd.choices(words_, k=4))) for q in range(9)] + [(90, None), (91, "nowhere")], "query_id int, query string")
    found = search.matches(rows, asked)
    # Pairs of rows and questions are never shuffled.
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    every = {(r.query_id, r.id): (r.score, r.n_terms) for r in found.collect()}
    want = {}
    texts = {r.id: [t for t in spark_words(r.content) if len(t) >= 2] for r in rows.collect()}
    questions = {r.query_id: {words.stem_word(t) for t in spark_words(r.query) if len(t) >= 2} for r in asked.collect()}
    n, average = len(texts), sum(map(len, texts.values())) / len(texts)
    held = {i: [words.stem_word(t) for t in ts] for i, ts in texts.items()}
    df = {s: sum(s in h for h in held.values()) for q in questions.values() for s in q}
    for q, stems in questions.items():
        for i, h in held.items():
            if both := [s for s in stems if s in h]:
                part = lambda s: max(math.log((n - df[s] + 0.5) / (df[s] + 0.5)), 1e-6) * h.count(s) * 2.2 / (h.count(s) + 1.2 * (0.25 + 0.75 * len(h) / average))  # noqa: B023, E731
                want[q, i] = (round(sum(map(part, both)), 6), len(both))
    assert every == want and len(want) > 300
    for by, newest in (("score", True), ("n_terms", False)):
        ties = F.desc("id") if newest else "id"
        best = search.best(found.withColumn("score", F.col(by).cast("double")), "score", 5, ties).select("query_id", "id", "score", "rank")
        got = search.top(search.prepared(rows, asked), by, 5, newest=newest)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, best.collect()))
    # Several blocks of questions give the same.
    monkeypatch.setattr(search, "BLOCK", 3)
    assert {(r.query_id, r.id): (r.score, r.n_terms) for r in search.matches(rows, asked).collect()} == want
    assert search.bm25(rows, asked.where("query_id > 89"), k=3).collect() == [] == search.matches(rows, asked.where("query_id = 90")).collect()


def spark_words(text):
    return re.split("[^a-z0-9_]+", (text or "").lower())


def test_stems_of_words_are_those_of_the_expression(spark):
    rnd = random.Random(5)
    ends = ["ies", "ing", "ed", "es", "s", "tes", "les", "res", "ves", "ss", "us", "is", "e", "ee", "", "sses", "nning", "tted"]
    ws = ["".join(rnd.choices("abe1_s", k=rnd.randint(0, 5))) + rnd.choice(ends) for _ in range(4000)]
    got = spark.createDataFrame([(w,) for w in ws], "w string").select("w", words.stem(F.col("w")).alias("s")).collect()
    assert [r for r in got if words.stem_word(r.w) != r.s] == []
