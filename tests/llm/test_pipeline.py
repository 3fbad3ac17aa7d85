import random
import re
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_decontam import brute as overlap_of
from test_neardup import least_ids, word_sets
from test_packing import direct
from test_pii import brute as spans_of

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(seed, n):
    return " ".join(f"{chr(97 + (seed * 7 + i * i) % 26)}{chr(97 + (i * 5 + seed) % 26)}{i % 10}x" for i in range(n))


def test_stages_decide(spark, tmp_path):
    quiz = words(99, 30)
    rows = [
        (1, words(1, 60), "en"), (2, words(1, 60), "en"), (3, words(1, 59) + " changed", "en"), (4, words(2, 60) + " mail a@b.example now", "en"),
        (5, "12345 !!", "en"), (6, None, "en"), (7, words(3, 40) + " " + quiz, "en"), (8, words(4, 900) + " " + " ".join(quiz.split()[:14]), "en"),
    ]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, quiz)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert kept == [[1, 2, 3, 4, 7, 8], [1, 4, 7, 8], [1, 4, 8], [1, 4, 8]]
    assert docs.where("doc_id = 4").first().text.endswith("mail [EMAIL] now")
    assert docs.where("doc_id = 1").first().text == rows[0][1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {1, 4, 8} and {r.sequence_id for r in packed} == set(range(len({r.sequence_id for r in packed})))


def near_rows(rows):
    """One row of each group of near-duplicate rows, by comparing all pairs."""
    sets = word_sets([(i, r[1]) for i, r in enumerate(rows)], 5)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = least_ids(len(rows), links, list(range(len(rows))))
    first = {}
    for i, r in enumerate(rows):
        first[group[i]] = min(first.get(group[i], (True, 0, i)), (r[0] is None, r[0] or 0, i)) if group[i] in first else (r[0] is None, r[0] or 0, i)
    return [rows[i] for _, _, i in sorted(first.values(), key=lambda x: x[2])]


def redacted(text):
    spans = sorted((int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans_of(text)))
    out, at = "", 0
    for lo, hi, kind in spans:
        if lo >= at:
            out += text[at:lo] + f"[{kind.upper()}]"
        at = max(at, hi)
    return out + text[at:]


def corpus():
    r = random.Random(8)
    say = lambda n: " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice('aeiou')}{r.randint(0, 9)}" for _ in range(n))
    quiz = [(1, say(30)), (2, say(5)), (None, say(20))]
    texts = [say(r.randint(1, 120)) for _ in range(60)]
    texts += [t.upper() for t in texts[:5]] + [f"{t} added" for t in texts[5:15]] + ["", None, "123 !?", "short", "short", "x " * 9000]
    texts += [f"{say(20)} {quiz[0][1]}", f"{say(900)} {quiz[1][1]}", quiz[2][1], f"{say(10)} a@b.example +1 (702) 555-0742 and 10.0.0.1", say(4000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "other words under an id seen before"), (None, texts[20]), (None, None), (None, "no id"), (7, texts[7]), (90, texts[30]), (95, texts[30] + " b"), (95, "kept although its id goes once")]
    r.shuffle(rows)
    return [(i, t, r.choice(["p", "q", None]), f"s{k}", len(t or ""), "clash", k, "clash") for k, (i, t) in enumerate(rows)], quiz


WIDE = T.StructType([*SCHEMA.fields, T.StructField("language", T.StringType()), T.StructField("row", T.LongType()), T.StructField("pii", T.StringType())])


def test_every_stage_equals_brute_force(spark, tmp_path):
    rows, quiz = corpus()
    spark.createDataFrame(quiz, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, want = spark.createDataFrame(rows, WIDE).coalesce(1), rows
    stages = dict(corpus_pipeline.STAGES)
    wanted = {
        "language ID": lambda rs: [r for r in rs if re.search(r"[^\W\d_]", r[1] or "")],
        "near-duplicates": near_rows,
        "decontamination": lambda rs: [r for r in rs if not overlap_of(r[1], quiz)[3]],
        "personal data": lambda rs: [(r[0], redacted(r[1]), r[2], r[3], len(redacted(r[1])), *r[5:]) for r in rs],
    }
    for i, (name, by) in enumerate(wanted.items()):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == WIDE.names
        out.coalesce(1).write.parquet(f"{tmp_path}/out{i}")
        docs, want = spark.read.parquet(f"{tmp_path}/out{i}"), by(want)
        found = [tuple(r) for r in docs.collect()]
        if not i:  # the language found replaces the label
            assert {r[2] for r in found} <= {"p", "q"}
            lang = {r[6]: r[2] for r in found}
            want = [(*r[:2], lang[r[6]], *r[3:]) for r in want]
        assert sorted(found, key=str) == sorted(want, key=str), name
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    ids = {(r[0], n): [np.array([*direct(r[1]), 1], "<u4")] for n, r in enumerate(want)}
    tokens = sorted((str(k[0]), len(v[0])) for k, v in ids.items())
    assert sorted((str(r.doc_id), r.doc_tokens) for r in packed if r.start == 0) == tokens
    digests = {(k[0], at, n, zlib.crc32(v[0][at : at + n].tobytes())) for k, v in ids.items() for at, n in {(r.start, r.length) for r in packed if r.doc_id == k[0]}}
    assert all((r.doc_id, r.start, r.length, r.ids_crc32) in digests for r in packed) and sum(r.length for r in packed) == sum(n for _, n in tokens)


def test_corpora_without_labels_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([(1, "some words", None, "s", 10), (2, "12", None, "s", 2), (3, None, "en", "s", 0)], SCHEMA)
    assert [(r.doc_id, r.lang) for r in corpus_pipeline.language(spark, none, str(tmp_path)).collect()] == [(1, None)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.limit(0), str(tmp_path)).collect() == []
    kept = corpus_pipeline.decontaminate(spark, none, str(tmp_path))
    assert sorted(r.doc_id for r in corpus_pipeline.personal_data(spark, kept, str(tmp_path)).where(F.col("n_chars") >= 0).collect()) == [1, 2, 3]
