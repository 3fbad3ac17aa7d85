import random
import re

import pytest
from pyspark.sql import types as T

from memloom.llm import decontam

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("items", T.StringType()), T.StructField("n_hit", T.LongType())])
BENCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.LongType())])


def brute(text, items, window=13):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    find = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)
    ws, hit, got = find(lower), set(), set()
    for item, t in items:
        it = find("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n = min(window, len(it))
        for i in range(len(it) - n + 1) if n else ():
            for k in range(len(ws) - n + 1):
                if ws[k : k + n] == it[i : i + n]:
                    hit |= set(range(k, k + n))
                    got |= {str(item)} - {"None"}
    return len(ws), len(hit), sorted(got), bool(hit) and 20 * len(hit) >= len(ws)


def cases():
    r = random.Random(1)
    vocab = ["alpha", "Beta", "é2", "ÉA", "x", "42", "ñandú"]
    say = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", " -", ". "]) for _ in range(n))
    items = [(1, say(20)), (2, "Alpha, beta x!"), (3, None), (4, "..."), (None, say(15)), (2, "ÉA 42 x x"), (10, say(14))]
    docs = [(1, say(40) + items[0][1].upper() + say(5)), (2, None), (3, ""), (4, "alpha beta x"), (5, say(3000)), (6, items[4][1]), (7, items[6][1] + " " + say(400)), (7, "same"), (7, "same")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 0) for i, t in items], BENCH)


def test_equals_brute_force_in_one_or_many_shards(spark):
    docs, items = cases()
    d, b = frames(spark, docs, items)
    spans = []
    for shard_words in (200_000, 16):
        rows = decontam.decontaminate(d, b, shard_words=shard_words).collect()
        spans.append(sorted((r.doc_id, r.text or "", [tuple(s) for s in r.overlap.spans], list(r.overlap.hit_words)) for r in rows))
        got = sorted((r.doc_id, r.text or "", r.overlap.n_words, r.overlap.n_hit, list(r.overlap["items"]), r.overlap.contaminated) for r in rows)
        assert got == sorted((i, t or "", *brute(t, items)) for i, t in docs)
        assert all(r["items"] == "clash" and r["n_hit"] == 5 for r in rows)
    assert spans[0] == spans[1]


def test_long_items_are_cut_with_their_windows_whole(spark):
    _, b = frames(spark, [], [(1, " ".join(f"w{i}" for i in range(50))), (2, "a b")])
    got = [piece for shard in decontam.shards(b, "item_id", "text", 13, 20) for piece in shard]
    runs = {tuple(p[i : i + 13]) for item, p in got if item == "1" for i in range(len(p) - 12)}
    assert runs == {tuple(f"w{i}".encode() for i in range(k, k + 13)) for k in range(38)} and all(len(p) <= 20 for _, p in got)


def test_a_column_is_never_replaced(spark):
    d, b = frames(spark, [(1, "a")], [])
    with pytest.raises(ValueError, match="n_hit"):
        decontam.decontaminate(d, b, into="n_hit")


def test_spans_point_into_the_original(spark):
    d, b = frames(spark, [(1, "É: (Alpha,  BETA) x. rest")], [(2, "alpha beta x")])
    (r,) = decontam.decontaminate(d, b).collect()
    assert [r.text[s.start : s.end] for s in r.overlap.spans] == ["Alpha,  BETA) x"]


def test_empty_tables(spark):
    d, b = frames(spark, [], [])
    assert decontam.decontaminate(d, b).collect() == []
    d, _ = frames(spark, [(1, "a b")], [])
    (r,) = decontam.decontaminate(d, b).collect()
    assert (r.overlap.n_words, r.overlap.n_hit, r.overlap.contaminated) == (2, 0, False)
