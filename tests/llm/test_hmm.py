import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from memloom.llm import hmm

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("block", T.StringType()), T.StructField("total", T.LongType())])


def toy(states=hmm.STATES, seed=0):
    r = np.random.default_rng(seed)
    rows = lambda *n: (lambda x: x / x.sum(-1, keepdims=True))(r.uniform(0.1, 1, n))
    return {"first": rows(states), "move": rows(states, states), "emit": rows(states, hmm.FORMS + 1)}


def test_forward_equals_the_sum_over_all_paths():
    m, seqs = toy(), [[5], [5, 9, 4096], [0, 1, 2, 3]]
    for got, s in zip(hmm.forward(m, [np.array(x) for x in seqs]), seqs, strict=True):
        p = sum(
            m["first"][path[0]] * math.prod(m["emit"][k, x] for k, x in zip(path, s)) * math.prod(m["move"][a, b] for a, b in itertools.pairwise(path))
            for path in itertools.product(range(hmm.STATES), repeat=len(s))
        )
        assert math.isclose(got, math.log10(p), rel_tol=1e-9)


def test_baum_welch_raises_the_likelihood():
    r = random.Random(1)
    seqs = [np.array([r.choice([1, 2, 3] if i % 2 else [7, 8, 9]) for _ in range(40)] + [4096]) for i in range(60)]
    grid, opening = hmm.cut(seqs)
    m, last = hmm.start(), -math.inf
    for _ in range(6):
        m = hmm.better(hmm.expected(m, grid, opening))
        now = hmm.forward(m, seqs).sum()
        assert now > last
        last = now


def brute(docs):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up)), None] for _, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    c = Counter(w for ws, h in zip(toks, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (i, _), ws, h in zip(docs, toks, held, strict=True)]


def test_base_equals_brute_force_and_the_model_beats_it(spark, monkeypatch):
    r = random.Random(7)
    tongue = [[f"{a}{b}{s}" for a in "bdfg" for b in "aeiou"] for s in ("tion", "keit", "ment")]
    docs = [(i, " ".join(r.choice(tongue[i % 3]) + r.choice(["", ",", "."]) for _ in range(r.randint(5, 80)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "ÉCOLE école Bation\tbation\x0b x"), (303, "w " * 20_000), (303, "w"), (None, "no id"), (None, "no id")]
    out = hmm.score(spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], SCHEMA)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    got, want = sorted((tuple(x) for x in out), key=key), sorted(brute(docs), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(math.isfinite(g[6]) for g in got)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_empty_table_and_no_training_rows(spark):
    assert hmm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = hmm.score(spark.createDataFrame([(held, "a b", None, None)], SCHEMA)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert math.isclose(r.base_score, 0) and math.isfinite(r.score)
