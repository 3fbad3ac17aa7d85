import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from memloom.llm import neardup
from memloom.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("c", T.StringType()), T.StructField("component_id", T.LongType())])
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(docs, k):
    out = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def least_ids(n, links, ids):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(n)]


def brute(docs, k, percent):
    sets = word_sets(docs, k)
    links = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [(i, len(s), c, c == i) for (i, _), s, c in zip(docs, sets, least_ids(len(docs), links, [i for i, _ in docs]), strict=True)]


def corpus():
    r = random.Random(5)
    say = lambda n: [f"w{r.randint(0, 500)}" for _ in range(n)]
    docs, base = [], say(200)
    for i in range(60):  # one large group of near copies, chained away from each other
        base = list(base)
        base[r.randrange(200)] = f"new{i}"
        docs.append(" ".join(base))
    docs += [" ".join(say(50)) for _ in range(40)] + ["One TWO three"] * 5 + ["one two three", "a", "A", "a b", "", None, None, " \t\n", "x " * 5000, "x " * 50]
    r.shuffle(docs)
    return list(enumerate(docs)) + [(0, docs[0]), (3, "another text with an id seen before")]


def rows(spark, docs):
    return spark.createDataFrame([(i, t, "clash", -1) for i, t in docs], SCHEMA)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 40)  # so that nodes of the small corpus branch on
    monkeypatch.setattr(neardup, "CHUNK", 10)
    docs = corpus()
    for k, percent in ((3, 85), (5, 80)):
        got = sorted(tuple(r) for r in neardup.near_duplicates(rows(spark, docs), k=k, threshold=percent / 100).collect())
        assert got == sorted(brute(docs, k, percent))


def pairs_in_one_passage(n, passage, pair, own):
    """Pairs of texts with similarity (passage + pair) / (passage + pair + 2 own), which all share a passage; words in no order."""
    say = lambda name, k: " ".join(f"{name}x{i}" for i in range(k))
    return [(2 * i + j, f"{say('all', passage)} {say(f'pair{i}', pair)} {say(f'own{i}y{j}', own)}") for i in range(n) for j in (0, 1)]


def test_pairs_at_the_threshold_in_large_nodes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 10)
    monkeypatch.setattr(neardup, "CHUNK", 50)
    got = neardup.near_duplicates(rows(spark, pairs_in_one_passage(200, 148, 12, 20)), k=1, threshold=0.8).collect()
    assert len(got) == 400 and [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2] == []


def planted(n, r):
    """Pairs of random sets of similarity 0.8 to 0.9, and the 64-bit hashes of their members."""
    out = []
    for _ in range(n):
        size = r.integers(40, 400)
        own = int(round(size * (1 - (s := r.uniform(0.8, 0.9))) / (1 + s)))
        x = r.integers(0, 2**64, size + own, dtype=np.uint64)
        out.append((np.unique(x[:size]), np.unique(x[own:])))
    return out


def test_recall_of_the_trees_at_and_above_the_threshold():
    """The whole way of a pair before its sets are compared: a common node in some tree, and minwise values that may be linked."""
    r, n = np.random.default_rng(7), 4000
    pairs = planted(n, r)
    sim = np.array([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in pairs])
    x, y = (np.array([neardup.minwise(p[k]) for p in pairs]) for k in (0, 1))
    roots = neardup.mix(np.arange(1, neardup.TREES + 1, dtype=np.uint64))
    met = np.zeros(n, dtype=bool)
    for lo in range(0, n, 500):
        nodes = [neardup.descend(np.tile(roots, 500), np.repeat(np.arange(500), neardup.TREES), s[lo : lo + 500], 0.8, neardup.DEPTH) for s in (x, y)]
        both = set(zip(*(v.tolist() for v in nodes[0]), strict=True)) & set(zip(*(v.tolist() for v in nodes[1]), strict=True))
        met[[lo + k for _, k in both]] = True
    rows = pd.DataFrame({"node": np.repeat(np.arange(n), 2), "i": 0, "j": 0, "chunk": 0, "label": np.arange(2 * n), "sig": [s[i].tobytes() for i in range(n) for s in (x, y)]})
    i, j = neardup.likely(rows, 0.8)
    may = np.zeros(n, dtype=bool)
    may[i // 2] = True
    assert (j == i + 1).all()
    at = sim >= 0.8
    assert at.sum() > 1000 and (met & may)[at].mean() >= 0.995


def test_likely_pairs_are_the_same_in_small_and_large_groups(monkeypatch):
    r = np.random.default_rng(3)
    base = np.array([neardup.minwise(np.unique(r.integers(0, 2**64, 50, dtype=np.uint64))) for _ in range(40)])
    sig = base[r.integers(0, 40, 600)]
    sig[r.random(sig.shape) < 0.1] = 7
    rows = pd.DataFrame({"node": np.sort(r.integers(0, 9, 600)), "i": 0, "j": r.integers(0, 2), "chunk": r.integers(0, 2, 600), "label": r.integers(0, 400, 600), "sig": [s.tobytes() for s in sig]})
    want = []
    for a in range(600):
        for b in range(a + 1, 600):
            one, other = rows.iloc[a], rows.iloc[b]
            if one.node == other.node and one.label != other.label and (one.i == one.j or one.chunk != other.chunk) and (sig[a] == sig[b]).sum() >= 128 * 0.8 - 4 * (128 * 0.16) ** 0.5:
                want.append((a, b))
    for wide, pairs in ((1000, 500_000), (1000, 50), (0, 500_000), (64, 500_000)):
        monkeypatch.setattr(neardup, "WIDE", wide)
        monkeypatch.setattr(neardup, "PAIRS", pairs)
        assert set(zip(*(x.tolist() for x in neardup.likely(rows, 0.8)), strict=True)) == set(want) and len(want) > 100


def test_large_sets_and_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_SHINGLES", 300)  # a few sets a chunk
    docs = [(f"id{i:03}" if i else None, t) for i, (_, t) in enumerate(corpus())]
    kind = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())])
    got = {(r.doc_id, r.n_shingles): r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs[1:], kind), k=5, threshold=0.8).collect()}
    assert got == {(i, n): c for i, n, c, _ in brute(docs[1:], 5, 80)}


def test_empty_table(spark):
    assert neardup.near_duplicates(rows(spark, [])).collect() == []


def test_null_ids_link_too(spark):
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(rows(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (None, "z")])).collect()}
    assert got == {(None, 7, True), (7, 7, True), (None, None, True)}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(1000, 1200), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_that_several_trees_find_are_one(spark):
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 2**32, size=(6, neardup.COORDS), dtype=np.uint32)
    sig[1], sig[3] = sig[0], sig[2]  # classes 0 and 1, and 2 and 3, are likely pairs; 4 and 5 met by chance
    classes = spark.createDataFrame([(c, sig[c].tobytes()) for c in range(6)], "c long, sig binary")
    nodes = {10: [0, 1, 2, 3], 20: [1, 0, 4], 30: [3, 2, 5, 0], 40: [4, 5]}
    front = spark.createDataFrame([(n, c, 9, len(cs), 9 * len(cs), c) for n, cs in nodes.items() for c in cs], "node long, c long, size long, n long, mass long, label long")
    got = {}
    for r in neardup.active(front, classes, 0.85).collect():
        got.setdefault((r.node, r.i, r.j), []).append(r.c)
    assert sorted(map(sorted, got.values())) == [[0, 1], [2, 3]]


def test_names_of_groups():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 400):
        c = rng.permutation(10 * n)[:n]
        i, j = rng.integers(0, n, size=(2, n // 2))
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist()):
            root[find(a)] = find(b)
        want = {}
        for x in range(n):
            want.setdefault(find(x), set()).add(int(c[x]))
        name = neardup.grouped(c, i, j)
        got = {}
        for x in range(n):
            got.setdefault(name[x], set()).add(int(c[x]))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        order = rng.permutation(n)
        place = np.argsort(order)
        assert (neardup.grouped(c[order], place[i], place[j]) == name[order]).all()
