import numpy as np
from pyspark.sql import types as T

from memloom.llm import capfilter

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("c", T.StringType())])


def near(x, cos, r):
    e = r.normal(size=x.shape)
    e -= (e * x).sum(-1, keepdims=True) * x
    return cos * x + np.sqrt(1 - cos**2) * e / np.linalg.norm(e, axis=-1, keepdims=True)


def vectors():
    r = np.random.default_rng(4)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(r.normal(size=(n, 16)))
    x = unit(300)
    group = near(np.repeat(x[:1], 700, 0), 0.985, r)  # larger than a chunk
    out = [*x, *group, *near(x[1:120], 0.952, r), *near(x[120:200], 0.948, r), *np.repeat(x[5:6], 20, 0), *(3 * x[6:8])]
    return [v.astype(np.float32).tolist() for v in out] + [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0], [7.0]]


def brute(rows):
    n = len(rows)
    ok = [i for i, v in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, least = [0] * n, list(range(n))
    for d in {len(rows[i]) for i in ok}:
        mine = [i for i in ok if len(rows[i]) == d]
        x = np.array([rows[i] for i in mine], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near_ = x @ x.T >= 0.95
        np.fill_diagonal(near_, False)
        root = np.array(mine)
        while True:
            new = np.where(near_, root[None, :], n).min(1)
            new = np.minimum(root, new)
            if (new == root).all():
                break
            root = new
        for k, i in enumerate(mine):
            links[i], least[i] = int(near_[k].sum()), int(root[k])
    return [(i, links[i], least[i], least[i] == i) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors()
    got = capfilter.near_vectors(spark.createDataFrame([(i, v, 0, "clash") for i, v in enumerate(rows)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def exhaustive(x, code, words):
    """All directions above the cap and the LEAST best, from the scores of every direction."""
    turn, books = capfilter.codebook(code, x.shape[1], words)
    y, at, total = x @ turn, 0, np.zeros((len(x), 1))
    for b in books:
        total = (total[:, :, None] + (y[:, at : at + b.shape[1]] @ b.T)[:, None, :]).reshape(len(x), -1)
        at += b.shape[1]
    cap = capfilter.tail(min(0.4, capfilter.LEAST / total.shape[1])) * np.sqrt(len(books) / x.shape[1])
    return total, [set(np.flatnonzero(s >= cap)) | set(np.argsort(-s)[: capfilter.LEAST]) for s in total]


def test_list_decoding_equals_all_scores():
    r = np.random.default_rng(2)
    for dim, words in ((64, 32), (16, 8), (3, 8), (2, 4), (1, 8)):
        x = r.normal(size=(200, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        row, f = capfilter.decode(x, 1, words)
        scores, want = exhaustive(x, 1, words)
        for i in range(200):  # directions may tie, their scores not
            assert np.allclose(sorted(scores[i, f[row == i]]), sorted(scores[i, list(want[i])])), dim


def test_pairs_at_the_threshold_are_found():
    r = np.random.default_rng(9)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = near(x, 0.95, r)
    for words in (16, 64, 512, 2048):  # up to more than 100 million classes
        hit, lists = np.zeros(3000, dtype=bool), 0
        for code in range(capfilter.codes_for(64, words, 0.95)):
            (i, a), (j, b) = capfilter.decode(x, code, words), capfilter.decode(y, code, words)
            both = np.intersect1d(i * words**2 + a, j * words**2 + b)
            hit[both // words**2] = True
            lists += len(a) / 3000
        assert hit.mean() >= 0.998 and lists < 12 * capfilter.codes_for(64, words, 0.95), words


def test_empty_and_null_ids(spark):
    assert capfilter.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    got = capfilter.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1, None), (4, [1.0, 0.0], 1, None), (4, [1.0, 0.0], 1, None)], SCHEMA)).collect()
    assert sorted((r.n_links, r.component_id) for r in got) == [(2, 4)] * 3
