"""Near-duplicate vectors by spherical-cap filters.

Filter directions come from random product codes: after a random rotation the space is cut into two blocks with a
codebook each, and a direction joins one word of each.  A vector is list-decoded: each block's words are sorted by their
scores, and only sums above the cap are walked, so the work follows the list and not the code.  It goes to every
direction whose cap holds it, and to its ``LEAST`` best ones where fewer do, in each of several independent codes.
Vectors that share a direction are compared; a pair counts only at its first common direction.  A pair at the threshold
shares about nine directions and is missed less than once in 1,000 (measured in the tests).

Equal vectors form one class first.  The code grows with the number of classes, so that a direction keeps about
``BUCKET`` of them; a direction with more is cut into chunks of ``CHUNK`` rows, and pairs of chunks are compared, so no
task holds a hot direction.  Each comparison returns, per class, its number of new partners and one link to the least
class of its local component: at most one row for each row read.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths aren't compared; repeated rows are copies of one another; a null id never is the least of a group that
has another; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, table, written
from .components import components

LEAST, BUCKET, CHUNK = 4, 128, 512
#: Chance that a pair at the threshold shares no direction in any code.
MISS = 2e-4
#: float32 products may err by this much before the exact check in double precision.
SLACK = 1e-4


def codebook(code: int, dim: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    r = np.random.default_rng([20240301, code, dim, words])
    turn, _ = np.linalg.qr(r.normal(size=(dim, dim)))
    books = []
    for part in np.array_split(np.arange(dim), min(2, dim)):
        c = r.normal(size=(words, len(part)))
        books.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return turn, books


def tail(p: float) -> float:
    """The standard normal value exceeded with probability ``p``."""
    lo, hi = 0.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(mid / math.sqrt(2)) > p else (lo, mid)
    return lo


def decode(x: np.ndarray, code: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of each unit vector, in order: all directions whose cap holds it, and the LEAST best."""
    n, dim = x.shape
    turn, books = codebook(code, dim, words)
    y, at, scores = x @ turn, 0, []
    for b in books:
        scores.append(y[:, at : at + b.shape[1]] @ b.T)
        at += b.shape[1]
    if len(books) == 1:
        scores.append(np.zeros((n, 1)))
    total = words ** len(books)
    cap = tail(min(0.4, LEAST / total)) * math.sqrt(len(books) / dim)
    one, other = scores
    order = np.argsort(-other, axis=1)
    falling = np.take_along_axis(other, order, 1)
    width, last = other.shape[1], other.shape[1] - 1
    # List decoding: words of the first block that the best word of the second lifts over the cap, each with the second
    # block's words in falling order for as long as the sum stays above it.
    row, i = np.nonzero(one >= cap - falling[:, :1])
    least, rows, found, k = cap - one[row, i], [], [], 0
    while len(row):
        inside = falling[row, k] >= least
        row, i, least = row[inside], i[inside], least[inside]
        rows.append(row)
        found.append(i * width + order[row, k])
        k += 1
        if k > last:
            break
    # The best sums lie among the best words of both blocks.
    top, few = np.argsort(-one, axis=1)[:, :LEAST], order[:, :LEAST]
    sums = (np.take_along_axis(one, top, 1)[:, :, None] + falling[:, None, : few.shape[1]]).reshape(n, -1)
    best = np.argsort(-sums, axis=1, kind="stable")[:, :LEAST]
    where = (top[:, :, None] * width + few[:, None, :]).reshape(n, -1)
    rows.append(np.repeat(np.arange(n), best.shape[1]))
    found.append(np.take_along_axis(where, best, 1).ravel())
    both = np.unique(np.concatenate(rows).astype(np.int64) * total + np.concatenate(found))
    return both // total, both % total


def near_pairs(dim: int, threshold: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and others at the threshold from them."""
    r = np.random.default_rng([20240302, dim, n])
    x, e = r.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e -= (e * x).sum(1, keepdims=True) * x
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
    return x, threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * e


@functools.lru_cache(maxsize=64)
def codes_for(dim: int, words: int, threshold: float) -> int:
    """Independent codes that bring the chance of a miss at the threshold to ``MISS``, from one code's misses on 1,000 random pairs."""
    x, y = near_pairs(dim, threshold, 1000)
    total = words ** min(2, dim)
    (i, a), (j, b) = decode(x, 0, words), decode(y, 0, words)
    met = len(np.unique(np.intersect1d(i * total + a, j * total + b) // total))
    return max(1, math.ceil(math.log(MISS) / math.log((1003 - met) / 1003.0001)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def filtered(classes: DataFrame, words: int, threshold: float, width: str) -> DataFrame:
    """(f, c, m, v, fs): one row for each class and direction; fs holds all directions of the class."""
    kind = np.dtype(width)

    def run(batches):
        for pdf in batches:
            vectors = [np.asarray(v, dtype=kind) for v in pdf["v"]]
            sizes, c, m = np.array([len(v) for v in vectors], dtype=np.int64), pdf["c"].to_numpy(), pdf["m"].to_numpy()
            for dim in np.unique(sizes).tolist():
                same, codes = np.flatnonzero(sizes == dim), codes_for(dim, words, threshold)
                for lo in range(0, len(same), 1000):
                    part = same[lo : lo + 1000]
                    x = unit(np.stack([vectors[i] for i in part]))
                    lists = [decode(x, code, words) for code in range(codes)]
                    of = np.concatenate([r for r, _ in lists])
                    f = np.concatenate([np.int64((dim * 4096 + code) * words * words) + d for code, (_, d) in enumerate(lists)])
                    by = np.lexsort((f, of))
                    of, f = of[by], f[by]
                    edge, raw = np.searchsorted(of, np.arange(len(part) + 1)) * 8, f.astype("<i8").tobytes()
                    v = np.array([vectors[i].tobytes() for i in part] + [None], dtype=object)[:-1]
                    fs = np.array([raw[edge[k] : edge[k + 1]] for k in range(len(part))] + [None], dtype=object)[:-1]
                    yield pd.DataFrame({"f": f, "c": c[part][of], "m": m[part][of], "v": v[of], "fs": fs[of]})

    return classes.mapInPandas(run, "f long, c long, m long, v binary, fs binary")


def met_before(fs: np.ndarray, f: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the rows of each pair share a direction before ``f``: they were counted there."""
    mine = np.unique(np.concatenate([i, j]))
    lists = [np.frombuffer(b, dtype="<i8") for b in fs[mine]]
    flat, of = np.concatenate(lists), np.repeat(np.arange(len(mine)), [len(x) for x in lists])
    flat, of = flat[flat < f], of[flat < f]
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    # One bit for each direction that several rows have.
    bit = (np.cumsum(count > 1) - 1)[at]
    of, bit = of[(count > 1)[at]], bit[(count > 1)[at]]
    bits = np.zeros((len(mine), int(bit.max(initial=0)) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (of, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    i, j, out = np.searchsorted(mine, i), np.searchsorted(mine, j), np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), 20_000):
        out[k : k + 20_000] = (bits[i[k : k + 20_000]] & bits[j[k : k + 20_000]]).any(1)
    return out


def compare(rows: dict[str, np.ndarray], lo: int, hi: int, cross: bool, threshold: float, kind: np.dtype) -> tuple[np.ndarray, ...] | None:
    """(c, n, root) of one direction's rows ``lo`` to ``hi``: new partners, and the least class linked here; None without links."""
    x = unit(np.frombuffer(b"".join(rows["v"][lo:hi]), dtype=kind).reshape(hi - lo, -1))
    low = x.astype(np.float32)
    near = low @ low.T >= threshold - SLACK
    if np.count_nonzero(near) <= hi - lo:  # each with itself alone
        return None
    near = np.triu(near, 1)
    if cross:
        chunk = rows["chunk"][lo:hi]
        near &= chunk[:, None] != chunk[None, :]
    i, j = np.nonzero(near)
    ok = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), 100_000):
        ok[k : k + 100_000] = np.einsum("ij,ij->i", x[i[k : k + 100_000]], x[j[k : k + 100_000]]) >= threshold
    i, j = i[ok], j[ok]
    if not len(i):
        return None
    c, m, f = rows["c"][lo:hi], rows["m"][lo:hi], rows["f"][lo]
    first = ~met_before(rows["fs"][lo:hi], f, i, j)
    n = np.bincount(i[first], weights=m[j[first]], minlength=len(c)) + np.bincount(j[first], weights=m[i[first]], minlength=len(c))
    root = c.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            break
    touched = np.zeros(len(c), dtype=bool)
    touched[i] = touched[j] = True
    return c[touched], n[touched].astype(np.int64), root[touched]


def near_vectors(vectors: DataFrame, *, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``."""
    v = F.col(vector)
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    width = "float64" if vectors.schema[vector].dataType.elementType.simpleString() == "double" else "float32"
    kind = np.dtype(width)
    # Two hashes of 64 bits name a class; a number of 64 bits stands for it in all joins but the last.
    hashes = {"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}
    rows = vectors.select(F.col(key).alias("key"), F.when(sound, v).alias("v")).withColumns({k: F.when(F.col("v").isNotNull(), x) for k, x in hashes.items()})
    with scratch() as keep:
        classes = rows.where("v is not null").groupBy("h", "g").agg(F.count("*").alias("m"), F.min("key").alias("rep"), F.first("v").alias("v"))
        classes = written(classes.withColumn("c", F.monotonically_increasing_id()))
        # Directions in proportion to the classes, as words ** 2.
        words = int(max(8, 2 ** round(math.log2(max(1, classes.count()) * LEAST / BUCKET) / 2)))
        caps = written(filtered(classes.select("c", "m", "v"), words, threshold, width))
        sizes = written(caps.groupBy("f").count().where("count > 1").withColumn("k", F.ceil(F.col("count") / CHUNK)).select("f", "k"))
        chunked = caps.join(sizes, "f").withColumn("chunk", F.pmod(F.xxhash64("c"), "k"))
        # Chunk i meets every other chunk once; a direction of one chunk is compared as it is.
        dealt = chunked.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select(
            "f", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "c", "m", "v", "fs"
        )

        def run(batches):
            rest = None
            for pdf in batches:
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                if not len(pdf):
                    continue
                rest, done = None, []
                rows = {k: pdf[k].to_numpy() for k in pdf.columns}
                ids = np.stack([rows[k] for k in "fij"], axis=1)
                cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist()]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    done.append(compare(rows, lo, hi, ids[lo, 1] != ids[lo, 2], threshold, kind) if hi - lo > 1 else None)
                rest = pdf.iloc[cuts[-1] :]
                yield from result(done)
            if rest is not None and len(rest) > 1:
                rows = {k: rest[k].to_numpy() for k in rest.columns}
                yield from result([compare(rows, 0, len(rest), rows["i"][0] != rows["j"][0], threshold, kind)])

        def result(done):
            if done := [x for x in done if x]:
                yield pd.DataFrame({k: np.concatenate([x[n] for x in done]) for n, k in enumerate(("c", "n", "root"))})

        found = written(dealt.repartition(F.col("f"), F.col("i"), F.col("j")).sortWithinPartitions("f", "i", "j").mapInPandas(run, "c long, n long, root long"))
        label = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")).distinct()).select(F.col("id").alias("c"), F.col("component_id").alias("label"))
        partners = found.groupBy("c").agg(F.sum("n").alias("n"))
        known = written(classes.select("c", "h", "g", "m", "rep").join(partners, "c", "left").join(label, "c", "left").withColumn("label", F.coalesce("label", "c")))
        least = known.groupBy("label").agg(F.min("rep").alias("component_id"))
        known = keep(written(known.join(least, "label").select("h", "g", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")))
    out = rows.select("key", "h", "g").join(known, ["h", "g"], "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def op10_cap_filters(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
w AS (SELECT r AS a, r AS b FROM v UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b),
c AS (SELECT w.a AS r, min(v.vec_id) AS component_id FROM w JOIN v ON v.r = w.b GROUP BY w.a), n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""
