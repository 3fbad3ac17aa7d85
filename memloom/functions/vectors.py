"""Vectors as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Raw cosine -> score, linear between.
CURVE = [(0.0, 0.0), (0.12, 0.36), (0.38, 0.68), (0.60, 0.84), (1.0, 1.0)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or zero; the common prefix where lengths differ."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(x) * norm(y)
    return F.when((n <= 0) | (size == 0), 0.0).otherwise(dot(x, y) / size)


def calibrate(c: Column) -> Column:
    out = F.when(c <= 0, 0.0).when(c >= 1, 1.0)
    for (x0, y0), (x1, y1) in zip(CURVE, CURVE[1:]):
        out = out.when(c <= x1, y0 + (c - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(1.0)


def rounded(x: Column, places: int) -> Column:
    """``x`` rounded; a negative value that rounds to zero, and a negative zero, give -0.0 as SQL engines do (``round`` drops the sign)."""
    r = F.round(x, places)
    return F.when(r == 0, x * 0.0).otherwise(r)


def valid(v: Column, dim: int | None = None) -> Column:
    """Finite, of the wanted length, and not constant; null vectors are not valid."""
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.array_max(v) - F.array_min(v) >= 1e-9)
    return F.coalesce(sound if dim is None else sound & (F.size(v) == dim), F.lit(False))


def sparse(v: Column) -> Column:
    """Fewer than twelve of the first 64 components are other than zero: such a vector's cosine isn't calibrated."""
    head = F.slice(v, 1, 64)
    return F.coalesce(F.size(F.filter(head, lambda x: F.abs(x) > 1e-7)) < F.least(F.lit(12), F.size(head)), F.lit(False))


def hashed(text: Column, dim: int) -> Column:
    """A vector of the text's SHA-256: two bytes a component, round and round; unit length, 6 decimals; zeros for no text."""
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731 (a value that is worked out once)
    raw = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(digest, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("double") / 65535 * 2 - 1)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = let(let(F.sha2(text, 256), raw), lambda v: let(size(v), lambda z: F.transform(v, lambda x: F.round(x / z, 6))))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array_repeat(F.lit(0.0), dim)).otherwise(unit)


def token_hashed(tokens: Column, dim: int) -> Column:
    """A vector of words: each adds 1, 0.6 and -0.4 at three hashed places; unit length."""
    place = lambda w, k: F.pmod(F.xxhash64(w, F.lit(k)), F.lit(dim)).cast("int")
    add = lambda v, w: F.transform(v, lambda x, i: x + F.when(place(w, 0) == i, 1.0).otherwise(0.0) + F.when(place(w, 1) == i, 0.6).otherwise(0.0) - F.when(place(w, 2) == i, 0.4).otherwise(0.0))
    raw = F.aggregate(tokens, F.array_repeat(F.lit(0.0), dim), add)
    return F.when(norm(raw) > 0, F.transform(raw, lambda x: x / norm(raw))).otherwise(raw)


def centroids(rows: DataFrame, *, by: str, vector: str = "embedding", weight: Column | None = None) -> DataFrame:
    """(by, centroid, n): the weighted sum of each group's valid vectors, at unit length; sums are partial in each task."""
    w = F.lit(1.0) if weight is None else weight
    each = rows.where(valid(F.col(vector))).select(by, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    sums = each.groupBy(by, "i").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("a"), F.max("n").alias("n"))
    sizes = whole.select(by, "n", F.transform("a", lambda x: x["s"]).alias("v"))
    return sizes.withColumn("size", norm(F.col("v"))).select(by, F.when(F.col("size") > 1e-12, F.transform("v", lambda x: x / F.col("size"))).alias("centroid"), "n")


def residual(h: Column, q: Column, beta: float) -> Column:
    """``h`` without ``beta`` of its part along ``q``, normalised."""
    along = dot(h, q) * beta
    r = F.zip_with(h, q, lambda x, y: x - along * y)
    n = norm(r)
    return F.when(n > 0, F.transform(r, lambda x: x / n)).otherwise(r)
