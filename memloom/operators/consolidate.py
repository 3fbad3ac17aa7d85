"""Rows whose vectors are nearly equal: each goes to the largest smaller id among its near rows.

Vectors meet by hashes that grow with the table: one hash is the nearest of some random directions and their opposites, a table joins
as many of them as make about ``SHARE`` vectors a bucket, and the number of tables follows from how often two vectors at the
threshold share one hash (measured on random pairs), for a chance of ``MISS`` that such a pair never meets.  Directions are drawn
once from a fixed seed; the chance depends on the angle alone, not on the data or the dimension.

Equal vectors are one class, named by its least id.  Buckets of more than ``CHUNK`` classes are dealt as pairs of chunks.  A task
compares a bucket in blocks and passes on, for each class of one row, its best partner only; pairs of classes are passed on
where one holds several rows, and the rows of the smaller class are then looked up in the order of the other's.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..sources import staging
from . import ordered

#: Bits of one hash at most; vectors a bucket; chance that a pair at the threshold is missed; classes of a chunk.
BITS, SHARE, MISS, CHUNK = 7, 256, 1e-6, 2048


@functools.cache
def meeting_chance(cosine: float, directions: int) -> float:
    """How often two vectors at this cosine share one hash, from 200,000 random pairs."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200_000, directions)).astype(np.float32)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.normal(size=x.shape).astype(np.float32)
    return float(np.mean(nearest_direction(x) == nearest_direction(y)))


def nearest_direction(along: np.ndarray) -> np.ndarray:
    """The direction (last axis) with the greatest part, and its side."""
    best = np.abs(along).argmax(axis=-1)
    return 2 * best + (np.take_along_axis(along, best[..., None], -1)[..., 0] > 0)


def hashes(n: int, cosine: float) -> tuple[int, int, int]:
    """(directions a hash, hashes a table, tables) for ``n`` vectors."""
    bits = math.log2(max(n / SHARE, 4))
    width = math.ceil(bits / BITS)
    directions = max(2, round(2 ** (bits / width - 1)))
    return directions, width, math.ceil(math.log(MISS) / math.log1p(-(meeting_chance(cosine, directions) ** width)))


def bucket_keys(directions: int, width: int, tables: int):
    """A UDF: the bucket of a vector in each table."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        sizes = v.map(len)
        for dim in sorted(set(sizes)):
            mine = np.flatnonzero(sizes.to_numpy() == dim)
            x = np.stack(v.iloc[mine].tolist()).astype(np.float32)
            key = np.full((len(mine), tables), dim, dtype=np.int64)
            rng = np.random.default_rng([7, dim])
            for t in range(tables):
                for _ in range(width):
                    key[:, t] = key[:, t] * 2 * directions + nearest_direction(x @ rng.normal(size=(dim, directions)).astype(np.float32))
            for i, k in zip(mine, key):
                out.iat[i] = k
        return out

    return keys


def compared(batches, distance: float):
    """Rows (t, k, i, j, id, many, chunk, v) in order of the bucket (t, k, i, j) -> (newer, older, whole): near pairs, a bucket at a time.

    Chunk i meets chunk j; ``whole`` marks pairs of which one class holds several rows.
    """
    held: list[pd.DataFrame] = []

    def bucket(b: pd.DataFrame):
        ids, many = b["id"].to_numpy(), b["many"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, many, chunk, v = ids[order], many[order], b["chunk"].to_numpy()[order], b["v"].to_numpy()[order]
        x = np.stack(v).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        cross = b["i"].iat[0] != b["j"].iat[0]
        near = 1 - x @ x.T <= distance
        near &= ids[:, None] > ids[None, :]
        if cross:
            near &= chunk[:, None] != chunk[None, :]
        rows = near.any(axis=1)
        # The last near column is the largest smaller id.
        plain = near & ~many[:, None] & ~many[None, :]
        hit = np.flatnonzero(plain.any(axis=1))
        best = plain.shape[1] - 1 - plain[hit][:, ::-1].argmax(axis=1)
        a, c = np.nonzero((near & (many[:, None] | many[None, :]))[rows]) if many.any() else (np.array([], int), np.array([], int))
        a = np.flatnonzero(rows)[a]
        return np.concatenate([ids[hit], ids[a]]), np.concatenate([ids[best], ids[c]]), np.repeat([False, True], [len(hit), len(a)])

    def cut(pdf: pd.DataFrame, last: bool):
        """Whole buckets' results, and the rows of the bucket that may go on."""
        key = pdf[["t", "k", "i", "j"]].to_numpy()
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        found = [bucket(pdf.iloc[lo:hi]) for lo, hi in zip(edges, edges[1:] if last else edges[1:-1]) if hi - lo > 1]
        out = pd.DataFrame(dict(zip(("newer", "older", "whole"), map(np.concatenate, zip(*found))))) if found else None
        return out, pdf.iloc[edges[-2] :]

    for pdf in batches:
        if not len(pdf):
            continue
        out, rest = cut(pd.concat([*held, pdf], ignore_index=True) if held else pdf, False)
        held = [rest]
        if out is not None:
            yield out
    if held and (out := cut(held[0], True)[0]) is not None:
        yield out


def near_classes(classes: DataFrame, distance: float) -> DataFrame:
    """(newer, older, whole) from classes (id, many, v)."""
    keys = bucket_keys(*hashes(classes.count(), 1 - distance))
    keyed = classes.select("id", "many", "v", F.posexplode(keys(F.col("v"))).alias("t", "k"))
    large = classes.select(F.posexplode(keys(F.col("v"))).alias("t", "k")).groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    dealt = keyed.join(large, ["t", "k"], "left").withColumn("chunks", F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("t", "k", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "id", "many", "chunk", "v")
    sorted_ = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    kind = classes.schema["id"].dataType.simpleString()
    return sorted_.mapInPandas(lambda batches: compared(batches, distance), f"newer {kind}, older {kind}, whole boolean")


def consolidation(rows: DataFrame, *, distance: float = 0.15) -> DataFrame:
    """(id, superseded_by): rows (id, embedding) whose cosine distance to a smaller id is at most ``distance`` go to the largest such id.

    Vectors that are null, constant or not finite, and null ids, go nowhere and take nothing; vectors of other lengths never meet.
    """
    sound = rows.where(vectors.valid(F.col("embedding")) & F.col("id").isNotNull()).select("id", F.col("embedding").alias("v"))
    # Equal vectors by 128 bits; a class of any number of rows is dealt out along its ids.
    named = sound.select("id", "v", F.xxhash64("v").alias("x"), F.xxhash64("v", F.lit(1)).alias("y"))
    classes = staging.staged(named.groupBy("x", "y").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("v").alias("v"), F.count("*").alias("n")))
    several = classes.where("n > 1").select("x", "y", F.col("id").alias("class"))
    members = staging.staged(named.select("id", "x", "y").join(several, ["x", "y"]).select("class", "id"))
    twins = ordered.running(members, ["class"], ["id"], highest={"older": "id"}).where("older < id").select(F.col("id").alias("newer"), "older")
    near = staging.staged(near_classes(classes.select("id", (F.col("n") > 1).alias("many"), "v"), distance))
    alone = near.where("NOT whole").select("newer", "older")
    # Pairs of classes of which one is large: the rows of the smaller one are placed among the rows of the other.
    sizes = classes.select(F.col("id").alias("class"), "n")
    both = near.where("whole").select(F.col("newer").alias("p"), F.col("older").alias("q")).distinct()
    sized = both.join(sizes.withColumnsRenamed({"class": "p", "n": "np"}), "p").join(sizes.withColumnsRenamed({"class": "q", "n": "nq"}), "q")
    small = sized.select(F.when(F.col("np") <= F.col("nq"), F.col("p")).otherwise(F.col("q")).alias("small"), F.when(F.col("np") <= F.col("nq"), F.col("q")).otherwise(F.col("p")).alias("large"))
    every = members.unionByName(classes.where("n = 1").select(F.col("id").alias("class"), "id"))
    asked = small.join(every, F.col("small") == F.col("class")).select(F.col("large").alias("class"), "id", F.lit(True).alias("asks"))
    met = asked.unionByName(every.join(small.select(F.col("large").alias("class")).distinct(), "class", "left_semi").withColumn("asks", F.lit(False)))
    met = met.withColumns({"row": F.when(~F.col("asks"), F.col("id")), "down": -F.col("id"), "next": F.when(~F.col("asks"), -F.col("id"))})
    back = ordered.running(met, ["class"], ["id"], highest={"older": "row"}).where("asks AND older < id").select(F.col("id").alias("newer"), "older")
    onward = ordered.running(met, ["class"], ["down"], highest={"after": "next"}).where("asks AND -after > id").select((-F.col("after")).alias("newer"), F.col("id").alias("older"))
    return twins.unionByName(alone).unionByName(back).unionByName(onward).groupBy(F.col("newer").alias("id")).agg(F.max("older").alias("superseded_by"))
