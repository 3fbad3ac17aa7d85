"""The tables as memories, dialogue turns and feedback; vectors as bytes; incremental merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: id, project (source), category (language), content."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"), F.col("lang").alias("category"), F.col("text").alias("content"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(raw: pd.Series) -> pd.Series:
    """Little-endian float32 bytes as a vector; null where the length is no multiple of four."""
    return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


def tag_list(tags: Column) -> Column:
    """Tags from a JSON array, or from text parted by commas, semicolons or bars."""
    listed = F.from_json(tags, "array<string>")
    return F.filter(F.transform(F.coalesce(F.when(tags.startswith("["), listed), F.split(tags, r"[,;|]+")), lambda t: F.trim(t)), lambda t: t != "")


def merge(local: DataFrame, remote: DataFrame, *, key: str, content: str = "content") -> DataFrame:
    """Local rows, with remote values where the key is known, and remote rows whose key and content are both new.

    A key that the remote copy gives several times counts once, with its greatest content.
    """
    others = [c for c in remote.columns if c not in (key, content)]
    remote = remote.groupBy(key).agg(F.max(F.struct(content, *others)).alias("__r")).select(key, F.col(f"__r.{content}").alias(content), *[F.col(f"__r.{c}").alias(c) for c in others])
    r = remote.select(F.col(key), F.col(content).alias("__new"))
    known = local.join(r, key, "left").withColumn(content, F.coalesce("__new", content)).drop("__new")
    fresh = remote.join(local.select(key), key, "left_anti").join(local.select(F.lower(F.trim(content)).alias("__same")).distinct(), F.lower(F.trim(F.col(content))) == F.col("__same"), "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True)


def drift(memories_: DataFrame, files: DataFrame) -> DataFrame:
    """(id, reason, start): memories (id, file, quote, sha) against a snapshot (path, text): missing file, missing quote, changed file."""
    f = files.select(F.col("path").alias("file"), F.regexp_replace("text", "\r\n", "\n").alias("now"))
    found = F.expr("instr(now, quote)")
    reason = F.when(F.col("now").isNull(), "file_missing").when(F.col("quote").isNotNull() & (found == 0), "quoted_span_not_found").when(F.col("sha") != F.sha2(F.expr(r"regexp_replace(now, '^\\s+|\\s+$', '')"), 256), "file_hash_mutated")
    return memories_.join(f, "file", "left").select("id", reason.alias("reason"), F.when(found > 0, found - 1).alias("start"))
