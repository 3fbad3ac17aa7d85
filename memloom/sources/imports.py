"""Imports: nested chats, JSON or literals, older schemas, files of a workspace, exchange with a remote copy."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text


def flatten_chats(chats: DataFrame, *, key: str = "conversation_id", chat: str = "chat") -> DataFrame:
    """(key, session, turn, role, content): one row a message of array<array<struct<role, content>>>, empty ones dropped."""
    s = chats.select(F.col(key), F.posexplode(chat).alias("session", "__turns"))
    t = s.select(key, "session", F.posexplode("__turns").alias("turn", "__m"))
    return t.select(key, "session", "turn", F.lower(F.trim("__m.role")).alias("role"), F.col("__m.content").alias("content")).where(F.trim(F.coalesce("content", F.lit(""))) != "")


@F.pandas_udf(T.StringType())
def as_json(values: pd.Series) -> pd.Series:
    """JSON of a JSON text or of a Python literal; null where it is neither."""

    def read(v):
        if v is None:
            return None
        for parse in (json.loads, ast.literal_eval):
            try:
                return json.dumps(parse(v), ensure_ascii=False)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
        return None

    return values.map(read)


def evolved(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` in a newer schema: columns that are missing become null, others are cast, unknown ones are dropped."""
    return rows.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def new_dimension(rows: DataFrame, dim: int, *, vector: str = "embedding") -> DataFrame:
    """``rows`` whose vectors of another dimension are null, to be embedded again."""
    return rows.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)))


def read_workspace(spark: SparkSession, folder: str, *, most_bytes: int = 512 * 1024) -> DataFrame:
    """(path, text, sha): text files under a folder, without ignored folders, files that may hold secrets, large ones and binaries."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/") + "/"
    f = f.withColumn("path", F.element_at(F.split("path", base.replace("\\", "\\\\").join(("\\Q", "\\E")) if base else "$"), -1))
    sound = f.where((F.col("length") > 0) & (F.col("length") <= most_bytes) & ~paths.sensitive(F.col("path")) & ~paths.ignored(F.col("path")))
    read = sound.select("path", F.decode("content", "UTF-8").alias("text")).where(~F.contains("text", F.lit("\x00")))
    return read.withColumn("sha", text.content_hash(F.col("text")))


def pulled(local: DataFrame, remote: DataFrame, *, most: int = 500) -> DataFrame:
    """Local rows (id, remote_id, content, status, synced) after a pull of the newest remote rows (remote_id, content, status, created_at).

    Rows that are known and unchanged here take the remote values; rows changed here keep theirs; remote rows whose id and
    text are both unknown join without a local id.
    """
    new = remote.orderBy(F.desc("created_at"), F.desc("remote_id")).limit(most).dropDuplicates(["remote_id"])
    r = new.select("remote_id", F.col("content").alias("__content"), F.col("status").alias("__status"))
    known = local.join(r, "remote_id", "left")
    take = F.col("__content").isNotNull() & F.coalesce("synced", F.lit(False))
    known = known.select("id", "remote_id", F.when(take, F.col("__content")).otherwise(F.col("content")).alias("content"), F.when(take, F.col("__status")).otherwise(F.col("status")).alias("status"), "synced")
    fresh = new.join(local.where("remote_id is not null").select("remote_id"), "remote_id", "left_anti").join(local.select("content").distinct(), "content", "left_anti")
    return known.unionByName(fresh.select(F.lit(None).cast(local.schema["id"].dataType).alias("id"), "remote_id", "content", "status", F.lit(True).alias("synced")))


def to_push(local: DataFrame) -> DataFrame:
    """Rows to write to the remote copy, in order of id: new ones, and known ones that changed here; links go by remote ids."""
    rows = local.where(~F.coalesce("synced", F.lit(False)))
    ids = local.where("remote_id is not null").select(F.col("id").alias("__id"), F.col("remote_id").alias("remote_superseded_by"))
    return rows.join(ids, F.col("superseded_by") == F.col("__id"), "left").drop("__id").withColumn("op", F.when(F.col("remote_id").isNull(), "insert").otherwise("update")).orderBy("id")
