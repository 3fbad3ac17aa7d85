"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN: list[str] = []
_OPEN: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("open", default=None)
#: Bytes of rows that go to a Python worker at once, unless the session says otherwise: long texts and sets make small batches.
BATCH_BYTES = 16_000_000


def bounded_batches(spark: SparkSession, most: int | None = None) -> None:
    """Bound the bytes of Arrow batches, not their rows alone: ``most``, or BATCH_BYTES unless the session sets a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "2147483647")) > (most or 2**31 - 2):
        spark.conf.set(name, str(most or BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and all tasks run on this machine (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="memloom-"))
    return _OWN[0]


def written(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and lost executors cost nothing done so far.

    ``by``: columns that name folders, so that a filter on them reads its folders only.
    """
    bounded_batches(df.sparkSession)
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
    out._written_to = path
    if (tables := _OPEN.get()) is not None:
        tables.append(out)
    return out


def row_keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a key for each row that every reading gives again: its file and its place there, in the order of the file.

    A table that doesn't come straight from files is written first.
    """
    try:
        return docs.withColumn(name, F.concat_ws("-", F.substring(F.sha2("_metadata.file_path", 256), 1, 24), F.lpad("_metadata.row_index", 15, "0")))
    except AnalysisException:
        return written(docs.withColumn(name, F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")))


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At the end of the block, tables that ``written`` made inside are deleted but for those given to the function it yields."""
    kept: list[DataFrame] = []
    mine: list[DataFrame] = []
    token = _OPEN.set(mine)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _OPEN.reset(token)
        discard(*[df for df in mine if not any(df is k for k in kept)])
        if (outer := _OPEN.get()) is not None:
            outer.extend(kept)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def added(df: DataFrame, name: str, col: Column) -> DataFrame:
    """``df`` with a new column; a column of that name is never replaced."""
    if fresh(df, name) != name:
        raise ValueError(f"the table has a column {name} already")
    return df.withColumn(name, col)


def running(rows: DataFrame, group: list[str], order: list[str], **sums: str) -> DataFrame:
    """``rows`` with ``place``, their number within the group from 0, and prefix sums: ``name=column`` adds up the rows before.

    Two passes, so that no group needs one task: range partitions are numbered on their own, and their totals (one row a
    group and range) are summed up before.  Rows that are alike in all columns of the order stand in any order.
    """
    tied = written(rows.withColumn("__tie", F.monotonically_increasing_id()))
    dealt = written(tied.repartitionByRange(*group, *order, "__tie").withColumn("__range", F.spark_partition_id()))
    discard(tied)
    within = W.partitionBy(*group, "__range").orderBy(*order, "__tie")
    mine = within.rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    nil = F.lit(0).cast("long")
    totals = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{name}") for name, c in sums.items()])
    before = totals.select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__range").alias("__r"),
        F.coalesce(F.sum("__n").over(ahead), nil).alias("__b"), *[F.coalesce(F.sum(f"__{name}").over(ahead), nil).alias(f"__b_{name}") for name in sums],
    )
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inside = dealt.withColumns({"place": F.row_number().over(within).cast("long") - 1} | {name: F.coalesce(F.sum(c).over(mine), nil) for name, c in sums.items()})
    out = inside.join(before, same).withColumns({"place": F.col("place") + F.col("__b")} | {name: F.col(name) + F.col(f"__b_{name}") for name in sums})
    return out.select(*rows.columns, "place", *sums)


def ascii_lower(col):
    """Lower-case A-Z only (Spark's lower() also changes other letters)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(col, n: int):
    """crc32 of the id written as text, modulo ``n``; the folds of the contracts."""
    return F.crc32(col.cast("string").cast("binary")) % n
