"""Numbers, sums and maxima along an order, for groups of any size.

A window over a whole group is one task.  Here rows are dealt to ranges of (group, order), each range is worked through on
its own, and one line a group and range (their totals, summed up along the ranges) says what stood before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import staging


def running(rows: DataFrame, group: list[str], order: list[str], *, sums: dict[str, str] | None = None, highest: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``place``, their number within the group from 0, and for the rows before: ``sums`` and ``highest`` (name: column).

    Null groups are a group.  Rows alike in group and order stand in any order, in one range; nothing before: a sum of 0, no maximum.
    """
    sums, highest = sums or {}, highest or {}
    dealt = staging.staged(rows.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()))
    own = W.partitionBy("__range", *group).orderBy(*order)
    ahead = own.rowsBetween(W.unboundedPreceding, -1)
    along = W.partitionBy(*[f"__g{i}" for i in range(len(group))]).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    nil = F.lit(0).cast("long")
    totals = dealt.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__range").alias("__at")).agg(
        F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()], *[F.max(c).alias(f"__h_{n}") for n, c in highest.items()]
    )
    # One line a group and range: windows over them are short, whatever the group holds.
    before = totals.select(
        *[f"__g{i}" for i in range(len(group))], "__at", F.coalesce(F.sum("__n").over(along), nil).alias("__n"),
        *[F.coalesce(F.sum(f"__s_{n}").over(along), nil).alias(f"__s_{n}") for n in sums], *[F.max(f"__h_{n}").over(along).alias(f"__h_{n}") for n in highest],
    )
    same = F.col("__range") == F.col("__at")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inside = dealt.withColumns({"__place": F.row_number().over(own) - 1} | {f"__own_{n}": F.sum(c).over(ahead) for n, c in sums.items()} | {f"__top_{n}": F.max(c).over(ahead) for n, c in highest.items()})
    out = inside.join(before, same)
    return out.select(
        *rows.columns, (F.col("__place") + F.col("__n")).cast("long").alias("place"),
        *[(F.coalesce(f"__own_{n}", nil) + F.col(f"__s_{n}")).alias(n) for n in sums], *[F.greatest(f"__top_{n}", f"__h_{n}").alias(n) for n in highest],
    )
