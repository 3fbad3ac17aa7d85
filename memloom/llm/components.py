"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (partial sums on the map side) and a join of two written tables that adaptive execution
can split, so a hub linked with a third of all rows stays spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Links a task handles; small tables needn't be spread over all partitions.
TASK_LINKS = 20_000


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every node that has a link; component_id is the least node id reachable."""
    hi, lo = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    links = written(links.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    before = _mark(links)
    tasks = before[0] // TASK_LINKS + 1  # no step has more rows than twice the links
    stored = lambda df: written(df.coalesce(tasks))
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: each node's larger neighbours go to the least of the node and its neighbours.
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: each node and its smaller neighbours go to the least of these.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        old, links = [links, low, large, least], stored(small.distinct())
        discard(*old)
        after = _mark(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).unionByName(roots)
