"""Filter interaction audit: what each of five filters removes in every order, from one histogram of failure masks.

A document fails some of the filters, which is a mask of five bits; what becomes of it in any order follows from the mask
alone.  So one pass counts masks by part and label, the counts of a part are stacked as rows (all, good, toxic), and an
integer product with the 32-by-600 matrices of outcomes (one column a permutation and step: kept, removed, redundant,
unique) gives every figure.  Removals summed over the permutations, by filter, are the filters' Shapley values times 120.

Filters: A fewer than 50 words; B under 65 % distinct words; C over 5 % capital letters A-Z; D holds one of ``#$%&*|``;
E is the text of a row with a smaller key.  Texts are the same where their SHA-256 is.

Defined cases: a null text is the empty text and a null part the empty string; a row with a null key is never a copy of
another, nor another of it; rows that repeat key and text are no copies of each other; a key counts as good (toxic) when
any of its label rows says so; a null label says nothing; an empty table gives no rows; columns besides those named are
not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts multiplied at once: 600 rows come of each.
PARTS = 64


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: which of A to D a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, docs, good, toxic): documents by part and failures.

    Rows are counted before each shuffle, and meet by (text's digest, key), so that a text or part of any number of rows is dealt out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(key).alias("key"), F.unhex(F.sha2(body, 256)).alias("digest"), text_failures(body).alias("mask"))
    seen = written(read.groupBy("part", "key", "digest", "mask").agg(F.count("*").alias("docs")))
    firsts = seen.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    said = labels.groupBy(F.col(key).alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.col("key").isNotNull() & F.col("first").isNull()
    judged = seen.join(firsts, ["digest", "key"], "left").join(said, "key", "left").withColumn("mask", F.col("mask") + F.when(copy, 16).otherwise(0))
    lost = lambda c: F.sum(F.when(F.col(c), F.col("docs")).otherwise(0)).alias(c)
    return judged.groupBy("part", "mask").agg(F.sum("docs").alias("docs"), lost("good"), lost("toxic"))


def outcomes() -> dict[str, np.ndarray]:
    """32-by-600 matrices: whether a document with a mask (row) meets an outcome at a step of an order (column)."""
    out = {name: np.zeros((MASKS, len(ORDERS) * len(FILTERS)), dtype=np.int64) for name in ("kept", "removed", "redundant", "unique")}
    for column, (order, step) in enumerate((o, s) for o in ORDERS for s in range(len(FILTERS))):
        bit = 1 << FILTERS.index(order[step])
        before = sum(1 << FILTERS.index(f) for f in order[:step])
        for mask in range(MASKS):
            fails, gone = bool(mask & bit), bool(mask & before)
            out["kept"][mask, column] = not fails and not gone
            out["removed"][mask, column] = fails and not gone
            out["redundant"][mask, column] = fails and gone
            out["unique"][mask, column] = mask == bit
    return out


def audit(counted: DataFrame) -> DataFrame:
    """One row a part, order and step of ``masks``; a part is one row of 96 sums before the product."""
    sums = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for c in ("docs", "good", "toxic") for m in range(MASKS)]
    stacked = counted.groupBy("part").agg(*sums)
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def product(batches):
        m = outcomes()
        letter = np.array([FILTERS.index(f) for order in ORDERS for f in order])
        for pdf in batches:
            for lo in range(0, len(pdf), PARTS):
                mine = pdf.iloc[lo : lo + PARTS]
                rows = mine.drop(columns="part").to_numpy(dtype=np.int64).reshape(len(mine), 3, MASKS)
                removed = rows @ m["removed"]
                shapley = np.stack([removed[:, 0, letter == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
                columns = [rows[:, 0] @ m["kept"], removed[:, 0], rows[:, 0] @ m["redundant"], rows[:, 0] @ m["unique"], removed[:, 1], removed[:, 2], shapley[:, letter]]
                out = pd.DataFrame({c: v.ravel() for c, v in zip(COUNTS, columns)})
                out.insert(0, "part", np.repeat(mine["part"].to_numpy(dtype=object), len(letter)))
                out.insert(1, "filter_order", np.tile(np.repeat(np.array(ORDERS, dtype=object), len(FILTERS)), len(mine)))
                out.insert(2, "step", np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(mine) * len(ORDERS)))
                yield out

    return stacked.mapInPandas(product, schema)


def op11_incidence_product(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(masks(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(ws) < 50 AS INT) AS a, CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT) AS b,
  CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) AS c, CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d, CAST(coalesce(w.doc_id > least, false) AS INT) AS e FROM w LEFT JOIN l USING (doc_id)),
h AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM k p JOIN k q ON q.x <> p.x JOIN k r ON r.x NOT IN (p.x, q.x) JOIN k s ON s.x NOT IN (p.x, q.x, r.x) JOIN k t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
m AS (SELECT part, n, good, toxic, filter_order, CAST(step AS INT) AS step, a + b + c + d + e AS fails, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS bit FROM h, o, range(1, 6) r(step)),
j AS (SELECT *, filter_order[step] AS x, bit[filter_order[step]] AS fail, coalesce(list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda y: bit[y])), 0) > 0 AS gone FROM m),
s AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (fail = 0 AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fail = 1 AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fail = 1 AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fail = 1 AND fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fail = 1 AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fail = 1 AND NOT gone), 0)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM s"""
