"""Unified diffs as line tables: files touched, old-side hunks, added lines, overlap with known line spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths


HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def lines(diffs: DataFrame, *, key: str = "diff_id", text: str = "diff") -> DataFrame:
    """(key, n, line, kind, old_file, file): every line of a diff; kind is head, hunk, or the sign of a line inside a hunk.

    What stands inside a hunk is counted by the hunk's own header, so lines that merely look like a file's header are lines;
    a whole header (``---``, ``+++`` and a hunk behind one another) ends a hunk even if lines of it are lacking.
    """
    t = diffs.select(F.col(key), F.posexplode(F.split(F.col(text), "\r?\n")).alias("n", "line"))
    by = W.partitionBy(key).orderBy("n")  # the lines of one diff: one row's text
    number = lambda g: F.coalesce(F.regexp_extract("line", HUNK, g).try_cast("long"), F.lit(1))
    opens = F.col("line").rlike(HUNK)  # no line inside a hunk begins like this
    t = t.withColumn("__hunk", F.sum(opens.cast("int")).over(by)).withColumn("__opens", opens)
    for side in (2, 4):
        t = t.withColumn(f"__{side}", F.max(F.when(F.col("__opens"), number(side))).over(W.partitionBy(key, "__hunk")))
    sign = F.substring("line", 1, 1)
    before = W.partitionBy(key, "__hunk").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    seen = lambda other: F.coalesce(F.sum((~F.col("__opens") & ~sign.isin(other, "\\")).cast("int")).over(before), F.lit(0))
    inside = ~F.col("__opens") & (F.col("__hunk") > 0) & ((seen("+") < F.col("__2")) | (seen("-") < F.col("__4")))
    whole = lambda k: F.lead("line", k).over(by).startswith("--- ") & F.lead("line", k + 1).over(by).startswith("+++ ") & F.lead("line", k + 2).over(by).rlike(HUNK)
    header = F.coalesce(whole(0), F.lit(False)) | F.coalesce(whole(-1), F.lit(False))
    kind = F.when(F.col("__opens"), "hunk").when(header, "head").when(inside, F.when(sign.isin("+", "-", "\\"), sign).otherwise(" ")).otherwise("head")
    t = t.withColumn("kind", kind).drop("__hunk", "__opens", "__2", "__4")
    head = F.col("kind") == "head"
    named = lambda p: F.when(head & F.col("line").rlike(f"^{p}"), paths.relative(paths.unquoted(F.regexp_replace(F.regexp_replace("line", f"^{p}", ""), r"\t.*$", ""))))
    fresh = F.sum((head & F.col("line").startswith("diff --git ")).cast("int") + (head & F.col("line").startswith("--- ")).cast("int")).over(by)
    t = t.withColumn("__part", fresh).withColumn("__old", named(r"(?:--- |rename from |copy from )")).withColumn("__new", named(r"(?:\+\+\+ |rename to |copy to )"))
    here = W.partitionBy(key, "__part").orderBy("n")
    t = t.withColumn("old_file", F.last("__old", ignorenulls=True).over(here)).withColumn("file", F.last("__new", ignorenulls=True).over(here))
    return t.drop("__part", "__old", "__new").withColumn("file", F.coalesce("file", "old_file"))


def touched(diffs: DataFrame, **names) -> DataFrame:
    """(key, file): files on either side of a diff; renames and copies count with both names, /dev/null not."""
    key = names.get("key", "diff_id")
    t = lines(diffs, **names).where("kind = 'head'")
    return t.select(key, F.explode(F.array("old_file", "file")).alias("file")).where("file is not null").distinct()


def hunks(diffs: DataFrame, *, most: int = 200, **names) -> DataFrame:
    """(key, file, first, last): old-side line ranges, at most ``most`` lines each."""
    key = names.get("key", "diff_id")
    h = lines(diffs, **names).where("kind = 'hunk'")
    first = F.regexp_extract("line", HUNK, 1).cast("long")
    n = F.coalesce(F.regexp_extract("line", HUNK, 2).try_cast("long"), F.lit(1))
    return h.select(key, "file", first.alias("first"), (first + F.greatest(F.least(n, F.lit(most)), F.lit(1)) - 1).alias("last"))


def added(diffs: DataFrame, **names) -> DataFrame:
    key = names.get("key", "diff_id")
    return lines(diffs, **names).where("kind = '+'").select(key, "file", "n", F.substr("line", F.lit(2)).alias("line"))


def surviving(diffs: DataFrame, **names) -> DataFrame:
    """(key, file, n, line): lines that stand after the change: added and unchanged ones."""
    key = names.get("key", "diff_id")
    return lines(diffs, **names).where("kind in ('+', ' ')").select(key, "file", "n", F.substr("line", F.lit(2)).alias("line"))


def overlapping(spans: DataFrame, hunks_: DataFrame) -> DataFrame:
    """Spans (id, file, start_line, end_line) that a hunk of the same file touches: an equi-join on the file's base name first."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    a, b = spans.withColumn("base", base(F.col("file"))), hunks_.withColumnRenamed("file", "diff_file").withColumn("base", base(F.col("diff_file")))
    same = (F.col("file") == F.col("diff_file")) | F.endswith("file", F.concat(F.lit("/"), "diff_file")) | F.endswith("diff_file", F.concat(F.lit("/"), "file"))
    return a.join(b, "base").where(same & (F.col("start_line") <= F.col("last")) & (F.col("end_line") >= F.col("first"))).drop("base")
