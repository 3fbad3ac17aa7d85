"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant and all others
as named users.  System turns open the rendering and are nobody's perspective.  A turn's text stands between header and
end marks; the mask holds one character range per own turn, so that only the chosen speaker's words (and their end mark)
are trained on.

Built-in functions only.  A rendering is returned in parts of at most ``max_turns`` turns and about ``max_chars``
characters: consecutive pieces of the one rendering, every participant gets every part, and ``start`` says where in the
rendering a part begins.  Joined in order, the parts are the rendering, so the bounds never change a text or a mask.  Turns
meet in one sorted array per part; rows of conversations that need several parts are numbered by prefix sums over range
partitions, so no group is unbounded.

Defined cases: null texts are empty turns; null roles speak as ``unknown``; a null turn number sorts first; ties in the
turn number are ordered by role and text; repeated rows are repeated turns; a null conversation id is one conversation;
conversations of system turns alone, and empty tables, give no rows; one turn is never cut, however long; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import running, table, written

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<start:int,end:int>>"


def rotate(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_turns: int = 1024, max_chars: int = 2**24
) -> DataFrame:
    """(conv, part, speaker, n_turns, n_own, start, text, mask): one row for each participant and part of the rendering.

    ``start`` counts the code points of the rendering before this part; ``mask`` is array<struct<start, end>> over code
    points of the part's text.
    """
    role_, text_ = F.coalesce(role, F.lit("unknown")), F.coalesce(text, F.lit(""))
    t = turns.select(F.col(conv).alias("conv"), (role_ != "system").alias("late"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"))
    size = t.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    large = written(size.where((F.col("n") > max_turns) | (F.col("chars") > max_chars)).select(F.col("conv").alias("c")))
    some = large.limit(1).count()
    same = F.col("conv").eqNullSafe(F.col("c"))
    whole = in_order((t.join(large, same, "left_anti") if some else t).withColumn("part", F.lit(0).cast("long")))
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda x: x["role"]), lambda r: r != "system")))
    out = rendered(whole.withColumn("speaker", F.explode(speakers))).withColumn("start", F.lit(0).cast("long"))
    if some:
        many = written(t.join(large, same, "left_semi").withColumn("length", F.length("text").cast("long")))
        placed = running(many, ["conv"], ["late", "turn", "role", "text"], before="length")
        # Neither number ever falls, so their sum differs wherever one of them does.
        parts = in_order(placed.withColumn("part", F.floor(F.col("place") / max_turns) + F.floor(F.col("before") / max_chars)))
        who = many.where("late").select(F.col("conv").alias("c"), F.col("role").alias("speaker")).distinct()
        pieces = written(rendered(parts.join(who, same).drop("c")))
        ahead = W.partitionBy("conv", "speaker").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        at = F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")
        starts = pieces.select("conv", "speaker", "part", F.length("text").cast("long").alias("length")).select(F.col("conv").alias("c"), F.col("speaker").alias("s"), F.col("part").alias("p"), at.alias("start"))
        out = out.unionByName(pieces.join(starts, same & (F.col("speaker") == F.col("s")) & (F.col("part") == F.col("p"))).drop("c", "s", "p"))
    return out.select(F.col("conv").alias(conv), "part", "speaker", "n_turns", "n_own", "start", "text", "mask")


def in_order(t: DataFrame) -> DataFrame:
    """(conv, part, turns): the turns of each part, system turns first."""
    return t.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("late", "turn", "role", "text"))).alias("turns"))


def rendered(views: DataFrame) -> DataFrame:
    """(conv, part, speaker, n_turns, n_own, text, mask) of (conv, part, turns, speaker)."""

    def render(x: Column) -> Column:
        name = F.when(x["role"] == "system", "system").when(x["role"] == F.col("speaker"), "assistant").otherwise(F.concat(F.lit("user name="), x["role"]))
        return F.struct((x["role"] == F.col("speaker")).alias("own"), F.concat(F.lit(START), name, F.lit("\n")).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(TURNS).alias("out"))

    def mark(acc: Column, p: Column) -> Column:
        lo = acc["at"] + F.length(p["head"])
        hi = lo + F.length(p["body"])
        span = F.when(p["own"], F.array(F.struct(lo.alias("start"), hi.alias("end")))).otherwise(F.array().cast(TURNS))
        return F.struct(hi.alias("at"), F.concat(acc["out"], span).alias("out"))

    return views.withColumn("pieces", F.transform("turns", render)).select(
        "conv",
        "part",
        "speaker",
        F.size("pieces").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("pieces", zero, mark, lambda acc: acc["out"]).alias("mask"),
    )


def op2_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations")).select(
        "conv_id", "part", "speaker", "n_turns", "n_own", "start", "text",
        F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",").alias("mask"),
    )


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER w - 1 AS k, sum(length(text)) OVER w - length(text) AS c FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY role <> 'system', turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
v AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
x AS (SELECT v.conv_id, speaker, role = speaker AS own, k, k // 1024 + CAST(c AS BIGINT) // 16777216 AS part,
  '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body
  FROM v JOIN n ON n.conv_id IS NOT DISTINCT FROM v.conv_id),
y AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY k) AS hi FROM x),
z AS (SELECT *, min(hi - length(head) - length(body)) OVER (PARTITION BY conv_id, speaker, part) AS start FROM y)
SELECT conv_id, part, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own, CAST(start AS BIGINT) AS start, string_agg(head || body, '' ORDER BY k) AS text,
coalesce(string_agg(CAST(CAST(hi - length(body) - start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(hi - start AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (own), '') AS mask
FROM z GROUP BY conv_id, part, speaker, start
"""
