"""Provenance: anchoring quotes to files, drift and its healing, and where a quote has moved to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, text

#: First signs by which a quote without a whole word is looked for.
SIGNS = 8


def plain(t: Column) -> Column:
    return F.regexp_replace(t, "\r\n?", "\n")


def citation(file: Column, first: Column, last: Column, locator: Column) -> Column:
    lines = F.when(first.isNull(), "").otherwise(F.concat(F.lit("#L"), first, F.when(last != first, F.concat(F.lit("-L"), last)).otherwise("")))
    return F.concat(file, lines, F.when(locator.isNull(), "").otherwise(F.concat(F.lit(" ["), locator, F.lit("]"))))


def anchored(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` (id, file, quote, locator) with anchor_hash, char_start, char_end, start_line, end_line, citation, is_drifted, drift_reason.

    files: path, text.  A row's own path is found as it is; sensitive files are never read.
    """
    f = files.where(~paths.sensitive(F.col("path"))).select(F.col("path").alias("__path"), plain(F.col("text")).alias("__now"))
    t = rows.join(f, F.col("file") == F.col("__path"), "left").withColumn("__quote", plain(F.col("quote")))
    at = F.expr("instr(__now, __quote)")
    found = F.col("__quote").isNotNull() & (at > 0)
    start, end = at - 1, at - 1 + F.length("__quote")
    lines = text.line_range(F.col("__now"), start, end)
    missing = F.col("__now").isNotNull() & F.col("__quote").isNotNull() & (at == 0)
    t = t.withColumns({
        "anchor_hash": F.when(F.col("__now").isNotNull(), text.content_hash(F.col("__now"))),
        "char_start": F.when(found, start), "char_end": F.when(found, end),
        "start_line": F.when(found, lines["first"]), "end_line": F.when(found, lines["last"]),
        "is_drifted": missing, "drift_reason": F.when(missing, "quoted_span_not_found"),
    })
    return t.withColumn("citation", F.when(F.col("__now").isNotNull(), citation(F.col("file"), F.col("start_line"), F.col("end_line"), F.col("locator")))).drop("__path", "__now", "__quote")


def drifted(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(id, is_drifted, drift_reason, healed, start_line, end_line, anchor_hash) of rows (id, file, quote, anchor_hash, is_drifted, drift_reason).

    A quote that still stands in its changed file heals the row: new lines, new hash.
    """
    f = files.select(F.col("path").alias("__path"), plain(F.col("text")).alias("__now"))
    t = rows.join(f, F.col("file") == F.col("__path"), "left").withColumn("__quote", plain(F.col("quote"))).withColumn("__hash", text.content_hash(F.col("__now")))
    at, was = F.expr("instr(__now, __quote)"), F.coalesce("is_drifted", F.lit(False))
    gone, same = F.col("__now").isNull(), (F.col("__hash") == F.col("anchor_hash")) & ~was
    quoted = F.col("__quote").isNotNull()
    lost = F.when(F.col("drift_reason") == "quoted_span_not_found", "quoted_span_not_found").otherwise("quoted_span_mutated")
    reason = F.when(gone, "file_missing").when(F.coalesce(same, F.lit(False)), None).when(quoted & (at == 0), lost).when(~quoted & F.col("anchor_hash").isNotNull() & (F.col("__hash") != F.col("anchor_hash")), "file_hash_mutated")
    healed = ~gone & ~F.coalesce(same, F.lit(False)) & reason.isNull()
    lines = text.line_range(F.col("__now"), at - 1, at - 1 + F.length("__quote"))
    new = healed & quoted
    return t.select("id", reason.isNotNull().alias("is_drifted"), reason.alias("drift_reason"), healed.alias("healed"), F.when(new, lines["first"]).alias("start_line"), F.when(new, lines["last"]).alias("end_line"), F.when(healed, F.col("__hash")).otherwise(F.col("anchor_hash")).alias("anchor_hash"))


def relocated(rows: DataFrame, files: DataFrame, *, most: int = 5, gram: int = 3) -> DataFrame:
    """(id, path, start_line, end_line, citation, candidate_count): the best other file that holds a row's quote.

    rows: id, file, quote (ten signs at least); files: path, text.  Files meet a quote by its rarest run of ``gram`` words, so
    no quote is looked for in every file.  Quotes found in more than ``most`` files are ambiguous and stay where they are.
    Near files go first: the same folder, then shared folders, then fewer steps, then the path.
    """
    q = rows.withColumn("quote", F.regexp_replace(plain(F.col("quote")), r"^\s+|\s+$", "")).where(F.length(F.regexp_replace("quote", r"\s+", "")) >= 10)
    f = files.where(~paths.sensitive(F.col("path")) & ~paths.ignored(F.col("path")) & ~F.contains("text", F.lit("\x00"))).withColumn("text", plain(F.col("text")))
    runs = lambda t: F.filter(F.split(F.lower(t), r"[^a-z0-9]+"), lambda w: w != "")
    grams = lambda a: F.when(F.size(a) >= gram, F.transform(F.sequence(F.lit(1), F.size(a) - gram + 1), lambda i: F.xxhash64(F.array_join(F.slice(a, i, F.lit(gram)), " ")))).otherwise(F.array().cast("array<bigint>"))
    inner = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0)))  # noqa: E731  a quote may begin and end inside a word
    of_files = f.select("path", F.explode(F.array_distinct(grams(runs(F.col("text"))))).alias("g"))
    of_quotes = q.select("id", F.explode(F.array_distinct(grams(inner(runs(F.col("quote")))))).alias("g"))
    df = of_files.join(of_quotes.select("g").distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("df"))
    rarest = of_quotes.join(df, "g", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("r"))
    by_gram = rarest.where("r.df > 0").select("id", F.col("r.g").alias("g")).join(of_files, "g").select("id", "path")
    short = q.join(of_quotes.select("id").distinct(), "id", "left_anti").select("id", "quote")
    # Quotes of too few words for a run are looked for by their first whole word.
    word = short.select("id", F.get(inner(runs(F.col("quote"))), F.lit(0)).alias("w"))
    by_word = word.where("w is not null").join(f.select("path", F.explode(F.array_distinct(runs(F.col("text")))).alias("w")), "w").select("id", "path")
    pairs = by_gram.unionByName(by_word)
    # Quotes without any whole word, by their first signs; the files' runs of signs are cut only where there are such quotes.
    bare = short.join(word.where("w is null").select("id"), "id", "left_semi").select("id", F.substring("quote", 1, SIGNS).alias("s"))
    if not bare.isEmpty():
        cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - SIGNS + 1, F.lit(1))), lambda i: F.substr("text", i, F.lit(SIGNS))))
        pairs = pairs.unionByName(f.select("path", F.explode(cut).alias("s")).join(bare, "s").select("id", "path"))
    pairs = pairs.distinct()
    met = pairs.join(q.select("id", "file", "quote"), "id").where(F.col("path") != F.col("file")).join(f.select("path", "text"), "path")
    at = F.expr("instr(text, quote)")
    lines = text.line_range(F.col("text"), at - 1, at - 1 + F.length("quote"))
    found = met.where(at > 0).select("id", "file", "path", lines.alias("lines"))
    folder = lambda p: F.filter(F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1), lambda s: s != "")
    a, b = folder(F.col("file")), folder(F.col("path"))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: (F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)) & (F.size(F.slice(a, F.lit(1), i)) == i)))
    near = found.withColumn("near", F.struct((a != b).cast("int"), -shared, F.size(a) + F.size(b) - 2 * shared, F.col("path")))
    best = near.groupBy("id").agg(F.min(F.struct("near", "path", "lines")).alias("m"), F.count("*").alias("candidate_count")).where(F.col("candidate_count") <= most)
    first, last = F.col("m.lines.first"), F.col("m.lines.last")
    return best.select("id", F.col("m.path").alias("path"), first.alias("start_line"), last.alias("end_line"), citation(F.col("m.path"), first, last, F.lit(None).cast("string")).alias("citation"), "candidate_count")
