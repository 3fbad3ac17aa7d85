"""Source divergence audit: how far the word shares of the sources of a language are apart, from joint count histograms.

Terms are runs of letters A-Z (lower-cased) and of signs beyond ASCII; a language keeps those in at least ``min_docs`` of
its documents.  With c of a term's occurrences in a group, N of all kept terms' and V kept terms, p = 1 + floor(10^9 (c + 2) /
(N + 2 V)), and a term's part of a divergence is f = floor((p - q)^2 / (p + q)).  All of it depends on the two counts
alone, so a pair of sources is tallied by (count, count): combinations with two counts above zero come from the terms'
lists of sources, equal lists being one first; those with a zero are implied by each source's own histogram and by V.
f is evaluated once a combination and weighed by how many terms have it.  Integers throughout; counts of 9 * 10^9 and more
are multiplied as decimals.

Tasks count terms before the shuffle, a bounded number of entries at a time.  A term's list has one entry a source of its
language, and a pair of sources is one row of the result, so no group is larger than the result it stands for; pairs of
documents or of terms are never formed.

Defined cases: null text, language or source are ''; rows are documents, repeated ones too; a group without terms has all
counts 0; a language without kept terms has pairs of value 0 and no terms; texts are read whole, in slices where they are
long; empty tables give no rows; columns besides those named are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

MIN_DOCS, TOP = 10, 10
#: Entries (language, source, term) a task gathers before it passes them on.
ENTRIES = 400_000
#: Bytes of a text that are split at once.
SLICE = 4_000_000
#: A-Z to a-z, a-z and bytes beyond ASCII as they are, all others to blanks.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
#: Largest count that 10^9 can be multiplied with in 64 bits.
SMALL = 9_000_000_000


def slices(text: str):
    """Lists of the terms of a text, as bytes; a text of any length is cut at blanks."""
    b, at = text.encode().translate(BYTES), 0
    while at < len(b):
        to = b.find(b" ", at + SLICE)
        to = len(b) if to < 0 else to
        yield b[at:to].split()
        at = to


def term_counts(docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up in the tasks as far as memory is bounded."""

    def run(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for la, so, t in zip(*[batch.column(c).to_pylist() for c in ("lang", "source", "text")]):
                n, d = groups.setdefault((la, so), (Counter(), Counter()))
                before, mine = len(n), set()
                for terms in slices(t):
                    n.update(terms)
                    mine.update(terms)
                d.update(mine)
                size += 1 + len(n) - before
                if size > ENTRIES:
                    yield from partial(groups)
                    groups, size = {}, 0
        yield from partial(groups)

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = named.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # Dealt by term once: neither this sum nor the terms' lists need another shuffle.
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def partial(groups: dict) -> Iterator[pa.RecordBatch]:
    for (la, so), (n, d) in groups.items():
        yield pa.RecordBatch.from_pydict({"lang": [la] * len(n), "source": [so] * len(n), "term": [t.decode() for t in n], "n": list(n.values()), "docs": [d[t] for t in n]}, schema=COUNTED)


def share(n: str, total: str, kept: str) -> str:
    """p of a count, as an SQL expression."""
    return f"""1 + CASE WHEN {n} < {SMALL} THEN (1000000000L * ({n} + 2)) div greatest({total} + 2 * {kept}, 1L)
        ELSE (1000000000BD * CAST({n} + 2 AS DECIMAL(19, 0))) div greatest(CAST({total} + 2 * {kept} AS DECIMAL(20, 0)), 1BD) END"""


def part_of(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def sizes(docs: DataFrame, lists: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, total, kept, all): kept terms' occurrences in the group, kept terms and their occurrences in the language; one row a group."""
    named = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    mine = lists.select("lang", F.explode("per").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    whole = lists.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    return written(named.join(mine, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["total", "kept", "all"]))


def tallies(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, na, nb, terms) for sources a < b: how many kept terms have these two counts, zeros included."""
    alike = lists.groupBy("lang", "per").agg(F.count("*").alias("terms"))
    one = alike.select("lang", "terms", "per", F.posexplode("per").alias("i", "x"))
    both = one.select("lang", "terms", F.col("x.source").alias("a"), F.col("x.n").alias("na"), F.explode(F.expr("slice(per, i + 2, size(per))")).alias("y"))
    both = both.groupBy("lang", "a", F.col("y.source").alias("b"), "na", F.col("y.n").alias("nb")).agg(F.sum("terms").alias("terms"))
    # What has both counts above zero is taken off the sources' own histograms, and these off all kept terms.
    cells = "inline(array(struct(na, nb, terms), struct(na, 0L AS nb, -terms AS terms), struct(0L AS na, nb, -terms AS terms), struct(0L AS na, 0L AS nb, terms)))"
    own = one.groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n")).agg(F.sum("terms").alias("terms"))
    other = groups.select(F.col("lang").alias("l"), F.col("source").alias("o"))
    faced = own.join(other, (F.col("lang") == F.col("l")) & (F.col("source") != F.col("o")))
    ahead = F.expr("source < o")
    faced = faced.select("lang", F.least("source", "o").alias("a"), F.greatest("source", "o").alias("b"), F.when(ahead, F.col("n")).otherwise(F.lit(0)).alias("na"), F.when(ahead, F.lit(0)).otherwise(F.col("n")).alias("nb"), "terms")
    nil = groups.alias("g").join(other, (F.col("lang") == F.col("l")) & (F.col("source") < F.col("o"))).select("lang", F.col("source").alias("a"), F.col("o").alias("b"), F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), F.col("kept").alias("terms"))
    all_ = both.select("lang", "a", "b", F.expr(cells)).unionByName(nil)
    all_ = all_.unionByName(faced.select("lang", "a", "b", F.expr("inline(array(struct(na, nb, terms), struct(0L AS na, 0L AS nb, -terms AS terms)))")))
    return all_.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("terms").alias("terms"))


def divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source of the language, ``term`` rows for the ``top`` terms a source has more of."""
    counts = term_counts(docs, lang=lang, source=source, text=text)
    # A list holds one entry a source of the language.
    listed = counts.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("per"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    lists = written(listed.where(F.col("docs") >= min_docs).drop("docs"))
    groups = sizes(docs, lists, lang, source)
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("total").alias(f"total_{x}"), *(["kept"] if x == "a" else []))
    weighed = tallies(lists, groups).join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    weighed = weighed.withColumns({"p": F.expr(share("na", "total_a", "kept")), "q": F.expr(share("nb", "total_b", "kept"))})
    pairs = weighed.groupBy("lang", "a", "b").agg(F.sum(F.expr(f"CASE WHEN terms > 0 THEN terms * ({part_of('p', 'q')}) ELSE 0L END")).alias("value"))
    pairs = pairs.select("lang", F.expr("inline(array(struct(a AS source, b AS item), struct(b AS source, a AS item)))"), "value")
    terms = lists.select("lang", "term", F.explode("per").alias("x"), F.col("total").alias("n")).select("lang", "x.source", F.col("term").alias("item"), F.col("x.n").alias("mine"), "n")
    terms = terms.join(groups, ["lang", "source"]).withColumns({"p": F.expr(share("mine", "total", "kept")), "q": F.expr(share("n", "`all`", "kept"))})
    terms = terms.where("p > q").select("lang", "source", "item", F.expr(part_of("p", "q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", place).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("rank", place).where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op12_count_histograms(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


SQL = """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
keep AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN keep USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM keep GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(any_value(v), 0)::HUGEINT AS v, coalesce(any_value(whole), 0)::HUGEINT AS whole, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang) LEFT JOIN c ON c.lang = x.lang AND c.source = x.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.n + 2 * v) AS p, 1 + (1000000000 * (k.total + 2)::HUGEINT) // (g.whole + 2 * v) AS q FROM g JOIN keep k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""
