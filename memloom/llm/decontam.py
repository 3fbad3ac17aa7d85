"""Benchmark decontamination with Aho-Corasick automata over normalised words.

Texts are lower-cased (A-Z) and cut into words of digits, letters a-z and non-ASCII characters.  Every run of
``window`` consecutive words of an item is a pattern (an item of fewer words is one pattern).  The automaton's symbols
are word numbers, so one scan of a document's word numbers finds every pattern; hit words are mapped back to code-point
spans of the original text.  Documents never move: the patterns go to the documents.

The benchmark is a stated query set.  It is streamed through the driver in shards of at most ``shard_words`` words
(longer items are cut into overlapping pieces); a pass over the documents scans for one shard and adds its hits to those
of the passes before, so a worker holds one automaton whatever the benchmark's size, and spans are always those of the
union of all hits.  A benchmark of one shard, the usual case, is one scan.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item matches nothing; a null
item_id counts for hits but is not listed; repeated items and ids are listed once; empty tables give empty results;
other columns are kept as they are, and a table that has a column named like ``into`` is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, table, written

#: Bytes that are no word characters become blanks, A-Z become a-z; bytes of non-ASCII characters stay.
TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile(rb"[^\x20]+")
RESULT = "n_words long, n_hit long, items array<string>, hit_words array<int>, spans array<struct<start:int,end:int>>"
_AUTOMATA: dict = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class Automaton:
    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        import ahocorasick

        self.vocab: dict[bytes, int] = {}
        self.patterns: list[tuple[int, set]] = []
        at: dict[tuple, int] = {}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for item, ws in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]
            for i in range(max(1, len(ids) - window + 1)):
                key = tuple(ids[i : i + window])
                if key not in at:
                    at[key] = len(self.patterns)
                    self.patterns.append((len(key), set()))
                    self.trie.add_word(key, at[key])
                if item is not None:
                    self.patterns[at[key]][1].add(item)
        if at:
            self.trie.make_automaton()
        self.any = bool(at)

    def scan(self, text: str | None, items: set, before: list) -> tuple:
        """Items and hit words of ``text``, with those of earlier scans."""
        raw = (text or "").encode()
        clean = raw.translate(TABLE)
        ws = clean.split()
        get = self.vocab.get
        ids = tuple([get(w, 0) for w in ws])
        found = list(self.trie.iter(ids)) if self.any and ids else []
        if not found and not before:
            return len(ws), 0, sorted(items), [], []
        edge = np.zeros(len(ws) + 1, dtype=np.int64)
        for end, k in found:
            n, of = self.patterns[k]
            edge[end - n + 1] += 1
            edge[end + 1] -= 1
            items |= of
        hit = np.cumsum(edge[:-1]) > 0
        hit[before] = True
        at = [m.span() for m in WORD.finditer(clean)]
        point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
        turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
        spans = [{"start": int(point[at[a][0]]), "end": int(point[at[b - 1][1]])} for a, b in zip(turns[::2], turns[1::2], strict=True)]
        return len(ws), int(hit.sum()), sorted(items), np.flatnonzero(hit).tolist(), spans


def shards(benchmark: DataFrame, item_id: str, text: str, window: int, shard_words: int) -> Iterator[list]:
    part, n = [], 0
    step = max(1, shard_words - window + 1)  # pieces of a long item share window - 1 words, so that no window is cut
    for item, t in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        ws = words(t)
        for lo in range(0, max(1, len(ws) - window + 1), step):
            if piece := ws[lo : lo + step + window - 1]:
                part.append((item, piece))
                n += len(piece)
            if n >= shard_words:
                yield part
                part, n = [], 0
    if part:
        yield part


def scanner(spark, items: list, window: int):
    import uuid

    sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if name not in _AUTOMATA:
            _AUTOMATA.clear()  # workers live on between passes and queries
            _AUTOMATA[name] = Automaton(sent.value, window)
        automaton = _AUTOMATA[name]
        for texts, seen, hits in batches:
            rows = [automaton.scan(t, set(() if i is None else i), [] if h is None else list(h)) for t, i, h in zip(texts, seen, hits, strict=True)]
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "hit_words", "spans"])

    return scan


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 13,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_words: int = 200_000,
    into: str = "overlap",
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, items, hit_words, spans, contaminated (at least 5 % of the words hit)."""
    spark, out, so_far = docs.sparkSession, docs, None
    nothing = (F.lit(None).cast("array<string>"), F.lit(None).cast("array<int>"))
    for shard in shards(benchmark, item_id, item_text, window, shard_words):
        if so_far is not None:
            out = written(out)
        hits = nothing if so_far is None else (F.col(into)["items"], F.col(into)["hit_words"])
        found = scanner(spark, shard, window)(F.col(text), *hits)
        out = added(out, into, found) if so_far is None else out.withColumn(into, found)
        so_far = shard
    if so_far is None:
        out = added(out, into, scanner(spark, [], window)(F.col(text), *nothing))
    r = F.col(into)
    return out.withColumn(into, r.withField("contaminated", (r["n_hit"] > 0) & (r["n_hit"] * 20 >= r["n_words"])))


def op9_aho_corasick(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = F.col("overlap")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        r["n_words"].alias("n_words"),
        r["n_hit"].alias("n_hit"),
        F.size(r["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(r["items"], ","), 256).alias("items_sha256"),
        r["contaminated"].alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT n, item_id, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM dw JOIN pat USING (n, p)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.l, '')) AS items_sha256,
coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
