"""Concatenate and cut: fixed token windows over the whole corpus.

Pass 1 tokenises every document once, inside its input partition, and writes the token ids with each document's
offset *within its partition*.  Partition totals (one row per partition) are prefix-summed into global offsets.
Pass 2 is JVM-only: a document's global range is cut at multiples of ``length``; every cut is a boundary record
(sequence_id, offset, start, length), so a sequence is the gapless run of its records and only the last sequence of
the corpus can be short.

Defined cases: a null text is the empty text and packs as its end id alone; repeated rows (same id or text) are packed
once per row; empty tables give no rows; a null key is carried through; columns besides key and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Words a worker remembers with their ids, in each of two generations (about 70 MB each), and their bytes at most; frequent words move
#: to the new one, longer words are forgotten after each use.
CACHE_WORDS, CACHE_BYTES = 350_000, 64
#: Tokens kept in one stored row; longer documents take several rows, so that no row is unbounded.
SLAB_TOKENS = 16 * 2048
#: Words encoded by one call of the tokenizer.
GROUP = 1024
MARKS = ".,;:!?#$%&*()-\"/"
_ENCODERS: dict = {}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    ``by_word`` is for tokenizers that drop white space, lower-case, part letters from other signs and close every part
    with an end-of-word token: each white-space-separated chunk then encodes alone, and chunks seen before are looked up.
    Chunks of Latin letters with marks behind skip the normaliser; all others take the tokenizer's whole path, and so do
    whole texts that hold the string of an added token, which the tokenizer reads as that token.
    """

    def __init__(self, path: str, by_word: bool, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.by_word, self.cache_words = by_word, cache_words
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        if by_word:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.tok.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, chunks: list[bytes]) -> None:
        parts: dict[bytes, tuple[str, ...]] = {}
        for w in chunks:
            c = w.decode()
            s = c.rstrip(MARKS)
            low = s.lower()
            # A letter that becomes letter and combining mark is parted there.
            if low.isalpha() and (s.isascii() or max(s) < "\u0250"):
                parts[w] = (low, c[len(s) :]) if len(s) < len(c) else (low,)
            else:
                self.new[w] = self._whole(c)
        ids, pieces = {}, list({p for ps in parts.values() for p in ps})
        for i in range(0, len(pieces), GROUP):
            mine = pieces[i : i + GROUP]
            got = np.array(self.plain.encode_batch_fast([" ".join(mine)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = ((np.flatnonzero(self.ends[got]) + 1) * 4).tolist()
            raw, at = got.tobytes(), 0
            for piece, stop in zip(mine, stops, strict=True):
                ids[piece] = raw[at:stop]
                at = stop
        for w, ps in parts.items():
            self.new[w] = b"".join([ids[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        special = [not self.by_word or any(a in t for a in self.added) for t in texts]
        if any(special):
            rest = iter(self._by_word([t for t, q in zip(texts, special, strict=True) if not q]))
            return [self._whole(t) if q else next(rest) for t, q in zip(texts, special, strict=True)]
        return self._by_word(texts)

    def _by_word(self, texts: list[str]) -> list[bytes]:
        lists = []
        for t in texts:
            b = t.encode()
            # The tokenizer lower-cases after composing accents: lower-case first only where no combining mark follows a letter.
            lists.append((b if b"\xcc" in b or b"\xcd" in b else b.lower()).split())
        if len(self.new) > self.cache_words:
            self.old, self.new = self.new, {}
        fresh = []
        for w in set().union(*lists).difference(self.new):
            if w in self.old:
                self.new[w] = self.old[w]
            else:
                fresh.append(w)
        self._learn(fresh)
        get = self.new.__getitem__
        out = [b"".join(map(get, words)) for words in lists]
        for w in fresh:
            if len(w) > CACHE_BYTES:
                del self.new[w]
        return out


def encoder(*key) -> Encoder:
    """The worker's encoder for (path, by_word, cache_words)."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def tokenised(docs: DataFrame, path: str, *, end_id: int, key: str, text: str, by_word: bool, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(part, at, key, first, n, doc_tokens, ids): ``at`` is the row's first token within its partition, ``first`` within its document."""
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("key", docs.schema[key].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("first", "n", "doc_tokens")]
        + [T.StructField("ids", T.BinaryType())]
    )
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path, by_word, cache_words)
        for pdf in batches:
            for lo in range(0, len(pdf), 200):
                keys = pdf["key"].iloc[lo : lo + 200]
                rows = []
                for k, ids in zip(keys, enc.encode([t or "" for t in pdf["text"].iloc[lo : lo + 200]])):
                    ids += end
                    total = len(ids) // 4
                    for first in range(0, total, SLAB_TOKENS):
                        n = min(SLAB_TOKENS, total - first)
                        rows.append((part, at, k, first, n, total, ids[4 * first : 4 * (first + n)]))
                        at += n
                yield pd.DataFrame(rows, columns=schema.names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, schema)


def pack(
    docs: DataFrame, tokenizer_path: str, *, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", by_word: bool = True, cache_words: int = CACHE_WORDS
) -> DataFrame:
    """One row per piece: key, start, length, ids (uint32 bytes), doc_tokens, sequence_id, offset; see the module's text."""
    tokens = written(tokenised(docs, tokenizer_path, end_id=end_id, key=key, text=text, by_word=by_word, cache_words=cache_words))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    # One row per input partition, whatever the number of documents.
    bases = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    begin = F.col("base") + F.col("at")
    cut = (
        tokens.join(F.broadcast(bases), "part")
        .withColumn("begin", begin)
        .withColumn("sequence_id", F.explode(F.expr(f"sequence(begin div {length}, (begin + n - 1) div {length})")))
        .withColumn("lo", F.greatest("begin", F.col("sequence_id") * length))
        .withColumn("hi", F.least(F.col("begin") + F.col("n"), (F.col("sequence_id") + 1) * length))
    )
    return cut.select(
        F.col("key").alias(key),
        (F.col("first") + F.col("lo") - F.col("begin")).alias("start"),
        (F.col("hi") - F.col("lo")).alias("length"),
        F.expr("substring(ids, cast((lo - begin) * 4 + 1 as int), cast((hi - lo) * 4 as int))").alias("ids"),
        "doc_tokens",
        "sequence_id",
        (F.col("lo") - F.col("sequence_id") * length).alias("offset"),
    )


def pack_digest(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """``pack`` with each piece's ids replaced by their crc32."""
    return pack(docs, tokenizer_path, **options).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
