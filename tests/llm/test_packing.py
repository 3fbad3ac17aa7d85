import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from memloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("part", T.LongType())])
TEXTS = [
    "Hello, WORLD it's\n\nfine <|endoftext|> 12 34",
    None,
    "",
    "Éa é J̌ x\x01y \x1c z q   ñandú ΣΑΣ",
    "word " * 40_000,
    "same text",
    "same text",
    "x" * 5000,
    "İstanbul İ. ŉa ǅ ß ſ Ⅷ",
    "<|startoftext|>a<|ENDOFTEXT|> b<|endoftext|><|endoftext|>İ",
    "don't Ü'S we'LL Ǆ!! e\u0301E\u0301 K\u212a \u1e9e",
]


def direct(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_word_cache_equals_direct_encoding():
    enc = packing.Encoder(PATH, True)
    for text, raw in zip(TEXTS, enc.encode([t or "" for t in TEXTS]), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == direct(text)


def test_every_letter_below_0x250_and_random_strings():
    r = random.Random(3)
    letters = [chr(c) for c in range(0x20, 0x250)] + ["\u0307", "\u0301", "\u03a3", "\u2028", "\u00a0", "'s", "<|endoftext|>"]
    texts = [f"a{c}b {c} {c}{c}." for c in letters] + ["".join(r.choices(letters, k=40)) for _ in range(400)]
    one = Tokenizer.from_file(PATH)
    for text, raw in zip(texts, packing.Encoder(PATH, True).encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == one.encode(text, add_special_tokens=False).ids, text


def test_pieces_rebuild_every_document(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(5, "same text", "clash", 7), (None, "no id", None, None)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, length=64).collect()
    assert sum(r.length for r in out) == sum(len(direct(t)) + 1 for _, t, _, _ in rows)
    for i, t in enumerate(TEXTS):
        want = np.array(direct(t) + [1], "<u4").tobytes()
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert all(r.doc_tokens == len(want) // 4 for r in mine)
        if i != 5:  # the row given twice has every piece twice
            assert b"".join(bytes(r.ids) for r in mine) == want
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s, parts in seqs.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or s == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))


def test_digest_and_empty(spark):
    one = packing.pack_digest(spark.createDataFrame([(3, "a b c", None, None)], SCHEMA), PATH).collect()
    want = np.array(direct("a b c") + [1], "<u4").tobytes()
    assert [(r.doc_id, r.start, r.length, r.ids_crc32) for r in one] == [(3, 0, len(want) // 4, zlib.crc32(want))]
    assert packing.pack_digest(spark.createDataFrame([], SCHEMA), PATH).collect() == []
