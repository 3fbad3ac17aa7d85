import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from memloom.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
ONE = Tokenizer.from_file(PATH)
PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "'ve", "ll", "<|endoftext|>", "<|endof", "é", "日本", "ß", "1", "23", ".", "!!", "\x1c", "\x85", "|>", "ing", "tion", "😀",
          "é", "\r\n", "L'été", "#", "    ", "s", "م", " ", "Ǆ", "×", "\x00"]


def encoded(text):
    return len(ONE.encode(text or "", add_special_tokens=False).ids)


def prefixes(steps):
    return np.cumsum(np.frombuffer(steps, dtype=np.int8), dtype=np.int64).tolist()


def test_every_prefix_counts_as_the_library_counts_it():
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 14))) for _ in range(1500)]
    for text, steps in zip(texts, tokencount.PrefixCounter(PATH).steps(texts), strict=True):
        assert prefixes(steps) == [encoded(text[:i]) for i in range(1, len(text) + 1)], repr(text)


def test_long_units_runs_and_texts(monkeypatch):
    rnd = random.Random(7)
    texts = ["".join(rnd.choices("abcdeéß日", k=400)), " " * 300 + "x", "x" + "\n" * 150 + "y" + "-" * 333, "=" * 200 + "<|endoftext|>" + "a" * 90]
    for text, steps in zip(texts, tokencount.PrefixCounter(PATH).steps(texts), strict=True):
        got = prefixes(steps)
        assert all(got[i - 1] == encoded(text[:i]) for i in range(1, len(text) + 1))
    monkeypatch.setattr(tokencount, "CHUNK", 50)
    monkeypatch.setattr(tokencount, "KNOWN", 20)
    texts = [" ".join(rnd.choices(["hello", "  world", "it's\n", "<|endoftext|>", "x" * 70], k=60)) for _ in range(20)]
    assert [tokencount.total(s) for s in tokencount.PrefixCounter(PATH).steps(texts)] == [encoded(t) for t in texts]


def test_pairs_forgotten_are_asked_again(monkeypatch):
    monkeypatch.setattr(tokencount, "PAIRS", 2)
    text = "reticulated splines, unbelievable antidisestablishmentarianism; donaudampfschifffahrt"
    (steps,) = tokencount.PrefixCounter(PATH).steps([text])
    assert prefixes(steps) == [encoded(text[:i]) for i in range(1, len(text) + 1)]


def test_counts_truncation_and_budgets(spark):
    texts = [None, "", "same text", "same text", "don'll you'll we'l", "<|endoftext|> a <|endoftext", "word " * 30_000, "日本語のテキスト " * 50]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(2, "same text", None, None)], "doc_id long, text string, n_tokens string, steps string").repartition(3)
    out = tokencount.counted(docs, PATH)
    assert out.columns == ["doc_id", "text", "n_tokens", "steps", "tokens"]
    rows = out.collect()
    assert len(rows) == 9
    for r in rows:
        t = r.text or ""
        assert (r.tokens.n_bytes, r.tokens.n_tokens, len(r.tokens.steps)) == (len(t.encode()), encoded(t), len(t))
    asked = out.select("doc_id", "text", tokencount.count_at(F.col("tokens.steps"), 7).alias("at"), tokencount.longest_prefix(F.col("tokens.steps"), 6).alias("longest"))
    cut = {r.doc_id: r.text for r in tokencount.truncated(out, 6).collect()}
    for r in asked.collect():
        t = r.text or ""
        assert r["at"] == encoded(t[:7])
        if len(t) < 1000:
            assert r.longest == max(i for i in range(len(t) + 1) if encoded(t[:i]) <= 6)
        assert cut[r.doc_id] == (None if r.text is None else t[: r.longest])
    total, want = 0, []
    for i, t in sorted([*enumerate(texts), (2, "same text")], key=lambda x: x[0]):
        want.append((i, encoded(t), total, total + encoded(t) <= 20))
        total += encoded(t)
    assert sorted(map(tuple, tokencount.within_budget(out, 20).select("doc_id", "n_tokens", "before", "fits").collect())) == want
    with pytest.raises(ValueError):
        tokencount.counted(docs, PATH, into="steps")
    assert tokencount.counted(docs.limit(0), PATH).count() == 0


def test_query_over_the_table(spark):
    rows = tokencount.op13_prefix_counts(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {(i, len((t or "").encode()), encoded(t), encoded(t) > 512) for i, t in texts.items()}
    assert isinstance(tokencount.SCHEMA["steps"].dataType, T.BinaryType)
