import random

import numpy as np
import pytest
from pyspark.sql import types as T

from memloom.llm import langid

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.StringType())])


def brute_phrases(text, passages, piece):
    n = 0
    for lo in range(0, len(text), piece):
        s, i = text[lo : lo + piece], 0
        while i < len(s):
            k = 1
            while i + k < len(s) and any(s[i : i + k + 1] in p for p in passages):
                k += 1
            i += k
            n += 1
    return n


def test_phrases_equal_brute_force():
    r = random.Random(2)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(1, 5)))
    passages = {"p": [" ".join(word("abc") for _ in range(60)) for _ in range(3)], "q": [" ".join(word("bcdé") for _ in range(50))]}
    m = langid.CrossParser(passages)
    texts = [" ".join(word("abcdéz") for _ in range(n)) for n in (1, 5, 40, 300)]
    got = m.phrases([m.symbols(t) for t in texts])
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == [brute_phrases(t, passages[k], 10**9) for k in ("p", "q")]


def test_wide_alphabets_stay_small():
    r = random.Random(5)
    signs = lambda n: "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(n))
    passages = {"zh": [signs(600) for _ in range(64)], "en": ["the quick brown fox and the dog " * 18 for _ in range(64)]}
    m = langid.CrossParser(passages)
    assert sum(x.nbytes for x in (m.base, m.owner, m.target, m.of, m.root)) < 8_000_000
    texts = [passages["zh"][3][100:160], "the brown dog", signs(50) + " fox", "ж", "the 中"]
    assert m.predict(texts)[0][:2] == ["zh", "en"]
    for t, row in zip(texts, m.phrases([m.symbols(t) for t in texts]), strict=True):
        assert row.tolist() == [brute_phrases(t, [p.lower() for p in passages[k]], 10**9) for k in m.langs]


def test_ties_go_to_the_first_language():
    names, score = langid.CrossParser({"b": ["same words"], "a": ["same words"]}).predict(["same", "words same"])
    assert (names, score.tolist()) == (["a", "a"], [0, 0])


def test_long_texts_are_cut_into_lanes():
    m = langid.CrossParser({"p": ["ab ab ba"], "q": ["zz"]})
    assert m.predict(["ab " * 20_000 + "zz", None])[0] == ["p", "und"]


def test_defined_cases(spark):
    en, fr = "the quick thing and that other thing with them", "une chose et les autres choses avec eux à côté"
    rows = [(i, (en if i % 2 else fr) + f" {'x' * (i % 3)}", "en" if i % 2 else "fr", "clash") for i in range(60)]
    rows += [(100, None, "en", None), (101, "", "fr", None), (102, "123 !!", "en", None), (103, en, None, None), (103, en, None, None), (None, fr, "fr", None)]
    out = langid.fit_and_identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r in out:
        want = "und" if r.doc_id in (100, 101, 102) else "en" if r.text.startswith("the") else "fr"
        assert (r.language.lang, r.score) == (want, r.score) and 0 <= r.language.score <= 1
    assert langid.fit_and_identify(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = langid.fit_and_identify(spark.createDataFrame([(1, "abc", None, None)], SCHEMA)).collect()
    assert alone[0].language.lang == "und"


def test_null_keys_teach_and_columns_stay(spark):
    docs = spark.createDataFrame([(None, "only text here", "en", None)], SCHEMA)
    assert langid.fit_and_identify(docs).first().language.lang == "en"
    assert docs.select(langid.held_out(docs.doc_id).alias("x")).first().x is False
    with pytest.raises(ValueError, match="score"):
        langid.fit_and_identify(docs, into="score")


def test_sample_is_bounded(spark):
    rows = [(i, f"word{i} " * 500, "en", None) for i in range(400)]
    p = langid.labelled_passages(spark.createDataFrame(rows, SCHEMA), 64, 600, key="doc_id", text="text", lang="lang")
    assert len(p["en"]) == 64 and max(map(len, p["en"])) <= 600
    assert np.isfinite(langid.CrossParser(p).bits).all()


def test_rows_of_one_key_or_none_teach_as_many_passages(spark):
    for key in (None, 7):
        rows = [(key, f"{lang}word{i} and more of text {i}", lang, None) for i in range(200) for lang in ("en", "fr")]
        docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
        p = langid.labelled_passages(docs, 64, 600, key="doc_id", text="text", lang="lang")
        assert {k: len(v) for k, v in p.items()} == {"en": 64, "fr": 64}
