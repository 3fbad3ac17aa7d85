import random
import re
from collections import Counter, defaultdict

from memloom.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n string, docs string"


def brute(docs, min_docs, top):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", low)
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = set()
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        groups = {s: c for (la, s), c in counts.items() if la == lang}
        share = lambda c: {t: 1 + (10**9 * (c[t] + 2)) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(rows, 1)}
    return out


def check(spark, docs, min_docs=3, top=4):
    table = spark.createDataFrame([(i, *d, "clash", None, "x") for i, d in enumerate(docs)], DOCS).repartition(3)
    got = [tuple(r) for r in divergence.divergence(table, min_docs=min_docs, top=top).collect()]
    want = brute(docs, min_docs, top)
    assert set(got) == want and len(got) == len(want)
    return want


def test_equals_all_terms_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    vocab = ["The", "the", "Élan", "élan", "ÉLAN", "x1y", "日本", "a'b", "𝔘", " ", "zz"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    docs = [(" ".join(rnd.choices(vocab[: rnd.choice([8, 71])], k=rnd.randint(0, 30))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s0", "s1", "s2", "Ω", "é", None])) for _ in range(120)]
    docs += [(None, "en", "quiet"), ("", "xx", "a"), ("rare words here", "xx", "b"), (None, "yy", "alone"), ("the " * 50, "en", "s0"), ("the " * 50, "en", "s0")]
    want = check(spark, docs)
    assert {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)} <= want
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    monkeypatch.setattr(divergence, "SLICE", 7)
    assert list(b"".join(sum(divergence.slices("ab cd  efghijkl"), []))) == list(b"abcdefghijkl")
    check(spark, docs)


def test_counts_beyond_64_bits_of_product(spark):
    row = "9000000000L AS n, 123456789012L AS total, 7L AS kept"
    for n in (8_999_999_999, 9_000_000_000, 40_000_000_000):
        sql = f"SELECT {divergence.share('n', 'total', 'kept')} AS p FROM (SELECT {row.replace('9000000000L', f'{n}L')})"
        assert spark.sql(sql).head().p == 1 + 10**9 * (n + 2) // (123456789012 + 14)


def test_ties_hot_term_and_empty_table(spark):
    # Terms that tie are ranked by UTF-8, and one term in all documents of many sources is one list.
    docs = [("same " + ("Ω 𝔘 ～" if i % 2 else "b a"), "en", f"s{i % 30}") for i in range(300)]
    check(spark, docs, min_docs=10, top=2)
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
