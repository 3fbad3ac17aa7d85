import random
import re
from collections import Counter, defaultdict

import numpy as np

from memloom.llm import filters

DOCS = "doc_id long, text string, source string, mask string, part string, docs string, key string"


def brute(docs, labels):
    """Every order and step, document by document."""
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    judged = []
    for key, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": key is not None and any(k is not None and k < key and (o or "") == t for k, o, _ in docs)}
        judged.append((source or "", fails, key in good, key in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        mine = [j[1:] for j in judged if j[0] == part]
        shapley = Counter()
        for order in filters.ORDERS:
            left = mine
            for step, f in enumerate(order, 1):
                removed = [j for j in left if j[0][f]]
                left = [j for j in left if not j[0][f]]
                shapley[f] += len(removed)
                earlier = sum(j[0][f] and any(j[0][g] for g in order[: step - 1]) for j in mine)
                alone = sum(j[0][f] and sum(j[0].values()) == 1 for j in mine)
                out[part, order, step] = [len(left), len(removed), earlier, alone, sum(j[1] for j in removed), sum(j[2] for j in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_equals_every_order_tried_out(spark):
    rnd = random.Random(2)
    vocab = ["alpha", "Beta", "GAMMA", "d$", "é", "Ω", "x1"] + [f"w{i}" for i in range(80)]
    texts = [None, "", " \t\n", "\x0b\x0c", " ", "A", "#", "one two"] + [" ".join(rnd.choices(vocab[: rnd.choice([3, 40, 87])], k=rnd.randint(0, 120))) for _ in range(60)]
    docs = [(i, rnd.choice(texts), rnd.choice(["s0", "s1", None, ""])) for i in range(150)] + [(None, "one two", "s0"), (3, "one two", "s1"), (3, "one two", "s1"), (3, "one two", "s0"), (None, "", "s1")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, "clash", "clash", None, "x") for d in docs], DOCS).repartition(3)
    got = filters.audit(filters.masks(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    want = brute(docs, [x for x in labels if x[0] is not None])
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == want and len(got) == len(want)


def test_outcomes_cover_each_document_once():
    m = filters.outcomes()
    assert m["kept"].shape == (32, 600)
    # After each step a document is kept, or went at this step or an earlier one.
    steps = m["removed"].reshape(32, 120, 5).cumsum(axis=2) + m["kept"].reshape(32, 120, 5)
    assert np.array_equal(steps, np.ones((32, 120, 5), dtype=np.int64))
    assert m["unique"].sum() == 5 * 120


def test_empty_tables_and_one_hot_text(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(filters.masks(docs, labels)).count() == 0
    hot = spark.range(3000).selectExpr("id AS doc_id", "'the same' AS text", "'s' AS source")
    rows = filters.audit(filters.masks(hot, labels)).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [r.kept for r in rows] == [1, 0, 0, 0, 0] and rows[0].removed == 2999 and rows[1].redundant == 2999
    totals = defaultdict(int)
    for r in filters.audit(filters.masks(hot, labels)).collect():
        totals[r.filter_order] += r.removed
    assert set(totals.values()) == {3000}
