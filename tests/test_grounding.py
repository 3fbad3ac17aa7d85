import math
import random

from memloom.operators import grounding

STEM = {"rivers": "river", "boats": "boat", "harbour": "harbour", "engines": "engin", "paints": "paint", "sails": "sail", "maps": "map", "tides": "tid", "v2.parser": "v2.parser", "zebra": "zebra"}


def stem_all(spark, names):
    from pyspark.sql import functions as F

    from memloom.functions import words

    return {r.w: r.s for r in spark.createDataFrame([(n,) for n in names], "w string").select("w", words.stem(F.col("w")).alias("s")).collect()}


def plain(rows, terms, packed, raw, stem):
    """Row by row, window by window."""
    terms = list(dict.fromkeys(t.strip().lower() for t in terms))
    terms = [t for t in terms if len(t) >= 3 and not t.isdigit()]
    stems = {stem[t] for t in terms}
    if len(terms) < 2 or len(stems) < 2 or not rows:
        return "GROUNDED", [], [], [], 1.0
    held = {}
    for i, s, a, b, text in rows:
        ws = {stem[w] for w in text.lower().split()}
        held[i] = {stem[t] for t in terms if stem[t] in ws or (any(c in t for c in "._-") and t in text.lower())}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] if r[2] is not None else r[0], r[0]))
    session = {r[0]: r[1] for r in rows}

    def near(x, y):
        if x[1] is None or x[1] != y[1]:
            return False
        if x[2] is not None and y[2] is not None:
            return max(x[2], y[2]) - min(x[3], y[3]) <= 1
        lo, hi = sorted((x[0], y[0]))
        return hi - lo <= 1 or (hi - lo <= 8 and all(m in session and session[m] != x[1] for m in range(lo + 1, hi)))

    windows = []
    for k, r in enumerate(order):
        w = set(held[r[0]])
        for o in (k - 1, k + 1):
            if 0 <= o < len(order) and near(r, order[o]):
                w |= held[order[o][0]]
        windows.append(w)
    joint = max(len(w) for w in windows) / len(stems)
    df = {s: sum(s in h for h in held.values()) for s in stems}
    rank = {}
    for k, i in enumerate(packed):
        for s in held[i]:
            rank.setdefault(s, k)
    anchors = sorted((t for t in terms if df[stem[t]] and stem[t] in rank), key=lambda t: (df[stem[t]], rank[stem[t]], -len(t)))
    unknown = [t for t in terms if len(t) >= 4 and not df[stem[t]]]
    share = lambda a, b: a == b or any(a in w and b in w for w in windows)
    loose = []
    if anchors:
        ceiling = max(3, len(rows) * 0.4)
        pool = [t for t in anchors if df[stem[t]] <= ceiling] or anchors
        one = pool[0]
        if rank[stem[one]] > 0:
            top = next((t for t in pool if rank[stem[t]] == 0), None)
            if top and not share(stem[one], stem[top]):
                one = top
        primary = {stem[one]}
        if len(stems) >= 3 and len(pool) >= 2:
            two = next((t for t in pool if stem[t] != stem[one] and share(stem[one], stem[t])), None)
            if two:
                primary.add(stem[two])
        loose = [t for t in terms if len(t) >= 4 and df[stem[t]] and stem[t] not in primary and not any(stem[t] in w and p in w for w in windows for p in primary)]
    scale = min(3.5, math.log10(len(rows) / 25)) if len(rows) >= 50 else 0
    kinds = len({stem[t] for t in anchors}), len({stem[t] for t in unknown}), len({stem[t] for t in loose})
    status = "GROUNDED"
    if len(stems) >= 3 and raw < 0.42 + 0.032 * scale and ((kinds[0] == 0 and joint <= 0.25) or (kinds[1] >= 2 and joint <= 0.34)):
        status = "UNSUPPORTED"
    elif kinds[0] >= 1 and raw < 0.50 + 0.045 * scale and joint < 0.65 and (kinds[1] or kinds[2]):
        status = "UNATTESTED_ATTRIBUTE"
    return status, anchors, unknown, loose, round(joint, 4)


def test_equals_a_reading_row_by_row(spark):
    rnd = random.Random(31)
    vocab = ["rivers", "boats", "harbour", "engines", "paints", "sails", "maps", "v2.parser", "filler", "other", "words"]
    asked = ["Rivers", "boats", "harbour", "engines", "paints", "sails", "maps", "tides", "zebra", "v2.parser", "42", "ab", "rivers"]
    stem = stem_all(spark, [*vocab, *asked, *map(str.lower, asked), "v2", "parser"])
    statuses = set()
    for n, few in ((0, 3), (30, 3), (140, 1)):
        rows = []
        for i in rnd.sample(range(1, n * 2 + 1), n):
            s = rnd.choice([1, 2, 3, None])
            a = rnd.randint(1, 40) if rnd.random() < 0.5 and s else None
            rows.append((i, s, a, a and a + rnd.randint(0, 2), " ".join(rnd.choices(vocab if few == 3 else vocab[2:] + ["filler"] * 20, k=few + rnd.randint(0, few)))))
        rows = [(*r[:4], r[4].replace("v2.parser", "xv2.parser") if r[0] % 2 else r[4]) for r in rows]
        queries, packed = [], []
        for q in range(60):
            raw = rnd.choice([0.3, 0.43, 0.49, 0.51, 0.9])
            queries.append((q, rnd.sample(asked, k=rnd.randint(0, 6)), raw))
            packed += [(q, r[0], k + 1) for k, r in enumerate(rnd.sample(rows, k=min(len(rows), rnd.randint(0, 5))))]
        table = spark.createDataFrame(rows, "id long, session_id long, first long, last long, content string").repartition(3)
        got = grounding.grounded(table, spark.createDataFrame(queries, "query_id long, terms array<string>, raw double"), spark.createDataFrame(packed, "query_id long, id long, rank long"))
        got = {r.query_id: (r.status, r.anchors, r.unattested, r.unlinked, r.joint) for r in got.collect()}
        # Words of a text are split where the operator splits them.
        for i, r in enumerate(rows):
            rows[i] = (*r[:4], r[4].replace("v2.parser", "v2.parser v2 parser"))
        for q, terms, raw in queries:
            want = plain(rows, terms, [i for k, i, _ in packed if k == q], raw, {**{w: w for r in rows for w in r[4].split()}, **stem})
            assert got[q] == want, (q, terms, raw)
            statuses.add(want[0])
    assert statuses == {"GROUNDED", "UNATTESTED_ATTRIBUTE", "UNSUPPORTED"}
