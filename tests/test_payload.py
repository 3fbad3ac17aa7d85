import math
import random

from pyspark.sql import functions as F

from memloom.operators import payload


def tokens(t):
    return math.ceil(len(t) / 4)


def clamp(t, n):
    return t if tokens(t) <= n else t[: max(1, 4 * n - 2)].rstrip(" \n\t\r")


def plain(entries, query, budget, status, n, state, timeline, section, badge):
    """One text after another, until it fits."""
    budget, entries, shed = min(max(budget or 4000, 100), 32000), list(entries), []

    def text():
        return f'{state}# Context for "{query}"\n**Status**: {status} | **Items**: {len(entries)} / {n}{" | " + badge if badge else ""}\n\n{section}{timeline}{"".join(entries)}'

    over = lambda: tokens(text()) - budget
    if over() > 0 and timeline:
        timeline, shed = "", [*shed, "timeline"]
    if over() > 0 and len(entries) > 1:
        shed.append("entries")
        while over() > 0 and len(entries) > 1:
            entries.pop()
    if over() > 0 and badge:
        badge, shed = "", [*shed, "badge"]
    if over() > 0 and section:
        left = tokens(section) - over() - 4
        section, shed = clamp(section, left).rstrip(" \n\t\r") + "\n\n" if left >= 12 else "", [*shed, "status"]
    if over() > 0 and len(entries) == 1:
        left = tokens(entries[0]) - over() - 3
        entries, shed = [clamp(entries[0], left).rstrip(" \n\t\r") + "\n"] if left >= 10 else [], [*shed, "last entry"]
    if over() > 0 and state:
        left = tokens(state) - over() - 3
        state, shed = clamp(state, left).rstrip(" \n\t\r") + "\n\n" if left >= 12 else "", [*shed, "state"]
    if over() > 0:
        shed.append("end")
    return clamp(text(), budget), len(entries), shed


def test_what_goes_first(spark):
    rnd = random.Random(17)
    words = lambda n: " ".join(rnd.choice(["alpha", "be", "gamma delta", "x"]) for _ in range(n)) + ("\n" if n else "")
    heads, packed, want = [], [], {}
    for q in range(300):
        mine = [words(rnd.choice([3, 20, 60])) for _ in range(rnd.choice([0, 1, 1, 2, 5, 12]))]
        head = (q, words(rnd.choice([1, 1, 200]))[:-1], rnd.choice([None, 10, 120, 200, 400, 1000]), "SUPPORTED", rnd.randint(0, 200), words(rnd.choice([0, 30, 200])), words(rnd.choice([0, 40])), words(rnd.choice([0, 20, 150])), rnd.choice(["", "2 unknown"]))
        heads.append(head)
        packed += [(q, k, e) for k, e in enumerate(mine)]
        want[q] = plain(mine, *head[1:])
    h = spark.createDataFrame(heads, "query_id long, query string, budget int, epistemic_status string, n_candidates int, state string, timeline string, status_text string, badge string")
    h = h.withColumn("badge", F.when(F.col("badge") != "", F.col("badge")))
    got = payload.assembled(spark.createDataFrame(packed, "query_id long, rank int, entry string").repartition(3), h).collect()
    budgets = {r[0]: min(max(r[2] or 4000, 100), 32000) for r in heads}
    seen = set()
    for r in got:
        assert (r.text, r.n_packed, r.shed) == want[r.query_id] and r.tokens == tokens(r.text) <= budgets[r.query_id]
        seen |= set(r.shed)
    assert len(got) == 300 and seen == {"timeline", "entries", "badge", "status", "last entry", "state", "end"}


def test_entries_fill_the_room_in_order(spark):
    rnd = random.Random(5)
    items = [(q, k, "memory", f"#{k}", f"text {k} " + "y" * rnd.choice([10, 300, 900]), 0.1 + k / 100, room) for q, (n, room) in enumerate([(3, 40), (40, 5000), (40, 600), (1, 24), (2, 5), (35, 4000)]) for k in range(n)]
    got = {}
    for r in payload.entries(spark.createDataFrame(items, "query_id long, rank int, kind string, title string, content string, score double, room long")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.entry, r.used))
    for q in range(6):
        mine = [i for i in items if i[0] == q]
        room, used, want = mine[0][6], 0, []
        for k, i in enumerate(mine):
            most = (680 if k < 8 else 440 if k < 20 else 320) if len(mine) >= 30 and room >= 4000 else 4000
            head, body = f"### [MEMORY] {i[3]} (Score: {i[5] * 100:.1f}%)\n", i[4][:most].strip()
            entry = f"{head}{body}\n\n---\n"
            if used + tokens(entry) > room:
                if want:
                    break
                left = max(12, room * 4 - 2) - len(head) - 6
                entry = f"{head}{body[:left].rstrip()}\n\n---\n" if left >= 8 else entry
                entry = entry if tokens(entry) <= room else entry[: 4 * room - 2].rstrip(" ")
            used += tokens(entry)
            want.append((i[1], entry, used))
        assert got[q] == want


def test_room(spark):
    rows = [(limit, state, n, t, p) for limit in (100, 399, 400, 1999, 2000, 8000) for state in (0, 50, 3000) for n in (5, 30) for t in (False, True) for p in (False, True)]
    df = spark.createDataFrame(rows, "limit long, state long, n long, t boolean, p boolean")
    for r in df.withColumn("room", payload.room(F.col("limit"), F.col("state"), F.col("n"), temporal=F.col("t"), panorama=F.col("p"))).collect():
        left = max(40, r.limit - r.state)
        least = min(max(42, math.floor(left * 0.36)), 180)
        reserve = least
        if r.limit >= 2000 and r.n >= 30:
            reserve = min(math.floor(left * 0.5), 980 if r.t else 400 if r.p else 280)
        elif 400 <= r.limit < 2000:
            reserve = max(least, min(450, math.floor(left * 0.3)) if r.t else min(220 if r.p else 140, math.floor(left * (0.22 if r.p else 0.16))))
        assert r.room == max(24, left - reserve)
