import random
import re

from pyspark.sql import functions as F

from memloom.functions import condense

MONTHS = r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2}"


def plain(text, most):
    def shrink(raw, n):
        def one(m):
            label = f"{m[1]} code" if m[1] else "code"
            keep = [s.strip(" ") for s in m[2].split("\n")]
            keep = [s for s in keep if re.match(condense.SIGNATURE, s)][:n]
            return f"[{label}: {'; '.join(keep)}]" if keep else f"[{label} block]"

        return re.sub(r"```([\w-]*)\n([\s\S]*?)```", one, raw)

    clean = text or ""
    for p in (r"Copyright\s+(?:\(c\)|©)?\s*\d{4}.*$", r"All\s+rights\s+reserved\.?"):
        clean = re.sub(p, "", clean, flags=re.I | re.M)
    clean = re.sub(r"<!--[\s\S]*?-->", "", clean)
    if not most or len(clean) <= most:
        return clean
    m = re.match(r"^([\s\S]*?\bUSER:\s*)([\s\S]*?)\s*\|\s*ASSISTANT:\s*([\s\S]*)$", clean, re.I)
    if not m:
        return clean[:most]
    room = max(80, most - len(m[1]) - 15)
    share = int(room * (0.68 if most <= 260 else 0.62))
    rest = max(30, room - share)
    said = re.sub(r"```[\s\S]*?```", " ", m[2]) if most <= 360 else shrink(m[2], 5)
    flat = re.sub(r"\s+", " ", said).strip(" ")
    if len(flat) <= share:
        user = flat
    else:
        dates = [re.sub(r"\s*\([^)]*\)", "", re.sub(r"\*\*", "", re.sub(r"^[-*]\s*", "", s.strip(" ")))) for s in said.split("\n")]
        dates = [s for s in dates if re.search(MONTHS, s, re.I)]
        if len(dates) >= 2 and share >= 220:
            dated = " | ".join(dates)
            left = share - len(dated) - 3
            user = f"{flat[:left]} | {dated}" if left >= 16 else dated[-share:]
        else:
            user = f"{flat[: int(share * 0.78)]} ... {flat[-int(share * 0.18) :]}"
    kinds = ([], [], [])
    for s in filter(None, (x.strip(" ") for x in shrink(m[3], 4).split("\n"))):
        bare = re.sub(r"\*\*", "", re.sub(r"^#{1,6}\s*", "", s))
        kinds[0 if re.search(MONTHS, s, re.I) or re.match(r"#{1,6}\s", s) else 1 if re.match(r"(\d+\.\s+|-\s+[A-Z])", s, re.I) else 2].append(bare)
    joined = re.sub(r"\s{2,}", " ", " | ".join([*kinds[0][:14], *kinds[1][:12], *kinds[2][:3]])).strip(" ")
    return f"{m[1]}{user} | ASSISTANT: {joined[:rest]}"


def test_condensed_turns_equal_a_line_by_line_reading(spark):
    rnd = random.Random(21)
    lines = ["plain words of a line that says something", "# Heading one", "- Listed point", "3. third point", "- **Due** March 12 (draft)", "May 5 is the day", "", "  blanks  ", "**bold**", "All rights reserved.", "Copyright (c) 2021 Someone",
             "```sql\nSELECT 1;\n-- note\nCREATE TABLE t(x);\n```", "```\nfoo\n```", "```py\ndef a():\n  class B: pass\nconst x\ngit status\nexport y\nrevision z\n```", "<!-- hid\nden -->", "December 24", "long " * 30]
    texts = [None, "", "no turn at all " * 40]
    for _ in range(300):
        user, other = ("\n".join(rnd.choices(lines, k=rnd.randint(0, 14))) for _ in range(2))
        texts.append(rnd.choice(["[Session 3 | Turn #1] ", "", "x\n"]) + rnd.choice(["USER: ", "user:"]) + user + rnd.choice([" | ASSISTANT: ", "|assistant:"]) + other)
    rows = spark.createDataFrame([(i, m, t) for i, t in enumerate(texts) for m in (0, 60, 240, 330, 440, 680, 1500)], "i long, most int, text string").repartition(3)
    got = rows.select("i", "most", condense.condensed(F.col("text"), F.col("most")).alias("c")).collect()
    for r in got:
        assert r.c == plain(texts[r.i], r.most), (texts[r.i], r.most)
