from pyspark.sql import types as T

from memloom.llm import chat

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("speaker", T.StringType())])


def run(spark, rows, **options):
    return chat.rotate(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), **options).collect()


def test_every_participant_is_the_assistant_once(spark):
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann", "hé 😀"), (1, 2, "bob", "hello"), (1, 3, "ann", "bye"), (1, 4, "cy", None)]
    got = {r.speaker: r for r in run(spark, rows)}
    assert set(got) == {"ann", "bob", "cy"}
    assert got["bob"].text == "<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>user name=ann\nhé 😀<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user name=ann\nbye<|im_end|>\n<|im_start|>user name=cy\n<|im_end|>\n"
    own = {k: [r.text[m.start : m.end] for m in r["mask"]] for k, r in got.items()}
    assert own == {"ann": ["hé 😀<|im_end|>\n", "bye<|im_end|>\n"], "bob": ["hello<|im_end|>\n"], "cy": ["<|im_end|>\n"]}


def test_defined_cases(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 0, "system", "alone")]) == []
    got = run(spark, [(None, None, None, "a"), (2, 5, "u", "b"), (2, 5, "u", "b")])
    assert sorted((str(r.conv_id), r.speaker, r.n_turns, r.n_own) for r in got) == [("2", "u", 2, 2), ("None", "unknown", 1, 1)]


def brute(rows, max_turns, max_chars):
    """The whole rendering of every participant, cut where the rows' numbers and characters say so."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "unknown", x or "") for c, t, r, x in rows if c == conv), key=lambda r: (r[2] != "system", *r))
        for speaker in {r[2] for r in mine} - {"system"}:
            parts, at, chars = {}, 0, 0
            for k, (_, _, role, text) in enumerate(mine):
                name = "system" if role == "system" else "assistant" if role == speaker else f"user name={role}"
                head, body = f"<|im_start|>{name}\n", f"{text}<|im_end|>\n"
                p = parts.setdefault(k // max_turns + chars // max_chars, [0, 0, at, "", []])
                p[0] += 1
                if role == speaker:
                    p[1] += 1
                    p[4].append((len(p[3]) + len(head), len(p[3]) + len(head) + len(body)))
                p[3] += head + body
                at, chars = at + len(head + body), chars + len(text)
            out += [(conv, n, speaker, a, b, c, d, tuple(e)) for n, (a, b, c, d, e) in parts.items()]
    return sorted(out, key=str)


def test_parts_are_pieces_of_the_whole_rendering(spark):
    rows = [(1, i, "uv"[i % 2], f"{i} é😀") for i in range(25)] + [(2, 0, "u", str(i)) for i in range(25)]  # equal turn numbers
    rows += [(3, 30, "system", "rules"), *((3, i, "uvw"[i // 12], "x" * (i % 5)) for i in range(30)), (3, 31, None, None)]  # each silent in most parts
    rows += [(None, None, "uv"[i % 2], str(i % 7)) for i in range(40)] + [(4, 1, "system", "s")] * 15 + [(5, 1, "u", "long " * 40), (5, 2, "v", "y"), (5, 3, "u", "long " * 40), (6, 1, "u", "short")]
    for max_turns, max_chars in ((10, 2**24), (1024, 150)):
        got = run(spark, rows, max_turns=max_turns, max_chars=max_chars)
        assert sorted(((r.conv_id, r.part, r.speaker, r.n_turns, r.n_own, r.start, r.text, tuple((m.start, m.end) for m in r.mask)) for r in got), key=str) == brute(rows, max_turns, max_chars)


def test_a_hot_conversation_is_numbered_in_ranges(spark):
    rows = [(None, None, "uv"[i % 2], str(i % 700)) for i in range(2500)] + [(1, 7, "u", "same")] * 2500 + [(1, 8, "v", "x"), (3, 0, "u", "y")]
    sizes = {(r.conv_id, r.part, r.speaker, r.n_turns, r.n_own) for r in run(spark, rows, max_turns=1000)}
    want = {(1, p, s, n, n if s == "u" else 0) for p, n in enumerate((1000, 1000)) for s in "uv"} | {(1, 2, "u", 501, 500), (1, 2, "v", 501, 1), (3, 0, "u", 1, 1)}
    want |= {(None, 0, "u", 1000, 1000), (None, 1, "u", 1000, 250), (None, 2, "u", 500, 0), (None, 0, "v", 1000, 0), (None, 1, "v", 1000, 750), (None, 2, "v", 500, 500)}
    assert sizes == want


def test_running_numbers_equal_a_sort(spark):
    from memloom.llm.common import running

    rows = [(g, x % 50, 1) for g, n in ((None, 30), (1, 900), (2, 1)) for x in range(n)]
    got = running(spark.createDataFrame(rows, "g long, x long, one long"), ["g"], ["x"], before="one").collect()
    assert len(got) == len(rows) and all(r.place == r.before for r in got)
    for g in (None, 1, 2):
        assert [r.x for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == sorted(x for h, x, _ in rows if h == g)
