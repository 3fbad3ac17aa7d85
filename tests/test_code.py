import random

from memloom.operators import code

SIGNS = ["a", "return", " ", "\n", "/", "/", "*", "//", "/*", "*/", "'", '"', "`", "${", "{", "}", "\\", "(", ")", "=", "[", "]", "<", "#", "#!", "'''", '"""', "x.y", "$", ";", "1", "é", "typeof"]


def walk(text, python):
    """Sign by sign: the text without comments."""
    out, i, last, word, buf, stack = [], 0, "", "", "", []

    def template(i):
        while i < len(text):
            if text[i] == "\\" and i + 1 < len(text):
                out.append(text[i : i + 2])
                i += 2
            elif text.startswith("${", i):
                out.append("${")
                stack.append(0)
                return i + 2, "{"
            else:
                out.append(text[i])
                i += 1
                if text[i - 1] == "`":
                    return i, "`"
        return i, "`"

    def literal(i):
        inside, j = False, i + 1
        while j < len(text):
            c = text[j]
            if c in "\n\r" or (c == "\\" and text[j + 1 : j + 2] in ("", "\n", "\r")):
                return -1
            if c == "\\":
                j += 2
                continue
            if c == "[":
                inside = True
            elif c == "]":
                inside = False
            elif c == "/" and not inside:
                j += 1
                while j < len(text) and text[j] in code.FLAGS:
                    j += 1
                return j
            j += 1
        return -1

    while i < len(text):
        c, two, three = text[i], text[i : i + 2], text[i : i + 3]
        if not (c.isascii() and (c.isalnum() or c in "_$.")) and buf:
            word, buf = buf, ""
        if not python and two == "/*":
            end = text.find("*/", i + 2)
            stop = len(text) if end < 0 else end + 2
            out.append("\n" * text.count("\n", i, stop))
            i = stop
        elif (not python and (two == "//" or (i == 0 and two == "#!"))) or (python and c == "#"):
            while i < len(text) and text[i] != "\n":
                i += 1
        elif python and three in ("'''", '"""'):
            out.append(three)
            i += 3
            while i < len(text):
                if text[i] == "\\" and i + 1 < len(text):
                    out.append(text[i : i + 2])
                    i += 2
                elif text[i : i + 3] == three:
                    out.append(three)
                    i += 3
                    break
                else:
                    out.append(text[i])
                    i += 1
            last, word = c, ""
        elif not python and c == "`":
            out.append(c)
            i, last = template(i + 1)
            word = ""
        elif c in "'\"":
            out.append(c)
            i += 1
            while i < len(text) and (text[i] != "\n"):
                if text[i] == "\\" and i + 1 < len(text):
                    out.append(text[i : i + 2])
                    i += 2
                    continue
                out.append(text[i])
                i += 1
                if text[i - 1] == c:
                    break
            last, word = c, ""
        elif not python and c == "/" and (i == 0 or text[i - 1] != "<") and (not last or last in code.OPENERS or ((last.isascii() and last.isalpha() or last in "_$") and word in code.BEFORE_LITERAL)) and literal(i) > 0:
            j = literal(i)
            out.append(text[i:j])
            i, last, word = j, "/", ""
        elif stack and c in "{}":
            out.append(c)
            i += 1
            last = c
            if c == "{":
                stack[-1] += 1
            elif stack[-1]:
                stack[-1] -= 1
            else:
                stack.pop()
                i, last = template(i)
                word = ""
        else:
            if c.isascii() and (c.isalnum() or c in "_$."):
                buf, last = buf + c, c
            elif not c.isspace():
                last = c
            out.append(c)
            i += 1
    return "".join(out)


def test_comments_go_as_a_sign_by_sign_walk_takes_them(spark):
    rnd = random.Random(12)
    texts = ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 24))) for _ in range(4000)] + ["", "#!/usr/bin/env node\nx", "a = b / c // d\n/re[/]/.test(x) /* y\n*/ z", "`a ${ `b ${c /* d */}` } // kept` // gone", "return /x/ // y", "<b></b> // c", "/* open\n"]
    for t in texts:
        for python in (False, True):
            kinds = list(code.tokens(t, python))
            assert "".join(s for _, s in kinds) == t
            assert "".join("\n" * s.count("\n") if k == "block" else "" if k == "line" else s for k, s in kinds) == walk(t, python), (t, python)
    rows = spark.createDataFrame([(i, t, i % 2 == 1) for i, t in enumerate(texts)] + [(-1, None, None)], "id long, text string, py boolean").repartition(3)
    got = {r.id: r.text for r in code.stripped(rows, python=rows.py).collect()}
    assert got[-1] is None and all(got[i] == walk(t, i % 2 == 1) for i, t in enumerate(texts))


def test_calls_inside_effects(spark):
    cases = [
        ("useEffect(() => {\n  fetch('/x');\n}, []);", {2}),
        ("React.useEffect( () => { window.fetch(u) } )", {1}),
        ("useEffect(() => { load(); }, []);\nfetch('/x');", set()),
        ("useEffect(() => { api.fetch(u); refetch(); })", set()),
        ("useEffect(() => { // fetch(u)\n '/fetch(u)'; `fetch(${u})` })", set()),
        ("useEffect(() => { `a ${ fetch(u) }` })", {1}),
        ("useEffect(() => {\n const s = ')';\n const r = /\\)/;\n fetch (u)", {4}),
        ("useEffect(a, (b), c(d(e)))\nself.fetch(u)", set()),
        ("x) useEffect(() => useEffect(() => fetch(u)))", {1}),
        ("myuseEffect(() => fetch(u))", set()),
        ("$useEffect(() => globalThis.fetch(u))", {1}),
        (None, set()),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id long, text string").repartition(3)
    got = {}
    for r in code.calls_inside(rows).collect():
        got.setdefault(r.id, set()).add(r.line)
    assert got == {i: lines for i, (_, lines) in enumerate(cases) if lines}
