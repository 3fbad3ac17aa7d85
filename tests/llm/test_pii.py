import hashlib
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm import pii

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("spans", T.StringType())])
#: The contract's own patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    r = random.Random(3)
    bits = ["a.b%c@x.y-z.example", "@", "a@b.c%x@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "+1 (702) 555-0742", "+1.2", "+49 30 1234567 8", "é😀", "9807915762804490", " ", "\n", "-", "4", ".", "x"]
    out = ["".join(r.choice(bits) + r.choice(["", " ", ", "]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    return out + ["".join(r.choice("0123456789 -.+@a") for _ in range(60)) for _ in range(300)] + ["", None, "no data", "9" * 20_000, "a" * 50_000, "a@b" + ".c" * 20_000, "1 " * 20_000, "+1" + "(" * 20_000]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts())]
    got = pii.find(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "kind", pii.joined(F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))).alias("found")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.found, r.kind) == (",".join(brute(rows[r.doc_id][1])), "clash"), rows[r.doc_id][1][:200]


def test_cards_without_two_adjacent_digits(spark):
    for sign in " -":
        text = f"pay with {sign.join('4111111111111111')} now"
        (r,) = pii.redact(pii.find(spark.createDataFrame([(1, text, None, None)], SCHEMA))).select("text", pii.joined(F.col("pii")).alias("found")).collect()
        assert (r.found, r.text) == (",".join(brute(text)), "pay with [CARD] now")


def test_added_kinds_and_scores(spark):
    text = "IBAN GB82 WEST 1234 5698 7654 32, not GB82 WEST 1234 5698 7654 33. SSN: 123-45-6789. " + "x" * 60 + " 123-45-6780 " + "y" * 60 + " call +1 (702) 555-0742"
    (r,) = pii.find(spark.createDataFrame([(1, text, None, None)], SCHEMA)).collect()
    assert [(s.kind, text[s.start : s.end], s.score) for s in r.pii] == [("phone", "+1 (702) 555-0742", 0.8), ("iban", "GB82 WEST 1234 5698 7654 32", 1.0), ("ssn", "123-45-6789", 0.6)]


def test_the_match_is_no_context(spark):
    text = "contact@x.example, " + "z" * 60 + " write to a@b.example"
    (r,) = pii.find(spark.createDataFrame([(1, text, None, None)], SCHEMA)).collect()
    assert [s.score for s in r.pii] == [0.8, 1.0]


def test_redaction(spark):
    rows = [(1, "é a@b.example, 😀 +1 (702) 555-0742!", None, None), (2, "clean", None, None), (3, None, None, None), (4, "a@1.2.3.4 x", None, None)]
    got = {r.doc_id: r.text for r in pii.redact(pii.find(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: "é [EMAIL], 😀 [PHONE]!", 2: "clean", 3: None, 4: "[EMAIL] x"}


def test_digest_of_nothing(spark):
    assert pii.find(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256).alias("x")).first().x
