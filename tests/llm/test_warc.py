import gzip
import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm import warc

SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("position", T.LongType()), T.StructField("target", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("digest", T.StringType())])


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).withColumn("record", warc.as_record(F.col("target"), F.col("payload")))


def test_audit_finds_exactly_the_damage(spark):
    good = [(f, i, f"http://{f}/{i}", "é" * (i % 7)) for f in "abc" for i in range(300)] + [("d", 0, None, None)]
    bad = [r for r in good if r[:2] != ("c", 299)] + [("e", 0, "u", "new")]
    bad = [(*r[:3], "longer than before") if r[:2] in {("a", 17), ("b", 299)} else r for r in bad]
    trees = [warc.tree(records(spark, x)) for x in (good, bad)]
    got = sorted((r.file, r.record, r.fault) for r in warc.audit(*trees).collect())
    assert got == [("a", 17, "changed"), ("b", 299, "changed"), ("c", 299, "missing"), ("e", 0, "extra")]
    assert warc.audit(trees[0], trees[0]).collect() == []


def test_ranges_point_at_the_records(spark):
    rows = records(spark, [("a", i, f"u{i}", "x" * i) for i in range(40)])
    raw = b"".join(bytes(r.record) for r in rows.orderBy("position").collect())
    whole = warc.parse(raw)
    assert [r[4] for r in whole] == [b"x" * i for i in range(40)] and [r[3] for r in whole] == [f"u{i}" for i in range(40)]
    assert [(r.start, r.length) for r in warc.leaves(rows).orderBy("node").collect()] == [r[:2] for r in whole]
    files = spark.createDataFrame([("f", bytearray(raw)), ("g", None)], "path string, content binary")
    assert [(r.offset, r.length) for r in warc.read_warc(files).orderBy("position").collect()] == [r[:2] for r in whole]


def test_empty_tables(spark):
    none = warc.tree(records(spark, []))
    assert [level.collect() for level in none] == [[]] and warc.audit(none, none).collect() == []
    one = warc.tree(records(spark, [("a", 0, "u", "x")]))
    assert [(r.file, r.fault) for r in warc.audit(one, none).collect()] == [("a", "missing")]


def test_null_files_equal_positions_and_repeated_rows(spark):
    good = [(None, None, "u", f"p{i}") for i in range(20)] + [("a", 1, "u", "same")] * 5 + [("a", 1, "u", f"x{i}") for i in range(30)]
    trees = [warc.tree(records(spark, x)) for x in (good, good[::-1], good[:-1])]
    assert warc.audit(trees[0], trees[1]).collect() == []
    got = warc.audit(trees[0], trees[2]).collect()
    assert {r.file for r in got} == {"a"} and [r.fault for r in got].count("missing") == 1
    nothing = warc.audit(trees[0], warc.tree(records(spark, good[20:]))).collect()
    assert {(r.file, r.fault) for r in nothing} == {(None, "missing")} and len(nothing) == 20


def test_large_files_are_numbered_in_ranges(spark):
    rows = spark.createDataFrame([("a", i % 900, None, str(i), None) for i in range(2000)], SCHEMA).withColumn("record", F.col("payload"))
    got = warc.leaves(rows).collect()
    want = sorted((i % 900, hashlib.sha256(str(i).encode()).hexdigest(), len(str(i))) for i in range(2000))
    at = 0
    for r, (_, digest, n) in zip(sorted(got, key=lambda r: r.node), want, strict=True):
        assert (r.digest, r.start, r.length) == (digest, at, n)
        at += n


def record(payload, size=None):
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: u\r\nContent-Length: " + str(len(payload) if size is None else size).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def test_reading_goes_on_behind_damage():
    sound = [record(b"one"), record(b""), record(b"\r\n\r\nWARC/1.1 inside")]
    for bad in (b"garbage\r\n", record(b"long", 99_999), record(b"short", 2), record(b"x", "many"), record(b"y", -3), b"WARC/1.1\r\nno end\r\n", b"\x00" * 50 + b"\n"):
        raw = sound[0] + bad + sound[1] + sound[2]
        got = warc.parse(raw)
        assert [r[4] for r in got if r[2] != "fault"][:2] == [b"one", b""] and sum(r[1] for r in got) == len(raw)
        assert [r[2] for r in got].count("fault") >= 1
    assert warc.parse(b"") == [] and [r[2] for r in warc.parse(b"WARC/1.1")] == ["fault"]


def test_compressed_files():
    sound = [record(b"one"), record(b"two" * 50_000), record(b"three")]
    each = [gzip.compress(r) for r in sound]
    assert [r[4] for r in warc.records_of(b"".join(each))] == [b"one", b"two" * 50_000, b"three"]
    assert [r[:2] for r in warc.records_of(b"".join(each))] == [(0, len(each[0])), (len(each[0]), len(each[1])), (len(each[0] + each[1]), len(each[2]))]
    assert [r[4] for r in warc.records_of(gzip.compress(b"".join(sound)))] == [b"one", b"two" * 50_000, b"three"]
    hurt = each[0] + each[1][:40] + each[2]
    assert [(r[2], r[4]) for r in warc.records_of(hurt)][0::2] == [("resource", b"one"), ("resource", b"three")]
    assert sum(r[1] for r in warc.records_of(hurt)) == len(hurt)
