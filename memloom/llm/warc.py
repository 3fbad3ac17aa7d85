"""WARC fixity audit with Merkle trees.

Records are hashed in place; a file's records, in order, are the leaves of a tree whose nodes cover ``FANOUT`` children
and their byte ranges.  Two replicas are compared root by root, and only mismatching branches are descended, so an audit
of sound replicas exchanges one row a file.  Trees are stored tables, one a level: auditing again reads no record.

Only ids, lengths and digests are shuffled; record bytes never move.  A node's digest covers its children's digests and
lengths, not absolute offsets, so a record that changes its length spoils its own branch alone.  Records are numbered by
prefix sums over range partitions, so one large file is spread over tasks.

Reading files: gzip members (one a record, or one a file) are opened; where a record is damaged (no header end, no
length, a length beyond the file or not followed by the record's end) the bytes up to the next ``WARC/`` line are one row
of type ``fault``, and reading goes on there, so no byte of a file is without a row.

Defined cases: a null payload is an empty record; records with equal (file, position) are ordered by digest; repeated
records are records of their own; a null file is a file; files or records that one replica lacks are reported as missing
or extra; equal replicas and empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running, table, written

FANOUT = 16
FILE_RECORDS = 1000
HEADER = re.compile(rb"(?im)^([A-Za-z-]+):[ \t]*(.*?)\r?$")
NEXT = re.compile(rb"(?<=\n)WARC/[0-9]")


def record_at(raw: bytes, at: int) -> tuple[int, dict[bytes, bytes], int, int] | None:
    """(end, headers, payload's begin and end) of the sound record that begins at ``at``, or None."""
    body = raw.find(b"\r\n\r\n", at) + 4
    if body < 4 or not raw.startswith(b"WARC/", at) or not all(b":" in line or line[:1] in (b" ", b"\t") for line in raw[at : body - 4].split(b"\r\n")[1:]):
        return None
    head = {k.lower(): v for k, v in HEADER.findall(raw[at:body])}
    size = head.get(b"content-length", b"").strip()
    stop = body + int(size) if size.isdigit() and len(size) < 19 else -1
    return (stop + 4, head, body, stop) if raw[stop : stop + 4] == b"\r\n\r\n" and stop >= 0 else None


def parse(raw: bytes) -> list[tuple[int, int, str, str, bytes]]:
    """(offset, length, type, target, payload) of each record of a WARC file's bytes; damaged stretches are of type ``fault``.

    Damaged bytes are the payload of their row.
    """
    out, at = [], 0
    while at < len(raw):
        if found := record_at(raw, at):
            end, head, body, stop = found
            named = lambda k: head.get(k, b"").decode("utf-8", "replace")  # noqa: B023, E731
            out.append((at, end - at, named(b"warc-type"), named(b"warc-target-uri"), raw[body:stop]))
        else:
            m = NEXT.search(raw, at + 1)
            end = m.start() if m else len(raw)
            out.append((at, end - at, "fault", "", raw[at:end]))
        at = end
    return out


def members(raw: bytes) -> list[tuple[int, int, bytes, bool]]:
    """(offset, length, bytes, sound) of each gzip member; bytes that are no member run up to the next member's sign."""
    out, at = [], 0
    while at < len(raw):
        d, data, end = zlib.decompressobj(31), b"", at
        try:
            parts = []
            while end < len(raw) and not d.eof:
                parts.append(d.decompress(raw[end : end + 65_536]))
                end = min(len(raw), end + 65_536)
            data, end, sound = b"".join(parts), end - len(d.unused_data), d.eof
        except zlib.error:
            sound = False
        if not sound:
            end = raw.find(b"\x1f\x8b\x08", at + 1)
            end = end if end >= 0 else len(raw)
            data = raw[at:end]
        out.append((at, end - at, data, sound))
        at = end
    return out


def records_of(raw: bytes) -> list[tuple[int, int, str, str, bytes]]:
    """``parse`` of a plain file, or of a compressed one; offset and length are then those of the record's member."""
    if not raw.startswith(b"\x1f\x8b"):
        return parse(raw)
    out = []
    for at, length, data, sound in members(raw):
        out += [(at, length, *r[2:]) for r in parse(data)] if sound else [(at, length, "fault", "", data)]
    return out


def read_warc(files: DataFrame) -> DataFrame:
    """(file, position, offset, length, type, target, payload) from ``binaryFile`` rows (path, content)."""

    def run(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                rows = [(path, i, *r) for i, r in enumerate(records_of(raw or b""))]
                yield pd.DataFrame(rows, columns=["file", "position", "offset", "length", "type", "target", "payload"])

    return files.select("path", "content").mapInPandas(run, "file string, position long, offset long, length long, type string, target string, payload binary")


def as_record(target: Column, payload: Column) -> Column:
    """Bytes of a resource record."""
    body = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(target, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def leaves(records: DataFrame, *, file: str = "file", position: str = "position", record: str = "record") -> DataFrame:
    """(file, level 0, node, start, length, digest): records in order, with their byte ranges."""
    small = records.select(F.col(file).alias("file"), F.col(position).alias("position"), F.octet_length(record).cast("long").alias("length"), F.sha2(F.col(record), 256).alias("digest"))
    numbered = running(small, ["file"], ["position", "digest"], start="length")
    return numbered.select("file", F.lit(0).alias("level"), F.col("place").alias("node"), "start", "length", "digest")


def tree(records: DataFrame, **columns) -> list[DataFrame]:
    """The levels of all files' trees as stored tables, records first; the last holds one root a file."""
    level = written(leaves(records, **columns))
    out, k, width = [level], 0, level.agg(F.max("node")).first()[0]
    while width is not None and width > 0:
        k, width = k + 1, width // FANOUT
        children = F.array_sort(F.collect_list(F.struct("node", "digest", "length")))
        level = written(
            level.groupBy("file", F.floor(F.col("node") / FANOUT).alias("up"))
            .agg(children.alias("kids"), F.min("start").alias("start"), F.sum("length").alias("length"))
            .select("file", F.lit(k).alias("level"), F.col("up").alias("node"), "start", "length", F.sha2(F.array_join(F.transform("kids", lambda x: F.concat_ws(":", x["digest"], x["length"].cast("string"))), "|"), 256).alias("digest"))
        )
        out.append(level)
    return out


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(file, record, start, length, other_start, other_length, fault) of each record that differs between two trees."""
    wanted = None
    for k in range(max(len(ours), len(theirs)) - 1, -1, -1):
        # A tree that is lower than the other one has no node here; its branches are descended too.
        a, b = ((t[k] if k < len(t) else t[0].limit(0)).select("file", "node", "start", "length", "digest") for t in (ours, theirs))
        if wanted is not None:
            same = F.col("file").eqNullSafe(F.col("f")) & (F.floor(F.col("node") / FANOUT) == F.col("up"))
            a, b = (t.join(wanted, same, "left_semi") for t in (a, b))
        other = b.select(F.col("file").alias("f"), F.col("node").alias("n"), F.col("start").alias("other_start"), F.col("length").alias("other_length"), F.col("digest").alias("other"))
        both = a.join(other, F.col("file").eqNullSafe(F.col("f")) & (F.col("node") == F.col("n")), "full_outer")
        apart = written(both.where(~F.col("digest").eqNullSafe(F.col("other"))).withColumn("there", F.when(F.col("n").isNull(), F.col("file")).otherwise(F.col("f"))).withColumn("at", F.coalesce("node", "n")))
        wanted = apart.select(F.col("there").alias("f"), F.col("at").alias("up")).distinct()
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("node").isNull(), "extra").otherwise("changed")
    return apart.select(F.col("there").alias("file"), F.col("at").alias("record"), "start", "length", "other_start", "other_length", fault.alias("fault"))


def page_records(pages: DataFrame, html: Column) -> DataFrame:
    """Pages as records of files of FILE_RECORDS consecutive ids."""
    return pages.select(F.floor(F.coalesce("page_id", F.lit(-1)) / FILE_RECORDS).alias("file"), F.col("page_id").alias("position"), as_record(F.col("url"), html).alias("record"))


def op7_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """Audit of a replica of ``pages`` in which every 97th page has lost its first byte and every 89th has each e raised."""
    pages = table(spark, sf_dir, "pages")
    damaged = F.when(F.col("page_id") % 97 == 5, F.substr("html", F.lit(2))).when(F.col("page_id") % 89 == 3, F.replace(F.col("html"), F.lit("e"), F.lit("E"))).otherwise(F.col("html"))
    return audit(tree(page_records(pages, F.col("html"))), tree(page_records(pages, damaged)))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS a,
  coalesce(CASE WHEN page_id % 97 = 5 THEN substr(html, 2) WHEN page_id % 89 = 3 THEN replace(html, 'e', 'E') ELSE html END, '') AS b FROM pages),
r AS (SELECT page_id // 1000 AS file, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Length: ' AS h, a, b FROM p),
l AS (SELECT file, page_id, a <> b AS apart, strlen(h) + length(CAST(strlen(a) AS VARCHAR)) + strlen(a) + 8 AS length, strlen(h) + length(CAST(strlen(b) AS VARCHAR)) + strlen(b) + 8 AS other_length FROM r),
o AS (SELECT file, row_number() OVER w - 1 AS record, sum(length) OVER w - length AS start, length, sum(other_length) OVER w - other_length AS other_start, other_length, apart FROM l WINDOW w AS (PARTITION BY file ORDER BY page_id))
SELECT file, record, CAST(start AS BIGINT) AS start, length, CAST(other_start AS BIGINT) AS other_start, other_length, 'changed' AS fault FROM o WHERE apart
"""
