"""WARC: writing archives with revisit records, and reading them by boundary-chain verification.

Reading: archives are read in byte ranges, cut at the version line by Spark's text reader, so the tasks' pieces begin
behind every occurrence of it.  Tasks emit a candidate for each piece: its offset and, from the header, its successor's.
Ranges add up their bytes, which gives offsets in the file.  Pointer jumping from the file's start over the table of
candidates (each round doubles the distance every pointer spans) retains those that a chain of records reaches; the
version line inside a payload is never reached.  Pieces that are not reached belong to the record before them, and
only records of several pieces are put together, by a second look at the archives.

Spark's text writer and reader do the input and output, so that archives may lie in any store that Spark reaches,
and may be of any size; a record must fit into a task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import PIECE_BYTES, stash

VERSION = b"WARC/1.1\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:x-page:"
#: Groups of equal payloads that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.I)
_FIELD = re.compile(rb"([^\r\n:]+): *([^\r\n]*)\r\n")
#: Tasks among which the copies of a payload are dealt out where groups are joined by a shuffle.
SALT = 16


def typed(pages: DataFrame, *, least: int = 1000) -> DataFrame:
    """`pages` (page_id, url, html) with payload_bytes, payload_digest (SHA-1 in hexadecimal), record_type and refers_to.

    Of rows with equal payloads of at least `least` bytes those with the largest page_id (all of them, where it is
    repeated) are responses and the others, also those without page_id, revisit it; all else is a response.
    Other columns of the input, whatever their names, are left out; an empty table gives an empty one.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
    groups = stash(groups.agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1 and _last is not null").drop("_n"), "groups")
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    if groups.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(groups), same, "left")
    else:
        # the texts of one payload's copies go to several tasks
        groups = groups.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("_from", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(groups, same & (F.col("_from") == F.col("_to")), "left")
    again = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return rows.select(*rows.columns[:5], F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_last")).alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, path: str, *, least: int = 1000, date: str = "2000-01-01T00:00:00Z", records: int = 50_000) -> None:
    """Writes a record for every row of `pages`; null html is empty, null page_id and url are left out of the header.

    Rows that repeat a page_id are records of their own, other columns are left out, and an empty table makes archives without records.
    """
    rows = typed(pages, least=least)
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.col(c).cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(VERSION.decode()),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", urn("page_id")),
        _line("WARC-Date", F.lit(date)),
        # in brackets, so that no header line ends like the version line
        _line("WARC-Target-URI", F.concat(F.lit("<"), F.regexp_replace("url", "[\\r\\n]", ""), F.lit(">"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", urn("refers_to")),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(path)


def chain(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The candidates that the chain from the file's start reaches, by pointer jumping."""
    n = len(at)
    if not n or at[0]:
        return np.zeros(0, np.int64)
    to = np.searchsorted(at, after)
    jump = np.append(np.where((to < n) & (at[np.minimum(to, n - 1)] == after), to, n), n)
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    for _ in range(n.bit_length() + 1):
        reached[jump[reached]] = True
        jump = jump[jump]
    return np.flatnonzero(reached[:n])


def _page(urn: bytes | None) -> int | None:
    return int(urn[len(_URN) + 1 : -1]) if urn else None


def _header(record: bytes) -> tuple[int, int] | None:
    """(the header's end, the block's length) of what follows the version line; None where that is no header."""
    end = record.find(b"\r\n\r\n")
    m = _LENGTH.search(b"\r\n" + record[: end + 2]) if end >= 0 else None
    return (end + 4, int(m[1])) if m else None


def _record(record: bytes, head: int, length: int) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a whole record."""
    f = {k.lower(): v for k, v in _FIELD.findall(record, 0, head - 2)}
    body = record[head : head + length]
    http = body.find(b"\r\n\r\n") if body.startswith(b"HTTP/") else -4
    payload, kind = body[http + 4 :] if http != -1 else b"", f.get(b"warc-type", b"").decode()
    if kind == "revisit":
        size, digest, payload = int(f[b"x-payload-length"]), f[b"warc-payload-digest"].decode().partition(":")[2], None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    url = f.get(b"warc-target-uri")
    return _page(f.get(b"warc-record-id")), None if url is None else url.decode().removeprefix("<").removesuffix(">"), size, digest, kind, _page(f.get(b"warc-refers-to")), payload


_FIELDS = (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))
_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PLACE = (("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("local", pa.int64()), ("size", pa.int64()), ("reach", pa.int64()))
_PLACES = "file string, block long, seq long, local long, size long, reach long"


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece): what lies between version lines, in order within the byte range that begins at block."""
    text = spark.read.option("lineSep", VERSION.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _numbered(batches):
    """(file, block, number in the range, offset in the range, piece) of pieces as they pass."""
    now, seq, local = None, 0, 0
    for batch in batches:
        for file, block, piece in zip(*(batch.column(c) for c in ("file", "block", "piece")), strict=True):
            key, raw = (file.as_py(), block.as_py()), piece.as_py()
            if key != now:
                now, seq, local = key, 0, 0
            yield *key, seq, local, raw
            seq, local = seq + 1, local + len(raw) + len(VERSION)


def _candidate_rows(batches):
    """A row for each piece: its place and size, how far its record reaches from the piece's start (null: no header), and what the record says if it ends in the piece."""
    rows = []
    for file, block, seq, local, raw in _numbered(batches):
        own = _header(raw)
        reach = sum(own) + 4 if own else None
        whole = own is not None and reach == len(raw)
        rows.append((file, block, seq, local, len(raw), reach, *(_record(raw, *own)[:6] if whole else (None,) * 6)))
        if len(rows) == 2000:
            yield _batch(rows, _PLACE + _FIELDS)
            rows = []
    if rows:
        yield _batch(rows, _PLACE + _FIELDS)


def _chained(table: pa.Table) -> pa.Table:
    """Of one file's candidates (file, at, after, end): (file, at, owner), the owner being the reached candidate a piece belongs to."""
    at, after, end = (table.column(c).to_numpy() for c in ("at", "after", "end"))
    order = np.argsort(at)
    at, after, end = at[order], after[order], end[order]
    kept = chain(at, after)
    if not len(kept) or after[kept[-1]] != end[-1]:
        raise ValueError("the archive's chain of records does not end at its end")
    reached = np.zeros(len(at), np.int64)
    reached[kept[1:]] = 1
    return pa.table({"file": pa.array([table.column("file")[0].as_py()] * len(at)), "at": at, "owner": at[kept][np.cumsum(reached)]})


def read(spark: SparkSession, path: str, *, payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records of the archives.

    A response's length and digest come from its payload, a revisit's from its header.  An archive of which the
    chain of records does not end at its end is an error; an empty one has no records.
    """
    found = stash(_pieces(spark, path).mapInArrow(_candidate_rows, f"{_PLACES}, {_SCHEMA}"), "candidates")
    # a row for each byte range
    ranges = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(VERSION)).alias("bytes"))
    ranges = ranges.select("file", "block", (F.sum("bytes").over(W.partitionBy("file").orderBy("block")) - F.col("bytes")).alias("base"))
    placed = found.join(ranges, ["file", "block"]).withColumn("start", F.col("base") + F.col("local"))
    # the first piece of a file lies before its first version line
    rest = placed.where("start > 0 or size > 0").withColumn("at", F.col("start") - F.when(F.col("start") > 0, len(VERSION)).otherwise(F.lit(0)))
    chains = rest.select("file", "at", F.coalesce(F.when(F.col("start") > 0, F.col("start") + F.col("reach")), F.lit(-1)).alias("after"), (F.col("start") + F.col("size")).alias("end"))
    chains = chains.groupBy("file").applyInArrow(_chained, "file string, at long, owner long")
    owned = stash(rest.join(chains, ["file", "at"]), "owned")
    parts = owned.groupBy("file", "owner").agg(F.count("*").alias("parts"))
    several = (parts if payload else parts.where("parts > 1")).select("file", "owner")
    columns = [n for n, _ in _FIELDS]
    if payload:
        alone = None
    else:
        alone = owned.join(several, ["file", "owner"], "left_anti").select(*columns)
        if several.isEmpty():
            return alone
    schema, fields = f"{_SCHEMA}, payload binary", (*_PLACE[:3], ("piece", pa.binary()))

    def place(batches):
        rows, size = [], 0
        for file, block, seq, _, raw in _numbered(batches):
            rows.append((file, block, seq, raw))
            size += len(raw)
            if size > PIECE_BYTES or len(rows) == 2000:
                yield _batch(rows, fields)
                rows, size = [], 0
        if rows:
            yield _batch(rows, fields)

    def put_together(table: pa.Table) -> pa.Table:
        pieces = [p for _, p in sorted(zip(table.column("at").to_pylist(), table.column("piece").to_pylist(), strict=True))]
        record = VERSION.join(pieces)
        return pa.Table.from_batches([_batch([_record(record, *_header(record))], (*_FIELDS, ("payload", pa.binary())))])

    wanted = owned.join(several, ["file", "owner"]).select("file", "block", "seq", "at", "owner")
    again = _pieces(spark, path).mapInArrow(place, "file string, block long, seq long, piece binary").join(wanted, ["file", "block", "seq"])
    whole = again.groupBy("file", "owner").applyInArrow(put_together, schema)
    return whole if payload else alone.unionByName(whole.drop("payload"))


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) payload_digest from pages),
g as (select payload_digest, payload_bytes, max(page_id) m from p where payload_bytes >= 1000 group by 1, 2)
select page_id, payload_bytes, payload_digest, case when m > page_id then 'revisit' else 'response' end record_type,
       case when m > page_id then m end refers_to
from p left join g using (payload_digest, payload_bytes)
"""
