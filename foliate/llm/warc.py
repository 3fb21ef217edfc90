"""WARC archives in which equal payloads are stored once.

Headers (id, size, SHA-1) are shuffled by digest, with a partial maximum first, so a
payload that a third of all pages share is a few rows to the shuffle.  Digests held
by more than one page of ``least`` bytes or more name their original, the page with
the largest id; the others become revisit records that refer to it.  The table of
originals is stored, then joined by broadcast if it has at most ``BROADCAST_ROWS``
rows, and otherwise shuffled against headers alone; payloads join decisions by page.

Archives are written by Spark's text sink: a record's end, two line ends, is its line
separator, so each part file is a whole WARC file and the write is committed task by
task on any store.  Each file begins with a ``warcinfo`` record, and all headers are made
afresh, dated by the write.  Revisits keep their HTTP header with the payload's length.
Archives are read by the text source, line by line in order, an archive may have any size, and a task holds one record at a time.  (Spark's sinks
compress a file as one gzip member, so records are read in order, not by offset.)

Defined results: a null html is an empty payload; a null url leaves the target URI
out; rows with equal ids and payloads are alike, those with the largest id all
responses; null ids never become originals; an empty table gives no archives and no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.llm import common

BROADCAST_ROWS = 100_000
END = "\r\n"
#: Fixed value: the profile of a revisit record whose payload digest equals its original's.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _name(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(END)), F.lit(""))


def resolve(pages: DataFrame, least: int = 1000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, original, original_url`` of each page; ``original`` is null for responses."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    most = (headed.filter(F.col("payload_bytes") >= least).groupBy("payload_digest")
            .agg(F.max_by(F.struct(F.col("page_id").alias("id"), F.col("url").alias("at")), F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"))
            .filter("n > 1 and top.id is not null").select("payload_digest", F.col("top.id").alias("original"), F.col("top.at").alias("original_url")))
    originals = common.store(most, "warc_originals")
    if originals.limit(broadcast_rows + 1).count() <= broadcast_rows:
        joined = headed.join(F.broadcast(originals), "payload_digest", "left")
    else:
        headers = headed.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
        decided = common.store(headers.join(originals, "payload_digest").distinct(), "warc_decisions").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("by"), "original", "original_url")
        joined = headed.join(decided, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("by")), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", *(F.when(other, F.col(c)).alias(c) for c in ("original", "original_url")))


def record(date: str) -> Column:
    """The text of a row's record, without the two line ends that close it."""
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(END),
        _header("WARC-Record-ID", _name(F.col("page_id"))), _header("WARC-Target-URI", F.col("url")), F.lit(f"WARC-Date: {date}{END}"),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(END),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}"), _header("WARC-Refers-To", _name(F.col("original"))), _header("WARC-Refers-To-Target-URI", F.col("original_url")), F.lit(f"WARC-Refers-To-Date: {date}{END}"))).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{END}Content-Length: "), block.cast("string"), F.lit(END * 2), http, F.when(revisit, "").otherwise(F.col("payload")),
    )


def info(date: str) -> Column:
    """An archive's first record, with the line ends that close it."""
    block = f"software: foliate{END}format: WARC File Format 1.1{END}"
    head = f"WARC-Date: {date}{END}Content-Type: application/warc-fields{END}Content-Length: {len(block)}{END * 2}"
    return F.concat(F.lit(f"WARC/1.1{END}WARC-Type: warcinfo{END}WARC-Record-ID: <urn:uuid:"), F.expr("uuid()"), F.lit(f">{END}{head}{block}{END * 2}"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, date: str | None = None, records: int = 5000, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """One record for each page, ``records`` to an archive at most; ``date``: that of the headers, now if it isn't given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the task; a file begins at each multiple of `records`
    value = F.concat(F.when(place % records == 0, info(date)).otherwise(""), record(date))
    resolve(pages, least, broadcast_rows).select(value.alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record's headers and block, from the pieces of archives in order."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                if held:
                    raise ValueError("a cut record")
                return
        first, *lines = held[:at].decode().split(END)
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        size = int(headers["content-length"])
        if not need(at + 8 + size):
            raise ValueError("a cut record")
        yield headers, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 8 + size]


def read_archives(spark, path: str) -> DataFrame:
    """The records of all archives under ``path``, their payload digests verified (``COLUMNS``); a revisit's payload is null."""
    import hashlib

    def page(name: str | None) -> int | None:
        n = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(n) if n.lstrip("-").isdigit() else None

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        pieces = (x.as_py() + b"\n" for batch in batches for x in batch.column(0))
        for h, block in parse(pieces):
            kind = h["warc-type"]
            if kind == "warcinfo":
                continue
            http, _, payload = block.partition(b"\r\n\r\n")
            size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"record {h['warc-record-id']} does not match its digest")
            rows.append((page(h["warc-record-id"]), size, digest, kind, page(h.get("warc-refers-to")), h.get("warc-target-uri"), payload if kind == "response" else None))
            held += len(payload)
            if held > common.BATCH_BYTES or len(rows) >= common.BATCH_ROWS:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    common.small_batches(spark)
    # Files that are compressed as a whole aren't split, so a task gets whole archives, their pieces in order.
    pieces = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary"))
    return pieces.mapInArrow(run, COLUMNS)
