"""WARC records and not-modified revisits (operator 5).

``record_bytes`` and ``parse_records`` write and read WARC/1.1 records (plain or
gzip members). ``resolve_revisits`` gives every *server-not-modified* revisit
the latest earlier full response of the same canonical URL, checks validators,
and merges the revisit's headers into the stored ones as a cache does.

As-of join: captures are placed by (canonical URL, time bucket). Inside a bucket
a running maximum finds the latest earlier response; across buckets only the
last response of each bucket is carried on. A URL with a third of all captures
is thereby spread over its buckets; bodies never enter the shuffle.

A full response is an intact record of type ``response`` with status 200: one
whose length and digest hold. Records are followed by row, not by id, so an id
that occurs twice takes nothing from the other's captures.

Verdicts: ``resolved`` (ETags agree in weak comparison, or, where one lacks an
ETag, Last-Modified agrees), ``mismatch``, ``unchecked`` (no common validator),
``no_response`` (nothing earlier). Headers merge only when resolved.

Cases: null content has no records; a record that is cut off, damaged or shorter
than it says comes with ``intact`` false, and the records behind it are read (see
``parse_records``); a field that is no number counts as absent; very long files
are read a member and a record at a time; a null or unparsable URL has no
canonical form and never matches; captures of the same instant are not earlier
than one another; among responses of the same instant the largest record id
counts, then the largest body digest; repeated response records are one
candidate each and give one result; repeated revisit rows are resolved row by
row; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release, small_batches

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Hop-by-hop fields, and fields that describe the stored body, which a 304 must not replace.
NOT_MERGED = (
    "connection proxy-connection keep-alive te trailer transfer-encoding upgrade proxy-authenticate proxy-authentication-info "
    "proxy-authorization content-encoding content-length content-range content-type"
).split()
#: Query parameters that track a visit and do not name a page.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content ref fbclid gclid sessionid".split()
BUCKET_SECONDS = 3600

_FIELDS = "record_id string, warc_type string, target_uri string, warc_date string, profile string, refers_to string, status int, headers map<string,string>, body_bytes long, body_md5 string, intact boolean"


def record_bytes(kind: str, record_id: str, uri: str, date: str, status: int, headers: list[tuple[str, str]], body: bytes, profile: str | None = None) -> bytes:
    """One WARC/1.1 record that holds an HTTP response."""
    reason = {200: "OK", 304: "Not Modified"}.get(status, "Status")
    block = b"".join([f"HTTP/1.1 {status} {reason}\r\n".encode(), *(f"{k}: {v}\r\n".encode() for k, v in headers), b"\r\n", body])
    own = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response"), ("WARC-Block-Digest", "md5:" + hashlib.md5(block).hexdigest())]
    if profile:
        own.append(("WARC-Profile", profile))
    own.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in own) + b"\r\n" + block + b"\r\n\r\n"


def _lines(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in raw.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:  # a folded field goes on
            out[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.partition(b":")
        if colon:
            last = name.decode("utf-8", "replace").strip().lower()
            value = value.decode("utf-8", "replace").strip()
            out[last] = f"{out[last]}, {value}" if last in out else value
    return out


_START = re.compile(rb"(?:\A|(?<=\n))WARC/1\.[0-9]+\r\n")
_PIECE = 1 << 20


def _members(raw: bytes) -> Iterator[Iterator[bytes]]:
    """The members of a WARC file, each one unpacked in pieces; a plain file is one member.

    A damaged member ends where unpacking fails; the next one is looked for behind its start.
    """
    if raw[:2] != b"\x1f\x8b":
        yield iter((raw,))
        return
    at = 0

    def pieces() -> Iterator[bytes]:
        nonlocal at
        unpack, fed = zlib.decompressobj(wbits=31), at
        try:
            while not unpack.eof and fed < len(raw):
                piece = raw[fed : fed + _PIECE]
                fed += len(piece)
                yield unpack.decompress(piece)
            at = fed - len(unpack.unused_data) if unpack.eof else at + 1  # a cut member: others may follow
        except zlib.error:
            at += 1

    while at >= 0:
        yield pieces()
        at = raw.find(b"\x1f\x8b\x08", at)


def _record(head: bytes, block: bytes, length: int) -> dict:
    fields = _lines(head)
    top, _, body = block.partition(b"\r\n\r\n")
    status_line, _, rest = top.partition(b"\r\n")
    code = re.match(rb"HTTP/\S+ +([0-9]{3})(?: |\Z)", status_line)
    digest = fields.get("warc-block-digest", "")
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "warc_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"),
        "warc_date": fields.get("warc-date"),
        "profile": fields.get("warc-profile"),
        "refers_to": fields.get("warc-refers-to"),
        "status": int(code[1]) if code else None,
        "headers": list(_lines(rest).items()),
        "body_bytes": len(body),
        "body_md5": hashlib.md5(body).hexdigest(),
        "intact": len(block) == length and (not digest.startswith("md5:") or digest[4:] == hashlib.md5(block).hexdigest()),
    }


def _sound(fields: dict[str, str], block: bytes, after: bytes) -> bool:
    """Whether a block is likely to be what its header says: by its digest, else by the blank line behind it."""
    digest = fields.get("warc-block-digest", "")
    return digest[4:] == hashlib.md5(block).hexdigest() if digest.startswith("md5:") else after in (b"\r\n\r\n", b"")


def _inner(held: bytearray, start: int, end: int) -> int:
    """Where the header of another record starts inside a block, or -1."""
    for found in _START.finditer(held, start, end):
        close = held.find(b"\r\n\r\n", found.start())
        fields = _lines(bytes(held[found.end() : close if close >= 0 else len(held)]))
        if "warc-type" in fields and "content-length" in fields:
            return found.start()
    return -1


def _of_member(pieces: Iterator[bytes]) -> Iterator[dict]:
    held, more = bytearray(), True

    def fill() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        start = _START.search(held)
        while start is None and more:
            del held[: max(0, len(held) - 32)]  # what came so far holds no start
            more = fill()
            start = _START.search(held)
        if start is None:
            return
        end = held.find(b"\r\n\r\n", start.start())
        while end < 0 and more:
            more = fill()
            end = held.find(b"\r\n\r\n", start.start())
        if end < 0:
            return
        head = bytes(held[start.start() : end])
        fields = _lines(head)
        size = fields.get("content-length", "")
        length = int(size) if re.fullmatch("[0-9]{1,18}", size) else 0
        begin, stop = end + 4, end + 4 + length
        while more and len(held) < stop + 4:
            more = fill()
        block = bytes(held[begin:stop])
        inner = -1 if _sound(fields, block, bytes(held[stop : stop + 4])) and len(block) == length else _inner(held, begin, min(stop, len(held)))
        if inner >= 0:  # the record is shorter than it says, and took others for its body
            block, stop = bytes(held[begin:inner]).removesuffix(b"\r\n\r\n"), inner
        yield _record(head, block, length)
        del held[:stop]


def parse_records(raw: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes, in order.

    A record starts at a version line of its own; its length says where it ends,
    so version lines inside a sound body are not records. The end of a gzip member
    ends its last record too. A record that is cut off, that damage ends, or that
    is shorter than its length says comes with ``intact`` false (if its header
    came through); all later records follow. One record at a time is in memory.
    """
    for pieces in _members(raw):
        yield from _of_member(pieces)


_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "warc_type", "target_uri", "warc_date", "profile", "refers_to")]
    + [("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body_bytes", pa.int64()), ("body_md5", pa.string()), ("intact", pa.bool_())]
)


def parse(files: DataFrame, content: str = "content", rows_at_once: int = 256) -> DataFrame:
    """One row per record of every WARC content (binary column) of ``files``."""

    small_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for k in range(batch.num_rows):
                raw = batch.column(0)[k].as_py()
                for record in parse_records(raw or b""):
                    rows.append(record)
                    if len(rows) >= rows_at_once:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
        release()

    return files.select(content).mapInArrow(run, _FIELDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``; a file is read by one task."""
    return parse(spark.read.format("binaryFile").load(path))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, the scheme's own port or case; path without a trailing slash; sorted query without tracking; no scheme or fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    port = F.when(F.lower(bare).startswith("https:"), ":443").when(F.lower(bare).startswith("http:"), ":80")
    host = F.when(port.isNotNull() & host.endswith(port), F.substring_index(host, ":", 1)).otherwise(host)
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda q: (q != "") & ~F.substring_index(q, "=", 1).isin(*TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _validators(headers: str) -> list[Column]:
    return [F.regexp_replace(F.element_at(headers, "etag"), "^W/", ""), F.element_at(headers, "last-modified")]


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per not-modified revisit of ``records`` (as ``parse`` returns them; without a column ``intact`` all count as intact).

    (record_id, canonical, at, verdict, response_id, body_bytes, body_md5, headers)
    """
    intact = records["intact"] if "intact" in records.columns else F.lit(True)
    seen = records.select("record_id", "warc_type", "profile", "status", "headers", "body_bytes", "body_md5", intact.alias("intact"), canonical_url(F.col("target_uri")).alias("canonical"), F.expr("unix_micros(try_to_timestamp(warc_date))").alias("at"))
    full = F.coalesce((F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("intact") & F.col("at").isNotNull(), F.lit(False))
    again = F.coalesce((F.col("warc_type") == "revisit") & (F.col("profile") == NOT_MODIFIED), F.lit(False))
    # records without bodies are a small part of the input; written once, with a number of their own, the joins below reread them
    seen = cut(seen.where(full | again).withColumn("row", F.monotonically_increasing_id()), "warc-captures")
    etag, modified = _validators("headers")
    narrow = seen.select("canonical", "at", "record_id", "body_md5", "row", full.alias("full"), F.expr(f"at div {bucket_seconds * 1_000_000}").alias("bucket"))
    placed = narrow.where("canonical is not null and at is not null")
    best = F.struct("at", "record_id", "body_md5", "row")
    within = Window.partitionBy("canonical", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("near", F.max(F.when(F.col("full"), best)).over(within)).where("not full")
    last = placed.where("full").groupBy("canonical", "bucket").agg(F.max(best).alias("last"))
    # buckets that hold revisits or responses, with the last response before each
    slots = last.unionByName(placed.where("not full").select("canonical", "bucket").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    slots = slots.groupBy("canonical", "bucket").agg(F.max("last").alias("last"))
    before = slots.withColumn("carried", F.max("last").over(Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("canonical", "bucket", "carried")
    found = inside.join(before, ["canonical", "bucket"], "left").select("row", F.coalesce("near", "carried").getField("row").alias("response_row"))
    revisits = seen.where(again).select("row", "record_id", "canonical", "at", etag.alias("etag"), modified.alias("modified"), "headers")
    responses = seen.where(full).select(F.col("row").alias("response_row"), F.col("record_id").alias("response_id"), etag.alias("r_etag"), modified.alias("r_modified"), F.col("headers").alias("r_headers"), "body_bytes", "body_md5")
    joined = revisits.join(found, "row", "left").join(responses, "response_row", "left")
    agree = F.when(F.col("etag").isNotNull() & F.col("r_etag").isNotNull(), F.col("etag") == F.col("r_etag")).otherwise(F.col("modified") == F.col("r_modified"))
    verdict = F.when(F.col("r_headers").isNull(), "no_response").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("mismatch")
    fresh = F.map_filter("headers", lambda k, _: ~k.isin(*NOT_MERGED))
    merged = F.map_concat(F.map_filter("r_headers", lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    ok = F.col("verdict") == "resolved"
    return joined.withColumn("verdict", verdict).select(
        "record_id", "canonical", "at", "verdict", "response_id", F.when(ok, F.col("body_bytes")).alias("body_bytes"), F.when(ok, F.col("body_md5")).alias("body_md5"), F.when(ok, merged).alias("headers")
    )


def captures(pages: DataFrame) -> DataFrame:
    """WARC content of a crawl that fetches every page and asks for it again later (a binary column).

    A page without a number counts as page 0 in times, and its records end in ``:``.
    Page p is fetched at second p of 2024 and revisited at second 10 000 000 + p
    with its ETag; every 7th revisit (p mod 7 = 3) carries a stale ETag, every
    11th (p mod 11 = 5) happened before the crawl began.
    """
    small_batches(pages.sparkSession)
    source = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import datetime, timedelta

        start = datetime(2024, 1, 1)
        date = lambda s: (start + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                out = []
                for number, url, html in zip(*(batch.column(k).slice(first, 64).to_pylist() for k in range(3)), strict=True):
                    page, name = number or 0, "" if number is None else number
                    body = (html or "").encode("utf-8", "surrogatepass")
                    etag = f'"{hashlib.md5(body).hexdigest()}"'
                    head = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body))), ("ETag", etag), ("Server", "crawl"), ("Date", date(page))]
                    later = date(10_000_000 + page) if page % 11 != 5 else date(-1 - page)
                    again = [("ETag", '"stale"' if page % 7 == 3 else f"W/{etag}"), ("Content-Length", "0"), ("Connection", "close"), ("Cache-Control", f"max-age={page % 100}"), ("Date", later)]
                    out.append(record_bytes("response", f"urn:page:{name}", url or "", date(page), 200, head, body) + record_bytes("revisit", f"urn:revisit:{name}", url or "", later, 304, again, b"", NOT_MODIFIED))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["content"])

    return source.mapInArrow(run, "content binary")
