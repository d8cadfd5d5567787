"""WARC archives: writing pages as records, and reading them back with segments put together again.

A page becomes a response record whose HTTP body is framed in chunks. A record
longer than a segment is cut: the first part keeps the record's identifier and
has segment number 1, the rest are continuation records that name it as their
origin, the last of them with the total length. Pages with equal payloads are
revisits of one of them. Reading groups continuation records by origin, orders
them by number, verifies the total length and decodes the chunks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.shared import materialize, pick

SEGMENT_BYTES = 32_768  # of a record's block
CHUNK_BYTES = 8_192  # of an HTTP chunk
ARCHIVE_RECORDS = 4_096  # so an archive is 128 MB at most, before compression
#: Groups of equal payloads that are broadcast to the writing tasks, 60 bytes each; more of them are joined by a shuffle.
BROADCAST_GROUPS = 100_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
END = b"\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[at : at + size]), payload[at : at + size]) for at in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over. ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of a response block: the HTTP body, without chunk framing if the headers declare it."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("HTTP message without end of headers")
    lines = [x.lower().replace(b" ", b"") for x in head.split(b"\r\n")[1:]]
    return dechunked(body) if b"transfer-encoding:chunked" in lines else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    named = [f"{k}: {str(v).translate({13: '%0D', 10: '%0A'})}" for k, v in [*headers, ("Content-Length", len(block))] if v is not None]
    return "\r\n".join(["WARC/1.1", *named]).encode() + END + block


def page_records(ident: str, url: str | None, payload: bytes, refers: str | None = None, segment: int = SEGMENT_BYTES, date: str = DATE) -> Iterator[bytes]:
    """The records of one page: a revisit without payload, or a response and its continuations."""
    common = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", ident), *common, ("WARC-Refers-To", refers), ("WARC-Profile", profile)], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = HTTP + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", ident), *common, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = len(block) if k == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{ident[:-1]}:{k}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last)], part)


@dataclass
class Parser:
    """Records out of bytes that come piece by piece; holds one record and a piece at a time."""

    held: bytearray = field(default_factory=bytearray)

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece
        at = 0
        while True:
            while self.held[at : at + 2] == b"\r\n":
                at += 2
            end = self.held.find(END, at)
            if end < 0:
                break
            lines = self.held[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record: {lines[0][:40]!r}")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            start, length = end + 4, int(headers["content-length"])
            if len(self.held) < start + length + 4:
                break
            yield headers, bytes(self.held[start : start + length])
            at = start + length + 4
        del self.held[:at]

    def close(self) -> None:
        if self.held.strip(b"\r\n"):
            raise ValueError("archive ends inside a record")


def unpacked(content: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """An archive's bytes in pieces, gzip members unpacked one after the other; plain archives as they are."""
    pieces = (content[at : at + piece] for at in range(0, len(content), piece))
    if content[:2] != b"\x1f\x8b":
        yield from pieces
        return
    member = zlib.decompressobj(31)
    for rest in pieces:
        while rest:
            yield member.decompress(rest, 1 << 20)
            rest = member.unused_data or member.unconsumed_tail
            if member.eof:
                member = zlib.decompressobj(31)
    while data := member.decompress(b"", 1 << 20):
        yield data


def _identifier(page_id, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}>"


def with_roles(pages: DataFrame, least_bytes: int = 0, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """page_id, url, payload, keep: the largest page_id with the same payload where another row has it too, else null.

    Payloads under ``least_bytes`` are never revisits. Lengths and two hashes
    are grouped, not payloads, so two payloads made to have one SHA-1 stay
    apart; unless very many groups share a payload, payloads are not shuffled.
    """
    held = pick(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("key", F.struct(F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("hash")))
    large = held.filter(F.octet_length("payload") >= least_bytes)
    groups = materialize(large.groupBy("key").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1 and keep is not null").select("key", "keep"), "warc-groups")
    few = groups.limit(broadcast_groups + 1).count() <= broadcast_groups
    return held.join(F.broadcast(groups) if few else groups, "key", "left").drop("key")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT_BYTES, archive_records: int = ARCHIVE_RECORDS, broadcast_groups: int = BROADCAST_GROUPS) -> None:
    """Write ``pages`` (page_id, url, html) as WARC archives under ``path``, each record a gzip member of its own, where they are read.

    A null html is an empty payload, a null url leaves its header out. Of rows
    with equal payloads those of the largest page_id are responses, repeated
    rows each of them; rows with another page_id or none are revisits. Very long
    payloads are cut into segments, each row held by one task; an empty table
    writes no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for page_id, url, payload, keep in zip(*(c for c in batch.slice(at, 200).select(["page_id", "url", "payload", "keep"]).columns), strict=True):
                    page, data, kept = page_id.as_py(), payload.as_py(), keep.as_py()
                    digest = payload_digest(data)
                    refers = None if kept is None or kept == page else _identifier(kept, digest)
                    out += page_records(_identifier(page, digest), url.as_py(), data, refers, segment)
                yield pa.record_batch({"value": pa.array([gzip.compress(r + END, 6, mtime=0) for r in out], pa.binary())})

    records = with_roles(pages, least_bytes, broadcast_groups).mapInArrow(write, "value binary")
    # The text writer puts a row's bytes and the line end as they are. An empty gzip member as line end leaves a file of members alone.
    line_end = gzip.compress(b"", 6, mtime=0).decode("latin-1")
    records.select(F.col("value").cast("string")).write.option("lineSep", line_end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", archive_records).option("compression", "none").text(path)


READ = "type string, record_id string, refers_to string, digest string, origin string, number int, total long, block_hash binary, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``READ`` rows of the archives under ``path``.

    Whole responses have their payload decoded (its bytes only if
    ``payloads``) and its digest verified. Parts of a segmented record have
    ``number`` and the raw block as ``payload``. Revisits have neither. Other
    record types are passed over. An archive is read by one task, in pieces.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block_hash", pa.binary()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

        def row(h: dict[str, str], block: bytes) -> dict | None:
            kind, ident, digest = h.get("warc-type"), h.get("warc-record-id"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind == "revisit":
                return {"type": kind, "record_id": ident, "refers_to": h.get("warc-refers-to"), "digest": digest}
            if kind == "continuation" or kind == "response" and "warc-segment-number" in h:
                total = h.get("warc-segment-total-length")
                return {"type": kind, "record_id": ident, "digest": digest, "origin": h.get("warc-segment-origin-id", ident), "number": int(h["warc-segment-number"]), "total": total and int(total), "block_hash": xxhash.xxh3_128_digest(block), "payload": block}
            if kind == "response":
                payload = payload_of(block)
                return {"type": kind, "record_id": ident, "digest": verified(payload, digest, ident), "payload_bytes": len(payload), "payload": payload if payloads else None}
            return None

        for batch in batches:
            for content in batch.column(0):
                parser, rows, size = Parser(), [], 0
                for piece in unpacked(content.as_py()):
                    for headers, block in parser.feed(piece):
                        if found := row(headers, block):
                            rows.append(found)
                            size += len(block)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                parser.close()
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, READ)


def verified(payload: bytes, digest: str | None, ident: str | None) -> str:
    """The payload's digest; ValueError if another one is declared."""
    found = payload_digest(payload)
    if digest not in (None, found):
        raise ValueError(f"payload of {ident} does not have the digest {digest}")
    return found


def joined(numbers: list[int], totals: list[int | None], blocks: list[bytes], ident: str) -> tuple[bytes, int]:
    """(block, copies) of the segments of one origin in any order. A record archived twice has each number twice.

    ValueError where a number is missing, copies differ, or the total length is missing or wrong.
    """
    found: dict[int, bytes] = {}
    for number, block in zip(numbers, blocks, strict=True):
        if found.setdefault(number, block) != block:
            raise ValueError(f"segment {number} of {ident} comes in two forms")
    if sorted(found) != [*range(1, len(found) + 1)] or len(numbers) % len(found):
        raise ValueError(f"segments of {ident} are missing: {sorted(found)}")
    whole, declared = b"".join(found[k] for k in sorted(found)), {t for t in totals if t is not None}
    if declared != {len(whole)}:
        raise ValueError(f"{ident} has {len(whole)} bytes, declared {sorted(declared)}")
    return whole, len(numbers) // len(found)


def one_of_each(parts: DataFrame) -> DataFrame:
    """origin, number, total, digest, payload, n, forms of ``parts``: one row of each segment, which stands n times in so many forms.

    Segments are counted without their blocks. Those archived more than once
    are brought to one row by an aggregate that combines in each task before
    the shuffle, so the copies of a record never meet; the others stay as they are.
    """
    counts = parts.groupBy("origin", "number").agg(F.count("*").alias("n"))
    repeated = materialize(counts.filter("n > 1").select("origin").distinct(), "warc-repeated")
    once = lambda df: df.select("origin", "number", "total", "digest", "payload", F.lit(1).cast("long").alias("n"), F.lit(1).alias("forms"))
    if repeated.isEmpty():
        return once(parts)
    many = parts.join(repeated, "origin", "left_semi").groupBy("origin", "number").agg(
        F.max("total").alias("total"), F.max("digest").alias("digest"), F.first("payload").alias("payload"), F.count("*").alias("n"),
        F.when((F.min("block_hash") == F.max("block_hash")) & F.min("total").eqNullSafe(F.max("total")), 1).otherwise(2).alias("forms"),
    )
    return once(parts.join(repeated, "origin", "left_anti")).unionByName(many)


def reassembled(records: DataFrame, payloads: bool = True) -> DataFrame:
    """type, record_id, digest, payload_bytes, payload of the segmented records among ``records``, each as often as it was archived.

    Segments come grouped by origin and in order; a task holds one record's.
    ValueError where a segment is missing, comes in two forms, or is not as often there as the others.
    """
    schema = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("n", pa.int64())])

    def whole(ident: str, rows: list[tuple]) -> dict:
        """rows: (number, total, digest, block, n, forms)."""
        if max(r[5] for r in rows) > 1:
            raise ValueError(f"a segment of {ident} comes in two forms")
        if len(copies := {r[4] for r in rows}) > 1:
            raise ValueError(f"segments of {ident} are missing: they are there {sorted(copies)} times")
        block, _ = joined([r[0] for r in rows], [r[1] for r in rows], [r[3] for r in rows], ident)
        payload = payload_of(block)
        digest = verified(payload, next((r[2] for r in rows if r[2]), None), ident)
        return {"type": "response", "record_id": ident, "digest": digest, "payload_bytes": len(payload), "payload": payload if payloads else None, "n": copies.pop()}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, rows, out, size = None, [], [], 0
        for batch in batches:
            for origin, *row in zip(*(batch[c].to_pylist() for c in ("origin", "number", "total", "digest", "payload", "n", "forms")), strict=True):
                if origin != ident and rows:
                    out.append(whole(ident, rows))
                    size, rows = size + (len(out[-1]["payload"] or b"")), []
                    if size > 8_000_000 or len(out) >= 5_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                ident = origin
                rows.append(tuple(row))
        if rows:
            out.append(whole(ident, rows))
        yield pa.RecordBatch.from_pylist(out, schema)

    parts = records.filter("number is not null").select("origin", "number", "total", "digest", "block_hash", "payload")
    ordered = one_of_each(parts).repartition("origin").sortWithinPartitions("origin", "number")
    made = ordered.mapInArrow(join, "type string, record_id string, digest string, payload_bytes long, payload binary, n long")
    # Copies in thousands, so that no array grows with them.
    thousands = made.withColumn("k", F.explode(F.expr("sequence(0, cast((n - 1) div 1000 as int))")))
    return thousands.withColumn("copy", F.explode(F.expr("sequence(1, cast(least(1000, n - 1000 * k) as int))"))).drop("n", "k", "copy")


def read_pages(spark: SparkSession, path: str, id_type: T.DataType, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, and with ``payloads`` payload, of every archived page.

    A revisit takes length and payload from the response it names; one whose
    response is not there has null for both. A folder without archives gives no row.
    """
    records = materialize(read_archives(spark, path, payloads), "warc-records")
    names = ["type", "record_id", "digest", "payload_bytes", "payload"]
    responses = records.filter("type = 'response' and number is null").select(*names).union(reassembled(records, payloads).select(*names))
    if records.filter("number is not null").isEmpty():
        responses = records.filter("type = 'response'").select(*names)
    whole = materialize(responses, "warc-responses")
    # A record archived more than once is one target.
    targets = whole.groupBy("record_id").agg(F.first(F.struct("payload_bytes", "payload")).alias("p")).select(F.col("record_id").alias("refers_to"), "p.*")
    revisits = records.filter("type = 'revisit'").select("type", "record_id", "digest", "refers_to").join(targets, "refers_to", "left")
    every = whole.withColumn("refers_to", F.lit(None).cast("string")).unionByName(revisits)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*):[A-Z2-7]*>$", 1), F.lit("none")).cast(id_type)
    found = every.select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"), "payload")
    return found if payloads else found.drop("payload")
