"""WARC archives: written by tasks, and read back in byte ranges.

Every record written is a gzip member of its own; archives of other writers are read too. A reading task gets a byte range, looks for the gzip magic in it, and takes a
candidate for a member only if it inflates to a WARC header; it owns the records that start inside its range and
reads on past the end for the last one. Archives of any size are so read by many tasks, without an index.

Files are opened by URI through Arrow's file systems. A writing attempt writes files of its own name, and only files
of committed attempts are in the manifest, so tasks can be lost and run again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from tussis.llm.common import if_small, whole_text, written

#: Smaller payloads are always stored in full.
MIN_REVISIT_BYTES = 100
#: An archive file is closed beyond this size; a reading task takes ranges of this size.
FILE_BYTES = 1 << 30
RANGE_BYTES = 32 << 20
BLOCK_BYTES = 1 << 20
MOST_TASKS = 100_000

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "path string, length bigint, records bigint"


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, also in Hadoop's spelling of local ones."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record_bytes(page_id, url: str | None, digest: str, payload: bytes, refers_to) -> bytes:
    """One record, not yet compressed; a revisit (``refers_to`` given) has the response's HTTP header, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) as ``*.warc.gz`` under ``folder``; the manifest ``path, length, records``.

    Of records with equal payloads of 100 bytes or more, the one with the smallest id is a response and the others
    revisit it. A null html is empty, a null url is left out. Null ids are never the one that is revisited: they
    revisit an equal payload that has an id, and are responses otherwise. Rows that repeat the smallest id
    are all responses. An empty table writes nothing; other columns are ignored.
    """
    payload = whole_text(F.col("html")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    again = keyed.filter(F.octet_length("payload") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    again = written(again.filter("n > 1 and first_id is not null").select("digest", "first_id"), "equal-payloads")
    marked = keyed.join(if_small(again), "digest", "left").select(
        "page_id", "url", "digest", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(folder)
        out = path = None
        length = records = 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([records])], ["path", "length", "records"])

        for batch in batches:
            page, url, digest, payloads, refers = batch.columns
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    where.create_dir(base, recursive=True)
                    out, path, length, records = where.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0, 0
                data = member(record_bytes(page[i].as_py(), url[i].as_py(), digest[i].as_py(), payloads[i].as_buffer().to_pybytes(), refers[i].as_py()))
                out.write(data)
                length, records = length + len(data), records + 1
                if length >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(marked.mapInArrow(write, MANIFEST), "manifest")


def inflate(source, start: int) -> tuple[bytes, int] | None:
    """The WARC record of the gzip member at ``start`` and the member's end; None if there is no such member."""
    source.seek(start)
    unpack, parts, got, position = zlib.decompressobj(31), [], 0, start
    while not unpack.eof:
        data = source.read(64 << 10)
        if not data:
            return None
        position += len(data)
        try:
            part = unpack.decompress(data)
        except zlib.error:
            return None
        parts.append(part)
        got += len(part)
        if got >= len(VERSION) and len(parts) <= 2 and not b"".join(parts).startswith(VERSION):
            return None
    record = b"".join(parts)
    return (record, position - len(unpack.unused_data)) if record.startswith(VERSION) else None


def records_in(source, start: int, end: int) -> Iterator[bytes]:
    """Inflated members that hold records and start in [start, end)."""
    at, offset, block = start, start, b""
    while at < end:
        if at < offset or at - offset + len(MAGIC) > len(block):
            source.seek(at)
            offset, block = at, source.read(min(BLOCK_BYTES, end - at) + len(MAGIC) - 1)
        found = block.find(MAGIC, at - offset)
        if found < 0 or offset + found >= end:
            at = offset + max(1, len(block) - len(MAGIC) + 1)
            if len(block) < len(MAGIC):
                return
            continue
        at = offset + found
        taken = inflate(source, at)
        if taken is None:
            at += 1
        else:
            yield taken[0]
            at = taken[1]


def header_fields(head: bytes) -> dict[str, str]:
    """Header lines after the first as a dict of lower-case names; folded lines are joined, of repeated names the first counts."""
    fields: dict[str, str] = {}
    last = None
    for line in re.split("\r?\n", head.decode("utf-8", "replace"))[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            if last in fields:
                last = None
            else:
                fields[last] = value.strip()
    return fields


def cut_head(data: bytes, start: int = 0) -> tuple[bytes, int]:
    """The header that starts at ``start`` and the place after its blank line; without one, all of the rest is header."""
    ends = re.compile(rb"\r?\n\r?\n").search(data, start)
    return (data[start : ends.start()], ends.end()) if ends else (data[start:], len(data))


def split_member(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of every record of an inflated member; some writers put several into one. A damaged one raises."""
    at = 0
    while at < len(data):
        head, begin = cut_head(data, at)
        fields = header_fields(head)
        if not head.startswith(VERSION) or not re.fullmatch("[0-9]+", fields.get("content-length", "")):
            raise ValueError(f"damaged record {fields.get('warc-record-id')}: no header")
        end = begin + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"damaged record {fields.get('warc-record-id')}: wrong length")
        yield fields, data[begin:end]
        at = end + 4


def dechunked(body: bytes) -> bytes:
    """An HTTP body without its chunk sizes; as it is from where it isn't chunked."""
    parts, at = [], 0
    while True:
        size = re.compile(rb"([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r?\n").match(body, at)
        if size is None:
            return b"".join([*parts, body[at:]])
        n = int(size[1], 16)
        if n == 0:
            return b"".join(parts)
        parts.append(body[size.end() : size.end() + n])
        at = size.end() + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0


def digest_matches(declared: str, *contents: bytes) -> bool | None:
    """Whether ``algorithm:value`` (hex or base 32) is the digest of one of the contents; None where the algorithm isn't known."""
    name, _, value = declared.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512") or not value:
        return None
    for content in contents:
        found = hashlib.new(name, content, usedforsecurity=False).digest()
        if value.strip().lower() == found.hex() or value.strip().rstrip("=").upper() == base64.b32encode(found).decode().rstrip("="):
            return True
    return False


def page_of(identifier: str | None) -> int | None:
    """The page id in a record id of this module's archives; None for any other."""
    found = re.fullmatch(r"<?urn:page:(-?[0-9]{1,19})>?", identifier or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def parsed(fields: dict[str, str], block: bytes) -> tuple:
    """The columns of ``RECORD`` for one record.

    The payload is what follows an HTTP header, without chunk sizes, or the whole block of other records. Its length and
    SHA-256 are taken from it; those of a revisit, which has none, from the response's length and the declared
    digest (as declared, where it isn't SHA-256 in hex). A block or payload that contradicts its declared digest, or an HTTP body
    shorter than its length without a note that it was cut, raises.
    """
    kind, content = fields.get("warc-type", "").lower(), fields.get("content-type", "").lower()
    is_http = content.replace(" ", "").startswith("application/http") and kind in ("response", "request", "revisit")
    payload, http, line = block, {}, b""
    if is_http:
        head, begin = cut_head(block)
        http, payload, line = header_fields(head), block[begin:], head.partition(b"\n")[0]
    raw = payload
    if "chunked" in http.get("transfer-encoding", "").lower():
        payload = dechunked(raw)
    declared, whole = fields.get("warc-payload-digest", ""), "warc-truncated" not in fields
    status = re.match(rb"HTTP/\S+ +([0-9]{3})", line)
    stated = http.get("content-length", "")
    size = int(stated) if stated.isdecimal() else None
    if kind == "revisit":
        length, digest = size, declared.strip()
        if re.fullmatch("sha-?256:[0-9a-fA-F]{64}", digest, re.IGNORECASE):
            digest = digest.partition(":")[2].lower()
        damaged = False
    else:
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
        short = size is not None and raw is payload and len(payload) < size
        damaged = whole and (short or digest_matches(declared, payload, raw) is False)
    if damaged or whole and digest_matches(fields.get("warc-block-digest", ""), block) is False:
        raise ValueError(f"damaged record {fields.get('warc-record-id')}: wrong digest or length")
    return (
        page_of(fields.get("warc-record-id")), length, digest or None, kind or None, page_of(fields.get("warc-refers-to")), fields.get("warc-target-uri"),
        fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-date"), int(status[1]) if status else None, content or None,
    )


RECORD = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string,"
    " record_id string, refers_to_id string, date string, http_status int, content_type string"
)
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_TYPES = [_ARROW[c.split()[1]] for c in RECORD.split(", ")]


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of ``files`` (``path, length``), in ranges of ``range_bytes`` that are tasks' work of their own.

    Any gzipped WARC file can be read: all record types, HTTP headers with or without lengths, chunked bodies, MD5 and SHA
    digests in hex or base 32, ids of any form (``page_id`` and ``refers_to`` are null unless they name a page; ``record_id`` and
    ``refers_to_id`` hold them as they are), fields in any case, several records to a member. What a record doesn't have is null.

    Members that don't inflate to a WARC record are passed over; a record whose lengths or digest are wrong raises. Text
    payloads can't hold the gzip magic (it isn't UTF-8), so no range starts at a false member; an archive stored
    uncompressed inside a record could be taken for members where a range starts in it. An empty table gives no rows.
    """
    ranges = files.filter("length > 0").select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start"))
    tasks = min(MOST_TASKS, max(1, ranges.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                where, name = opened(path)
                with where.open_input_file(name) as source:
                    rows = []
                    for data in records_in(source, start, min(start + range_bytes, length)):
                        rows.extend(parsed(*record) for record in split_member(data))
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    return ranges.repartition(tasks).mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)
