"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both refer to their response by identifier, target and date. The metadata record keeps the source's status, headers and
digests and what the page says about itself; the conversion record holds its text. Each derivative is linked to its sibling
and has digests of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fitgauge.llm.markup import blocks

VERSION = "WARC/1.1"
#: Records of these tables: the headers in order, and the block.
RECORD = "record_id string, warc_type string, target_uri string, refers_to string, headers array<struct<name: string, value: string>>, block binary"
FIELDS = ["record_id", "warc_type", "target_uri", "refers_to", "headers", "block"]
TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()]
#: Type of the rows that stand for bytes of a file that are no whole record; no record has it.
DAMAGED = "damaged"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
CHUNK_SIZE = re.compile(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;.*)?", re.S)
GZIP = b"\x1f\x8b\x08"
#: Bytes of a damaged gzip member that are unpacked at a time, and of records that are handed on together.
STEP_BYTES, BATCH_BYTES = 1 << 14, 1 << 24
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
TITLE = re.compile(r"<title[^>]*>(.*?)(?:</title|\Z)", re.I | re.S)
LANGUAGE = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    """A record identifier that follows from the parts alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def payload(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response; without a header block all of it is the body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    names = {n.lower(): v.lower() for n, v in headers}
    if "chunked" in names.get("transfer-encoding", ""):
        body = _dechunked(body)
    coding = names.get("content-encoding", "")
    try:
        if "gzip" in coding:
            body = gzip.decompress(body)
        elif "deflate" in coding:
            body = zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass  # a body that can't be unpacked is read as it stands
    return lines[0], headers, body


def _dechunked(body: bytes) -> bytes:
    out, place = [], 0
    while (end := body.find(b"\r\n", place)) >= 0:
        stated = CHUNK_SIZE.fullmatch(body, place, end)
        if not stated:
            return body
        size = int(stated[1], 16)
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        place = end + 4 + size
    return b"".join(out)


def decoded(body: bytes, headers: list[tuple[str, str]]) -> tuple[str, str]:
    """The page as text, and its charset: from the headers, else from the page's start, else UTF-8. A charset that is unknown, or is
    none for pages, counts as UTF-8; what can't be decoded or encoded again becomes a replacement character."""
    stated = next((v for n, v in headers if n.lower() == "content-type"), "").encode()
    found = CHARSET.search(stated) or CHARSET.search(body[:2048])
    name = found[1].decode().lower() if found else "utf-8"
    if name != "utf-8":
        try:
            return body.decode(name, "replace").encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"), name
        except (LookupError, ValueError, OverflowError):
            pass
    return body.decode("utf-8", "replace"), "utf-8"


def _record(record_id: str, kind: str, uri: str, refers_to: str, headers: list[tuple[str, str]], content_type: str, block: bytes) -> tuple:
    first = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", uri)]
    last = [("Content-Type", content_type), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return record_id, kind, uri, refers_to, [{"name": n, "value": v} for n, v in (*first, *headers, *last)], block


def derivatives(record_id: str, uri: str, headers: dict[str, str], block: bytes) -> tuple[tuple, tuple]:
    """The metadata and the conversion record of a response."""
    status, http, body = payload(block)
    page, charset = decoded(body, http)
    found = blocks(page)
    text = "\n".join(b.text for b in found).encode()
    date = headers.get("WARC-Date", "")
    metadata_id, conversion_id = identifier(record_id, "metadata"), identifier(record_id, "conversion")
    source = [("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Date", date)]
    fields = [("source-record-id", record_id), ("source-block-digest", headers.get("WARC-Block-Digest") or digest(block)),
              ("source-payload-digest", headers.get("WARC-Payload-Digest") or digest(body)), ("source-content-length", str(len(block)))]
    if status:
        fields.append(("http-status", status))
    fields += [(f"http-header-{n.lower()}", v) for n, v in http]
    fields.append(("charset-detected", charset))
    if language := LANGUAGE.search(page):
        fields.append(("languages-declared", language[1]))
    if title := TITLE.search(page):
        fields.append(("title", one_line(title[1])))
    fields += [("outlink", link) for b in found for link in b.links]
    warc_fields = "".join(f"{n}: {one_line(v)}\r\n" for n, v in fields).encode()
    payload_digest = ("WARC-Payload-Digest", headers.get("WARC-Payload-Digest") or digest(body))
    return (
        _record(metadata_id, "metadata", uri, record_id, [*source, ("WARC-Concurrent-To", conversion_id)], "application/warc-fields", warc_fields),
        _record(conversion_id, "conversion", uri, record_id, [*source, ("WARC-Concurrent-To", metadata_id), payload_digest], "text/plain; charset=utf-8", text),
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], FIELDS)


def responses(pages: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """A response record for each row of ``pages`` (``page_id``, ``url``, ``html``), with HTTP headers as a server sends them.

    The identifier follows from id and URL. Null URLs and pages count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, page in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                body, url = (page or "").encode(), url or ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                out.append(_record(
                    identifier("response", str(page_id), url), "response", url, None,
                    [("WARC-Date", date), ("WARC-Payload-Digest", digest(body))], "application/http; msgtype=response", head + body))
            yield _rows(out)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, RECORD)


def derived(records: DataFrame) -> DataFrame:
    """Two records for each response among ``records`` (columns of ``RECORD``; others are ignored): metadata and conversion.

    Records of other types, and those without an identifier or block, have no derivatives. Repeated responses give repeated
    derivatives with equal identifiers. A page without text gives an empty conversion. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 500):
                out = []
                for record_id, uri, headers, block in zip(*(b.column(c).slice(low, 500).to_pylist() for c in ("record_id", "target_uri", "headers", "block"))):
                    out += derivatives(record_id, uri or "", {h["name"]: h["value"] for h in headers or []}, block)
                yield _rows(out)

    rows = records.where("warc_type = 'response' and record_id is not null and block is not null")
    return rows.select("record_id", "target_uri", "headers", "block").mapInArrow(run, RECORD)


def written(headers: list[dict], block: bytes) -> bytes:
    """A record as it stands in a file."""
    head = "".join(f"{h['name']}: {one_line(h['value'] or '')}\r\n" for h in headers)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _unpacked(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Stretches of a gzipped file: the bytes of members end to end, and the packed bytes behind them that are no whole member.

    What came out of a broken member belongs to the first; search goes on at the next start of a member behind it.
    """
    parts, place = [], 0
    while place < len(data):
        member, packed = zlib.decompressobj(31), memoryview(data)[place:]
        whole = False
        if data.startswith(GZIP, place):
            used = 0
            try:
                while used < len(packed) and not member.eof:
                    parts.append(member.decompress(packed[used : used + STEP_BYTES]))
                    used += STEP_BYTES
            except zlib.error:
                pass
            whole = member.eof
        if whole:
            place += min(used, len(packed)) - len(member.unused_data)
            continue
        after = data.find(GZIP, place + 1)
        after = len(data) if after < 0 else after
        yield b"".join(parts), data[place:after]
        parts, place = [], after
    if parts:
        yield b"".join(parts), b""


def _damaged(data: bytes) -> tuple:
    return None, DAMAGED, None, None, [], data


def _records(data: bytes) -> Iterator[tuple]:
    place, bad = 0, 0
    while place < len(data):
        end = data.find(b"\r\n\r\n", place) if VERSION_LINE.match(data, place) else -1
        if end >= 0 and VERSION_LINE.search(data, place + 1, end + 2):
            end = -1  # cut within its headers, those of the next record follow
        headers = []
        for line in data[place:end].decode("utf-8", "replace").split("\r\n")[1:] if end >= 0 else ():
            name, _, value = line.partition(":")
            headers.append({"name": name.strip(), "value": value.strip()})
        by_name = {h["name"].lower(): h["value"] for h in headers}
        size = by_name.get("content-length", "")
        close = end + 4 + int(size) if end >= 0 and re.fullmatch(r"[0-9]{1,18}", size) else len(data) + 1
        # behind a block stand two line ends, or the file's end
        if close <= len(data) and data[close : close + 4] in (b"\r\n\r\n", b"\r\n", b""):
            if data[bad:place].strip():
                yield _damaged(data[bad:place])
            yield (by_name.get("warc-record-id"), by_name.get("warc-type"), by_name.get("warc-target-uri"), by_name.get("warc-refers-to"), headers,
                   data[end + 4 : close])
            place = bad = min(close + 4, len(data))
        else:
            after = VERSION_LINE.search(data, place + 1)
            place = after.start() if after else len(data)
    if data[bad:].strip():
        yield _damaged(data[bad:])


def read(data: bytes) -> Iterator[tuple]:
    """The records of a file's bytes, plain or gzipped in members, in their order.

    Reading goes on behind a damaged record, where the next whole one starts, and behind a broken member at the next member. Each
    stretch of bytes that is left out, white space aside, is a row of type ``DAMAGED`` with those bytes as its block, so that nothing
    is lost unseen.
    """
    if not data.startswith(GZIP[:2]):
        yield from _records(data)
        return
    for whole, broken in _unpacked(data):
        yield from _records(whole)
        if broken:
            yield _damaged(broken)


def parsed(files: DataFrame) -> DataFrame:
    """The records of WARC files (``content``, as the binary file source gives them); other columns are ignored.

    Damaged stretches are rows of type ``DAMAGED``, which have no derivatives. A null or empty file has no records, repeated files
    repeat theirs, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for record in read(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    rows.append(record)
                    size += len(record[5])
                    if size > BATCH_BYTES:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    return files.select("content").mapInArrow(run, RECORD)


def archived(records: DataFrame) -> DataFrame:
    """Adds ``member``: the record as a gzip member. Members end to end are a WARC file.

    Null headers and blocks count as empty; extra columns are left out, repeated records repeat, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = [gzip.compress(written(h or [], x or b""), mtime=0) for h, x in zip(b.column("headers").to_pylist(), b.column("block").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(members, pa.binary())], [*b.schema.names, "member"])

    return records.select(*FIELDS).mapInArrow(run, f"{RECORD}, member binary")
