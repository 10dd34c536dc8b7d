"""WARC archives: a deduplicating writer and a reader that salvages what it can."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm.text import arrow_schema
from strandline.session import cut, shared_folder

#: Payloads of fewer bytes are always written whole.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PREFIX, NO_ID = "urn:page:", "urn:nil:page"
VERSION, GZIP = b"WARC/1.", b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.[0-9]\r\n")
#: More digits than any length has are damage, as are digits of other scripts.
LENGTH = re.compile(r"[0-9]{1,18}", re.ASCII)
DIGEST = re.compile(r"sha1:(?:([A-Z2-7]{32})|([0-9a-f]{40}))", re.ASCII | re.IGNORECASE)
CHUNK, WINDOW = 1 << 16, 1 << 20
#: Longest header of a record, and longest name or comment of a gzip member.
MOST_HEADER, MOST_NAME = 1 << 16, 1 << 12
BATCH_BYTES = 8 << 20
RECORD = (
    "archive string, offset bigint, length bigint, kind string, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes bigint, payload binary, reason string"
)


def _wire_digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _hex_digest(wire: str) -> str | None:
    """Lower-case hex of a SHA-1 that is written in base32 or in hex; null if it is neither."""
    found = DIGEST.fullmatch(wire.strip())
    if found is None:
        return None
    return base64.b32decode(found[1].upper()).hex() if found[1] else found[2].lower()


def _urn(page_id) -> str:
    return NO_ID if page_id is None else PREFIX + quote(str(page_id), safe="")


def render(page_id, url, payload: bytes, record_type: str, refers_to, digest: str, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record: HTTP response with the payload, or the headers alone of a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    head = {
        "WARC-Type": record_type, "WARC-Record-ID": f"<{_urn(page_id)}>", "WARC-Date": date,
        "WARC-Target-URI": None if url is None else "".join(url.split()) or None,
        "WARC-Payload-Digest": _wire_digest(digest),
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "Content-Type": "application/http; msgtype=response",
    }
    if record_type == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_urn(refers_to)}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


class Broken(ValueError):
    """A record that fails its checks."""


def headers(data: bytes) -> tuple[dict[str, str], int]:
    """Fields of a record's header, without the line ends that close it, and the length of its block."""
    if not VERSION_LINE.match(data + b"\r\n"):
        raise Broken("no version line")
    head = {}
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("bad header line")
        head[name.strip().lower()] = value.strip()
    if not LENGTH.fullmatch(head.get("content-length", "")):
        raise Broken("no content length")
    return head, int(head["content-length"])


def check_block(head: dict[str, str], block: bytes) -> None:
    told = head.get("warc-block-digest", "")
    if told.lower().startswith("sha1:") and _hex_digest(told) != hashlib.sha1(block).hexdigest():
        raise Broken("block digest differs")


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the whole record that ``data`` begins with."""
    end = data.find(b"\r\n\r\n", 0, MOST_HEADER)
    if end < 0:
        raise Broken("no header")
    head, length = headers(data[:end])
    stop = end + 4 + length
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("content length doesn't lead to the end of a record")
    block = data[end + 4 : stop]
    check_block(head, block)
    return head, block, stop + 4


class Window:
    """A file read through one buffered window that moves forward, so that a search over many false starts reads each byte once or twice."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""
        #: The first blank line found at or after the offset it was looked for from.
        self.blank_from, self.blank_at = 0, -1
        #: Where the next version line and the next gzip member are.
        self.ahead = [-1, -1]

    def read(self, offset: int, n: int) -> bytes:
        n = min(n, self.size - offset)
        if n <= 0:
            return b""
        if offset < self.start or offset + n > self.start + len(self.data):
            self.file.seek(offset)
            self.start, self.data = offset, bytes(self.file.read(max(n, WINDOW)))
        at = offset - self.start
        return self.data[at : at + n]

    def find(self, pattern: bytes, offset: int, stop: int) -> int:
        """Where the pattern begins first, at or after an offset and within bytes before ``stop``; -1 if nowhere.  Nothing is copied."""
        stop = min(stop, self.size)
        while offset + len(pattern) <= stop:
            self.read(offset, len(pattern))  # moves the window if need be
            held = self.start + len(self.data)
            at = self.data.find(pattern, offset - self.start, min(stop, held) - self.start)
            if at >= 0:
                return self.start + at
            if held >= stop:
                break
            offset = max(held - len(pattern) + 1, offset + 1)
        return -1

    def blank(self, offset: int) -> int:
        """Where the first blank line at or after an offset begins, within the longest header; -1 if there is none."""
        if not self.blank_from <= offset <= self.blank_at:
            found = self.find(b"\r\n\r\n", offset, offset + MOST_HEADER)
            if found < 0:
                return -1
            self.blank_from, self.blank_at = offset, found
        return self.blank_at if self.blank_at - offset <= MOST_HEADER else -1

    def next_start(self, offset: int) -> int:
        """Where the next gzip member or version line begins, from an offset on."""
        for i, pattern in enumerate((VERSION, GZIP)):
            # Places already found stay good until the search has passed them.
            if self.ahead[i] < offset:
                found = self.find(pattern, offset, self.size)
                self.ahead[i] = self.size if found < 0 else found
        return min(self.ahead)


def _member_header(file: Window, offset: int) -> None:
    """Fail soon where gzip's magic bytes begin no header: reserved flags, or a name or comment without an end."""
    head = file.read(offset, 12)
    if len(head) < 12 or head[3] & 0xE0:
        raise Broken("no header of a member")
    at = offset + 10
    if head[3] & 4:
        at += 2 + int.from_bytes(head[10:12], "little")
    for flag in (8, 16):
        if head[3] & flag:
            end = file.read(at, MOST_NAME).find(b"\0")
            if end < 0:
                raise Broken("no header of a member")
            at += end + 1


def _member(file: Window, offset: int) -> tuple[bytes, int]:
    """The content of the gzip member at an offset, and its length."""
    _member_header(file, offset)
    unzip, parts, at, step = zlib.decompressobj(31), [], offset, 1 << 10
    while not unzip.eof:
        chunk = file.read(at, step)
        if not chunk:
            raise Broken("member is cut off")
        try:
            parts.append(unzip.decompress(chunk))
        except zlib.error as error:
            raise Broken(f"member is damaged: {str(error)[:80]}") from error
        at, step = at + len(chunk), CHUNK
    return b"".join(parts), at - len(unzip.unused_data) - offset


def _plain(file: Window, offset: int) -> tuple[dict[str, str], bytes, int]:
    """The uncompressed record at an offset; its block is read only if its length leads to the end of a record."""
    end = file.blank(offset) if VERSION_LINE.match(file.read(offset, 16)) else -1
    if end < 0:
        raise Broken("no header")
    if file.find(b"\r\n" + VERSION, offset, end) >= 0:
        raise Broken("another record begins in the header")
    head, length = headers(file.read(offset, end - offset))
    stop = end + 4 + length
    if stop + 4 > file.size:
        raise Broken("content length goes beyond the archive")
    file.file.seek(stop)
    if bytes(file.file.read(4)) != b"\r\n\r\n":
        raise Broken("content length doesn't lead to the end of a record")
    file.file.seek(end + 4)
    block = bytes(file.file.read(length))
    check_block(head, block)
    return head, block, stop + 4 - offset


def salvage(file, size: int) -> Iterator[tuple]:
    """Records of one archive in order, and each gap of bytes that belongs to no valid record.

    Yields ``("record", offset, length, headers, block)`` or ``("gap", offset, length, reason, None)``.  After a failed
    check the search goes on at the next byte that begins a gzip member or a version line; gaps that touch are one.

    No damage raises: wrong digests, lengths and headers all make a gap.  Digests may be base32 or hex.  What no check covers
    is taken as it stands: the header of an uncompressed record has no digest, so a changed id or date there isn't seen.
    """
    offset, gap, reason, window = 0, None, "", Window(file, size)
    while offset < size:
        start = window.read(offset, len(VERSION))
        try:
            if start.startswith(GZIP):
                data, length = _member(window, offset)
                head, block, used = parse(data)
                if used != len(data):
                    raise Broken("more than one record in a member")
            elif start.startswith(VERSION):
                head, block, length = _plain(window, offset)
            else:
                raise Broken("no member or version line")
        except Broken as error:
            if gap is None:
                gap, reason = offset, str(error)
            offset = window.next_start(offset + 1)
            continue
        if gap is not None:
            yield "gap", gap, offset - gap, reason, None
            gap = None
        yield "record", offset, length, head, block
        offset += length
    if gap is not None:
        yield "gap", gap, size - gap, reason, None


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html, record_type, refers_to, digest`` rows as one ``.warc.gz`` a task, a member a record.

    Returns the manifest ``archive, records, bytes``.  A task that is run again writes another file; only files of the
    manifest count, so half-written archives of lost executors are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, path = fs.FileSystem.from_uri(folder)
        name, out, count, size = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for page_id, url, html, record_type, refers_to, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    target.create_dir(path, recursive=True)
                    out = target.open_output_stream(f"{path}/{name}", compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = render(page_id, url, (html or "").encode("utf-8", "surrogatepass"), record_type, refers_to, digest)
                member = pack.compress(data) + pack.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

    return cut(records.select("page_id", "url", "html", "record_type", "refers_to", "digest").mapInArrow(run, "archive string, records bigint, bytes bigint"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records and quarantined gaps of the archives named in column ``archive``, streamed file by file.

    ``kind`` is record or gap; a gap has its offset, length and reason.  ``payload_digest`` (lower-case hex) and
    ``payload_bytes`` are of the full payload: of the bytes themselves, and of a revisit what its headers say.
    """

    schema = arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                source, path = fs.FileSystem.from_uri(archive)
                size = source.get_file_info(path).size
                rows, held = [], 0
                with source.open_input_file(path) as file:
                    for kind, offset, length, head, block in salvage(file, size):
                        if kind == "gap":
                            row = dict(kind=kind, reason=head)
                        else:
                            body = block
                            if head.get("content-type", "").startswith("application/http"):
                                body = block.partition(b"\r\n\r\n")[2]
                            told = head.get("warc-payload-digest", "")
                            revisit = head.get("warc-type") == "revisit"
                            n, digest = len(body), hashlib.sha1(body).hexdigest()
                            if revisit:
                                digest = _hex_digest(told)
                                http = [x.partition(b":") for x in block.partition(b"\r\n\r\n")[0].lower().split(b"\r\n")]
                                n = next((int(v) for k, _, v in http if k == b"content-length" and LENGTH.fullmatch(v.strip().decode("latin-1"))), None)
                            row = dict(
                                kind=kind, record_type=head.get("warc-type"), record_id=head.get("warc-record-id", "").strip("<>"),
                                target_uri=head.get("warc-target-uri"), refers_to=head.get("warc-refers-to", "").strip("<>") or None,
                                payload_digest=digest, payload_bytes=n, payload=body if payloads else None,
                            )
                        rows.append(row | dict(archive=archive, offset=offset, length=length))
                        held += len(block or b"") if payloads else 500
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("archive").mapInArrow(run, RECORD)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Which record every page gets: ``page_id, url, html, digest, record_type, refers_to``.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes that with the largest page_id is the response (repeated rows
    of it all are), the others revisit it; a null page_id is the smallest.  A null payload is empty.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long_ = rows.where(F.octet_length("html") >= REVISIT_BYTES)
    again = long_.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "newest")
    revisit = (F.col("newest").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return rows.join(again, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("newest")).alias("refers_to")
    )


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page as a WARC record in the shared folder and read all archives back: a row for each record.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``; ids keep their type (text is quoted in the
    record id), a null id stays null, a null payload is empty, repeated rows are records of their own, of equal payloads
    the largest id is the response, an empty table writes nothing, and other columns are ignored.

    Byte gaps that the reader quarantines are logged as Parquet in ``quarantine`` below the folder; a gap, or another
    number of records than the manifest has, raises a RuntimeError that names the log.  Without ``folder`` the archives
    stand in a new one, which is deleted once they are read.
    """
    own = folder is None
    folder = folder or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(plan_records(pages), folder)
    found = cut(read_archives(manifest.repartition(max(1, manifest.count())), payloads=False))
    records, gaps = found.where("kind = 'record'"), found.where("kind = 'gap'")
    written = manifest.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first().n
    read = records.count()
    if read != written or not gaps.isEmpty():
        gaps.select("archive", "offset", "length", "reason").write.parquet(f"{folder}/quarantine")
        raise RuntimeError(f"{read} of {written} records were read; gaps are logged in {folder}/quarantine")
    if own and written:
        store, path = fs.FileSystem.from_uri(folder)
        store.delete_dir(path)
    kind = pages.schema["page_id"].dataType
    named = lambda c: F.when(F.col(c).startswith(PREFIX), F.url_decode(F.substring(c, len(PREFIX) + 1, 1 << 30))).cast(kind)
    return records.select(named("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", named("refers_to").alias("refers_to"))
