"""WARC records in ZIP packages: written with an index, read by ranges without extraction.

A package holds stored (not compressed) members:

    archive/data.warc.gz   records, each a gzip member of its own
    indexes/index.cdx      a line for each record: key, time, and its file, offset and length as JSON
    datapackage.json       counts

The reader parses the end of the file, the ZIP64 end if there is one, and the central directory;
finds where the bytes of stored members lie; reads all indexes; and reads the records of all archives
by their ranges, neighbouring ranges in one request. An archive that no index covers is an error.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.shared import filesystem, joined_with_one, put_file, workspace, written
from barwright.llm.tokens import forget

DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE, _TIME = "2024-01-01T00:00:00Z", "20240101000000"
#: Bytes of compressed records in a package, and of one range request, about.
PACKAGE_BYTES, REQUEST_BYTES = 8 << 20, 1 << 20
_ID = "urn:barwright:page:"


class ArchiveError(ValueError):
    """A package or record is not as its directory, index or digest says."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int  # where its local header lies


class Package:
    """A ZIP file read by ranges. ``read(start, length)`` gives bytes; ``size`` is the file's."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _directory(self):
        tail_at = max(0, self.size - 65557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)  # these bytes may also stand in the comment
        if at < 0:
            raise ArchiveError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self.read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ArchiveError("no ZIP64 locator")
            end = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ArchiveError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end, 32)
        entries, at = self.read(start, length), 0
        for _ in range(count):
            if entries[at : at + 4] != b"PK\x01\x02":
                raise ArchiveError("a damaged central directory")
            method = struct.unpack_from("<H", entries, at + 10)[0]
            packed, size, n, extra, comment = struct.unpack_from("<IIHHH", entries, at + 20)
            header = struct.unpack_from("<I", entries, at + 42)[0]
            name = entries[at + 46 : at + 46 + n].decode("utf-8")
            x, stop = at + 46 + n, at + 46 + n + extra
            while x + 4 <= stop:
                kind, wide = struct.unpack_from("<HH", entries, x)
                if kind == 1:  # ZIP64: only the values that did not fit, in this order
                    values = list(struct.unpack_from(f"<{wide // 8}Q", entries, x + 4))
                    size = values.pop(0) if size == 0xFFFFFFFF else size
                    packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                    header = values.pop(0) if header == 0xFFFFFFFF else header
                x += 4 + wide
            yield Member(name, method, size, packed, header)
            at = stop + comment

    def stored_at(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member lie, and how many."""
        member = self.members.get(name)
        if member is None or member.method:
            raise ArchiveError(f"{name} is not a stored member")
        head = self.read(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ArchiveError("a damaged local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n + extra, member.size

    def index(self) -> dict[str, list[tuple[int, int]]]:
        """Offset and length of each record, by archive member, in the order of the indexes."""
        out: dict[str, list[tuple[int, int]]] = {m: [] for m, x in self.members.items() if m.startswith("archive/") and x.size}
        for name in self.members:
            if name.startswith("indexes/"):
                start, size = self.stored_at(name)
                for line in self.read(start, size).splitlines():
                    entry = json.loads(line[line.index(b"{") :])
                    member = "archive/" + entry["filename"]
                    if member not in out:
                        raise ArchiveError(f"an index names {member}, which is not there")
                    out[member].append((int(entry["offset"]), int(entry["length"])))
        for member, found in out.items():
            if not found:
                raise ArchiveError(f"no index covers {member}")
        return out

    def records(self):
        """Every record as (header fields, block), in the order of the indexes."""
        for member, index in self.index().items():
            yield from self._records(member, index)

    def _records(self, member: str, index: list[tuple[int, int]]):
        base, total = self.stored_at(member)
        i = 0
        while i < len(index):
            j, first = i, index[i][0]
            while j < len(index) and (j == i or index[j][0] + index[j][1] - first <= REQUEST_BYTES):
                j += 1
            if index[j - 1][0] + index[j - 1][1] > total:
                raise ArchiveError("the index points past the records")
            some = self.read(base + first, index[j - 1][0] + index[j - 1][1] - first)
            for at, length in index[i:j]:
                yield parse(zlib.decompress(some[at - first : at - first + length], 31))
            i = j


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("a damaged record")
    return fields, rest[:size]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def _uri(url: str | None) -> str:
    """One line, whatever the column holds."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in (url or "urn:barwright:no-url"))


def record(page_id: int | None, url: str | None, payload: bytes, name: str, refers_to: int | None = None) -> bytes:
    """A response with the payload, or a revisit of ``refers_to`` with the HTTP header alone. The
    HTTP header has the full payload's length in both."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{_name(page_id)}>", f"WARC-Target-URI: {_uri(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{name}"]
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def package(records: list[tuple[int | None, bytes]]) -> bytes:
    """A package of gzip members, each with its page id."""
    lines, at = [], 0
    for page_id, data in records:
        lines.append(f'{_ID}{_name(page_id)} {_TIME} {{"offset": "{at}", "length": "{len(data)}", "filename": "{DATA.rpartition("/")[2]}"}}\n')
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
            for _, data in records:
                member.write(data)
        z.writestr(zipfile.ZipInfo(INDEX), "".join(lines))
        z.writestr(zipfile.ZipInfo(ABOUT), json.dumps({"profile": "data-package", "records": len(records)}))
    return out.getvalue()


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def write_archives(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record for each row and lists the packages: path, n_bytes, n_records.

    Of rows with equal payloads (html in UTF-8; null: empty) of at least ``least_bytes``, that with
    the smallest page_id is a response and the others are revisits of it. Rows that repeat the
    smallest page_id are responses too; without any page_id among equal rows all are. A null page_id
    is kept, payloads of any length are whole, an empty table gives no package, and other columns are
    ignored.

    Files have names that no other attempt uses; the list, written by Spark, has those that count.
    """
    folder = folder or workspace(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # payloads of a very common digest stay where they are
    rows = joined_with_one(rows, first, ["sha1"], pages.count())
    revisits = (F.length("payload") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "payload", "sha1", F.when(revisits, F.col("first")).alias("refers_to"))

    def run(batches):
        forget()
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close():
            data = package(held)
            put_file(path := f"{folder}/{uuid.uuid4().hex}.wacz", [data])
            made = pa.RecordBatch.from_pydict({"path": [path], "n_bytes": [len(data)], "n_records": [len(held)]})
            held.clear()
            return made

        for batch in batches:
            for i in range(0, len(batch), 512):
                for page_id, url, body, sha1, to in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True):
                    data = gzip_member(record(page_id, url, body, base64.b32encode(bytes.fromhex(sha1)).decode(), to))
                    held.append((page_id, data))
                    size += len(data)
                    if size >= PACKAGE_BYTES:
                        yield close()
                        size = 0
        if held:
            yield close()

    return written(rows.mapInArrow(run, "path string, n_bytes long, n_records long"), "warc-files")


def _page(uri: str) -> int | None:
    name = uri.strip("<>").removeprefix(_ID)
    return int(name) if name else None


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """A row for each record of the listed packages: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (checked against the payload of a response), and with ``payload``
    the response's payload (null for revisits). One task for each package."""
    n = max(1, files.count())  # a row for each package

    def run(batches):
        forget()
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = filesystem(path)
                with store.open_input_file(at) as file:
                    made = []
                    held = 0
                    for fields, block in Package(lambda s, m, f=file: f.read_at(m, s), size).records():
                        http, _, body = block.partition(b"\r\n\r\n")
                        full = int(http.rpartition(b"Content-Length: ")[2])
                        named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = fields["WARC-Type"] == "response"
                        if response and (len(body) != full or digest(body) != named):
                            raise ArchiveError("a payload is not as its digest says")
                        to = _page(fields["WARC-Refers-To"]) if not response else None
                        made.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], to, full, named, body if response and payload else None))
                        held += len(body) if payload else 200
                        if held >= REQUEST_BYTES:
                            yield _batch(made, payload)
                            made, held = [], 0
                    if made:
                        yield _batch(made, payload)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if payload else "")
    return files.select("path", "n_bytes").repartition(n).mapInArrow(run, schema)


def _batch(made: list[tuple], payload: bool) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    kinds = kinds if payload else kinds[:-1]
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])
