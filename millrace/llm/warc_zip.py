"""Web archives inside ZIP packages: written per task, read by ranges without extraction.

A package holds a stored (uncompressed) member ``archive/data.warc`` and its index
``indexes/index.cdxj``, one line per record with offset and length. The reader finds the end of
the central directory, follows the ZIP64 locator where sizes or offsets need it, and lists the
members; a stored member is a range of the package, so that the index and then each record are
read at their place. Packages go to a folder that all executors share, by name of the digest of
their content; a task that runs again writes the same ones.

Of pages with equal payloads of at least ``REVISIT_BYTES`` that of the largest id is the response
and others are revisits of it, which carry the payload's length and digest, not the payload. Equal
payloads meet in an aggregate by digest with one row for each, however many pages share one.

Cases: null html is an empty payload, null urls are left out of the header; control characters and
blanks in urls are percent-encoded in it. Pages without id are always responses. Rows with the same id
and payload are both responses. An empty table gives no packages and an empty result. Extra columns
are not read. Deflated members are listed but not read by ranges; asking for one is an error.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import files_at, publish, table
from millrace.session import fresh_folder, staged

REVISIT_BYTES = 1000
PACKAGE_BYTES = 16 << 20
ARCHIVE, INDEX = "archive/data.warc", "indexes/index.cdxj"

# Fixed values of the ZIP format: signatures, and the mark of a field that stands in the ZIP64 part.
END_SIGNATURE, LOCATOR_SIGNATURE, END64_SIGNATURE = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
ENTRY_SIGNATURE, LOCAL_SIGNATURE = b"PK\x01\x02", b"PK\x03\x04"
IN_ZIP64, IN_ZIP64_SHORT, ZIP64_EXTRA = 0xFFFFFFFF, 0xFFFF, 0x0001
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


@dataclass
class Member:
    name: str
    method: int
    size: int
    header_at: int


class Package:
    """A ZIP file read by ranges; ``source`` needs ``size()`` and ``read_at(length, offset)``."""

    def __init__(self, source):
        self.source = source
        at, size, count = self._directory()
        self.members: dict[str, Member] = {}
        raw, place = source.read_at(size, at), 0
        for _ in range(count):
            if raw[place : place + 4] != ENTRY_SIGNATURE:
                raise ValueError("broken central directory")
            method, packed, full, n_name, n_extra, n_note, header_at = (
                *struct.unpack_from("<H", raw, place + 10), *struct.unpack_from("<IIHHH", raw, place + 20), *struct.unpack_from("<I", raw, place + 42)
            )
            name = raw[place + 46 : place + 46 + n_name].decode("utf-8")
            extra = raw[place + 46 + n_name : place + 46 + n_name + n_extra]
            full, packed, header_at = self._wide(extra, full, packed, header_at)
            self.members[name] = Member(name, method, packed, header_at)
            place += 46 + n_name + n_extra + n_note

    def _directory(self) -> tuple[int, int, int]:
        """Offset, size and number of entries of the central directory."""
        end = self.source.size()
        tail_at = max(0, end - 65_557)
        tail = self.source.read_at(end - tail_at, tail_at)
        found = tail.rfind(END_SIGNATURE, 0, len(tail) - 18)
        while found >= 0 and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] != len(tail):
            found = tail.rfind(END_SIGNATURE, 0, found + 3)  # the signature may stand in the comment
        if found < 0:
            raise ValueError("no end of central directory")
        count, size, at = struct.unpack_from("<HII", tail, found + 10)
        if IN_ZIP64_SHORT == count or IN_ZIP64 in (size, at):
            locator = self.source.read_at(20, tail_at + found - 20)
            if locator[:4] != LOCATOR_SIGNATURE:
                raise ValueError("no ZIP64 locator")
            end64 = self.source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if end64[:4] != END64_SIGNATURE:
                raise ValueError("no ZIP64 end of central directory")
            count, size, at = struct.unpack_from("<QQQ", end64, 32)
        return at, size, count

    @staticmethod
    def _wide(extra: bytes, *fields: int) -> list[int]:
        """Fields of an entry, those marked as wide from the ZIP64 part, in its order."""
        place, wide = 0, b""
        while place + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, place)
            if kind == ZIP64_EXTRA:
                wide = extra[place + 4 : place + 4 + length]
            place += 4 + length
        values = iter(struct.unpack(f"<{len(wide) // 8}Q", wide[: len(wide) // 8 * 8]))
        return [next(values) if f == IN_ZIP64 else f for f in fields]

    def range_of(self, name: str) -> tuple[int, int]:
        """Where a stored member lies in the package: offset and length."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed and cannot be read by ranges")
        head = self.source.read_at(30, member.header_at)
        if head[:4] != LOCAL_SIGNATURE:
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return member.header_at + 30 + n_name + n_extra, member.size

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        at, size = self.range_of(name)
        length = size - offset if length is None else length
        if offset < 0 or offset + length > size:
            raise ValueError("range outside of the member")
        return self.source.read_at(length, at + offset)


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response, or a revisit of the record of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    page_id: str | None
    url: str | None
    type: str
    payload: bytes | None
    payload_bytes: int
    digest: str
    refers_to: str | None


def parse(raw: bytes) -> Record:
    """One record; the payload of a response is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind, refers = fields["warc-type"], fields.get("warc-refers-to")
    if kind == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")

    def page(uri: str | None) -> str | None:
        return uri.removeprefix("<urn:page:").removesuffix(">") or None if uri else None

    return Record(page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, body if kind == "response" else None, length, digest, page(refers))


def package_bytes(records: list[tuple[str, bytes]]) -> bytes:
    """A package of records, each with its key for the index."""
    data, lines = io.BytesIO(), []
    for key, raw in records:
        lines.append(f"{key} {json.dumps({'offset': data.tell(), 'length': len(raw)})}\n")
        data.write(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        for name, content in ((ARCHIVE, data.getvalue()), (INDEX, "".join(lines).encode())):
            package.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), content)
    return out.getvalue()


def index_of(package: Package) -> Iterator[tuple[str, int, int]]:
    for line in package.read(INDEX).decode().splitlines():
        key, _, place = line.partition(" ")
        found = json.loads(place)
        yield key, found["offset"], found["length"]


def with_revisits(pages: DataFrame, id_column: str = "page_id", least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(id, ``url``, ``payload``, ``digest``, ``refers_to``) of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where((F.octet_length("payload") >= least_bytes) & F.col("id").isNotNull())
    first = large.groupBy("digest").agg(F.max("id").alias("last_id"), F.min("id").alias("first_id")).where("first_id < last_id")
    # Written first, so that its true size decides: a short list is sent to the pages, whose payloads then stay in
    # place; a long one is sorted and merged, and a digest of very many pages can be split among tasks.
    repeated = staged(first.select(F.unhex("digest").alias("raw"), "last_id"), "digests")
    found = rows.join(repeated, F.unhex("digest") == F.col("raw"), "left")
    return found.select("id", "url", "payload", "digest", F.when(F.col("id") < F.col("last_id"), F.col("last_id")).alias("refers_to"))


def write_packages(records: DataFrame, folder: str, limit: int = PACKAGE_BYTES) -> DataFrame:
    """Write the rows of :func:`with_revisits`; returns the packages' paths, already written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, held, size = str(TaskContext.get().taskAttemptId()), [], 0

        def flush():
            nonlocal held, size
            data = package_bytes(held)
            # Named by content: partitions may be dealt differently when a stage runs again.
            name = f"{hashlib.sha256(data).hexdigest()}.{TaskContext.get().partitionId()}.zip"
            path = publish(folder, name, attempt, lambda out: out.write(data))
            n, held, size = len(held), [], 0
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = record(page_id, url, payload, digest, refers_to)
                held.append((str(page_id), raw))
                size += len(raw)
                if size >= limit:
                    yield flush()
        if held:
            yield flush()

    return staged(records.mapInArrow(write, "path string, n_records bigint"), "packages")


def read_packages(packages: DataFrame, id_type: str = "bigint", id_column: str = "page_id") -> DataFrame:
    """(id, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``) of every record."""
    schema = "id string, payload_bytes bigint, payload_digest string, record_type string, refers string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = files_at(path)
                with fs.open_input_file(inner) as source:
                    package = Package(source)
                    rows = []
                    for _, offset, length in index_of(package):
                        r = parse(package.read(ARCHIVE, offset, length))
                        rows.append((r.page_id, r.payload_bytes, r.digest, r.type, r.refers_to))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["id", "payload_bytes", "payload_digest", "record_type", "refers"],
                )

    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = packages.select("path").repartition(tasks, "path").mapInArrow(read, schema)
    return found.select(
        F.col("id").cast(id_type).alias(id_column), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to")
    )


def op10_warc_zip(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_packages(write_packages(with_revisits(pages), fresh_folder(spark, "packages")))


SQL = {
    "op10_warc_zip": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS last FROM p WHERE octet_length(b) >= {REVISIT_BYTES} GROUP BY d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d"""
}
