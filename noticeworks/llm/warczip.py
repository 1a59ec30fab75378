"""WARC records in ZIP packages: written by Spark, read back by their directories.

A package holds three stored members: the records (``archive/data.warc.gz``, a gzip member for each record), an index
(``indexes/index.cdx``, a line of CDXJ for each record with its range) and a description. A reader takes paths and
lengths alone from Spark. One task a package reads the end record, the ZIP64 end record if there is one, the central
directory and the index by their ranges; the ranges of records are then dealt over all tasks, which read each by
seeking. No package is read whole, and nothing is extracted.

Ranges are read by ``pyarrow.fs``, which knows local, HDFS, S3, GCS and Azure paths; ``opener`` puts another in its place.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
#: Bytes of records after which a package is closed.
PACKAGE_BYTES = 4 << 20
#: Bytes of neighbouring records that are read at once.
RANGE_BYTES = 1 << 20
#: Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_MANY, _LARGE = 0xFFFF, 0xFFFFFFFF

Read = Callable[[int, int], bytes]


class BadArchive(ValueError):
    """Not a package that this reader can use."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header_at: int


def _zip64(extra: bytes, wanted: list[int]) -> list[int]:
    """Replace the values that the 32-bit fields could not hold, in the order of the format."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(values, w) if w == _LARGE else w for w in wanted]
        at += 4 + n
    return wanted


def directory(read: Read, size: int) -> list[Member]:
    """The members that the central directory lists. ``read(at, n)`` gives n bytes of the package."""
    tail_at = max(0, size - 22 - _MANY)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    # The comment may hold the signature: the true record's comment ends with the file.
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise BadArchive("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if _MANY == count or _LARGE in (length, start):
        locator = read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
        if locator[:4] != LOCATOR64:
            raise BadArchive("no ZIP64 locator")
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise BadArchive("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    central, at, members = read(start, length), 0, []
    for _ in range(count):
        if central[at : at + 4] != CENTRAL:
            raise BadArchive("broken central directory")
        flags, method = struct.unpack_from("<HH", central, at + 8)
        stored, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", central, at + 20)
        name = central[at + 46 : at + 46 + n_name]
        full, stored, header = _zip64(central[at + 46 + n_name : at + 46 + n_name + n_extra], [full, stored, struct.unpack_from("<I", central, at + 42)[0]])
        members.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, full, stored, header))
        at += 46 + n_name + n_extra + n_note
    return members


def member_start(read: Read, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise BadArchive(f"{member.name} is compressed")
    head = read(member.header_at, 30)
    if head[:4] != LOCAL:
        raise BadArchive("broken local header")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))


def package(members: list[tuple[str, bytes]], *, zip64: bool = False, comment: bytes = b"") -> bytes:
    """A ZIP package of stored members. ``zip64`` writes the 64-bit records even where they are not needed."""
    out, central = io.BytesIO(), []
    for name, body in members:
        at, crc, raw = out.tell(), zlib.crc32(body), name.encode()
        large = zip64 or len(body) >= _LARGE or at >= _LARGE
        extra = struct.pack("<HHQQ", 1, 16, len(body), len(body)) if large else b""
        sizes = (_LARGE, _LARGE) if large else (len(body), len(body))
        common = struct.pack("<HHHHHIIIHH", 45 if large else 20, 0x800, 0, 0, 0x21, crc, *sizes, len(raw), len(extra))
        out.write(LOCAL + common + raw + extra + body)
        far = struct.pack("<HHQQQ", 1, 24, len(body), len(body), at) if large else b""
        common = struct.pack("<HHHHHIIIHH", 45 if large else 20, 0x800, 0, 0, 0x21, crc, *sizes, len(raw), len(far))
        central.append(CENTRAL + struct.pack("<H", 45) + common + struct.pack("<HHHII", 0, 0, 0, 0, _LARGE if large else at) + raw + far)
    start, block, n = out.tell(), b"".join(central), len(central)
    out.write(block)
    if zip64 or n >= _MANY or start >= _LARGE or len(block) >= _LARGE:
        at = out.tell()
        out.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(block), start) + LOCATOR64 + struct.pack("<IQI", 0, at, 1))
        n, block_size, start = _MANY, _LARGE, _LARGE
    else:
        block_size = len(block)
    out.write(END + struct.pack("<HHHHIIH", 0, 0, n, n, block_size, start, len(comment)) + comment)
    return out.getvalue()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(kind: str, uri: str, page: str, payload: bytes, *, length: int, digest: str, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record of an HTTP message; a revisit has the message's head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload of the HTTP message) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise BadArchive("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _one_line(text: str | None) -> str:
    return (text or "").translate({13: "%0D", 10: "%0A"})


def write_packages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> None:
    """Write a WARC record for each row into ZIP packages under ``path``, a file each.

    Of rows with equal payloads of ``least_bytes`` or more, those with the greatest id are responses and the others
    revisit that id; shorter payloads are all responses. Null html is an empty payload. Null ids are never referred to:
    if a payload has no other, they are all responses. Only digests and ids are shuffled for this; the payloads
    themselves move once, to meet their ids' verdicts.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), body.alias("body"))
    # The row's own key: its id and what it holds. Rows equal in both need the same verdict.
    digests = rows.select("id", F.sha1("body").alias("sha"), F.length("body").alias("n"))
    last = digests.filter(F.col("n") >= least_bytes).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("rows")).filter("rows > 1 and last is not null").drop("rows")
    older = digests.join(last, "sha").filter(~F.col("id").eqNullSafe(F.col("last"))).select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), "last").distinct()
    keyed = rows.withColumn("sha", F.sha1("body"))
    judged = keyed.join(older, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")) & (F.length("body") >= least_bytes), "left")
    # A revisit's payload stays behind.
    slim = judged.select("id", F.when(F.col("id").isNotNull(), F.col("id").cast("string")).alias("page"), "url", F.when(F.col("last").isNull(), F.col("body")).alias("body"), F.length("body").alias("n"), "sha", F.col("last").cast("string").alias("refers_to")).drop("id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, lines = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            whole = package([(DATA, data.getvalue()), (INDEX, "".join(lines).encode()), (ABOUT, b'{"profile": "data-package"}')], comment=b"\n")
            data.seek(0)
            data.truncate()
            lines.clear()
            # The text sink ends a row with a line break: it is the package's comment.
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], ["value"])

        for batch in batches:
            for row in batch.to_pylist():
                kind = "revisit" if row["refers_to"] is not None else "response"
                digest = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                page = "" if row["page"] is None else row["page"]
                raw = warc_record(kind, _one_line(row["url"]), page, row["body"] or b"", length=row["n"], digest=digest, refers_to=row["refers_to"])
                packed, at = zlib.compressobj(6, zlib.DEFLATED, 31), data.tell()
                data.write(packed.compress(raw) + packed.flush())
                about = {"url": _one_line(row["url"]), "mime": "text/html" if kind == "response" else "warc/revisit", "status": "200", "digest": f"sha1:{digest}", "offset": str(at), "length": str(data.tell() - at), "filename": DATA.partition("/")[2]}
                lines.append(f"{page or '-'} 19700101000000 {json.dumps(about)}\n")
                if data.tell() >= package_bytes:
                    yield close()
        if lines:
            yield close()

    packages = slim.mapInArrow(build, "value binary")
    packages.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def arrow_uri(path: str) -> str:
    """A path as Spark lists it, as ``pyarrow.fs`` names it: Hadoop's names of S3 are one scheme there."""
    if "://" not in path:
        return path.replace("file:", "file://", 1)
    scheme, rest = path.split("://", 1)
    return f"{'s3' if scheme.lower() in ('s3a', 's3n') else scheme}://{rest}"


def open_path(path: str) -> tuple[Read, Callable[[], None]]:
    """(a reader of ranges, what closes it) of a file that ``pyarrow.fs`` can reach."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(arrow_uri(path))
    file = where.open_input_file(inner)
    return lambda at, n: file.read_at(n, at), file.close


def record_ranges(read: Read, size: int) -> list[list[tuple[int, int]]]:
    """The places and lengths of a package's records, in runs of neighbours of about RANGE_BYTES."""
    members = {m.name: m for m in directory(read, size)}
    if INDEX not in members:
        raise BadArchive("no index")
    starts: dict[str, int] = {}
    found = []
    for line in read(member_start(read, members[INDEX]), members[INDEX].size).decode().splitlines():
        if "{" not in line or line.startswith("!"):
            continue
        about = json.loads(line[line.index("{") :])
        name = f"archive/{about['filename']}"
        if name not in members:
            raise BadArchive(f"no records {name}")
        at, n = int(about["offset"]), int(about["length"])
        if at < 0 or n < 1 or at + n > members[name].size:
            raise BadArchive("range beyond the records")
        if name not in starts:
            starts[name] = member_start(read, members[name])
        found.append((starts[name] + at, n))
    out: list[list[tuple[int, int]]] = []
    for at, n in sorted(found):
        if out and at == sum(out[-1][-1]) and at + n - out[-1][0][0] <= RANGE_BYTES:
            out[-1].append((at, n))
        else:
            out.append([(at, n)])
    return out


def read_packages(spark: SparkSession, path: str, *, id_type: str = "long", opener: Callable[[str], tuple[Read, Callable[[], None]]] = open_path) -> DataFrame:
    """A row for each record of the packages under ``path``: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload (null for revisits). A response whose payload belies its digest or length fails the job."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                read, close = opener(name)
                found = record_ranges(read, size)
                close()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array([[x[0] for x in r] for r in found], pa.list_(pa.int64())), pa.array([[x[1] for x in r] for r in found], pa.list_(pa.int64()))], ["path", "at", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read, close = None, None, None
        for batch in batches:
            for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "n")), strict=True):
                if name != held:
                    if close:
                        close()
                    held, (read, close) = name, opener(name)
                whole, rows = read(at[0], at[-1] + n[-1] - at[0]), []
                for a, k in zip(at, n, strict=True):
                    headers, payload = parse_record(zlib.decompress(whole[a - at[0] : a - at[0] + k], 31))
                    kind, page = headers["WARC-Type"], headers["WARC-Record-ID"][len("<urn:page:") : -1]
                    size, digest = int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                        raise BadArchive(f"page {page}: the payload differs from its digest")
                    to = headers.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                    rows.append((page or None, headers["WARC-Target-URI"], size, digest, kind, to or None, payload if kind == "response" else None))
                columns = list(zip(*rows, strict=True))
                types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if close:
            close()

    found = files.mapInArrow(ranges, "path string, at array<long>, n array<long>")
    dealt = found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = dealt.mapInArrow(scan, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
