"""Operator 4: WARC records in ZIP-packaged archives (stored members with an index), written and range-read.

Writing: every record is a gzip member of its own in `archive/data.warc.gz`, a stored (uncompressed) member of a ZIP
package, beside `indexes/index.cdxj`, whose lines (key, time, JSON) name file, offset and length of each record. Sizes
are not limited: archive members use ZIP64 records. Payloads are compared by digest; of equal payloads of at least
REVISIT_BYTES the one of the largest id is the response and the others are revisit records that refer to it.

Reading: the end record, the ZIP64 end record and the central directory are parsed from the package's tail; the
members' data are located by their local headers; all indexes are read (plain or gzipped CDXJ, or bare JSON lines), and
then each record by its byte range in the archive member that its line names. Archive members that no line names are
walked record by record, so nothing is passed over. Nothing is extracted, and executors share the ranges, however
large a package is. Of a package's index a task holds an offset and a length for each record.

Packages live in the cluster's shared folder and are reached by pyarrow's file systems, so any executor can read
them. A package's name is unique to the task attempt, and only those that finished are listed in the manifest, so
repeated or lost tasks do no harm.

Defined results: null and empty pages are responses with an empty payload; a null or clashing id: rows that share an
id are records of their own under one record id (of equal payloads all rows of the largest id are responses); a null id is read back as null; a null url has an
empty target; an empty table writes no package; further columns are ignored. Records of packages from elsewhere have
null in the fields that they lack, and other types than response have no payload. A package that isn't a whole ZIP, an
archive member that isn't stored, or a line that names a missing member is a ValueError: nothing is dropped in silence.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.llm.common import slices, small, written

REVISIT_BYTES = 1000
#: Index lines, and bytes of records, that a range holds about.
RANGE_RECORDS, RANGE_BYTES = 256, 8 << 20
#: Records after which a task begins another package.
PACKAGE_RECORDS = 20_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format.
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
STORED = 0
GZIP = b"\x1f\x8b"


def store(path: str):  # noqa: ANN201
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# writing


def record(kind: str, page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record as a gzip member."""
    http = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": "".join(url.split("\r")).replace("\n", ""), "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Page-Id": "" if page_id is None else page_id, "X-Payload-Length": size,
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", "X-Refers-To-Page-Id": refers_to}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(http)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + http + b"\r\n\r\n", 6, mtime=0)


def sort_key(url: str) -> str:
    """The host's labels from the last on, and the path, without a space; "-" for what isn't a URL."""
    host, _, path = url.partition("://")[2].partition("/")
    key = ",".join(reversed(host.lower().split("."))) + ")/" + path if host else "-"
    return "".join("%20" if c.isspace() else c for c in key)


@dataclass
class Package:
    """A ZIP package being written: records go straight to the stored data member."""

    folder: str

    def __post_init__(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.wacz"
        files, inner = store(self.path)
        files.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: int | None, url: str, data: bytes) -> None:
        self.data.write(data)
        self.lines.append(f"{sort_key(url)} 20240101000000 " + json.dumps({"url": url, "filename": DATA.rpartition("/")[2], "offset": str(self.at), "length": str(len(data))}, ensure_ascii=True))
        self.at += len(data)

    def close(self) -> tuple[str, int]:
        self.data.close()
        index = "".join(f"{x}\n" for x in sorted(self.lines)).encode()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write(index)
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA, "bytes": self.at}, {"path": INDEX, "bytes": len(index)}]}))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, package_records: int = PACKAGE_RECORDS) -> DataFrame:
    """Writes the packages of (page_id, url, html); returns the manifest (path, records), itself written."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    equal = rows.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    equal = small(written(equal.select(F.col("digest").alias("equal"), "response"), "equal"))
    # small payloads meet nothing, and each has a key of its own: a common one (an empty page) is no hot key
    own = F.when(F.col("size") >= revisit_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest").cast("string")))
    rows = rows.withColumn("own", own).join(equal, F.col("own") == F.col("equal"), "left").drop("own", "equal")
    old = F.col("response").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("response")))
    rows = rows.withColumn("kind", F.when(old, "revisit").otherwise("response")).withColumn("refers_to", F.when(old, F.col("response")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for b in slices(batches):
            for r in b.to_pylist():
                package = package or Package(folder)
                package.add(r["page_id"], r["url"], record(r["kind"], r["page_id"], r["url"], r["payload"] or b"", r["size"], r["digest"], r["refers_to"]))
                if len(package.lines) >= package_records:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pydict({"path": pa.array([x for x, _ in done], pa.string()), "records": pa.array([n for _, n in done], pa.int64())})

    need = rows.select("page_id", "url", F.when(F.col("kind") == "response", F.col("payload")).alias("payload"), "size", "digest", "kind", "refers_to")
    return written(need.mapInArrow(write, "path string, records long"), "manifest")


# reading


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def directory(read, size: int) -> list[Member]:  # noqa: ANN001
    """The members of a ZIP package of that many bytes; read(offset, length) gives a range of it."""
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
    if locator[:4] == LOCATOR:
        (at64,) = struct.unpack_from("<Q", locator, 8)
        end = read(at64, 56)
        if end[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    entries, at, out = read(start, length), 0, []
    for _ in range(count):
        if entries[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_comment, header = (struct.unpack_from(f, entries, at + x)[0] for f, x in (("<H", 10), ("<I", 20), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
        name = entries[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra, k = entries[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # in this order, each only where the field above is all ones
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            k += 4 + n
        out.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(read, member: Member) -> int:  # noqa: ANN001
    """Where a stored member's bytes begin: after its local header, whose name and extra field have their own lengths."""
    head = read(member.header, 30)
    if head[:4] != LOCAL or member.method != STORED:
        raise ValueError(f"{member.name} isn't a stored member")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def opened(path: str):  # noqa: ANN201
    files, inner = store(path)
    f = files.open_input_file(inner)
    return f, lambda at, n: f.read_at(n, at)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and block of a WARC record, gzipped or not."""
    raw = zlib.decompress(data, 31) if data[:2] == GZIP else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def chunks(read, at: int, end: int, size: int = 1 << 20) -> Iterator[bytes]:  # noqa: ANN001
    for x in range(at, end, size):
        yield read(x, min(size, end - x))


def index_lines(read, at: int, end: int) -> Iterator[bytes]:  # noqa: ANN001
    """The lines of an index, which may be gzipped in any number of gzip members."""
    rest, unzip, zipped = b"", None, None
    for chunk in chunks(read, at, end):
        zipped = chunk[:2] == GZIP if zipped is None else zipped
        out = chunk
        if zipped:
            out = b""
            while chunk:
                unzip = unzip if unzip and not unzip.eof else zlib.decompressobj(31)
                out += unzip.decompress(chunk)
                chunk = unzip.unused_data
        *lines, rest = (rest + out).split(b"\n")
        yield from lines
    yield rest


def walked(read, at: int, end: int) -> list[tuple[int, int]]:  # noqa: ANN001
    """(offset, length) of the gzip members from a place on, by unzipping them in turn."""
    found, start, unzip, seen = [], at, zlib.decompressobj(31), at
    for chunk in chunks(read, at, end):
        seen += len(chunk)
        while chunk:
            unzip.decompress(chunk)
            chunk = unzip.unused_data
            if unzip.eof:
                found.append((start, seen - len(chunk) - start))
                start, unzip = seen - len(chunk), zlib.decompressobj(31)
    if start != end:
        raise ValueError("an archive member ends inside a record")
    return found


def records(read, size: int) -> list[tuple[int, int]]:  # noqa: ANN001
    """(offset in the package, length) of every record of all archive members, in order."""
    members = directory(read, size)
    data = {m.name: (data_start(read, m), m.size) for m in members if m.name.startswith("archive/") and not m.name.endswith("/")}
    by_file = {k.rpartition("/")[2]: k for k in data} | {k: k for k in data}
    spans: dict[str, set[tuple[int, int]]] = {k: set() for k in data}
    for m in members:
        if m.name.startswith("indexes/") and m.name.rpartition(".")[2] in ("cdxj", "cdx", "gz", "json"):
            at = data_start(read, m)
            for line in index_lines(read, at, at + m.size):
                if (brace := line.find(b"{")) < 0 or line.startswith(b"!"):  # an empty line, or a heading
                    continue
                x = json.loads(line[brace:])
                if "offset" in x:
                    name = x.get("filename", next(iter(data)) if len(data) == 1 else None)
                    if name not in by_file:
                        raise ValueError(f"the index names no archive member: {name}")
                    spans[by_file[name]].add((data[by_file[name]][0] + int(x["offset"]), int(x["length"])))
    return sorted(span for k, (at, n) in data.items() for span in (spans[k] or (walked(read, at, at + n) if n else ())))


def ranges(paths: DataFrame) -> DataFrame:
    """(path, start, ends): byte ranges of neighbouring records, located by directory and indexes of each package."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for path in b["path"].to_pylist():
                f, read = opened(path)
                with f:
                    spans = records(read, f.size())
                out: list[tuple[int, list[int]]] = []
                for x, n in spans:
                    if not out or len(out[-1][1]) >= RANGE_RECORDS or x + n - out[-1][0] > RANGE_BYTES or x != out[-1][1][-1]:
                        out.append((x, []))
                    out[-1][1].append(x + n)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(out), pa.string()), "start": pa.array([s for s, _ in out], pa.int64()), "ends": pa.array([e for _, e in out], pa.list_(pa.int64()))})

    return paths.select("path").mapInArrow(locate, "path string, start long, ends array<long>")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, digest_ok, html."""
    spark = manifest.sparkSession
    names = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, payload binary"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for r in b.to_pylist():
                f, read = opened(r["path"])
                with f:
                    data = read(r["start"], r["ends"][-1] - r["start"])
                out, at = [], 0
                for end in (e - r["start"] for e in r["ends"]):
                    h, block = parse_record(data[at:end])
                    at, kind = end, h["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    name, _, given = h.get("warc-payload-digest", "").partition(":")
                    digest = base64.b32decode(given).hex() if name.lower() == "sha1" and len(given) == 32 else None
                    own = None if payload is None else hashlib.sha1(payload).hexdigest()
                    number = lambda x: int(x) if x else None
                    size = number(h.get("x-payload-length")) if payload is None else len(payload)
                    out.append((number(h.get("x-page-id")), h.get("warc-target-uri"), size, own or digest, kind, number(h.get("x-refers-to-page-id")), None in (own, digest) or own == digest, payload))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in names.split(", ")])

    located = written(ranges(manifest), "ranges")
    parts = max(1, spark.sparkContext.defaultParallelism, located.count() // 8)
    return located.repartition(parts).mapInArrow(fetch, names)
