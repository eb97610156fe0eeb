"""Web archives in ZIP packages: written by tasks, read by ranges through the package's own directories.

A package holds ``archive/data.warc.gz`` (each record a gzip member of its own) and ``indexes/index.cdxj``
(one line a record: where it lies), both stored, not deflated, so that a place in a member is a place in
the package.  The end of the package, with its ZIP64 records, tells where the central directory lies, the
directory where the members lie, and the index where the records lie: the reader fetches those ranges and
then runs of neighbouring records.  Nothing is extracted.

Ranges are rows, dealt out over all tasks, whatever the number and size of the packages.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Payloads of this many bytes or more are looked up among equal ones.
LEAST = 1000
#: Bytes of records after which a task begins another package, and that one range of records holds (or one record).
PACKAGE, RANGE = 256 << 20, 4 << 20
#: Tasks that packages or ranges are dealt out to at most; more of them go to each task then.
MOST_TASKS = 100_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

#: Signatures of ZIP records, and the profile of a record that repeats another's payload.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ALL16, _ALL32 = 0xFFFF, 0xFFFFFFFF


def _filesystem(path: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


# Packages: ZIP files of stored members


class PackageWriter:
    """Stored members one after another on a stream that cannot seek; all sizes and places in ZIP64 form."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc = name.encode(), self.at, 0
        # Sizes follow the data (bit 3); the ZIP64 field makes them eight bytes each.
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 0x21, 0, _ALL32, _ALL32, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))
        self.first = self.at

    def write(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)

    def end(self) -> None:
        size = self.at - self.first
        self._put(b"PK\7\10" + struct.pack("<IQQ", self.crc, size, size))
        self.members.append((self.name, self.crc, size, self.start))

    def close(self) -> None:
        begin = self.at
        for name, crc, size, start in self.members:
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, crc, _ALL32, _ALL32, len(name), 28, 0, 0, 0, 0, _ALL32) + name + struct.pack("<HHQQQ", 1, 24, size, size, start))
        size, n, end64 = self.at - begin, len(self.members), self.at
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin))
        self._put(LOCATOR + struct.pack("<IQI", 0, end64, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, _ALL16, _ALL16, _ALL32, _ALL32, 0))


@dataclass(frozen=True)
class Member:
    """A member's name, how it is kept (0: stored), its size there and where its data starts in the package."""

    name: str
    method: int
    size: int
    start: int


class Ranges:
    """A random-access file of known size."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("a range lies outside of the package")
        return self.file.read_at(n, at)


def _directory(f: Ranges) -> tuple[int, int, int]:
    """Place, size and number of entries of the central directory, from the end records."""
    tail_at = max(0, f.size - (22 + _ALL16))
    tail = f.read(tail_at, f.size - tail_at)
    at = len(tail)
    while (at := tail.rfind(END, 0, at)) >= 0:
        if len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    if at < 0:
        raise ValueError("no end record: this is no whole ZIP package")
    n, size, start = struct.unpack_from("<HII", tail, at + 10)
    here = tail_at + at
    if here >= 20 and (loc := f.read(here - 20, 20))[:4] == LOCATOR:
        end64 = f.read(struct.unpack_from("<Q", loc, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("the ZIP64 locator leads to no ZIP64 end record")
        n64, size64, start64 = struct.unpack_from("<QQQ", end64, 32)
        n, size, start = n64 if n == _ALL16 else n, size64 if size == _ALL32 else size, start64 if start == _ALL32 else start
    return start, size, n


def _wide(extra: bytes, fields: list[int]) -> list[int]:
    """Fields of 32 bits with those that are all ones taken, in order, from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            more = iter(struct.unpack_from(f"<{min(n // 8, 3)}Q", extra, at + 4))
            return [next(more) if x == _ALL32 else x for x in fields]
        at += 4 + n
    return fields


def members(f: Ranges, block: int = 1 << 20) -> Iterator[Member]:
    """All members, by the central directory, which is fetched in blocks."""
    start, size, n = _directory(f)
    held, here, at, stop = b"", 0, start, start + size
    for _ in range(n):
        while True:
            if len(held) - here >= 46:
                if held[here : here + 4] != CENTRAL:
                    raise ValueError("the central directory is broken")
                names, extras, comments = struct.unpack_from("<HHH", held, here + 28)
                if len(held) - here >= (whole := 46 + names + extras + comments):
                    break
            if at >= stop:
                raise ValueError("the central directory ends early")
            more = f.read(at, min(block, stop - at))
            held, here, at = held[here:] + more, 0, at + len(more)
        entry, here = held[here : here + whole], here + whole
        method = struct.unpack_from("<H", entry, 10)[0]
        packed, plain, local = struct.unpack_from("<II", entry, 20) + struct.unpack_from("<I", entry, 42)
        plain, packed, local = _wide(entry[46 + names : 46 + names + extras], [plain, packed, local])
        name = entry[46 : 46 + names].decode("utf-8", "replace")
        head = f.read(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name}: no local header where the directory says")
        yield Member(name, method, packed, local + 30 + sum(struct.unpack_from("<HH", head, 26)))


# Records


def record(page: str, url: str, payload: bytes | None, n_bytes: int, sha1: str, refers_to: str | None) -> bytes:
    """A response, or, with ``refers_to``, a revisit: its block is the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{page}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: {digest}", *([f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record's fields, the HTTP head's and the payload (None for a revisit); broken ones raise."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    web = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    revisit = fields["warc-type"] == "revisit"
    sha1 = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if not revisit and hashlib.sha1(payload).hexdigest() != sha1:
        raise ValueError(f"record {fields.get('warc-record-id')}: the payload's digest is another one")
    return {"type": fields["warc-type"], "id": fields["warc-record-id"].strip("<>"), "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
            "payload": None if revisit else payload, "n_bytes": int(web["content-length"]) if revisit else len(payload), "sha1": sha1}


def _urn(page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def _page(urn: str | None) -> int | None:
    return int(x) if urn and (x := urn.rpartition(":")[2]) else None


def _uri(url: str | None) -> str:
    """A target without what would break a header line."""
    return re.sub(r"[\x00-\x20\x7f]+", "%20", url or "")


# Spark jobs


def with_references(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, n_bytes, sha1, refers_to, payload``: payload is null where ``refers_to`` names the page that has it.

    Only digests and ids are summed, and only digests that occur twice meet the pages again.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("payload"))
    p = p.withColumn("n_bytes", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    same = p.where(F.col("n_bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("lead"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("same"), "lead")
    # Stored, so that its size is known to the planner and AQE can split the rows of a hot digest.
    joined = p.join(stored(same, "same-payloads"), F.col("sha1") == F.col("same"), "left")
    refers = F.when(F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead")), F.col("lead"))
    return joined.select("page_id", "url", "n_bytes", "sha1", refers.alias("refers_to"), F.when(refers.isNull(), F.col("payload")).alias("payload"))


def write_packages(pages: DataFrame, path: str, least: int = LEAST, package: int = PACKAGE) -> DataFrame:
    """Write every page as a record to packages below ``path``; ``path, n_records, n_bytes`` of each package, as a table.

    A task writes packages of its own, under names of their own; only those that a task that succeeded has
    told of are in the table, so a lost executor leaves files that nobody reads, and no record twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(path)
        fs.create_dir(folder)
        out, name, index, at = None, None, [], 0

        def finish() -> pa.RecordBatch:
            w.end()
            w.begin(INDEX)
            for line in sorted(index):
                w.write(line)
            w.end()
            w.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([w.at], pa.int64())], names=["path", "n_records", "n_bytes"])

        for b in batches:
            for page, url, n, sha1, refers, payload in zip(*b.columns, strict=True):
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.wacz"
                    out, index, at = fs.open_output_stream(f"{folder}/{name.rpartition('/')[2]}"), [], 0
                    w = PackageWriter(out)
                    w.begin(DATA)
                own, target, lead = _urn(page.as_py()), _uri(url.as_py()), refers.as_py()
                raw = record(own, target, payload.as_py(), n.as_py(), sha1.as_py(), None if lead is None else _urn(lead))
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = z.compress(raw) + z.flush()
                w.write(data)
                told = {"url": target, "mime": "text/html" if lead is None else "warc/revisit", "digest": f"sha1:{sha1.as_py()}", "length": str(len(data)), "offset": str(at), "filename": DATA.rpartition("/")[2]}
                index.append(f"{target} 19700101000000 {json.dumps(told)}\n".encode())
                at += len(data)
                if at >= package:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    return stored(pages.mapInArrow(run, "path string, n_records long, n_bytes long"), "packages")


def locate(packages: DataFrame, most: int = RANGE) -> DataFrame:
    """``path, offset, lengths``: runs of neighbouring records, by each package's directory and index.

    Archive or index members that are not stored raise: no range of theirs can be read alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, where = _filesystem(path)
                with fs.open_input_file(where) as file:
                    f = Ranges(file, file.size())
                    found = {m.name: m for m in members(f)}
                    archives = {n.rpartition("/")[2]: m for n, m in found.items() if n.startswith("archive/")}
                    for m in (m for n, m in found.items() if n.startswith(("archive/", "indexes/")) and m.method != 0):
                        raise ValueError(f"{path}: {m.name} is deflated, its records cannot be read by range")
                    places: dict[str, list[tuple[int, int]]] = {n: [] for n in archives}
                    for m in (m for n, m in found.items() if n.startswith("indexes/") and n.endswith((".cdxj", ".cdxj.gz"))):
                        for line in _lines(f, m):
                            told = json.loads(line[line.index(b"{") :])
                            places[told["filename"]].append((int(told["offset"]), int(told["length"])))
                    for n, spans in places.items():
                        yield from _runs(path, archives[n], sorted(spans), most)

    return packages.select("path").mapInArrow(run, "path string, offset long, lengths array<long>")


def _lines(f: Ranges, m: Member, block: int = 1 << 20) -> Iterator[bytes]:
    """Lines of an index member, fetched in blocks; a gzipped one (stored like the others) is inflated on the way."""
    z, held = zlib.decompressobj(31) if m.name.endswith(".gz") else None, b""
    for at in range(0, m.size, block):
        data = f.read(m.start + at, min(block, m.size - at))
        *whole, held = (held + (z.decompress(data) if z else data)).split(b"\n")
        yield from (x for x in whole if x.strip())
    if held.strip():
        yield held


def _runs(path: str, m: Member, spans: list[tuple[int, int]], most: int) -> Iterator[pa.RecordBatch]:
    starts, lengths, end, size = [], [], -1, 0
    for at, n in spans:
        if at + n > m.size:
            raise ValueError(f"{path}: the index leads out of {m.name}")
        if at != end or size + n > most:
            starts.append(m.start + at)
            lengths.append([])
            size = 0
        lengths[-1].append(n)
        end, size = at + n, size + n
    if starts:
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["path", "offset", "lengths"])


def read_records(ranges: DataFrame, tasks: int | None = None) -> DataFrame:
    """``record_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``: every record of the ranges, each fetched in one read.

    Ranges are small rows that stand for many bytes, so they are dealt out to a number of tasks that is given: by default, one for each core.

    A response's length and digest are those of the payload that was read; a revisit has no payload here, and tells both.
    """
    kinds = [("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    keys = ["id", "url", "type", "refers_to", "n_bytes", "sha1", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, offset, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, where = _filesystem(path)
                with fs.open_input_file(where) as file:
                    data = Ranges(file, file.size()).read(offset, sum(lengths))
                out, at = [], 0
                for n in lengths:
                    out.append(parsed(zlib.decompress(data[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in zip(keys, kinds, strict=True)], names=[n for n, _ in kinds])

    spread = ranges.repartition(tasks or ranges.sparkSession.sparkContext.defaultParallelism, F.xxhash64("path", "offset"))
    return spread.mapInArrow(run, "record_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def archive(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Packages of all pages below ``path`` (a new folder of the shared one, by default), as ``write_packages`` tells them."""
    where = path or f"{shared_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    return write_packages(with_references(pages, least), where, least)


def roundtrip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Every page written as a record and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null html is an empty payload; the page_id of a null id stays null (it is the least of ids, and no page refers to
    it).  Of equal payloads of ``least`` bytes or more the largest page_id is the response; rows that repeat that id,
    too, are all responses, as are those of which every id is null.  Very long payloads are records like others, a
    range of their own.  Other columns are not read, whatever their names; an empty table gives no rows.
    """
    packages = archive(pages, least=least)
    n, size = packages.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    cores = pages.sparkSession.sparkContext.defaultParallelism
    got = read_records(locate(packages.repartition(max(1, min(n, MOST_TASKS)), "path")), max(cores, min(-(-size // (16 * RANGE)), MOST_TASKS)))
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return got.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


def oracle_sql(least: int = LEAST) -> str:
    """DuckDB: lengths, digests, and the largest id of each payload."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS lead FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= {least} AND page_id IS DISTINCT FROM lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {least} AND page_id IS DISTINCT FROM lead THEN lead END AS refers_to
FROM w"""
