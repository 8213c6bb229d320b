"""WARC records in ZIP archives: writing, and reading by ranges without extraction."""

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
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, stored
from .shared import filesystem, looked_up, partitions_of

#: An archive is closed once it holds so many bytes of records, a member of it likewise.
ARCHIVE_BYTES, MEMBER_BYTES = 128 << 20, 32 << 20
#: Records whose ranges lie in one such stretch are read at once.
READ_BYTES = 4 << 20
#: Index lines of one reading task.
SPLIT_LINES = 20_000
# Fixed values of the ZIP format: signatures and records.
_LOCAL, _CENTRAL, _END = 0x04034B50, 0x02014B50, 0x06054B50
_END64, _LOCATOR64, _DESCRIPTOR, _BIG = 0x06064B50, 0x07064B50, 0x08074B50, 0xFFFFFFFF
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP -------------------------------------------------------------------------------------------------------


class StoredZip:
    """Writes stored members to a stream that can't seek, with 64-bit sizes throughout."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append([name.encode(), self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        # Sizes and sum follow the data (flag 3).
        self._put(struct.pack("<IHHHHHIIIHH", _LOCAL, 45, 8, 0, 0, 0x21, 0, _BIG, _BIG, len(self.members[-1][0]), len(extra)))
        self._put(self.members[-1][0] + extra)

    def write(self, data: bytes) -> None:
        m = self.members[-1]
        m[2], m[3] = zlib.crc32(data, m[2]), m[3] + len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<IIQQ", _DESCRIPTOR, crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, offset, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            head = struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 8, 0, 0, 0x21, crc, _BIG, _BIG, len(name), len(extra), 0, 0, 0, 0, _BIG)
            self._put(head + name + extra)
        size, end, n = self.at - start, self.at, len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", _LOCATOR64, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, 0xFFFF, 0xFFFF, _BIG, _BIG, 0))
        self.out.close()


@dataclass(frozen=True)
class Member:
    name: str
    header: int
    size: int
    packed: int
    method: int


class ZipFile:
    """Members of a ZIP archive by its central directory; stored ones are read by ranges."""

    def __init__(self, file):
        self.file, self.length = file, file.size()
        tail_at = max(0, self.length - 22 - 0xFFFF)
        tail = self._read(tail_at, self.length - tail_at)
        end = tail.rfind(struct.pack("<I", _END))
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(struct.pack("<I", _END), 0, end)
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP archive, or cut off")
        _, _, _, _, n, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, end)
        if 0xFFFF == n or _BIG in (size, start):
            sign, _, at, _ = struct.unpack("<IIQI", self._read(tail_at + end - 20, 20))
            if sign != _LOCATOR64:
                raise ValueError("no ZIP64 locator")
            sign, _, _, _, _, _, _, n, size, start = struct.unpack("<IQHHIIQQQQ", self._read(at, 56))
            if sign != _END64:
                raise ValueError("no ZIP64 end of central directory")
        self.members = list(self._directory(self._read(start, size), n))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError(f"the archive ends within a range of {size} bytes at {at}")
        return data

    @staticmethod
    def _directory(data: bytes, n: int) -> Iterator[Member]:
        at = 0
        for _ in range(n):
            sign, _, _, _, method, _, _, _, packed, size, n_name, n_extra, n_note, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if sign != _CENTRAL:
                raise ValueError("broken central directory")
            name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
            extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, e)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                    size = next(wide) if size == _BIG else size
                    packed = next(wide) if packed == _BIG else packed
                    header = next(wide) if header == _BIG else header
                e += 4 + length
            yield Member(name, header, size, packed, method)
            at += 46 + n_name + n_extra + n_note

    def start(self, m: Member) -> int:
        """Where a stored member's bytes begin."""
        if m.method:
            raise ValueError(f"{m.name} is not stored: it can't be read by ranges")
        head = struct.unpack("<IHHHHHIIIHH", self._read(m.header, 30))
        if head[0] != _LOCAL:
            raise ValueError("broken local header")
        return m.header + 30 + head[9] + head[10]

    def read(self, m: Member, at: int = 0, size: int | None = None, start: int | None = None) -> bytes:
        return self._read((self.start(m) if start is None else start) + at, m.size - at if size is None else size)


# --- records ---------------------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers of its payload, not the payload. Line ends in a URL are
    percent-encoded; a page without an id has the bare urn."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _headers(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(data: bytes) -> dict:
    """The fields of one record; a payload that doesn't have its digest is an error.

    Blocks that are no HTTP message are payloads as they are; ids that are no urn:page are null.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = _headers(lines[1:])
    block, kind = rest[: int(h["content-length"])], h["warc-type"]
    payload, size = block, len(block)
    if h.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(_headers(http.decode("utf-8", "replace").split("\r\n")[1:]).get("content-length", len(payload))) if kind == "revisit" else len(payload)
    given = h.get("warc-payload-digest", "")
    digest = given.removeprefix("sha1:") if given.startswith("sha1:") else base32_sha1(payload)
    if kind != "revisit" and base32_sha1(payload) != digest:
        raise ValueError(f"{h.get('warc-record-id')}: payload and digest differ")

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    return {
        "page_id": number(h.get("warc-record-id")), "record_type": kind, "refers_to": number(h.get("warc-refers-to")), "payload_digest": digest,
        "payload_bytes": size, "payload": None if kind == "revisit" else payload,
        "url": h.get("warc-target-uri"),
    }


def _stream(chunks: Iterator[bytes], packed: bool) -> Iterator[bytes]:
    """Records of a member without an index, one after the other; a record is all that is held."""

    def plain() -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        for c in chunks:
            while c:
                yield z.decompress(c)
                c = z.unused_data
                if z.eof:
                    z = zlib.decompressobj(31)

    data, need = b"", None
    for c in plain() if packed else chunks:
        data += c
        while True:
            if need is None:
                data = data.lstrip(b"\r\n")
                end = data.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(_headers(data[:end].decode("utf-8", "replace").split("\r\n")[1:])["content-length"])
            if len(data) < need:
                break
            yield data[:need]
            data, need = data[need:], None
    if data.strip(b"\r\n"):
        raise ValueError("a record is cut off")


class _Archive:
    """A ZIP of stored members: gzipped records, and behind each of these an index with a line for each record."""

    def __init__(self, folder: str, part: int, member_bytes: int):
        self.member_bytes, self.path = member_bytes, f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.zip"
        store, at = filesystem(self.path)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.zip, self.lines, self.at, self.size, self.records, self.member = StoredZip(store.open_output_stream(at)), [], 0, 0, 0, ""

    def add(self, page_id: int | None, data: bytes) -> None:
        if not self.member:
            self.member = f"data-{len(self.zip.members) // 2:05d}.warc.gz"
            self.zip.begin("archive/" + self.member)
        z = zlib.compressobj(3, zlib.DEFLATED, 31)
        packed = z.compress(data) + z.flush()
        self.zip.write(packed)
        line = {"filename": self.member, "offset": self.at, "length": len(packed)} | ({} if page_id is None else {"page": page_id})
        self.lines.append(f"urn:page:{'' if page_id is None else page_id} - {json.dumps(line)}")
        self.at, self.size, self.records = self.at + len(packed), self.size + len(packed), self.records + 1
        if self.at >= self.member_bytes:
            self._index()

    def _index(self) -> None:
        if self.member:
            self.zip.end()
            self.zip.begin(f"indexes/{self.member.removesuffix('.warc.gz')}.cdxj")
            self.zip.write("".join(x + "\n" for x in self.lines).encode())
            self.zip.end()
        self.lines, self.at, self.member = [], 0, ""

    def close(self) -> tuple[str, int]:
        self._index()
        self.zip.close()
        return self.path, self.records


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page (page_id, url, html) to ZIP archives under folder: (path, records) of each archive.

    The payload is the html in UTF-8; null is empty. Of pages with equal payloads of at least min_bytes, that with the
    largest id is the response, the others revisit it; rows that repeat its id are responses too. A page without an id
    has a record as well: it revisits the response of its payload, or is a response itself if no page with an id has
    that payload. A null url is left out of its record; very long payloads are one record.

    Which pages revisit which is found from ids and digests alone, where a payload that many pages share is an
    aggregation key and a side of a join that Spark may split; payloads are dealt out by page, so no digest is hot. A
    task that runs again writes archives of new names, and only those of the task that ended count.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    src = src.withColumn("sha1", F.sha1("payload"))
    ids = src.filter(F.octet_length("payload") >= min_bytes).select("page_id", "sha1")
    shared = ids.groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1 and response is not null")
    shared = stored(shared.select("sha1", "response"), "shared-payloads")
    revisits = ids.join(shared, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("response")))
    revisits = stored(revisits.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("response").alias("refers_to")).distinct(), "revisits")
    # Where the revisits can be looked up, no payload is dealt out.
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1"))
    src = src.join(looked_up(revisits), same, "left").select("page_id", "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done, open_ = [], None
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                open_ = open_ or _Archive(folder, TaskContext.get().partitionId(), MEMBER_BYTES)
                open_.add(page_id, record(page_id, url, payload, base32_sha1(payload), refers_to, date))
                if open_.size >= ARCHIVE_BYTES:
                    done.append(open_.close())
                    open_ = None
        if open_:
            done.append(open_.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return stored(src.mapInArrow(run, "path string, records long"), "archives")


_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_FILE = re.compile(rb'"filename":\s*"([^"]*)"')


def _index_runs(z: ZipFile, m: Member, split: int, block_bytes: int) -> Iterator[tuple[int, int, set[str]]]:
    """An index member in runs of whole lines: (begin, end, files named), without holding it."""
    base, at, begin, lines, files, rest = z.start(m), 0, 0, 0, set(), b""
    while at < m.size:
        block = z.read(m, at, min(block_bytes, m.size - at), base)
        at += len(block)
        *whole, rest = (rest + block).split(b"\n")
        if at == m.size and rest:
            whole, rest = [*whole, rest], b""
        whole_to = at - len(rest)
        for k, line in enumerate(whole):
            found = _FILE.search(line)
            files |= {found[1].decode()} if found else set()
            lines += 1
            if lines == split:
                done = min(m.size, whole_to - sum(len(x) + 1 for x in whole[k + 1 :]))
                yield begin, done, files
                begin, lines, files = done, 0, set()
    if lines:
        yield begin, m.size, files


def _runs(split: int, block_bytes: int):
    """What there is to read in each archive: runs of index lines, and members that no index names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = filesystem(path)
                out = []
                with store.open_input_file(at) as file:
                    z, named = ZipFile(file), set()
                    for m in z.members:
                        if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj", ".jsonl")) and not m.method:
                            for begin, end, files in _index_runs(z, m, split, block_bytes):
                                named |= files
                                out.append((path, m.name, begin, end))
                    for m in z.members:
                        if m.name.endswith((".warc", ".warc.gz")) and m.name.rsplit("/", 1)[-1] not in named:
                            out.append((path, m.name, 0, -1))
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "member", "begin", "end"), x)) for x in out], pa.schema([("path", pa.string()), ("member", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    return run


def _indexed(z: ZipFile, lines: list[bytes], most: int) -> Iterator[list[dict]]:
    """Records that index lines name, read by stretches of a member."""
    members = {m.name.rsplit("/", 1)[-1]: m for m in z.members if m.name.endswith((".warc", ".warc.gz"))}
    entries = [json.loads(x[x.index(b"{") :]) for x in lines if b"{" in x]
    entries = [(e["filename"].rsplit("/", 1)[-1], int(e["offset"]), int(e["length"]), e.get("page")) for e in entries]
    base = {name: z.start(members[name]) for name in {e[0] for e in entries}}
    entries.sort(key=lambda e: e[:2])
    k = 0
    while k < len(entries):
        name, first = entries[k][:2]
        end = k + 1
        while end < len(entries) and entries[end][0] == name and entries[end][1] + entries[end][2] - first <= most:
            end += 1
        stretch = z.read(members[name], first, entries[end - 1][1] + entries[end - 1][2] - first, base[name])
        rows = []
        for _, offset, length, page in entries[k:end]:
            data = stretch[offset - first :][:length]
            rows.append(parse(zlib.decompress(data, 31) if name.endswith(".gz") else data))
            if page is not None and rows[-1]["page_id"] != page:
                raise ValueError(f"the index names page {page} where {rows[-1]['page_id']} lies")
        yield rows
        k = end


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives (path): page_id, url, record_type, refers_to, payload_bytes, payload_digest and,
    with_payload, payload (null for revisits). Digests of payloads are checked.

    All stored members of WARC records are read, in runs of the lines of all stored indexes (JSON with filename, offset
    and length, as in CDXJ); a member that no index names is read from its begin to its end. Each task reads the
    directory, its index lines and their stretches of the members, and nothing else. Archives of other tools are read
    likewise; records without a page's id have a null one. An archive without records gives no rows; a file that is no
    archive, a packed member or a broken record is an error. Null paths are left out; other columns are not read.
    """
    n_parts = partitions_of(archives.sparkSession)
    runs = stored(archives.select("path").filter("path is not null").mapInArrow(_runs(SPLIT_LINES, READ_BYTES), "path string, member string, begin long, end long"), "index-runs")
    runs = runs.repartition(n_parts, "path", "member", "begin")
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in _SCHEMA.split(", ")] + [("payload", pa.binary())] * with_payload)
        for b in batches:
            for path, member, begin, end in zip(*(c.to_pylist() for c in b.columns)):
                store, at = filesystem(path)
                with store.open_input_file(at) as file:
                    z = ZipFile(file)
                    m = next(m for m in z.members if m.name == member)
                    if end >= 0:
                        found = _indexed(z, z.read(m, begin, end - begin).split(b"\n"), READ_BYTES)
                    else:
                        base = z.start(m)
                        chunks = (z.read(m, k, min(READ_BYTES, m.size - k), base) for k in range(0, m.size, READ_BYTES))
                        found = ([parse(x)] for x in _stream(chunks, member.endswith(".gz")))
                    for rows in found:
                        yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in rows], schema)

    return runs.mapInArrow(run, _SCHEMA + (", payload binary" if with_payload else ""))


def archive_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
