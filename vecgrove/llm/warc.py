"""WARC records in ZIP-packaged archives.

Each package is a ZIP file with stored (uncompressed) members: a WARC file of
one gzip member a record, and an index with the place of every record in it.
The reader parses the end-of-central-directory record (with the ZIP64 locator
and record where present) and the central directory, finds where the stored
members begin, and reads index and records by byte range; nothing is extracted.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, pick, slices

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Smallest payload, in bytes, of which later copies become revisits.
LEAST = 100
#: Records that follow each other are read together up to so many bytes.
READ_BYTES = 4_000_000
SALTS = 16


# ---- ZIP


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class Package:
    """Members of a ZIP file, read by byte range only."""

    def __init__(self, url: str):
        fs, path = filesystem(url)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        self.members = {m.name: m for m in self._directory()}
        self.begin: dict[str, int] = {}

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 65_557)  # the record and the longest comment
        tail = self.file.read_at(self.size - tail_at, tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\5\6", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
            locator = self.file.read_at(20, tail_at + end - 20)
            if locator[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            record = self.file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 record")
            count, size, at = struct.unpack_from("<QQQ", record, 32)
        buf, pos = self.file.read_at(size, at), 0
        for _ in range(count):
            if buf[pos : pos + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", buf, pos + 8)
            stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", buf, pos + 20)
            header = struct.unpack_from("<I", buf, pos + 42)[0]
            name = buf[pos + 46 : pos + 46 + n_name]
            extra = buf[pos + 46 + n_name : pos + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # 64-bit values, only for fields that overflow
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    stored = next(wide) if stored == 0xFFFFFFFF else stored
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, full, stored, header)
            pos += 46 + n_name + n_extra + n_comment

    def read(self, name: str, at: int = 0, size: int | None = None) -> bytes:
        """A byte range of a stored member."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is not stored")
        if name not in self.begin:
            local = self.file.read_at(30, m.header)
            if local[:4] != b"PK\3\4":
                raise ValueError("broken local header")
            self.begin[name] = m.header + 30 + sum(struct.unpack_from("<HH", local, 26))
        size = m.size - at if size is None else size
        if at < 0 or at + size > m.size:
            raise ValueError("range beyond the member")
        return self.file.read_at(size, self.begin[name] + at)

    def pieces(self, name: str, ranges: Iterable[tuple[int, int]], most: int = READ_BYTES) -> Iterator[bytes]:
        """The byte ranges of a stored member, in their order; neighbours come
        by one read of up to ``most`` bytes (or of one range, if that is longer)."""
        near: list[tuple[int, int]] = []
        for at, size in chain(ranges, [(-1, 0)]):
            follows = near and at == sum(near[-1])
            if near and (not follows or at + size - near[0][0] > most):
                begin = near[0][0]
                raw = self.read(name, begin, sum(near[-1]) - begin)
                yield from (raw[a - begin : a - begin + n] for a, n in near)
                near = []
            near.append((at, size))


# ---- WARC


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit holds the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:]), payload


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def gzip_one(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


# ---- Spark


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, digest, refers_to, revisit``: of records with equal
    payloads of at least ``LEAST`` bytes, that with the smallest id is the
    response. A null html is an empty payload. Rows that share both id and
    payload are all responses; a null id is a revisit where the group has
    another id. Digests are counted before the payloads move, and the join is
    salted, so a payload that a third of all pages share is spread out.
    """
    p = pick(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    p = p.withColumn("digest", F.sha2("html", 256))
    firsts = (
        p.filter(F.octet_length("html") >= LEAST)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    joined = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(firsts, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(marked: DataFrame, out_dir: str) -> list[str]:
    """Write one package a partition; returns their places (a list as long as
    the number of partitions). A task that is run again writes a new file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, index, at = f"{out_dir}/pages-{uuid.uuid4().hex}.zip", [], 0
        fs, path = filesystem(place)
        zipped = data = None
        for batch in slices(batches, "html"):
            if zipped is None:
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink = fs.open_output_stream(path)
                zipped = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
                data = zipped.open(DATA, "w", force_zip64=True)
            for r in batch.to_pylist():
                raw = gzip_one(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], r["revisit"]))
                data.write(raw)
                index.append((at, len(raw)))
                at += len(raw)
        if zipped is not None:
            data.close()
            with zipped.open(INDEX, "w") as out:
                for a, n in index:
                    out.write(json.dumps({"offset": a, "length": n}).encode() + b"\n")
            zipped.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"place": [place]})

    return sorted(r.place for r in marked.mapInArrow(run, "place string").collect())


def read_archives(spark: SparkSession, places: list[str], payload: bool = True) -> DataFrame:
    """Every record of the packages: ``page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload`` (binary; null for revisits, or
    where not asked for). A response's digest is recomputed and must match."""
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def one(raw: bytes) -> tuple:
        fields, http, body = parse(zlib.decompress(raw, 31))
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
        return _page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, _page(fields.get("WARC-Refers-To")), int(http["Content-Length"]), digest, body if payload and kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                pack = Package(places[n])
                rows, held = [], 0
                for raw in pack.pieces(DATA, ((x["offset"], x["length"]) for x in map(json.loads, pack.read(INDEX).splitlines()))):
                    rows.append(one(raw))
                    held += 200 + len(rows[-1][-1] or b"")
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return spark.range(0, len(places), 1, max(1, len(places))).mapInArrow(run, schema)
