"""WARC records in ZIP packages: writing with revisits, and reading by range.

A package is a ZIP file of stored (uncompressed) members, as web archive packages are laid out:
``archive/data.warc.gz`` (one gzip member per record), ``indexes/index.jsonl`` (a line per record: page,
offset, length) and ``datapackage.json``. The reader never unpacks a package: it reads the end of central
directory, its ZIP64 forms where sizes ask for them, the central directory and the members' local headers,
then the index, and fetches each record by its byte range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, fresh_folder, open_shared, write_shared

ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.jsonl"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of at least so many bytes are stored once. Zero: all of them.
LEAST_BYTES = 0
#: Bytes of one package's records before another package is begun.
PACKAGE_BYTES = 256 << 20
_SPAN_GAP = 64 << 10
_SPAN_BYTES = 8 << 20


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


# ---- deciding ------------------------------------------------------------------------------


def decisions(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Revisits of ``pages`` (page_id, html): (page_id, payload_digest, refers_to), a row per page and payload
    that revisits another page.

    Of pages with equal payloads of at least ``least`` bytes, that with the largest page_id is the
    response. Only digests (``_payload_digest``) are shuffled, and equal ones meet before the shuffle.
    """
    known = cut_lineage(
        pages.filter(F.col("page_id").isNotNull() & (F.octet_length(F.coalesce("html", F.lit(""))) >= least))
        .select("page_id", _payload_digest().alias("payload_digest"))
    )
    owners = known.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"))
    shared = cut_lineage(owners.filter("low < refers_to").select("payload_digest", "refers_to"))
    found = known.join(shared, "payload_digest").filter("page_id <> refers_to")
    return found.select("page_id", "payload_digest", "refers_to").distinct()


def _payload_digest() -> Column:
    """SHA-1 of the column ``html`` as payload, in hex."""
    return F.sha1(F.coalesce("html", F.lit("")))


# ---- writing -------------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit that names another's."""
    digest, kind = digest_of(payload), "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _header(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def _header(url: str | None) -> str | None:
    """A URL that cannot break out of its header line; null has no line."""
    return None if url is None else "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Sink:
    """A write-only file object for zipfile that hands its bytes on."""

    def __init__(self):
        self.ready, self.at = [], 0

    def write(self, data) -> int:
        self.ready.append(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass

    def take(self) -> list[bytes]:
        out, self.ready = self.ready, []
        return out


def package(records, index: list[bytes]):
    """The bytes of a package, chunk by chunk; ``index`` gets a line per record."""
    sink = _Sink()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True) as out:
        with out.open(zipfile.ZipInfo(ARCHIVE, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
            at = 0
            for page_id, data in records:
                member.write(data)
                line = {"page_id": page_id, "offset": at, "length": len(data)}
                index.append(json.dumps(line).encode())
                at += len(data)
                yield from sink.take()
        out.writestr(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), b"\n".join(index))
        about = {"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}
        out.writestr(zipfile.ZipInfo("datapackage.json", (2024, 1, 1, 0, 0, 0)), json.dumps(about))
    yield from sink.take()


def write_packages(pages: DataFrame, folder: str, least: int = LEAST_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) into packages; a row per package.

    Null html is the empty payload, a null url leaves its header out. Rows that repeat a page_id are
    records of their own, each decided by its own payload. Rows without a page_id are responses. Packages have names by
    partition and appear only when whole, so a task that is run again replaces what it wrote.
    """
    spark = pages.sparkSession
    revisits = decisions(pages, least)
    rows = pages.select("page_id", "url", "html", _payload_digest().alias("payload_digest"))
    rows = rows.join(revisits, ["page_id", "payload_digest"], "left")

    made_of = pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())])

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def records():
            for batch in parts:
                # Row by row out of Arrow, so that ids stay whole numbers beside nulls.
                for page_id, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    yield page_id, _gzip(record(page_id, url, (html or "").encode("utf-8"), refers))

        waiting, number = records(), 0
        first = next(waiting, None)
        while first is not None:
            index: list[bytes] = []
            rest = {"next": None}

            def some(first=first, rest=rest):
                size, one = 0, first
                while one is not None:
                    if size and size + len(one[1]) > package_bytes:
                        rest["next"] = one
                        return
                    size += len(one[1])
                    yield one
                    one = next(waiting, None)

            path = f"{folder}/part-{part:06d}-{number:04d}.wacz"
            size = write_shared(path, package(some(), index))
            yield pa.RecordBatch.from_pylist([{"path": path, "size": size, "records": len(index)}], schema=made_of)
            first, number = rest["next"], number + 1

    made = rows.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, size bigint, records bigint")
    found = made.collect()  # a row per package
    return spark.createDataFrame(sorted(found), "path string, size bigint, records bigint")


# ---- reading -------------------------------------------------------------------------------


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP file: name to (offset of the data, bytes), from its central directory."""

    def at(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = at(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record64 = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record64, 32)
    directory, found, p = at(start, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, plain, names, extras, remarks = struct.unpack_from("<IIHHH", directory, p + 20)
        local = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + names : p + 46 + names + extras], 0
        while q + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                wide, r = [], q + 4
                for value in (plain, packed, local):
                    if value == 0xFFFFFFFF:
                        value = struct.unpack_from("<Q", extra, r)[0]
                        r += 8
                    wide.append(value)
                plain, packed, local = wide
            q += 4 + width
        if method == 0 and not flags & 1:  # stored and not encrypted: can be read by range
            head = at(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("broken local header")
            found[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        p += 46 + names + extras + remarks
    return found


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one gzipped record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    for line in http.decode("latin-1").split("\r\n")[1:]:
        k, _, v = line.partition(": ")
        fields.setdefault("http-" + k.lower(), v)
    return fields, payload


def _spans(entries: list[dict]) -> list[list[dict]]:
    """Index lines grouped into reads: neighbours go together up to a size."""
    out: list[list[dict]] = []
    for e in sorted(entries, key=lambda e: e["offset"]):
        if out:
            first, last = out[-1][0], out[-1][-1]
            end = e["offset"] + e["length"]
            if e["offset"] - last["offset"] - last["length"] <= _SPAN_GAP and end - first["offset"] <= _SPAN_BYTES:
                out[-1].append(e)
                continue
        out.append([e])
    return out


_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_packages(spark: SparkSession, packages: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of ``packages`` (path, size), read by range; with ``payloads``, also the html.

    A response's length and digest are those of the bytes read, and must agree with its header. A revisit's
    are those that its headers state of the full payload; its html is null.
    """
    rows = packages.select("path", "size").collect()  # a row per package

    names = [c.split()[0] for c in _RECORD.split(", ")] + ["html"] * payloads
    kinds = [pa.int64() if c.endswith("bigint") else pa.string() for c in _RECORD.split(", ")] + [pa.string()] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                with open_shared(path) as f:
                    found = members(f, size)
                    base, at = found[ARCHIVE][0], found[INDEX]
                    f.seek(at[0])
                    entries = [json.loads(line) for line in f.read(at[1]).split(b"\n") if line]
                    for span in _spans(entries):
                        first = span[0]["offset"]
                        f.seek(base + first)
                        data = f.read(span[-1]["offset"] + span[-1]["length"] - first)
                        out = []
                        for e in span:
                            fields, payload = parsed(data[e["offset"] - first : e["offset"] - first + e["length"]])
                            stated = fields["warc-payload-digest"].removeprefix("sha1:")
                            refers = fields.get("warc-refers-to")
                            if refers is None:
                                length, digest = len(payload), digest_of(payload)
                                if digest != stated:
                                    raise ValueError(f"payload of page {e['page_id']} does not match its digest")
                            else:
                                length, digest = int(fields["http-content-length"]), stated
                                refers = int(refers.strip("<>").rpartition(":")[2])
                            html = payload.decode("utf-8") if refers is None else None
                            out.append(
                                (e["page_id"], fields.get("warc-target-uri"), length, digest, fields["warc-type"], refers)
                                + ((html,) if payloads else ())
                            )
                        columns = [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)]
                        yield pa.RecordBatch.from_arrays(columns, names)

    parts = spark.createDataFrame(rows, "path string, size bigint")
    dealt = parts.repartition(max(1, len(rows)), "path") if rows else parts
    return dealt.mapInArrow(read, _RECORD + ", html string" * payloads)


def archived(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Archive ``pages`` in a new folder of the shared place and read the records back."""
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    return read_packages(spark, write_packages(pages, folder, least))
