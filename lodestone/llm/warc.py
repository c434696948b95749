"""Web pages in WARC archives, read back through a two-level index of captures.

1. Payloads that are equal (SHA-256 and length) and not short get one response record, that of the largest page_id; the
   others become revisit records that name it. Counts are combined before the shuffle, and the join's hot side can be split.
2. Tasks write records, each a gzip member of its own, to archives in a shared folder and return where each one lies. A
   file's name is new in every attempt, so that what a lost executor has left is never named by the index.
3. The captures, sorted by reversed-host URL key over all tasks, are cut into compressed blocks of `BLOCK` captures. A
   task's blocks are one file, which ends with the sparse directory of its blocks (first key, place). The driver keeps the
   first key of each file: one row for each shuffle partition.
4. A lookup sorts what is asked for alike; each key finds its file, then its block, by binary search in first keys, reads
   that range, and finds its captures in the block by binary search. Records are then read by ranges of their archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

LEAST = 1000  # payloads of fewer bytes are always written
BLOCK = 1000  # captures in a block of the index
ARCHIVE = 1 << 30  # bytes after which a task begins another archive
GAP, SPAN = 1 << 16, 1 << 22  # ranges are read together over gaps of GAP bytes, up to SPAN bytes
CAPTURED = "2024-01-01T00:00:00Z"

_URL = r"(?i)^([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?"
_CAPTURES = "key string, page_id long, record_type string, path string, offset long, length long"
_ARROW = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_NO_PAGE = -(1 << 63) - 1  # a null page_id sorts first


def url_key(url: Column) -> Column:
    """A URL by its host from the end: `http://www.A.example.com:80/x?q#f` is `com,example,a)/x?q`. Scheme, user, `www.`,
    usual ports and fragments go; hosts of digits or in brackets stay as they are; other texts are their own key; null is ''."""
    url = F.coalesce(url, F.lit(""))
    scheme, host, port, path, query = (F.regexp_extract(url, _URL, k) for k in range(1, 6))
    host = F.regexp_replace(F.lower(host), r"^www[0-9]*\.", "")
    turned = F.when(host.rlike(r"^[0-9.]+$|^\["), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    usual = (port == "") | ((F.lower(scheme) == "http") & (port == "80")) | ((F.lower(scheme) == "https") & (port == "443"))
    whole = F.concat(turned, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), F.lit(")"), F.when(path == "", "/").otherwise(path), query)
    return F.when(url.rlike(_URL), whole).otherwise(url)


def record_id(page_id: Column, url: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("-")), F.lit(":"), F.substring(F.sha2(F.coalesce(url, F.lit("")), 256), 1, 16), F.lit(">"))


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """What is to be written of each page: page_id, url, key, id, payload, digest (SHA-1), record_type, and of a revisit
    refers_id and refers_url. Rows that repeat page_id, URL and payload of a response are responses as well."""
    url, payload = F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url, payload).withColumn("same", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    base = base.withColumn("own", F.struct("page_id", "url"))
    first = base.where("same is not null").groupBy("same").agg(F.max("own").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("same").alias("s"), "first")
    joined = base.join(first, F.col("same") == F.col("s"), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("own"))
    return joined.select(
        "page_id",
        "url",
        url_key(F.col("url")).alias("key"),
        record_id(F.col("page_id"), F.col("url")).alias("id"),
        "payload",
        F.sha1("payload").alias("digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, record_id(F.col("first.page_id"), F.col("first.url"))).alias("refers_id"),
        F.when(again, F.col("first.url")).alias("refers_url"),
    )


def _plain(url: str | None) -> str:
    """A URL that can stand in a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def encoded_record(kind: str, id: str, url: str | None, digest: str, payload: bytes, refers_id: str | None, refers_url: str | None, captured: str = CAPTURED) -> bytes:
    """A WARC 1.1 record. A revisit keeps the HTTP head, which tells the payload's length, and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {id}",
        f"WARC-Date: {captured}",
        f"WARC-Target-URI: {_plain(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {refers_id}",
            f"WARC-Refers-To-Target-URI: {_plain(refers_url)}",
            f"WARC-Refers-To-Date: {captured}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    code = zlib.compressobj(6, zlib.DEFLATED, 31)
    return code.compress(data) + code.flush()


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes planned records to archives in a folder that all executors reach; returns the captures as a stored table:
    key, page_id, record_type, path (in the folder), offset, length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        task, out, name = TaskContext.get().partitionId(), None, ""
        info = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
        try:
            for batch in batches:
                rows = []
                for k in range(batch.num_rows):
                    page_id, url, key, id, payload, digest, kind, refers_id, refers_url = (c[k].as_py() for c in batch.columns)
                    if out is None or out.tell() >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"pages-{task:06d}-{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {CAPTURED}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                        out.write(_member(head.encode() + info + b"\r\n\r\n"))
                    offset = out.tell()
                    member = _member(encoded_record(kind, id, url, digest, payload, refers_id, refers_url))
                    out.write(member)
                    rows.append((key, page_id, kind, name, offset, len(member)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 6, _ARROW)], schema=_ARROW)
        finally:
            if out is not None:
                out.close()

    return stored(planned.select("page_id", "url", "key", "id", "payload", "digest", "record_type", "refers_id", "refers_url").mapInArrow(write, _CAPTURES))


@dataclass
class Index:
    """Where the index files lie, and the first (key, page_id) of each in order."""

    folder: str
    first: list[tuple[bytes, int]]
    names: list[str]


def _place(key: str, page_id: int | None) -> tuple[bytes, int]:
    return key.encode(), _NO_PAGE if page_id is None else page_id


def _ranges(df: DataFrame, *names: str) -> DataFrame:
    """Dealt by ranges of key, as many as the session has shuffle partitions."""
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names)


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> Index:
    """Sorts captures by key and writes one file of blocks, with their directory at its end, for each range of keys."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = FileSystem.from_uri(folder)
        out, directory, lines, at = None, [], [], None
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"

        def end_block() -> None:
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 6)
            directory.append((lines[0][0], lines[0][1], out.tell(), len(data)))
            out.write(data)
            lines.clear()

        try:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        files.create_dir(root, recursive=True)
                        out, at = files.open_output_stream(f"{root}/{name}", compression=None), row[:2]
                    lines.append(row)
                    if len(lines) == block:
                        end_block()
            if out is not None:
                if lines:
                    end_block()
                data = zlib.compress(json.dumps(directory).encode(), 6)
                tail = struct.pack("<QQ", out.tell(), len(data))
                out.write(data + tail)
        finally:
            if out is not None:
                out.close()
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int64()), pa.array([name])], ["key", "page_id", "name"])

    ordered = _ranges(captures.select(*_ARROW.names), "key", "page_id").sortWithinPartitions("key", "page_id", "path", "offset")
    written = stored(ordered.mapInArrow(write, "key string, page_id long, name string"))
    found = sorted((_place(r["key"], r["page_id"]), r["name"]) for r in written.collect())  # a row for each shuffle partition
    discard(written)
    return Index(folder, [p for p, _ in found], [n for _, n in found])


class _Reader:
    """Captures of one key after another. The last file's directory and the last block stay, as keys come in order."""

    def __init__(self, index: Index):
        self.index = index
        self.files, self.root = FileSystem.from_uri(index.folder)
        self.shard = self.block = None

    def open(self, shard: int) -> None:
        if shard != self.shard:
            path = f"{self.root}/{self.index.names[shard]}"
            self.file, self.shard, self.block = self.files.open_input_file(path), shard, None
            size = self.file.size()
            offset, length = struct.unpack("<QQ", self.file.read_at(16, size - 16))
            self.directory = json.loads(zlib.decompress(self.file.read_at(length, offset)))
            self.starts = [_place(k, p) for k, p, _, _ in self.directory]

    def load(self, block: int) -> None:
        if block != self.block:
            _, _, offset, length = self.directory[block]
            self.rows = [json.loads(line) for line in zlib.decompress(self.file.read_at(length, offset)).split(b"\n")]
            self.places, self.block = [_place(r[0], r[1]) for r in self.rows], block

    def find(self, low: tuple, high: tuple) -> Iterator[list]:
        """The captures at low <= place <= high: from the last block that begins before `low` on."""
        shard = max(0, bisect_left(self.index.first, low) - 1)
        while shard < len(self.index.names) and self.index.first[shard] <= high:
            self.open(shard)
            block = max(0, bisect_left(self.starts, low) - 1)
            while block < len(self.starts) and self.starts[block] <= high:
                self.load(block)
                for k in range(bisect_left(self.places, low), len(self.rows)):
                    if self.places[k] > high:
                        return
                    yield self.rows[k]
                block += 1
            shard += 1


def lookup(index: Index, wanted: DataFrame) -> DataFrame:
    """All captures of the keys in `wanted` (key), or those of (key, page_id) where it has both columns. Each is found
    once, however often it is asked for. Keys that aren't there give no row."""
    exact = "page_id" in wanted.columns
    names = ["key", "page_id"] if exact else ["key"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index)
        for batch in batches:
            rows: list = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = (_place(*row), _place(*row)) if exact else ((row[0].encode(), _NO_PAGE), (row[0].encode(), 1 << 63))
                for found in reader.find(low, high):
                    rows.append(found)
                    if len(rows) == 10_000:  # a key may have any number of captures
                        yield _table(rows)
                        rows = []
            yield _table(rows)

    asked = wanted.where("key is not null").select(*names).distinct()
    return _ranges(asked, *names).sortWithinPartitions(*names).mapInArrow(find, _CAPTURES)


def _table(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 6, _ARROW)], schema=_ARROW)


def _head(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and what follows them."""
    head, _, rest = data.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v.strip() for k, _, v in pairs}, rest


def decoded_record(member: bytes) -> dict:
    """A response or revisit record: id, page_id, url, record_type, payload_bytes and payload_digest of the whole payload
    (hexadecimal), refers_id, refers_to, and the payload that it holds. A payload that isn't what its digest says is an error."""
    fields, rest = _head(zlib.decompress(member, 31))
    http, payload = _head(rest[: int(fields["content-length"])])
    digest, kind = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), fields["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    n = int(http["content-length"])

    def page(id: str | None) -> int | None:
        own = id.split(":")[2] if id else "-"
        return None if own == "-" else int(own)

    id, refers = fields["warc-record-id"], fields.get("warc-refers-to")
    return {"id": id, "page_id": page(id), "url": fields["warc-target-uri"], "record_type": kind, "payload_bytes": n, "payload_digest": digest, "refers_id": refers, "refers_to": page(refers), "payload": payload if kind == "response" else None}


def read_records(captures: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """The records at captures: id, page_id, url, record_type, payload_bytes, payload_digest, refers_id, refers_to, and
    payload (of responses) if asked for. Ranges of an archive that lie near each other are read at once."""
    schema = "id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_id string, refers_to long" + ", payload binary" * keep_payload
    types = [("id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_id", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())][: 8 + keep_payload]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            paths, offsets, lengths = (c.to_pylist() for c in batch.columns)
            i, n = 0, batch.num_rows
            while i < n:
                j, end = i + 1, offsets[i] + lengths[i]
                while j < n and paths[j] == paths[i] and offsets[j] <= end + GAP and offsets[j] + lengths[j] <= offsets[i] + SPAN:
                    end, j = max(end, offsets[j] + lengths[j]), j + 1
                if paths[i] != name:
                    name, file = paths[i], files.open_input_file(f"{root}/{paths[i]}")
                data = file.read_at(end - offsets[i], offsets[i])
                rows = [decoded_record(data[offsets[k] - offsets[i] : offsets[k] - offsets[i] + lengths[k]]) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types], [c for c, _ in types])
                i = j

    placed = _ranges(captures.select("path", "offset", "length"), "path", "offset").sortWithinPartitions("path", "offset")
    return placed.mapInArrow(read, schema)


def with_payloads(found: DataFrame) -> DataFrame:
    """Records read with payloads; revisits get that of the response they name."""
    whole = found.where("record_type = 'response'").select(F.col("id").alias("i"), F.col("payload").alias("p")).dropDuplicates(["i"])
    joined = found.where("record_type = 'revisit'").join(whole, F.col("refers_id") == F.col("i"), "left")
    return found.where("record_type = 'response'").unionByName(joined.withColumn("payload", F.col("p")).drop("i", "p"))


def archived(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes all pages to archives in a shared folder, indexes them, and reads every page's record back through the
    index: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    pages: page_id, url, html; other columns are not read. Null html is an empty payload; a null URL has the key ''; a
    null page_id is a page of its own and smaller than any other. Rows that repeat a page_id give as many records. Short
    payloads, also empty ones, are responses always. An empty table gives no rows. A record is held in memory whole."""
    captures = write_archives(records(pages, least), folder)
    index = build_index(captures, f"{folder}/index")
    found = stored(lookup(index, captures.select("key", "page_id")))
    return read_records(found, folder).select("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")


#: DuckDB SQL for the rows of op13_warc.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM r
"""
