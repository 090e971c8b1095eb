"""WARC archives as a Python data source (operator 10): `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans a partition for each archive (writers start a new one every `ROLL` bytes). Filters on record type and on other headers are pushed
down; each record's headers are parsed first, and a record that they rule out, or whose payload the schema leaves out, is passed over without
decoding its payload. Compressed archives have a gzip member for each record; where its extra field "sl" tells its length the reader
skips ahead by it, else it inflates to the end.

Writers name archives uniquely and list the committed ones in a manifest, which readers follow: what a failed or repeated task leaves is ignored. All file access
goes through the file system of the path's scheme.

A null html is an empty payload; null urls have no target header; line breaks in urls are escaped. Repeated rows of a page are written alike. An empty
table has archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from byteloom.llm.common import new_path, stored

ROLL, LEVEL, HEAD = 64 << 20, 1, 4096
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, content_length long, archive string, offset long, verified boolean, payload binary"
WRITES = "record_id string, record_type string, target_uri string, refers_to string, sha1 string, payload_length long, payload binary"
_OF_HEADER = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
_IN_BRACKETS = {"record_id", "refers_to"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, digest: str, length: int, payload: bytes | None, date: str) -> bytes:
    block = b""
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}"]
    lines += [f"WARC-Target-URI: {_clean(uri)}"] if uri else []
    lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_REVISIT}"] if kind == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose extra field tells its length and that of the data."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Archive(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Window:
    """Reads at any place of a file through one buffer, so that records passed over are not fetched one by one."""

    def __init__(self, file, size: int = 4 << 20):
        self.file, self.size, self.at, self.held, self.end = file, size, 0, b"", file.size()

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.end - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, self.size))
        return self.held[at - self.at : at - self.at + n]


def _head(data: bytes) -> tuple[dict[str, str], int] | None:
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        return None
    lines = data[:stop].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("this is no WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, stop + 4


def records(window: _Window, wanted, payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """Offset, headers and block (None unless asked for) of the records whose headers are wanted."""
    at = 0
    while at < window.end:
        first = window.get(at, 24)
        if first[:2] == b"\x1f\x8b":
            inflate, told, start = zlib.decompressobj(31), 0, at
            if len(first) == 24 and first[3] & 4 and first[12:14] == b"sl":
                told = struct.unpack("<I", first[16:20])[0]
            data, taken = b"", at
            got = _head(data)
            while got is None and not inflate.eof:
                more = inflate.unconsumed_tail or window.get(taken, HEAD)
                if not more:
                    raise ValueError("the archive ends within a record")
                taken += 0 if inflate.unconsumed_tail else len(more)
                data += inflate.decompress(more, HEAD)
                got = _head(data)
            headers, body = got
            use = wanted(headers)
            if not told or use and payload:
                parts = [data]
                while not inflate.eof:
                    more = inflate.unconsumed_tail
                    if not more:
                        more = window.get(taken, min(told - (taken - start), 1 << 20) if told else 1 << 16)
                        taken += len(more)
                    if not more:
                        raise ValueError("the archive ends within a record")
                    piece = inflate.decompress(more, 1 << 20)
                    if use and payload:
                        parts.append(piece)
                data = b"".join(parts)
                at = taken - len(inflate.unused_data)
            else:
                at = start + told
            length = int(headers["content-length"])
            if use:
                yield start, headers, data[body : body + length] if payload else None
        else:
            n = HEAD
            while (got := _head(window.get(at, n))) is None:
                if n >= window.end - at:
                    raise ValueError("the archive ends within a record's headers")
                n *= 4
            headers, body = got
            length = int(headers["content-length"])
            if wanted(headers):
                yield at, headers, window.get(at + body, length) if payload else None
            at += body + length + 4


def value_of(name: str, headers: dict[str, str]) -> str | None:
    v = headers.get(_OF_HEADER[name].lower())
    if v is not None and name in _IN_BRACKETS:
        v = v.strip("<>")
    if v is not None and name == "payload_digest":
        v = v.rpartition(":")[2]
    return v


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, verify: bool):
        self.path, self.names, self.verify, self.tests = path, schema.names, verify, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in _OF_HEADER and isinstance(f, (EqualTo, In, IsNull, IsNotNull, StringStartsWith)):
                self.tests.append((name, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, headers) -> bool:
        for name, kind, value in self.tests:
            v = value_of(name, headers)
            if kind == "IsNull":
                ok = v is None
            elif kind == "IsNotNull":
                ok = v is not None
            elif kind == "EqualTo":
                ok = v == value
            elif kind == "In":
                ok = v in value
            else:
                ok = v is not None and v.startswith(value)
            if not ok:
                return False
        return True

    def partitions(self):
        from pyarrow import fs

        system, path = _file_system(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [Archive(self.path)]
        manifest = f"{path}/_manifest.json"
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as f:
                names = json.loads(f.read())
        else:
            names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.endswith((".warc", ".warc.gz")))
        return [Archive(f"{self.path}/{n}") for n in names]

    def read(self, partition: Archive | None):
        if partition is None:  # an archive folder without archives
            return
        system, path = _file_system(partition.path)
        payload = self.verify or "payload" in self.names
        kinds = {"payload_length": pa.int64(), "content_length": pa.int64(), "offset": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        rows, size = [], 0
        with system.open_input_file(path) as f:
            for at, headers, block in records(_Window(f), self.wanted, payload):
                body, verified = None, None
                if block is not None and value_of("record_type", headers) != "revisit":
                    body = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                    digest = value_of("payload_digest", headers)
                    if self.verify and digest is not None:
                        verified = base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                row = {n: value_of(n, headers) for n in self.names if n in _OF_HEADER}
                told = headers.get("warc-payload-length")
                row |= {"payload_length": len(body) if body is not None else int(told) if told else None, "content_length": int(headers["content-length"]), "archive": partition.path, "offset": at, "verified": verified, "payload": body}
                rows.append([row.get(n) for n in self.names])
                size += len(body or b"") * ("payload" in self.names) + 300
                if size >= 8 << 20:
                    yield self._batch(rows, schema)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows, schema):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, compressed: bool, date: str):
        self.path, self.compressed, self.date = path, compressed, date

    def write(self, iterator):
        system, path = _file_system(self.path)
        files, out, size = [], None, 0
        for b in iterator:
            columns = [b.column(b.schema.get_field_index(n)) for n in ("record_type", "record_id", "target_uri", "refers_to", "sha1", "payload_length", "payload")]
            for i in range(b.num_rows):
                kind, rid, uri, refers, sha1, length, payload = (c[i].as_py() for c in columns)
                data = record(kind, rid, uri, refers, base32(sha1), length, payload, self.date)
                data = member(data) if self.compressed else data
                if out is None or size + len(data) > ROLL:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.compressed)
                    out, size = system.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        system, path = _file_system(self.path)
        names = sorted(n for m in messages if m is not None for n in m.files)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/_manifest.json", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages):
        system, path = _file_system(self.path)
        for m in messages:
            for n in m.files if m is not None else ():
                system.delete_file(f"{path}/{n}")


class Warc(DataSource):
    """Options: path; verify (read: compare payloads with their digests); compressed (write, true unless "false"); date (write)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"].rstrip("/"), schema, self.options.get("verify", "false").lower() == "true")

    def writer(self, schema, overwrite):
        path = self.options["path"].rstrip("/")
        system, inner = _file_system(path)
        system.create_dir(inner, recursive=True)
        return WarcWriter(path, self.options.get("compressed", "true").lower() != "false", self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def _id(column: str):
    return F.concat(F.lit("urn:byteloom:page:"), F.coalesce(F.col(column).cast("string"), F.lit("null")))


def to_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Rows to write: of pages with equal payloads of at least `least` bytes, the largest page_id is the response and the others revisit it.

    Only digests are grouped and joined by payload, so a payload with very many copies costs little; pages themselves move once, by page_id."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    told = pages.select("page_id", "url", html.alias("payload")).withColumns({"sha1": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    small = stored(told.select("page_id", "sha1", "payload_length").distinct(), "digests")
    last = stored(small.where(F.col("payload_length") >= least).groupBy("sha1", "payload_length").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n"), "responses")
    revisits = small.join(last, ["sha1", "payload_length"]).where(~F.col("page_id").eqNullSafe(F.col("last"))).select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "last")
    joined = told.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left")
    again = F.col("last").isNotNull()
    return joined.select(_id("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.when(again, _id("last")).alias("refers_to"), "sha1", "payload_length", F.when(~again, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages as WARC archives to the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    spark = pages.sparkSession
    register(spark)
    path = new_path(spark, "warc")
    to_records(pages, least).write.format("warc").mode("append").option("path", path).save()
    back = spark.read.format("warc").schema("record_id string, record_type string, refers_to string, payload_digest string, payload_length long, verified boolean").option("path", path).option("verify", "true").load()
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).try_cast("long")
    return back.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"), "verified")
