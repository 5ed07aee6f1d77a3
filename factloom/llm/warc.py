"""WARC archives as a PySpark Python data source, read and written.

Reading plans one partition per archive file, takes filters on header fields (record type, URI,
digest, ...) into the scan, parses a record's headers first and, where they fail the filter, skips
the rest of the record: by the length that the gzip member carries in its ``sl`` field (WARC
1.1, annex D), so that its payload is not even inflated. Writing makes gzip members of one record
each, rolls files at ``roll_bytes`` and publishes a manifest of its own on commit; a folder's archives are
those of all its manifests, so further writes append. Files of failed or repeated tasks are in none,
and commit and abort delete them.

All access to files goes through pyarrow's file systems, so paths may be local, hdfs:// or object
stores. Payloads of responses stand behind an HTTP header block; a revisit has that block alone,
and its Content-Length still tells how long the payload was.
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
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from factloom.llm.common import BitArray, cut, fresh_path, let, small_batches

READ_SCHEMA = "record_id string, warc_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary, headers map<string,string>"
WRITE_COLUMNS = ("record_id", "warc_type", "target_uri", "payload_digest", "refers_to", "payload_bytes", "payload")
#: Column of the source -> WARC header.
HEADER_OF = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_MANIFEST-"


def file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose ``sl`` field holds its compressed and uncompressed length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """A whole record: WARC headers, then for pages the HTTP headers and (responses only) the payload."""
    payload, kind = row.get("payload") or b"", row["warc_type"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http + (payload if kind != "revisit" else b"")
    head = [f"{HEADER_OF[c]}: {_one_line(row[c])}" for c in ("warc_type", "record_id", "target_uri", "refers_to") if row.get(c) is not None]
    if row.get("payload_digest") is not None:
        head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    """Header values can't hold line breaks; they are percent-encoded, as in any URI."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


class Records:
    """Walks over an archive's records, plain or in gzip members, headers first."""

    def __init__(self, file, chunk: int = 1 << 16):
        self.file, self.chunk, self.position = file, chunk, 0
        self.buffer = b""
        self.skipped_inflating = 0

    def _fill(self, n: int) -> bytes:
        """At least n raw bytes from the position on, fewer only at the end."""
        while len(self.buffer) < n:
            more = self.file.read(max(self.chunk, n - len(self.buffer)))
            if not more:
                break
            self.buffer += more
        return self.buffer

    def _advance(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.file.seek(self.file.tell() + n - len(self.buffer))
            self.buffer = b""

    def __iter__(self) -> Iterator[Record]:
        while start := self._fill(24):
            if start[:2] != b"\x1f\x8b":
                yield from self._plain()
                continue
            length = struct.unpack_from("<I", start, 16)[0] if start[3] == 4 and start[12:14] == b"sl" else 0
            record = Record(self, zlib.decompressobj(31), length)
            yield record
            record.close()

    def _plain(self):
        while self.buffer[:2] in (b"\r\n",):
            self._advance(2)
            if not self._fill(2):
                return
        if self._fill(5)[:5] == b"WARC/":
            record = Record(self, None, 0)
            yield record
            record.close()
        elif self.buffer:
            raise ValueError("not a WARC record")


class Record:
    """headers are parsed on entry; body() inflates the rest, close() skips what was not asked for."""

    def __init__(self, records: Records, inflate, length: int):
        self.records, self.inflate, self.length, self.used, self.data, self.done = records, inflate, length, 0, b"", False
        while b"\r\n\r\n" not in self.data and self._more():
            pass
        head, _, self.data = self.data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        self.headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.size = int(self.headers.get("Content-Length", 0))

    def _more(self, n: int = 1 << 14) -> bool:
        if self.done:
            return False
        raw = self.records._fill(n)[:n]
        if self.inflate is None:
            self.data += raw
            self.records._advance(len(raw))
            self.done = not raw
            return bool(raw)
        out = self.inflate.decompress(raw)
        taken = len(raw) - len(self.inflate.unused_data)
        self.records._advance(taken)
        self.used += taken
        self.done = self.inflate.eof or not raw
        self.data += out
        return not self.done or bool(out)

    def body(self) -> bytes:
        """The whole block. Pieces are joined once, so a block of many MB costs its length."""
        parts, n = [self.data], len(self.data)
        self.data = b""
        while n < self.size and self._more(1 << 18):
            parts.append(self.data)
            n += len(self.data)
            self.data = b""
        parts.append(self.data)
        self.data = b"".join(parts)
        if len(self.data) < self.size:
            raise ValueError("the record is cut short")
        return self.data[: self.size]

    def head_of_body(self) -> tuple[bytes, int]:
        """The block's HTTP headers, and where the payload starts in it."""
        while b"\r\n\r\n" not in self.data[: self.size] and len(self.data) < self.size and self._more():
            pass
        at = self.data[: self.size].find(b"\r\n\r\n")
        return self.data[: max(at, 0)], at + 4 if at >= 0 else 0

    def close(self) -> None:
        if self.inflate is None:
            need = self.size + 4 - len(self.data)
            if need >= 0:
                self.records._advance(need)
            else:  # it read into the next record
                self.records.buffer = self.data[self.size + 4 :] + self.records.buffer
        elif self.length and not self.done:
            self.records.skipped_inflating += 1
            self.records._advance(self.length - self.used)
        else:
            while self._more():
                self.data = b""


@dataclass
class ArchiveFile(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


_ARROW_READ = pa.schema([*((c, pa.string()) for c in HEADER_OF), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string()))])


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    columns[7] = [list(h.items()) for h in columns[7]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_READ, strict=True)], schema=_ARROW_READ)


def _listed(fs, path: str) -> list[str]:
    with fs.open_input_stream(path) as file:
        return json.loads(file.read())


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool, pushdown: bool = True):
        self.path, self.with_payload, self.pushdown, self.wanted = path, with_payload, pushdown, {}

    def pushFilters(self, filters):
        for f in filters:
            if self.pushdown and isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_OF:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self):
        fs, root = file_system(self.path)
        from pyarrow.fs import FileSelector, FileType

        if fs.get_file_info(root).type == FileType.File:
            return [ArchiveFile(self.path)]
        names = sorted(x.base_name for x in fs.get_file_info(FileSelector(root)))
        manifests = [x for x in names if x.startswith(MANIFEST)]
        if manifests:
            names = sorted(x for m in manifests for x in _listed(fs, f"{root}/{m}"))
        else:
            names = [x for x in names if x.endswith((".warc", ".warc.gz"))]
        return [ArchiveFile(f"{self.path.rstrip('/')}/{x}") for x in names]

    def read(self, partition):
        if not isinstance(partition, ArchiveFile):
            return
        fs, name = file_system(partition.path)
        held, size = [], 0
        with fs.open_input_file(name) as file:
            for row in self.rows(Records(file)):
                held.append(row)
                size += len(row[6] or b"") + 200
                if size >= 1 << 20:
                    yield _read_batch(held)
                    held, size = [], 0
        if held:
            yield _read_batch(held)

    def rows(self, records: Records):
        for record in records:
            value = {c: record.headers.get(h) for c, h in HEADER_OF.items()}
            if value["payload_digest"]:
                value["payload_digest"] = value["payload_digest"].removeprefix("sha1:")
            if any(value[c] not in wanted for c, wanted in self.wanted.items()):
                continue
            payload, size = None, record.size
            if record.headers.get("Content-Type", "").startswith("application/http"):
                http, start = record.head_of_body()
                fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:] if b": " in x)
                size = int(fields.get(b"content-length", record.size - start))
            else:
                start = 0
            if self.with_payload and value["warc_type"] != "revisit":
                payload = record.body()[start:]
            yield (value["record_id"], value["warc_type"], value["target_uri"], value["payload_digest"], value["refers_to"], size, payload, record.headers)


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    """Its files' names begin with the job's, which commit and abort know them by."""

    def __init__(self, path: str, roll_bytes: int, overwrite: bool = False):
        self.path, self.roll_bytes, self.overwrite, self.job = path, roll_bytes, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]):
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        names, file, size = [], None, 0
        for batch in small_batches(iterator, "payload", 1 << 20):
            for row in batch.to_pylist():
                if file is None:
                    names.append(f"{self.job}-{uuid.uuid4().hex}.warc.gz")
                    file, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                size += file.write(member := gzip_member(record_bytes(row))) or len(member)
                if size >= self.roll_bytes:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        return Written(names)

    def _names(self, fs, root: str) -> list[str]:
        from pyarrow.fs import FileSelector

        return [x.base_name for x in fs.get_file_info(FileSelector(root, allow_not_found=True))]

    def commit(self, messages):
        """Publish a manifest under its final name in one move; then what it doesn't list of this job (and, when overwriting, all older archives) goes."""
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        written = sorted(x for m in messages if m for x in m.names)
        older = self._names(fs, root)
        with fs.open_output_stream(f"{root}/.{self.job}") as file:
            file.write(json.dumps(written).encode())
        fs.move(f"{root}/.{self.job}", f"{root}/{MANIFEST}{self.job}.json")
        old = lambda x: self.overwrite and (x.startswith(MANIFEST) or x.endswith((".warc", ".warc.gz")))
        # manifests first: what no manifest lists is not read
        for name in sorted(x for x in older if x not in written and (x.startswith(self.job) or old(x))):
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages):
        fs, root = file_system(self.path)
        for name in self._names(fs, root):
            if name.startswith((self.job, f".{self.job}")):
                fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """Options: path; payload (``false`` leaves payloads null and undecoded); pushdown, for frames that are read once; roll_bytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", self.options.get("pushdown", "false") == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("roll_bytes", 256 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _base32(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1's 40 hex digits: five hex digits are four base32 digits."""
    digits = [F.conv(F.conv(F.substring(hex_digest, i, 5), 16, 10), 10, 32) for i in range(1, 41, 5)]
    return F.translate(F.concat(*(F.lpad(d, 4, "0") for d in digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, key: str, url: str, payload: str, min_revisit_bytes: int = 0, salts: int = 16, max_bits: int = 1 << 25) -> DataFrame:
    """pages as records to write: of equal payloads of at least min_revisit_bytes the smallest key is the response, the others revisit it.

    A null payload is an empty one. Rows that share the smallest key are all responses; a row
    without a key revisits a response that has one, else is a response. Equal means equal
    SHA-256. Groups are found by a pre-aggregated count. Only rows whose digest a bit array of the repeated
    ones holds are shuffled: they meet one row for each repeated payload and salt, so a payload that a
    third of all pages share is spread too. Beyond max_bits all rows are.
    """
    body = F.coalesce(F.encode(F.col(f"`{payload}`"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("target_uri"), body.alias("payload"))
    rows = rows.withColumns({"same": F.unhex(F.sha2("payload", 256)), "payload_bytes": F.length("payload").cast("long")})
    groups = rows.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("same").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = cut(groups.select("same", "first"))
    bits = BitArray(groups.select(F.xxhash64("same").alias("hash")), max_bits)
    repeated = let(bits.literal(), lambda words: bits.holds(words, F.xxhash64("same"))) if bits.fits else F.lit(True)
    spread = groups.select("same", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.where(repeated).withColumn("salt", F.pmod(F.xxhash64("key", "target_uri"), F.lit(salts)).cast("int")).join(spread, ["same", "salt"], "left").drop("salt")
    joined = salted.unionByName(rows.where(~repeated).withColumn("first", F.lit(None).cast("long"))) if bits.fits else salted
    refers = F.when(F.coalesce(F.col("key") != F.col("first"), F.col("first").isNotNull()), F.col("first"))
    return joined.select(
        "key",
        F.concat(F.lit("<urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("none")), F.lit(">")).alias("record_id"),
        F.when(refers.isNotNull(), "revisit").otherwise("response").alias("warc_type"),
        "target_uri",
        _base32(F.upper(F.sha1("payload"))).alias("payload_digest"),
        F.when(refers.isNotNull(), F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">"))).alias("refers_to"),
        "payload_bytes",
        F.when(refers.isNull(), F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, path: str, roll_bytes: int = 256 << 20, mode: str = "append") -> None:
    """Write records to path: beside the archives that are there, or (mode overwrite) in their place."""
    register(records.sparkSession)
    records.select(*WRITE_COLUMNS).write.format("warc").mode(mode).option("path", path).option("roll_bytes", roll_bytes).save()


def read_archives(spark: SparkSession, path: str, payload: bool = True, where: str | None = None) -> DataFrame:
    """Records of archives. A condition given as where is taken into the scan as far as it is on header fields.

    Spark keeps filters that a Python source took in with the loaded frame, so that a second query
    on the same frame would see them; frames without where take none in.
    """
    register(spark)
    out = spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("pushdown", str(where is not None).lower()).load()
    return out if where is None else out.where(where)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None) -> DataFrame:
    """Write pages to archives under path (default: the shared folder) and return what the archives say of each page.

    Responses and revisits are read apart, by the record type, which the scan takes in: the digest and
    length of a response are taken anew from the payload that was read back; those of a revisit from
    its headers, and of a response only headers are parsed then. An empty table gives empty archives
    and no rows. Archives that path holds already are replaced.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(plan_records(pages, key, url, payload), path, mode="overwrite")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")

    def told(records: DataFrame, size: Column, digest: Column) -> DataFrame:
        return records.select(number(F.col("record_id")).alias(key), size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))

    responses = read_archives(spark, path, where="warc_type = 'response'")
    revisits = read_archives(spark, path, payload=False, where="warc_type = 'revisit'")
    return told(responses, F.length("payload"), _base32(F.upper(F.sha1("payload")))).unionByName(told(revisits, F.col("payload_bytes"), F.col("payload_digest")))
