"""WARC archives of pages, a two-level capture index over them, and range reads of the captures looked up.

Records are gzip members of their own, so each can be read alone from its offset. The index sorts the captures by
their reversed-host key into compressed blocks; a sparse directory keeps each block's first key. A lookup searches
the directory, then the block, and reads the record's bytes from the archive.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docstrata.llm.store import materialize, new_path

#: An empty gzip member, which the writer puts between records.
GAP = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
RECORDS_A_FILE = 4096
BLOCK_ROWS = 512
#: The directory has at most so many blocks besides one a partition, of keys cut to so many characters.
MOST_BLOCKS, KEY_CUT = 100_000, 64
SHA1 = "sha1:"


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, then port, path and query; scheme, user and fragment are left out. Null: '-'."""
    if url is None:
        return "-"
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m:
        return url.split("#")[0] or "-"
    return ",".join(reversed(m[1].lower().split("."))) + (m[2] or "") + ")" + (m[3] or "/")


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (HTTP headers alone) if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: {SHA1}{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every page. Of equal payloads of ``min_bytes`` or more, the largest id is the response.

    The others revisit it; rows that share the largest id, or have no id at all among them, are responses. A null
    html is an empty payload. Files hold at most RECORDS_A_FILE records. Equal payloads are found by SHA-1: digests
    meet their largest id in a sum and a join that Spark may split, so a payload of very many pages is no hot spot.
    """
    p = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col], F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    groups = p.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter("n > 1 and top is not null").select("digest", "top")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top"))
    rows = p.join(groups, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([pa.array([record(*x) for x in zip(*(c.to_pylist() for c in part.columns))], pa.binary())], ["value"])

    out = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    # members are bytes, not characters; as a separator in this charset, the empty member is written as it is
    out.write.option("encoding", "ISO-8859-1").option("lineSep", GAP.decode("latin-1")).option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def members(content: memoryview, step: int = 1 << 14) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and bytes of each gzip member that isn't empty."""
    at = 0
    while at < len(content):
        unpack, out, fed = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if fed >= len(content):
                raise ValueError("the archive ends within a record")
            out.append(unpack.decompress(content[fed : fed + step]))
            fed += step
        end = min(fed, len(content)) - len(unpack.unused_data)
        if text := b"".join(out):
            yield at, end - at, text
        at = end


def parse(text: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a record, by lower-case name, and its block."""
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(key, file, offset, length) of every record in the archives under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows = [(url_key(parse(text)[0].get("warc-target-uri")), at, n) for at, n, text in members(memoryview(content.as_buffer()))]
                file = name.as_py().rpartition("/")[2]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([file] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["key", "file", "offset", "length"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, "key string, file string, offset long, length long")


class CaptureIndex:
    """Compressed blocks of captures in order of their keys, and the sparse directory of the blocks' first keys."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        found = materialize(captures(spark, path), "captures")
        size = max(BLOCK_ROWS, math.ceil(found.count() / MOST_BLOCKS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, k, held = TaskContext.get().partitionId(), 0, []

            def block() -> pa.RecordBatch:
                data = zlib.compress("\n".join("\t".join(map(str, r)) for r in held).encode())
                return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), pa.array([held[0][0]], pa.string()), pa.array([data], pa.binary())], ["block", "first_key", "data"])

            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    held.append(r)
                    if len(held) == size:
                        yield block()
                        k, held = k + 1, []
            if held:
                yield block()

        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = found.withColumn("key", F.regexp_replace("key", r"[\t\n]", " ")).repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
        self.blocks = materialize(ordered.mapInArrow(run, "block long, first_key string, data binary"), "capture-blocks")
        #: Bounded: at most MOST_BLOCKS blocks and one more a partition, of cut keys.
        self.directory = sorted((r[0], r[1]) for r in self.blocks.select("block", F.substring("first_key", 1, KEY_CUT)).collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Captures (key, file, offset, length) whose key is among ``keys`` (one column of distinct keys)."""
        ids, firsts = [b for b, _ in self.directory], [k for _, k in self.directory]

        def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for key in b.column(0).to_pylist():
                    cut = key[:KEY_CUT]
                    for k in range(max(0, bisect.bisect_left(firsts, cut) - 1), bisect.bisect_right(firsts, cut)):
                        rows.append((ids[k], key))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["block", "key"])

        def inside(wanted: pa.Table, block: pa.Table) -> pa.Table:
            out = []
            for data in block.column("data"):
                lines = [x.split("\t") for x in zlib.decompress(data.as_buffer()).decode().split("\n")]
                order = [x[0] for x in lines]
                for key in wanted.column("key").to_pylist():
                    out += lines[bisect.bisect_left(order, key) : bisect.bisect_right(order, key)]
            return pa.table({"key": pa.array([x[0] for x in out], pa.string()), "file": pa.array([x[1] for x in out], pa.string()), "offset": pa.array([int(x[2]) for x in out], pa.int64()), "length": pa.array([int(x[3]) for x in out], pa.int64())})

        asked = keys.toDF("key").mapInArrow(where, "block long, key string")
        return asked.groupBy("block").cogroup(self.blocks.select("block", "data").groupBy("block")).applyInArrow(inside, "key string, file string, offset long, length long")

    def read(self, found: DataFrame) -> DataFrame:
        """Read the records of captures by their byte ranges: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

        The payload of a revisit is null; its size and digest are those of the full payload. A response whose bytes
        don't have the digest it states is an error.
        """
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(path)
            name, file = None, None
            for b in batches:
                rows = []
                for f, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                    if f != name:
                        name, file = f, store.open_input_file(f"{root}/{f}")
                    fields, block = parse(zlib.decompress(file.read_at(length, offset), 31))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix(SHA1)
                    if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
                    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    rows.append((number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to")), payload if fields["warc-type"] == "response" else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

        ordered = found.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / (4 << 20))).sortWithinPartitions("file", "offset")
        return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_roundtrip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to archives, index them, look every page's URL up in the index and read its captures back.

    One row a page, as ``CaptureIndex.read`` gives it. Pages that share a URL, or lack one, are all found under it;
    repeated rows come back as often as they were written; an empty table gives no row.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path, min_bytes, id_col, url_col, html_col)
    index = CaptureIndex(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [url_key(None if u is None else _line(u)) for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    keys = pages.select(F.col(url_col).cast("string")).mapInArrow(run, StructType([StructField("key", StringType())])).distinct()
    return index.read(index.lookup(keys))
