"""WARC archives: write records with an index, then read selected records by coalesced byte ranges.

Each task writes archives of its own (one gzip member a record) and returns an index row for each record:
file, offset, length, URL, digest.  Files carry the attempt's number and the index is written through Spark,
so a task that is lost and run again leaves at most a file that no index row names.  Equal payloads are
stored once; later ones are revisit records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, new_path, ship, slices

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = EPOCH) -> bytes:
    """One record as a gzip member: a response, or a revisit if it refers to another page."""
    uri = (url or "urn:x-unknown").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of one record; `payload` is empty for revisits, `payload_bytes` is the full payload's."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    stored, told = fields["WARC-Type"] == "response", fields["WARC-Payload-Digest"].removeprefix("sha1:")
    made = digest(payload) if stored else told
    number = lambda name: None if name not in fields or fields[name].endswith(":none>") else int(fields[name].rpartition(":")[2][:-1])
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload_digest": made,
        "payload_bytes": len(payload) if stored else int(stated["Content-Length"]),
        "payload": payload,
        "intact": made == told and (not stored or len(payload) == int(stated["Content-Length"])),
    }


def revisits(keys: DataFrame) -> DataFrame:
    """(page_id, payload_key, refers_to) of pages whose payload a page with a smaller id has."""
    first = keys.groupBy("payload_key").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return keys.join(first, "payload_key").where("page_id > refers_to").select("page_id", "payload_key", "refers_to").distinct()


def _one_response(told: DataFrame, keys: DataFrame, broadcast_rows: int) -> DataFrame:
    """`told` where of responses that repeat both id and payload one stays a response; the others revisit it."""
    twice = cut(keys.where("page_id is not null").groupBy("page_id", "payload_key").count().where("count > 1").select("page_id", "payload_key"), "repeated-pages")
    n = twice.count()
    if not n:
        return told
    small = lambda df: F.broadcast(df) if n <= broadcast_rows else df
    same = ["page_id", "payload_key"]
    rows = cut(told.join(small(twice), same, "left_semi").withColumn("row", F.monotonically_increasing_id()), "repeated-rows")
    head = rows.groupBy(*same).agg(F.min("row").alias("head"))
    refers = F.when(F.col("refers_to").isNull() & (F.col("row") != F.col("head")), F.col("page_id")).otherwise(F.col("refers_to"))
    rows = rows.join(small(head), same).withColumn("refers_to", refers).select(told.columns)
    return told.join(small(twice), same, "left_anti").union(rows)


def write(pages: DataFrame, folder: str, least_bytes: int = 0, broadcast_rows: int = 100_000, roll_bytes: int = 256_000_000) -> DataFrame:
    """Archives of (page_id, url, html) in `folder`; returns the written index.

    Null html is an empty payload.  Of rows that repeat both id and payload one is the response, unless a smaller
    id has it, and the others revisit it; rows without an id are responses.  Other columns are not read.  An empty
    table gives an empty index.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_key", F.unhex(F.sha2("payload", 256)))
    keys = cut(pages.where(F.octet_length("payload") >= least_bytes).select("page_id", "payload_key"), "payload-keys")
    again = cut(revisits(keys), "revisits")
    few = again.count() <= broadcast_rows  # 48 bytes a row; beyond that the join shuffles
    told = pages.join(F.broadcast(again) if few else again, ["page_id", "payload_key"], "left").select("page_id", "payload_key", "url", "payload", "refers_to")
    told = _one_response(told, keys, broadcast_rows).drop("payload_key")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        filesystem, base = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        number, out, name, offset = 0, None, "", 0
        for batch in batches:
            for part in slices(batch, "payload"):
                index = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None or offset > roll_bytes:
                        if out is not None:
                            out.close()
                        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                        out, offset, number = filesystem.open_output_stream(f"{base}/{name}", compression=None), 0, number + 1
                        info = gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:{name}>\r\nWARC-Date: {EPOCH}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), 6, mtime=0)
                        out.write(info)
                        offset = len(info)
                    data = record(page_id, url, payload, refers_to)
                    out.write(data)
                    index.append((page_id, url, name, offset, len(data), digest(payload), "response" if refers_to is None else "revisit", refers_to))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), TYPES, strict=True)], names=NAMES)
        if out is not None:
            out.close()

    return cut(told.mapInArrow(store, INDEX), "warc-index")


NAMES = [c.split(" ")[0] for c in INDEX.split(", ")]
TYPES = [pa.int64() if c.endswith(" long") else pa.string() for c in INDEX.split(", ")]


def coalesce(spans: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int]]:
    """(start, end, records) of reads that cover sorted (offset, length) spans: gaps up to `gap` are read over."""
    reads: list[list[int]] = []
    for offset, length in spans:
        if reads and offset - reads[-1][1] <= gap and offset + length - reads[-1][0] <= most:
            reads[-1][1] = max(reads[-1][1], offset + length)
            reads[-1][2] += 1
        else:
            reads.append([offset, offset + length, 1])
    return [tuple(r) for r in reads]


def read(index: DataFrame, folder: str, gap: int = 65_536, most: int = 8_000_000, region: int = 8_000_000) -> DataFrame:
    """Fields of the records that `index` selects, from the archives alone, with their payloads.

    Index rows meet by file and `region` of it, so a task holds one region's records, however large a file is.
    Index rows are tiny, so the number of tasks comes from the archives' bytes: about two regions each.
    """
    ship(index.sparkSession)
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, intact boolean"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split(" ")[1]] for c in schema.split(", ")]

    def fetch(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        spans = sorted((o, n) for b in batches for o, n in zip(b.column("offset").to_pylist(), b.column("length").to_pylist(), strict=True))
        with filesystem.open_input_file(f"{base}/{key[0].as_py()}") as source:
            at = 0
            for start, end, count in coalesce(spans, gap, most):
                source.seek(start)
                data = source.read(end - start)
                found = [parse(data[o - start : o - start + n]) for o, n in spans[at : at + count]]
                at += count
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, kinds, strict=True)], names=names)

    narrow = index.select("file", F.floor(F.col("offset") / region).alias("region"), "offset", "length")
    total = index.agg(F.sum("length")).collect()[0][0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, total // (2 * region))
    return narrow.repartition(tasks, "file", "region").groupBy("file", "region").applyInArrow(fetch, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """The query's columns, read back from the archives; responses' digest and size are those of the payload read."""
    folder = new_path(pages.sparkSession, "warc")
    found = read(write(pages, folder), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
