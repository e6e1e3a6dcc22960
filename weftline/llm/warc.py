"""A dictionary-compressed WARC writer and reader.

Pages become WARC records: the first page (by id) of equal payloads is a response,
the others revisit it. An archive file starts with a skippable frame that holds a
Zstandard dictionary built from the records, and each record is a frame of its own,
so that a record can be read without those before it. Archives are written by tasks
into a folder that all executors see, each under a name of its own attempt and then
moved to its final name, so a task that is run again leaves one whole file.

Defined cases: a null payload counts as empty; null ids are written and come back
null, and are the last choice for a response; rows that repeat a response's id and
payload are responses too; an empty table gives no archives; fewer than 16 records of
64 bytes or more are written without a dictionary. Only the named columns are read. Ids are integers.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, shared_dir

#: The skippable frame that holds a dictionary, in WARC files compressed with Zstandard.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528


def plan(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(page_id, digest, record_type, refers_to, payload_bytes) of distinct ids and payloads, without the payloads.

    The response is the smallest id of those with the payload, and each row that has
    this id. A payload under `least` bytes is always a response.
    """
    payload = _payload(payload_col)
    ids = pages.select(F.col(id_col).alias("page_id"), F.sha1(payload).alias("digest"), (F.length(payload) < least).alias("short"), F.length(payload).alias("payload_bytes")).distinct()
    ids = cut(ids)
    first = ids.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"))
    kind = F.when(F.col("short") | F.col("page_id").eqNullSafe(F.col("first")), "response").otherwise("revisit")
    return ids.join(first, F.col("digest") == F.col("d")).select("page_id", "digest", kind.alias("record_type"), F.when(kind == "revisit", F.col("first")).alias("refers_to"), "payload_bytes")


def _payload(payload_col: str) -> Column:
    return F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")


def prepared(pages: DataFrame, planned: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to). Payloads are shuffled once, by id, so that no payload is hot."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), _payload(payload_col).alias("payload"), F.sha1(_payload(payload_col)).alias("digest"))
    p = planned.select(F.col("page_id").alias("pid"), F.col("digest").alias("pd"), "record_type", "refers_to")
    return src.join(p, F.col("page_id").eqNullSafe(F.col("pid")) & (F.col("digest") == F.col("pd"))).select("page_id", "url", "payload", "digest", "record_type", "refers_to")


def train(pages: DataFrame, planned: DataFrame, id_col: str = "page_id", payload_col: str = "html", size: int = 64 << 10, samples: int = 1000, longest: int = 32 << 10) -> bytes:
    """A dictionary from at most `samples` responses of 64 bytes or more, the first by digest, each up to `longest` bytes; b"" if there are too few.

    Records that aren't chosen are compressed with the same dictionary all the same.
    """
    chosen = planned.filter("record_type = 'response' AND payload_bytes >= 64").orderBy("digest", "page_id").limit(samples).select(F.col("page_id").alias("pid"), F.col("digest").alias("pd"))
    src = pages.select(F.col(id_col).alias("page_id"), _payload(payload_col).alias("payload")).withColumn("digest", F.sha1("payload"))
    src = src.join(F.broadcast(chosen), F.col("page_id").eqNullSafe(F.col("pid")) & (F.col("digest") == F.col("pd"))).dropDuplicates(["digest"])
    texts = sorted({bytes(r["head"]) for r in src.select(F.substring("payload", 1, longest).alias("head")).collect()})
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, texts)) // 16)), texts).as_bytes() if len(texts) >= 16 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """The record's bytes before compression; a revisit has no payload but names its length."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{b32}", f"Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Of a record: its headers, its HTTP payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields | {"payload": body.partition(b"\r\n\r\n")[2]}


def write(rows: DataFrame, folder: str, dictionary: bytes, level: int = 9) -> DataFrame:
    """Writes `prepared` rows to `folder`, an archive per partition; returns (archive, records, bytes). Nothing is written before an action."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, root = fs.FileSystem.from_uri(folder)
        attempt, final = f"{root}/.{uuid.uuid4().hex}", f"{root}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True).compress
        records = size = 0
        out = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(attempt)
                    if dictionary:
                        out.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
                frame = pack(record(*row))
                out.write(frame)
                records, size = records + 1, size + len(frame)
        if out is not None:
            out.close()
            files.move(attempt, final)
            yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

    return rows.mapInArrow(run, "archive string, records long, bytes long")


def frame_end(buffer: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, from its header and its blocks' headers."""
    if struct.unpack_from("<I", buffer, at)[0] != FRAME_MAGIC:
        raise ValueError(f"no frame at {at}")
    flags = buffer[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(buffer[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * (flags >> 2 & 1)


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    buffer, at, d = memoryview(content), 0, None
    if len(content) >= 8 and struct.unpack_from("<I", buffer)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", buffer, 4)[0]
        d, at = zstandard.ZstdCompressionDict(bytes(buffer[8 : 8 + n])), 8 + n
    unpack = zstandard.ZstdDecompressor(dict_data=d).decompress
    while at < len(content):
        end = frame_end(buffer, at)
        yield unpack(buffer[at:end])
        at = end


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the archives in a folder.

    A response's length and digest are those of the payload read; a revisit's come from
    its headers.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no page, no archive
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[10:-1])
        out: list[tuple] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        for b in batches:
            for k in range(b.num_rows):
                for raw in frames(b.column(0)[k].as_py()):
                    r = parsed(raw)
                    seen = r["WARC-Type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() if seen else r["WARC-Payload-Digest"][5:]
                    if seen and digest != r["WARC-Payload-Digest"][5:]:
                        raise ValueError(f"digest of {r['WARC-Record-ID']} is wrong")
                    out.append((number(r["WARC-Record-ID"]), r.get("WARC-Target-URI"), len(r["payload"]) if seen else int(r["Payload-Length"]), digest, r["WARC-Type"], number(r.get("WARC-Refers-To")), r["payload"] if seen else None))
                    size += len(raw)
                    if size > 4 << 20:
                        yield batch()
                        out, size = [], 0
        if out:
            yield batch()

    return files.mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes all pages and returns (archive, records, bytes), a row per archive."""
    planned = cut(plan(pages, id_col, payload_col, least))
    dictionary = train(pages, planned, id_col, payload_col)
    return cut(write(prepared(pages, planned, id_col, url_col, payload_col), folder, dictionary))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder).drop("payload", "url")


OP3_SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, (i * 5) // 4 + 1, 2))::BIGINT >> (3 - (i * 5) % 4)) & 31))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
