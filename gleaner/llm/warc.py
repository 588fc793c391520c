"""Operator 3: WARC archives, normalised from monolithic gzip to a member per record.

Writers often compress a whole archive as one gzip stream, which can only be read
from its start.  The normaliser inflates such a stream once, front to back in
bounded pieces, writes every record as a gzip member of its own, and writes a
sidecar index (offset, length and identity of each record); readers then fetch
single records.  Payloads of at least ``MIN_REVISIT`` bytes that occur again are
written as revisit records that name the first.

Files live in the shared folder.  A task names its file after itself and reports
it in a table; only reported files are read, so files of failed attempts are
never seen, and a lost executor costs the tasks it ran.

Defined cases: a null html is an empty payload; a null url is the empty text; rows
with a null page_id sort after all others and refer like them; equal page_ids with
equal payloads are all responses; payloads of any length; an empty table gives an
empty result (and no files); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import table_path
from gleaner.llm.util import drop_path, open_fs, scratch, store

MIN_REVISIT = 100
PIECE = 1 << 18
LEVEL = 6


# --- records ----------------------------------------------------------------------

def record(page_id, url, payload: bytes, digest: str, n_bytes: int, refers_to) -> bytes:
    """One WARC record; a revisit has no payload but carries its digest and size."""
    kind = "response" if refers_to is None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{digest}\n{kind}")
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {n_bytes}", f"X-Page-Id: {'' if page_id is None else page_id}",
            "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    if kind == "revisit":
        head.insert(5, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(6, f"WARC-Refers-To: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def header_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}


def records(chunks):
    """(header bytes, whole record) of every record in a stream of byte chunks;
    only the record at hand is held."""
    held = bytearray()
    chunks = iter(chunks)

    def fill(n) -> bool:
        while len(held) < n:
            c = next(chunks, None)
            if c is None:
                return False
            held.extend(c)
        return True

    while fill(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not fill(seen + 1):
                raise ValueError("a record's header is cut short")
        head = bytes(held[:end])
        size = end + 4 + int(header_of(head)["Content-Length"]) + 4
        if not fill(size):
            raise ValueError("a record is cut short")
        yield head, bytes(held[:size])
        del held[:size]


def inflate(stream):
    """The bytes of a gzip stream (one member or several), in bounded pieces."""
    z = zlib.decompressobj(31)
    while data := stream.read(PIECE):
        while data:
            out = z.decompress(data, PIECE)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    if out := z.flush():
        yield out


def normalise(source, target) -> list[tuple[int, int, dict]]:
    """Rewrite a monolithic archive with a member per record; (offset, length,
    header) of each."""
    index, at = [], 0
    for head, whole in records(inflate(source)):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(whole) + z.flush()
        target.write(member)
        index.append((at, len(member), header_of(head)))
        at += len(member)
    return index


# --- jobs --------------------------------------------------------------------------

def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, n_bytes and refers_to (null: a response)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"),
                        F.sha2(html.cast("binary"), 256).alias("digest"),
                        F.octet_length(html).cast("long").alias("n_bytes"))
    # one pre-aggregated row per payload that occurs again
    first = (rows.where(f"n_bytes >= {MIN_REVISIT}").groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return (rows.join(first, "digest", "left")
            .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first"))


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """One whole-file gzip archive per task; (path, n) of the files."""
    schema = pa.schema([("path", pa.string()), ("n", pa.int64())])

    def run(batches):
        fs, base = open_fs(folder)
        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cols = batch.slice(at, 256).to_pydict()
                for page_id, url, html, digest, size, to in zip(*(cols[c] for c in (
                        "page_id", "url", "html", "digest", "n_bytes", "refers_to"))):
                    if out is None:
                        out, z = fs.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(z.compress(record(page_id, url, html.encode(), digest, size, to)))
                    n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], schema=schema)

    fs, base = open_fs(folder)
    fs.create_dir(base)
    return store(rows.mapInArrow(run, "path string, n long"), "warc-files")


INDEX = "path string, offset long, length long, page_id long, url string, record_type string, refers_to long"


def write_normalised(files: DataFrame, folder: str) -> DataFrame:
    """Normalise every file; the sidecar indexes as one table."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()),
                        ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        for batch in batches:
            for source in batch.column("path").to_pylist():
                fs, base = open_fs(folder)
                path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(source, compression=None) as f, fs.open_output_stream(path, compression=None) as out:
                    index = normalise(f, out)
                rows = [(path, at, n, int(h["X-Page-Id"]) if h["X-Page-Id"] else None, json.loads(f'"{h["WARC-Target-URI"]}"'),
                         h["WARC-Type"], int(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None) for at, n, h in index]
                with fs.open_output_stream(path + ".idx", compression=None) as out:
                    for r in rows:
                        out.write((json.dumps([os.path.basename(r[0]), *r[1:]]) + "\n").encode())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    fs, base = open_fs(folder)
    fs.create_dir(base)
    # a file a task: spread by the files themselves, not by a key
    n = max(1, files.count())
    return store(files.repartition(n).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read every indexed record by its offset: page_id, payload_bytes,
    payload_digest, record_type, refers_to, and whether it holds what it says: a
    revisit does if a response of the page it refers to was read with its digest and size."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("intact", pa.bool_())])

    def run(batches):
        fs, _ = open_fs(folder)
        path, f = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    if f:
                        f.close()
                    path, f = r["path"], fs.open_input_file(r["path"])
                f.seek(r["offset"])
                whole = zlib.decompress(f.read(r["length"]), 31)
                end = whole.find(b"\r\n\r\n")
                h = header_of(whole[:end])
                body = whole[end + 4:-4]
                said = h["WARC-Payload-Digest"].removeprefix("sha256:")
                if h["WARC-Type"] == "response":
                    digest, size = hashlib.sha256(body).hexdigest(), len(body)
                else:
                    digest, size = said, int(h["X-Payload-Length"])
                out.append((r["page_id"], size, digest, h["WARC-Type"], r["refers_to"], r["url"], digest == said))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), schema)], schema=schema)
        if f:
            f.close()

    read = store(index.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                       "refers_to long, url string, intact boolean"), "warc-read")
    # one row per page and payload that were read
    found = (read.where("record_type = 'response'").groupBy("page_id", "payload_digest", "payload_bytes").agg(F.lit(True).alias("found"))
             .withColumnRenamed("page_id", "refers_to"))
    return (read.join(found, ["refers_to", "payload_digest", "payload_bytes"], "left")
            .withColumn("intact", F.when(F.col("record_type") == "revisit", F.col("found").isNotNull()).otherwise(F.col("intact")))
            .select(*read.columns))


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write, normalise; (the index, the folder of the normalised files)."""
    spark = pages.sparkSession
    raw, out = scratch(spark, "warc-raw"), scratch(spark, "warc")
    files = write_monolithic(with_references(pages), raw)
    index = write_normalised(files, out)
    drop_path(spark, raw)
    return index, out


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = archive(spark.read.parquet(table_path(sf_dir, "pages")))
    return read_records(index, folder)


SQL = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id > min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to,
       coalesce(url, '') AS url, true AS intact
FROM (SELECT page_id, url, coalesce(html, '') AS h FROM pages) WINDOW w AS (PARTITION BY h)
"""
