"""WARC archives: records written and read through Spark's own file sources, and transactions assembled from them.

Writing: a record ends with CR LF CR LF, which is the separator of Spark's text writer, so records of any content make valid WARC files
on any file system Spark writes to (gzip over whole files). Every capture has a request, a response or revisit, and a metadata
record; the first and the last name the second in WARC-Concurrent-To. Of equal payloads of at least `least` bytes, the one with the
largest key is stored, under the record id <urn:capture:KEY>; the others are revisit records without payload that refer to it by that id. Other records' ids also hold the row's number at writing, which
is the same each time that files are read. Reading: files are bounded by records and, through the longest payload, by bytes, read as binary and parsed once by Content-Length, so a payload may hold any bytes of UTF-8.
Assembly brings the three kinds together by the identifiers in one shuffle and emits one nested row per capture.

Defined results: a null payload is an empty one; null keys are the smallest and never referred to by others with keys; rows that tie for the
largest key are all responses, of which the first is referred to; repeated rows are captures of their own; a very long payload makes a file of its own; columns other than key, payload and uri are
left out, whatever their names; an empty table makes no captures.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cloakframe.llm.common import table, written
from cloakframe.sources.scratch import scratch_path

LEAST_BYTES, RECORDS_A_FILE = 1000, 3000
#: A file has at most so many bytes before it is compressed, or one record.
FILE_BYTES = 1 << 28
CRLF, END = "\r\n", "\r\n\r\n"
SCHEMA = "warc_type string, record_id string, concurrent_to string, target_uri string, refers_to string, payload_digest string, x_key string, block_bytes long, block_sha1 string, profile string"


def captures(rows: DataFrame, key: str, payload: str, uri: str, least: int = LEAST_BYTES) -> DataFrame:
    """key, uri, payload, at (the row's number), digest, n_bytes, refers_to (the stored capture's key, for those that revisit) and named (whether others refer to it)."""
    text = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    base = rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{uri}`").cast("string"), F.lit("")).alias("uri"), text.alias("payload"))
    base = base.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "n_bytes": F.octet_length("payload").cast("long"), "at": F.monotonically_increasing_id()})
    # counted without the payloads; the map holds digests that occur more than once only
    same = base.where(F.col("n_bytes") >= least).groupBy("digest", "key").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    tops = same.groupBy("digest").agg(F.max(F.struct("key", "n", "at")).alias("__top"), F.sum("n").alias("__n")).where("__n > 1 AND __top.key IS NOT NULL").drop("__n")
    out = base.join(written(tops, "stored"), "digest", "left")  # written, so that the join can split a hot digest
    is_top = F.col("key").eqNullSafe(F.col("__top.key"))
    return out.withColumns({"refers_to": F.when(~is_top, F.col("__top.key")), "named": F.coalesce(is_top & ((F.col("__top.n") == 1) | (F.col("at") == F.col("__top.at"))), F.lit(False)) & F.col("__top").isNotNull()}).drop("__top")


def _record(kind: Column, rid: Column, extra: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), rid, F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z")]
    for name, value in extra:
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{CRLF}{name}: "), value)).otherwise(""))
    return F.concat(*lines, F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def records(found: DataFrame) -> DataFrame:
    """One column `value`: three records of each capture, without their ends."""
    named = F.concat(F.lit("<urn:capture:"), F.col("key").cast("string"), F.lit(">"))
    own = lambda part: F.concat(F.lit("<urn:capture:"), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit(":"), F.col("at").cast("string"), F.lit(f":{part}>"))
    rid = lambda part: F.when(F.col("named"), named).otherwise(own(part)) if part == "main" else own(part)
    revisit = F.col("refers_to").isNotNull()
    uri = ("WARC-Target-URI", F.regexp_replace("uri", r"[\r\n]", " "))
    key = ("X-Key", F.col("key").cast("string"))
    main = _record(
        F.when(revisit, "revisit").otherwise("response"), rid("main"),
        [uri, key, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:capture:"), F.col("refers_to").cast("string"), F.lit(">")))), ("Content-Type", F.when(~revisit, "text/html; charset=utf-8"))],
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    to = ("WARC-Concurrent-To", rid("main"))
    request = _record(F.lit("request"), rid("request"), [uri, to, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), uri[1], F.lit(" HTTP/1.1")))
    metadata = _record(F.lit("metadata"), rid("metadata"), [uri, to, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payload-bytes: "), F.col("n_bytes").cast("string")))
    return found.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_archives(found: DataFrame, path: str, per_file: int = RECORDS_A_FILE) -> None:
    most = found.select("n_bytes").agg(F.max("n_bytes")).first()[0] or 0
    per_file = max(1, min(per_file, FILE_BYTES // (most + 4096)))
    records(found).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        n = int(headers["content-length"])
        yield headers, data[head + 4 : head + 4 + n]
        at = head + 4 + n + 4


def read_archives(spark: SparkSession, path: str, with_block: bool = False) -> DataFrame:
    """One row per record: its headers, its block's size and SHA-1 and, if asked or for metadata, the block."""
    schema = f"{SCHEMA}, block binary"
    names = ("warc-type", "warc-record-id", "warc-concurrent-to", "warc-target-uri", "warc-refers-to", "warc-payload-digest", "x-key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = []
                for h, block in parse(data):
                    rows.append((*(h.get(k) for k in names), len(block), hashlib.sha1(block).hexdigest(), h.get("warc-profile"), block if with_block or h["warc-type"] == "metadata" else None))
                if rows:
                    kinds = [*[pa.string()] * 7, pa.int64(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(work, schema)


def assembled(read: DataFrame) -> DataFrame:
    """One nested row per capture: key, main (response or revisit), request, metadata; missing parts are null. Archives are parsed once, and a capture's records meet in one group of three."""
    fields = [c for c in read.columns if c != "block"]
    kind = F.when(F.col("warc_type").isin("response", "revisit"), "main").otherwise(F.col("warc_type"))
    rows = read.select(F.coalesce("concurrent_to", "record_id").alias("id"), kind.alias("kind"), F.struct(*fields).alias("rec"), F.struct(*fields, F.col("block").cast("string").alias("text")).alias("noted"))
    part = lambda name, what: F.first(F.when(F.col("kind") == name, F.col(what)), ignorenulls=True).alias(name)
    whole = rows.groupBy("id").agg(part("main", "rec"), part("request", "rec"), part("metadata", "noted")).where("main IS NOT NULL")
    return whole.select(F.col("main.x_key").cast("long").alias("key"), "main", "request", "metadata")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "html", "url"), path)
    return assembled(read_archives(spark, path)).select(
        F.col("key").alias("page_id"),
        F.regexp_extract("metadata.text", r"payload-bytes: (\d+)", 1).cast("long").alias("payload_bytes"),
        F.regexp_extract("main.payload_digest", "sha1:(.*)", 1).alias("payload_digest"),
        F.col("main.warc_type").alias("record_type"),
        F.regexp_extract("main.refers_to", r"<urn:capture:(-?\d+)>", 1).cast("string").alias("__to"),
        (F.col("main.block_sha1") == F.regexp_extract("main.payload_digest", "sha1:(.*)", 1)).alias("stored_whole"),
        F.col("request.target_uri").alias("request_uri"),
    ).select("page_id", "payload_bytes", "payload_digest", "record_type", F.expr("CASE WHEN __to <> '' THEN cast(__to AS bigint) END").alias("refers_to"), "stored_whole", "request_uri")


QUERIES = {"op5_warc": op5_warc}
ORACLE_SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
tops AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT p.page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN top IS NOT NULL AND p.page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM top THEN top END AS refers_to,
  NOT (top IS NOT NULL AND p.page_id IS DISTINCT FROM top) AS stored_whole, url AS request_uri
FROM p LEFT JOIN tops ON p.html = tops.html"""
}
