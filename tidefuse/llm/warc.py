"""WARC archives: writing captures, reading records, assembling transactions.

Every page is a capture of three records: its request, its response (or, when a
larger page_id holds the same long payload, a revisit) and its metadata. The
request and the metadata name the response in WARC-Concurrent-To. Reading
follows the Content-Length of each record; assembly joins the three kinds of
records through the concurrent-to identifiers to one nested row per capture.

Archives are gzip files of a bounded number of captures, written by Spark's text
writer below the shared folder. Null html is an empty payload. Rows of equal
page_id are captures of their own; equal long payloads under the largest
page_id are all responses. A null page_id never becomes a revisit's target.
An empty table gives no captures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_REVISIT = 1000
CAPTURES_PER_FILE = 1000
DATE = "2024-01-01T00:00:00Z"
SALTS = 16
RECORD = ("kind string, record_id string, concurrent_to string, uri string, page_id long, refers_to long, "
          "payload_bytes long, payload_digest string, declared_digest string, fields map<string,string>")


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages with payload, digest, size and refers_to (the page a revisit refers to, or null)."""
    captured = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", "").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    captured = captured.withColumn("size", F.octet_length("payload").cast("long")) \
        .withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    long_ = captured.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    target = long_.groupBy("digest", "size").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n"))
    # A payload that a large part of all pages share is met in SALTS groups.
    target = target.where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = captured.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(target.drop("n"), ["digest", "size", "salt"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("target").eqNullSafe(F.col("page_id")), F.col("target"))) \
        .drop("salt", "target")


def record(kind: str, uid: Column, block: Column, content_type: str, *headers: Column) -> Column:
    """One record: headers, an empty line, the block, and the two line ends that close it."""
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nContent-Type: {content_type}\r\n"),
        F.lit("WARC-Record-ID: <"), uid, F.lit(f":{'response' if kind == 'revisit' else kind}>\r\n"), *headers,
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n")]
    return F.concat(*lines)


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Writes the archives of all pages below ``path``."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    uid = F.concat(F.lit("urn:capture:"), page, F.lit(":"), F.col("uid"))
    uri = F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n"))
    other = F.concat(F.lit("WARC-Concurrent-To: <"), uid, F.lit(":response>\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    refers = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                            "WARC-Refers-To: <urn:capture:"), F.col("refers_to").cast("string"), F.lit(">\r\n"))
    get = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))
    size = F.concat(F.lit("payloadBytes: "), F.col("size").cast("string"), F.lit("\r\n"))
    main = F.when(F.col("refers_to").isNull(), record("response", uid, F.concat(http, F.col("payload")),
                                                      "application/http;msgtype=response", uri, digest)) \
        .otherwise(record("revisit", uid, http, "application/http;msgtype=response", uri, digest, refers))
    capture = F.concat(record("request", uid, get, "application/http;msgtype=request", uri, other), main,
                       record("metadata", uid, size, "application/warc-fields", uri, other))
    decided = decide(pages, least).withColumn("uid", F.monotonically_increasing_id().cast("string"))
    # The writer adds the last line end of each capture.
    decided.select(F.regexp_replace(capture, r"\n\z", "").alias("value")).write.option(
        "compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        begin = end + 4
        end = begin + int(headers["content-length"])
        yield headers, data[begin:end]
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record is not closed at byte {end}")
        at = end + 4


def read(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """All records of the archives below ``path``; ``keep_payload`` adds the payload of responses."""
    schema = RECORD + (", payload binary" if keep_payload else "")

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in schema.split(", ")]
        kinds = [pa.string()] * 4 + [pa.int64()] * 3 + [pa.string()] * 2 + [pa.map_(pa.string(), pa.string())]
        kinds += [pa.binary()] * keep_payload
        for batch in batches:
            for content in batch.column(0):
                unzip = zlib.decompressobj(31)
                rows = []
                for h, block in parsed(unzip.decompress(content.as_py()) + unzip.flush()):
                    payload, fields, size, digest = None, {}, None, None
                    if h["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    elif h["warc-type"] == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if x)
                    name = h["warc-record-id"].strip("<>")
                    refers = h.get("warc-refers-to", "").strip("<>").rpartition(":")[2]
                    said = h.get("warc-payload-digest")
                    rows.append((h["warc-type"], name, h.get("warc-concurrent-to", "").strip("<>") or None,
                                 h.get("warc-target-uri"), number(name.split(":")[2]), number(refers), size, digest,
                                 said and said.partition(":")[2], list(fields.items()), payload)[:len(names)])
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id and the nested request, response (or revisit) and metadata.

    A capture without a request or metadata record has null there.
    """
    def nested(kind: str) -> DataFrame:
        part = records.where(F.col("kind") == kind)
        return part.select(F.col("concurrent_to").alias("capture_id"), F.struct(*records.columns).alias(kind))

    main = records.where("kind IN ('response', 'revisit')")
    main = main.select(F.col("record_id").alias("capture_id"), F.struct(*records.columns).alias("response"))
    return main.join(nested("request"), "capture_id", "left").join(nested("metadata"), "capture_id", "left")
