"""WARC archives: write records, read them back, and resolve equal payloads to revisit records.

Headers are shuffled by payload digest; of the records with one digest the smallest id stays a
response and the others become revisit records that name it. Archives are written by Spark's own
text writer, one record a row, so they land in any store the session can write to and a lost task is
simply written again. Their number follows the bytes, whatever the number of shuffle partitions: each
small file costs a store several calls, and on a local disk without Hadoop's native library four child
processes, each of which counts its executor's memory once more until it has started.

Cases: a null payload is an empty one; payloads under ``min_bytes`` are responses always; rows that
repeat the smallest id of their payload are responses too; a null id comes after every id; a null
url writes no WARC-Target-URI. An empty table gives one archive without records.
Other columns are not looked at, whatever their names. A payload is one record, whatever its length up to the
2 GB that a reader of whole files can take.
"""

import math
import zlib

from pyspark.sql import functions as F

from voxstars.sources.staging import shared_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2020-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_id long, record_type string, url string, payload_digest string, refers_to long, payload_bytes long"


def base32_sha1(payload):
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes: eight letters from each 40 bits."""
    hexed = F.sha1(F.encode(payload, "utf-8"))
    letters = []
    for part in range(4):
        bits = F.conv(F.substring(hexed, 1 + 10 * part, 10), 16, 10).cast("long")
        for shift in range(35, -1, -5):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31).cast("int") + 1, 1))
    return F.concat(*letters)


def headers(records, record_id="page_id", url="url", payload="html"):
    """Payload, id, url and digest of each row; nothing else of the table is carried along."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return records.select(
        F.col(record_id).cast("long").alias("record_id"), F.col(url).alias("url"), body.alias("payload")
    ).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )


def resolve_revisits(records, min_bytes=0):
    """Adds ``refers_to``: the smallest id among equal payloads, null where the row is that one.

    Minima are taken in map tasks first, so a payload that fills a third of the rows is one row a
    task. The join back is a merge join whose large partitions Spark splits.
    """
    key = ["payload_digest", "payload_bytes"]
    first = (
        records.select("record_id", *key)
        .filter(F.col("payload_bytes") >= min_bytes)
        .groupBy(*key)
        .agg(F.min("record_id").alias("first_id"))
    )
    again = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    return (
        records.join(first.hint("merge"), key, "left")
        .withColumn("refers_to", F.when(again, F.col("first_id")))
        .drop("first_id")
    )


def _uri(record_id):
    return F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("none")), F.lit(">"))


def record_text(date=DATE):
    """One WARC record of a resolved row, without the two line breaks that end it."""
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    target = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uri(F.col("record_id"))),
        line("WARC-Date", F.lit(date)),
        F.when(target.isNotNull(), line("WARC-Target-URI", target)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(
            revisit, F.concat(line("WARC-Refers-To", _uri(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(resolved, path, records_per_archive=2000, date=DATE):
    """Gzip archives of at most so many records each; each row is one record."""
    (
        resolved.select(record_text(date).alias("value"))
        .write.option("lineSep", "\r\n\r\n")
        .option("maxRecordsPerFile", records_per_archive)
        .option("compression", "gzip")
        .text(path)
    )
    return path


def parse_archive(content):
    """Yield (fields, payload) of each record; lengths come from the headers, never from the payload."""
    if content[:2] == b"\x1f\x8b":
        parts = []
        while content[:2] == b"\x1f\x8b":
            gz = zlib.decompressobj(31)
            parts.append(gz.decompress(content))
            content = gz.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        block = content[start:stop]
        http = fields.get("content-type", "").startswith("application/http")
        yield fields, block[block.index(b"\r\n\r\n") + 4 :] if http else block
        at = stop + 4


def _number(uri):
    text = (uri or "").rpartition(":")[2].rstrip(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _parsed(batches):
    import base64
    import hashlib

    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in FIELDS.split(", "))])
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, payload in parse_archive(content.as_py()):
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                kind, size = fields["warc-type"], None
                if kind == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest and digest != found:
                        raise ValueError(f"record {fields.get('warc-record-id')}: payload does not fit its digest")
                    digest, size = found, len(payload)
                rows.append((
                    _number(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), digest,
                    _number(fields.get("warc-refers-to")), size,
                ))
            columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def read_archives(spark, path):
    """Headers of every record of the archives in a folder, plain or gzip; responses are checked by digest."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, FIELDS)


def originals_of(read):
    """Give each revisit the payload size of the response that it refers to."""
    sizes = (
        read.filter("record_type = 'response' AND record_id IS NOT NULL")
        .groupBy("record_id", "payload_digest")
        .agg(F.max("payload_bytes").alias("original_bytes"))
    )
    sizes = sizes.select(F.col("record_id").alias("refers_to"), "payload_digest", "original_bytes")
    return (
        read.join(sizes.hint("merge"), ["refers_to", "payload_digest"], "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "original_bytes"))
        .drop("original_bytes")
    )


def deduplicate(records, spark, min_bytes=0, target_bytes=16 << 20, path=None, **columns):
    """Write a table of payloads as deduplicated archives, read them back and resolve the revisits.

    Tasks that write, and parts of the result, are as many as archives of ``target_bytes`` are needed, or
    fewer where the shuffle has fewer; a task with more records than an archive takes begins another.
    """
    found = headers(records, **columns)
    rows, size = found.agg(F.count(F.lit(1)), F.sum("payload_bytes")).first()
    per_archive = max(1, math.floor(target_bytes / max(1, (size or 0) / max(1, rows) + 500)))
    archives = max(1, math.ceil(rows / per_archive))
    resolved = resolve_revisits(found, min_bytes).coalesce(archives)
    path = write_archives(resolved, path or shared_path(spark, "warc"), per_archive)
    return originals_of(read_archives(spark, path)).coalesce(archives)
