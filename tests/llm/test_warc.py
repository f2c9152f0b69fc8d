import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from voxstars.llm import warc

PAGES = "page_id long, url string, html string, payload string, record_id long"


def expected(pages, min_bytes=0):
    first = {}
    for page_id, _, html in pages:
        body = (html or "").encode()
        if len(body) >= min_bytes and page_id is not None:
            first[body] = min(page_id, first.get(body, page_id))
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        other = first.get(body)
        again = other is not None and other != page_id
        out.append((page_id, len(body), digest, "revisit" if again else "response", other if again else None))
    return sorted(out, key=str)


CASES = [
    (7, "http://a", "same"), (3, "http://b", "same"), (3, "http://b", "same"), (9, None, "same"), (None, "http://c", "same"),
    (1, "http://x\r\nX: y", None), (2, "http://d", ""), (4, "http://e", "été ñ 漢字\r\n\r\nWARC/1.1\r\n"), (5, "http://f", "l" * 200_000),
    (6, "", "\x00\x01 odd"),
]


def table(spark, pages):
    return spark.createDataFrame([(*p, "clash", -1) for p in pages], PAGES)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    read = warc.deduplicate(table(spark, CASES), spark, min_bytes, target_bytes=4000)
    got = sorted(map(tuple, read.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == expected(CASES, min_bytes)


def test_empty_table(spark):
    assert warc.deduplicate(table(spark, []), spark).count() == 0


@pytest.mark.parametrize("target_bytes, most", [(16 << 20, 1), (40_000, 8)])
def test_archives_follow_bytes_not_shuffle_partitions(spark, tmp_path, target_bytes, most):
    pages = [(i, f"http://{i}", "same" if i % 3 == 0 else f"{i} " * 100) for i in range(400)]
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        read = warc.deduplicate(table(spark, pages), spark, target_bytes=target_bytes, path=str(tmp_path / "warc"))
        got = sorted(map(tuple, read.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
        parts = read.rdd.getNumPartitions()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == expected(pages)
    written = len(list((tmp_path / "warc").glob("part-*")))
    assert written <= 2 * most and parts <= most


def test_digest_equals_hashlib(spark):
    df = spark.createDataFrame([("",), ("abc",), ("ß漢",)], "x string").select("x", warc.base32_sha1(F.col("x")).alias("d"))
    for x, d in df.collect():
        assert d == base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()


def test_corrupt_payload_is_noticed():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 20\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n"
    fields, payload = next(warc.parse_archive(record))
    assert fields["warc-type"] == "response" and payload == b"x"
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"junk\r\n\r\n"))
