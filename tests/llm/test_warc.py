"""An exact round trip through archives cut into small chunks and small file splits."""

import hashlib
import random
from base64 import b32encode

import pytest
from pyspark.sql import functions as F

from numerale.llm.common import new_path
from numerale.llm.warc import archived, base32, chunks_of, read_pages, read_records, write_archives

SCHEMA = "page_id long, url string, html string, name string, mark long, k int"


def digest(text):
    return b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [
        (1, "u", "a\r\n\r\nWARC/1.0\r\nb"), (2, "u\r\nx", "WARC/1.0\r\n"), (3, None, None), (4, "v", ""), (5, "w", "é" * 300 + "WARC/1.0" * 50),
        (6, "w", "é" * 300 + "WARC/1.0" * 50), (6, "w", "é" * 300 + "WARC/1.0" * 50), (None, "z", "q\r\n"), (None, "z", "a\r\n\r\n"), (9, "z", "a\r\n\r\n"),
        (10, "z", "\r\n\r\nWARC/1.0"), (-11, "z", "x" * 70),
    ]
    bits = ["\r\n", "WARC", "/1.0", "\r", "\n", "é", "abc", "😀"]
    made += [(i, "h", "".join(rng.choice(bits) for _ in range(rng.choice([1, 3, 30, 200])))) for i in range(100, 300)]
    return made


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, rows, compression):
    pages = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(3)
    path = new_path(spark, "test")
    write_archives(pages, path, chunk=64, compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = read_pages(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.intact for r in got)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len((t or "").encode()), digest(t)) for i, _, t in rows)
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[digest(t)] = min(first.get(digest(t), i), i)
    responses = [r for r in got if r.record_type == "response"]
    assert len({r.payload_digest for r in responses}) == len(responses) == len({digest(t) for _, _, t in rows})
    for r in got:
        assert r.refers_to == (None if r.record_type == "response" else first.get(r.payload_digest))
    records = read_records(spark, path)
    assert max(len(r.data) for r in records.collect()) <= 64
    assert {r.type for r in records.select("type").distinct().collect()} == {"response", "revisit", "continuation"}


def test_small_payloads_are_kept_whole(spark, rows):
    pages = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    got = archived(pages, chunk=64, min_revisit=100).collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
    assert any(r.record_type == "revisit" for r in got) and len(got) == len(rows)


def test_chunks_join_and_hold_no_mark(spark, rows):
    frame = spark.createDataFrame([(t or "",) for _, _, t in rows], "t string")
    for r in frame.select("t", chunks_of(F.col("t"), 7).alias("c")).collect():
        assert "".join(r.c) == r.t and all(len(c) <= 7 for c in r.c) and r.c
    assert not any("WARC/1.0" in c for r in frame.select(chunks_of(F.col("t"), 64).alias("c")).collect() for c in r.c)


def test_base32(spark):
    texts = [str(k) for k in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", base32(F.sha1(F.col("t").cast("binary"))).alias("d")).collect()
    assert all(r.d == digest(r.t) for r in rows)


def test_empty_table(spark, rows):
    pages = spark.createDataFrame([(*rows[0], None, None, None)], SCHEMA).where("false")
    assert archived(pages).count() == 0
