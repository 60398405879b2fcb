"""WARC archives as tables: written and read by Spark's text files, with oversized payloads in chunks.

Writing: a payload longer than ``chunk`` characters becomes rows of record identifier
and chunk number, and each row is written as a record of its own: the first segment
as ``response``, the others as ``continuation`` (the format's own segmentation).  So
no row, and no record of a file, is larger than a chunk.  Files are plain text files
whose rows end in the two line ends that close a record.  A payload is also cut
inside each ``WARC/1.0``, so that no record holds the line that starts the next one.

Digests: SHA-1 in base32.  A payload of one chunk is digested in its row; the chunks
of an oversized one stream through a task in order and a running digest is updated,
without the whole payload ever being joined.

Of records with equal payloads (digest and length) of at least ``min_revisit`` bytes,
that with the smallest page id is the response and the others are revisits without
payload.  Digests are pre-aggregated, so a payload that a third of all pages share
costs one number; payloads move once, by page id.

Defined cases: a null payload is empty; a null page id is compared last (a response
only if no page with an id has its payload); of rows that repeat page id and payload
one is written as response and the others revisit it; a null URL is left out, and
control characters in one are escaped; an empty table gives no record.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from numerale.llm.common import new_path, schema_of, small_batches, stored

CHUNK = 1 << 16
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
NEXT = "\r\n\r\nWARC/1.0\r\n"


def base32(sha1_hex: Column) -> Column:
    """The base32 form of a SHA-1 digest given as 40 hexadecimal digits (60 bits make 12 characters)."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, a, n), 16, 32), m, "0") for a, n, m in ((1, 15, 12), (16, 15, 12), (31, 10, 8))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunks_of(payload: Column, chunk: int) -> Column:
    """The payload as an array of parts; joined they give it back. An empty payload is one empty part."""
    size = F.greatest(F.ceil(F.length(payload) / chunk), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.substring(payload, k * chunk + 1, F.lit(chunk)))
    whole = F.when(F.length(payload) <= chunk, F.array(payload)).otherwise(parts)
    inside = F.flatten(F.transform(whole, lambda p: F.split(p, r"(?<=WARC)(?=/1\.0)", -1)))
    # a border between chunks may fall inside the mark; the parts on either side then hold no whole one
    return F.when(F.contains(payload, F.lit("WARC/1.0")), inside).otherwise(whole)


def streamed_digests(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, payload_bytes, payload_digest) of payloads given as rows (keys, chunk_no, data).

    The rows of a payload come in order; what is carried from one to the next is a
    running digest and a count.
    """
    fields = ", ".join(f"{k} {dict(chunks.dtypes)[k]}".replace("bigint", "long") for k in keys)
    fields += ", payload_bytes long, payload_digest string"
    out = schema_of(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, size = None, None, 0
        for batch in batches:
            done = []
            rows = zip(*(batch.column(k).to_pylist() for k in keys))
            for key, data in zip(rows, batch.column("data").cast(pa.binary())):
                if key != now:
                    if now is not None:
                        done.append((*now, size, b32encode(digest.digest()).decode()))
                    now, digest, size = key, hashlib.sha1(), 0
                digest.update(data.as_buffer())
                size += len(data.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
        if now is not None:
            last = (*now, size, b32encode(digest.digest()).decode())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, out)], schema=out)

    ordered = chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk_no")
    return ordered.select(*keys, "data").mapInArrow(run, fields)


def record_table(pages: DataFrame, id_col: str, payload_col: str, chunk: int) -> DataFrame:
    """(page_id, mark, payload_bytes, payload_digest) of distinct records; mark is a hash that tells payloads of an id apart."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(payload_col), F.lit("")).alias("data"))
    rows = rows.withColumn("mark", F.xxhash64("data"))
    small = rows.where(F.length("data") <= chunk)
    small = small.select("page_id", "mark", F.octet_length("data").cast("long").alias("payload_bytes"), base32(F.sha1(F.col("data").cast("binary"))).alias("payload_digest"))
    large = rows.where(F.length("data") > chunk).withColumn("row", F.monotonically_increasing_id())
    large = large.select("page_id", "mark", "row", F.posexplode(chunks_of(F.col("data"), chunk)).alias("chunk_no", "data"))
    large = streamed_digests(large, ["page_id", "mark", "row"]).drop("row")
    return small.unionByName(large).distinct()


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
    chunk: int = CHUNK, min_revisit: int = 0, compression: str = "gzip",
) -> None:
    """Write the pages as WARC records under ``path``."""
    small_batches(pages.sparkSession)
    records = stored(record_table(pages, id_col, payload_col, chunk), "warc-records")
    first = records.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"))
    records = records.join(first, ["payload_digest", "payload_bytes"])

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
        F.col(url_col).alias("url"),
    ).withColumn("mark", F.xxhash64("payload"))
    # null ids meet too; 0 and a flag stand for them
    key = [F.coalesce("page_id", F.lit(0)).alias("k"), F.col("page_id").isNull().alias("none"), F.col("mark").alias("m")]
    rows = rows.select(*key, "page_id", "payload", "url")
    records = records.select(*key, "payload_bytes", "payload_digest", "first")
    copy = F.row_number().over(Window.partitionBy("k", "none", "m").orderBy(F.lit(1)))
    rows = rows.join(records, ["k", "none", "m"]).withColumn("copy", copy)

    revisit = (F.col("payload_bytes") >= min_revisit) & (~F.col("page_id").eqNullSafe(F.col("first")) | (F.col("copy") > 1))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), "payload_digest")
    # only the first copy of the first page bears the plain name, to which revisits refer
    number = F.when(F.col("copy") > 1, F.concat(F.lit(":"), F.col("copy").cast("string"))).otherwise("")
    target = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("none")), F.lit(":"), "payload_digest", F.lit(">"))
    escaped = F.replace(F.replace(F.regexp_replace("url", r"[\x00-\x09\x0b\x0c\x0e-\x1f]", ""), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = rows.select(
        F.concat(name, number, F.lit(">")).alias("name"), revisit.alias("revisit"), target.alias("target"), "payload_digest",
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), escaped, F.lit("\r\n")), F.lit("")).alias("uri"),
        F.when(revisit, F.array(F.lit(""))).otherwise(chunks_of(F.col("payload"), chunk)).alias("parts"),
    )
    rows = rows.select("*", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part")).drop("parts")
    block = F.when(F.col("revisit") | (F.col("k") > 0), F.col("part")).otherwise(F.concat(F.lit(HTTP), "part"))
    head = F.when(
        F.col("revisit"),
        F.concat(
            F.lit("WARC-Type: revisit\r\nWARC-Record-ID: "), "name", F.lit("\r\nWARC-Refers-To: "), "target",
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"),
        ),
    ).when(
        F.col("k") == 0,
        F.concat(
            F.lit("WARC-Type: response\r\nWARC-Record-ID: "), "name", F.lit("\r\nContent-Type: application/http; msgtype=response\r\n"),
            F.when(F.col("n") > 1, "WARC-Segment-Number: 1\r\n").otherwise(""),
        ),
    ).otherwise(
        F.concat(
            F.lit("WARC-Type: continuation\r\nWARC-Record-ID: "), F.replace("name", F.lit(">"), F.concat(F.lit(":part"), F.col("k").cast("string"), F.lit(">"))),
            F.lit("\r\nWARC-Segment-Origin-ID: "), "name", F.lit("\r\nWARC-Segment-Number: "), (F.col("k") + 1).cast("string"), F.lit("\r\n"),
        )
    )
    record = F.concat(
        F.lit("WARC/1.0\r\n"), head, "uri", F.lit(f"WARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), "payload_digest",
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    out = rows.select(record.alias("value")).write.mode("errorifexists").option("lineSep", "\r\n\r\n")
    out.option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives: type, name, origin, segment, refers_to, digest, data (the payload's part)."""
    raw = spark.read.option("lineSep", NEXT).text(path).where("value != ''")
    value = F.regexp_replace("value", r"^WARC/1\.0\r\n", "")
    rows = raw.select(value.alias("value")).select(F.substring_index("value", "\r\n\r\n", 1).alias("head"), "value")
    field = lambda name: F.nullif(F.regexp_extract(F.concat(F.lit("\n"), "head"), rf"\n(?i:{name}): ([^\r\n]*)", 1), F.lit(""))
    rows = rows.select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("name"), field("WARC-Segment-Origin-ID").alias("origin"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(0)).alias("segment"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("url"), field("WARC-Payload-Digest").alias("digest"), field("Content-Length").cast("int").alias("size"),
        F.substr("value", F.length("head") + 5).alias("block"),
    )
    # the closing line ends of a file's last record are beyond Content-Length
    block = F.when(F.octet_length("block") == F.col("size"), F.col("block")).otherwise(
        F.substring(F.col("block").cast("binary"), F.lit(1), F.col("size")).cast("string")
    )
    rows = rows.withColumn("block", block)
    body = F.when(F.col("type") == "response", F.substr("block", F.instr("block", "\r\n\r\n") + 4)).otherwise(F.col("block"))
    return rows.withColumn("data", body).drop("block", "size")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest (of what was read), record_type, refers_to, and intact:
    whether that digest is the one the record states."""
    small_batches(spark)
    records = read_records(spark, path)
    whole = records.where((F.col("type") == "response") & (F.col("segment") == 0))
    whole = whole.select(
        "name", F.octet_length("data").cast("long").alias("payload_bytes"), base32(F.sha1(F.col("data").cast("binary"))).alias("payload_digest"), "digest"
    )
    parts = records.where(F.col("segment") > 0)
    chunks = parts.select(F.coalesce("origin", "name").alias("name"), "digest", F.col("segment").alias("chunk_no"), "data")
    long = streamed_digests(chunks, ["name", "digest"]).select("name", "payload_bytes", "payload_digest", "digest")
    responses = stored(whole.unionByName(long), "warc-read")
    intact = F.col("digest") == F.concat(F.lit("sha1:"), "payload_digest")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1).try_cast("long")
    found = responses.select(
        page("name").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), intact.alias("intact"),
    )
    revisits = records.where(F.col("type") == "revisit").select(page("name").alias("page_id"), "refers_to", F.col("digest").alias("stated"))
    of = responses.select(F.col("name").alias("refers_to"), "payload_bytes", "payload_digest", "digest")
    joined = revisits.join(of, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), page("refers_to").alias("refers_to"),
        (intact & (F.col("stated") == F.col("digest"))).alias("intact"),
    )
    return found.unionByName(joined)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return read_pages(pages.sparkSession, path)
