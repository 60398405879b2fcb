"""SimHash near-dedup with pigeonring filtering.

A document's fingerprint has 64 bits; bit k is 1 if it is set in over half the
hashes of its word shingles.  Documents whose fingerprints differ in at most
``max_bits`` bits are linked, and linked documents form components.

The 64 bits lie on a ring of ``segments`` segments.  If two fingerprints differ
in at most t bits, some segment starts a chain in which every first l segments
differ in at most l * t / segments bits together (the cycle lemma).  With five
segments and t = 4 the first segment of such a chain is equal and the second
differs in one bit at most, so that one of its halves is equal too: fingerprints
meet on (segment, half of the next), and the longer chains are checked in the
join's condition before the full distance.

Groups of copies: equal fingerprints are one node.  In every bucket each node is
linked to the bucket's smallest first (a star, as many links as nodes); then
only nodes of different components are compared, and in each bucket only those
outside the component of its smallest node are set against the others.  So a
dense group yields links in proportion to its size, not to its square, and no
link between components is lost.

Defined cases: null and empty texts and texts without words have fingerprint 0
and are linked like any other; rows that repeat a document id keep one row each;
a null id is never the smallest of its component (null if all are).  Words are
split and lowered in ASCII only.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerale.llm.common import components, quoted, small_batches, stored, whole_row

BITS = 64


def simhash(text: str | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        spans = zip([0, *ends], [e - 1 for e in ends[shingle - 1 :]])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return of(text)


def cuts(segments: int) -> list[int]:
    """First bit of each segment, and the end."""
    return [round(k * BITS / segments) for k in range(segments + 1)]


def bits_of(x: Column, start: int, end: int) -> Column:
    width = end - start
    return F.shiftrightunsigned(x, start).bitwiseAND(F.lit((1 << width) - 1))


def ring_condition(x: Column, segments: int, max_bits: int, start: Column) -> Column:
    """From segment ``start`` on, every chain of differing bits ``x`` keeps its budget; then the whole distance does."""
    at = cuts(segments)
    diff = [F.bit_count(bits_of(x, at[k], at[k + 1])) for k in range(segments)]
    chains = F.lit(False)
    for s in range(segments):
        total, fits = None, start == s
        for n in range(1, segments):
            d = diff[(s + n - 1) % segments]
            total = d if total is None else total + d
            fits = fits & (total <= n * max_bits // segments)
        chains = chains | fits
    return chains & (F.bit_count(x) <= max_bits)


def bucket_keys(fp: Column, segments: int, max_bits: int) -> Column:
    """The keys (start segment, its bits, which part of the next one, that part's bits) of a fingerprint.

    The first segment may differ in ``a = t // segments`` bits and the first two
    in ``b = 2t // segments``; a = 0 is needed, and the second is cut into b + 1
    parts of which one is equal.
    """
    if max_bits >= segments:
        raise ValueError("needs more segments than differing bits, so that one segment is equal")
    parts, at, keys = 2 * max_bits // segments + 1, cuts(segments), []
    for s in range(segments):
        n = (s + 1) % segments
        width = at[n + 1] - at[n]
        for p in range(parts):
            lo, hi = at[n] + p * width // parts, at[n] + (p + 1) * width // parts
            bits = F.shiftleft(bits_of(fp, at[s], at[s + 1]), hi - lo).bitwiseOR(bits_of(fp, lo, hi))
            keys.append(F.struct(F.lit(s).alias("s"), F.lit(p).alias("p"), bits.alias("v")))
    return F.explode(F.array(*keys))


def near_links(nodes: DataFrame, segments: int = 5, max_bits: int = 4) -> DataFrame:
    """(fp, component) of distinct fingerprints ``nodes`` (fp), by links of at most ``max_bits`` bits."""
    keyed = nodes.select("fp", bucket_keys(F.col("fp"), segments, max_bits).alias("k")).select("fp", "k.*")
    keyed = stored(keyed, "simhash-buckets")
    key = ["s", "p", "v"]
    pivots = keyed.groupBy(*key).agg(F.min("fp").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = stored(keyed.join(pivots, key), "simhash-met")
    star = met.where((F.col("fp") != F.col("pivot")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= max_bits))
    groups = components(star.select(F.col("fp").alias("a"), F.col("pivot").alias("b")), "simhash-star")

    own = groups.select(F.col("node").alias("fp"), F.col("component").alias("own"))
    main = groups.select(F.col("node").alias("pivot"), F.col("component").alias("main"))
    met = met.join(own, "fp", "left").join(main, "pivot", "left")
    met = met.select(*key, "fp", F.coalesce("own", "fp").alias("own"), F.coalesce("main", "pivot").alias("main"))
    met = stored(met, "simhash-met")
    mixed = met.where("own != main").select(*key).distinct()
    outside = met.where("own != main").select(*key, F.col("fp").alias("fq"), F.col("own").alias("other"))
    inside = met.join(mixed, key, "left_semi")
    fits = ring_condition(F.col("fp").bitwiseXOR(F.col("fq")), segments, max_bits, F.col("s"))
    cross = inside.join(outside, key).where((F.col("own") != F.col("other")) & fits)
    merged = components(cross.select(F.col("own").alias("a"), F.col("other").alias("b")).distinct(), "simhash-cross")

    labels = nodes.join(own, "fp", "left").select("fp", F.coalesce("own", "fp").alias("own"))
    last = merged.select(F.col("node").alias("own"), "component")
    return labels.join(last, "own", "left").select("fp", F.coalesce("component", "own").alias("component"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, segments: int = 5
) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``; component_id is the smallest id of the component."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp"))
    rows = stored(rows, "simhash-fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    labels = near_links(nodes.select("fp"), segments, max_bits).join(nodes, "fp")
    smallest = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = labels.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return rows.join(labels, "fp").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component stays: that with the smallest id. Decided by id, a null id being one id: all
    rows of an id stay with it; where ids can be null or repeated, ``keep_one`` decides on rows."""
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("__id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]), "left_semi")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, **options) -> DataFrame:
    """Exactly one row of each component stays: one with the smallest id (rows without id come last), and of rows
    that repeat it the first as they are stored."""
    small_batches(docs.sparkSession)
    rows = docs.select(whole_row(docs).alias("doc"), F.monotonically_increasing_id().alias("row"), fingerprint(F.col(quoted(text_col)), shingle).alias("fp"))
    rows = stored(rows, "simhash-rows")  # the key of a row is fixed by this table
    place = F.struct(F.col("doc")[id_col].isNull().alias("none"), F.col("doc")[id_col].alias("id"), F.col("row").alias("row"))
    nodes = stored(rows.groupBy("fp").agg(F.min(place).alias("first")), "simhash-nodes")
    labels = near_links(nodes.select("fp"), **options).join(nodes, "fp")
    kept = labels.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")
