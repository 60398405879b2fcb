"""Packing of token sequences: shortest-pack-first over the histogram of lengths.

Documents become token ids (a public byte-level vocabulary), each followed by an
end id.  A document is cut at multiples of ``size``; full pieces are sequences of
their own, and the remainders are packed.

Only the histogram of remainder lengths (at most ``size`` numbers, whatever the
corpus) reaches the driver.  There lengths are placed longest first, each into
the packing patterns with the most room left that still fit it, all documents of a
length at once; a pattern that takes only some of them is split into two.  The
patterns then go back to the pieces by rank: piece number r of a length belongs to
the pattern whose range of ranks holds r.  Ranks are dealt per (task, length) and
shifted by the counts of the tasks before, so that a very frequent length is not
gathered in one place.

Defined cases: a null text is an empty one (only its end id); an added token of the
vocabulary's file in a text, such as ``<|endoftext|>``, is one id; rows that repeat an id are packed once each; an empty table
gives no piece.  Columns besides id and text are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from numerale.llm.common import schema_of, small_batches, stored, texts_of

SIZE = 2048
END_ID = 1
CACHED_PIECES = 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tokens:
    """Token ids of texts, as little-endian 32-bit words.

    A space before a non-space always starts a new pre-token, so a text is cut
    there and every part is encoded once and remembered (up to a bound, then the
    memory starts anew).  Texts with other white space beside such a space are
    encoded whole.  Before all that a text is split at the added tokens of the
    vocabulary's file, each of which is one id.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        ranks = {}
        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.known: dict[str, bytes] = {}
        with open(public_tokenizers.path(vocabulary.replace(".tiktoken", ".json")), "rb") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        longest = sorted(map(re.escape, added), key=len, reverse=True)
        self.borders = re.compile(f"({'|'.join(longest)})") if added else None

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def part(self, part: str) -> bytes:
        if len(self.known) >= CACHED_PIECES:
            self.known.clear()
        ids = self.known[part] = self.encode(" " + part)
        return ids

    def __call__(self, text: str) -> bytes:
        if self.borders is None or not any(t in text for t in self.added):
            return self.between(text)
        return b"".join(self.added.get(t) or self.between(t) for t in self.borders.split(text) if t)

    def between(self, text: str) -> bytes:
        """The ids of a text that holds no added token."""
        parts = text.split(" ")
        if len(parts) == 1:
            return self.encode(text)
        known = self.known
        out = [self.encode(parts[0])] if parts[0] else []
        for part in parts[1:]:
            ids = known.get(part)
            if ids is None:
                if not part or part[0].isspace():  # a space before white space or the end is no border
                    return self.encode(text)
                ids = self.part(part)
            out.append(ids)
        return b"".join(out)


def tokenized(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """The pieces of every document, with the checksum of their ids."""
    small_batches(docs.sparkSession)
    out = schema_of(PIECES)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = tokens(text.decode("utf-8", "replace")) + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
            columns = list(zip(*rows)) or [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, PIECES)


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences) patterns, by shortest-pack-first over a histogram.

    Lengths are placed longest first; the packs filled least take them, as many
    as there are of either, and a pack left over by a split keeps its place.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # ascending

    def add(pattern: tuple[int, ...], n: int) -> None:
        room = size - sum(pattern)
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = rooms[-1] if rooms else -1
            if room < length:
                add((length,), left)
                break
            pattern, n = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(bisect_left(rooms, room))
            used = min(n, left)
            if n > used:
                add(pattern, n - used)
            add((*pattern, length), used)
            left -= used
    return [p for room in rooms for p in by_room[room]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset) of each place in a pattern.

    A place takes a range of ranks of its length, one for each sequence of the pattern.
    """
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, rank + n - 1, sequence, offset))
            next_rank[length] = rank + n
            offset += length
        sequence += n
    return rows


def pack_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces with their sequence_id and offset; ``pieces`` must be a stored table (it is read several times)."""
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") >= size)
    rest = pieces.where(F.col("length") < size).withColumn("task", F.spark_partition_id())
    rest = stored(rest, "pack-rest")
    per_task = rest.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shifts = stored(shifts, "pack-counts")
    histogram = shifts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `size` rows
    patterns = pack_histogram({r.length: r.n for r in histogram}, size)
    places = slots(patterns)
    by_length: dict[int, list[tuple]] = {}
    for place in places:
        by_length.setdefault(place[0], []).append(place)
    order = Window.partitionBy("task", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = rest.withColumn("local", F.row_number().over(order) - 1)
    ranked = ranked.join(shifts.drop("n"), ["task", "length"]).withColumn("rank", F.col("local") + F.col("shift"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    out = schema_of(f"{PIECES}, sequence_id long, offset long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {n: np.array(rows, np.int64) for n, rows in by_length.items()}
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                table = tables[int(n)]
                at = np.searchsorted(table[:, 1], rank[mine], "right") - 1
                sequence[mine] = table[at, 3] + rank[mine] - table[at, 1]
                offset[mine] = table[at, 4]
            arrays = [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    packed = ranked.select(*columns, "rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
    # full pieces: a sequence each; the ids are distinct, not dense (the table is stored, so they are the same if a task is repeated)
    first_full = sum(n for _, n in patterns)
    own = F.lit(first_full).cast("long") + F.monotonically_increasing_id()
    whole = full.select(*columns, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    size: int = SIZE,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack_pieces(stored(tokenized(docs, id_col, text_col, vocabulary, size, end_id), "pack-pieces"), size)
