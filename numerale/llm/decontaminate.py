"""Benchmark decontamination: CGK random walks, bit-sampling LSH, exact edit verification.

Texts are sequences of words (lower-cased in ASCII, split at ASCII white space).
The CGK walk writes one symbol a step and moves on or stays by a random bit that
depends on the step and the symbol; two sequences at a small edit distance soon
walk in step again, so their outputs are at a small Hamming distance.  A key
samples ``sampled`` of the first ``steps`` outputs; ``repeats`` walks with own bits
are tried, as many as the target recall asks for (``repeats_for``).

Windows: every ``stride``-th word of a document starts one, and an item is indexed
from each of its words on.  A passage of an item thus offers a window for every
``stride`` words, each compared with the part of the item that begins there.  A walk
reads a window only as far as its steps go, so a window needs no copy of the text.
Items shorter than ``steps + stride`` words would offer too few; while there are such
items, windows start more often (at every word if need be).  The walks read ``steps`` steps, about half as many words, so
they tell items of ``SHORT`` words and more.  Shorter ones are found exactly: of one more pieces than an
item may have edits, at least one stands in the text as it is, and the pieces of all items lie in one table by their hash.

Every candidate is verified: the item's edit distance, in words, to the best
stretch of the document around the window, must be at most ``max_edits`` of the
item's words (one minus a similarity of 0.8).

The items are a stated query set against all documents.  They are read in blocks
of at most ``BLOCK_BYTES`` of text by expectation, however many there are; the
documents are scanned once per block and never shuffled; neither the driver nor a task holds more than one block.

Defined cases: null and empty texts and items match nothing; a repeated item id
counts once, by its best match; rows that repeat a document id are reported each;
very long texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numerale.llm.common import new_path, quoted, schema_of, small_batches, stored, texts_of, whole_row

BLOCK_BYTES = 16 << 20
STEPS = 12
SAMPLED = 8
STRIDE = 4
SHORT = 8

FOUND = "doc_id long, item_id long, distance int, item_words int, similarity double, first_word long, last_word long"


def repeats_for(recall: float, max_edits: float, steps: int = STEPS) -> int:
    """Walks needed to reach ``recall``: one window's key is whole if none of the words it reads is edited."""
    read = (steps + 1) / 2
    p = (1 - max_edits) ** read
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def best_stretch(item: list[int], text: np.ndarray | list[int]) -> tuple[int, int]:
    """(distance, end): the smallest edit distance of ``item`` to a stretch of ``text``, and where the first such ends.

    Bit-parallel over the item's words, for an item of any length.
    """
    m = len(item)
    at: dict[int, int] = {}
    for k, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | ~(xh | up) & full
        minus = up & xh
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(xv | plus) & full, plus & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """The items of a block, and the keys of all their windows."""

    def __init__(self, items: list[tuple[int, bytes]], repeats: int, max_edits: float, steps: int, sampled: int, stride: int, seed: int):
        split = [(i, words_of(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        vocabulary = sorted({w for _, words in split for w in words})
        self.ids = {w: k + 1 for k, w in enumerate(vocabulary)}  # 0: a word of no item, or the end
        self.items = [(i, [self.ids[w] for w in words]) for i, words in split]
        self.words = [frozenset(w) for _, w in self.items]
        self.max_edits, self.steps, self.sampled = max_edits, steps, sampled
        long = [k for k, (_, w) in enumerate(self.items) if len(w) >= SHORT]
        shortest = min((len(self.items[k][1]) for k in long), default=steps + stride)
        self.stride = max(1, min(stride, shortest - steps))
        rng = np.random.default_rng(seed)
        n = len(vocabulary) + 1
        self.code = rng.integers(1, 1 << 63, n, np.int64).astype(np.uint64)
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) < SHORT:
                cuts = np.linspace(0, len(w), min(len(w), int(max_edits * len(w) + 1e-9) + 1) + 1).astype(int).tolist()
                for a, b in zip(cuts[:-1], cuts[1:]):
                    pieces.setdefault(b - a, []).append((int(self.hashes(np.array(w[a:b]), b - a)[0]), k, a))
        #: By length: the hashes of the pieces in order, and item and place of each.
        self.pieces = {}
        for size, rows in pieces.items():
            rows.sort()
            self.pieces[size] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64))
        self.walks = []
        for _ in range(repeats if long else 0):
            bits = rng.integers(0, 2, (steps, n)).astype(np.int64)
            picks = np.sort(rng.choice(steps, sampled, replace=False))
            symbols, starts, owner = [], [], []
            base = 0
            for k in long:
                w = self.items[k][1]
                symbols.append(np.array(w + [0] * steps))
                offsets = np.arange(len(w))
                starts.append(base + offsets)
                owner.append(np.stack([np.full(len(w), k), offsets], 1))
                base += len(w) + steps
            keys, live = self.keys(np.concatenate(symbols), np.concatenate(starts), bits, picks)
            owner = np.concatenate(owner)[live]
            order = np.argsort(keys, kind="stable")
            self.walks.append((bits, picks, keys[order], owner[order]))

    def hashes(self, symbols: np.ndarray, n: int) -> np.ndarray:
        """A hash of every n words in a row."""
        code = self.code[symbols]
        out = np.zeros(max(0, len(symbols) - n + 1), np.uint64)
        for k in range(n):
            out = (out ^ code[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def keys(self, symbols: np.ndarray, starts: np.ndarray, bits: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of each window, and which windows are left: one that samples a word of no item can't match."""
        at, live = starts, np.arange(len(starts))
        key = np.zeros(len(starts), np.uint64)
        for step in range(int(picks[-1]) + 1):
            out = symbols[at]
            if step in picks:
                some = np.flatnonzero(out)
                at, live, out, key = at[some], live[some], out[some], key[some]
                key = (key ^ self.code[out]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step)
            at = at + bits[step][out]
        return key, live

    def known(self, text: bytes) -> list[int]:
        """The word ids of a document's text."""
        get = self.ids.get
        return [get(w, 0) for w in words_of(text)]

    def search(self, texts: list[list[int]]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item) -> (distance, start, end) of texts given as word ids."""
        lengths = np.array([len(t) for t in texts], np.int64)
        base = np.concatenate([[0], np.cumsum(lengths + self.steps)])
        symbols = np.zeros(base[-1], np.int64)
        for t, b in zip(texts, base):
            symbols[b : b + len(t)] = t
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        candidates = []
        starts = [np.arange(b, b + n, self.stride) for b, n in zip(base, lengths)]
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        for bits, picks, known, owner in self.walks:
            keys, live = self.keys(symbols, starts, bits, picks)
            lo = np.searchsorted(known, keys, "left")
            n = np.searchsorted(known, keys, "right") - lo
            hit = np.repeat(np.arange(len(n)), n)
            place = owner[lo[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)]
            candidates.append(np.stack([place[:, 0], starts[live[hit]] - place[:, 1], starts[live[hit]]], 1))
        for n, (known, owner) in self.pieces.items():
            here = np.flatnonzero(symbols)  # a piece has words of items only
            here = here[here + n <= len(symbols)]
            mine = self.hashes(symbols, n)[here]
            lo = np.searchsorted(known, mine, "left")
            times = np.searchsorted(known, mine, "right") - lo
            hit = np.repeat(np.arange(len(here)), times)
            place = owner[lo[hit] + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)]
            candidates.append(np.stack([place[:, 0], here[hit] - place[:, 1], here[hit]], 1))
        candidates = np.concatenate(candidates) if candidates else np.zeros((0, 3), np.int64)
        _, one = np.unique(candidates[:, :2], axis=0, return_index=True)
        candidates = candidates[np.sort(one)]
        owners = np.searchsorted(base, candidates[:, 2], "right") - 1
        for t, (k, start, _) in zip(owners.tolist(), candidates.tolist()):
            item = self.items[k][1]
            allowed = int(self.max_edits * len(item) + 1e-9)
            a = max(0, start - int(base[t]) - allowed)
            b = min(int(lengths[t]), start - int(base[t]) + len(item) + allowed)
            if found.get((t, k), (1,))[0] == 0:
                continue
            stretch = texts[t][a:b]
            if sum(map(self.words[k].__contains__, stretch)) < len(item) - allowed:
                continue  # fewer of the item's words than any stretch within the distance has
            distance, end = best_stretch(item, stretch)
            if distance <= allowed and distance < found.get((t, k), (allowed + 1,))[0]:
                found[t, k] = (distance, max(a, a + end - len(item)), a + end)
        return found


def indexes(
    spark: SparkSession,
    items: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    max_edits: float = 0.2,
    recall: float = 0.95,
    steps: int = STEPS,
    sampled: int = SAMPLED,
    stride: int = STRIDE,
    seed: int = 1,
) -> tuple[int, Iterator[Callable[[], Index]]]:
    """The number of blocks of items, and one by one what makes a block's index in a task: a block is read when it is asked for."""
    small_batches(spark)
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    repeats = repeats_for(recall, max_edits, steps)

    def each() -> Iterator[Callable[[], Index]]:
        for block in range(blocks):
            mine = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
            pairs = [(r.i, r.t.encode()) for r in mine.collect()]  # bounded: one block of items
            yield partial(Index, pairs, repeats, max_edits, steps, sampled, stride, seed)

    return blocks, each()


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """One row per document and item it holds: distance, similarity and the words where the best match lies."""
    out = schema_of(FOUND)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long"), text_col)
    blocks, makes = indexes(spark, items, **options)
    path = new_path(spark, "contaminated")
    for make in makes:

        def run(batches: Iterator[pa.RecordBatch], make=make) -> Iterator[pa.RecordBatch]:
            index = make()
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                texts = [index.known(t) for t in texts_of(batch.column(1))]
                best: dict[tuple, tuple] = {}
                for (t, k), (distance, a, b) in index.search(texts).items():
                    item, words = index.items[k]
                    if distance < best.get((t, item), (len(words) + 1,))[0]:
                        best[t, item] = (distance, len(words), 1 - distance / len(words), a, b - 1)
                made = [(doc_ids[t], item, *rest) for (t, item), rest in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] or 0))]
                columns = list(zip(*made)) or [()] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        part = texts.mapInArrow(run, FOUND)
        if blocks == 1:
            return part
        part.write.mode("append").parquet(path)  # neither the driver nor a task holds more than one block
    return spark.read.schema(FOUND).parquet(path)


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold an item (by id; a null id is one id: where ids can be null or repeated,
    ``keep_clean`` decides on rows)."""
    found = contaminated(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["__id"]), "left_anti")


def clean(make: Callable[[], Index], text: Column) -> Column:
    """True where a text holds no item of a block."""

    @F.arrow_udf("boolean")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = make()
        for batch in batches:
            texts = [index.known(t) for t in texts_of(batch)]
            held = {t for t, _ in index.search(texts)}
            yield pa.array([t not in held for t in range(len(texts))], pa.bool_())

    return of(text)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds an item, whatever their ids: each row is decided on by itself."""
    spark = docs.sparkSession
    blocks, makes = indexes(spark, items, **options)
    if blocks == 1:
        return docs.where(clean(next(makes), F.col(quoted(text_col))))
    rows = docs.select(whole_row(docs).alias("doc"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "decontaminate-rows")  # the key of a row is fixed by this table
    path = new_path(spark, "contaminated")
    for make in makes:
        rows.where(~clean(make, F.col("doc")[text_col])).select("row").write.mode("append").parquet(path)
    gone = spark.read.schema("row long").parquet(path).distinct()
    return rows.join(gone, "row", "left_anti").select("doc.*")
