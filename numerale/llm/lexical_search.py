"""Ranked lexical search: best-first document intervals under range-maximum tables.

* Index: each task cuts its documents into shards (``SHARD_DOCS`` documents or ``SHARD_POSTINGS``
  postings, whichever comes first), without a shuffle.  A shard orders its documents by id and has a
  posting list (document, frequency) for every term it holds.  The shards are stored once, whole texts
  and all terms; number and length of the documents and the document frequencies are sums over them.
* Impacts: a posting of term t in document d weighs w(t) * ((10**9 tf) div (1000 tf + 8 m(d))), as
  integers; a document's score is the sum over an item's terms, repeats included.
* Range maxima: every posting list asked for gets a sparse table, in which the position of the largest
  impact between any two documents is found with two look-ups.
* Search: an item's intervals of documents lie in a heap by their bound, the sum of its terms' range
  maxima.  The first is split at the document where its largest impact lies: that document is scored,
  and the parts to its left and right get bounds of their own.  It ends when no interval can beat the k-th
  answer.  All items of a block take such steps together, as arrays.
* The k-th answers are carried from shard to shard inside a task; one shard in sixteen is searched first
  and its k-th answers bound the search of all others.
* Items come in blocks of at most ``BLOCK_BYTES``, one at a time on the driver and in the tasks; items
  with equal text are searched once.

Defined cases: a null or empty text has no terms, counts for nothing and is no answer; an item without
terms has no answers; rows that repeat a document or an id are documents each; null ids come after all
others in ties; every item row gets its answers; without documents there are none.  A text is read in
pieces of about ``PIECE`` bytes.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerale.llm.common import new_path, schema_of, small_batches, stored, texts_of
from numerale.llm.topk import NO_ID, Best, floors, ids_array, ranked, seeds

SHARD_DOCS = 8192
SHARD_POSTINGS = 2_000_000
BLOCK_BYTES = 1 << 20
PIECE = 1 << 20

#: What a byte of a text becomes: a part of a term, in lower case, or a space.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

INDEX = "uid long, docs long, length long, ids binary, sizes binary, terms binary, starts binary, postings binary, counts binary"
ANSWERS = "q long, score long, id long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list per piece."""
    text = text.translate(TERM_BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def index(docs: DataFrame, id_col: str, text_col: str, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The shards: document ids and lengths, terms, where each term's postings start, document numbers and frequencies."""
    schema = schema_of(INDEX)

    def made(uid: int, ids: list, sizes: list, vocabulary: dict, keys: list, counts: list) -> pa.RecordBatch:
        ids = ids_array(ids)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        sizes = np.array(sizes, np.int64)[order]
        key = np.concatenate(keys)
        key = (key >> 32 << 32) | rank[key & 0xFFFFFFFF]  # term, document
        place = np.argsort(key)
        key, counts = key[place], np.concatenate(counts)[place]
        starts = np.searchsorted(key >> 32, np.arange(len(vocabulary) + 1))
        whole = [ids[order], sizes, b"\n".join(vocabulary), starts, (key & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32)]
        columns = [[uid], [len(ids)], [int(sizes.sum())], *([x if isinstance(x, bytes) else x.tobytes()] for x in whole)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: ([], [], defaultdict(), [], [])
        held, postings, uid = fresh(), 0, None
        for batch in batches:
            for id_, row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts_of(batch.column(1))):
                ids, sizes, vocabulary, keys, counts = held
                vocabulary.default_factory = vocabulary.__len__
                parts = [np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)) for words in terms_of(text)]
                size = sum(map(len, parts))
                if not size:
                    continue
                uid = row if uid is None else uid
                found, number = np.unique(np.concatenate(parts), return_counts=True)
                keys.append(found << 32 | len(ids))
                counts.append(number)
                ids.append(id_)
                sizes.append(size)
                postings += len(found)
                if len(ids) >= shard_docs or postings >= shard_postings:
                    yield made(uid, *held)
                    held, postings, uid = fresh(), 0, None
        if held[0]:
            yield made(uid, *held)

    texts = docs.select(F.col(id_col).cast("long"), text_col, F.monotonically_increasing_id())
    return stored(texts.mapInArrow(cut, INDEX), "lexical-shards")


class Shard:
    """The posting lists of the asked terms: keys (term, document) in order, impacts, and a sparse table over them."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int], weights: np.ndarray, total_docs: int, total_terms: int):
        read = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        self.ids = read("ids", np.int64)
        self.n = len(self.ids)
        terms = [vocabulary.get(t, -1) for t in row["terms"].as_py().split(b"\n")]
        starts, docs, counts = read("starts", np.int64), read("postings", np.int32), read("counts", np.int32)
        mine = sorted((v, k) for k, v in enumerate(terms) if v >= 0)
        lists = [np.arange(starts[k], starts[k + 1]) for _, k in mine]
        at = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        sizes = np.array([len(x) for x in lists], np.int64)
        self.term = np.array([v for v, _ in mine], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.doc = docs[at].astype(np.int64)
        # the list's number in front of the document: one sorted array for all lists
        self.key = np.repeat(np.arange(len(mine)), sizes) * self.n + self.doc
        tf = counts[at].astype(np.int64)
        m = np.array([25 + 75 * int(x) * total_docs // total_terms for x in read("sizes", np.int64)], np.int64)
        self.impact = np.repeat(weights[self.term], sizes) * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc]))
        self.table = [np.arange(len(at), dtype=np.int32)]
        longest = int(sizes.max()) if len(sizes) else 0
        for level in range(1, longest.bit_length()):
            last, half = self.table[-1], 1 << (level - 1)
            a, b = last[:-half], last[half:]
            # entries that reach into the next list are never looked up
            self.table.append(np.where(self.impact[a] >= self.impact[b], a, b).astype(np.int32))

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the largest impact of each (non-empty) range of a posting list lies."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        a, b = np.empty(len(low), np.int64), np.empty(len(low), np.int64)
        for j in np.unique(level).tolist():
            some = level == j
            a[some] = self.table[j][low[some]]
            b[some] = self.table[j][high[some] - (1 << j)]
        return np.where(self.impact[a] >= self.impact[b], a, b)


def search(shard: Shard, items: list[dict[int, int]], best: list[Best]) -> None:
    """Adds each item's answers in the shard to ``best``; an item is its terms and how often each stands in it."""
    place = {t: k for k, t in enumerate(shard.term.tolist())}
    heaps: list[list] = [[] for _ in items]
    ids = shard.ids.tolist()
    number = 0  # keeps the heap from comparing arrays

    def push(which: list, first: list, last: list, sizes: np.ndarray, lists, low, high, times) -> None:
        """Intervals (documents first to last) with ``sizes`` ranges each get their bounds, and a place in their item's heap."""
        nonlocal number
        top = shard.largest(low, high)
        gain = times * shard.impact[top]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        bounds = np.add.reduceat(gain, begins)
        # the document to split at: where the interval's largest impact lies
        widest = np.maximum.reduceat(gain, begins)
        at = np.flatnonzero(gain == np.repeat(widest, sizes))
        at = at[np.searchsorted(at, begins)]
        split = shard.doc[top[at]].tolist()
        for k, (i, a, b, bound, s, x, y) in enumerate(zip(which, first, last, bounds.tolist(), split, begins.tolist(), ends.tolist())):
            if bound > 0 and best[i].beaten_by(bound, ids[a]):
                number += 1
                heappush(heaps[i], (-bound, a, number, b, s, lists[x:y], low[x:y], high[x:y], times[x:y]))

    which, sizes, lists, times = [], [], [], []
    for i, item in enumerate(items):
        held = [(place[t], n) for t, n in item.items() if t in place]
        if held:
            which.append(i)
            sizes.append(len(held))
            lists += [p for p, _ in held]
            times += [n for _, n in held]
    if not which:
        return
    lists, times = np.array(lists, np.int64), np.array(times, np.int64)
    push(which, [0] * len(which), [shard.n] * len(which), np.array(sizes), lists, shard.start[lists], shard.end[lists], times)
    active = which
    while active:
        taken, still = [], []
        for i in active:
            if heaps[i]:
                entry = heappop(heaps[i])
                if best[i].beaten_by(-entry[0], ids[entry[1]]):
                    taken.append((i, entry))
                    still.append(i)
                elif best[i].floor[0] <= -entry[0]:
                    still.append(i)  # only the ids lose: others of the same bound are left
        active = still
        if not taken:
            continue
        sizes = np.array([len(e[5]) for _, e in taken])
        begins = np.cumsum(sizes) - sizes
        lists, low, high, times = (np.concatenate([e[c] for _, e in taken]) for c in (5, 6, 7, 8))
        split = np.repeat([e[4] for _, e in taken], sizes)
        cut = np.searchsorted(shard.key, lists * shard.n + split)
        cut = np.clip(cut, low, high)
        here = (cut < high) & (shard.doc[np.minimum(cut, len(shard.doc) - 1)] == split)
        scores = np.add.reduceat(np.where(here, times * shard.impact[np.minimum(cut, len(shard.doc) - 1)], 0), begins)
        for (i, e), score in zip(taken, scores.tolist()):
            if score > 0 and best[i].beaten_by(score, ids[e[4]]):
                best[i].add(score, ids[e[4]])
        for left in (True, False):
            a, b = (low, cut) if left else (cut + here, high)
            some = a < b
            if not some.any():
                continue
            kept = np.add.reduceat(some.astype(np.int64), begins)
            full = np.flatnonzero(kept).tolist()
            mine = [taken[k] for k in full]
            push(
                [i for i, _ in mine], [e[1] if left else e[4] + 1 for _, e in mine], [e[4] if left else e[3] for _, e in mine],
                kept[full], lists[some], a[some], b[some], times[some],
            )


def frequencies(shards: DataFrame, vocabulary: dict[bytes, int]) -> list[int]:
    """The document frequency of each term of a block."""
    shared = shards.sparkSession.sparkContext.broadcast(vocabulary)  # bounded: one block
    schema = schema_of("term long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                at = [shared.value.get(t, -1) for t in terms.as_py().split(b"\n")]
                at = np.array(at, np.int64)
                total[at[at >= 0]] += np.diff(np.frombuffer(starts.as_buffer(), np.int64))[at >= 0]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], schema=schema)

    found = shards.select("terms", "starts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = [0] * len(vocabulary)
    for r in found.collect():  # bounded: the terms of one block
        out[r.term] = r.n
    return out


def answers(shards: DataFrame, vocabulary: dict[bytes, int], weights: list[int], items: dict[int, dict[int, int]], floor: dict, k: int, totals: tuple[int, int]) -> DataFrame:
    """(q, score, id): per task, the best k documents of each item among its shards that beat the item's floor."""
    schema = schema_of(ANSWERS)
    shared = shards.sparkSession.sparkContext.broadcast((vocabulary, weights, items, floor))  # bounded: one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, items, floor = shared.value
        weights = np.array(weights, np.int64)
        best = [Best(k, floor.get(q)) for q in items]
        for batch in batches:
            for row in zip(*batch.columns):
                search(Shard(dict(zip(batch.schema.names, row)), vocabulary, weights, *totals), list(items.values()), best)
        found = [(q, s, None if i == -NO_ID else -i) for q, mine in zip(items, best) for s, i in mine.heap]
        columns = list(zip(*found)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return shards.mapInArrow(run, ANSWERS)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, id, score): the best k documents of every row of ``items``."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = index(docs, id_col, text_col, shard_docs, shard_postings)
    totals = shards.agg(F.sum("docs"), F.sum("length")).first()
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).where(F.col("t") != "")
    texts = stored(asked.select("t").distinct().withColumn("q", F.monotonically_increasing_id()), "lexical-items")
    size = texts.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(2 * size / block_bytes))  # a hash deals them evenly but for a small share
    path = new_path(spark, "lexical-answers")
    for block in range(blocks if totals[0] else 0):
        mine = texts.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()  # bounded: one block
        vocabulary: dict[bytes, int] = {}
        asked_terms = {}
        for r in mine:
            words = Counter(w for part in terms_of(r.t.encode()) for w in part)
            asked_terms[r.q] = {vocabulary.setdefault(w, len(vocabulary)): n for w, n in words.items()}
        weights = [weight(totals[0], n) for n in frequencies(shards, vocabulary)]
        first = stored(answers(shards.where(seeds(F.col("uid"), True)), vocabulary, weights, asked_terms, {}, k, tuple(totals)), "lexical-first")
        rest = answers(shards.where(seeds(F.col("uid"), False)), vocabulary, weights, asked_terms, floors(first, "q", k), k, tuple(totals))
        ranked(first.unionByName(rest), "q", k).write.mode("append").parquet(path)
    schema = "q long, score long, id long, rank int"
    found = spark.read.schema(schema).parquet(path) if totals[0] else spark.createDataFrame([], schema)
    return asked.join(texts, "t").join(found, "q").select("item_id", "rank", "id", "score")
