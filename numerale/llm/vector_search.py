"""Exact top-k search by inner product: KD-trees per shard, searched best first.

* Shards: each task cuts its rows into shards of at most ``SHARD`` vectors, without a shuffle,
  and builds a KD-tree in each: the node is split at the median of its widest dimension (by
  position, so that equal vectors are divided too) down to ``LEAF`` vectors.  Every node has
  the tight bounding box of its vectors and its smallest id.  The shards are stored once and hold every row.
* Bounds: no vector in a box [lo, hi] scores more than the sum over dimensions of
  max(q * lo, q * hi) against the query q; for all nodes and queries of a block these are
  two matrix products.
* Search: per query and shard, nodes are opened in the order of their bounds until none can
  beat the k-th answer; a leaf's vectors are scored all.  The k-th answer is carried from
  shard to shard inside a task.  One shard in ``FIRST`` is searched first; its k-th answers go to
  all other tasks, so that the rows sent to the last ranking stay in proportion to the queries.
* Queries come in blocks of at most ``BLOCK_BYTES``, one block at a time on the driver and in the
  tasks, however many there are; answers of a block are stored before the next.

Scores are exact integers: components become floor(scale * x) and are multiplied in
doubles as long as no sum can leave the range where doubles are exact, in Python's integers else.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part; only vectors of one length are compared; a null id is no query and comes after all
others in ties; a query's own row is no candidate, other rows with its id are; rows that
repeat a query's id are queries each (with the same query_id); fewer than k
candidates are all returned; an empty table has no answers.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerale.llm.common import new_path, schema_of, small_batches, stored
from numerale.llm.topk import NO_ID, Best, floors, ranked, seeds

SHARD = 16_384
LEAF = 32
BLOCK_BYTES = 4 << 20
EXACT = 1 << 53

INDEX = "uid long, dim int, ids binary, rows binary, asked binary, vectors binary"
QUERIES = "row long, id long, dim int, vector binary"
ANSWERS = "q long, score long, id long"


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles (whole numbers; those beyond 2**53 are whole anyway)."""
    return np.floor(vectors * scale)


class Tree:
    """A KD-tree over the rows of a matrix: nodes are ranges of ``order``, numbered from the root, a leaf has no child."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int):
        self.order = np.arange(len(vectors))
        self.start, self.end, self.child = [0], [len(vectors)], [0]
        low, high, least = [], [], []
        node = 0
        while node < len(self.start):  # children follow their parents
            a, b = self.start[node], self.end[node]
            mine = vectors[self.order[a:b]]
            low.append(mine.min(0))
            high.append(mine.max(0))
            least.append(ids[self.order[a:b]].min())
            if b - a > leaf:
                middle = (b - a) // 2
                widest = int(np.argmax(high[-1] - low[-1]))
                self.order[a:b] = self.order[a:b][np.lexsort((ids[self.order[a:b]], mine[:, widest]))]
                self.child[node] = len(self.start)
                self.start += [a, a + middle]
                self.end += [a + middle, b]
                self.child += [0, 0]
            node += 1
        self.low, self.high, self.least = np.array(low), np.array(high), np.array(least)
        self.vectors, self.ids = vectors[self.order], ids[self.order]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: doubles where every sum fits them, Python's integers else."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object)
    return whole(a) @ whole(b).T


def search(tree: Tree, rows: np.ndarray, queries: np.ndarray, own: list[int], best: list[Best]) -> None:
    """Adds to ``best`` the answers of the queries among the tree's vectors, whose row numbers are ``rows``."""
    rows = rows[tree.order]
    bounds = products(np.maximum(queries, 0), tree.high) + products(np.minimum(queries, 0), tree.low)
    least = tree.least.tolist()
    for q, answers in enumerate(best):
        bound = bounds[q].tolist()
        heap = [(-bound[0], least[0], 0)]
        while heap:
            negative, smallest, node = heappop(heap)
            if not answers.beaten_by(-negative, smallest):
                if answers.floor[0] > -negative:
                    break  # nor can any node that is left
                continue
            child = tree.child[node]
            if child:
                for c in (child, child + 1):
                    if answers.beaten_by(bound[c], least[c]):
                        heappush(heap, (-bound[c], least[c], c))
                continue
            a, b = tree.start[node], tree.end[node]
            scores = products(queries[q : q + 1], tree.vectors[a:b])[0]
            floor = answers.floor
            near = np.arange(a, b) if floor is None else a + np.flatnonzero(scores >= floor[0])
            for i in near.tolist():
                if rows[i] != own[q]:
                    answers.add(int(scores[i - a]), int(tree.ids[i]))


def vectors_of(rows: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """(id, v, asked, row): the vectors that take part, each row with a number of its own."""
    v = F.col(vec_col).cast("array<double>").alias("v")
    out = rows.select(F.col(id_col).cast("long").alias("id"), v, F.monotonically_increasing_id().alias("row"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return out.where(fine).select("id", "v", F.coalesce(is_query & F.col("id").isNotNull(), F.lit(False)).alias("asked"), "row")


def record(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def index(vectors: DataFrame, scale: float, shard: int = SHARD) -> DataFrame:
    """The shards: one row each with the ids, row numbers, marks of queries and scaled vectors, stored."""
    schema = schema_of(INDEX)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def made(dim: int) -> pa.RecordBatch:
            ids, data, asked, rows = zip(*held.pop(dim))
            whole = scaled(np.array(data, np.float64), scale)
            bits = [np.array(ids, np.int64), np.array(rows, np.int64), np.array(asked, np.uint8), whole]
            return record([[rows[0]], [dim], *([x.tobytes()] for x in bits)], schema)

        for batch in batches:
            for id_, v, asked, row in zip(*(c.to_pylist() for c in batch.columns)):
                mine = held.setdefault(len(v), [])
                mine.append((NO_ID if id_ is None else id_, v, asked, row))
                if len(mine) == shard:
                    yield made(len(v))
        for dim in list(held):
            yield made(dim)

    return stored(vectors.mapInArrow(cut, INDEX), "vector-shards")


def queries_of(shards: DataFrame) -> DataFrame:
    """(row, id, dim, vector): the queries among the shards' rows, stored."""
    schema = schema_of(QUERIES)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, rows, asked, data in zip(*(batch.column(c) for c in ("dim", "ids", "rows", "asked", "vectors"))):
                at = np.flatnonzero(np.frombuffer(asked.as_buffer(), np.uint8))
                vectors = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, dim.as_py())[at]
                ids, rows = (np.frombuffer(x.as_buffer(), np.int64)[at] for x in (ids, rows))
                yield record([rows, ids, np.full(len(at), dim.as_py()), [v.tobytes() for v in vectors]], schema)

    return stored(shards.mapInArrow(pick, QUERIES), "vector-queries")


def answers(shards: DataFrame, queries: dict[int, tuple], floor: dict[int, tuple[int, int]], k: int, leaf: int) -> DataFrame:
    """(q, score, id): per task, the best k of each query among its shards that beat the query's floor.

    ``queries``: by vector length, the row numbers q and the matrix of one block.
    """
    schema = schema_of(ANSWERS)
    shared = shards.sparkSession.sparkContext.broadcast((queries, floor))  # bounded: one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floor = shared.value
        best = {dim: [Best(k, floor.get(q)) for q in numbers] for dim, (numbers, _) in queries.items()}
        for batch in batches:
            for dim, ids, rows, data in zip(*(batch.column(c) for c in ("dim", "ids", "rows", "vectors"))):
                if dim.as_py() not in queries:
                    continue
                own, matrix = queries[dim.as_py()]
                vectors = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, dim.as_py())
                tree = Tree(vectors, np.frombuffer(ids.as_buffer(), np.int64), leaf)
                search(tree, np.frombuffer(rows.as_buffer(), np.int64), matrix, own, best[dim.as_py()])
        for dim, (numbers, _) in queries.items():
            found = [(q, s, -i) for q, mine in zip(numbers, best[dim]) for s, i in mine.heap]
            if found:
                q, s, i = zip(*found)
                yield record([q, s, [None if x == NO_ID else x for x in i]], schema)

    return shards.mapInArrow(run, ANSWERS)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, shard: int = SHARD, leaf: int = LEAF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the best k other rows of every row for which ``is_query`` (over ``id``) holds."""
    spark = rows.sparkSession
    small_batches(spark)
    shards = index(vectors_of(rows, id_col, vec_col, is_query), scale, shard)
    asked = queries_of(shards)
    size = asked.agg(F.sum(F.octet_length("vector") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(2 * size / block_bytes))  # a hash deals them evenly but for a small share
    path = new_path(spark, "vector-answers")
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).collect()  # bounded: one block
        data: dict[int, list] = {}
        for r in mine:
            data.setdefault(r.dim, []).append((r.row, r.vector))
        queries = {d: ([r for r, _ in x], np.frombuffer(b"".join(v for _, v in x), np.float64).reshape(-1, d)) for d, x in data.items()}
        first = stored(answers(shards.where(seeds(F.col("uid"), True)), queries, {}, k, leaf), "vector-first")
        rest = answers(shards.where(seeds(F.col("uid"), False)), queries, floors(first, "q", k), k, leaf)
        ranked(first.unionByName(rest), "q", k).write.mode("append").parquet(path)
    found = spark.read.schema("q long, score long, id long, rank int").parquet(path)
    numbers = asked.select(F.col("row").alias("q"), F.col("id").alias("query_id"))
    return found.join(numbers, "q").select("query_id", "rank", "id", "score")
