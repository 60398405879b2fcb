"""Embedding near-dedup by collision-counting projections.

Vectors are compared as unit vectors; a cosine of at least ``min_cosine`` is a
distance of at most r = sqrt(2 - 2 * min_cosine).  On a random one-dimensional
projection such a pair differs by N(0, r^2): it *collides* if one value lies in the
window of half-width ``HALF * r`` centred at the other.  Of ``counted`` projections a
pair at the threshold collides on a binomial number; pairs that reach the count
which all but ``1 - recall`` of such pairs reach are verified by their cosine in
double precision.

Counting every pair of a corpus would be quadratic, so pairs meet first in cells:
``tables`` tables cut ``depth`` further projections into cells of width ``WIDTH * r``
with random offsets.  depth follows the number of vectors (a cell holds about
``CELL`` unrelated ones), and the number of tables follows from depth, so that a
pair at the threshold shares a cell with probability ``recall`` at any size.  In a
cell the vectors are sorted by one projection; only pairs within ``REACH * r`` there,
which hardly any linked pair exceeds, are counted.  A pair is counted in the first table only where it shares a
cell, so nothing is counted twice and no pair leaves the task: a task returns link
counts per vector and a spanning forest of the links.

Equal vectors are one node with a count, so a group of copies costs nothing.  A cell
with more than ``BLOCK`` vectors is cut into blocks by a hash, and each pair of
blocks is a task of its own: no cell is gathered and none is capped.

Vectors of every length take part; only those of one length are compared.  DOUBLE components are
kept as they are, all others as single precision.

Defined cases: vectors that are null, empty, zero, or
hold null or non-finite components link with nothing (their own component);
rows that repeat a vec_id are vectors of their own with that id; a null id is never
the smallest of a component (null if all are).  Labels are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerale.llm.common import components, schema_of, small_batches, stored

HALF = 1.96
REACH = 3.5
WIDTH = 6.0
CELL = 64
BLOCK = 1024
COUNTED = 32
ROWS = 4096
PAIRS = 200_000


def within(c: float) -> float:
    """Probability that two values at a normal distance of scale 1 fall into one cell of width c."""
    tail = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def least_count(counted: int, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(HALF / math.sqrt(2))
    below = 0.0
    for k in range(counted + 1):
        below += math.comb(counted, k) * p**k * (1 - p) ** (counted - k)
        if below > 1 - recall:
            return k
    return counted


def plan(n: int, min_cosine: float, recall: float) -> tuple[int, int]:
    """(depth, tables) for n vectors: unrelated ones are taken as orthogonal."""
    r = math.sqrt(2 - 2 * min_cosine)
    far, near = within(WIDTH * r / math.sqrt(2)), within(WIDTH)
    depth = max(1, math.ceil(math.log(max(n, 2) / CELL) / -math.log(far)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - near**depth)) if near**depth < recall else 1
    return depth, tables


class Projections:
    """The random projections and offsets; the same in every task for a seed."""

    def __init__(self, dims: int, depth: int, tables: int, counted: int, r: float, seed: int):
        rng = np.random.default_rng(seed)
        self.cut = rng.standard_normal((dims, depth * tables))
        self.shift = rng.random(depth * tables)
        self.count = rng.standard_normal((dims, counted))
        self.mix = rng.integers(0, 1 << 63, (tables, depth), np.int64).astype(np.uint64) | np.uint64(1)
        self.depth, self.tables, self.width = depth, tables, WIDTH * r

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of every vector in every table, as 64-bit numbers."""
        at = np.floor(x @ self.cut / self.width + self.shift).astype(np.int64).astype(np.uint64)
        at = at.reshape(len(x), self.tables, self.depth)
        out = np.zeros((len(x), self.tables), np.uint64)
        for k in range(self.depth):
            out = (out ^ at[:, :, k]) * self.mix[:, k]
            out ^= out >> np.uint64(29)
        return out


def unit(vectors: list[bytes], dims: int, kind: str = "<f4") -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(-1, dims).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # no square leaves the range of doubles
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def joined(find: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest among links (a, b); ``find`` holds the parents."""
    forest = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = x, y
        while find[rx] != rx:
            find[rx] = find[find[rx]]
            rx = find[rx]
        while find[ry] != ry:
            find[ry] = find[find[ry]]
            ry = find[ry]
        if rx != ry:
            find[ry] = rx
            forest.append((x, y))
    return forest


def linked_pairs(
    group: np.ndarray, own: np.ndarray, cross: np.ndarray, table: np.ndarray,
    x: np.ndarray, p: np.ndarray, cells: np.ndarray, need: int, r: float, min_cosine: float,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked row pairs inside groups; where ``cross``, only pairs of different blocks.

    Rows are ordered by (group, first projection), so that what is in reach of a row
    is a range; pairs are handled a bounded number at a time.
    """
    at = group * 1e4 + p[:, 0]
    order = np.argsort(at, kind="stable")
    at = at[order]
    n = np.searchsorted(at, at + REACH * r, "right") - np.arange(len(at)) - 1
    counted, half = p.shape[1], HALF * r
    ends = np.cumsum(n)
    k = 0
    while k < len(at):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        m = n[k:stop]
        first = np.repeat(np.arange(k, stop), m)
        later = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(m) - m, m)
        i, j = order[first], order[later]
        fits = ~cross[i] | (own[i] != own[j])
        i, j = i[fits], j[fits]
        hits = np.zeros(len(i), np.int8)
        for t in range(counted):
            hits += np.abs(p[i, t] - p[j, t]) <= half
            if t % 4 == 0:  # pairs that can't reach the count any more are dropped
                keep = hits >= need - (counted - 1 - t)
                i, j, hits = i[keep], j[keep], hits[keep]
        keep = hits >= need
        i, j = i[keep], j[keep]
        for t in range(int(table.max())):  # a pair counts in the first table where it shares a cell
            new = (table[i] <= t) | (cells[i, t] != cells[j, t])
            i, j = i[new], j[new]
        same = np.einsum("ij,ij->i", x[i], x[j]) >= min_cosine
        yield i[same], j[same]
        k = stop


LINKS = "node long, links long, other long"


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    min_cosine: float = 0.95,
    recall: float = 0.995,
    counted: int = COUNTED,
    seed: int = 1,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``."""
    spark = vectors.sparkSession
    small_batches(spark)
    wide = vectors.schema[vector_col].dataType.simpleString() == "array<double>"
    kind, width = ("<f8", 8) if wide else ("<f4", 4)
    value = F.transform(F.col(vector_col), lambda v: v.cast("double" if wide else "float"))
    fine = (F.size(vector_col) > 0) & ~F.exists(
        vector_col, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))
    ) & F.exists(vector_col, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, value).alias("v"))

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None else (np.asarray(a, kind) + np.zeros(1, kind)).tobytes())

    rows = stored(rows.withColumn("v", packed("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("v is not null").groupBy("v")
    classes = classes.agg(F.min("row").alias("node"), F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = stored(classes, "vector-classes")
    n = classes.count()
    r = math.sqrt(2 - 2 * min_cosine)
    each = 1 - (1 - recall) / 2
    depth, tables = plan(n, min_cosine, each)
    need = least_count(counted, each)
    make = (depth, tables, counted, r, seed)
    columns = "dims int, table int, cell long, node long, copies long, v binary"
    cell_schema = schema_of(columns)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, Projections] = {}
        for batch in batches:
            sizes = pc.divide(pc.binary_length(batch.column("v")), width).to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                own = lines.setdefault(dims, Projections(dims, *make))
                cells = own.cells(unit(part.column("v").to_pylist(), dims, kind)).view(np.int64)
                same = pa.array(np.full(len(cells), dims, np.int32))
                for t in range(tables):
                    arrays = [same, pa.array(np.full(len(cells), t, np.int32)), pa.array(cells[:, t].copy()), part.column("node"), part.column("copies"), part.column("v")]
                    yield pa.RecordBatch.from_arrays(arrays, schema=cell_schema)

    placed = classes.select("node", "copies", "v").mapInArrow(to_cells, columns)
    sizes = classes.select("node", "copies", "v").mapInArrow(to_cells, columns)
    sizes = sizes.select("dims", "table", "cell").groupBy("dims", "table", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "vector-cells")
    placed = placed.join(sizes.drop("n"), ["dims", "table", "cell"])
    # block b of a cell takes part in the pairs (b, 0), (b, 1), ..., each a group of its own
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own")
    pairs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
    dealt = placed.select("dims", "table", "cell", "node", "copies", "v", own, "blocks").select("*", pairs)
    dealt = dealt.withColumns({"a": F.least("own", "with"), "b": F.greatest("own", "with")})

    keys = ["dims", "table", "cell", "a", "b"]

    def count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Projections] = {}
        out = schema_of(LINKS)

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for dims in rows.column("dims").unique().to_pylist():
                yield linked(rows.filter(pc.equal(rows.column("dims"), dims)), dims)

        def linked(rows: pa.Table, dims: int) -> pa.RecordBatch:
            lines = known.setdefault(dims, Projections(dims, *make))
            table, cell, first, second, own, nodes, copies = (rows.column(c).to_numpy() for c in [*keys[1:], "own", "node", "copies"])
            new = np.ones(len(nodes), bool)
            new[1:] = (table[1:] != table[:-1]) | (cell[1:] != cell[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            x = unit(rows.column("v").to_pylist(), dims, kind)
            links, find, forest = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), []
            found = linked_pairs(np.cumsum(new), own, first != second, table, x, x @ lines.count, lines.cells(x), need, r, min_cosine)
            for i, j in found:
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                forest += joined(find, i, j)
            some = np.flatnonzero(links)
            ends = np.array(forest, np.int64).reshape(-1, 2)
            node = np.concatenate([nodes[some], nodes[ends[:, 0]]])
            other = np.concatenate([np.full(len(some), -1, np.int64), nodes[ends[:, 1]]])
            n_links = np.concatenate([links[some], np.zeros(len(ends), np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(n_links), pa.array(other)], schema=out)

        # rows come ordered by group; whole groups are handled, some thousand rows at a time
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < ROWS:
                continue
            ends = [held.column(c).to_numpy() for c in keys]
            last = np.flatnonzero(~np.logical_and.reduce([e == e[-1] for e in ends]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from done(held)

    grouped = dealt.select(*keys, "own", "node", "copies", "v").repartition(*keys).sortWithinPartitions(*keys)
    found = stored(grouped.mapInArrow(count_links, LINKS), "vector-links")

    counts = found.where("other < 0").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")), "vector-components")
    known = classes.join(counts, "node", "left").join(groups, "node", "left")
    known = known.select("v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    known = stored(known, "vector-known")
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(smallest, "component").select("v", "n_links", "component_id")
    linked = rows.where("v is not null").join(known, "v").select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
