"""What the two exact searches share: the best k answers of many queries, carried through a task."""

from __future__ import annotations

from heapq import heappush, heapreplace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for a null id: it comes after all others.
NO_ID = (1 << 63) - 1

#: One in so many shards is searched first; its k-th answers bound the search of all others.
FIRST = 16


class Best:
    """The best k (score, id) of one query: higher scores first, then smaller ids; ``floor`` is the k-th known so far."""

    def __init__(self, k: int, floor: tuple[int, int] | None = None):
        self.k, self.heap, self.floor = k, [], floor

    def beaten_by(self, score: int, least_id: int) -> bool:
        """Whether an answer with at most this score and at least this id can be among the best."""
        return self.floor is None or (score, -least_id) > self.floor

    def add(self, score: int, id_: int) -> None:
        entry = (score, -id_)
        if len(self.heap) < self.k:
            heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapreplace(self.heap, entry)
        if len(self.heap) == self.k and (self.floor is None or self.heap[0] > self.floor):
            self.floor = self.heap[0]


def seeds(uid: Column, first: bool) -> Column:
    """True for the shards that are searched first (or for all others)."""
    mine = F.pmod(F.xxhash64(uid), F.lit(FIRST)) == 0
    return mine if first else ~mine


def ranked(found: DataFrame, query: str, k: int, score: str = "score", id_col: str = "id") -> DataFrame:
    """The best k rows of each query with their rank; each task sends no more than its own best k."""
    order = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(id_col).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def floors(found: DataFrame, query: str, k: int) -> dict[int, tuple[int, int]]:
    """For each query of one block, its k-th answer among ``found``: a bound for the answers still to be found."""
    rows = ranked(found, query, k).where(F.col("rank") == k).collect()  # bounded: one row per query of a block
    return {r[query]: (r.score, -(NO_ID if r.id is None else r.id)) for r in rows}


def ids_array(values) -> np.ndarray:
    """Ids as int64, null as ``NO_ID``."""
    return np.array([NO_ID if v is None else v for v in values], np.int64)
