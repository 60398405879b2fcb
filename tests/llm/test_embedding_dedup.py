"""Links against all pairs in double precision."""

import math

import numpy as np
import pytest

from numerale.llm.embedding_dedup import BLOCK, COUNTED, HALF, least_count, near_duplicates, plan

SCHEMA = "vec_id long, embedding array<float>, label int, node long, v string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, None, None, None) for i, v in rows], SCHEMA).repartition(4)


def brute(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    x = np.stack([v / np.sqrt((v * v).sum()) for _, v in good])
    linked = x @ x.T >= 0.95
    ids = [i for i, _ in good]
    label = list(ids)
    changed = True
    while changed:
        new = [min(label[j] for j in np.flatnonzero(linked[k])) for k in range(len(ids))]
        changed, label = new != label, new
    return {i: (int(linked[k].sum()) - 1, label[k]) for k, i in enumerate(ids)}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((300, 32))
    rows = []
    for k in range(1500):
        v = centres[k % 300] / np.linalg.norm(centres[k % 300])
        noise = rng.standard_normal(32) / math.sqrt(32)
        rows.append((k, (v + noise * rng.choice([0, 0.05, 0.2, 0.33])).tolist() if k >= 300 else v.tolist()))
    rows += [(2000 + k, [2 * c for c in rows[0][1]]) for k in range(40)]  # scaled copies: one direction
    return rows


def test_links(spark, vectors):
    got = {r.id: r for r in near_duplicates(frame(spark, vectors)).collect()}
    want = brute(vectors)
    assert got.keys() == want.keys()
    found, there = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert there > 5000 and 0.99 * there <= found <= there
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.99 * len(want)
    assert all(r.kept == (r.id == r.component_id) for r in got.values())


def test_dense_cell_is_cut_into_blocks(spark, monkeypatch):
    from numerale.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    rng = np.random.default_rng(5)
    rows = [(k, (np.eye(16)[0] + 0.01 * rng.standard_normal(16)).tolist()) for k in range(400)]
    got = near_duplicates(frame(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(399, 0)} and sum(r.kept for r in got) == 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 0.01]), (None, None), (10, [-0.0, 1.0]), (11, [0.0, 1.0])]
    got = sorted((r.id or -1, r.n_links, r.component_id or -1, r.kept) for r in near_duplicates(frame(spark, rows)).collect())
    one = [(i, 3, 1, i == 1) for i in (-1, 1, 2, 2)]
    alone = [(i, 0, i, True) for i in (-1, 3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted([*one, *alone, (10, 1, 10, True), (11, 1, 10, False)])
    empty = frame(spark, rows[:1]).where("false")
    assert near_duplicates(empty).count() == 0
    assert near_duplicates(frame(spark, [(3, None)])).collect()[0].n_links == 0


def test_parameters():
    p = math.erf(HALF / math.sqrt(2))
    k = least_count(COUNTED, 0.999)
    assert sum(math.comb(COUNTED, j) * p**j * (1 - p) ** (COUNTED - j) for j in range(k)) <= 0.001
    small, large = plan(10_000, 0.95, 0.99), plan(1_000_000_000, 0.95, 0.99)
    assert small[0] < large[0] and small[1] < large[1] < 400 and BLOCK > 100


def test_vectors_of_every_length_and_doubles(spark):
    rows = [(k, [1.0, k / 1000]) for k in range(5)] + [(10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.0]), (12, [1.0, 2.0, 3.01]), (13, [5.0] * 40)]
    got = {r.id: (r.n_links, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == {**{k: (4, 0) for k in range(5)}, 10: (2, 10), 11: (2, 10), 12: (2, 10), 13: (0, 13)}
    # cosines just above and below the threshold that single precision cannot tell apart, and components of any size
    c = 0.95
    pair = lambda x, eps: [x, [x[0] * (c + eps) - x[1] * math.sqrt(1 - (c + eps) ** 2), x[0] * math.sqrt(1 - (c + eps) ** 2) + x[1] * (c + eps)]]
    for scale in (1.0, 1e200, 1e-200):
        above, below = pair([scale, 0.0], 1e-12), pair([0.0, scale], -1e-12)
        rows = spark.createDataFrame([(k, v) for k, v in enumerate([*above, *[[-a, -b] for a, b in below]])], "vec_id long, embedding array<double>")
        assert sorted((r.id, r.n_links) for r in near_duplicates(rows).collect()) == [(0, 1), (1, 1), (2, 0), (3, 0)]
