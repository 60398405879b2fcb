"""Matches against a plain edit distance over every stretch, and recall on edited passages."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from numerale.llm.decontaminate import best_stretch, contaminated, remove_contaminated, repeats_for


def plain_best(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item):
        new = [k + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=20))
def test_distance(item, text):
    assert best_stretch(item, text)[0] == plain_best(item, text)


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([2, 4, 6])))


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    common = [word(rng) for _ in range(60)]
    pick = lambda n: [rng.choice(common) if rng.random() < 0.4 else word(rng) for _ in range(n)]
    items = [(k, " ".join(pick(rng.choice([15, 20, 35, 60])))) for k in range(30)]
    docs = []
    for d in range(240):
        text = pick(rng.choice([20, 100, 300]))
        if d % 3 == 0:
            passage = items[d % 30][1].split()
            for _ in range(rng.randint(0, int(0.12 * len(passage)))):
                at = rng.randrange(len(passage))
                passage[at : at + rng.randint(0, 1)] = [word(rng)] * rng.randint(0, 1)
            at = rng.randrange(len(text))
            text[at:at] = passage
        docs.append((d, " ".join(text).replace(" ", "\n", 2).upper() if d % 2 else " ".join(text)))
    return items, docs


def test_against_all_stretches(spark, cases):
    items, docs = cases
    got = contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    found = {(r.doc_id, r.item_id): r.distance for r in got}
    want = {}
    for d, text in docs:
        words = text.lower().split()
        have = set(words)
        for i, item in items:
            item = item.split()
            allowed = int(0.2 * len(item) + 1e-9)
            if sum(w in have for w in item) >= len(item) - allowed:
                distance = plain_best(item, words)
                if distance <= allowed:
                    want[d, i] = distance
    assert len(want) >= 80 and set(found) <= set(want)  # nothing beyond the distance
    assert len(found) >= 0.97 * len(want)
    assert all(found[k] >= want[k] for k in found) and sum(found[k] == want[k] for k in found) >= 0.97 * len(found)
    assert {k for k, v in want.items() if v == 0} <= set(found)  # every exact copy


def test_short_items_and_blocks(spark, monkeypatch):
    from numerale.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 16)
    items = [(1, "alpha beta"), (2, "gamma"), (2, "delta epsilon zeta"), (3, None), (4, " "), (None, "eta theta")]
    docs = [(1, "x Alpha\nbeta y"), (2, "alpha x beta"), (3, "the gamma ray"), (4, "delta epsilon zeta"), (5, "eta theta")]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (3, 2), (4, 2), (5, None)}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog again and again"), (1, "ein anderer text ganz ohne bezug")], "item_id long, text string")
    kept = remove_contaminated(odd, items)
    assert kept.columns == odd.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert {i for i, _ in left} == {None, 3, 4, 5, 6, 7} and len([x for x in left if x[0] == 4]) == 2
    assert contaminated(none, items).count() == 0 and contaminated(odd, items.where("false")).count() == 0


def test_repeats_follow_the_recall():
    assert repeats_for(0.5, 0.2) < repeats_for(0.95, 0.2) < repeats_for(0.99, 0.3)


@pytest.mark.parametrize("words", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60])
def test_recall_at_the_full_number_of_edits(words):
    from numerale.llm.decontaminate import SHORT, Index

    rng = random.Random(words)
    edits, trials = int(0.2 * words + 1e-9), 200
    items = [(k, " ".join(word(rng) + str(k) for _ in range(words)).encode()) for k in range(trials)]
    index = Index(items, repeats_for(0.95, 0.2), 0.2, 12, 8, 4, 1)
    texts = []
    for _, text in items:
        passage = text.decode().split()
        for _ in range(edits):
            at = rng.randrange(len(passage))
            passage[at : at + rng.randint(0, 1)] = [word(rng)] * rng.randint(0, 1)
        around = [[word(rng) for _ in range(rng.randint(0, 30))] for _ in range(2)]
        texts.append(" ".join([*around[0], *passage, *around[1]]).encode())
    found = index.search([index.known(t) for t in texts])
    assert all(t == k for t, k in found)  # words of one item stand in no other
    assert len(found) >= (trials if words < SHORT else 0.95 * trials)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=7), min_size=1, max_size=4), st.lists(st.sampled_from("abcde"), max_size=25))
def test_short_items_are_found_exactly(items, text):
    from numerale.llm.decontaminate import Index

    index = Index([(k, " ".join(w).encode()) for k, w in enumerate(items)], 1, 0.2, 12, 8, 4, 1)
    found = index.search([index.known(" ".join(text).encode())])
    best = {k: plain_best(w, text) for k, w in enumerate(items)}
    assert {k: d[0] for (_, k), d in found.items()} == {k: d for k, d in best.items() if d <= int(0.2 * len(items[k]) + 1e-9)}


def test_one_block_at_a_time(spark, monkeypatch):
    from numerale.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    items = [(k, f"item number {k} alpha{k} beta{k} gamma{k}") for k in range(12)]
    docs = [(k % 5, f"x{k} y item number {k} alpha{k} beta{k} gamma{k} z", "a") for k in range(0, 30, 2)] + [(None, None, "b"), (None, "clean", "c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, row string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    blocks, makes = decontaminate.indexes(spark, asked)
    sizes = [len(make().items) for make in makes]
    assert blocks > 5 and sum(sizes) == 12 and max(sizes) < 6
    assert sorted(r.item_id for r in contaminated(frame, asked).collect()) == [0, 2, 4, 6, 8, 10]
    left = decontaminate.keep_clean(frame, asked)
    assert left.columns == frame.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in frame.collect() if not (r.text or "").startswith(("x0 ", "x2 ", "x4 ", "x6 ", "x8 ", "x10 ")))
