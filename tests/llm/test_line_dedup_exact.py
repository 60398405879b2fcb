"""Exactly the deletions of a plain search: every run that stands earlier goes, nothing else."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from numerale.llm.line_dedup import LINE_END, lines_of, remove_repeated_lines


def cut(text):
    import re

    return re.split(LINE_END, text)


def plain(rows, min_words=25):
    """Texts and lines removed, rows in their order (id, then as given)."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = {}, [None] * len(rows)
    for k in order:
        text = rows[k][1]
        if not text:
            out[k] = (rows[k][0], text, 0)
            continue
        lines = cut(text)
        bare = [x.strip(" \t\r\n") for x in lines]
        words = [x.count(" ") + 1 for x in bare]
        gone = set()
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += words[b]
                if total >= min_words:
                    window = tuple(bare[a : b + 1])
                    if seen.get(window, (k, a)) != (k, a):
                        gone |= set(range(a, b + 1))
                    seen.setdefault(window, (k, a))
                    if total - words[b] >= min_words + 30:
                        break
        out[k] = (rows[k][0], "".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return sorted(out, key=str)


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.text, r.lines_removed) for r in remove_repeated_lines(frame, **options).collect()]
    assert sorted(got, key=str) == plain(rows, **options)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + "."


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.choice([1, 2, 3, 5, 8, 14, 30])) for _ in range(60)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(2, 9))] for _ in range(15)]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(0, 8)):
            kind = rng.random()
            if kind < 0.35:
                parts += [sentence(rng, rng.choice([3, 9, 20]))]
            elif kind < 0.6:
                parts += [rng.choice(pool)]
            else:
                run = rng.choice(runs)
                a = rng.randrange(len(run))
                parts += run[a : a + rng.randint(1, 9)]
        rows.append((rng.choice([None, rng.randrange(200), 7]), rng.choice([" ", "\n"]).join(parts)))
    rows += rng.sample(rows, 20)
    check(spark, rows)


def test_stitched_lines_stay(spark):
    rng = random.Random(4)
    shared = [sentence(rng, 14) for _ in range(4)]
    rows = [(k, f"{sentence(rng, 9)} {shared[k]} {sentence(rng, 9)}") for k in range(4)] + [(9, " ".join(shared))]
    check(spark, rows)
    assert plain(rows) == sorted(((i, t, 0) for i, t in rows), key=str)


def test_rows_without_or_with_one_id(spark):
    rng = random.Random(5)
    run = " ".join(sentence(rng, 8) for _ in range(5))
    rows = [(None, f"{sentence(rng, 9)} {run}"), (None, f"{run} {sentence(rng, 7)}"), (1, f"{run} a."), (1, f"b. {run}"), (5, run)]
    rows += [(None, run)] * 5
    check(spark, rows)


def test_hot_places_meet_by_broadcast(spark, monkeypatch):
    from numerale.llm import line_dedup

    monkeypatch.setattr(line_dedup, "max", lambda *x: 3 if x[0] == 1000 else max(*x), raising=False)
    rng = random.Random(6)
    runs = [" ".join(sentence(rng, 8) for _ in range(5)) for _ in range(3)]
    check(spark, [(k, f"{sentence(rng, 9)} {runs[k % 3]} {sentence(rng, 6)} {runs[k % 2]}") for k in range(40)])


def test_periodic_and_long_texts(spark):
    rng = random.Random(7)
    a, b = sentence(rng, 4), sentence(rng, 13)
    check(spark, [(1, " ".join([a] * 30)), (2, " ".join([a, b] * 12)), (3, " ".join([b, a, b] * 9)), (4, "x" * 50_000 + ". " + " ".join([b] * 5))])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("a. ,\n\x01;", max_size=12), min_size=1, max_size=8))
def test_lines_are_those_of_the_pattern(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lines_of(F.col("t")).alias("u")).collect()
    assert all(r.u == cut(r.t) for r in rows)


NAMES = ["doc", "row", "id", "th", "flag", "gone", "slot", "bucket", "map", "a.b", "lines_removed", "`q`"]


def test_columns_of_the_user(spark):
    schema = "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    run = " ".join(f"word{k}" for k in range(30)) + ", "
    rows = [(k, run + str(k), *(f"{n}{k}" for n in NAMES)) for k in range(3)]
    out = remove_repeated_lines(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", *NAMES, "lines_removed_"]
    for r in out.collect():
        assert list(r)[2:-1] == [f"{n}{r.doc_id}" for n in NAMES] and (r["lines_removed_"] > 0) == (r.doc_id > 0)


@pytest.mark.parametrize("min_words", [1, 4, 25, 60])
def test_winnowing_of_texts(spark, min_words):
    from numerale.llm.line_dedup import line_table

    rng = random.Random(11)
    own = [sentence(rng, n) for n in (1, 2, 3, 5, 9, 30)]
    texts = [" ".join(rng.choices(own, k=rng.randint(1, 40))) for _ in range(60)] + ["a. " * 70, "\n".join("b" * 9), "é, ü. x\ty"]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "id long, row long, text string")
    table = line_table(rows, min_words)
    for r in table.collect():
        size = len(r.h)
        least = [min((n for n in range(1, size - i + 1) if sum(r.nw[i : i + n]) >= min_words), default=0) for i in range(size)]
        key = [h & (2**63 - 1) if n < 5 else h | -(2**63) for h, n in zip(r.h, r.nw)]
        places = {min(range(i, i + n), key=lambda k: (key[k], k)) for i, n in enumerate(least) if n}
        assert r.w == least and [tuple(x) for x in r.s] == sorted((key[p], p) for p in places)
    # nothing is ordered by an interpreted comparison, and the sums of words are made once per line
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "nw4" in plan


@pytest.mark.parametrize("min_words", [8, 17, 25])
def test_stretches_of_many_lines(spark, min_words):
    from numerale.llm.line_dedup import line_table

    rng = random.Random(12)
    own = [sentence(rng, n) for n in (1, 1, 1, 1, 2, 6)]
    texts = [rng.choice([" ", "\n", " \t", "\r\n "]).join(rng.choices(own[: rng.randint(1, 6)], k=rng.randint(1, 70))) for _ in range(60)]
    table = line_table(spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "id long, row long, text string"), min_words)
    for r in table.collect():
        size = len(r.h)
        words = [min(x.strip(" \t\r\n").count(" ") + 1, min_words) for x in cut(texts[r.id])]
        least = [min((n for n in range(1, size - i + 1) if sum(words[i : i + n]) >= min_words), default=0) for i in range(size)]
        key = [h & (2**63 - 1) if n < 5 else h | -(2**63) for h, n in zip(r.h, words)]
        places = {min(range(i, i + n), key=lambda k: (key[k], k)) for i, n in enumerate(least) if n}
        assert r.nw == words and r.w == least and [tuple(x) for x in r.s] == sorted((key[p], p) for p in places)
    # the words of a stretch, however many lines it has, are not added up line by line
    assert "aggregate(" not in table._jdf.queryExecution().optimizedPlan().toString()
