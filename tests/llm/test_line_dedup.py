"""Repeated runs against a plain search of repeated word windows."""

import random

from numerale.llm.line_dedup import lines_of, remove_repeated_lines
from pyspark.sql import functions as F


def result(docs, **options):
    return {r.doc_id: r.text for r in remove_repeated_lines(docs, **options).collect()}


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)) + "."


def test_lines_join_to_the_text(spark):
    texts = ["a, b.\nc d; e\n\n f", "", "one", "...", " x. \n y!? z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(lines_of(F.col("t")), "").alias("u"))
    assert all(r.t == r.u for r in rows.collect())


def test_passages_inside_lines_go(spark):
    rng = random.Random(5)
    passage = " ".join(sentence(rng, n) for n in (4, 9, 15, 8, 12, 10))
    rows = []
    for d in range(40):
        before, after = (" ".join(sentence(rng, 9) for _ in range(6)) for _ in range(2))
        rows.append((d, f"{before[:-1]} {passage} {after}" if d % 4 == 1 else f"{before}\n{after}"))
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    last = passage[passage.index(".") + 2 :]
    for d, text in rows:
        if d % 4 != 1 or d == 1:
            assert got[d] == text  # clean documents and the first copy
        else:
            assert last not in got[d] and got[d].startswith(text[:40]) and got[d].endswith(text[-60:])


def test_copies_and_repeats_inside_a_text(spark):
    rng = random.Random(6)
    one = " ".join(sentence(rng, 8) for _ in range(8))
    twice = " ".join(sentence(rng, 7) for _ in range(6))
    rows = [(3, one), (1, one), (2, f"{twice}\n{twice}\nend of it"), (4, "Is it. " * 400)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got[1] == one and got[3] == ""
    assert got[2].count(twice[5:40]) == 1 and got[2].endswith("end of it")
    assert 0 < len(got[4]) < 40


def test_repeats_go_whoever_holds_their_lines_first(spark):
    rng = random.Random(9)
    run = [sentence(rng, 9) for _ in range(4)]
    rows = [(k, f"{sentence(rng, 9)} {run[k]} {sentence(rng, 9)}") for k in range(4)]  # each line stands earlier, the run does not
    rows += [(7, " ".join([sentence(rng, 9), *run, sentence(rng, 9)])), (9, " ".join([sentence(rng, 9), *run, sentence(rng, 9)]))]
    own = [sentence(rng, 9) for _ in range(4)]
    parts = [own[0], sentence(rng, 9), own[1], sentence(rng, 9), own[2], sentence(rng, 9), own[3], sentence(rng, 9)]
    rows.append((12, " ".join([*parts, *own, sentence(rng, 9), *own, sentence(rng, 9)])))  # the same inside one text
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(got[k] == t for k, t in rows[:5])
    assert not any(line in got[9] for line in run) and got[9].count(".") == 2
    assert [got[12].count(line) for line in own] == [2] * 4


def test_short_repeats_stay(spark):
    rows = [(k, f"Licensed as ever, for all. Text number {k} {'xyz'[k]} goes on here.") for k in range(3)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == dict(rows)


def test_hot_passage(spark):
    rng = random.Random(8)
    passage = " ".join(sentence(rng, 8) for _ in range(7))
    rows = [(d, f"{sentence(rng, 12)} {passage} {sentence(rng, 12)}") for d in range(300)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sum(passage[60:200] in t for t in got.values()) == 1 and passage[60:200] in got[0]


def test_odd_rows(odd, none):
    out = remove_repeated_lines(odd)
    assert out.columns == [*odd.columns, "lines_removed"] and out.count() == odd.count()
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert (3, None) in got and (None, None) in got and got.count((4, "")) == 2 and got.count((7, "x")) == 1
    assert sum(t is not None and t.startswith("Ein anderer") for _, t in got) == 2  # a repeated row is one document
    assert remove_repeated_lines(none).count() == 0


def test_native_plan(odd):
    plan = remove_repeated_lines(odd)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
