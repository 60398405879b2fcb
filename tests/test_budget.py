"""The cut against a loop that tries every suffix."""

import random

import pytest
from pyspark.sql import functions as F

from numerale import TextFormat
from numerale.operators import budget, nexttoken, textnum
from numerale.operators.scaling import attach_scaler
from numerale.plans.prepare import prepare

FMT = TextFormat()


def chunk_rows(spark, lengths, seed=5):
    rng = random.Random(seed)
    rows = []
    for s, n in enumerate(lengths):
        for i in range(n):
            z = None if rng.random() < 0.1 else rng.choice([1, -1]) * 10 ** rng.uniform(-4, 4)
            rows.append((f"s{s}", i, z))
    df = spark.createDataFrame(rows, "series_id string, i int, z double").repartition(5)
    return budget.count_tokens(textnum.chunks(df, FMT), FMT)


def try_every_suffix(costs, steps, context, multiplier):
    n = len(costs)
    for i in range(n):
        total = sum(costs[i:])
        per_step = total / (n + 1 - i)
        if total + steps * per_step * multiplier < context:
            return i
    return None


@pytest.mark.parametrize("context", [30, 60, 150, 400, 10_000])
def test_cut(spark, context):
    rows = chunk_rows(spark, [1, 2, 30, 80, 200])
    costs = {}
    for r in sorted(rows.collect(), key=lambda r: r.i):
        costs.setdefault(r.series_id, []).append(r.n_tok)
    marked = budget.mark_budget(rows, 6, context, 1.2)
    report = {r.series_id: r for r in budget.truncation_report(marked).collect()}
    prompts = {r.series_id: r.prompt for r in budget.prompts(marked, FMT).collect()}
    kept = {r.series_id: r["count"] for r in budget.truncate_to_budget(rows, 6, context).groupBy("series_id").count().collect()}
    for sid, own in costs.items():
        cut = try_every_suffix(own, 6, context, 1.2)
        r = report[sid]
        if cut is None:
            assert (r.kept, r.status, prompts[sid]) == (0, "does_not_fit", "") and sid not in kept
            assert r.discarded == len(own)
        else:
            assert (r.discarded, r.kept, r.tokens, r.status) == (cut, len(own) - cut, sum(own[cut:]), "ok")
            assert r.avg_tokens == pytest.approx(sum(own[cut:]) / (len(own) + 1 - cut))
            assert kept[sid] == r.kept and prompts[sid].count(" ,") == r.kept


def test_whole_series_and_request(spark):
    rows = [("a", i, float(i + 1)) for i in range(20)]
    series = attach_scaler(spark.createDataFrame(rows, "series_id string, i int, y double"), "basic")
    whole = prepare(series, FMT, truncate=False).first()
    assert (whole.discarded, whole.kept, whole.status) == (0, 20, "ok") and whole.prompt.endswith(" ,")
    request = nexttoken.build_requests(prepare(series, FMT, n_steps=12), FMT, 12, 0.7, 5).first()
    assert request.max_tokens == int(whole.tokens / 21 * 12 * 1.05)
    assert request.bias == {t: 30 for t in [f" {d}" for d in range(10)] + [" ,", " -"]}
    assert (request.n_samples, request.seed) == (5, 1234)


def test_caller_owned_counts(spark):
    rows = chunk_rows(spark, [50]).withColumn("n_tok", F.lit(100))
    assert budget.truncation_report(budget.mark_budget(rows, 1, 1000, 1.0)).first().kept == 9
