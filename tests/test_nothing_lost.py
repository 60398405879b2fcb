"""No step, sample or series disappears."""

import math

import pytest
from pyspark.sql import functions as F

from numerale import TextFormat
from numerale.operators import metrics, nexttoken
from numerale.operators.textnum import chunks, decode_completions, series_string

FMT = TextFormat()
INF = float("inf")


def texts(spark, values, fmt):
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "series_id string, i int, z double")
    return [r.chunk for r in chunks(rows, fmt).orderBy("i").collect()], series_string(chunks(rows, fmt), fmt).collect()[0].text


@pytest.mark.parametrize("mode", ["decimal", "greedy"])
def test_values_of_any_size(spark, mode):
    values = [1.0, 1e26, 1e36, -1e300, 2.0, INF, -INF, float("nan"), None, 1.7e308, 3.0]
    got, text = texts(spark, values, TextFormat(digit_mode=mode))
    assert len(got) == len(values) and None not in got
    assert text.count(" ,") == len(values) and [c == " Nan" for c in got] == [v is None or not math.isfinite(v) for v in values]
    whole = lambda c: int(c.replace("-", "").replace(" ", ""))
    for value, chunk in zip(values, got):
        if chunk != " Nan":
            wanted = int(abs(value)) * 1000
            assert abs(whole(chunk) - wanted) * 10**9 <= wanted
            assert chunk.startswith(" -") == (value < 0)


def test_many_places_in_greedy_mode(spark):
    fmt = TextFormat(prec=16, digit_mode="greedy")
    got, _ = texts(spark, [0.5], fmt)
    assert got == [" 5" + " 0" * 15]
    rows = spark.createDataFrame([("a", 0, 0.5, 16)], "series_id string, i int, z double, prec int")
    with pytest.raises(Exception, match="max_prec"):
        chunks(rows, TextFormat(digit_mode="greedy")).collect()
    wide = chunks(rows, TextFormat(digit_mode="greedy", max_prec=16)).collect()
    assert wide[0].chunk == got[0]


def test_empty_and_missing_answers_count_as_no_steps(spark):
    requests = spark.createDataFrame([("a", "p"), ("b", "q")], "series_id string, prompt string")
    answers = {"a": [" 1 ,", None, " 2 ,"], "b": []}
    got = nexttoken.complete_with(requests, lambda rows: [answers[k] for k in rows["series_id"]])
    rows = sorted(map(tuple, got.collect()))
    assert rows == [("a", 0, " 1 ,"), ("a", 1, ""), ("a", 2, " 2 ,"), ("b", 0, "")]
    assert {tuple(r) for r in metrics.common_horizon(decode_completions(got, FMT)).collect()} == {("a", 0, 3), ("b", 0, 1)}


def test_series_without_forecast_stay(spark):
    benchmark = spark.createDataFrame([(s, k, "naive", 1.0) for s in "ab" for k in range(3)], "series_id string, step int, model string, yhat double")
    forecast = spark.createDataFrame([("a", 0, 5.0), ("a", 1, 6.0)], "series_id string, step int, yhat double")
    rows = metrics.attach_model(benchmark, forecast, "mine")
    got = sorted((r.series_id, r.step, r.model, r.yhat) for r in rows.collect() if r.model == "mine" or r.series_id == "a")
    assert [g[:3] for g in got] == [("a", 0, "mine"), ("a", 0, "naive"), ("a", 1, "mine"), ("a", 1, "naive"), *[("b", k, "mine") for k in range(3)]]
    assert rows.where("series_id = 'b' and model = 'naive'").count() == 3
    truth = spark.createDataFrame([(s, k, 1.0) for s in "ab" for k in range(3)], "series_id string, step int, y double")
    by = {r.model: r for r in metrics.compare_models(rows, truth).collect()}
    assert (by["mine"].compared, by["mine"].unmatched, by["mine"].series_without_forecast, by["mine"].mae) == (2, 3, 1, 4.5)
    assert (by["naive"].compared, by["naive"].unmatched, by["naive"].series_without_forecast) == (5, 0, 0)


def test_cold_draws_take_the_first_of_tied_tokens(spark):
    fmt = TextFormat(prec=0)
    words = fmt.vocabulary
    pairs = [("a", p, q, t, 7) for p in words for q in words for t in words]
    model = spark.createDataFrame(pairs, "series_id string, p2 string, p1 string, tok string, c long")
    request = [("a", " 1 ,", 200, 0.0, 3, 1)]
    requests = spark.createDataFrame(request, "series_id string, prompt string, max_tokens int, temperature double, n_samples int, seed long")
    got = nexttoken.sample_completions(model, requests, fmt).collect()
    assert [r.text for r in got] == [words[0] * 200] * 3


def test_draws_do_not_depend_on_the_block(spark, monkeypatch):
    fmt = TextFormat(prec=0)
    model = spark.createDataFrame([("a", " 1", " ,", t, 3 + k) for k, t in enumerate(fmt.allowed_tokens())], "series_id string, p2 string, p1 string, tok string, c long")
    request = [("a", " 1 ,", 150, 1.0, 4, 9)]
    requests = spark.createDataFrame(request, "series_id string, prompt string, max_tokens int, temperature double, n_samples int, seed long")
    draw = lambda: sorted((r.sample_id, r.text) for r in nexttoken.sample_completions(model, requests, fmt).collect())
    whole = draw()
    monkeypatch.setattr(nexttoken, "DRAW_BLOCK", 7)
    assert draw() == whole


def test_series_that_cannot_be_forecast_keep_a_row(spark):
    from numerale.plans.forecast import forecast, forecast_samples

    long = [("good", i, 60, float(i % 7 + 1), "train") for i in range(60)]
    rows = long + [("none", i, 20, None, "train") for i in range(20)] + [("wide", 0, 2, 1.0, "train"), ("wide", 1, 2, 1e300, "train")]
    rows += [("val", i, 5, 2.0, "val") for i in range(5)]
    series = spark.createDataFrame(rows, "series_id string, i int, n int, y double, split string")
    options = {"fit_on": F.col("split") == "train", "n_steps": 4}
    got = forecast(series, TextFormat(), **options).collect()
    status = {r.series_id: r.status for r in got}
    assert status == {"good": "ok", "none": "no_training_part", "wide": status["wide"], "val": "no_training_part"}
    assert sorted(r.series_id for r in got if r.step is None) == sorted(k for k, v in status.items() if v != "ok")
    assert all(r.yhat is None for r in got if r.step is None) and sum(r.series_id == "good" for r in got) >= 1
    assert {r.series_id for r in forecast_samples(series, TextFormat(), **options).collect()} == {k for k, v in status.items() if v == "ok"}
    landed = spark.createDataFrame([("good", 0, " 1 ,")], "series_id string, sample_id int, text string")
    assert {r.series_id: r.status for r in forecast(series, TextFormat(), completions=landed, **options).collect()}["good"] == "no_common_step"
    nothing = forecast(series, TextFormat(), completions=landed.where("false"), **options).collect()
    assert {r.series_id: r.status for r in nothing}["good"] == "no_answer" and len(nothing) == 4
    grid = [{"pid": 0, "alpha": 0.2, "beta": 0.15, "prec": 2, "temp": 1.0}]
    best = spark.createDataFrame([("good", 0)], "series_id string, pid int")
    tuned = {r.series_id: r.status for r in forecast(series, TextFormat(), grid=grid, best=best, **options).collect()}
    assert tuned == {"good": "ok", "none": "no_usable_score", "wide": "no_usable_score", "val": "no_usable_score"}


def test_requests_that_do_not_fit_stay(spark):
    from numerale.operators.nexttoken import build_requests, complete_with, fit_next_token, sample_completions

    prepared = spark.createDataFrame([("a", " 1 ,", 2.0, "ok"), ("b", "", None, "does_not_fit")], "series_id string, prompt string, avg_tokens double, status string")
    requests = build_requests(prepared, TextFormat(), 3)
    assert {r.series_id: (r.max_tokens, r.status) for r in requests.collect()} == {"a": (6, "ok"), "b": (None, "does_not_fit")}
    asked = complete_with(requests, lambda rows: [[" 5 ,"] * 2 for _ in rows["prompt"]]).collect()
    assert sorted((r.series_id, r.sample_id, r.text) for r in asked) == [("a", 0, " 5 ,"), ("a", 1, " 5 ,"), ("b", 0, "")]
    model = fit_next_token(spark.createDataFrame([("b", " 1", " ,", " 1")], "series_id string, p2 string, p1 string, tok string"))
    drawn = sample_completions(model, requests, TextFormat(), ["status"]).collect()
    assert sorted((r.series_id, r.status, r.text) for r in drawn) == [("a", "no_model", ""), ("b", "does_not_fit", "")]


def test_wide_report_keeps_steps_of_both_sides(spark):
    from numerale.operators.metrics import wide_report

    rows = spark.createDataFrame([("a", 0, "m", 1.0), ("a", 1, "n.x", 2.0), ("b", 0, "m", None)], "series_id string, step int, model string, yhat double")
    truth = spark.createDataFrame([("a", 0, 5.0), ("c", 3, 6.0)], "series_id string, step int, y double")
    got = wide_report(rows, truth)
    assert got.columns == ["series_id", "step", "y", "m", "n.x"]
    assert sorted(map(tuple, got.collect())) == [("a", 0, 5.0, 1.0, None), ("a", 1, None, None, 2.0), ("b", 0, None, None, None), ("c", 3, 6.0, None, None)]
    with pytest.raises(ValueError, match="called"):
        wide_report(rows.replace("m", "y", "model"), truth)
