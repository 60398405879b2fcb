"""Scores from landed answers agree with the offline scores, and nothing asked for is lost."""

import pytest
from pyspark.sql import functions as F

from numerale import TextFormat
from numerale.catalog.inputs import s1
from numerale.operators import nexttoken
from numerale.plans import tuning
from numerale.sources import gather_logprobs

FMT = TextFormat()


def test_landed_scores_equal_offline_scores(spark, sf):
    grid = tuning.param_grid({"alpha": [0.2, 0.8], "beta": [0.0], "prec": [2], "temp": [1.0]})
    series = s1(spark, sf)
    rows = tuning.scoring_rows(series, grid, FMT, 30, 4097, 1.2)
    kept = rows.where((F.col("i") >= F.col("cut")) | ~F.col("train"))
    contexts = nexttoken.context_tokens(kept.select("series_id", "pid", "i", "chunk", "split"), FMT)
    model = nexttoken.fit_next_token(contexts, F.col("split") == "train")
    responses = gather_logprobs(nexttoken.score_tokens(model, contexts, FMT))
    requests = tuning.scoring_requests(series, grid, FMT)
    assert requests.where("status = 'ok' and prompt != ''").count() == 10
    want = {(r.series_id, r.pid): r for r in tuning.evaluate_grid(series, grid, FMT).collect()}
    got = {(r.series_id, r.pid): r for r in tuning.evaluate_responses(requests, responses, grid, FMT).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.status, r.alpha, r.prec) == ("ok", want[k].alpha, 2) and r.nlld == pytest.approx(want[k].nlld, abs=1e-5)
    some = responses.where("pid = 0")
    left = {r.pid: r.status for r in tuning.evaluate_responses(requests, some, grid, FMT).collect()}
    assert left == {0: "ok", 1: "no_answer"}
    best = tuning.best_params(tuning.evaluate_responses(requests, some, grid, FMT))
    assert [r.pid for r in best.collect()] == [0] * 5


def test_temperatures_are_scored_once(spark, tiny):
    grid = tuning.param_grid({"alpha": [0.5], "beta": [0.15], "prec": [1, 2], "temp": [0.5, 1.0]})
    rows = sorted((r.series_id, r.pid, r.prec, r.temp, r.nlld) for r in tuning.evaluate_grid(s1(spark, tiny), grid, FMT).collect())
    assert [r[1:4] for r in rows[:4]] == [(p["pid"], p["prec"], p["temp"]) for p in grid]
    assert all(a[4] == b[4] for a, b in zip(rows[::2], rows[1::2])) and len(rows) == 20
