"""Sums with the same bits however the rows lie, and row numbers without one task."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from numerale.operators.calendar import off_scale, resample_mean, weekly_series
from numerale.operators.exact import exact_mean
from numerale.operators.numbering import number_rows

SCHEMA = "series_id string, ts timestamp_ntz, value double"


@pytest.fixture(scope="module")
def observations(spark):
    import datetime

    rng = random.Random(4)
    rows = []
    for _ in range(4000):
        value = rng.choice([None, 0.0, rng.gauss(0, 1), rng.gauss(0, 1) * 10 ** rng.randint(-12, 12), 0.1, -0.1])
        rows.append((rng.choice("abc"), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=rng.randrange(30)), value))
    return rows


def means(rows):
    return {(r.series_id, r.wk): r.y for r in rows.collect()}


def test_mean_has_the_same_bits_in_any_order(spark, observations):
    frames = []
    for k, parts in enumerate((1, 3, 7, 13)):
        rows = observations[:]
        random.Random(k).shuffle(rows)
        frames.append(means(resample_mean(spark.createDataFrame(rows, SCHEMA).repartition(parts))))
    assert all(f == frames[0] for f in frames)
    groups = {}
    for s, ts, v in observations:
        monday = ts.date().toordinal() - ts.weekday()
        groups.setdefault((s, monday + 6), []).append(v)
    for (s, wk), y in frames[0].items():
        values = [v for v in groups[s, wk.toordinal()] if v is not None]
        assert y == pytest.approx(math.fsum(values) / len(values), rel=1e-15, abs=1e-300)
    assert weekly_series(spark.createDataFrame(observations, SCHEMA)).count() > 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e300, max_value=1e300), min_size=1, max_size=6))
def test_digits_add_up(spark, values):
    rows = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    got = exact_mean(rows, ["g"], ["v"]).first().v
    assert got == pytest.approx(math.fsum(values) / len(values), rel=1e-14, abs=5e-324 * 8)


def test_extremes_and_nothing(spark):
    rows = [(1, 5e-324), (1, 5e-324), (2, 1.7e308), (2, -1.7e308), (3, None), (4, 2.0**-1022), (5, -0.0), (6, 2.0**500), (6, None), (7, 2.0**-500)]
    got = {r.g: r.v for r in exact_mean(spark.createDataFrame(rows, "g int, v double"), ["g"], ["v"]).collect()}
    assert got == {1: 5e-324, 2: 0.0, 3: None, 4: 2.0**-1022, 5: 0.0, 6: 2.0**500, 7: 2.0**-500}


def test_several_columns_keep_their_names(spark):
    rows = spark.createDataFrame([(1, 1.5, None), (1, 2.5, 4.0)], "g int, v double, `w` double")
    assert [tuple(r) for r in exact_mean(rows, ["g"], ["w", "v"]).collect()] == [(1, 4.0, 2.0)]


def test_values_a_scale_does_not_hold_are_counted(spark):
    rows = spark.createDataFrame([("a", None, 1.23456), ("a", None, 1.25), ("b", None, None)], SCHEMA)
    got = {r.series_id: (r.observations, r.off_scale, r.largest) for r in off_scale(rows, 2).collect()}
    assert got == {"a": (2, 1, pytest.approx(0.00456)), "b": (0, 0, None)}


@pytest.mark.parametrize("range_rows", [7, 100, 10_000])
def test_numbers_with_ties_across_borders(spark, range_rows):
    rng = random.Random(range_rows)
    values = [rng.choice([None, 1.0, 1.0, 2.0, rng.random() * 5]) for _ in range(900)]
    rows = spark.createDataFrame([(v, str(k % 3)) for k, v in enumerate(values)], "v double, t string").repartition(5)
    out = number_rows(rows, [F.col("v"), F.col("t")], range_rows=range_rows)
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    got = sorted(out.collect(), key=lambda r: r.step)
    assert [r.step for r in got] == list(range(900)) and out.columns == ["v", "t", "step"]
    key = lambda r: (r.v is not None, r.v or 0, r.t)
    assert [key(r) for r in got] == sorted(map(key, got))
    assert number_rows(rows.where("false"), [F.col("v")]).count() == 0
