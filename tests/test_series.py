"""Calendar, scalers, splits and checks against pandas and numpy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from numerale.operators import calendar, checks, scaling
from numerale.sources import as_series


def observations(seed=1, series=4, rows=400):
    rng = random.Random(seed)
    out = []
    for s in range(series):
        for _ in range(rows // (s + 1)):
            day = dt.datetime(2019, 12, 20) + dt.timedelta(days=rng.randrange(700), hours=rng.randrange(24))
            value = rng.choice([None, float("nan"), round(rng.uniform(-50, 100), 2)]) if rng.random() < 0.3 else round(rng.uniform(-50, 100), 2)
            out.append((f"s{s}", day, value))
    # a third of everything belongs to one series and one week
    out += [("s0", dt.datetime(2020, 6, 3), 1.25)] * (len(out) // 2)
    return out


@pytest.fixture(scope="module")
def obs():
    return observations()


@pytest.fixture(scope="module")
def series(spark, obs):
    raw = spark.createDataFrame(obs, "id string, at timestamp_ntz, v double")
    return calendar.weekly_series(as_series(raw, ["id"], "at", "v"), 2)


def test_weeks_as_pandas(obs, series):
    got = {(r.series_id, r.wk): (r.i, r.n, r.y) for r in series.collect()}
    frame = pd.DataFrame(obs, columns=["id", "at", "v"]).astype({"v": float})
    seen = 0
    for sid, part in frame.groupby("id"):
        weekly = part.resample("W", on="at")["v"].mean()
        for k, (wk, y) in enumerate(weekly.items()):
            i, n, value = got[(sid, wk.date())]
            assert (i, n) == (k, len(weekly))
            assert (value is None and np.isnan(y)) or value == pytest.approx(y, abs=1e-9)
            seen += 1
    assert seen == len(got)


def test_partitions_do_not_matter(spark, obs):
    raw = spark.createDataFrame(obs, "id string, at timestamp_ntz, v double")
    results = []
    for n in (1, 13):
        s = calendar.weekly_series(as_series(raw.repartition(n), ["id"], "at", "v"), 2)
        results.append(sorted(map(str, scaling.attach_scaler(s, "advanced").withColumn("z", scaling.scaled()).collect())))
    assert results[0] == results[1]


def test_several_id_columns_do_not_collide(spark):
    raw = spark.createDataFrame([("a|b", "c", 1.0), ("a", "b|c", 2.0)], "x string, y string, v double")
    raw = raw.withColumn("at", F.lit("2020-01-01").cast("timestamp_ntz"))
    assert as_series(raw, ["x", "y"], "at", "v").select("series_id").distinct().count() == 2


def arrays(series):
    out = {}
    for r in sorted(series.collect(), key=lambda r: r.i):
        out.setdefault(r.series_id, []).append(np.nan if r.y is None else r.y)
    return {k: np.array(v) for k, v in out.items()}


def test_scalers_as_numpy(series):
    data = arrays(series)
    for kind in scaling.KINDS:
        table = {r.series_id: r for r in scaling.fit_scaler(series, kind, 0.8, 0.15).collect()}
        inline = {
            r.series_id: r for r in scaling.attach_scaler(series, kind, 0.8, 0.15).select("series_id", "offset", "scale").distinct().collect()
        }
        for sid, values in data.items():
            y = values[~np.isnan(values)]
            if kind == "identity":
                want = (0.0, 1.0)
            elif kind == "gaussian":
                want = (y.mean(), y.std())
            elif kind == "basic":
                want = (0.0, max(np.quantile(abs(y), 0.8), 0.01))
            else:
                low = y.min() - 0.15 * (y.max() - y.min())
                want = (low, np.quantile(y - low, 0.8))
            for row in (table[sid], inline[sid]):
                assert (row.offset, row.scale) == pytest.approx(want)


def test_guards(spark):
    rows = [("flat", 0, 5.0), ("flat", 1, 5.0), ("zero", 0, 0.0), ("none", 0, None), ("gap", 0, 1.0), ("gap", 1, None)]
    s = spark.createDataFrame(rows, "series_id string, i int, y double")
    basic = {r.series_id: r.scale for r in scaling.fit_basic(s).collect()}
    assert basic == {"flat": 5.0, "zero": 0.01, "none": None, "gap": 1.0}
    advanced = {r.series_id: (r.offset, r.scale) for r in scaling.fit_advanced(s).collect()}
    assert advanced["flat"] == (5.0, 1.0) and advanced["none"] == (None, None)
    z = scaling.transform(s, scaling.fit_gaussian(s)).collect()
    assert all(r.z is None for r in z)
    kept = {r.series_id: r.scale for r in scaling.fit_advanced(s, missing="propagate").collect()}
    assert kept["gap"] is None and kept["flat"] == 1.0
    with pytest.raises(ValueError):
        scaling.fit_scaler(s, "minmax")
    with pytest.raises(ValueError):
        scaling.fit_scaler(s, missing="zero")


def test_inverse_and_slope(series):
    for kind in scaling.KINDS:
        table = scaling.fit_scaler(series, kind)
        back = scaling.inverse(scaling.transform(series, table), table)
        assert back.where("abs(x - y) > 1e-9 or (x is null) <> (y is null)").count() == 0
        for r in scaling.log_slope(table).collect():
            assert r.log_slope == pytest.approx(-np.log(r.scale))


def test_holdout_and_concat(series):
    marked = calendar.split_holdout(series, 30)
    for sid, y in arrays(series).items():
        val = marked.where((F.col("series_id") == sid) & (F.col("split") == "val")).count()
        assert val == len(y[-30:])
    short = calendar.split_holdout(series, 10_000)
    assert short.where("split = 'train'").count() == 0
    train, val = marked.where("split = 'train'"), marked.where("split = 'val'")
    again = calendar.concat_splits(train, val.withColumn("i", F.col("i") + 5))
    a, b = arrays(again), arrays(series)
    assert all(np.array_equal(a[k], b[k], equal_nan=True) for k in b)


def test_head_profile_and_steps(series):
    assert all(r.i < 3 for r in calendar.head_per_series(series, 3).collect())
    for r in calendar.series_profile(series).collect():
        y = arrays(series)[r.series_id]
        assert (r.steps, r.gaps) == (len(y), np.isnan(y).sum())
    stepped = calendar.with_step(series.drop("i"))
    assert stepped.exceptAll(series.select(*stepped.columns)).count() == 0


def test_checks(spark, series):
    for r in checks.check_positive(series).collect():
        assert r.violations == (arrays(series)[r.series_id] <= 0).sum()
    positive = series.withColumn("y", F.abs("y") + 1)
    z = scaling.attach_scaler(positive, "basic", 0.9).withColumn("z", scaling.scaled())
    assert all(r.ok for r in checks.check_unit_quantile(z, 0.9).collect())
    assert checks.check_unique_step(series).count() == 0
    assert checks.check_unique_step(series.unionByName(series)).count() == series.count()
    truth = series.select("series_id", F.col("i").alias("step"), "y")
    bench = truth.select("series_id", "step", F.col("y").alias("test"))
    assert checks.check_truth(bench, truth).count() == 0
    changed = bench.where("step > 0").withColumn("test", F.when(F.col("step") == 2, F.lit(1e9)).otherwise(F.col("test")))
    kinds = {r.problem for r in checks.check_truth(changed, truth).collect()}
    assert "not_in_benchmark" in kinds and kinds & {"differs", "missing_value"}


def test_absent_columns_fail_while_building(spark):
    with pytest.raises(ValueError):
        calendar.resample_mean(spark.range(1))
