"""Files in and out."""

import datetime as dt
import json

import pytest

from numerale.operators import calendar, metrics
from numerale.sources import (
    as_series,
    explode_logprobs,
    parse_time,
    read_completions,
    read_observations,
    read_predictions,
    read_token_logprobs,
    rejected_times,
    rejected_values,
    write_table,
)


def test_observation_file_to_weeks(spark, tmp_path):
    (tmp_path / "obs.csv").write_text("Date,tmax\n2020-01-01,3.5\n2020-01-05,\n2020-01-06,1.0\nnot a day,9.0\n2020-01-20,NaN\n")
    raw = read_observations(spark, str(tmp_path / "obs.csv"))
    assert raw.dtypes == [("Date", "string"), ("tmax", "double")]
    assert [r.Date for r in rejected_times(raw, "Date").collect()] == ["not a day"]
    from pyspark.sql import functions as F

    bound = as_series(parse_time(raw, "Date"), [F.lit("weather")], "ts", "tmax")
    rows = sorted(map(tuple, calendar.weekly_series(bound).collect()), key=lambda r: r[2])
    days = [dt.date(2020, 1, d) for d in (5, 12, 19, 26)]
    assert rows == [("weather", d, k, 4, y) for k, (d, y) in enumerate(zip(days, [3.5, 1.0, None, None]))]


def test_time_with_pattern(spark):
    df = spark.createDataFrame([("03/02/2021",), ("2021",), (None,)], "d string")
    got = [r.ts for r in parse_time(df, "d", "dd/MM/yyyy").collect()]
    assert got == [dt.datetime(2021, 2, 3), None, None]
    assert rejected_times(df, "d", "dd/MM/yyyy").count() == 1


def test_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "obs.csv").write_text("Day,other\n2020-01-01,3.5\n")
    with pytest.raises(ValueError, match="(?i)header"):
        read_observations(spark, str(tmp_path / "obs.csv"))


def test_observations_with_further_columns(spark, tmp_path):
    (tmp_path / "obs.csv").write_text("tmin,Date,tmax\n1,2020-01-01,3.5\n?,2020-01-05,\n2,2020-01-06,n/a\n")
    raw = read_observations(spark, str(tmp_path / "obs.csv"))
    assert raw.dtypes == [("tmin", "double"), ("Date", "string"), ("tmax", "double")]
    assert [tuple(r) for r in raw.collect()] == [(1.0, "2020-01-01", 3.5), (None, "2020-01-05", None), (2.0, "2020-01-06", None)]
    assert {tuple(r) for r in rejected_values(spark, str(tmp_path / "obs.csv")).collect()} == {("tmin", 1), ("tmax", 1)}


def test_predictions_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",test,arima\n0,1.0,1.5\n1,2.0,1.0\n")
    wide = read_predictions(spark, str(tmp_path / "p.csv"), ["arima"])
    assert [tuple(r) for r in wide.orderBy("step").collect()] == [(0, 1.0, 1.5), (1, 2.0, 1.0)]
    assert metrics.unpivot_models(wide).count() == 2


def test_predictions_are_bound_by_name(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",naive,test,sarima\n2020-01-12,3,2.0,x\n2020-01-05,1,1.0,4\n2020-02-02,5,,6\n")
    wide = read_predictions(spark, str(tmp_path / "p.csv"))
    assert wide.columns == ["step", "test", "naive", "sarima"]
    assert [tuple(r) for r in wide.orderBy("step").collect()] == [(0, 1.0, 1.0, 4.0), (1, 2.0, 3.0, None), (2, None, 5.0, 6.0)]
    counts = rejected_values(spark, str(tmp_path / "p.csv"), ["_c0"])
    assert {r["column"]: r.rejected for r in counts.collect()}["sarima"] == 1
    with pytest.raises(ValueError, match="arima2"):
        read_predictions(spark, str(tmp_path / "p.csv"), ["arima2"])


def test_logprobs_json(spark, tmp_path):
    line = {
        "series_id": "a", "pid": 0, "tokens": [" 1", " ,"], "token_logprobs": [None, -0.5],
        "top_logprobs": [None, {" ,": -0.5, " the": -2.0}],
    }
    (tmp_path / "lp.json").write_text(json.dumps(line) + "\n")
    rows = explode_logprobs(read_token_logprobs(spark, str(tmp_path / "lp.json"))).orderBy("pos").collect()
    assert [(r.pos, r.tok, r.logprob, r.top) for r in rows] == [
        (0, " 1", None, None), (1, " ,", -0.5, {" ,": -0.5, " the": -2.0})
    ]


def test_tables_and_completions(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([("a", 0, 0, " 1 ,"), ("b", 0, 1, " 2 ,")], "series_id string, pid int, sample_id int, text string")
    write_table(df, path)
    assert read_completions(spark, path).exceptAll(df).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        write_table(df, path)
    scores = spark.createDataFrame([("basic", 1.0), ("gaussian", 2.0)], "kind string, s double")
    write_table(scores, str(tmp_path / "s"), ["kind"])
    assert (tmp_path / "s" / "kind=basic").is_dir()


def test_lines_of_text(spark):
    from numerale.sources import accepted, parse_csv_lines, parse_json_lines, rejected

    lines = ["a,2024-01-02T00:00:00,1.5", "b,2024-01-03T00:00:00,", "c,yesterday,2", "d,2024-01-04T00:00:00,x", "", 'e,"2024-01-05T00:00:00",7', None]
    read = parse_csv_lines(spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, line string"))
    assert read.columns == ["k", "series_id", "ts", "value", "_corrupt"]
    assert {r.k: r.value for r in accepted(read).where("series_id is not null").collect()} == {0: 1.5, 1: None, 5: 7.0}
    assert {r[0] for r in rejected(read).collect()} >= {lines[2], lines[3]}
    texts = ['{"series_id": "a", "pid": 1, "sample_id": 0, "text": " 1 ,"}', '{"series_id": "b", "pid"', "[]"]
    answers = parse_json_lines(spark.createDataFrame([(t,) for t in texts], "line string"))
    assert [r.text for r in accepted(answers).where("series_id is not null").collect()] == [" 1 ,"]
    assert texts[1] in {r[0] for r in rejected(answers).collect()}


def test_a_job_run_again_leaves_one_copy(spark, tmp_path):
    from numerale.sources import write_table

    rows = spark.createDataFrame([("m", 1), ("m", 2), ("n", 3)], "model string, x int")
    path = str(tmp_path / "t")
    for part in (rows, rows.where("model = 'm'"), rows.where("model = 'm'")):
        write_table(part, path, ["model"], mode="replace_parts")
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="partition_by"):
        write_table(rows, path, mode="replace_parts")


def test_a_table_by_series_is_joined_without_a_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F

    from numerale.sources import write_bucketed

    rows = spark.range(200).select((F.col("id") % 9).alias("series_id"), F.col("id").alias("x"))
    for _ in range(2):  # a second run replaces the first
        write_bucketed(rows, "by_series_a", 4)
    write_bucketed(rows, "by_series_b", 4)
    a, b = spark.table("by_series_a"), spark.table("by_series_b").withColumnRenamed("x", "z")
    joined = a.join(b.hint("merge"), "series_id").groupBy("series_id").agg(F.sum("z").alias("z"))
    assert a.count() == 200 and "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    for t in ("by_series_a", "by_series_b"):
        spark.sql(f"DROP TABLE {t}")
