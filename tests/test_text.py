"""Numbers to text and back against literal examples and plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from numerale import TextFormat
from numerale.functions import ensure_terminated, token_array, token_codes, token_count, token_of_code
from numerale.operators import textnum
from numerale.operators.budget import tokens

DECIMAL, GREEDY = TextFormat(), TextFormat(digit_mode="greedy")


def frame(spark, values, **more):
    rows = [("a", k, v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, i int, z double").repartition(3)


def by_step(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("i").collect()]


def digits(spark, values, fmt):
    return by_step(textnum.digits(frame(spark, values), fmt), "digits")


def loop_digits(value, fmt):
    """Position by position in float64."""
    rest, out = abs(value), []
    positions = [fmt.base ** float(k) for k in range(fmt.int_digits - 1, -1, -1)]
    positions += [float(fmt.base) ** -k for k in range(1, fmt.prec + 1)]
    for weight in positions:
        out.append(int(rest / weight))
        rest = rest - out[-1] * weight
    while len(out) > 1 and out[0] == 0:
        out.pop(0)
    return "".join(map(str, out))


def test_documented_digits(spark):
    assert digits(spark, [0.123, 1.23, 1.2345, 0.0, 0.3], DECIMAL) == ["123", "1230", "1234", "0", "300"]


def test_greedy_drift(spark):
    values = [0.123, 1.23, 1.2345, 0.3, 0.7, 1.0]
    assert digits(spark, values, GREEDY) == ["122", "1229", "1234", "299", "699", "1000"]


@pytest.mark.parametrize(
    "fmt", [GREEDY, TextFormat(prec=2, base=2, digit_mode="greedy"), TextFormat(prec=0, digit_mode="greedy")]
)
def test_greedy_against_loop(spark, fmt):
    rng = random.Random(7)
    values = [rng.uniform(-1000, 1000) for _ in range(300)] + [k / 100 for k in range(300)] + [0.0, -0.0, 123456.789]
    assert digits(spark, values, fmt) == [loop_digits(v, fmt) for v in values]


def test_decimal_is_exact_on_two_decimals(spark):
    cents = list(range(0, 100000, 37))
    assert digits(spark, [c / 100 for c in cents], DECIMAL) == [str(c * 10) for c in cents]


def test_prec_zero_is_the_integer_part(spark):
    assert digits(spark, [12.9, 0.4, 7.0], TextFormat(prec=0)) == ["12", "0", "7"]


def test_missing_and_overflow(spark):
    rows = textnum.digits(frame(spark, [None, float("nan"), 1.2e8, 9_999_999.0]), DECIMAL)
    assert by_step(rows, "digits", "overflow")[2:] == [("120000000000", True), ("9999999000", False)]
    assert by_step(rows, "digits")[:2] == [None, None]
    for fmt in (DECIMAL, GREEDY):
        chunks = by_step(textnum.chunks(frame(spark, [None, float("nan")]), fmt), "chunk")
        assert chunks == [" Nan", " Nan"]
    wide = by_step(textnum.chunks(frame(spark, [1.2e8]), GREEDY), "chunk")
    assert wide == [" 120 0 0 0 0 0 0 0 0 0"]


def test_huge_values_keep_all_digits(spark):
    assert digits(spark, [1e17, 1.5e18], TextFormat(prec=2)) == ["1" + "0" * 19, "15" + "0" * 19]


def test_prec_column(spark):
    rows = frame(spark, [1.25, 1.25, 1.25]).withColumn("prec", F.col("i"))
    for fmt in (DECIMAL, GREEDY):
        want = ["1", "12", "125"] if fmt is DECIMAL else [loop_digits(1.25, TextFormat(prec=k)) for k in range(3)]
        assert by_step(textnum.digits(rows, fmt), "digits") == want


def test_chunks_and_string(spark):
    rows = textnum.chunks(frame(spark, [0.12, -0.034, None, 0.0, -1e-9]), DECIMAL)
    assert by_step(rows, "chunk") == [" 1 2 0", " - 3 4", " Nan", " 0", " - 0"]
    text = textnum.series_string(rows, DECIMAL).first().text
    assert text == " 1 2 0 , - 3 4 , Nan , 0 , - 0 ,"


def test_other_signs_and_separators(spark):
    fmt = TextFormat(prec=1, plus_sign="+", minus_sign="-", time_sep=";", bit_sep="_", missing_str="?")
    rows = textnum.chunks(frame(spark, [1.5, -2.0, None]), fmt)
    assert by_step(rows, "chunk") == ["+_1_5", "-_2_0", "?"]
    toks = by_step(rows.withColumn("t", token_array("chunk", fmt)), "t")
    assert toks == [["+", "_1", "_5", ";"], ["-", "_2", "_0", ";"], ["?", ";"]]
    back = textnum.decode_steps(
        textnum.split_completion(spark.createDataFrame([("a", "+_1_5;-_2_0;+_9")], "series_id string, text string"), fmt),
        fmt,
    )
    assert [round(r.z, 6) for r in back.orderBy("step").collect()] == [1.55, -2.05]


@pytest.mark.parametrize("fmt", [DECIMAL, GREEDY, TextFormat(prec=2, plus_sign=" +"), TextFormat(prec=1, bit_sep="")])
def test_tokens_codes_and_counts(spark, fmt):
    values = [0.0, 12.5, -3.75, None, -0.001, 999.999]
    rows = textnum.chunks(frame(spark, values), fmt)
    long = tokens(rows, fmt).groupBy("i").agg(F.expr("array_sort(collect_list(struct(j, tok)))").alias("t"))
    spelled = {r.i: "".join(t.tok for t in r.t) for r in long.collect()}
    both = rows.select("i", "chunk", token_codes("chunk", fmt).alias("codes"), F.size(token_array("chunk", fmt)).alias("n"))
    for r in both.collect():
        assert spelled[r.i] == r.chunk + fmt.time_sep
        assert len(r.codes) == r.n
        words = {c: t for t, c in fmt.codes.items()}
        assert "".join(words[c] for c in r.codes) == r.chunk + fmt.time_sep
    if fmt.bit_sep:
        counted = rows.select((token_count("chunk", fmt) + 1).alias("n_tok"), F.size(token_array("chunk", fmt)).alias("n"))
        assert all(r.n_tok == r.n for r in counted.collect())
    else:
        with pytest.raises(ValueError):
            token_count("chunk", fmt)


def test_token_outside_the_vocabulary_is_marked(spark):
    row = spark.range(1).select(token_codes(F.lit(" 120 5"), GREEDY).alias("c")).first()
    assert row.c == "?5,"
    back = spark.range(1).select(token_of_code(F.lit("5"), GREEDY).alias("a"), token_of_code(F.lit("?"), GREEDY).alias("b"))
    assert tuple(back.first()) == (" 5", "?")


def test_missing_marker_cost(spark):
    fmt = TextFormat(missing_tokens=3)
    row = spark.range(1).select(
        token_count(F.lit(" Nan"), fmt).alias("one"), token_count(F.lit(" 1 2 , Nan , Nan ,"), fmt).alias("more")
    ).first()
    assert tuple(row) == (3, 2 + 1 + 3 + 1 + 3 + 1)


def test_terminated(spark):
    row = spark.range(1).select(
        ensure_terminated(F.lit(" 1"), DECIMAL).alias("a"), ensure_terminated(F.lit(" 1 ,"), DECIMAL).alias("b")
    ).first()
    assert tuple(row) == (" 1 ,", " 1 ,")


COMPLETIONS = {
    " 1 2 0 , - 3 4 , 0 , 9 9": ([0.1205, -0.0345, 0.0005], 3),
    " 1 0 0 0 , 7 ,": ([1.0005], 1),
    " 1 x , 5 , 6": ([None, 0.0055], 0),
    " Nan , 5 , 6": ([None, 0.0055], 0),
    " , 5 , 6": ([0.0055], 1),
    " 12 3 , -4 , 6": ([0.1235, -0.0045], 2),
    " 7 ,\t 5 1\n, 6 , 2  3 , 1": ([0.0075, None, 0.0065, None], 1),
    " +5 , 1_0 , 3 , 4": ([None, None, 0.0035], 0),
    "": ([], 0),
    " 1": ([], 0),
}


def test_completions_literal(spark):
    rows = [("a", k, text) for k, text in enumerate(COMPLETIONS)]
    df = spark.createDataFrame(rows, "series_id string, sample_id int, text string")
    whole = {r.sample_id: r for r in textnum.decode_completions(df, DECIMAL).collect()}
    long = textnum.decode_steps(textnum.split_completion(df, DECIMAL), DECIMAL).collect()
    for k, (text, (want, usable)) in enumerate(COMPLETIONS.items()):
        got = [None if z is None else round(z, 9) for z in whole[k].zs]
        if text.startswith(" 7 ,\t"):
            # the separator is ' ,' exactly: "\n," does not end a step
            assert got[0] == 0.0075 and whole[k].usable == 1
            continue
        assert got == want, text
        assert whole[k].usable == usable, text
        steps = sorted((r.step, None if r.z is None else round(r.z, 9), r.malformed) for r in long if r.sample_id == k)
        assert steps == [(s, z, z is None) for s, z in enumerate(want)]


def test_half_bin(spark):
    df = spark.createDataFrame([("a", " 1 2 , 0")], "series_id string, text string")
    for half, want in ((True, 0.125), (False, 0.12)):
        fmt = TextFormat(prec=2, half_bin=half)
        assert math.isclose(textnum.decode_steps(textnum.split_completion(df, fmt), fmt).first().z, want)


@pytest.mark.parametrize("fmt", [DECIMAL, GREEDY, TextFormat(prec=5), TextFormat(prec=4, base=3, digit_mode="greedy")])
def test_round_trip_within_half_a_bin(spark, fmt):
    rng = random.Random(3)
    values = [rng.uniform(-50, 50) for _ in range(500)] + [0.0, 1.0, -1.0]
    rows = textnum.chunks(frame(spark, values), fmt)
    text = textnum.series_string(rows, fmt).withColumn("text", F.concat("text", F.lit(" 0")))
    got = {r.step: r.z for r in textnum.decode_steps(textnum.split_completion(text, fmt), fmt).collect()}
    half = 0.5 / fmt.base**fmt.prec
    for k, v in enumerate(values):
        # greedy digits may be a whole bin low, see the drift
        slack = half * (3 if fmt.digit_mode == "greedy" else 1) + 1e-9
        assert abs(got[k] - v) <= slack, (v, got[k])


def test_format_is_checked():
    for bad in (dict(digit_mode="other"), dict(base=2), dict(prec=-1), dict(time_sep="")):
        with pytest.raises(ValueError):
            TextFormat(**bad)
