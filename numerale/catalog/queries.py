"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numerale.catalog.inputs import (
    FMT,
    FMT2,
    GREEDY,
    HORIZON,
    SEASON,
    analog_completions,
    fitted,
    rule_answers,
    rule_responses,
    s1,
    s2,
    s3,
    scalers_of,
    season_completions,
    truth_of,
)
from numerale.functions import ensure_terminated, week_end
from numerale.operators.numbering import number_rows
from numerale.operators import budget, calendar, checks, likelihood, metrics, nexttoken, scaling, textnum
from numerale.plans import forecast as forecasting
from numerale.plans import oneshot, prepare as preparing, tuning
from numerale.settings import CONTEXT_TOKENS, TextFormat
from numerale.sources import (
    accepted,
    as_series,
    explode_logprobs,
    load,
    orders_by_nation,
    orders_by_priority,
    parse_csv_lines,
    parse_json_lines,
    parse_time,
    rejected_observations as count_rejected,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Only for the queries whose point is the cut; all others use the method's own context.
SMALL_CONTEXT = 900


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- sources ------------------------------------------------------------------------------------


@query
def parse_times(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    orders = load(spark, sf, "orders").select(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("?"), text)).otherwise(text).alias("Date")
    )
    return parse_time(orders, "Date").groupBy("o_orderpriority").agg(
        F.count("ts").alias("parsed"),
        F.count_if(F.col("ts").isNull()).alias("rejected"),
        F.min(F.to_date("ts")).alias("first_day"),
        F.max(F.to_date("ts")).alias("last_day"),
    )


@query
def bind_series(spark, sf):
    bound = as_series(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_shipdate", "l_extendedprice")
    return bound.groupBy("series_id").agg(
        F.count("value").alias("observations"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")
    ).select("series_id.l_returnflag", "series_id.l_linestatus", "observations", F.col("total").cast("double").alias("total"))


@query
def rejected_observations(spark, sf):
    # a seventh of the rows without time, a fifth without id, values that are no numbers
    k = F.col("l_orderkey")
    value = F.when(k % 11 == 0, F.lit(float("inf"))).when(k % 13 == 0, F.lit(float("nan"))).when(k % 3 > 0, F.col("l_extendedprice"))
    rows = load(spark, sf, "lineitem").select(
        F.when(k % 5 > 0, F.col("l_suppkey")).alias("id"), F.when(k % 7 > 0, F.col("l_shipdate")).alias("ts"), value.alias("value")
    )
    return count_rejected(rows, ["id"], "ts", "value")


@query
def observations_parsed(spark, sf):
    """Observations as lines of text, some without a number: per series what was read and what was turned away."""
    key = F.col("o_orderkey")
    value = F.when(key % 9 == 0, F.lit("n/a")).when(key % 11 > 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).otherwise("")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    lines = load(spark, sf, "orders").select("o_orderpriority", F.concat_ws(",", "o_orderpriority", stamp, value).alias("line"))
    read = parse_csv_lines(lines)
    return read.groupBy("o_orderpriority").agg(
        F.count_if(F.col("_corrupt").isNull()).alias("accepted"), F.count("_corrupt").alias("rejected"), F.count("value").alias("values"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.min("_corrupt").alias("first_rejected"),
        F.min(F.to_date("ts")).alias("first_day"),
    )


@query
def predictions_parsed(spark, sf):
    """A wide benchmark as lines of text in any order: its rows numbered by the index, without one task for all."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    lines = load(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", price.cast("string"), (price * 2).cast("string")).alias("line"))
    read = accepted(parse_csv_lines(lines, schema="idx BIGINT, test DOUBLE, twice DOUBLE"))
    return number_rows(read, [F.col("idx")], range_rows=4000).select("step", "idx", "test", "twice")


@query
def completions_parsed(spark, sf):
    """Landed answers as JSON lines, some broken off: texts per sample, and the broken lines kept."""
    key = F.col("o_orderkey")
    whole = F.to_json(F.struct(F.col("o_orderpriority").alias("series_id"), F.lit(0).alias("pid"), (key % 5).cast("int").alias("sample_id"), F.concat(F.lit(" "), key.cast("string"), F.lit(" ,")).alias("text")))
    line = F.when(key % 13 == 0, F.substring(whole, F.lit(1), F.length(whole) - 4)).otherwise(whole)
    read = parse_json_lines(load(spark, sf, "orders").select((key % 5).cast("bigint").alias("sample"), line.alias("line")))
    return read.groupBy("sample").agg(
        F.count_if(F.col("_corrupt").isNull()).alias("accepted"), F.count("_corrupt").alias("rejected"),
        F.sum(F.when(F.col("_corrupt").isNull(), F.length("text"))).alias("characters"), F.max(F.length("_corrupt")).cast("bigint").alias("longest_rejected"),
    )


LINE_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_means(spark, sf):
    bound = as_series(load(spark, sf, "lineitem"), ["l_returnflag"], "l_shipdate", LINE_VALUES)
    return calendar.resample_mean(bound, LINE_VALUES, decimals=2)


@query
def weekly_mean_columns(spark, sf):
    return _line_means(spark, sf).select("series_id", "wk", *[r6(c).alias(c) for c in LINE_VALUES])


@query
def select_target(spark, sf):
    return calendar.select_target(_line_means(spark, sf), "l_quantity", ("series_id", "wk")).withColumn("value", r6("value"))


# --- calendar -----------------------------------------------------------------------------------


@query
def week_ends(spark, sf):
    return load(spark, sf, "orders").groupBy(week_end("o_orderdate").alias("wk")).agg(F.count(F.lit(1)).alias("orders"))


@query
def weekly_mean(spark, sf):
    return calendar.resample_mean(orders_by_nation(spark, sf), decimals=2).withColumn("y", r6("y"))


def _net(spark, sf):
    """Prices with as many decimals as a division leaves."""
    lines = load(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7).alias("net"))
    return as_series(lines, ["l_suppkey"], "l_shipdate", "net")


@query
def mean_any_order(spark, sf):
    """Means of doubles of any size without a stated number of decimals: added digit by digit."""
    return calendar.resample_mean(_net(spark, sf)).withColumn("y", r6("y"))


@query
def values_off_scale(spark, sf):
    rows = calendar.off_scale(_net(spark, sf), 2)
    return rows.select("series_id", "observations", "off_scale", r6("largest").alias("largest"))


@query
def weekly_spine(spark, sf):
    return s3(spark, sf).select("series_id", "wk", long("i").alias("i"), long("n").alias("n"), r6("y").alias("y"))


@query
def step_index(spark, sf):
    weekly = calendar.resample_mean(orders_by_priority(spark, sf), decimals=2)
    return calendar.with_step(weekly).select("series_id", "wk", long("i").alias("i"), r6("y").alias("y"))


@query
def head_per_series(spark, sf):
    return calendar.head_per_series(s3(spark, sf), 10).select("series_id", long("i").alias("i"), r6("y").alias("y"))


@query
def series_profile(spark, sf):
    p = calendar.series_profile(s3(spark, sf))
    return p.withColumns({"min_y": r6("min_y"), "max_y": r6("max_y")})


@query
def holdout(spark, sf):
    marked = calendar.split_holdout(s2(spark, sf), HORIZON)
    return marked.groupBy("series_id", "split").agg(
        F.count(F.lit(1)).alias("steps"), F.min("wk").alias("first_wk"), r6(F.avg("y")).alias("mean_y")
    )


@query
def concat_splits(spark, sf):
    marked = calendar.split_holdout(s1(spark, sf), HORIZON)
    train, val = marked.where("split = 'train'"), marked.where("split = 'val'")
    later = val.withColumn("i", F.col("i") - (F.col("n") - HORIZON))
    joined = calendar.concat_splits(train, later)
    return joined.select("series_id", long("i").alias("i"), r6("y").alias("y"))


# --- scaling ------------------------------------------------------------------------------------


def _scaler_table(df):
    return df.select("series_id", "kind", r6("offset").alias("offset"), r6("scale").alias("scale"))


@query
def scale_identity(spark, sf):
    return _scaler_table(scaling.fit_identity(s2(spark, sf)))


@query
def scale_gaussian(spark, sf):
    series = s2(spark, sf)
    z = scaling.transform(series, scaling.fit_gaussian(series))
    return z.select("series_id", long("i").alias("i"), r6("z").alias("z"))


@query
def scale_basic(spark, sf):
    return _scaler_table(scaling.fit_basic(s3(spark, sf), 0.9))


@query
def scale_advanced(spark, sf):
    return _scaler_table(scaling.fit_scaler(s2(spark, sf), "advanced"))


@query
def scale_transform(spark, sf):
    z = scaling.attach_scaler(s2(spark, sf), "advanced", 0.95, 0.3).withColumn("z", scaling.scaled())
    return z.select("series_id", long("i").alias("i"), r6("z").alias("z"))


@query
def scale_propagate(spark, sf):
    return _scaler_table(scaling.fit_advanced(s2(spark, sf), missing="propagate"))


@query
def scale_inverse(spark, sf):
    series = s2(spark, sf)
    table = scaling.fit_advanced(series)
    x = scaling.inverse(scaling.transform(series, table), table)
    return x.select("series_id", long("i").alias("i"), F.round("x", 4).alias("x"))


@query
def log_slope(spark, sf):
    return scaling.log_slope(scaling.fit_gaussian(s3(spark, sf))).select("series_id", r6("log_slope").alias("log_slope"))


# --- numbers to text ----------------------------------------------------------------------------


def _z(spark, sf):
    return fitted(s2(spark, sf)).withColumn("z", scaling.scaled())


@query
def digits_decimal(spark, sf):
    return textnum.digits(_z(spark, sf), FMT).select("series_id", long("i").alias("i"), "digits", "overflow")


@query
def digits_greedy(spark, sf):
    return textnum.digits(_z(spark, sf), GREEDY).select("series_id", long("i").alias("i"), "digits", "overflow")


@query
def chunks(spark, sf):
    return textnum.chunks(_z(spark, sf), FMT).select("series_id", long("i").alias("i"), "chunk")


@query
def chunks_greedy_overflow(spark, sf):
    # unscaled prices in cents exceed the integer positions: the first digit grows past 9
    rows = s3(spark, sf).withColumn("z", F.col("y") * 1000)
    rows = textnum.chunks(textnum.digits(rows, GREEDY), GREEDY)
    return rows.select("series_id", long("i").alias("i"), "chunk", "overflow")


@query
def chunks_of_any_size(spark, sf):
    """As many chunks as steps, from values of up to 1e41 and infinite ones."""
    z = F.when(F.col("i") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("y") * F.pow(F.lit(10.0), F.col("i") % 40))
    rows = textnum.chunks(s3(spark, sf).withColumn("z", z), FMT)
    text = textnum.series_string(rows, FMT)
    pieces = F.split(F.col("text"), F.lit(FMT.time_sep), -1)
    counts = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("steps"), F.count("chunk").alias("chunks"), F.count_if(F.col("chunk") == FMT.missing_str).alias("missing")
    )
    return counts.join(text, "series_id").select("series_id", "steps", "chunks", "missing", long(F.size(pieces) - 1).alias("in_text"))


@query
def series_string(spark, sf):
    return textnum.series_string(textnum.chunks(_z(spark, sf), FMT), FMT)


@query
def series_string_greedy(spark, sf):
    return textnum.series_string(textnum.encode(fitted(s1(spark, sf)), GREEDY), GREEDY)


@query
def terminated(spark, sf):
    rows = textnum.chunks(_z(spark, sf), FMT)
    open_text = F.when(F.col("split") == "val", F.concat("chunk", F.lit(FMT.time_sep))).otherwise(F.col("chunk"))
    return rows.select("series_id", long("i").alias("i"), ensure_terminated(open_text, FMT).alias("text"))


# --- token budget -------------------------------------------------------------------------------


def _counted(series, fmt=FMT):
    return budget.count_tokens(textnum.encode(fitted(series), fmt), fmt)


@query
def token_rows(spark, sf):
    rows = budget.tokens(textnum.encode(fitted(s2(spark, sf)), FMT), FMT)
    return rows.select("series_id", long("i").alias("i"), long("j").alias("j"), "tok")


@query
def token_counts(spark, sf):
    return _counted(s2(spark, sf)).select("series_id", long("i").alias("i"), long("n_tok").alias("n_tok"))


@query
def suffix_tokens(spark, sf):
    rows = budget.suffix_tokens(_counted(s3(spark, sf)))
    return rows.select("series_id", long("i").alias("i"), "suffix_tok", "suffix_steps")


@query
def truncate_budget(spark, sf):
    kept = budget.truncate_to_budget(_counted(s3(spark, sf)), 20, SMALL_CONTEXT)
    return kept.select("series_id", long("i").alias("i"), "chunk")


def _report_columns(df, *more):
    return df.select(
        "series_id", *more, "discarded", "kept", "tokens", r6("avg_tokens").alias("avg_tokens"), "status"
    )


@query
def truncate_report(spark, sf):
    marked = budget.mark_budget(_counted(s3(spark, sf)), 20, SMALL_CONTEXT)
    return _report_columns(budget.truncation_report(marked))


@query
def truncate_impossible(spark, sf):
    # a context below one step plus the answer: nothing fits, every series is reported
    marked = budget.mark_budget(_counted(s2(spark, sf)), 12, 30)
    return _report_columns(budget.truncation_report(marked))


@query
def prepare(spark, sf):
    rows = fitted(s3(spark, sf))
    return _report_columns(preparing.prepare(rows, FMT, True, 12, SMALL_CONTEXT), "prompt")


@query
def prepare_joined_digits(spark, sf):
    # digits without separators: tokens can't be told from spaces
    joined = TextFormat(bit_sep="")
    return _report_columns(preparing.prepare(fitted(s2(spark, sf)), joined, True, 12, SMALL_CONTEXT), "prompt")


@query
def digit_array(spark, sf):
    """One entry per position, so that a first digit above 9 stays one entry."""
    rows = s3(spark, sf).withColumn("z", F.col("y") * 1000)
    rows = textnum.digit_arrays(rows, GREEDY)
    return rows.select("series_id", long("i").alias("i"), F.concat_ws("|", "digit_array").alias("digits"), long(F.coalesce(F.size("digit_array"), F.lit(-1))).alias("n"))


@query
def prepare_whole(spark, sf):
    return _report_columns(preparing.prepare(fitted(s1(spark, sf)), FMT, truncate=False), "prompt")


# --- requests and the offline model -------------------------------------------------------------


def _requests(series, fmt=FMT, context=CONTEXT_TOKENS):
    prepared = preparing.prepare(fitted(series), fmt, True, 12, context)
    return nexttoken.build_requests(prepared, fmt, 12, 0.7, 5)


@query
def requests(spark, sf):
    return _requests(s3(spark, sf)).select(
        "series_id", "prompt", long("max_tokens").alias("max_tokens"), "temperature",
        long("n_samples").alias("n_samples"), "seed", long(F.size("bias")).alias("n_bias"), "status",
    )


@query
def requests_that_do_not_fit(spark, sf):
    """A context that holds a few steps only: series of large numbers are not asked for, and stay."""
    return _requests(s3(spark, sf), context=90).select("series_id", long("max_tokens").alias("max_tokens"), F.col("bias").isNull().alias("no_bias"), "status")


@query
def token_bias(spark, sf):
    rows = _requests(s1(spark, sf)).select("series_id", F.explode("bias").alias("tok", "bias"))
    return rows.select("series_id", "tok", long("bias").alias("bias"))


@query
def allowed_tokens(spark, sf):
    rows = budget.tokens(textnum.encode(fitted(s2(spark, sf)), FMT), FMT)
    return rows.groupBy("tok").agg(F.count(F.lit(1)).alias("uses")).select(
        "tok",
        "uses",
        F.col("tok").isin(FMT.allowed_tokens()).alias("may_complete"),
        F.col("tok").isin(FMT.allowed_tokens(scoring=True)).alias("may_score"),
    )


def _contexts(spark, sf):
    return nexttoken.context_tokens(textnum.encode(fitted(s1(spark, sf)), FMT2), FMT2)


@query
def next_token_counts(spark, sf):
    return nexttoken.fit_next_token(_contexts(spark, sf), F.col("split") == "train")


@query
def score_tokens(spark, sf):
    contexts = _contexts(spark, sf)
    model = nexttoken.fit_next_token(contexts, F.col("split") == "train")
    scored = nexttoken.score_tokens(model, contexts, FMT2)
    best = F.array_max(F.map_values("top"))
    return scored.select(
        "series_id", long("pos").alias("pos"), "tok", r6(F.col("logprob").cast("double")).alias("logprob"),
        long(F.size("top")).alias("n_top"), r6(best).alias("top_logprob"),
        r6(likelihood.extra_mass(F.col("top"), FMT2)).alias("extra"),
    )


@query
def sample_completions(spark, sf):
    rows = textnum.encode(fitted(s1(spark, sf)), FMT2)
    model = nexttoken.fit_next_token(nexttoken.context_tokens(rows.select("series_id", "i", "chunk"), FMT2))
    rows = nexttoken.sample_completions(model, _requests(s1(spark, sf), FMT2), FMT2)
    return rows.select("series_id", long("sample_id").alias("sample_id"), "text")


# --- completions back to numbers ----------------------------------------------------------------


@query
def decode_split(spark, sf):
    rows = textnum.split_completion(season_completions(s2(spark, sf)), FMT)
    return rows.select("series_id", long("sample_id").alias("sample_id"), long("step").alias("step"), "chunk")


@query
def decode_values(spark, sf):
    rows = textnum.decode_steps(textnum.split_completion(season_completions(s2(spark, sf)), FMT), FMT)
    return rows.select(
        "series_id", long("sample_id").alias("sample_id"), long("step").alias("step"), r6("z").alias("z"), "malformed"
    )


@query
def decode_malformed(spark, sf):
    decoded = textnum.decode_completions(season_completions(s3(spark, sf)), FMT)
    return decoded.select(
        "series_id", long("sample_id").alias("sample_id"),
        long(F.size("zs")).alias("steps"), long("usable").alias("usable"),
    )


@query
def rescale_roundtrip(spark, sf):
    result = oneshot.round_trip(s2(spark, sf), FMT)
    return result.withColumns({c: F.round(c, 4) for c in ("mae", "max_error", "scale")})


# --- evaluation ---------------------------------------------------------------------------------


def _decoded(series):
    return textnum.decode_completions(analog_completions(series), FMT)


def _samples(series):
    """Samples on the original scale; the scaler travels with them, so the series is planned once."""
    answers = analog_completions(series, carry=("offset", "scale"))
    clipped = metrics.clip_samples(textnum.decode_completions(answers, FMT))
    return clipped.select("series_id", "sample_id", "step", scaling.unscaled("z").alias("x"))


def _wide_benchmark(series):
    """Truth, the value one season earlier and the training mean, per held-out step.

    Weeks are moved to the step they predict; nothing is joined.
    """
    held = F.col("n") - HORIZON
    rows = calendar.split_holdout(series, HORIZON)
    mean = F.avg(F.when(F.col("split") == "train", F.col("y"))).over(scaling.by_key(series))
    moves = F.explode(F.array(F.struct(F.lit("test").alias("c"), F.lit(0).alias("d")),
                              F.struct(F.lit("seasonal_naive").alias("c"), F.lit(SEASON).alias("d"))))
    moved = rows.withColumn("train_mean", mean).withColumn("m", moves)
    moved = moved.withColumn("step", F.col("i") + F.col("m.d") - held)
    moved = moved.where((F.col("step") >= 0) & (F.col("step") < HORIZON))
    return moved.groupBy("series_id", "step").agg(
        F.max(F.when(F.col("m.c") == "test", F.col("y"))).alias("test"),
        F.max(F.when(F.col("m.c") == "seasonal_naive", F.col("y"))).alias("seasonal_naive"),
        F.max("train_mean").alias("train_mean"),
    )


@query
def common_horizon(spark, sf):
    return metrics.common_horizon(_decoded(s3(spark, sf))).select("series_id", long("horizon").alias("horizon"), "n_samples")


@query
def clip_samples(spark, sf):
    # the scaler as a table of its own, joined
    series = s1(spark, sf)
    rows = metrics.rescale(metrics.clip_samples(_decoded(series)), scalers_of(fitted(series)))
    return rows.select(
        "series_id", long("sample_id").alias("sample_id"), long("step").alias("step"), F.round("x", 4).alias("x")
    )


@query
def mae_samples(spark, sf):
    series = s1(spark, sf)
    return metrics.mae(_samples(series), truth_of(series)).withColumn("mae", F.round("mae", 4))


@query
def median_forecast(spark, sf):
    rows = metrics.point_forecast(_samples(s1(spark, sf)))
    return rows.select("series_id", long("step").alias("step"), F.round("yhat", 4).alias("yhat"))


def _attached(series):
    benchmark = metrics.unpivot_models(_wide_benchmark(series))
    return metrics.attach_model(benchmark, metrics.point_forecast(_samples(series)), "analog_median")


@query
def attach_model(spark, sf):
    rows = _attached(s1(spark, sf))
    return rows.select("series_id", long("step").alias("step"), "model", F.round("yhat", 4).alias("yhat"))


@query
def mae_by_model(spark, sf):
    series = s1(spark, sf)
    return metrics.compare_models(_attached(series), truth_of(series)).withColumn("mae", F.round("mae", 4))


@query
def attach_model_gaps(spark, sf):
    # series with missing weeks: many have no forecast at all and must not be lost
    rows = _attached(s3(spark, sf))
    return rows.select("series_id", long("step").alias("step"), "model", F.round("yhat", 4).alias("yhat"))


@query
def mae_by_model_gaps(spark, sf):
    series = s3(spark, sf)
    return metrics.compare_models(_attached(series), truth_of(series)).withColumn("mae", F.round("mae", 4))


@query
def unpivot_benchmark(spark, sf):
    rows = metrics.unpivot_models(_wide_benchmark(s2(spark, sf)))
    return rows.select("series_id", long("step").alias("step"), "model", F.round("yhat", 4).alias("yhat"))


# --- likelihood ---------------------------------------------------------------------------------


@query
def token_logprobs(spark, sf):
    rows = explode_logprobs(rule_responses(s1(spark, sf)))
    return rows.select(
        "series_id", long("pos").alias("pos"), "tok", r6(F.col("logprob").cast("double")).alias("logprob"),
        long(F.size("top")).alias("n_top"),
    )


@query
def val_start(spark, sf):
    rows = likelihood.validation_start(rule_responses(s1(spark, sf)), "n_train", FMT2)
    return rows.select("series_id", long("n_train").alias("n_train"), long("val_start").alias("val_start"))


@query
def val_tokens(spark, sf):
    rows = likelihood.validation_start(rule_responses(s1(spark, sf)), "n_train", FMT2)
    rows = likelihood.validation_tokens(rows)
    return rows.select("series_id", long(F.size("tokens")).alias("n_tokens"), F.concat_ws("", "tokens").alias("text"))


@query
def extra_mass(spark, sf):
    rows = explode_logprobs(rule_responses(s2(spark, sf)))
    extra = likelihood.extra_mass(F.col("top"), FMT2)
    return rows.select("series_id", long("pos").alias("pos"), r6(extra).alias("extra"))


@query
def nll_per_step(spark, sf):
    rows = likelihood.nll_per_step(rule_responses(s1(spark, sf)), "n_train", "n_val", FMT2)
    return rows.select("series_id", r6("nll").alias("nll"), "status")


@query
def nlld(spark, sf):
    rows = likelihood.nlld(likelihood.nll_per_step(rule_responses(s2(spark, sf)), "n_train", "n_val", FMT2), FMT2)
    return rows.select("series_id", r6("nlld").alias("nlld"), "status")


@query
def score_config(spark, sf):
    """One configuration from landed answers and a table of scalers."""
    rows = rule_responses(s2(spark, sf))
    scored = likelihood.score(rows.drop("scale"), rows.select("series_id", "scale"), "n_train", "n_val", FMT2)
    return scored.select("series_id", r6("nlld").alias("nlld"), "status")


# --- tuning and forecast ------------------------------------------------------------------------


def _points():
    return tuning.param_grid(tuning.GRID)


def _scores(spark, sf):
    return tuning.evaluate_grid(s1(spark, sf), _points(), FMT)


def _rounded(scores):
    types = {"pid": "bigint", "prec": "bigint"}
    return scores.withColumns({"nlld": r6("nlld"), **{c: F.col(c).cast(t) for c, t in types.items()}})


@query
def param_grid(spark, sf):
    marked = calendar.split_holdout(s2(spark, sf), HORIZON)
    rows = scaling.attach_grid_scalers(marked, _points(), F.col("split") == "train")
    return rows.groupBy("series_id", "pid", "alpha", "beta", "prec", "temp").agg(
        r6(F.max("offset")).alias("offset"), r6(F.max("scale")).alias("scale"), F.count(F.lit(1)).alias("steps")
    ).withColumns({"pid": long("pid"), "prec": long("prec")})


@query
def scoring_requests(spark, sf):
    rows = tuning.scoring_requests(s3(spark, sf), _points(), FMT)
    return rows.select(
        "series_id", long("pid").alias("pid"), "prompt", "n_train", "n_val", r6("scale").alias("scale"), "temperature", "status"
    )


@query
def grid_scores(spark, sf):
    return _rounded(_scores(spark, sf))


@query
def grid_scores_gaps(spark, sf):
    # series with missing weeks: the missing marker is a token a score must discount
    return _rounded(tuning.evaluate_grid(s3(spark, sf), _points(), FMT))


@query
def grid_scores_spread(spark, sf):
    """The same, with the grid's rows dealt out before text is made of them."""
    return _rounded(tuning.evaluate_grid(s3(spark, sf), _points(), FMT, spread=2 * spark.sparkContext.defaultParallelism))


@query
def grid_scores_landed(spark, sf):
    """The grid scored from landed answers; a point without an answer keeps its row."""
    requests = tuning.scoring_requests(s1(spark, sf), _points(), FMT)
    return _rounded(tuning.evaluate_responses(requests, rule_answers(requests), _points(), FMT))


@query
def best_params(spark, sf):
    return _rounded(tuning.best_params(_scores(spark, sf)))


@query
def leaderboard(spark, sf):
    return _rounded(tuning.leaderboard(_scores(spark, sf)))


def _history(series):
    """Everything but the test part, with its own validation part held out."""
    past = series.where(F.col("i") < F.col("n") - HORIZON).withColumn("n", F.col("n") - HORIZON)
    return calendar.split_holdout(past, tuning.VAL_STEPS)


@query
def forecast(spark, sf):
    rows = forecasting.forecast(_history(s1(spark, sf)), FMT, fit_on=F.col("split") == "train")
    return rows.select("series_id", long("step").alias("step"), F.round("yhat", 4).alias("yhat"), "status")


@query
def forecast_tuned(spark, sf):
    history = _history(s1(spark, sf))
    best = tuning.best_params(tuning.evaluate_grid(history, _points(), FMT))
    rows = forecasting.forecast(history, FMT, grid=_points(), best=best, fit_on=F.col("split") == "train")
    return rows.select("series_id", long("step").alias("step"), F.round("yhat", 3).alias("yhat"), "status")


@query
def forecast_status(spark, sf):
    """Series of few weeks: one line per series, forecast or not, and why not."""
    rows = forecasting.forecast(_history(s3(spark, sf)), FMT, fit_on=F.col("split") == "train")
    return rows.groupBy("series_id").agg(F.count("step").alias("steps"), F.count("yhat").alias("values"), F.max("status").alias("status"))


@query
def comparison_wide(spark, sf):
    """The final table: truth and every model's value side by side."""
    series = s1(spark, sf)
    rows = metrics.wide_report(_attached(series), truth_of(series))
    return rows.select("series_id", long("step").alias("step"), *[F.round(c, 4).alias(c) for c in rows.columns if c not in ("series_id", "step")])


@query
def forecast_comparison(spark, sf):
    series = s1(spark, sf)
    point = forecasting.forecast(_history(series), FMT, fit_on=F.col("split") == "train")
    benchmark = metrics.unpivot_models(_wide_benchmark(series))
    rows = metrics.attach_model(benchmark, point, "next_token")
    return metrics.compare_models(rows, truth_of(series)).withColumn("mae", F.round("mae", 4))


# --- checks -------------------------------------------------------------------------------------


@query
def check_positive(spark, sf):
    return checks.check_positive(s2(spark, sf))


@query
def check_unit_quantile(spark, sf):
    z = scaling.attach_scaler(s1(spark, sf), "basic", 0.9).withColumn("z", scaling.scaled())
    return checks.check_unit_quantile(z, 0.9).withColumn("quantile", r6("quantile"))


@query
def check_unique_step(spark, sf):
    # two bindings of the same series put together: every step of the shared range is double
    both = s1(spark, sf).select("series_id", "i", "y")
    late = calendar.split_holdout(s1(spark, sf), HORIZON).where("split = 'val'").select("series_id", "i", "y")
    rows = checks.check_unique_step(both.unionByName(late))
    return rows.select("series_id", long("i").alias("i"), "times")


@query
def check_truth(spark, sf):
    # the benchmark holds last season's value as truth: differs nearly everywhere
    series = s2(spark, sf)
    shifted = _wide_benchmark(series).select("series_id", "step", F.col("seasonal_naive").alias("test"))
    rows = checks.check_truth(shifted, truth_of(series))
    return rows.select(
        "series_id", long("step").alias("step"), F.round("test", 4).alias("test"), F.round("y", 4).alias("y"), "problem"
    )


@query
def head_rows(spark, sf):
    """The first observations of a whole table by time."""
    return load(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").limit(10).select(
        "o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice"
    )
