"""Grid search on NLL/D: every grid point of every series in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numerale.functions import bound_once, key_columns, require_columns
from numerale.operators.calendar import split_holdout
from numerale.operators.likelihood import bin_correction, score
from numerale.operators.nexttoken import ORDER, code_places, context_cells, count_between, smoothed_logprob, step_codes
from numerale.operators.scaling import grid_literal, pack_grid_scalers
from numerale.operators.textnum import kept_text
from numerale.plans.prepare import pack_marked_chunks
from numerale.settings import CONTEXT_TOKENS, REQUEST_SEED, STEP_MULTIPLIER, TextFormat

# The grid searched and the length of the validation part.
GRID = {"alpha": [0.2, 0.5, 0.8], "beta": [0.0, 0.15], "prec": [2], "temp": [1.0]}
VAL_STEPS = 30


def param_grid(lists: dict[str, Sequence] = GRID) -> list[dict]:
    """All combinations, names in alphabetical order, the last name varying fastest."""
    names = sorted(lists)
    return [{"pid": k, **dict(zip(names, point))} for k, point in enumerate(product(*(lists[n] for n in names)))]


def grid_frame(spark: SparkSession, grid: Sequence[dict]) -> DataFrame:
    return spark.range(1).select(F.inline(grid_literal(grid)))


def for_grid(fmt: TextFormat, grid: Sequence[dict]) -> TextFormat:
    """The format with as many places prepared as the grid asks for."""
    return replace(fmt, max_prec=max(p["prec"] for p in grid))


def scoring_texts(
    series: DataFrame, grid: Sequence[dict], fmt: TextFormat, val_steps: int, context: int, multiplier: float, spread: int | None = None
) -> DataFrame:
    """One row per series and grid point: ``steps`` (i, fit, chunk, n_tok) and the ``cut``; ``fit`` marks the training steps.

    ``spread`` deals the rows of a grid of several points to so many partitions by series and point, before text is
    made of them: one shuffle more, for a session whose partitions are merged by size alone.
    """
    require_columns(series, "series_id", "i", "n", "y")
    marked = split_holdout(series, val_steps).withColumn("n_val", F.least(F.col("n"), F.lit(val_steps)))
    rows = pack_grid_scalers(marked, grid, fit_on=F.col("split") == "train", carry=("n_val",))
    if spread and len(grid) > 1:
        rows = rows.hint("rebalance", spread, "series_id", "pid")
    return pack_marked_chunks(rows, for_grid(fmt, grid), val_steps, context, multiplier, within="fit")


def scoring_rows(
    series: DataFrame, grid: Sequence[dict], fmt: TextFormat, val_steps: int, context: int, multiplier: float, spread: int | None = None
) -> DataFrame:
    """Chunks of every grid point, one row per step: the training steps the budget leaves, then the validation steps."""
    texts = scoring_texts(series, grid, fmt, val_steps, context, multiplier, spread)
    rows = texts.select(*[c for c in texts.columns if c != "steps"], F.inline("steps")).withColumnRenamed("fit", "train")
    return rows.withColumn("split", F.when(F.col("train"), "train").otherwise("val"))


def _kept_steps(train: bool) -> Column:
    """The steps of a scored text: of the training part those the budget leaves, of the validation part all."""
    if not train:
        return F.filter("steps", lambda s: ~s["fit"])
    return bound_once(F.col("cut"), lambda cut: F.filter("steps", lambda s: s["fit"] & (s["i"] >= cut)))


def scoring_requests(
    series: DataFrame,
    grid: Sequence[dict],
    fmt: TextFormat = TextFormat(),
    val_steps: int = VAL_STEPS,
    context: int = CONTEXT_TOKENS,
    multiplier: float = STEP_MULTIPLIER,
    alternatives: int = 5,
    seed: int = REQUEST_SEED,
) -> DataFrame:
    """What a model needs to score every grid point of every series, one row each.

    ``prompt`` is the training text followed by the validation text, to be scored
    as it stands (no new tokens, ``alternatives`` likeliest tokens per position);
    ``n_train`` and ``n_val`` say where the scored part begins and how long it is.
    Series that cannot be asked for keep their row, with a status.
    """
    texts = scoring_texts(series, grid, fmt, val_steps, context, multiplier)
    rows = texts.select(
        "series_id", "pid", "n_val", "scale", "cut", "temp", _kept_steps(True).alias("_train"), _kept_steps(False).alias("_val")
    )
    out = rows.select(
        "series_id",
        "pid",
        F.concat(kept_text("_train", fmt), kept_text("_val", fmt)).alias("prompt"),
        F.size("_train").cast("bigint").alias("n_train"),
        F.col("n_val").cast("bigint").alias("n_val"),
        "scale",
        F.col("cut").alias("_cut"),
        F.col("temp").alias("temperature"),
    )
    status = F.when(F.col("scale").isNull(), "no_training_part").when(F.col("_cut").isNull(), "does_not_fit").otherwise("ok")
    return out.select(
        "series_id", "pid", "prompt", "n_train", "n_val", "scale", "temperature", F.lit(0).alias("max_tokens"),
        F.lit(alternatives).alias("alternatives"), F.lit(seed).cast("bigint").alias("seed"), status.alias("status"),
    )


def evaluate_responses(
    requests: DataFrame, responses: DataFrame, grid: Sequence[dict], fmt: TextFormat = TextFormat()
) -> DataFrame:
    """The scores of ``evaluate_grid`` from a model's landed answers to ``scoring_requests``.

    ``responses(series_id, pid, tokens, token_logprobs, top_logprobs)`` is joined
    once; a request without an answer keeps its row, with the status ``no_answer``.
    """
    point = F.element_at(grid_literal(grid), F.col("pid") + 1)
    asked = requests.select("series_id", "pid", "n_train", "n_val", "scale", F.col("status").alias("_asked"), point["prec"].alias("prec"))
    arrays = ["tokens", "token_logprobs", "top_logprobs"]
    landed = asked.join(responses.select("series_id", "pid", *arrays), ["series_id", "pid"], "left")
    landed = landed.withColumn("_answered", F.col("tokens").isNotNull())
    scored = score(landed.drop("scale"), asked.select("series_id", "pid", "scale"), "n_train", "n_val", fmt)
    status = (
        F.when(F.col("_asked") != "ok", F.col("_asked")).when(~F.col("_answered"), "no_answer").otherwise(F.col("status"))
    )
    out = scored.select("series_id", point.alias("_p"), status.alias("status"), "nlld").select("series_id", "_p.*", "nlld", "status")
    return out.withColumn("nlld", F.when(F.col("status") == "ok", F.col("nlld")))


def evaluate_grid(
    series: DataFrame,
    grid: Sequence[dict],
    fmt: TextFormat = TextFormat(),
    val_steps: int = VAL_STEPS,
    context: int = CONTEXT_TOKENS,
    multiplier: float = STEP_MULTIPLIER,
    spread: int | None = None,
) -> DataFrame:
    """``scores(series_id, pid, alpha, beta, prec, temp, nlld, status)`` under the offline model.

    Same numbers as scoring every validation token and summing, but the sum
    runs over distinct contexts: how often each token follows a context in the
    training text and in the validation text is all the likelihood needs.
    After the series has been laid out by ``series_id`` no further shuffle is
    needed.  The steps of a series are gathered before the grid multiplies them; text and counts of a point are
    made inside its row, and one row per context of the validation text is summed.

    The temperature does not change log-probabilities: points that differ in it
    only are scored once.
    """
    alike: dict[tuple, list[dict]] = {}
    for p in grid:
        alike.setdefault((p["alpha"], p["beta"], p["prec"]), []).append(p)
    if len(alike) < len(grid):
        distinct = [{**points[0], "pid": k} for k, points in enumerate(alike.values())]
        scores = evaluate_grid(series, distinct, fmt, val_steps, context, multiplier, spread)
        own = F.array(*[F.array(*[F.struct(F.lit(p["pid"]).alias("pid"), F.lit(float(p["temp"])).alias("temp")) for p in points]) for points in alike.values()])
        fanned = scores.select("*", F.explode(F.element_at(own, F.col("pid") + 1)).alias("_t"))
        return fanned.select("series_id", "_t.pid", "alpha", "beta", "prec", "_t.temp", "nlld", "status")
    words = [*fmt.codes, "?"]
    size = len(words)
    # the same for all contexts of a key: carried, not computed
    names = ["series_id", "pid", "scale", "cut", "n_val"]
    carried = [F.max(c).alias(c) for c in names[2:]]
    texts = scoring_texts(series, grid, fmt, val_steps, context, multiplier, spread)
    codes = texts.select(*names, step_codes(_kept_steps(True), fmt).alias("_train"), step_codes(_kept_steps(False), fmt).alias("_val"))
    letters = "".join(fmt.codes.values()) + "?"
    lines = codes.select(*names, F.length("_train").alias("_n"), code_places(F.concat("_train", "_val"), letters).alias("_t"))
    cells = lines.select(*names, "_n", context_cells("_t", size).alias("_cells"))
    # tokens without a full context are only there without a training text, and then there is no score
    learned = F.slice("_cells", F.lit(ORDER + 1), F.greatest(F.col("_n") - ORDER, F.lit(0)))
    asked = F.filter(F.slice("_cells", F.col("_n") + 1, F.size("_cells")), lambda c: c >= 0)
    cells = cells.select(*names, learned.alias("_learned"), asked.alias("_asked"))
    contexts = F.sort_array(F.array_distinct(F.transform("_asked", lambda c: ((c - c % size) / size).cast("int"))))
    cells = cells.withColumn("_contexts", contexts)
    # every token after a context, and where the last one ends
    marks = F.flatten(F.transform("_contexts", lambda k: F.sequence(k * size, k * size + size)))
    cells = cells.withColumn("_marks", marks)
    cells = count_between(count_between(cells, "_learned", "_marks", "_c"), "_asked", "_marks", "_v")

    def counted(c: Column, v: Column) -> Column:
        def own(x: Column, k: Column) -> Column:
            return F.slice(x, k * (size + 1) + 1, F.lit(size))

        return F.transform("_contexts", lambda _, k: F.struct(own(c, k).alias("c"), own(v, k).alias("v")))

    each = bound_once(F.struct("_c", "_v"), lambda x: counted(x["_c"], x["_v"]))
    counts = cells.select(*names, F.explode_outer(each).alias("_x")).select(
        *names,
        *[F.get(f"_x.{x}", F.lit(k)).alias(f"{x}{k}") for x in ("c", "v") for k in range(size)],
        F.aggregate("_x.c", F.lit(0), lambda a, b: a + b).alias("seen"),
        F.aggregate("_x.v", F.lit(0), lambda a, b: a + b).alias("scored"),
    )
    rest = 1.0 - _disallowed_mass(fmt, words)
    surprise = [
        F.col(f"v{k}") * -smoothed_logprob(F.col(f"c{k}"), F.col("seen"), fmt).cast("float").cast("double")
        for k in range(len(words))
    ]
    loss = F.when(rest > 0, sum(surprise, F.col("scored") * F.ln(rest)))
    scored = counts.groupBy("series_id", "pid").agg(
        F.sum(loss).alias("loss"),
        F.count_if(rest <= 0).alias("unusable"),
        *carried,
    )
    status = (
        F.when(F.col("scale").isNull(), "no_training_part")
        .when(F.col("cut").isNull(), "does_not_fit")
        .when(F.col("unusable") > 0, "unusable_token")
        .otherwise("ok")
    )
    point = F.element_at(grid_literal(grid), F.col("pid") + 1)
    per_step = F.try_divide(F.col("loss"), F.col("n_val").cast("double"))
    value = per_step - bin_correction(fmt, F.col("prec")) + F.when(F.col("scale") > 0, F.ln("scale"))
    return (
        scored.withColumn("_p", point)
        .select("series_id", "_p.*", "loss", "n_val", "scale", status.alias("status"))
        .withColumn("nlld", F.when(F.col("status") == "ok", value))
        .select("series_id", "pid", "alpha", "beta", "prec", "temp", "nlld", "status")
    )


def _disallowed_mass(fmt: TextFormat, words: list[str], top: int = 5) -> Column:
    """Probability of disallowed tokens among the ``top`` most frequent ones after a context.

    The columns c0, c1, … count ``words`` and ``seen`` is their sum; ties rank by token text.
    """
    mass = F.lit(0.0)
    if not fmt.bit_sep:
        return mass
    for k, word in enumerate(words):
        if word in fmt.allowed_tokens(scoring=True):
            continue
        own = F.col(f"c{k}")
        others = [(F.col(f"c{j}"), w) for j, w in enumerate(words) if j != k]
        ahead = [F.when(c >= own if w < word else c > own, 1).otherwise(0) for c, w in others]
        listed = (own > 0) & (sum(ahead, F.lit(0)) < top)
        mass = mass + F.when(listed, F.exp(smoothed_logprob(own, F.col("seen"), fmt))).otherwise(0.0)
    return mass


def usable_scores(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("nlld").isNotNull() & ~F.isnan("nlld"))


def best_params(scores: DataFrame) -> DataFrame:
    """The grid point with the lowest score per series; the first one wins a tie, NaN never wins."""
    keys = [k for k in key_columns(scores) if k != "pid"]
    fields = [c for c in ("alpha", "beta", "prec", "temp") if c in scores.columns]
    order = F.struct("nlld", "pid")
    best = F.min_by(F.struct("pid", *fields, "nlld"), order)
    return usable_scores(scores).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def leaderboard(scores: DataFrame) -> DataFrame:
    """All scores, best first; those without a score last."""
    score = F.when(~F.isnan("nlld"), F.col("nlld"))
    return scores.orderBy(score.asc_nulls_last(), "series_id", "pid")
