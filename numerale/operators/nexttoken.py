"""Requests to a sequence model, and a count-based stand-in that answers them offline.

The stand-in predicts a digit from the two tokens before it.  It exists so
that the pipeline runs end to end; its forecasts say nothing about what a
language model would answer.  Own a model?  Use ``complete_with``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerale.functions import bound_once, key_columns, newest_first, require_columns, token_array, token_codes, token_of_code
from numerale.settings import HEADROOM, REQUEST_SEED, TOKEN_BIAS, TextFormat

ORDER = 2

#: Tokens drawn before they are put aside.
DRAW_BLOCK = 64

# A multiplicative congruential generator whose products fit a BIGINT, so that any engine can repeat the draws.
DRAW_FACTOR = 48_271
DRAW_MODULUS = 2_147_483_647


def token_bias(fmt: TextFormat) -> Column:
    """Map of every allowed token to the same positive bias."""
    allowed = fmt.allowed_tokens()
    return F.map_from_arrays(F.array(*map(F.lit, allowed)), F.array_repeat(F.lit(TOKEN_BIAS), len(allowed)))


def build_requests(
    prepared: DataFrame,
    fmt: TextFormat,
    n_steps: int,
    temperature: Column | float = 1.0,
    n_samples: int = 10,
    seed: int = REQUEST_SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per prompt with its status; the answer's length follows from the tokens per step.

    Only rows with the status ``ok`` are to be asked for: the others, series that do not fit or
    have no scaler, have no length and no bias.  ``carry`` names further columns of ``prepared`` to pass along.
    """
    require_columns(prepared, "prompt", "avg_tokens", "status")
    temp = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    asked = F.col("status") == "ok"
    max_tokens = F.floor(F.col("avg_tokens") * F.lit(n_steps) * F.lit(HEADROOM)).cast("int")
    return prepared.select(
        *key_columns(prepared),
        "prompt",
        F.when(asked, max_tokens).alias("max_tokens"),
        temp.alias("temperature"),
        F.lit(n_samples).alias("n_samples"),
        F.lit(seed).cast("bigint").alias("seed"),
        F.when(asked, token_bias(fmt)).alias("bias"),
        "status",
        *[c for c in carry if c != "status"],
    )


def complete_with(
    requests: DataFrame, answer: Callable[[pd.DataFrame], list[list[str]]], partitions: int | None = None
) -> DataFrame:
    """Let a caller's model answer the requests, batch by batch inside the tasks.

    ``answer`` gets request rows and returns one list of texts per row.  A sample
    without text (None) stays as an empty text, and a request without any answer
    gets one empty sample: both count as 0 steps and are seen downstream.  A request
    whose status is not ``ok`` is not asked and gets an empty sample too.  Write
    the result to a table before using it: a lost executor makes Spark ask again.
    """
    keys = key_columns(requests)
    types = dict(requests.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["sample_id INT", "text STRING"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            asked = rows["status"] == "ok" if "status" in rows else pd.Series(True, rows.index)
            texts = iter(answer(rows[asked]) if asked.any() else [])
            out = rows[keys].assign(text=[list(next(texts)) or [None] if a else [None] for a in asked])
            out = out.explode("text")
            out["text"] = out["text"].map(lambda t: t if isinstance(t, str) else "")
            out["sample_id"] = out.groupby(level=0).cumcount().astype("int32")
            yield out[[*keys, "sample_id", "text"]]

    source = requests if partitions is None else requests.repartition(partitions)
    return source.mapInPandas(run, schema)


# --- the stand-in -----------------------------------------------------------------------------


def code_lines(chunk_rows: DataFrame, fmt: TextFormat) -> DataFrame:
    """Replace ``chunk`` by ``codes``, one character per token, and add ``line``: the two characters before it, then it.

    The window runs over steps, not tokens: every step ends with a separator,
    so two characters are all that has to cross from one step to the next.
    """
    require_columns(chunk_rows, "i", "chunk")
    rows = chunk_rows.withColumn("codes", token_codes("chunk", fmt)).drop("chunk")
    # seen from the newest step, the step before is the one that follows
    before = F.coalesce(F.substring(F.lead("codes").over(newest_first(rows)), -ORDER, ORDER), F.lit(""))
    return rows.withColumn("line", F.concat(before, "codes"))


def code_position() -> Column:
    """Place in ``line`` (from 1) of each token of the step: one row per token."""
    return F.explode(F.sequence(F.length("line") - F.length("codes") + 1, F.length("line")))


def context_tokens(chunk_rows: DataFrame, fmt: TextFormat) -> DataFrame:
    """One row per token with the two tokens before it (``p2``, ``p1``) and its position ``pos``."""
    carried = [c for c in chunk_rows.columns if c != "chunk"]
    lines = code_lines(chunk_rows, fmt)
    order = newest_first(chunk_rows)
    to_end = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.sum(F.length("codes")).over(whole) - F.sum(F.length("codes")).over(to_end)
    at = lines.withColumn("_start", start).select(*carried, "_start", "line", "codes", code_position().alias("_at"))
    lead = F.length("line") - F.length("codes")
    j = F.col("_at") - lead - 1

    def token(back: int) -> Column:
        there = F.when(F.col("_at") > back, F.substring("line", F.col("_at") - back, F.lit(1)))
        return token_of_code(there, fmt)

    return at.select(
        *carried,
        j.alias("j"),
        (F.col("_start") + j).cast("int").alias("pos"),
        token(2).alias("p2"),
        token(1).alias("p1"),
        token(0).alias("tok"),
    )


def step_codes(steps: Column | str, fmt: TextFormat) -> Column:
    """The text of an array of steps (``chunk``) as one character per token (``fmt.codes``)."""
    return F.array_join(F.transform(steps, lambda s: token_codes(s["chunk"], fmt)), "")


def code_places(codes: Column, letters: str) -> Column:
    """Place of each character in ``letters``, from 0; -1 for any other."""
    places = F.transform(F.split(codes, ""), lambda c: F.instr(F.lit(letters), c) - 1)
    return F.when(F.length(codes) > 0, places).otherwise(F.array().cast("array<int>"))


def context_cells(places: str, size: int) -> Column:
    """For each token its place in a table of (token two before, token before, token); -1 without two tokens before it."""

    def cell(tok: Column, k: Column) -> Column:
        before = F.get(places, k - 2) * size + F.get(places, k - 1)
        return F.when(k >= ORDER, before * size + tok).otherwise(-1)

    return F.transform(places, cell)


def count_between(rows: DataFrame, cells: str, marks: str, into: str) -> DataFrame:
    """Add ``into``: for each of the sorted ``marks`` but the last, how many ``cells`` lie from it to before the next.

    Both are arrays of whole numbers in the row.  They are sorted together, each mark before the cells equal to
    it, so that no cell is looked up and no row leaves its place.
    """
    both = F.sort_array(F.concat(F.transform(cells, lambda c: c * 2 + 1), F.transform(marks, lambda m: m * 2)))
    rows = rows.withColumn("_both", both)
    at = F.filter(F.sequence(F.lit(0), F.size("_both") - 1), lambda k: F.get("_both", k) % 2 == 0)
    rows = rows.withColumn("_at", F.when(F.size("_both") > 0, at).otherwise(F.array().cast("array<int>")))
    later = F.slice("_at", F.lit(2), F.greatest(F.size("_at") - 1, F.lit(0)))
    return rows.withColumn(into, F.transform(later, lambda p, k: p - F.get("_at", k) - 1)).drop("_both", "_at")


def fit_next_token(contexts: DataFrame, counted: Column | None = None) -> DataFrame:
    """Counts of each token after each pair of tokens: ``(…, p2, p1, tok, c)``.

    Counting is combined before any shuffle; a series has at most
    |vocabulary|^3 rows here, whatever its length.
    """
    full = F.col("p2").isNotNull()
    rows = contexts.where(full if counted is None else full & counted)
    return rows.groupBy(*key_columns(contexts), "p2", "p1", "tok").agg(F.count(F.lit(1)).alias("c"))


def smoothed_logprob(count: Column, total: Column, fmt: TextFormat) -> Column:
    """Add-one estimate of a token after a context."""
    return F.ln((count + 1) / (total + len(fmt.vocabulary)))


def score_tokens(model: DataFrame, contexts: DataFrame, fmt: TextFormat, top: int = 5) -> DataFrame:
    """Log-probability of every token and the most likely alternatives.

    Output as a scored text would be landed, in long form: ``(…, pos, tok,
    logprob FLOAT, top MAP)``.  The first token has no log-probability.

    The contexts of a series, at most |vocabulary|^2, meet its tokens as one nested array in which a
    context is a position, so the join is on the series alone, no token leaves its place, and nothing is searched for.
    """
    keys = key_columns(model)
    size = len(fmt.vocabulary)
    of_token = F.create_map(*[F.lit(x) for k, t in enumerate(fmt.vocabulary) for x in (t, k)])

    def position(tok: str) -> Column:
        return F.try_element_at(of_token, F.col(tok))

    seen = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("neg"), "tok")))
    by_token = F.array(*[F.coalesce(F.sum(F.when(F.col("tok") == t, F.col("c"))), F.lit(0)) for t in fmt.vocabulary])
    best = F.transform(F.slice("seen", 1, top), lambda s: F.struct(s["tok"], smoothed_logprob(-s["neg"], F.col("total"), fmt)))
    by_context = (
        model.groupBy(*keys, "p2", "p1")
        .agg(F.sum("c").alias("total"), by_token.alias("counts"), seen.alias("seen"))
        .select(*keys, (position("p2") * size + position("p1")).alias("_context"), F.struct("total", "counts", F.map_from_entries(best).alias("top")).alias("_seen"))
        .where("_context is not null")
    )
    # contexts in their order; a token finds its own by its place among those that were seen
    entries = F.array_sort(F.collect_list(F.struct("_context", F.struct("_seen.total", "_seen.counts", F.map_entries("_seen.top").alias("top")).alias("_seen"))))
    by_series = by_context.groupBy(*keys).agg(entries.alias("_entries"))
    place = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.array_position(F.transform("_entries", lambda e: e["_context"]), k).cast("int") - 1)
    by_series = by_series.select(*keys, place.alias("_place"), F.transform("_entries", lambda e: e["_seen"]).alias("_model"))
    rows = contexts.join(by_series, keys, "left")
    at = F.get("_place", position("p2") * size + position("p1"))
    rows = rows.withColumn("_seen", F.when(at >= 0, F.get("_model", at))).drop("_model", "_place")
    count = F.coalesce(F.get("_seen.counts", position("tok")), F.lit(0))
    logprob = smoothed_logprob(count, F.coalesce("_seen.total", F.lit(0)), fmt).cast("float")
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return rows.select(
        *keys,
        *[c for c in ("i", "j", "split") if c in contexts.columns],
        "pos",
        "tok",
        F.when(F.col("p1").isNotNull(), logprob).alias("logprob"),
        F.coalesce(F.map_from_entries("_seen.top"), nothing).alias("top"),
    )


def _token_index(tok: Column | str, fmt: TextFormat) -> Column:
    return (F.array_position(F.array(*map(F.lit, fmt.vocabulary)), tok) - 1).cast("int")


def sampling_tables(model: DataFrame, fmt: TextFormat) -> DataFrame:
    """Per series, ``counts[context][token]`` as one nested array.

    Bounded by the vocabulary: |V|^2 + 1 contexts of |V| counts.  Tokens a
    request does not allow (the missing marker) stay 0.  A context that was
    never seen is NULL; the last entry, token counts alone, stands in for it.
    """
    keys = key_columns(model)
    size = len(fmt.vocabulary)
    context = _token_index(F.col("p2"), fmt) * size + _token_index(F.col("p1"), fmt)
    rows = model.where(F.col("tok").isin(fmt.allowed_tokens())).select(
        *keys, F.explode(F.array(context, F.lit(size * size))).alias("ctx"), _token_index(F.col("tok"), fmt).alias("t"), "c"
    )
    counts = F.array(*[F.coalesce(F.sum(F.when(F.col("t") == k, F.col("c"))), F.lit(0)) for k in range(size)])
    by_context = rows.groupBy(*keys, "ctx").agg(counts.alias("counts"))
    table = F.map_from_entries(F.collect_list(F.struct("ctx", "counts")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size * size)), lambda k: F.try_element_at("_m", k))
    return by_context.groupBy(*keys).agg(table.alias("_m")).select(*keys, dense.alias("counts"))


def text_tables(texts: DataFrame, fmt: TextFormat) -> DataFrame:
    """``sampling_tables`` of the model that ``fit_next_token`` finds in ``codes``, a text per row (``step_codes``).

    A text without a token to learn from has no ``counts``.  Counted inside the row: no row per token is made, and what a task holds does not grow with the number of series.
    """
    keys = key_columns(texts)
    size = len(fmt.vocabulary)
    allowed = [k for k, t in enumerate(fmt.vocabulary) if t in fmt.allowed_tokens()]
    rows = texts.select(*keys, code_places(F.col("codes"), "".join(fmt.codes[t] for t in fmt.vocabulary)).alias("_t"))

    def cells(tok: Column, k: Column) -> Column:
        context = F.get("_t", k - 2) * size + F.get("_t", k - 1)
        # under its context, and under the last entry, token counts alone
        counted = F.array(F.when(context >= 0, context * size + tok), F.lit(size**3) + tok)
        return F.when((k >= ORDER) & tok.isin(allowed), counted).otherwise(F.array().cast("array<int>"))

    rows = rows.select(*keys, F.array_compact(F.flatten(F.transform("_t", cells))).alias("_cells"))
    rows = rows.withColumn("_marks", F.sequence(F.lit(0), F.lit((size * size + 1) * size)))
    rows = count_between(rows, "_cells", "_marks", "_counts")

    def entry(counts: Column, k: Column) -> Column:
        return bound_once(F.slice(counts, k * size + 1, F.lit(size)), lambda own: F.when(F.array_max(own) > 0, own))

    dense = bound_once(F.col("_counts"), lambda counts: F.transform(F.sequence(F.lit(0), F.lit(size * size)), lambda k: entry(counts, k)))
    # not a filter: pushed down, it would make the text again for every token
    return rows.select(*keys, F.when(F.size("_cells") > 0, dense).alias("counts"))


def _cumulative(counts: Column, temperature: Column) -> Column:
    """Cumulative weights per context; weight = (count / highest count) ^ (1 / temperature)."""

    def weight(c: Column, first: Column, top: Column) -> Column:
        cold = F.when(first, F.lit(1.0)).otherwise(F.lit(0.0))
        exponent = F.lit(1.0) / F.nullif(temperature, F.lit(0.0))
        return F.when(temperature > 0, F.pow(c.cast("double") / top, exponent)).otherwise(cold)

    def one(entry: Column) -> Column:
        # without temperature the first of tied tokens is taken
        weights = bound_once(
            F.array_max(entry),
            lambda top: F.transform(entry, lambda c, k: weight(c, F.array_position(entry, top) == k + 1, top)),
        )
        return F.aggregate(
            weights,
            F.array().cast("array<double>"),
            lambda acc, w: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + w),
        )

    return F.transform(counts, one)


def sample_completions(
    model: DataFrame, requests: DataFrame, fmt: TextFormat, carry: Sequence[str] = ()
) -> DataFrame:
    """Draw the requested number of texts of ``max_tokens`` tokens: ``(…, sample_id, text)``; see ``draw_completions``."""
    return draw_completions(sampling_tables(model, fmt), requests, fmt, carry)


def draw_completions(
    tables: DataFrame, requests: DataFrame, fmt: TextFormat, carry: Sequence[str] = ()
) -> DataFrame:
    """Draw from ``sampling_tables`` or ``text_tables`` the requested number of texts: ``(…, sample_id, text)``.

    The draws of a sample come from a generator that starts at a hash of (series, sample, seed), so
    the result does not depend on partitioning, is the same when a task is run again, and any engine
    with MD5 and 64-bit integers can repeat it.  A request that is not ``ok`` or has no model
    keeps its row: one empty sample (with ``status`` in ``carry``, the reason).
    """
    require_columns(requests, "prompt", "max_tokens", "temperature", "n_samples", "seed")
    if "status" not in requests.columns:
        requests = requests.withColumn("status", F.lit("ok"))
    keys = key_columns(requests)
    size = len(fmt.vocabulary)
    words = F.array(*map(F.lit, fmt.vocabulary))
    last_chunk = F.try_element_at(F.split("prompt", f"\\Q{fmt.time_sep}\\E", -1), F.lit(-2))
    tail = F.slice(token_array(last_chunk, fmt), -ORDER, ORDER)
    ready = (
        requests.join(tables, keys, "left")
        .withColumn("status", F.when((F.col("status") == "ok") & F.col("counts").isNull(), "no_model").otherwise(F.col("status")))
        .withColumn("cum", F.when(F.col("status") == "ok", _cumulative(F.col("counts"), F.col("temperature"))))
        .withColumn("ctx", _token_index(F.get(tail, F.lit(0)), fmt) * size + _token_index(F.get(tail, F.lit(1)), fmt))
        .select(*keys, *carry, "max_tokens", "n_samples", "seed", "cum", "ctx")
        .withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.when(F.col("cum").isNull(), 0).otherwise(F.col("n_samples") - 1))))
    )
    start = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("sample_id").cast("string"), F.col("seed").cast("string")))
    start = F.conv(F.substring(start, 1, 8), 16, 10).cast("bigint") % (DRAW_MODULUS - 1) + 1
    ready = ready.withColumn("rng", start)
    # drawn in blocks: what one draw copies is bounded by the block, not by the text
    empty = F.array().cast("array<int>")
    blocks = F.struct(F.col("ctx").alias("ctx"), F.col("rng").alias("rng"), F.array().cast("array<array<int>>").alias("done"))

    def draw(state: Column, k: Column) -> Column:
        options = F.coalesce(F.get("cum", state["ctx"]), F.get("cum", F.lit(size * size)))

        def pick(rng: Column) -> Column:
            # the token's index is the number of cumulative weights not above the level
            level = rng.cast("double") / float(DRAW_MODULUS)
            chosen = bound_once(options, lambda cum: bound_once(level * F.element_at(cum, -1), lambda u: F.size(F.filter(cum, lambda w: w <= u))))
            return bound_once(chosen, lambda t: F.struct(
                ((state["ctx"] % size) * size + t).alias("ctx"), rng.alias("rng"), F.array_append(state["drawn"], t).alias("drawn")
            ))

        return bound_once(state["rng"] * DRAW_FACTOR % DRAW_MODULUS, pick)

    def draw_block(state: Column, b: Column) -> Column:
        positions = F.sequence(b * DRAW_BLOCK + 1, (b + 1) * DRAW_BLOCK)
        begin = F.struct(state["ctx"].alias("ctx"), state["rng"].alias("rng"), empty.alias("drawn"))
        return bound_once(
            F.aggregate(positions, begin, draw),
            lambda block: F.struct(
                block["ctx"].alias("ctx"), block["rng"].alias("rng"), F.array_append(state["done"], block["drawn"]).alias("done")
            ),
        )

    n_blocks = F.ceil(F.greatest("max_tokens", F.lit(1)) / DRAW_BLOCK).cast("int")
    drawn = F.flatten(F.aggregate(F.sequence(F.lit(0), n_blocks - 1), blocks, draw_block)["done"])
    drawn = F.slice(drawn, F.lit(1), F.greatest("max_tokens", F.lit(0)))
    text = F.array_join(F.transform(drawn, lambda t: F.get(words, t)), "")
    return ready.select(*keys, *carry, "sample_id", F.coalesce(F.when(F.col("cum").isNotNull(), text), F.lit("")).alias("text"))
