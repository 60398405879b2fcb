"""The same results as plain SQL, written independently of the Spark plans:
windows and joins over long tables where Spark uses arrays and vice versa.
"""

from __future__ import annotations

SMALL_CONTEXT = 900
CONTEXT = 4097

WEEK = "CAST(date_trunc('week', {0}) AS DATE) + 6"


def _weekly(series_id: str, ts: str, value: str, source: str) -> str:
    return f"""weekly AS (
  SELECT {series_id} AS series_id, {WEEK.format(ts)} AS wk,
         CAST(sum(CAST({value} AS DECIMAL(18,2))) AS DOUBLE) / nullif(count({value}), 0) AS y
  FROM {source} GROUP BY 1, 2)"""


SERIES = """bounds AS (SELECT series_id, min(wk) AS a, max(wk) AS b FROM weekly GROUP BY 1),
spine AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS wk FROM bounds),
series AS (
  SELECT series_id, wk, row_number() OVER (PARTITION BY series_id ORDER BY wk) - 1 AS i,
         count(*) OVER (PARTITION BY series_id) AS n, y
  FROM spine LEFT JOIN weekly USING (series_id, wk))"""

W1 = _weekly("o_orderpriority", "o_orderdate", "o_totalprice", "orders")
W2 = _weekly("c_nationkey", "o_orderdate", "c_acctbal", "orders JOIN customer ON o_custkey = c_custkey")
W3 = _weekly("l_suppkey", "l_shipdate", "l_extendedprice", "lineitem")
S1, S2, S3 = (f"WITH {w},\n{SERIES}" for w in (W1, W2, W3))

MARKED = "marked AS (SELECT *, CASE WHEN i >= n - 30 THEN 'val' ELSE 'train' END AS split FROM series)"


def _basic(alpha: float = 0.95) -> str:
    """Held-out split and the basic scaler of the rest."""
    return f"""{MARKED},
scal AS (
  SELECT series_id, CAST(0 AS DOUBLE) AS "offset",
         greatest(quantile_cont(abs(y), {alpha}) FILTER (WHERE split = 'train'), 0.01) AS scale,
         count(y) FILTER (WHERE split = 'train') AS seen
  FROM marked GROUP BY 1),
zed AS (
  SELECT m.*, CASE WHEN seen > 0 THEN (y - "offset") / scale END AS z,
         CASE WHEN seen > 0 THEN "offset" END AS "offset", CASE WHEN seen > 0 THEN scale END AS scale
  FROM marked m JOIN scal USING (series_id))"""


def _advanced(alpha: float, beta: float) -> str:
    return f"""{MARKED},
stat AS (
  SELECT series_id, min(y) FILTER (WHERE split = 'train') AS lo, max(y) FILTER (WHERE split = 'train') AS hi,
         quantile_cont(y, {alpha}) FILTER (WHERE split = 'train') AS q
  FROM marked GROUP BY 1),
scal0 AS (SELECT series_id, lo - CAST({beta} AS DOUBLE) * (hi - lo) AS "offset", q FROM stat),
scal AS (
  SELECT series_id, "offset", CASE WHEN q - "offset" = 0 THEN 1 ELSE q - "offset" END AS scale FROM scal0),
zed AS (SELECT m.*, (y - "offset") / scale AS z, "offset", scale FROM marked m JOIN scal USING (series_id))"""


def _decimal(prec: int | str = 3, source: str = "zed", out: str = "chunked") -> str:
    """Digits and chunk of z in decimal mode."""
    units = f"CAST(floor(abs(z) * power(CAST(10 AS DOUBLE), {prec}) + 5e-7) AS BIGINT)"
    return f"""{out}_d AS (SELECT *, CAST({units} AS VARCHAR) AS digits, abs(z) >= 1e7 AS overflow FROM {source}),
{out} AS (
  SELECT *, CASE WHEN z IS NULL THEN ' Nan'
                 ELSE CASE WHEN z < 0 THEN ' -' ELSE '' END || regexp_replace(digits, '(.)', ' \\1', 'g') END AS chunk
  FROM {out}_d)"""


def _greedy(prec: int = 3, source: str = "zed") -> str:
    """Digits and chunk of z, one CTE per digit position."""
    powers = [10.0**k for k in range(6, -1, -1)] + [10.0**-k for k in range(1, prec + 1)]
    steps = [f"g0 AS (SELECT *, abs(z) AS rest, '' AS spaced FROM {source})"]
    for k, p in enumerate(powers):
        power = f"CAST({p!r} AS DOUBLE)"
        steps.append(
            f"g{k + 1} AS (SELECT * REPLACE (rest - trunc(rest / {power}) * {power} AS rest, "
            f"spaced || ' ' || CAST(CAST(trunc(rest / {power}) AS BIGINT) AS VARCHAR) AS spaced) FROM g{k})"
        )
    steps.append(
        f"""gd AS (
  SELECT * REPLACE (CASE WHEN regexp_replace(spaced, '^( 0)+', '') = '' THEN ' 0'
                         ELSE regexp_replace(spaced, '^( 0)+', '') END AS spaced), abs(z) >= 1e7 AS overflow
  FROM g{len(powers)}),
chunked AS (
  SELECT *, replace(spaced, ' ', '') AS digits,
         CASE WHEN z IS NULL THEN ' Nan' ELSE CASE WHEN z < 0 THEN ' -' ELSE '' END || spaced END AS chunk
  FROM gd)"""
    )
    return ",\n".join(steps)


TOKENS = """listed AS (SELECT *, regexp_extract_all(chunk || ' ,', ' [^ ]+') AS toks FROM chunked),
tokens AS (SELECT * EXCLUDE (toks), unnest(toks) AS tok, unnest(range(len(toks))) AS j FROM listed)"""

COUNTED = "counted AS (SELECT *, len(regexp_extract_all(chunk || ' ,', ' [^ ]+')) AS n_tok FROM chunked)"


def _budget(n_steps: int, context: int, keys: str = "series_id", source: str = "counted", within: str = "true") -> str:
    return f"""suffixed AS (
  SELECT *, sum(CASE WHEN {within} THEN n_tok ELSE 0 END) OVER w AS suffix_tok,
         sum(CASE WHEN {within} THEN 1 ELSE 0 END) OVER w AS suffix_steps
  FROM {source}
  WINDOW w AS (PARTITION BY {keys} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fit AS (
  SELECT {keys}, min(i) AS cut FROM suffixed
  WHERE {within} AND suffix_tok + {n_steps} * (CAST(suffix_tok AS DOUBLE) / (suffix_steps + 1)) * CAST(1.2 AS DOUBLE) < {context}
  GROUP BY {keys}),
cutted AS (SELECT * FROM suffixed LEFT JOIN fit USING ({keys}))"""


REPORT = """report AS (
  SELECT series_id, coalesce(string_agg(chunk || ' ,', '' ORDER BY i) FILTER (WHERE i >= cut), '') AS prompt,
         count(*) - count(*) FILTER (WHERE i >= cut) AS discarded, count(*) FILTER (WHERE i >= cut) AS kept,
         coalesce(sum(n_tok) FILTER (WHERE i >= cut), 0) AS tokens
  FROM cutted GROUP BY 1),
reported AS (
  SELECT *, CASE WHEN kept > 0 THEN CAST(tokens AS DOUBLE) / (kept + 1) END AS avg_tokens,
         CASE WHEN kept > 0 THEN 'ok' ELSE 'does_not_fit' END AS status
  FROM report)"""

REPORT_COLUMNS = (
    "discarded, kept, CAST(tokens AS BIGINT) AS tokens, round(avg_tokens, 6) AS avg_tokens, status"
)


def _allowed(scoring: bool) -> str:
    tokens = [f" {d}" for d in range(10)] + [" ,", " -"] + ([" "] if scoring else [])
    return "(" + ", ".join(f"'{t}'" for t in tokens) + ")"


ALLOWED, ALLOWED_SCORING = _allowed(False), _allowed(True)

# next-token model over tokens(series_id, i, j, tok, split)
CONTEXTS = """ordered AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY i, j) - 1 AS pos,
         lag(tok, 2) OVER (PARTITION BY series_id ORDER BY i, j) AS p2,
         lag(tok, 1) OVER (PARTITION BY series_id ORDER BY i, j) AS p1
  FROM tokens),
model AS (
  SELECT series_id, p2, p1, tok, count(*) AS c FROM ordered
  WHERE split = 'train' AND p2 IS NOT NULL GROUP BY ALL)"""

ANALOG = """analog AS (
  SELECT series_id, sample_id, i - (n - 30 - 52 * (sample_id + 1)) AS step, chunk
  FROM chunked, range(5) t(sample_id)
  WHERE i - (n - 30 - 52 * (sample_id + 1)) BETWEEN 0 AND 30 - sample_id),
numbered AS (
  SELECT series_id, sample_id, row_number() OVER (PARTITION BY series_id, sample_id ORDER BY step) - 1 AS step,
         count(*) OVER (PARTITION BY series_id, sample_id) AS n_chunks, chunk
  FROM analog),
done AS (SELECT * FROM numbered WHERE step < n_chunks - 1),
decoded AS (
  SELECT *, CASE WHEN chunk = ' Nan' THEN NULL
                 ELSE CASE WHEN chunk LIKE ' -%' THEN -1 ELSE 1 END
                      * (CAST(regexp_replace(chunk, '[ -]', '', 'g') AS DOUBLE) / 1000 + CAST(0.5 AS DOUBLE) / 1000) END AS z
  FROM done),
sized AS (
  SELECT b.series_id, b.sample_id, b.n_chunks - 1 AS steps,
         coalesce(min(d.step) FILTER (WHERE d.chunk = ' Nan'), b.n_chunks - 1) AS usable
  FROM (SELECT DISTINCT series_id, sample_id, n_chunks FROM numbered) b
  LEFT JOIN decoded d ON d.series_id = b.series_id AND d.sample_id = b.sample_id
  GROUP BY b.series_id, b.sample_id, b.n_chunks),
horizons AS (SELECT series_id, min(usable) AS horizon, count(*) AS n_samples FROM sized GROUP BY 1),
samples AS (
  SELECT series_id, sample_id, step, z * scale + "offset" AS x
  FROM decoded JOIN horizons USING (series_id) JOIN scal USING (series_id) WHERE step < horizon)"""

#: Every week as part of a text: a season per sample.
SEASONS = "analog AS (SELECT series_id, i // 52 AS sample_id, i % 52 AS step, chunk FROM chunked),\nnumbered AS" + ANALOG.split("numbered AS", 1)[1]

TRUTH = "truth AS (SELECT series_id, i - (n - 30) AS step, y FROM series WHERE i >= n - 30)"

WIDE = """moved AS (
  SELECT a.series_id, a.i - (a.n - 30) AS step, a.y FROM series a),
train_means AS (SELECT series_id, avg(y) AS train_mean FROM marked WHERE split = 'train' GROUP BY 1),
steps AS (
  SELECT DISTINCT series_id, step FROM (
    SELECT series_id, step FROM moved UNION ALL SELECT series_id, step + 52 FROM moved)
  WHERE step BETWEEN 0 AND 29),
wide AS (
  SELECT s.series_id, s.step, t.y AS test, e.y AS seasonal_naive, m.train_mean
  FROM steps s LEFT JOIN moved t ON t.series_id = s.series_id AND t.step = s.step
  LEFT JOIN moved e ON e.series_id = s.series_id AND e.step + 52 = s.step
  LEFT JOIN train_means m ON m.series_id = s.series_id),
benchmark_long AS (
  SELECT series_id, step, 'seasonal_naive' AS model, seasonal_naive AS yhat FROM wide
  UNION ALL SELECT series_id, step, 'train_mean', train_mean FROM wide)"""

ATTACHED = """points AS (SELECT series_id, step, quantile_cont(x, 0.5) AS yhat FROM samples GROUP BY 1, 2),
lengths AS (SELECT series_id, max(step) + 1 AS h FROM points GROUP BY 1),
attached AS (
  SELECT b.series_id, b.step, b.model, b.yhat FROM benchmark_long b
  WHERE coalesce(b.step < (SELECT max(h) FROM lengths l WHERE l.series_id = b.series_id), true)
  UNION ALL SELECT series_id, step, 'analog_median', yhat FROM points
  UNION ALL SELECT DISTINCT series_id, step, 'analog_median', CAST(NULL AS DOUBLE) FROM benchmark_long
  WHERE series_id NOT IN (SELECT series_id FROM lengths))"""

# scored texts by rule: training steps within the token budget, then the held-out steps
RULED = ",\n".join(
    [
        _advanced(0.5, 0.15),
        _decimal(2),
        COUNTED,
        _budget(30, CONTEXT, within="split = 'train'"),
        """chosen AS (SELECT * FROM cutted WHERE i >= cut OR split = 'val'),
ruled AS (
  SELECT series_id, i, split, n, scale, tok, row_number() OVER (PARTITION BY series_id ORDER BY i, j) - 1 AS pos
  FROM (SELECT *, unnest(regexp_extract_all(chunk || ' ,', ' [^ ]+')) AS tok,
               unnest(range(len(regexp_extract_all(chunk || ' ,', ' [^ ]+')))) AS j FROM chosen)),
scored AS (
  SELECT *, CASE WHEN pos > 0 THEN CAST(CAST(-(0.1 + ((pos * 7) % 23) / 10.0) AS FLOAT) AS DOUBLE) END AS logprob,
         CASE WHEN pos % 3 = 0 THEN exp(-(2.0 + pos % 5)) ELSE 0 END
         + CASE WHEN tok IN """
        + ALLOWED_SCORING
        + """ THEN 0 ELSE exp(-(0.1 + ((pos * 7) % 23) / 10.0)) END AS extra
  FROM ruled),
lens AS (
  SELECT series_id, count(DISTINCT i) FILTER (WHERE split = 'train') AS n_train, least(max(n), 30) AS n_val,
         max(scale) AS scale
  FROM ruled GROUP BY 1),
starts AS (
  SELECT r.series_id, min(pos) FILTER (WHERE r.tok = ' ,' AND seps = n_train) + 1 AS val_start
  FROM (SELECT *, sum(CASE WHEN tok = ' ,' THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos) AS seps
        FROM ruled) r JOIN lens USING (series_id) GROUP BY 1),
nlls AS (
  SELECT series_id, n_val, lens.scale AS scale, CASE WHEN val_start IS NULL THEN 'no_validation_start'
              WHEN max(extra) FILTER (WHERE pos >= val_start) >= 1 THEN 'unusable_token' ELSE 'ok' END AS status,
         CASE WHEN max(extra) FILTER (WHERE pos >= val_start) < 1 THEN
           -sum(CASE WHEN pos >= val_start THEN logprob - ln(CASE WHEN extra < 1 THEN 1 - extra END) END) / n_val END AS nll
  FROM scored JOIN starts USING (series_id) JOIN lens USING (series_id)
  GROUP BY series_id, n_val, lens.scale, val_start)""",
    ]
)

POINTS = """grid AS (
  SELECT row_number() OVER (ORDER BY alpha, beta) - 1 AS pid, alpha, beta, 2 AS prec, CAST(1 AS DOUBLE) AS temp
  FROM (SELECT CAST(unnest([0.2, 0.5, 0.8]) AS DOUBLE) AS alpha), (SELECT CAST(unnest([0, 0.15]) AS DOUBLE) AS beta)),
fitgrid AS (
  SELECT series_id, pid, alpha, beta, prec, temp,
         min(y) FILTER (WHERE split = 'train') - beta * (max(y) FILTER (WHERE split = 'train') - min(y) FILTER (WHERE split = 'train')) AS "offset",
         CASE alpha WHEN 0.2 THEN quantile_cont(y, 0.2) FILTER (WHERE split = 'train')
                    WHEN 0.5 THEN quantile_cont(y, 0.5) FILTER (WHERE split = 'train')
                    ELSE quantile_cont(y, 0.8) FILTER (WHERE split = 'train') END AS q,
         count(*) AS steps
  FROM marked, grid GROUP BY series_id, pid, alpha, beta, prec, temp),
scal AS (
  SELECT * EXCLUDE (q), CASE WHEN q - "offset" = 0 THEN 1 ELSE q - "offset" END AS scale FROM fitgrid)"""

SCORES = ",\n".join(
    [
        MARKED,
        POINTS,
        """zed AS (
  SELECT m.*, s.pid, s.alpha, s.beta, s.prec, s.temp, s.scale, (m.y - s."offset") / s.scale AS z
  FROM marked m JOIN scal s USING (series_id))""",
        _decimal("prec"),
        COUNTED,
        _budget(30, CONTEXT, keys="series_id, pid", within="split = 'train'"),
        """chosen AS (SELECT * FROM cutted WHERE i >= cut OR split = 'val'),
tokens AS (
  SELECT series_id, pid, i, split, unnest(regexp_extract_all(chunk || ' ,', ' [^ ]+')) AS tok,
         unnest(range(len(regexp_extract_all(chunk || ' ,', ' [^ ]+')))) AS j FROM chosen),
ordered AS (
  SELECT *, lag(tok, 2) OVER (PARTITION BY series_id, pid ORDER BY i, j) AS p2,
         lag(tok, 1) OVER (PARTITION BY series_id, pid ORDER BY i, j) AS p1 FROM tokens),
model AS (
  SELECT series_id, pid, p2, p1, tok, count(*) AS c FROM ordered
  WHERE split = 'train' AND p2 IS NOT NULL GROUP BY ALL),
totals AS (SELECT series_id, pid, p2, p1, sum(c) AS total FROM model GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, pid, p2, p1 ORDER BY c DESC, tok) AS rank FROM model),
extras AS (
  SELECT series_id, pid, p2, p1, sum((c + 1) / CAST(total + 13 AS DOUBLE)) AS extra
  FROM ranked JOIN totals USING (series_id, pid, p2, p1)
  WHERE rank <= 5 AND tok NOT IN """
        + ALLOWED_SCORING
        + """ GROUP BY ALL),
lps AS (
  SELECT o.series_id, o.pid,
         CAST(CAST(ln((coalesce(m.c, 0) + 1) / CAST(coalesce(t.total, 0) + 13 AS DOUBLE)) AS FLOAT) AS DOUBLE)
         - ln(1 - coalesce(e.extra, 0)) AS lp
  FROM ordered o
  LEFT JOIN model m ON m.series_id = o.series_id AND m.pid = o.pid AND m.p2 = o.p2 AND m.p1 = o.p1 AND m.tok = o.tok
  LEFT JOIN totals t ON t.series_id = o.series_id AND t.pid = o.pid AND t.p2 = o.p2 AND t.p1 = o.p1
  LEFT JOIN extras e ON e.series_id = o.series_id AND e.pid = o.pid AND e.p2 = o.p2 AND e.p1 = o.p1
  WHERE o.split = 'val'),
sums AS (SELECT series_id, pid, -sum(lp) AS total FROM lps GROUP BY 1, 2),
lens AS (SELECT series_id, least(max(n), 30) AS n_val FROM marked GROUP BY 1),
scores0 AS (
  SELECT s.series_id, s.pid, s.alpha, s.beta, s.prec, s.temp,
         CASE WHEN s.scale IS NULL THEN 'no_training_part' WHEN f.cut IS NULL THEN 'does_not_fit' ELSE 'ok' END AS status,
         total / n_val - s.prec * ln(CAST(10 AS DOUBLE)) + ln(s.scale) AS value
  FROM scal s JOIN sums USING (series_id, pid) JOIN lens USING (series_id) LEFT JOIN fit f USING (series_id, pid)),
scores AS (SELECT * EXCLUDE (value), CASE WHEN status = 'ok' THEN value END AS nlld FROM scores0)""",
    ]
)

SCORE_COLUMNS = "series_id, CAST(pid AS BIGINT) AS pid, alpha, beta, CAST(prec AS BIGINT) AS prec, temp, round(nlld, 6) AS nlld"


def _draws(rows: str, asked: str) -> str:
    """Samples drawn from the counts of ``rows`` (series_id, i, chunk) for ``asked`` (series_id, prompt, max_tokens,
    temperature, n_samples): texts (series_id, sample_id, text), one draw of every sample per round."""
    words = ", ".join(f"' {d}'" for d in range(10)) + ", ' ,', ' -', ' Nan'"
    return f"""voc AS (SELECT unnest([{words}]) AS tok, unnest(range(13)) AS k),
d_tokens AS (
  SELECT series_id, i, unnest(regexp_extract_all(chunk || ' ,', ' [^ ]+')) AS tok,
         unnest(range(len(regexp_extract_all(chunk || ' ,', ' [^ ]+')))) AS j FROM {rows}),
d_ctx AS (
  SELECT series_id, tok, lag(tok, 2) OVER w AS p2, lag(tok, 1) OVER w AS p1 FROM d_tokens WINDOW w AS (PARTITION BY series_id ORDER BY i, j)),
d_pairs AS (
  SELECT series_id, a.k * 13 + b.k AS ctx, t.k, count(*) AS c
  FROM d_ctx JOIN voc a ON a.tok = p2 JOIN voc b ON b.tok = p1 JOIN voc t ON t.tok = d_ctx.tok WHERE t.k < 12 GROUP BY ALL),
d_counts AS (SELECT * FROM d_pairs UNION ALL SELECT series_id, 169, k, sum(c) FROM d_pairs GROUP BY ALL),
d_weights AS (
  SELECT q.series_id, q.ctx, v.k, power(coalesce(c, 0) / CAST(max(c) OVER (PARTITION BY q.series_id, q.ctx) AS DOUBLE), 1 / temperature) AS w
  FROM (SELECT DISTINCT series_id, ctx FROM d_counts) q JOIN {asked} r ON r.series_id = q.series_id CROSS JOIN voc v
  LEFT JOIN d_counts c ON c.series_id = q.series_id AND c.ctx = q.ctx AND c.k = v.k),
d_tables AS (
  SELECT series_id, ctx, list(cum ORDER BY k) AS cum
  FROM (SELECT *, sum(w) OVER (PARTITION BY series_id, ctx ORDER BY k) AS cum FROM d_weights) GROUP BY 1, 2),
d_start AS (
  SELECT series_id, max_tokens, unnest(range(n_samples)) AS sample_id, regexp_extract_all(prompt, ' [^ ]+') AS toks FROM {asked}),
d_draws AS (
  SELECT series_id, sample_id, 0 AS drawn, max_tokens, '' AS text, a.k * 13 + b.k AS ctx,
         CAST('0x' || substr(md5(CAST(series_id AS VARCHAR) || '|' || CAST(sample_id AS VARCHAR) || '|1234'), 1, 8) AS BIGINT) % 2147483646 + 1 AS rng
  FROM d_start JOIN voc a ON a.tok = toks[-2] JOIN voc b ON b.tok = toks[-1]
  UNION ALL
  SELECT d.series_id, sample_id, drawn + 1, max_tokens, text || tok, (d.ctx % 13) * 13 + k, rng
  FROM (
    SELECT d.* REPLACE (d.rng * 48271 % 2147483647 AS rng), coalesce(a.cum, b.cum) AS cum
    FROM d_draws d LEFT JOIN d_tables a ON a.series_id = d.series_id AND a.ctx = d.ctx
    JOIN d_tables b ON b.series_id = d.series_id AND b.ctx = 169 WHERE drawn < max_tokens) d
  JOIN voc ON k = len(list_filter(cum, lambda w: w <= rng / CAST(2147483647 AS DOUBLE) * cum[13]))),
texts AS (SELECT series_id, sample_id, text FROM d_draws WHERE drawn = max_tokens)"""


#: The history before the test part in the place of the series.
def _past(series: str) -> str:
    head, tail = series.split("series AS (", 1)
    return f"{head}whole AS ({tail},\nseries AS (SELECT series_id, wk, i, n - 30 AS n, y FROM whole WHERE i < n - 30)".replace("WITH ", "WITH RECURSIVE ", 1)


def _forecast(scalers: str) -> str:
    """Point forecasts of the series under ``scalers`` (series_id, offset, scale): f_points (series_id, step, yhat, status)."""
    return f"""f_zed AS (
  SELECT m.series_id, m.i, s."offset", s.scale, CASE WHEN s.scale <> 0 THEN (m.y - s."offset") / s.scale END AS z
  FROM marked m LEFT JOIN {scalers} s USING (series_id)),
{_decimal(2, "f_zed", "f_chunked")},
f_counted AS (SELECT *, len(regexp_extract_all(chunk || ' ,', ' [^ ]+')) AS n_tok FROM f_chunked),
f_suffixed AS (
  SELECT *, sum(n_tok) OVER w AS suffix_tok, count(*) OVER w AS suffix_steps FROM f_counted
  WINDOW w AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f_fit AS (
  SELECT series_id, min(i) AS cut FROM f_suffixed
  WHERE suffix_tok + 30 * (CAST(suffix_tok AS DOUBLE) / (suffix_steps + 1)) * CAST(1.2 AS DOUBLE) < {CONTEXT} GROUP BY 1),
f_kept AS (SELECT * FROM f_suffixed JOIN f_fit USING (series_id) WHERE i >= cut),
f_asked AS (
  SELECT series_id, string_agg(chunk || ' ,', '' ORDER BY i) AS prompt,
         CAST(floor(CAST(sum(n_tok) AS DOUBLE) / (count(*) + 1) * 30 * CAST(1.05 AS DOUBLE)) AS BIGINT) AS max_tokens,
         CAST(1 AS DOUBLE) AS temperature, 10 AS n_samples, max("offset") AS "offset", max(scale) AS scale
  FROM f_kept GROUP BY 1 HAVING max(scale) IS NOT NULL),
{_draws("f_kept", "f_asked")},
f_pieces AS (
  SELECT series_id, sample_id, list_filter(string_split(text, ' ,'), lambda p: len(p) > 0) AS pieces FROM texts),
f_steps AS (
  SELECT series_id, sample_id, unnest(pieces[:-2]) AS chunk, unnest(range(len(pieces) - 1)) AS step, len(pieces) - 1 AS n_chunks FROM f_pieces),
f_read AS (
  SELECT *, trim(CASE WHEN chunk LIKE ' -%' THEN substr(chunk, 3) ELSE chunk END) AS body FROM f_steps),
f_values AS (
  SELECT *, CASE WHEN regexp_full_match(body, '[0-9]( [0-9])*') THEN
    CASE WHEN chunk LIKE ' -%' THEN -1 ELSE 1 END * (CAST(replace(body, ' ', '') AS DOUBLE) / 100 + CAST(0.5 AS DOUBLE) / 100) END AS z FROM f_read),
f_usable AS (
  SELECT series_id, sample_id, coalesce(min(step) FILTER (WHERE z IS NULL), max(n_chunks)) AS usable FROM f_values GROUP BY 1, 2),
f_horizon AS (
  SELECT series_id, min(coalesce(usable, 0)) AS h FROM texts LEFT JOIN f_usable USING (series_id, sample_id) GROUP BY 1),
f_values_cut AS (
  SELECT series_id, step, quantile_cont(z * scale + "offset", 0.5) AS yhat
  FROM f_values JOIN f_horizon USING (series_id) JOIN f_asked USING (series_id) WHERE step < h GROUP BY 1, 2),
f_status AS (
  SELECT a.series_id, CASE WHEN max(s.series_id) IS NULL THEN 'no_usable_score' WHEN max(s.scale) IS NULL THEN 'no_training_part'
                           WHEN max(f.cut) IS NULL THEN 'does_not_fit'
                           WHEN max(h) > 0 THEN 'ok' ELSE 'no_common_step' END AS status
  FROM (SELECT DISTINCT series_id FROM marked) a LEFT JOIN {scalers} s USING (series_id) LEFT JOIN f_fit f USING (series_id)
  LEFT JOIN f_horizon h USING (series_id) GROUP BY 1),
f_points AS (SELECT series_id, step, yhat, status FROM f_status LEFT JOIN f_values_cut USING (series_id))"""


#: Parameters of the final forecast.
FINAL = f"""f_scal AS (
  SELECT series_id, lo - CAST(0.15 AS DOUBLE) * (hi - lo) AS "offset",
         CASE WHEN q - (lo - CAST(0.15 AS DOUBLE) * (hi - lo)) = 0 THEN 1 ELSE q - (lo - CAST(0.15 AS DOUBLE) * (hi - lo)) END AS scale
  FROM (SELECT series_id, min(y) FILTER (WHERE split = 'train') AS lo, max(y) FILTER (WHERE split = 'train') AS hi,
               quantile_cont(y, 0.2) FILTER (WHERE split = 'train') AS q FROM marked GROUP BY 1))"""


def _line_means(columns: list[str]) -> str:
    means = ", ".join(
        f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / nullif(count({c}), 0) AS {c}" for c in columns
    )
    return f"SELECT l_returnflag AS series_id, {WEEK.format('l_shipdate')} AS wk, {means} FROM lineitem GROUP BY 1, 2"


LINE_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def oracle() -> dict[str, str]:
    z1, z2, z3 = (f"{s},\n{_basic()}" for s in (S1, S2, S3))
    c1, c2, c3 = (f"{z},\n{_decimal()}" for z in (z1, z2, z3))
    c1p2 = f"{z1},\n{_decimal(2)}"
    cut3 = f"{c3},\n{COUNTED},\n{_budget(20, SMALL_CONTEXT)}"
    prep3 = f"{c3},\n{COUNTED},\n{_budget(12, SMALL_CONTEXT)},\n{REPORT}"
    request3, request1 = (f"{c},\n{COUNTED},\n{_budget(12, CONTEXT)},\n{REPORT}" for c in (c3, c1))
    a1, a2, a3 = (f"{c},\n{ANALOG}" for c in (c1, c2, c3))
    sql: dict[str, str] = {}

    sql["parse_times"] = """
SELECT o_orderpriority, count(ts) AS parsed, count(*) - count(ts) AS rejected,
       CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day
FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS ts FROM orders) GROUP BY 1"""
    sql["bind_series"] = """
SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS observations,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2"""
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in LINE_VALUES)
    sql["weekly_mean_columns"] = f"SELECT series_id, wk, {rounded} FROM ({_line_means(LINE_VALUES)})"
    sql["select_target"] = (
        f"SELECT series_id, wk, round(l_quantity, 6) AS value FROM ({_line_means(['l_quantity'])})"
    )
    sql["rejected_observations"] = """
SELECT count(*) AS observations, count(*) FILTER (WHERE l_orderkey % 7 = 0 OR l_shipdate IS NULL) AS without_time,
       count(*) FILTER (WHERE l_orderkey % 5 = 0 OR l_suppkey IS NULL) AS without_id,
       count(*) FILTER (WHERE l_orderkey % 11 = 0 OR l_orderkey % 13 = 0) AS no_number,
       count(*) FILTER (WHERE l_orderkey % 11 > 0 AND l_orderkey % 13 > 0 AND (l_orderkey % 3 = 0 OR l_extendedprice IS NULL)) AS missing_values
FROM lineitem"""
    sql["observations_parsed"] = """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderkey % 9 > 0) AS accepted, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS rejected,
       count(*) FILTER (WHERE o_orderkey % 9 > 0 AND o_orderkey % 11 > 0) AS values,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderkey % 9 > 0 AND o_orderkey % 11 > 0) AS DOUBLE) AS total,
       min(o_orderpriority || ',' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ',n/a') FILTER (WHERE o_orderkey % 9 = 0) AS first_rejected,
       CAST(min(o_orderdate) AS DATE) AS first_day
FROM orders GROUP BY 1"""
    sql["predictions_parsed"] = """
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS step, o_orderkey AS idx, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS test,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 2 AS DOUBLE) AS twice FROM orders"""
    sql["completions_parsed"] = """
SELECT o_orderkey % 5 AS sample, count(*) FILTER (WHERE o_orderkey % 13 > 0) AS accepted, count(*) FILTER (WHERE o_orderkey % 13 = 0) AS rejected,
       CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 3) FILTER (WHERE o_orderkey % 13 > 0) AS BIGINT) AS characters,
       max(length('{"series_id":"' || o_orderpriority || '","pid":0,"sample_id":0,"text":" ' || CAST(o_orderkey AS VARCHAR) || ' ,"}') - 4)
         FILTER (WHERE o_orderkey % 13 = 0) AS longest_rejected
FROM orders GROUP BY 1"""
    net = "l_extendedprice * (1 - l_discount) / 7"
    sql["mean_any_order"] = f"""
SELECT l_suppkey AS series_id, {WEEK.format('l_shipdate')} AS wk, round(avg({net}), 6) AS y FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2"""
    sql["values_off_scale"] = f"""
SELECT l_suppkey AS series_id, count({net}) AS observations, count(*) FILTER (WHERE round(({net}) * 100) / 100 <> {net}) AS off_scale,
       round(max(abs(round(({net}) * 100) / 100 - {net})), 6) AS largest FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1"""
    sql["week_ends"] = f"SELECT {WEEK.format('o_orderdate')} AS wk, count(*) AS orders FROM orders GROUP BY 1"
    sql["weekly_mean"] = f"WITH {W2} SELECT series_id, wk, round(y, 6) AS y FROM weekly"
    sql["weekly_spine"] = f"{S3} SELECT series_id, wk, i, n, round(y, 6) AS y FROM series"
    sql["step_index"] = f"""WITH {W1}
SELECT series_id, wk, row_number() OVER (PARTITION BY series_id ORDER BY wk) - 1 AS i, round(y, 6) AS y FROM weekly"""
    sql["head_per_series"] = f"{S3} SELECT series_id, i, round(y, 6) AS y FROM series WHERE i < 10"
    sql["series_profile"] = f"""{S3}
SELECT series_id, count(*) AS steps, count(*) - count(y) AS gaps, min(wk) AS first_wk, max(wk) AS last_wk,
       round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM series GROUP BY 1"""
    sql["holdout"] = f"""{S2}, {MARKED}
SELECT series_id, split, count(*) AS steps, min(wk) AS first_wk, round(avg(y), 6) AS mean_y FROM marked GROUP BY 1, 2"""
    sql["concat_splits"] = f"{S1} SELECT series_id, i, round(y, 6) AS y FROM series"

    sql["scale_identity"] = f"""{S2}
SELECT DISTINCT series_id, 'identity' AS kind, CAST(0 AS DOUBLE) AS "offset", CAST(1 AS DOUBLE) AS scale FROM series"""
    sql["scale_gaussian"] = f"""{S2},
g AS (SELECT series_id, avg(y) AS m, stddev_pop(y) AS d FROM series GROUP BY 1)
SELECT series_id, i, round((y - m) / nullif(d, 0), 6) AS z FROM series JOIN g USING (series_id)"""
    sql["scale_basic"] = f"""{S3}
SELECT series_id, 'basic' AS kind, CAST(0 AS DOUBLE) AS "offset",
       round(greatest(quantile_cont(abs(y), 0.9), 0.01), 6) AS scale FROM series WHERE y IS NOT NULL GROUP BY 1"""
    advanced_all = """t AS (SELECT series_id, min(y) - CAST(0.3 AS DOUBLE) * (max(y) - min(y)) AS "offset",
  quantile_cont(y, 0.95) AS q, count(*) - count(y) AS gaps FROM series GROUP BY 1),
u AS (SELECT series_id, "offset", gaps, CASE WHEN q - "offset" = 0 THEN 1 ELSE q - "offset" END AS scale FROM t)"""
    sql["scale_advanced"] = f"""{S2}, {advanced_all}
SELECT series_id, 'advanced' AS kind, round("offset", 6) AS "offset", round(scale, 6) AS scale FROM u"""
    sql["scale_transform"] = f"""{S2}, {advanced_all}
SELECT series_id, i, round((y - "offset") / scale, 6) AS z FROM series JOIN u USING (series_id)"""
    sql["scale_propagate"] = f"""{S2}, {advanced_all}
SELECT series_id, 'advanced' AS kind, CASE WHEN gaps = 0 THEN round("offset", 6) END AS "offset",
       CASE WHEN gaps = 0 THEN round(scale, 6) END AS scale FROM u"""
    sql["scale_inverse"] = f"{S2} SELECT series_id, i, round(y, 4) AS x FROM series"
    sql["log_slope"] = f"""{S3}
SELECT series_id, CASE WHEN stddev_pop(y) > 0 THEN round(-ln(stddev_pop(y)), 6) END AS log_slope FROM series GROUP BY 1"""

    sql["digits_decimal"] = f"{c2} SELECT series_id, i, digits, overflow FROM chunked"
    sql["digits_greedy"] = f"""{z2},
{_greedy()} SELECT series_id, i, CASE WHEN z IS NOT NULL THEN digits END AS digits, overflow FROM chunked"""
    sql["chunks"] = f"{c2} SELECT series_id, i, chunk FROM chunked"
    big = "zed AS (SELECT *, y * 1000 AS z FROM series)"
    sql["chunks_greedy_overflow"] = f"{S3},\n{big},\n{_greedy()} SELECT series_id, i, chunk, overflow FROM chunked"
    sql["series_string"] = f"{c2} SELECT series_id, string_agg(chunk || ' ,', '' ORDER BY i) AS text FROM chunked GROUP BY 1"
    sql["series_string_greedy"] = f"""{z1},
{_greedy()} SELECT series_id, string_agg(chunk || ' ,', '' ORDER BY i) AS text FROM chunked GROUP BY 1"""
    sql["chunks_of_any_size"] = f"""{S3}
SELECT series_id, count(*) AS steps, count(*) AS chunks, count(*) FILTER (WHERE y IS NULL OR i % 7 = 0) AS missing,
       count(*) AS in_text FROM series GROUP BY 1"""
    sql["terminated"] = f"{c2} SELECT series_id, i, chunk || ' ,' AS text FROM chunked"

    sql["token_rows"] = f"{c2},\n{TOKENS} SELECT series_id, i, j, tok FROM tokens"
    sql["token_counts"] = f"{c2},\n{TOKENS} SELECT series_id, i, count(*) AS n_tok FROM tokens GROUP BY 1, 2"
    sql["suffix_tokens"] = f"""{cut3}
SELECT series_id, i, CAST(suffix_tok AS BIGINT) AS suffix_tok, CAST(suffix_steps AS BIGINT) AS suffix_steps FROM cutted"""
    sql["truncate_budget"] = f"{cut3} SELECT series_id, i, chunk FROM cutted WHERE i >= cut"
    sql["truncate_report"] = f"{cut3},\n{REPORT} SELECT series_id, {REPORT_COLUMNS} FROM reported"
    sql["truncate_impossible"] = f"""{c2},\n{COUNTED},\n{_budget(12, 30)},\n{REPORT}
SELECT series_id, {REPORT_COLUMNS} FROM reported"""
    sql["prepare_joined_digits"] = f"""{c2.replace("regexp_replace(digits, '(.)', ' \\1', 'g')", "digits")},
counted AS (SELECT *, CASE WHEN z IS NULL THEN 2 ELSE length(digits) + CASE WHEN z < 0 THEN 2 ELSE 1 END END AS n_tok FROM chunked),
{_budget(12, SMALL_CONTEXT)},
{REPORT} SELECT series_id, prompt, {REPORT_COLUMNS} FROM reported"""
    sql["digit_array"] = f"""{S3},
zed AS (SELECT *, y * 1000 AS z FROM series),
{_greedy()}
SELECT series_id, i, coalesce(replace(ltrim(spaced), ' ', '|'), '') AS digits,
       CASE WHEN z IS NULL THEN -1 ELSE len(string_split(ltrim(spaced), ' ')) END AS n FROM chunked"""
    sql["prepare"] = f"{prep3} SELECT series_id, prompt, {REPORT_COLUMNS} FROM reported"
    whole = "cutted AS (SELECT *, 0 AS cut FROM counted)"
    sql["prepare_whole"] = f"{c1},\n{COUNTED},\n{whole},\n{REPORT} SELECT series_id, prompt, {REPORT_COLUMNS} FROM reported"

    sql["requests"] = f"""{request3}
SELECT series_id, prompt, CAST(floor(avg_tokens * 12 * CAST(1.05 AS DOUBLE)) AS BIGINT) AS max_tokens,
       CAST(0.7 AS DOUBLE) AS temperature, CAST(5 AS BIGINT) AS n_samples, CAST(1234 AS BIGINT) AS seed,
       CAST(12 AS BIGINT) AS n_bias, status FROM reported"""
    sql["requests"] = sql["requests"].replace("CAST(12 AS BIGINT) AS n_bias", "CASE WHEN status = 'ok' THEN CAST(12 AS BIGINT) END AS n_bias")
    sql["requests_that_do_not_fit"] = f"""{c3},\n{COUNTED},\n{_budget(12, 90)},\n{REPORT}
SELECT series_id, CAST(floor(avg_tokens * 12 * CAST(1.05 AS DOUBLE)) AS BIGINT) AS max_tokens, status <> 'ok' AS no_bias, status FROM reported"""
    asked1 = f"""{c1p2},\n{COUNTED},\n{_budget(12, CONTEXT)},\n{REPORT},
asked AS (
  SELECT series_id, prompt, CAST(floor(avg_tokens * 12 * CAST(1.05 AS DOUBLE)) AS BIGINT) AS max_tokens,
         CAST(0.7 AS DOUBLE) AS temperature, 5 AS n_samples FROM reported)"""
    sql["sample_completions"] = f"""{asked1},\n{_draws("chunked", "asked")}
SELECT series_id, sample_id, text FROM texts""".replace("WITH ", "WITH RECURSIVE ", 1)
    p1, p3 = f"{_past(S1)},\n{MARKED},\n{FINAL},\n{_forecast('f_scal')}", f"{_past(S3)},\n{MARKED},\n{FINAL},\n{_forecast('f_scal')}"
    point = "SELECT series_id, step, round(yhat, 4) AS yhat, status FROM f_points"
    sql["forecast"] = f"{p1} {point}"
    sql["forecast_status"] = f"""{p3}
SELECT series_id, count(step) AS steps, count(yhat) AS values, max(status) AS status FROM f_points GROUP BY 1"""
    sql["forecast_tuned"] = f"""{_past(S1)},\n{SCORES},
f_best AS (
  SELECT series_id, pid FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY nlld, pid) AS place FROM scores WHERE nlld IS NOT NULL) WHERE place = 1),
f_scal AS (SELECT series_id, "offset", scale FROM scal JOIN f_best USING (series_id, pid)),
{_forecast("f_scal")} {point.replace("yhat, 4", "yhat, 3")}"""
    compared = WIDE.replace("FROM series a", "FROM whole a").replace("FROM marked WHERE split = 'train'", "FROM whole WHERE i < n - 30")
    sql["forecast_comparison"] = f"""{p1},
{compared},
truth AS (SELECT series_id, i - (n - 30) AS step, y FROM whole WHERE i >= n - 30),
{ATTACHED.replace("SELECT series_id, step, quantile_cont(x, 0.5) AS yhat FROM samples GROUP BY 1, 2", "SELECT series_id, step, yhat FROM f_points WHERE status = 'ok'").replace("analog_median", "next_token")}
SELECT model, round(avg(abs(yhat - y)), 4) AS mae, count(yhat - y) AS compared, count(*) - count(yhat - y) AS unmatched,
       count(DISTINCT series_id) - count(DISTINCT CASE WHEN yhat IS NOT NULL THEN series_id END) AS series_without_forecast
FROM attached LEFT JOIN truth USING (series_id, step) GROUP BY 1"""
    sql["token_bias"] = f"""{request1}
SELECT series_id, tok, CAST(30 AS BIGINT) AS bias FROM reported,
  (SELECT ' ' || CAST(range AS VARCHAR) AS tok FROM range(10) UNION ALL SELECT ' ,' UNION ALL SELECT ' -')
WHERE status = 'ok'"""
    sql["allowed_tokens"] = f"""{c2},\n{TOKENS}
SELECT tok, count(*) AS uses, tok IN {ALLOWED} AS may_complete, tok IN {ALLOWED_SCORING} AS may_score
FROM tokens GROUP BY tok"""
    sql["next_token_counts"] = f"{c1p2},\n{TOKENS},\n{CONTEXTS} SELECT series_id, p2, p1, tok, c FROM model"
    sql["score_tokens"] = f"""{c1p2},\n{TOKENS},\n{CONTEXTS},
totals AS (SELECT series_id, p2, p1, sum(c) AS total, count(*) AS kinds, max(c) AS top FROM model GROUP BY ALL),
odd AS (
  SELECT series_id, p2, p1, sum((c + 1) / CAST(total + 13 AS DOUBLE)) AS extra FROM (
    SELECT m.*, total, row_number() OVER (PARTITION BY series_id, p2, p1 ORDER BY c DESC, tok) AS rank
    FROM model m JOIN totals USING (series_id, p2, p1))
  WHERE rank <= 5 AND tok NOT IN {ALLOWED_SCORING} GROUP BY ALL)
SELECT o.series_id, o.pos, o.tok,
       CASE WHEN pos > 0 THEN round(CAST(CAST(ln((coalesce(c, 0) + 1) / CAST(coalesce(total, 0) + 13 AS DOUBLE)) AS FLOAT) AS DOUBLE), 6) END AS logprob,
       CAST(least(coalesce(kinds, 0), 5) AS BIGINT) AS n_top,
       round(ln((top + 1) / CAST(total + 13 AS DOUBLE)), 6) AS top_logprob, round(coalesce(extra, 0), 6) AS extra
FROM ordered o
LEFT JOIN model m ON m.series_id = o.series_id AND m.p2 = o.p2 AND m.p1 = o.p1 AND m.tok = o.tok
LEFT JOIN totals t ON t.series_id = o.series_id AND t.p2 = o.p2 AND t.p1 = o.p1
LEFT JOIN odd e ON e.series_id = o.series_id AND e.p2 = o.p2 AND e.p1 = o.p1"""

    b2, b3 = f"{c2},\n{SEASONS}", f"{c3},\n{SEASONS}"
    sql["decode_split"] = f"{b2} SELECT series_id, sample_id, step, chunk FROM done"
    sql["decode_values"] = f"""{b2}
SELECT series_id, sample_id, step, round(z, 6) AS z, z IS NULL AS malformed FROM decoded"""
    sql["decode_malformed"] = f"{b3} SELECT series_id, sample_id, steps, usable FROM sized"
    sql["rescale_roundtrip"] = f"""{S2},
b AS (SELECT series_id, greatest(quantile_cont(abs(y), 0.95), 0.01) AS scale FROM series WHERE y IS NOT NULL GROUP BY 1),
zed AS (SELECT s.*, scale, y / scale AS z FROM series s JOIN b USING (series_id)),
{_decimal()},
back AS (
  SELECT series_id, y, scale, CASE WHEN z IS NOT NULL THEN
    abs(CASE WHEN z < 0 THEN -1 ELSE 1 END * (CAST(digits AS DOUBLE) / 1000 + CAST(0.0005 AS DOUBLE)) * scale - y) END AS e
  FROM chunked WHERE i < n - 1)
SELECT series_id, count(*) AS steps, count(e) AS compared, round(avg(e), 4) AS mae, round(max(e), 4) AS max_error,
       round(max(scale), 4) AS scale FROM back GROUP BY 1"""

    sql["common_horizon"] = f"{a3} SELECT series_id, horizon, n_samples FROM horizons"
    sql["clip_samples"] = f"{a1} SELECT series_id, sample_id, step, round(x, 4) AS x FROM samples"
    sql["mae_samples"] = f"""{a1}, {TRUTH}
SELECT series_id, round(avg(abs(x - y)), 4) AS mae, count(x - y) AS compared, count(*) - count(y) AS unmatched
FROM samples LEFT JOIN truth USING (series_id, step) GROUP BY 1"""
    sql["median_forecast"] = f"""{a1}
SELECT series_id, step, round(quantile_cont(x, 0.5), 4) AS yhat FROM samples GROUP BY 1, 2"""
    sql["attach_model"] = f"{a1},\n{WIDE},\n{ATTACHED} SELECT series_id, step, model, round(yhat, 4) AS yhat FROM attached"
    sql["attach_model_gaps"] = f"{a3},\n{WIDE},\n{ATTACHED} SELECT series_id, step, model, round(yhat, 4) AS yhat FROM attached"
    for name, a in (("mae_by_model", a1), ("mae_by_model_gaps", a3)):
        sql[name] = f"""{a},\n{WIDE},\n{ATTACHED}, {TRUTH}
SELECT model, round(avg(abs(yhat - y)), 4) AS mae, count(yhat - y) AS compared, count(*) - count(yhat - y) AS unmatched,
       count(DISTINCT series_id) - count(DISTINCT CASE WHEN yhat IS NOT NULL THEN series_id END) AS series_without_forecast
FROM attached LEFT JOIN truth USING (series_id, step) GROUP BY 1"""
    sql["comparison_wide"] = f"""{a1},\n{WIDE},\n{ATTACHED}, {TRUTH}
SELECT series_id, step, round(max(y), 4) AS y,
       round(max(CASE WHEN model = 'analog_median' THEN yhat END), 4) AS analog_median,
       round(max(CASE WHEN model = 'seasonal_naive' THEN yhat END), 4) AS seasonal_naive,
       round(max(CASE WHEN model = 'train_mean' THEN yhat END), 4) AS train_mean
FROM attached FULL JOIN truth USING (series_id, step) GROUP BY 1, 2"""
    sql["unpivot_benchmark"] = f"""{S2}, {MARKED},\n{WIDE}
SELECT series_id, step, model, round(yhat, 4) AS yhat FROM benchmark_long WHERE yhat IS NOT NULL
UNION ALL SELECT series_id, step, model, yhat FROM benchmark_long WHERE yhat IS NULL"""

    r1, r2 = f"{S1},\n{RULED}", f"{S2},\n{RULED}"
    sql["token_logprobs"] = f"""{r1}
SELECT series_id, pos, tok, round(logprob, 6) AS logprob, CAST(CASE WHEN pos % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_top FROM scored"""
    sql["val_start"] = f"{r1} SELECT series_id, n_train, val_start FROM starts JOIN lens USING (series_id)"
    sql["val_tokens"] = f"""{r1}
SELECT series_id, count(*) AS n_tokens, string_agg(tok, '' ORDER BY pos) AS text
FROM ruled JOIN starts USING (series_id) WHERE pos >= val_start GROUP BY 1"""
    sql["extra_mass"] = f"{r2} SELECT series_id, pos, round(extra, 6) AS extra FROM scored"
    sql["nll_per_step"] = f"{r1} SELECT series_id, round(nll, 6) AS nll, status FROM nlls"
    sql["nlld"] = f"""{r2}
SELECT series_id, round(nll - 2 * ln(CAST(10 AS DOUBLE)) + ln(scale), 6) AS nlld, status FROM nlls"""

    sql["score_config"] = sql["nlld"]
    sql["grid_scores_landed"] = f"""{S1},\n{SCORES},
l_tokens AS (SELECT *, row_number() OVER (PARTITION BY series_id, pid ORDER BY i, j) - 1 AS pos FROM tokens),
l_scored AS (
  SELECT *, CAST(CAST(-(0.1 + ((pos * 7) % 23) / 10.0) AS FLOAT) AS DOUBLE) AS logprob,
         CASE WHEN pos % 3 = 0 THEN exp(-(2.0 + pos % 5)) ELSE 0 END
         + CASE WHEN tok IN {ALLOWED_SCORING} THEN 0 ELSE exp(-(0.1 + ((pos * 7) % 23) / 10.0)) END AS extra
  FROM l_tokens WHERE split = 'val')
SELECT series_id, CAST(pid AS BIGINT) AS pid, max(alpha) AS alpha, max(beta) AS beta, CAST(max(prec) AS BIGINT) AS prec, max(temp) AS temp,
       CASE WHEN pid = 5 THEN 'no_answer' WHEN max(extra) >= 1 THEN 'unusable_token' ELSE 'ok' END AS status,
       CASE WHEN pid < 5 AND max(extra) < 1 THEN
         round(-sum(logprob - ln(CASE WHEN extra < 1 THEN 1 - extra END)) / max(n_val) - max(prec) * ln(CAST(10 AS DOUBLE)) + ln(max(scale)), 6) END AS nlld
FROM l_scored JOIN scal USING (series_id, pid) JOIN lens USING (series_id) GROUP BY series_id, pid"""
    sql["param_grid"] = f"""{S2}, {MARKED},\n{POINTS}
SELECT series_id, CAST(pid AS BIGINT) AS pid, alpha, beta, CAST(prec AS BIGINT) AS prec, temp,
       round("offset", 6) AS "offset", round(scale, 6) AS scale, steps FROM scal"""
    sql["scoring_requests"] = f"""{S3},\n{SCORES},
asked AS (
  SELECT series_id, pid, string_agg(chunk || ' ,', '' ORDER BY i) AS prompt, count(*) FILTER (WHERE split = 'train') AS n_train
  FROM chosen GROUP BY 1, 2)
SELECT s.series_id, CAST(s.pid AS BIGINT) AS pid, coalesce(a.prompt, '') AS prompt, coalesce(a.n_train, 0) AS n_train,
       CAST(lens.n_val AS BIGINT) AS n_val, round(s.scale, 6) AS scale, s.temp AS temperature,
       CASE WHEN s.scale IS NULL THEN 'no_training_part' WHEN f.cut IS NULL THEN 'does_not_fit' ELSE 'ok' END AS status
FROM scal s JOIN lens USING (series_id) LEFT JOIN asked a USING (series_id, pid) LEFT JOIN fit f USING (series_id, pid)"""
    sql["grid_scores"] = f"{S1},\n{SCORES} SELECT {SCORE_COLUMNS}, status FROM scores"
    sql["grid_scores_gaps"] = f"{S3},\n{SCORES} SELECT {SCORE_COLUMNS}, status FROM scores"
    sql["grid_scores_spread"] = sql["grid_scores_gaps"]
    sql["best_params"] = f"""{S1},\n{SCORES}
SELECT {SCORE_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY nlld, pid) AS place FROM scores WHERE nlld IS NOT NULL)
WHERE place = 1"""
    sql["leaderboard"] = f"{S1},\n{SCORES} SELECT {SCORE_COLUMNS}, status FROM scores ORDER BY nlld NULLS LAST, series_id, pid"

    sql["check_positive"] = f"""{S2}
SELECT series_id, count(*) FILTER (WHERE y <= 0) AS violations, count(y) AS checked FROM series GROUP BY 1"""
    sql["check_unit_quantile"] = f"""{S1}
SELECT series_id, CAST(1 AS DOUBLE) AS quantile, true AS ok FROM series GROUP BY 1"""
    sql["check_unique_step"] = f"{S1} SELECT series_id, i, CAST(2 AS BIGINT) AS times FROM series WHERE i >= n - 30"
    sql["check_truth"] = f"""{S2}, {MARKED},\n{WIDE}, {TRUTH},
cmp AS (
  SELECT coalesce(w.series_id, t.series_id) AS series_id, coalesce(w.step, t.step) AS step, w.seasonal_naive AS test, t.y,
         CASE WHEN w.series_id IS NULL THEN 'not_in_benchmark' WHEN t.series_id IS NULL THEN 'not_in_truth'
              WHEN w.seasonal_naive IS NULL AND t.y IS NULL THEN NULL
              WHEN w.seasonal_naive IS NULL OR t.y IS NULL THEN 'missing_value'
              WHEN abs(w.seasonal_naive - t.y) > 1e-6 THEN 'differs' END AS problem
  FROM wide w FULL JOIN truth t ON w.series_id = t.series_id AND w.step = t.step)
SELECT series_id, step, round(test, 4) AS test, round(y, 4) AS y, problem FROM cmp WHERE problem IS NOT NULL"""
    sql["head_rows"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10"""
    return sql
