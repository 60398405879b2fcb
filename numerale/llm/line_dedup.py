"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A text is cut into lines: at line ends, and inside a physical line after the
punctuation that ends a clause, since shared passages often sit inside longer
lines.  Cutting loses nothing: the lines joined give the text back.  A run is a stretch of
consecutive lines with at least ``min_words`` words; a run that stands earlier - in a row
that comes before (by id, then as read), or before in its own text - is deleted.

* Fingerprints (winnowing): of the lines of each shortest stretch of ``min_words`` words the
  one with the smallest hash is selected (long lines before short ones), so that two texts that share
  a run always share a selected line at the same place of it.
* Positions: each fingerprint of a row is joined to its first place in the corpus, and inside the
  text to its place before.
* Extension: on each pair of rows and shift that a fingerprint found, matches are extended both ways
  line by line; each stretch of agreeing lines with ``min_words`` words is a run.  What
  agrees with different sources or at different shifts is never joined to one run.
* The rest: a fingerprint with three or more places may share a run with another place than
  the first.  Only where the runs found so far do not cover its surroundings, the shortest
  stretches of ``min_words`` words around all its places are hashed, and each that stands
  earlier, whoever holds it first, is a run too.  So every run that stands earlier goes.

Fingerprints are sent once per row and pre-aggregated; a passage that very many documents share gives
one pair per document, with its first holder.  Hashes with very many places (at most ``HOT_KEYS``)
meet their holder by broadcast, the others by a shuffle; rows that surely take no part in a join are
told by a bitmap (sized by the number of keys, at most half a million words) and stay where they are.  Pairs
are joined with line hashes (8 bytes a line), never with texts.

Only whole lines are compared: what repeats inside a line, such as a passage without
line ends or clause marks in other surroundings, stays.

Defined cases: null text stays null; empty texts stay; rows without id or with one id are
documents each, equal rows too (the first as read keeps its text); a null id comes before all
others; a text all of whose lines are deleted becomes empty.  Other columns, whatever their
names, are passed on; if there is a column of the result's name, the result's gets an
underscore more.  Rows are numbered as they are read: ``docs`` must come in the same order
when it is read again, as files do (a row that does not is left as it is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerale.llm.common import free_name, stored, whole_row

LINE_END = r"(?<=[.,;:!?])(?= )|(?<=\n)"
MARK = "\x01"
#: Bits of a bitmap, at least and at most (half a million words of 64 bits), and per key.
SLOTS, MOST_SLOTS, SLOTS_PER_KEY = 1 << 16, 1 << 25, 8
#: Keys that have more than this share of all places are joined by broadcast: so many at most.
HOT_KEYS = 10_000
NEAR = 32  # lines that stretches of the usual length need at most: looked at one by one, without a slice of the array
SHORT = 5  # words; lines below this are selected only among themselves


def flags(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with the column flag: false only if the key is surely not in ``wanted``, a stored table with this key.

    The wanted keys set bits of a map, which is broadcast.  What is not flagged need not be shuffled to a join with
    them; with far more keys than slots everything is flagged and nothing is lost.
    """
    slots = min(MOST_SLOTS, max(SLOTS, 1 << (SLOTS_PER_KEY * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(slots))
    bit = (slot % 64).cast("int")
    words = wanted.select(F.shiftright(slot, 6).alias("word"), F.expr("1L").alias("one"), bit.alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("bit"))).alias("bits"))
    own = rows.withColumns({"word": F.shiftright(slot, 6), "bit": bit}).join(F.broadcast(words), "word", "left")
    return own.withColumn("flag", F.coalesce(F.getbit("bits", "bit") == 1, F.lit(False))).drop("word", "bit", "bits")


def lines_of(text: Column) -> Column:
    """The lines of a text: a cut after each line end, and before a blank after a clause mark."""
    marked = F.replace(text, F.lit("\n"), F.lit("\n" + MARK))
    for c in ".,;:!?":
        marked = F.replace(marked, F.lit(c + " "), F.lit(c + MARK + " "))
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, LINE_END, -1)).otherwise(F.split(marked, MARK, -1))


def blocks(min_words: int) -> list[int]:
    """Numbers of lines (powers of two) whose words and smallest fingerprint are made once per line: a stretch has ``min_words`` lines at most."""
    return [1 << n for n in range(max(min_words - 1, 4).bit_length())]


def named(name: str, lines: int) -> str:
    return name if lines == 1 else f"{name}{lines}"


def reach(words: int, most: int = 0) -> str:
    """SQL in ``transform(nw, (x, i) -> ...)``: how many lines from line i on have ``words`` words together; 0 if the text ends before.

    ``nw2``, ``nw4``, ... hold the words of so many lines from each line on (null if the text ends before): halving
    finds the number, whatever it is (``most`` at most, where this is known); null is as good as enough, and a number that
    passes the last of the ``lines`` is none.
    """

    def search(low: int, high: int, before: str) -> str:  # more than low lines, high at most; before: the words of low lines
        if high - low == 1:
            return f"if(i + {high} > lines, 0, {high})"
        half = 1 << ((high - low - 1).bit_length() - 1)
        total = before + f"get({named('nw', half)}, i + {low})"
        return f"if({total} < {words}, {search(low + half, high, total + ' + ')}, {search(low, low + half, before)})"

    return search(0, most or max(words, 5), "")


def least_print(min_words: int) -> str:
    """SQL in ``transform(w, (n, i) -> ...)``: the smallest fingerprint of the n lines from line i on; null for none.

    ``k2``, ``k4``, ... hold the smallest of so many lines from each line on; two of them that overlap hold that of n lines.
    """
    *small, most = blocks(min_words)
    least = f"least(get(k{most}, i), get(k{most}, i + n - {most}))"
    for size in reversed(small):
        k = named("k", size)
        least = f"if(n < {2 * size}, least(get({k}, i), get({k}, i + n - {size})), {least})" if size > 1 else f"if(n < 2, get(k, i), {least})"
    return f"if(n = 0, null, {least})"


def print_of(h: str, nw: str) -> str:
    """SQL: the fingerprint of a line: its hash, negative for long lines, so that they come before short ones."""
    return f"if({nw} < {SHORT}, {h} & 9223372036854775807L, {h} | -9223372036854775808L)"


def line_table(rows: DataFrame, min_words: int) -> DataFrame:
    """Per text: id, row, line hashes h, words per line nw, how many lines the shortest stretch of ``min_words`` words
    from each line on has (w; 0 at the end of the text), the places of its fingerprints s (f, p) in the order of f and p, and
    the distances between places of one fingerprint (steps).

    ``rows``: id, row, text.
    """
    rows = rows.where(F.col("text") != "").select("id", "row", F.xxhash64("text").alias("th"), lines_of(F.col("text")).alias("u"))
    bare = F.transform("u", lambda u: F.btrim(u, F.lit(" \t\r\n")))
    rows = rows.select("id", "row", "th", bare.alias("u")).select(
        "id",
        "row",
        "th",
        F.transform("u", lambda u: F.xxhash64(u)).alias("h"),
        # no more than a run needs: a line counts at most min_words words
        F.transform("u", lambda u: F.least(F.octet_length(u) - F.octet_length(F.replace(u, F.lit(" "), F.lit(""))) + 1, F.lit(min_words))).alias("nw"),
    )
    rows = rows.withColumns({"k": F.expr(f"zip_with(h, nw, (a, n) -> {print_of('a', 'n')})"), "lines": F.size("nw")})
    most = blocks(min_words)[-1]

    def next_(name: str, n: int, both: str) -> str:  # of n lines and the next n
        return f"zip_with({named(name, n)}, slice({named(name, n)}, {n + 1}, lines), (a, b) -> {both})"

    for n in blocks(min_words)[:-1]:
        # no line is looked up where n lines have half of the words anywhere in the text: none is as good as enough
        sums = next_("nw", n, "a + b") if n < 4 else f"if(array_min({named('nw', n)}) * 2 >= {min_words}, cast(array() as array<int>), {next_('nw', n, 'a + b')})"
        rows = rows.withColumn(f"nw{2 * n}", F.expr(sums))
    shorter = f"if(size(nw{most}) = 0, transform(nw, (x, i) -> {reach(min_words, most)}), transform(nw, (x, i) -> {reach(min_words)}))"
    rows = rows.withColumn("w", F.expr(shorter if most < max(min_words, 5) else f"transform(nw, (x, i) -> {reach(min_words)})"))
    for n in blocks(min_words)[:-1]:
        rows = rows.withColumn(f"k{2 * n}", F.expr(f"if(array_max(w) >= {2 * n}, {next_('k', n, 'least(a, b)')}, cast(array() as array<bigint>))"))
    # the smallest fingerprint of the stretch from line i on is at the first of equal ones; from line to line it never goes back, and
    # it stays where it is if the one from the line before is equal and not in that line itself
    rows = rows.withColumn("m", F.expr(f"transform(w, (n, i) -> {least_print(min_words)})"))
    at = " ".join(f"WHEN get(k, i + {n}) = x THEN i + {n}" for n in range(min(min_words, NEAR)))
    at = f"CASE {at} ELSE int(i + array_position(slice(k, i + 1, get(w, i)), x) - 1) END"
    once = f"array_remove(transform(m, (x, i) -> if(x is null or (x = get(m, i - 1) and x != get(k, i - 1)), -1, {at})), -1)"
    places = F.expr(f"sort_array(transform({once}, x -> struct(get(k, x) as f, x as p)))")
    rows = rows.select("id", "row", "th", "h", "nw", "w", places.alias("s"))
    steps = "array_distinct(filter(transform(s, (x, i) -> if(i > 0 and s[i - 1].f = x.f, x.p - s[i - 1].p, null)), x -> x is not null))"
    # most texts hold each fingerprint once
    return rows.withColumn("steps", F.expr(f"if(size(array_distinct(s.f)) = size(s), cast(array() as array<int>), {steps})"))


def first_holders(places: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(places that have an earlier holder, with it and n; the keys of at least two places, stored).

    ``places``: key, at (a struct that orders them), n (how many it stands for).  Keys with very many places meet
    their holder by broadcast: their number is bounded, however large the corpus is.
    """
    held = places.groupBy(key).agg(F.min("at").alias("o"), F.sum("n").alias("all"), F.count("*").alias("rows"))
    held = stored(held.where("rows > 1 or all > 1"), "lines-holders")
    total = held.agg(F.sum("rows")).first()[0] or 0
    many = max(1000, total // HOT_KEYS)
    hot = held.where(F.col("rows") > many).select(key, F.col("o").alias("hot_o"), F.col("all").alias("hot_all"))
    cold = held.where(F.col("rows") <= many).select(key, "o", "all")
    met = places.join(F.broadcast(hot), key, "left")
    at_hot = met.where("hot_o is not null").select(key, "at", F.col("hot_o").alias("o"), F.col("hot_all").alias("all"))
    rest = flags(met.where("hot_o is null").select(key, "at"), key, held).where("flag").select(key, "at")
    return at_hot.unionByName(rest.join(cold, key)), held


def enough(a: str, b: str) -> str:
    """SQL: whether the lines a to b have ``min_words`` words together: the shortest stretch from a on ends with b or before."""
    return f"(get(w, {a}) between 1 and ({b}) - ({a}) + 1)"


def agreeing(shifts: str, other: str) -> str:
    """SQL: the runs (a, b) of lines that agree with the lines of ``other`` ``k`` before, for each shift k."""
    from_, to = "greatest(k, 0)", f"(least(size(h), size({other}) + k) - 1)"
    breaks = f"concat(array({from_} - 1), filter(sequence({from_}, {to}), i -> h[i] != {other}[i - k]), array({to} + 1))"
    runs = "transform(slice(z, 2, size(z) - 1), (e, j) -> struct(z[j] + 1 as a, e - 1 as b))"
    runs = f"filter({runs}, r -> r.b >= r.a and {enough('r.a', 'r.b')})"
    one = f"flatten(transform(array({breaks}), z -> {runs}))"
    return f"flatten(transform({shifts}, k -> if({from_} <= {to}, {one}, array())))"


def paired_runs(lines: DataFrame) -> DataFrame:
    """(row, th, runs, open): the runs that agree with the first holder of a fingerprint or inside the text, and the
    places of fingerprints with three or more places that they do not cover."""
    # each fingerprint's first place in the text, and how often (up to three times) it is there
    places = lines.select("id", "row", "s", F.posexplode("s").alias("i", "x")).where("i = 0 or get(s, i - 1).f != x.f")
    often = F.expr("if(get(s, i + 1).f <=> x.f, if(get(s, i + 2).f <=> x.f, 3, 2), 1)").alias("n")
    places = places.select("id", "row", F.col("x.f").alias("f"), F.col("x.p").alias("p"), often)
    places = places.select("f", F.struct("id", "row", "p", "n").alias("at"), "n")
    met, _ = first_holders(places, "f")
    many = F.col("all") > 2
    met = met.where((F.col("at.row") != F.col("o.row")) | many)
    met = met.select(
        F.col("at.row").alias("row"), F.col("o.row").alias("source"), (F.col("at.p") - F.col("o.p")).alias("shift"),
        F.when(many, F.col("at.p")).alias("p"), (many & (F.col("at.n") > 1)).alias("again"),
    )
    pairs = met.groupBy("row", "source").agg(F.collect_set("shift").alias("at"), F.collect_list("p").alias("ps"), F.max("again").alias("again"))
    pairs = stored(pairs, "lines-pairs")
    sources = pairs.select(F.col("source").alias("row"), F.col("row").alias("later")).where("row != later")
    source = flags(lines.select("row", "h"), "row", sources).where("flag").select(F.col("row").alias("source"), F.col("h").alias("sh"))
    other = pairs.where("row != source").join(source, "source")
    # a row that holds a fingerprint first is compared with itself only
    own = pairs.where("row = source").select("source", "row", "at", "ps", "again", F.lit(None).cast("array<bigint>").alias("sh"))
    found = other.select("source", "row", "at", "ps", "again", "sh").unionByName(own)
    mine = flags(lines.select("row", "th", "h", "nw", "w", "s", "steps"), "row", pairs).where("flag or size(steps) > 0").drop("flag")
    both = mine.join(found, "row", "left")
    runs = F.when(F.col("sh").isNotNull(), F.expr(agreeing("at", "sh"))).alias("runs")
    each = both.select("row", "th", "h", "nw", "w", "s", "steps", runs, "ps", "again")
    each = each.groupBy("row").agg(
        F.first("th").alias("th"), F.first("h").alias("h"), F.first("nw").alias("nw"), F.first("w").alias("w"),
        F.first("s").alias("s"), F.first("steps").alias("steps"),
        F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("ps")).alias("ps"), F.max("again").alias("again"),
    )
    each = each.withColumn("runs", F.concat("runs", F.expr(agreeing("steps", "h"))))
    each = each.withColumn("ps", F.expr("if(again, transform(s, x -> x.p), ps)"))
    before, after = enough("r.a", "p - 1"), enough("p + 1", "r.b")
    covered = f"exists(runs, r -> r.a <= p and r.b >= p and (r.a = 0 or {before}) and (r.b = size(h) - 1 or {after}))"
    each = each.withColumn("open", F.expr(f"filter(ps, p -> not {covered})"))
    prints = f"transform(open, p -> {print_of('h[p]', 'nw[p]')})"
    return stored(each.select("row", "th", "runs", F.expr(prints).alias("open")), "lines-runs")


def other_runs(lines: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """(row, th, runs): around all places of the fingerprints left open, the shortest stretches that stand earlier."""
    wanted = stored(found.select(F.explode("open").alias("f")).distinct(), "lines-open")
    places = lines.select("row", F.explode("s").alias("x")).select("row", F.col("x.f").alias("f"), F.col("x.p").alias("p"))
    places = flags(places, "f", wanted).where("flag").join(wanted, "f").groupBy("row").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    # each place with the one before it: a stretch is taken with the first place that it holds
    places = stored(places.select("row", F.expr("transform(ps, (p, i) -> struct(p, if(i = 0, -1, ps[i - 1]) as q))").alias("ps")), "lines-places")
    rows = flags(lines.select("id", "row", "th", "h", "w"), "row", places).where("flag").join(places, "row")
    # one row per place, then per line a before it, then per last line b: from each line on, and up to each line, the shortest
    # stretch has min_words words; b goes from where the stretch from a ends to before where the stretch from a + 1 ends
    rows = rows.select("id", "row", "th", "h", "w", F.explode("ps").alias("x"))
    rows = rows.select("id", "row", "th", "h", "w", "x.p", "x.q", F.explode(F.sequence(F.lit(0), F.lit(min_words - 1))).alias("back"))
    rows = rows.withColumn("a", F.col("p") - F.col("back")).where("a > q and a >= 0 and get(w, a) > 0")
    end, next_ = "a + get(w, a) - 1", "if(get(w, a + 1) > 0, a + get(w, a + 1) - 1, size(w) - 1)"
    rows = rows.withColumns({"low": F.greatest("p", F.expr(end)), "high": F.greatest(F.expr(end), F.expr(next_))}).where("low <= high")
    rows = rows.select("id", "row", "th", "h", "a", F.explode(F.sequence("low", "high")).alias("b"))
    at = F.struct("id", "row", "a", "b", "th")
    hashed = F.expr("xxhash64(slice(h, a + 1, b - a + 1))")
    windows = stored(rows.select(hashed.alias("k"), at.alias("at"), F.lit(1).alias("n")), "lines-windows")
    met, _ = first_holders(windows, "k")
    met = met.where("at.row != o.row or at.a != o.a")
    return met.groupBy(F.col("at.row").alias("row")).agg(F.first("at.th").alias("th"), F.collect_list(F.struct("at.a", "at.b")).alias("runs"))


def repeated_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(row, th, runs), stored: the first and last lines of the runs of each row that stand earlier."""
    # mostly hashes, of which a dictionary saves nothing
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("h.list.element", "s.list.element.f")}
    lines = stored(line_table(rows, min_words), "lines", "snappy", plain)
    found = paired_runs(lines)
    both = found.where("size(runs) > 0").select("row", "th", "runs").unionByName(other_runs(lines, found, min_words))
    both = both.groupBy("row").agg(F.first("th").alias("th"), F.flatten(F.collect_list("runs")).alias("runs"))
    gone = F.expr("array_distinct(flatten(transform(runs, r -> sequence(r.a, r.b))))")
    return stored(both.select("row", "th", gone.alias("gone")), "lines-gone")


def remove_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, into: str = "lines_removed"
) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted, and the column lines_removed."""
    rows = docs.select(whole_row(docs).alias("doc"), F.monotonically_increasing_id().alias("row"))
    text = F.col("doc")[text_col]
    gone = repeated_runs(rows.select(F.col("doc")[id_col].alias("id"), "row", text.alias("text")), min_words)
    flagged = flags(rows, "row", gone)
    # texts that stay as they are do not move
    same = flagged.where("not flag").select("doc", text.alias("text"), F.lit(0).alias("removed"))
    some = flagged.where("flag").select("doc", "row", F.xxhash64(text).alias("own")).join(gone.hint("merge"), "row", "left")
    some = some.select("doc", F.when(F.col("own") == F.col("th"), F.col("gone")).alias("gone"), lines_of(text).alias("u"))
    left = F.expr("array_join(transform(array_except(sequence(0, size(u) - 1), gone), i -> u[i]), '')")
    changed = some.select(
        "doc", F.when(F.col("gone").isNull(), text).otherwise(left).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed")
    )
    out = [F.col("text") if c == text_col else F.col("doc")[c] for c in docs.columns]
    out = [x.alias(c) for x, c in zip(out, docs.columns)]
    return same.unionByName(changed).select(*out, F.col("removed").alias(free_name(into, docs.columns)))
