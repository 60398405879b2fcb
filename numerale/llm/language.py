"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

A text is described by the frequencies of its byte trigrams (lower-cased in ASCII,
digits, punctuation and white space as one blank), hashed to ``BUCKETS`` numbers.
One linear machine per family (against the rest) chooses the family; within it one
linear support vector machine for every two languages votes, ties going to the
larger sum of margins.  As frequencies enter linearly, a text of any length is scored
by summing weights over its trigrams, in bounded parts.

Learning: at most ``PER_LANGUAGE`` documents of each language (fewer each with very many
languages: at most ``SAMPLE`` in all, but one of each language), those with the smallest
hashes of id and text, rows that repeat both being one, are described on the executors;
the machines, of fixed size, are fitted on the driver.

Defined cases: ``und`` with score 0 if the text is null, empty or has no letter, or
if nothing could be learned; a language of no known family is a family of its own;
null labels are not learned from.  Only id, text and (for learning) lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerale.llm.common import free_name, quoted, schema_of, small_batches, stored, texts_of, whole_row

BUCKETS = 1 << 12
PER_LANGUAGE = 500
SAMPLE = 3000
PART = 1 << 18

# Families of languages by their two-letter codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ca ro gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr ne ur pa gu",
    "semitic": "ar he am mt",
    "baltic": "lt lv",
    "celtic": "ga cy br gd",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

FOLD = np.arange(256, dtype=np.int64)
FOLD[:128] = 32
for _c in range(97, 123):
    FOLD[_c] = FOLD[_c - 32] = _c


def trigrams(text: bytes, start: int) -> np.ndarray:
    """Buckets of the trigrams that begin in text[start : start + PART]."""
    part = FOLD[np.frombuffer(text, np.uint8, min(PART + 2, len(text) - start), start)]
    if len(part) < 3:
        part = np.concatenate([part, np.full(3 - len(part), 32)])
    code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
    return ((code * 0x9E3779B1) >> 15) % BUCKETS


def frequencies(text: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS)
    for k in range(0, max(1, len(text) - 2), PART):
        counts += np.bincount(trigrams(text, k), minlength=BUCKETS)
    return (counts / counts.sum()).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # (buckets, families + pairs)
    bias: np.ndarray

    def margins(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for k in range(0, max(1, len(text) - 2), PART):
            found = trigrams(text, k)
            total += self.weights[found].sum(axis=0, dtype=np.float64)
            n += len(found)
        return total / n + self.bias

    def predict(self, text: bytes) -> tuple[str, float]:
        # a letter is what Unicode files under L: numerals such as those in circles are none
        if not self.languages or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return "und", 0.0
        margin = self.margins(text)
        names = sorted(set(self.families))
        score, family = 1.0, 0
        if len(names) > 1:
            family = int(np.argmax(margin[: len(names)]))
            rest = np.delete(margin[: len(names)], family).max()
            score = chance(margin[family] - rest)
        inside = [k for k, f in enumerate(self.families) if f == names[family]]
        votes, sums, own = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0.0), {}
        for q, (a, b) in enumerate(self.pairs):
            if a in votes and b in votes:
                m = margin[len(names) + q]
                votes[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
                own[a, b] = m
        best = max(inside, key=lambda k: (votes[k], sums[k]))
        against = [m if a == best else -m for (a, b), m in own.items() if best in (a, b)]
        return self.languages[best], score * (chance(min(against)) if against else 1.0)


def chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(margin, -20, 20))))


def machine(x: np.ndarray, y: np.ndarray, steps: int = 80, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, both sides weighted alike; y is 1 or -1."""
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    v, c = w.copy(), b
    rate = np.float32(1.0 / (2 * float(share @ np.einsum("ij,ij->i", x, x)) + 2 + penalty))
    for k in range(steps):  # accelerated gradient steps
        slack = np.maximum(0, 1 - y * (x @ v + c)) * share * y
        nw, nb = v + rate * (2 * (slack @ x) - np.float32(penalty) * v), c + rate * 2 * slack.sum()
        push = np.float32(k / (k + 3))
        v, c = nw + push * (nw - w), nb + push * (nb - b)
        w, b = nw, nb
    return w, float(b)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    languages = sorted(set(labels))
    families = [FAMILY_OF.get(lang.lower().split("-")[0], lang) for lang in languages]
    names, known = sorted(set(families)), np.array([languages.index(v) for v in labels], int)
    pairs = [(a, b) for a, b in combinations(range(len(languages)), 2) if families[a] == families[b]]
    if not languages:
        return Model([], [], [], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    scale = 1 / (np.sqrt(x.mean(axis=0)) + 1e-3)
    x = (x * scale).astype(np.float32)
    x_norm = float(np.sqrt((x * x).sum(axis=1)).mean())
    x, scale = x / np.float32(x_norm), scale / x_norm
    made = []
    family = np.array([names.index(f) for f in families])[known]
    for k in range(len(names)):
        made.append(machine(x, np.where(family == k, 1, -1)) if len(names) > 1 else (np.zeros(BUCKETS), 0.0))
    for a, b in pairs:
        mine = (known == a) | (known == b)
        made.append(machine(x[mine], np.where(known[mine] == a, 1, -1)))
    weights = np.stack([w * scale for w, _ in made], axis=1).astype(np.float32)
    return Model(languages, families, pairs, weights, np.array([b for _, b in made]))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Fit on a sample of ``docs`` (rows that may be learned from)."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64(F.col("id").cast("string"), "text"))
    # rows that repeat id and text count once
    marks = stored(rows.select("lang", "mark").distinct(), "language-marks")
    counts = stored(marks.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")  # one row per language
    wanted = max(1, min(per_language, sample // max(1, counts.count())))
    # about twice as many as wanted reach the driver; of each language the smallest are taken
    drawn = F.pmod("mark", F.lit(1 << 30)) * F.col("n") <= F.lit((2 * wanted + 64) * (1 << 30))
    some = marks.join(F.broadcast(counts), "lang").where(drawn).select("lang", "mark").toArrow()
    best: dict[str, list[int]] = {}
    for lang, mark in sorted(zip(some["lang"].to_pylist(), some["mark"].to_pylist()), key=lambda x: (x[0], x[1] % (1 << 30), x[1])):
        if len(best.setdefault(lang, [])) < wanted:
            best[lang].append(mark)
    taken = docs.sparkSession.createDataFrame([(lang, m) for lang, own in best.items() for m in own], "lang string, mark long")
    chosen = rows.join(F.broadcast(taken), ["lang", "mark"]).groupBy("lang", "mark")
    chosen = chosen.agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "lang", "text")
    out = schema_of("id string, lang string, x binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [str(k) for k in batch.column(0).to_pylist()]
            x = [frequencies(t).tobytes() for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(1).cast(pa.string()), pa.array(x, pa.binary())], schema=out)

    found = chosen.mapInArrow(run, "id string, lang string, x binary").toArrow()
    order = sorted(zip(found["id"].to_pylist(), found["lang"].to_pylist(), found["x"].to_pylist()))
    x = np.frombuffer(b"".join(o[2] for o in order), np.float32).reshape(-1, BUCKETS)
    return fit(x, [o[1] for o in order])


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (with an underscore more where there is a column of that name)."""
    small_batches(docs.sparkSession)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t) for t in texts_of(texts)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], fields=list(kind))

    found = docs.select(whole_row(docs).alias("doc"), predict(F.col(quoted(text_col))).alias("found"))
    own = [F.col("found")[c].alias(free_name(c, docs.columns)) for c in ("lang_pred", "score")]
    return found.select("doc.*", *own)
