"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words (whole text; a text without
words is one empty passage).  A passage is described by how its character classes
follow each other and how its words repeat; a learned layer encodes it, gated
attention (a tanh branch times a sigmoid branch) weighs the passages against each
other, and the weighted sum of their encodings is scored.  All weights are learned
together from labels of documents only.

Learning: at most ``SAMPLE`` labelled documents, those with the smallest hash of their
id, are described on the executors; their passages go to the driver, where the model,
of fixed size, is fitted.  Scoring runs over all documents in tasks.

Defined cases: null text is an empty one; empty texts get a score; labels that are
null or belong to no document are not learned from, and of several labels of an id
the largest counts; without labels of both kinds every score is the share of label 1
(1/2 without any).  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerale.llm.common import free_name, quoted, schema_of, small_batches, texts_of

PASSAGE = 64
SAMPLE = 4000
LEARN_PASSAGES = 128  # of one document, spread evenly over it; scoring reads all
ENCODED = 24
ATTENTION = 12
THRESHOLD = 0.3

#: Character classes by byte: space, line end, lower, upper, digit, stop, comma, mark, dash or quote, symbol, rest, beyond ASCII.
CLASSES = np.full(256, 10, np.uint8)
CLASSES[128:] = 11
for _k, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!?", b"-'\"()", b"#$%&*+/<=>@[\\]^_`{|}~")):
    CLASSES[list(_chars)] = _k
KINDS = 12
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True
FEATURES = KINDS * KINDS + 5
CHUNK = 1 << 20


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages per text)."""
    stats, n_passages = [], []
    for text in texts:
        words = text.split()
        n_passages.append(max(1, -(-len(words) // PASSAGE)))
        for k in range(0, max(1, len(words)), PASSAGE):
            part = words[k : k + PASSAGE]
            n = max(1, len(part))
            repeats = sum(map(eq, part, part[1:]))
            stats.append((n / PASSAGE, len(set(part)) / n, repeats / n, sum(map(len, part)) / n / 10, not part))
    counts = np.zeros((len(stats), KINDS * KINDS), np.float32)
    base = np.concatenate([[0], np.cumsum(n_passages)])
    for t, text in enumerate(texts):
        before_words = 0
        for k in range(0, len(text), CHUNK):  # long texts in bounded parts, with one byte of context
            data = np.frombuffer(text, np.uint8, min(CHUNK, len(text) - k), k)
            blank = SPACE[data]
            previous = np.concatenate([[k == 0 or SPACE[text[k - 1]]], blank[:-1]])
            word = before_words + np.cumsum(~blank & previous)
            before_words = int(word[-1])
            passage = np.maximum(word - 1, 0) // PASSAGE
            kind = CLASSES[data].astype(np.int64)
            first = CLASSES[text[k - 1]] if k else 1
            pair = passage * (KINDS * KINDS) + np.concatenate([[first], kind[:-1]]) * KINDS + kind
            low = int(passage[0])
            got = np.bincount(pair - low * KINDS * KINDS).astype(np.float32)
            rows = -(-len(got) // (KINDS * KINDS))
            got = np.pad(got, (0, rows * KINDS * KINDS - len(got))).reshape(rows, -1)
            counts[base[t] + low : base[t] + low + rows] += got
    counts = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return np.concatenate([counts, np.array(stats, np.float32).reshape(-1, 5)], axis=1), np.array(n_passages)


@dataclass
class Model:
    """Encoder w, b; attention branches v, u and their combination a; output c, d; feature mean and scale."""

    weights: list[np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    prior: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        w, b, v, u, a, c, d = self.weights
        h = np.tanh(((x - self.mean) / self.scale) @ w + b)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * g) @ a
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        att = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(att[:, None] * h, starts)
        return h, t, g, att, sizes, z, 1 / (1 + np.exp(-np.clip(z @ c + d, -30, 30)))

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(sizes), self.prior)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return self.forward(x, starts)[-1].astype(float)


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 15, batch: int = 128, seed: int = 1) -> Model:
    """Minimise the cross entropy of the documents' labels (Adam, a fixed number of epochs)."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 0.02) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    if len(set(labels.tolist())) < 2:
        return Model([], mean, scale, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    shapes = [(FEATURES, ENCODED), (ENCODED,), (ENCODED, ATTENTION), (ENCODED, ATTENTION), (ATTENTION,), (ENCODED,), ()]
    weights = [(rng.standard_normal(s) / np.sqrt(s[0] if s else 1)).astype(np.float32) if len(s) != 0 else np.float32(0) for s in shapes]
    weights[1] = np.zeros(ENCODED, np.float32)
    model = Model(weights, mean.astype(np.float32), scale.astype(np.float32))
    moments = [[np.zeros(s, np.float32), np.zeros(s, np.float32)] for s in shapes]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(sizes))
        rate = 0.004 * (1 - epoch / epochs) + 0.0004
        for k in range(0, len(order), batch):
            mine = order[k : k + batch]
            rows = np.concatenate([np.arange(offsets[m], offsets[m + 1]) for m in mine])
            part = x[rows]
            starts = np.concatenate([[0], np.cumsum(sizes[mine])[:-1]])
            h, t, g, att, n, z, p = model.forward(part, starts)
            w, b, v, u, a, c, d = model.weights
            dy = ((p - labels[mine]) / len(mine)).astype(np.float32)
            dz = np.repeat(dy[:, None] * c, n, axis=0)
            datt = (dz * h).sum(axis=1)
            de = att * (datt - np.repeat(np.add.reduceat(att * datt, starts), n))
            dt, dg = (de[:, None] * a) * g * (1 - t * t), (de[:, None] * a) * t * g * (1 - g)
            dh = (att[:, None] * dz + dt @ v.T + dg @ u.T) * (1 - h * h)
            xs = (part - model.mean) / model.scale
            grads = [xs.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ dy, dy.sum()]
            step += 1
            for q, grad in enumerate(grads):
                grad = grad + 1e-4 * model.weights[q]
                m = moments[q]
                m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.999 * m[1] + 0.001 * grad * grad
                move = m[0] / (1 - 0.9**step) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
                model.weights[q] = (model.weights[q] - rate * move).astype(np.float32)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents, one of each id, and ``LEARN_PASSAGES`` passages of each: what
    reaches the driver is bounded, however long the texts are."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
    chosen = chosen.agg(F.max(F.col(label_col).cast("int")).alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
    # one row of each id, that with the smallest hash: at most `sample` rows, whatever ids repeat
    rows = rows.groupBy("__id", "__label").agg(F.min_by(F.col(text_col), F.xxhash64(text_col)).alias("__text"))
    out = schema_of("id string, label int, n int, x binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for key, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                x, n = describe([text])
                x = x[np.unique(np.linspace(0, n[0] - 1, min(n[0], LEARN_PASSAGES)).astype(int))]
                made.append((str(key), label, len(x), x.astype(np.float32).tobytes()))
            columns = list(zip(*made)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    found = rows.mapInArrow(run, "id string, label int, n int, x binary").toArrow()
    # the order makes the fit repeatable
    bags = sorted(zip(found["id"].to_pylist(), found["label"].to_pylist(), found["n"].to_pylist(), found["x"].to_pylist()))
    x = np.frombuffer(b"".join(b[3] for b in bags), np.float32).reshape(-1, FEATURES)
    return fit(x, np.array([b[2] for b in bags], int), np.array([b[1] for b in bags], np.float32))


def scored(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 (``into`` gets an underscore more where there is a column of that name)."""
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(into, docs.columns), score_column(model, F.col(quoted(text_col))))


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known = list(texts_of(texts))
        out: list[np.ndarray] = []
        part: list[bytes] = []
        size = 0
        for text in [*known, None]:
            if part and (text is None or size > CHUNK):
                out.append(model.score(*describe(part)))
                part, size = [], 0
            if text is not None:
                part.append(text)
                size += len(text)
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(text)
