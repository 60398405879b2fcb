"""Held-out accuracy, attention on mixed documents, gradients, and the defined cases."""

import numpy as np
import pytest

from numerale.llm.common import crc_mod
from numerale.llm.quality import FEATURES, KINDS, PASSAGE, describe, fit, learn, scored


@pytest.fixture(scope="module")
def model_and_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return learn(docs, labels.where(crc_mod("doc_id", 5) != 0)), docs, labels


def test_held_out(model_and_data):
    model, docs, labels = model_and_data
    rows = scored(docs.join(labels.where(crc_mod("doc_id", 5) == 0), "doc_id"), model).select("quality", "score").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97 and np.mean([b < 0.3 for b in bad]) > 0.75


def test_same_score_alone_or_in_a_batch(model_and_data):
    model, docs, _ = model_and_data
    texts = [r.text.encode() for r in docs.limit(40).collect()] + [b"", b" \n", b"a"]
    together = model.score(*describe(texts))
    assert np.allclose(together, [model.score(*describe([t]))[0] for t in texts], atol=1e-5)


def test_passages_cover_the_text(monkeypatch):
    from numerale.llm import quality

    text = ("Some words here, 12 of them!\n" * 300).encode()
    whole = describe([text, b"x"])
    monkeypatch.setattr(quality, "CHUNK", 101)
    parts = describe([text, b"x"])
    assert whole[1].tolist() == parts[1].tolist() == [-(-len(text.split()) // PASSAGE), 1]
    assert np.allclose(whole[0], parts[0]) and whole[0].shape[1] == FEATURES
    assert np.allclose((whole[0][:, : KINDS * KINDS] ** 2).sum(axis=1), 1)


def test_one_bad_passage_is_found():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 6, 600)
    x = np.zeros((sizes.sum(), FEATURES), np.float32)
    x[:, :8] = rng.standard_normal((len(x), 8)) * 0.3
    labels = rng.integers(0, 2, 600).astype(np.float32)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = first + rng.integers(0, sizes)
    x[at[labels == 0], 3] += 4  # a single passage marks the document
    model = fit(x[: first[500]], sizes[:500], labels[:500], epochs=30)
    p = model.score(x[first[500] :], sizes[500:])
    assert ((p > 0.5) == labels[500:]).mean() > 0.9


def test_repeated_ids_do_not_fill_the_sample(spark, monkeypatch):
    from numerale.llm import quality

    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, sizes, labels: seen.append(labels.tolist()))
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(k, "other") for k in range(2, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k > 1)) for k in range(1, 12)], "doc_id long, quality int")
    learn(docs, labels, sample=20)
    assert sorted(seen[0]) == [0] + [1] * 10


def test_defined_cases(spark, odd, none, model_and_data):
    model, _, labels = model_and_data
    out = scored(odd.drop("score"), model)
    rows = out.collect()
    assert out.columns == [*odd.drop("score").columns, "score"] and len(rows) == odd.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1  # null and empty alike
    assert scored(none, model).count() == 0
    assert learn(odd, labels.where("false")).score(*describe([b"x"]))[0] == 0.5
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (7, None), (99, 0)], "doc_id long, quality int")
    assert learn(odd, one).score(*describe([b"x"]))[0] == 1.0  # the largest of several labels; nothing else to learn from


def test_a_long_document_teaches_with_some_of_its_passages(spark, monkeypatch):
    from numerale.llm import quality

    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, sizes, labels: seen.append((x, sizes, labels)))
    words = quality.PASSAGE * quality.LEARN_PASSAGES * 5
    docs = spark.createDataFrame([(1, "word " * words), (2, "short text"), (3, "a b " * 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    quality.learn(docs, labels)
    x, sizes, marks = seen[0]
    assert sizes.tolist() == [quality.LEARN_PASSAGES, 1, 2] and len(x) == sizes.sum() and marks.tolist() == [1, 0, 1]
