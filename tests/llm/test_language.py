"""Held-out accuracy, votes, and the defined cases."""

import numpy as np
import pytest

from numerale.llm import language
from numerale.llm.common import crc_mod
from numerale.llm.language import fit, frequencies, identified, learn


@pytest.fixture(scope="module")
def learned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return learn(docs.where(crc_mod("doc_id", 4) != 2)), docs


def test_held_out(learned):
    model, docs = learned
    rows = identified(docs.where(crc_mod("doc_id", 4) == 2), model).select("lang", "lang_pred", "score").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert set(model.families) == {"germanic", "romance"} and len(model.pairs) == 2


def test_long_texts_in_parts(learned, monkeypatch):
    model, _ = learned
    text = ("Der Text ist lang und wird in Teilen gelesen. " * 400).encode()
    whole = model.margins(text), frequencies(text)
    monkeypatch.setattr(language, "PART", 97)
    assert np.allclose(model.margins(text), whole[0], atol=1e-5) and np.allclose(frequencies(text), whole[1], atol=1e-6)


def test_more_languages_and_unknown_families():
    rng = np.random.default_rng(1)
    alphabets = {"en": b"abcd ", "de": b"cdef ", "nl": b"efgh ", "xx": b"ijkl ", "es-MX": b"mnop "}
    make = lambda lang, n: bytes(rng.choice(list(alphabets[lang]), n))
    labels = [lang for lang in alphabets for _ in range(40)]
    model = fit(np.stack([frequencies(make(lang, 200)) for lang in labels]), labels)
    assert len(model.pairs) == 3 and set(model.families) == {"germanic", "xx", "romance"}
    assert all(model.predict(make(lang, 150))[0] == lang for lang in alphabets for _ in range(10))


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda x, labels: seen.append((x, labels)))
    rows = [(None, f"no id {k} of many", "en") for k in range(300)] + [(5, f"one id {k} of many", "de") for k in range(300)]
    rows += [(None, "the same row", "fr")] * 300 + [(k, f"other {k}", "fr") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn(docs, per_language=20)
    learn(docs, sample=2)  # more languages than the sample
    assert [seen[0][1].count(v) for v in ("en", "de", "fr")] == [20, 20, 20]
    assert len(seen[0][0]) == 60
    assert sorted(seen[1][1]) == ["de", "en", "fr"]


def test_defined_cases(spark, odd, none, learned):
    model, _ = learned
    out = identified(odd.drop("score"), model)
    rows = out.collect()
    assert out.columns == [*odd.drop("score").columns, "lang_pred", "score"] and len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not (r.text or "").strip()) and (r.lang_pred != "und" or r.score == 0)
    assert model.predict("123 ... !?_".encode())[0] == "und" and model.predict("漢字".encode())[0] != "und"
    assert identified(none, model).count() == 0
    nothing = learn(odd.withColumn("lang", odd["lang"].substr(9, 1)).where("lang is null"))
    assert nothing.predict(b"some text") == ("und", 0.0)


def test_numerals_are_no_letters(learned):
    model, _ = learned
    assert all(model.predict(t.encode()) == ("und", 0.0) for t in ("½ ²", "Ⅷ", "①", "12", "__", "〇"))
    assert model.predict("ª".encode())[0] != "und"
