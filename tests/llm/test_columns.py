"""No operator or stage touches a column of the user, whatever its name."""

import pytest

from numerale.llm import decontaminate, language, line_dedup, pii, quality, simhash

NAMES = [
    "__row", "__fp", "fp", "row", "doc", "first", "component", "__flag", "flag", "__bucket", "bucket", "__key", "key", "__runs", "__d", "__spans", "spans",
    "mark", "id", "kind", "value", "__found", "found", "__score", "score", "lang_pred", "lines_removed", "n_replaced", "replaced", "a.b", "`q`", "gone", "text2",
]


@pytest.fixture(scope="module")
def docs(spark):
    from numerale.llm.common import quoted

    texts = ["Mail to ann@example.com about the plan, please.", "Mail to ann@example.com about the plan, please.", None, "", "Ein Text, der für sich steht."]
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{quoted(n)} string" for n in NAMES)
    return spark.createDataFrame([(k, t, "de", 0, *(f"{n}{k}" for n in NAMES)) for k, t in enumerate(texts)], schema)


def operators(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    return {
        "line_dedup": lambda d: line_dedup.remove_repeated_lines(d),
        "simhash": lambda d: simhash.keep_one(d, shingle=4, max_bits=4),
        "pii": lambda d: pii.pseudonymized(d, b"key"),
        "language": lambda d: language.identified(d, language.learn(table)),
        "quality": lambda d: quality.scored(d, quality.learn(table, labels)),
        "decontaminate": lambda d: decontaminate.keep_clean(d, spark.createDataFrame([(1, "some other words entirely, not in any text")], "item_id long, text string")),
    }


@pytest.mark.parametrize("name", ["line_dedup", "simhash", "pii", "language", "quality", "decontaminate"])
def test_columns_stay(spark, sf, docs, name):
    out = operators(spark, sf)[name](docs)
    assert out.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert rows
    for r in rows:
        assert list(r)[4 : len(docs.columns)] == [f"{n}{r.doc_id}" for n in NAMES]


def test_stages_return_the_columns(spark, sf, docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and all(list(r)[4:] == [f"{n}{r.doc_id}" for n in NAMES] for r in out.collect())
