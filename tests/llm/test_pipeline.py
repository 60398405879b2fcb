"""Every stage on planted cases; the registered queries."""

import random

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from numerale.llm.common import components

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def planted(spark, sf):
    """The documents, and cases planted in them: copies, benchmark passages, shared passages, clean texts."""
    rng = random.Random(11)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = [r.text for r in docs.where("lang = 'en' and n_chars > 1500").limit(3).collect()]
    words = sorted({w for t in clean for w in t.split() if w.isalpha()})
    prose = lambda n: " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 12))).capitalize() + "." for _ in range(n))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    passage = prose(9)
    rows = [(10_000 + k, prose(25)) for k in range(6)]  # clean
    rows += [(11_000, rows[0][1]), (11_001, rows[0][1].replace(rows[0][1].split()[40], "altered", 1))]
    rows += [(12_000 + k, f"{prose(8)[:-1]} {item} {prose(8)}") for k in range(2)]
    rows += [(13_000 + k, f"{prose(8)[:-1]} {passage} {prose(8)}") for k in range(3)]
    extra = spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in rows], docs.schema)
    return docs.unionByName(extra), dict(rows), passage, item


def test_stages(spark, sf, planted):
    docs, rows, passage, item = planted
    kept = {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    ids = range(10_000, 10_006)
    assert all(i in kept["quality classifier"] for i in rows)
    lines = kept["line dedup"]
    assert all(lines[i].text == rows[i] for i in ids)
    tail = passage[passage.index(".") + 2 :]
    assert tail in lines[13_000].text and all(tail not in lines[i].text and lines[i].n_chars == len(lines[i].text) for i in (13_001, 13_002))
    assert lines[11_000].text == ""
    near = kept["SimHash near-dedup"]
    assert all(near[i].text == rows[i] for i in ids) and 11_000 not in near or near[11_000].text == ""
    last = kept["benchmark decontamination"]
    assert all(i in last for i in ids) and 12_000 not in last and all(item not in r.text for r in last.values())


def test_near_copies_go(spark, planted, sf):
    docs, rows, *_ = planted
    left = {r.doc_id for r in STAGES["SimHash near-dedup"](spark, docs.where("doc_id >= 10000"), sf).collect()}
    assert {11_000, 11_001}.isdisjoint(left) and set(rows) - {11_000, 11_001} == left


def test_rows_are_decided_on_one_by_one(spark, sf, planted):
    _, rows, _, item = planted
    clean = [rows[10_000 + k] for k in range(4)]
    docs = [(None, rows[12_000]), (None, clean[0]), (7, rows[12_001]), (7, clean[1]), (8, clean[2]), (None, clean[3])]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    left = STAGES["benchmark decontamination"](spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(0, clean[0]), (7, clean[1]), (8, clean[2]), (0, clean[3])])
    # copies: without id beside an id, without ids only, of one id, and one id with two texts
    docs = [(None, clean[0]), (3, clean[0]), (None, clean[1]), (None, clean[1]), (5, clean[2]), (5, clean[2]), (5, clean[3])]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    left = STAGES["SimHash near-dedup"](spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(3, clean[0]), (0, clean[1]), (5, clean[2]), (5, clean[3])])


def test_run(spark, tiny):
    rows = corpus_pipeline.run(spark, tiny).collect()
    assert rows and rows[0].asDict().keys() >= {"doc_id", "sequence_id", "offset", "length"}


def test_registered():
    names = entry_point.queries()
    for k in range(1, 11):
        assert sum(n.startswith(f"op{k}_") for n in names) == 1
    assert "pipeline" in names and set(entry_point.oracle_sql()) <= set(names)


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 400)] + [(1000, 1001 + k) for k in range(300)] + [(5, 5), (7, 6)]
    edges += [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(90)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[top(a)] = top(b)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got.keys() == linked
    assert len({(got[v], top(v)) for v in linked}) == len({top(v) for v in linked}) == len({got[v] for v in linked})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
