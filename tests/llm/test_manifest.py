"""Against a tree built with lists: odd rows, fanouts, tampering in every field."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from numerale.llm.manifest import manifest, numbered, verified

FIELDS = ["doc_id", "lang", "text"]


def joined(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes, fanout):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [joined(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def way(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at // fanout * fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return out


def plain(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, joined(*(field(r[f]) for f in FIELDS)), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    top = levels_of([trees[g][-1][0] for g in names], fanout)
    out = Counter()
    for k, g in enumerate(names):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = way(trees[g], i, fanout) + way(top, k, fanout)
            out[x[1] if x[0] else None, x[2], trees[g][-1][0], top[-1][0], joined(*(s for lr in path for s in lr))] += 1
    return out


@pytest.fixture(scope="module")
def many(spark, odd):
    spread = spark.range(600).select(
        (F.col("id") % 550).alias("doc_id"),
        F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"),
        F.when(F.col("id") < 400, "de").when(F.col("id") < 590, "é").when(F.col("id") < 599, "a").alias("lang"),
    )
    copies = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text"), F.lit("de").alias("lang"))
    return spread.unionByName(copies).unionByName(odd.select("doc_id", "text", "lang")).repartition(5)


@pytest.mark.parametrize("fanout", [2, 3, 5, 16])
def test_against_lists(many, fanout):
    got = verified(manifest(many, "doc_id", "lang", FIELDS, fanout=fanout)).collect()
    assert Counter((r.id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == plain(many.collect(), fanout)
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_tampering_shows_in_any_field(odd):
    for column, value in (("text", F.lit("other")), ("doc_id", F.lit(77)), ("lang", F.lit(None).cast("string"))):
        got = verified(manifest(odd, "doc_id", "lang", FIELDS, {column: value})).collect()
        assert len(got) == odd.count() and not any(r.verified for r in got)


def test_one_row_and_none(odd, none):
    one = verified(manifest(odd.where("doc_id = 1"), "doc_id", "lang", FIELDS)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == joined()
    assert verified(manifest(none, "doc_id", "lang", FIELDS)).collect() == []


def test_numbers_without_a_single_task(spark):
    rows = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") * 7 % 5000 % 900).alias("k"), F.col("id").alias("salt"))
    got = numbered(rows, "g", ["k", "salt"], "test").collect()
    assert [(r.k, r.salt) for r in sorted(got, key=lambda r: r.pos)] == sorted((r.k, r.salt) for r in got)
    assert sorted(r.pos for r in got) == list(range(5000)) and {r["size"] for r in got} == {5000}
