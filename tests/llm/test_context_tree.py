"""Probabilities against a tree kept in a dictionary, counts against plain counting."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from numerale.llm.context_tree import END, grams, scored

DEPTH = 2


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """The same model for one process: counts by (context, bits so far)."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for context, byte in self.steps(t):
                for k, bit in self.bits(byte):
                    for d in range(DEPTH + 1):
                        self.counts[context[DEPTH - d :], k][bit] += 1
                        if d < DEPTH:
                            self.children[context[DEPTH - d :], k].add((context[DEPTH - d - 1 :], k))

    @staticmethod
    def steps(text):
        data = END * DEPTH + text + END
        return [(data[i - DEPTH : i], data[i]) for i in range(DEPTH, len(data))]

    @staticmethod
    def bits(byte):
        return [((256 | byte) >> (8 - j), byte >> (7 - j) & 1) for j in range(8)]

    def weight(self, node):
        own = kt(*self.counts[node])
        if len(node[0]) == DEPTH:
            return own
        below = sum(self.weight(c) for c in self.children[node])
        top = max(own, below)
        return top + math.log((math.exp(own - top) + math.exp(below - top)) / 2)

    def one(self, context, k, d=0):
        """Probability of a one at and below depth d, along the context."""
        node = (context[DEPTH - d :], k)
        if node not in self.counts:
            return 0.5 if d == 0 else None
        a, b = self.counts[node]
        own = (b + 0.5) / (a + b + 1)
        deeper = self.one(context, k, d + 1) if d < DEPTH else None
        if deeper is None:
            return own
        below = sum(self.weight(c) for c in self.children[node])
        stay = 1 / (1 + math.exp(below - kt(a, b)))
        return stay * own + (1 - stay) * deeper

    def score(self, text):
        total = 0.0
        for context, byte in self.steps(text):
            for k, bit in self.bits(byte):
                p = self.one(context, k)
                total += math.log10(p if bit else 1 - p)
        return total


TEXTS = [(k, t) for k, t in enumerate(["Abra cadabra", "abracadabra abra", "the cat", "", None, "zé the é", "cat the  cat\n", "new wörds"])]


@pytest.mark.parametrize("blocks", [1 << 24, 12])
def test_scores(spark, monkeypatch, blocks):
    from numerale.llm import context_tree

    monkeypatch.setattr(context_tree, "BLOCK", blocks)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    got = {r.id: r for r in scored(docs, F.col("doc_id") < 6, depth=DEPTH).collect()}
    low = {k: (t or "").encode().lower() for k, t in TEXTS}
    tree = Tree([t for k, t in low.items() if k < 6])
    words = Counter(w for k, t in low.items() if k < 6 for w in [*t.split(), b"\xff"])
    total, kinds = sum(words.values()), len(words)
    for k, t in low.items():
        r = got[k]
        assert r.score == pytest.approx(tree.score(t), rel=1e-6)
        tokens = [*t.split(), b"\xff"]
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.learned) == (len(tokens), sum(w in words for w in tokens), total, k < 6)


def test_probabilities_sum_to_one():
    tree = Tree([b"abracadabra", b"cat"])
    for context in (b"ab", b"zz", END * 2):
        total = 0.0
        for byte in range(256):
            p = 1.0
            for k, bit in Tree.bits(byte):
                one = tree.one(context, k)
                p *= one if bit else 1 - one
            total += p
        assert total == pytest.approx(1)


def test_strings_stop_at_texts():
    texts = [b"ab", b"", b"hello", b"x"]
    codes, distinct, starts = grams(texts, 4)
    keys, at = distinct[codes], 0
    for t, s in zip(texts, starts):
        assert s == at
        data = END * 4 + t + END
        for j in range(len(t) + 1):
            assert keys[at] == int.from_bytes(data[j : j + 5], "big")
            at += 1


def test_defined_cases(odd, none):
    rows = scored(odd, F.col("doc_id") != 7).collect()
    assert len(rows) == odd.count() and all(r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert len({r.score for r in rows if r.n_tokens == 1 and r.bits_per_byte == pytest.approx(-r.score * math.log2(10))}) == 1
    assert scored(none, F.lit(True)).count() == 0
    unseen = scored(odd.where("doc_id = 7"), F.lit(False)).collect()
    assert unseen[0].score == pytest.approx(16 * math.log10(0.5)) and unseen[0].train_tokens == 0


def test_contexts_beat_word_counts_on_held_out_rows(spark):
    # words differ in their first two letters only: a context shorter than a word tells nothing of the word before
    rng = random.Random(3)
    words = [a + b + "ing" for a in "bcdfghkl" for b in "aeiouy"]
    follow = {w: rng.sample(words, 2) for w in words}
    rows = []
    for k in range(400):
        text = [rng.choice(words)]
        while len(text) < 60:
            text.append(rng.choice(follow[text[-1]]))
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = scored(docs, F.col("doc_id") < 360).where("not learned").collect()
    assert len(held) == 40 and all(r.score > 0.7 * r.base_score for r in held)


def test_a_hot_row_is_spread_over_blocks(spark, monkeypatch):
    from numerale.llm import context_tree

    monkeypatch.setattr(context_tree, "BLOCK", 200)
    monkeypatch.setattr(context_tree, "PART_BYTES", 500)
    rows = [(None, "abra cadabra hot row")] * 60 + TEXTS
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    blocks = context_tree.blocks_of(docs.selectExpr("doc_id id", "true learned", "cast(coalesce(text, '') as binary) text", "monotonically_increasing_id() row"))
    assert blocks.agg(F.max("learned")).first()[0] <= 16 and blocks.agg(F.sum("learned")).first()[0] == len(rows)
    got = scored(docs, F.lit(True), depth=DEPTH).collect()
    low = [(t or "").encode().lower() for _, t in rows]
    tree = Tree(low)
    want = sorted(tree.score(t) for t in low)
    assert sorted(r.score for r in got) == pytest.approx(want, rel=1e-6)
    assert {r.train_tokens for r in got} == {sum(len(t.split()) + 1 for t in low)}


def test_bytes_come_back():
    import numpy as np

    from numerale.llm.context_tree import joined, packed, split, unpacked

    for values in ([], [5], [1, 2, 1 << 60, -3]):
        assert unpacked(packed(np.array(values, np.int64)), np.int64).tolist() == values
    for words in ([], [b"a"], [b"a", b"b\xff"]):
        assert split(joined(words)) == words
