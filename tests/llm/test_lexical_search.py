"""Against all scores: ties, hot copies, repeated ids and items, several shards and blocks, odd texts."""

import math
import random
import re
from collections import Counter

import pytest

from numerale.llm import lexical_search
from numerale.llm.lexical_search import ranked_search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, tf) for i, tf in held if tf]
    total, length = len(held), sum(sum(tf.values()) for _, tf in held)
    df = Counter(w for _, tf in held for w in tf)
    weight = {w: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, tf in held:
            m = 25 + 75 * sum(tf.values()) * total // length
            score = sum(weight[w] * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in terms(text) if w in tf)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def cases(odd):
    rng = random.Random(8)
    words = ["".join(rng.choice("aBcdé0Ω") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    text = lambda n: "".join(words[min(int(rng.expovariate(0.05)), 119)] + rng.choice([" ", "\n", "_", "-x ", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(300)]
    hot = text(30)
    docs += [(500 + i, hot) for i in range(150)] + [(None, hot)] * 3 + [(7, hot), (7, text(9)), (900, None), (901, ""), (902, " \n_-"), (903, "word " * 9000)]
    docs += [(r.doc_id, r.text) for r in odd.collect()]
    items = [(k, text(rng.choice([1, 3, 20]))) for k in range(30)]
    items += [(40, hot), (41, hot), (41, hot), (None, words[0]), (50, None), (51, ""), (52, "--"), (53, "nowhere"), (54, "word the word")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_docs": 23, "block_bytes": 900}, {"shard_postings": 300}])
def test_against_all_scores(spark, cases, options):
    docs, items = cases
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, q long, `a.b` string").repartition(5)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, q long")
    got = ranked_search(frame, asked, **options).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(docs, items)


def test_nothing_to_search(spark, cases, none):
    asked = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert ranked_search(none, asked).collect() == []
    assert ranked_search(spark.createDataFrame([(1, None)], "doc_id long, text string"), asked).collect() == []
    assert ranked_search(spark.createDataFrame([(1, "word")], "doc_id long, text string"), asked.where("false")).collect() == []


def test_pieces_cut_between_terms(monkeypatch):
    text = ("Ab1 " * 50 + "x" * 90 + "-é_ ").encode()
    whole = [w for part in terms_of(text) for w in part]
    monkeypatch.setattr(lexical_search, "PIECE", 7)
    assert [w for part in terms_of(text) for w in part] == whole == [t.encode() for t in terms(text.decode())]


def test_frequent_terms_open_few_documents():
    rng = random.Random(2)
    import numpy as np

    n = 20_000
    docs = np.sort(rng.sample(range(n), n // 2))
    shard = lexical_search.Shard.__new__(lexical_search.Shard)
    lists = [np.arange(n), docs]
    shard.ids, shard.n, shard.term = np.arange(n), n, np.array([0, 1])
    shard.end = np.cumsum([len(x) for x in lists])
    shard.start = shard.end - [len(x) for x in lists]
    shard.doc = np.concatenate(lists)
    shard.key = np.repeat([0, 1], [len(x) for x in lists]) * n + shard.doc
    shard.impact = np.array([rng.randrange(1, 10**6) for _ in shard.doc])
    shard.table = [np.arange(len(shard.doc))]
    while 2 << len(shard.table) <= n * 2:
        last, half = shard.table[-1], 1 << (len(shard.table) - 1)
        a, b = last[:-half], last[half:]
        shard.table.append(np.where(shard.impact[a] >= shard.impact[b], a, b))
    opened = []

    class Counted(lexical_search.Best):
        def add(self, score, id_):
            opened.append(id_)
            super().add(score, id_)

    best = Counted(10)
    lexical_search.search(shard, [{0: 1, 1: 2}], [best])
    scores = np.zeros(n, np.int64)
    scores += shard.impact[:n]
    scores[docs] += 2 * shard.impact[n:]
    assert sorted((s for s, _ in best.heap), reverse=True) == np.sort(scores)[::-1][:10].tolist()
    assert len(opened) < 200
