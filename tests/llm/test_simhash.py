"""Fingerprints and components against all pairs, compared one by one."""

import random

import xxhash

from numerale.llm.simhash import bucket_keys, keep_first, near_duplicates, near_links, simhash


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    bits = [2 * sum(h >> k & 1 for h in hashes) > len(hashes) for k in range(64)]
    return sum(b << k for k, b in enumerate(bits)) if hashes else 0


def groups(values, linked):
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and linked(a, b):
                parent[top(a)] = top(b)
    return {v: top(v) for v in values}


def partition(labels):
    found = {}
    for v, label in labels.items():
        found.setdefault(label, set()).add(v)
    return {frozenset(g) for g in found.values()}


def test_fingerprint():
    for text in ["", None, "One", "one two three", "A b c d e f g h", "é É x\x0by z", "w " * 70_000]:
        assert simhash(text, 4) % (1 << 64) == plain_fingerprint(text)


def test_links_lose_no_component(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base[:12]:  # dense groups, chains, and values just too far away
        for _ in range(40):
            x = b
            for k in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6])):
                x ^= 1 << k
            values.add(x)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.fp: r.component for r in near_links(nodes).collect()}
    want = groups(signed, lambda a, b: (a ^ b) % (1 << 64) and ((a ^ b) % (1 << 64)).bit_count() <= 4)
    assert partition(got) == partition(want)


def test_same_text_same_component(odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.id, set()).add((r.fp, r.component_id))
    assert by[1] == by[2] and next(iter(by[1]))[1] == 1
    assert {c for _, c in by[3] | by[4] | by[5]} == {3} and (0, 3) in by[None]  # without words: fingerprint 0
    want = {i: simhash(t, 4) for i, t in [(6, "wörter " * 20_000), (7, "x")]}
    assert all(by[i] == {(f, i)} for i, f in want.items())


def test_one_of_a_group_stays(odd):
    kept = keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 6, 7, 8, 8, 8]


def test_empty_table(none):
    assert near_duplicates(none).count() == 0


def test_more_bits_than_segments(spark):
    try:
        bucket_keys(None, 4, 4)
    except ValueError:
        return
    raise AssertionError("accepted")
