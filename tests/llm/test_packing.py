"""Pieces against the tokenizer itself, and the packing against its contract."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from numerale.llm.packing import SIZE, Tokens, pack, pack_histogram, slots


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tokens():
    return Tokens("byte_bpe_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeXYZ  \n\t\r'.,!1234é漢  　'st<|endoftext|>")), max_size=60))
def test_same_ids(reference, tokens, text):
    assert np.frombuffer(tokens(text), "<u4").tolist() == reference(text)


def test_added_tokens(spark, tokens):
    as_contract = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain = lambda text: as_contract.encode(text, add_special_tokens=False).ids
    mark = "<|endoftext|>"
    texts = [mark, f"a {mark} b", f"{mark}{mark} x", f"one two{mark}", f"  {mark}\n c  d", "<|endoftext| >", f"<{mark}>", f"{mark} " * 3000]
    for text in texts:
        assert np.frombuffer(tokens(text), "<u4").tolist() == plain(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(pack(docs).collect(), list(enumerate(texts)), plain)


def check(rows, texts, reference):
    expected = defaultdict(list)
    for i, t in texts:
        expected[i].append([*reference(t or ""), 1])
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert got.keys() == expected.keys()
    for i, all_ids in expected.items():
        want = []
        for ids in all_ids:
            for a in range(0, len(ids), SIZE):
                piece = np.array(ids[a : a + SIZE], "<u4")
                want.append((a, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got[i]) == sorted(want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= SIZE
    return places


def test_odd_rows(odd, none, reference):
    rows = pack(odd).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], reference)
    assert pack(none).count() == 0


def test_documents(spark, tiny, reference):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    places = check(pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], reference)
    used = sum(n for spans in places.values() for _, n in spans)
    assert used / (len(places) * SIZE) > 0.97


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 50), max_size=20))
def test_histogram(counts):
    patterns = pack_histogram(counts, 64)
    held = defaultdict(int)
    for pattern, n in patterns:
        assert n > 0 and sum(pattern) <= 64 and list(pattern) == sorted(pattern, reverse=True)
        for length in pattern:
            held[length] += n
    assert held == counts
    ranks = defaultdict(list)
    for length, a, b, *_ in slots(patterns):
        ranks[length] += range(a, b + 1)
    assert all(sorted(r) == list(range(counts[k])) for k, r in ranks.items())


def test_longest_first_into_the_emptiest():
    assert sorted(pack_histogram({6: 1, 5: 2, 3: 2, 2: 1}, 8)) == [((5, 3), 2), ((6, 2), 1)]
