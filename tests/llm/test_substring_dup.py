"""Repeated substrings against a plain version, and the suffix array against sorting."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerscope.llm import substring_dup
from ledgerscope.llm.suffix_array import permuted_common_prefixes, suffix_array


def brute(docs, length=100):
    seen, out = set(), {}
    for doc_id in sorted(docs):
        t = (docs[doc_id] or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc_id] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_query(spark, sf, documents):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dup.op3_suffix_array_dedup(spark, sf).collect()}
    want = brute(documents)
    assert got == want and any(r[1] for r in want.values())


@pytest.mark.parametrize("shard_bytes", [substring_dup.SHARD_BYTES, 2000])
def test_edges_of_shared_passages(spark, shard_bytes):
    """One passage in many texts between different words, periodic texts, texts within texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(60)
    texts = [f"{say(rng.randint(0, 30))} {passage[rng.randint(0, 40):len(passage) - rng.randint(0, 40)]} {say(rng.randint(0, 30))}" for _ in range(60)]
    texts += ["ab" * 300, "ab" * 120, "x" * 250, "x" * 99, texts[0], texts[0][50:], "\x00" * 150 + "é" * 90, "\x00" * 130, "", None]
    docs = dict(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, h int")
    got = {r.doc_id: tuple(r)[1:5] for r in substring_dup.repeated_substrings(df, shard_bytes=shard_bytes).collect()}
    assert got == brute(docs)


def test_odd(odd, empty):
    got = {r.doc_id: tuple(r)[1:5] for r in substring_dup.repeated_substrings(odd).collect()}
    assert got == brute({r.doc_id: r.text for r in odd.collect()})
    assert substring_dup.repeated_substrings(empty).count() == 0


def test_repeated_and_null_ids(spark):
    """Of a row given twice the first stays; other texts under one doc_id are documents of their own; null comes first."""
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(150))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, a), (1, b), (2, a + b), (None, c), (None, c), (3, c), (4, "short"), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substring_dup.repeated_substrings(df).collect())
    assert got == [(0, 150, 0), (0, 150, 150), (1, 150, 0), (1, 150, 0), (1, 150, 150), (2, 300, 300), (3, 150, 150), (4, 5, 0), (4, 5, 0)]


def test_large_anchor(spark):
    """One string of 40 bytes in many texts between different and equal words: runs of its anchors are cut until they fit a shard."""
    rng = random.Random(7)
    common = "the very common phrase of forty bytes...."
    sides = ["".join(rng.choice("abcdefghij") for _ in range(90)) for _ in range(40)]
    docs = {i: f"{rng.choice(sides)}{common}{rng.choice(sides)}" for i in range(300)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in substring_dup.repeated_substrings(df, shard_bytes=3000).collect()}
    assert got == brute(docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(2, 4), min_size=1, max_size=20), min_size=1, max_size=6), st.sampled_from([2, 4096]))
def test_suffix_array(strings, buckets):
    text = np.array([x for s in strings for x in [*s, 1]] + [0])
    left = np.array([x for s in strings for x in range(len(s), -1, -1)] + [0])
    sa = suffix_array(text, buckets)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    shared = permuted_common_prefixes(text, sa, left)
    for a, b in zip(sa[:-1], sa[1:], strict=True):
        same = next(k for k in range(len(text)) if max(a, b) + k == len(text) or text[a + k] != text[b + k])
        assert shared[b] == min(same, left[b])
