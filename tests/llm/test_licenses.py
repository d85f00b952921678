"""Licence scans: base places and matching statistics against plain versions, planted and clean texts."""

import random
import re

import numpy as np
import pytest

from ledgerscope.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words(text)
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_of_documents(spark, sf, documents):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.op13_license_scan(spark, sf).collect()}
    assert got == {i: base(t) for i, t in documents.items()} and any(v[1] for v in got.values())


def test_odd_rows(spark, odd, empty):
    extra = [(None, "MIT License"), (3, "cc-by"), (3, "cc-by"), (9, "the Apache\x00license MIT LICENSE mit license, GNU General\nPublic License"), (10, "gnu general public"), (11, "éMIT license")]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + extra
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, labels string")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(df).collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=str)
    assert licenses.license_scan(empty).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    notices = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(6)]
    text = [rng.randrange(5) for _ in range(200)]
    auto = licenses.SuffixAutomaton(notices)
    for i, (length, state) in enumerate(auto.statistics(text)):
        run = lambda n: text[i - n + 1 : i + 1]  # noqa: E731, B023
        ends = lambda n: {(k, e) for k, w in enumerate(notices) for e in range(n - 1, len(w)) if w[e - n + 1 : e + 1] == run(n)}
        want = max((n for n in range(i + 2) if n == 0 or ends(n)), default=0)
        assert length == want and (not length or auto.ends[state] == ends(length))


def test_matches_are_those_of_all_words():
    known = licenses.notices(tuple(licenses.NOTICES))
    rng = random.Random(3)
    vocabulary = [*known.number.values(), len(known.number)]
    ids, text = [], []
    for t in range(20):
        own = []
        for _ in range(rng.randrange(0, 30)):
            notice = [known.number[w] for w in rng.choice(licenses.NOTICES)[1].encode().split()]
            a = rng.randrange(len(notice))
            own += rng.choice([[rng.choice(vocabulary)], notice[a : a + rng.randrange(1, 12)]])
        ids += own
        text += [t] * len(own)
    ids, text = np.array(ids, np.int32), np.array(text)
    want = set()
    for t in range(20):
        own, first = ids[text == t].tolist(), int(np.searchsorted(text, t))
        longest = [max(n for n in range(i + 2) if n == 0 or any(own[i - n + 1 : i + 1] == w[j : j + n] for w in NUMBERS(known) for j in range(len(w) - n + 1))) for i in range(len(own))]
        for i, n in enumerate(longest):
            if n >= licenses.SHORTEST and (i + 1 == len(own) or longest[i + 1] != n + 1):
                want |= {(t, k, first + i - n + 1, j, n) for k, w in enumerate(NUMBERS(known)) for j in range(len(w) - n + 1) if own[i - n + 1 : i + 1] == w[j : j + n]}
    assert set(licenses.matches(known, ids, text)) == want


def NUMBERS(known):
    return [[known.number[w] for w in text.encode().split()] for _, text in licenses.NOTICES]


def test_notices_are_found_when_changed_and_clean_texts_are_left(spark):
    rng = random.Random(5)
    rows, want, clean = [], {}, []
    filler = lambda n: " ".join(rng.choice("the of and to a in software is it permission river stone with any table you".split()) for _ in range(n))
    for i, (label, text) in enumerate(licenses.NOTICES):
        w = text.split()
        if len(w) > 40:
            for at in range(10, len(w), 17):
                w[at] = "changed"
        rows.append((i, f"{filler(50)} {' '.join(w).title()}. {filler(30)}"))
        want[i] = label
    for i in range(100, 200):
        rows.append((i, filler(200)))
        clean.append(i)
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[i] in got[i].labels.split(",") and got[i].score >= 0.7 for i in want)
    assert all(not got[i].labels and got[i].spans == [] for i in clean)


def test_chains_cover_repeated_notices():
    once = [(0, 0, 10), (12, 11, 10), (40, 0, 22)]
    assert licenses.chained(once, 22) == [(0, 21, 20), (40, 61, 22)]
    assert licenses.chained([(0, 0, 5), (100, 5, 5)], 10) == [(0, 4, 5), (100, 104, 5)]
    assert licenses.chained([(0, 0, 6), (4, 3, 6)], 9) == [(0, 9, 9)]
