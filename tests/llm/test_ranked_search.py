"""Ranked search against SQL and a plain version, and what its shared sums save."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerscope.llm import lexical
from ledgerscope.llm.queries import SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    cut = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in cut if c), sum(c.total() for _, c in cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in cut:
            m = 25 + 75 * c.total() * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def test_search_is_that_of_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(SQL["op11_ranked_search"]).fetchall()
    assert found(lexical.op11_ranked_search(spark, sf)) == sorted(((a, b, c, d) for a, b, c, d in want), key=str)


@pytest.mark.parametrize("options", [{}, {"block_terms": 4}, {"wanted_bytes": 0}])
def test_odd_rows(spark, odd, options):
    items = [(1, "one TWO one same"), (1, "text of some six words"), (2, None), (3, ""), (4, "é ß W1x1 w3x3 w3x3"), (None, "x y one")]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(None, "one of some"), (3, "one"), (3, "one"), (20, "ONE one.two_three\x00four")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rank int, score int")
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    assert found(lexical.ranked_search(docs, asked, **options)) == plain(rows, items)


def test_ties_go_by_document(spark):
    rows = [(i, "alpha beta" if i % 2 else "alpha gamma delta") for i in range(60)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(1, "beta"), (2, "alpha delta")], "item_id long, text string")
    assert found(lexical.ranked_search(docs, asked)) == plain(rows, [(1, "beta"), (2, "alpha delta")])


def test_empty_tables(spark, odd, empty):
    asked = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.ranked_search(empty, asked).count() == 0 and lexical.ranked_search(odd, asked.limit(0)).count() == 0


def test_shared_sums_are_the_items_sums_with_fewer_additions():
    rng = np.random.default_rng(1)
    topics = [rng.choice(300, 12, replace=False) for _ in range(6)]
    items = [{int(t): int(rng.integers(1, 3)) for t in np.concatenate([topics[i % 6], rng.choice(300, 5)])} for i in range(60)]
    graph = lexical.SharedSums(items, 300)
    values = rng.integers(0, 1 << 30, (300, 7))
    term, doc = np.nonzero(values)
    want = [[sum(k * int(values[t, d]) for t, k in item.items()) for d in range(7)] for item in items]
    assert graph(term, doc, values[term, doc], 7).tolist() == want
    assert graph.shared > 10 and sum(len(x) for x in graph.levels) < 0.8 * graph.additions_apart


def test_long_texts_are_cut_between_terms():
    text = b"ab " * 1000 + b"x" * 500 + b" cd"
    assert [w for part in lexical.split(text, piece=64) for w in part] == text.split()
