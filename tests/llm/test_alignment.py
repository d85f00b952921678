"""Token alignment against a plain version over sets of ends."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerscope.llm import alignment
from ledgerscope.llm.tokens import tokenizer_file


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model")), alignment.byte_level(tokenizer_file())


def plain(libraries, docs):
    a, b, spelled = libraries
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    walked = []
    for doc, text in docs:
        ids, ids_b = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        parts, parts_b = [spelled[i] for i in ids], [piece(i) for i in ids_b]
        if not text or not b"".join(parts) == b"".join(parts_b) == (" " + text).encode():
            ids, ids_b, parts, parts_b = [], [], [], []
        ends, ends_b = np.cumsum([len(x) for x in parts]).astype(int).tolist(), np.cumsum([len(x) for x in parts_b]).astype(int).tolist()
        common, at = set(ends) & set(ends_b), dict(zip(ends_b, ids_b))
        cut = lambda ids, ends: [0, *(k for k, e in enumerate(ends, 1) if e in common)]
        part = lambda ids, ends: [",".join(map(str, ids[x:y])) for x, y in zip(cut(ids, ends), cut(ids, ends)[1:])]
        groups = [f"{x}|{y}" for x, y in zip(part(ids, ends), part(ids_b, ends_b))]
        links = [(i, at[e]) for i, e in zip(ids, ends) if e in at]
        walked.append((doc, len(ids), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids else ""))
    count = Counter(x for w in walked for x in w[4])
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return sorted(((d, na, nb, g, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), h) for d, na, nb, g, ls, h in walked), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD = ["a  b", " lead", "tail ", "  two", "a\tb", "a\nb c\nd", "x\n\ny", "\nfirst", "last\n", "mark ▁ here", "nul\x00 x", "<s> </s> <unk> <|endoftext|> <0x0A>", "é ß ½ ﬁ é", "日本語 テキスト", "👩‍👩‍👧 emoji", "a \n b", "x" * 300, "　 wide", " ", "\n", "don't we'll I'm", "12345 67,890.12 ---- ====", "́x"]


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_odd_texts(spark, libraries, odd, most):
    docs = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_a int, pairs string")
    assert found(alignment.token_alignment(df, broadcast_pairs=most)) == plain(libraries, docs)


def test_documents(spark, libraries, documents, sf):
    some = dict(list(documents.items())[:80])
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    assert found(alignment.token_alignment(df)) == plain(libraries, list(some.items()))


def test_empty_table(spark, empty):
    assert alignment.token_alignment(empty).count() == 0


def test_lanes_walk_like_whole_texts(libraries):
    side_a, side_b = alignment.sides(tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))
    texts = [" ".join(f"word{i * 7919 % 613} of{i}" for i in range(n)) for n in (2, 700, 33)]
    a = alignment.Spelled(side_a, alignment.encoder(tokenizer_file())([" " + t for t in texts]))
    b = alignment.Spelled(side_b, alignment.pieces(tokenizer_file("piece_bpe_32k.model"))(texts))
    a0, a1, b0, _ = alignment.lanes(a, b, 16)
    assert len(a0) > 20 and np.array_equal(alignment.walk(a.ends, b.ends, a0, a1, b0), alignment.walk(a.ends, b.ends, a.first, a.last, b.first))


def test_pair_counts_in_small_parts(spark):
    rows = [([i % 5, 7 + i % 3], [1, 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "pairs array<bigint>, times array<bigint>")
    want = Counter()
    for p, t in rows:
        want.update(dict(zip(p, t)))
    got = {r.pair: (r["count"], r.best) for r in alignment.pair_counts(df, 4, most=3).collect()}
    assert {p: c for p, (c, _) in got.items()} == want
    assert all(best == (c == max(d for q, d in want.items() if q % 4 == p % 4)) for p, (c, best) in got.items())
