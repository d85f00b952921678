"""Each query or operator against a plain version of it on a small table."""

import base64
import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import decontam, html_text, near_dup, packing, quality, secrets, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size=5):
    w = WORD.findall(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def classes(texts, threshold=0.8):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, sf, documents):
    got = {r.doc_id: r.class_id for r in near_dup.op2_near_duplicates(spark, sf).collect()}
    assert got == classes(documents)
    assert len(set(got.values())) < len(got)


def test_near_duplicates_odd(odd, empty):
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(odd).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    assert near_dup.near_duplicate_classes(empty).count() == 0


def test_chain_of_edits_is_one_class(spark):
    """Ends below the threshold, neighbours above it: the class is the connected part."""
    words = [f"a{i}" for i in range(100)]
    chain = []
    for k in range(8):
        chain.append((k, " ".join(words)))
        words[10 * k + 5] = f"b{k}"
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert got == classes(dict(chain)) and set(got.values()) == {0}


def test_near_copies_that_repeat_a_part_unequally_often(spark):
    docs = {}
    for k in range(12):
        words = [f"w{k}x{i}" for i in range(330)]
        changed = [*words[:104] * 50, *words[104:300], *(f"v{k}x{i}" for i in range(30))]
        docs |= {2 * k: " ".join(words), 2 * k + 1: " ".join(changed)}
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == classes(docs) == {i: i - i % 2 for i in docs}


def test_null_and_repeated_ids(spark, sf):
    """Every row gets a class by its text, and of each class one row stays; leaks are told by row."""
    import corpus_pipeline

    a, near, other = (" ".join(f"{c}{i}" for i in range(n)) + end for c, n, end in (("w", 99, " w99"), ("w", 99, " end"), ("v", 40, "")))
    [(item,)] = duckdb.connect().sql(f"select text from '{sf}/benchmark.parquet' order by item_id limit 1").fetchall()
    rows = [(7, a), (7, a), (7, other), (None, near), (None, "only here is this text"), (3, near), (3, ""), (None, item), (9, item), (9, "nothing")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    got = collections.Counter((r.doc_id, r.class_id, r.n_shingles) for r in near_dup.near_duplicate_classes(df).collect())
    n = len(shingle_set(item))
    assert got == collections.Counter([(7, 3, 96)] * 2 + [(7, 7, 36), (None, 3, 96), (None, None, 1), (3, 3, 96), (3, 3, 0), (None, 9, n), (9, 9, n), (9, 9, 1)])
    kept = corpus_pipeline.near_duplicates(spark, df, sf)
    assert kept.columns == df.columns
    assert {tuple(r) for r in kept.collect()} == {(i, t, "x") for i, t in (rows[2], rows[4], rows[5], rows[6], rows[8], rows[9])} and kept.count() == 6
    clean = corpus_pipeline.decontaminated(spark, df, sf).collect()
    assert collections.Counter(tuple(r) for r in clean) == collections.Counter((i, t, "x") for i, t in rows if t != item)


def base_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(k == x for _, x, _ in found) for k in range(3)], hashlib.sha256(said.encode()).hexdigest(), said


def test_secrets(spark, sf, documents):
    got = secrets.op1_secret_scan(spark, sf).collect()
    assert len(got) == len(documents)
    for r in got:
        n, digest, said = base_secrets(documents[r.doc_id])
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (n, digest)
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_secrets_added_by_novelty(spark, odd, empty):
    rows = [(1, "authorization header value Zx9Qw7LkP2mVb8Rt5YcN1hGd"), (2, "authorization of theInternalUserName1 user_name user_name user_name"), (3, "password: short1"), (4, 'API_KEY = "AKIA' + "A1" * 10 + '"')]
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == "novel:27:51" and got[1].n_novel == 1
    assert got[3].spans == "" and (got[4].n_assign, got[4].n_access) == (1, 1)
    assert {r.doc_id: r.spans for r in secrets.secret_spans(odd).collect()} == {i: "" for i in range(8)}
    assert secrets.secret_spans(empty).count() == 0
    assert secrets.redact("a token = abcdefabcdef0123456789 b", secrets.Novelty()) == "a [REDACTED] b"


def brute_quality(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = collections.Counter(windows)
    inside = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)


def test_quality(spark, sf, documents):
    got = quality.op9_quality_rules(spark, sf).collect()
    assert len(got) == len(documents)
    for r in got:
        assert tuple(r)[1:7] == brute_quality(documents[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    good = dict(duckdb.connect().sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    kept = collections.Counter((good[r.doc_id], r.kept) for r in got if r.doc_id in good and not r.base_failed)
    assert kept[1, True] >= 0.99 * (kept[1, True] + kept[1, False])
    assert kept[0, False] > kept[0, True]


def test_quality_odd(odd, empty):
    got = {r.doc_id: r for r in quality.quality_verdict(odd).collect()}
    assert all(got[i].base_failed and not got[i].kept for i in (0, 1, 2, 3, 4, 7))
    assert got[6].n_words == 30_000 and got[7].n_words == 3 and got[0].word_chars == 0
    assert quality.quality_verdict(empty).count() == 0
    lazy = {r.doc_id: (r.n_words, r.kept) for r in quality.quality_verdict(odd, whole=False).collect()}
    assert lazy == {i: (r.n_words, r.kept) for i, r in got.items()}


def test_quality_order_is_by_rejection_per_cost(spark):
    rows = [(i, "word " * 30) for i in range(50)]
    counted = quality.quality_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert quality.order_rules(counted, {"never": "n_words < 0", "always": "n_words > 0"})[0] == "always"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_file())
    t.encode_special_tokens = True
    return t


def test_encoder(tokenizer, documents):
    texts = [*documents.values(), "a  b", " a ", "x\n y", "", " ", "  a", "a b", "<|endoftext|> it's  \n\n 12 ab12", "\nx\n", "a\tb c\t", "don't we'll\n12 34,5 \u0416\u0444 naïve", "x\u00a0y z\u00a0"]
    encode = tokens.Encoder(tokens.tokenizer_file())
    for _ in range(2):
        for t, ids in zip(texts, encode(texts), strict=True):
            assert list(memoryview(ids).cast("I")) == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_counts(spark, sf, documents, tokenizer, empty, odd):
    lengths = sorted(len(tokenizer.encode(t, add_special_tokens=False).ids) for t in documents.values())
    got = tokens.op8_token_counts(spark, sf).collect()
    assert sorted(r.context_limit for r in got) == sorted(set(lengths))
    for r in got:
        within = [n for n in lengths if n <= r.context_limit]
        assert (r.n_docs, r.docs_within, r.docs_over) == (lengths.count(r.context_limit), len(within), len(lengths) - len(within))
        assert (r.tokens_within, r.tokens_over) == (sum(within), sum(lengths) - sum(within))
        assert r.tokens_truncated == sum(min(n, r.context_limit) for n in lengths)
    assert tokens.length_histogram(tokens.token_lengths(empty)).count() == 0
    assert tokens.token_lengths(odd).where("doc_id < 2").agg({"n_tokens": "sum"}).first()[0] == 0


def test_packing(spark, sf, documents, tokenizer, odd, empty):
    got = packing.op6_best_fit_packing(spark, sf).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == documents.keys()
    for doc_id, text in documents.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for k, r in enumerate(pieces):
            part = ids[at : at + r.length]
            assert r.start == at and r.length == len(part) and (r.length == 1024 or k == 0)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // 1024) + 1
    assert packing.pack(packing.token_pieces(odd)).where("doc_id in (0, 1)").select("length").distinct().collect()[0].length == 1
    assert packing.pack(packing.token_pieces(empty)).count() == 0


def test_packing_over_many_islands(spark):
    pieces = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + pmod(id * 7919, 1023) as length", "id as ids_crc32")
    got = packing.pack(pieces, group=1000).collect()
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert len(got) == 3000 and max(fill.values()) <= 1024
    assert len(fill) <= 1.02 * sum(fill.values()) / 1024 + 1


def test_packing_of_repeated_and_null_ids(spark):
    """One id on most rows, and few rows to a group: no sequence is filled twice."""
    pieces = spark.range(6000).selectExpr("if(id < 4000, null, id) as doc_id", "0 as piece", "0L as start", "200 + pmod(id * 7919, 600) as length", "7L as ids_crc32", "'x' as u")
    got = packing.pack(pieces, group=300).collect()
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 6000 and {r.u for r in got} == {"x"}
    for x in rows.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 1024


def test_genetic_steps_keep_all_items_and_improve_best_fit():
    rng = np.random.default_rng(4)
    fewer = 0
    for seed in range(5):
        sizes = rng.integers(250, 520, 300).tolist()
        best, plain = packing.evolve(sizes, 1024, seed), packing.best_fit_decreasing(sizes, 1024)
        assert sorted(i for b in best.bins for i in b) == list(range(300))
        assert all(sum(sizes[i] for i in b) <= 1024 for b in best.bins)
        assert packing.least_bins(sizes, 1024) <= len(best.bins) <= len(plain.bins)
        fewer += len(best.bins) < len(plain.bins)
    assert fewer


def test_least_bins():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n = int(rng.integers(1, 7))
        sizes = rng.integers(1, 11, n).tolist()
        fits = next(k for k in range(1, n + 1) if any(max(np.bincount(x, sizes, k)) <= 10 for x in np.ndindex(*[k] * n)))
        assert packing.least_bins(sizes, 10) <= fits


def test_warc(spark, sf):
    pages = duckdb.connect().sql(f"select page_id, coalesce(html, '') from '{sf}/pages.parquet'").fetchall()
    last = {}
    for i, h in pages:
        last[h] = max(i, last.get(h, i))
    got = {r.page_id: r for r in warc.op10_warc(spark, sf).collect()}
    assert len(got) == len(pages)
    for i, h in pages:
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(h.encode()), digest)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if last[h] == i else ("revisit", last[h]))
        assert got[i].verified


def test_warc_odd_pages(spark):
    rows = [(1, None, None, "a"), (2, "u\r\nX: y", "", "b"), (3, "u", "é" * 200_000, "c"), (4, "u", "é" * 200_000, "d"), (5, "u", "WARC/1.1\r\n\r\nx", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")
    chunks = warc.write_archive(pages, chunk=1000)
    got = {r.page_id: tuple(r)[1:] for r in warc.read_archive(chunks).collect()}
    assert got[1][2:] == ("revisit", 2, True) and got[3][2:] == ("revisit", 4, True) and got[4][0] == 400_000
    assert got[5][2:] == ("response", None, True) and max(len(r.data) for r in chunks.collect()) <= 1000
    joined = b"".join(bytes(r.data) for r in chunks.where(f"record_id = '{warc.record_urn(5, 5)}'").orderBy("chunk_no").collect())
    assert joined.startswith(b"WARC/1.1\r\nWARC-Type: response") and joined.endswith(b"\r\n\r\nWARC/1.1\r\n\r\nx\r\n\r\n")
    head, http, rest = joined.split(b"\r\n\r\n", 2)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert int(fields["Content-Length"]) == len(http) + 4 + len(rest) - 4 and fields.keys() >= {"WARC-Date", "WARC-Record-ID", "Content-Type"}
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0
    assert all(r.record_type == "response" for r in warc.read_archive(warc.write_archive(pages, least=10_000_000)).collect())


def test_warc_repeated_and_null_page_ids(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "u", "other"), (2, "v", "same"), (None, "w", "other"), (None, "w", None), (None, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.verified) for r in warc.read_archive(warc.write_archive(pages)).collect())
    want = [(1, 4, "revisit", 2, True)] * 2 + [(1, 5, "response", None, True), (2, 4, "response", None, True), (None, 5, "revisit", 1, True), (None, 0, "response", None, True), (None, 0, "revisit", None, True)]
    assert got == collections.Counter(want)


def article(page):
    """The given pages mark their text with article; a direct reading of that."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in parts)
    return "\n\n".join(b for b in blocks if b)


def test_html(spark, sf):
    pages = dict(duckdb.connect().sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall())
    got = html_text.op5_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a></header>
<ul class="main-menu"><li><a>One</a><li><a>Two</a></ul><div class="cookie-notice">We use cookies on this site, please agree to them now.</div>
<div id="content"><h1>The  head</h1><p>First paragraph of the story with quite some words in it &amp; more.</p>
<div class=ad>Buy this now, it is cheap</div><form><p>Your mail <input></form><p>Second one,<br>also with a number of words.<script>var a="<p>no</p>"</script></div>
<div id="comments"><p>I liked the story very much, said a reader of the page.</p></div><aside><p>Other stories that you may like to read.</p></aside>
<footer>All rights reserved by them</footer></body></html>"""


def test_html_marked_wrappers_and_comments(spark):
    story = "<p>The story of the day is told here in quite some words.</p><p>It has a second part too.</p>"
    want = "The story of the day is told here in quite some words.\n\nIt has a second part too."
    side = '<div class="sidebar"><p>Other news.</p></div><ul class="menu">' + "<li><a>One more place to go to</a></li>" * 9 + "</ul>"
    pages = [f'<body><a>Home</a><div class="{c}"><div>{story}</div>{side}</div>' for c in ("content has-sidebar", "layout no-sidebar", "page search-results", "share wrapper")]
    pages += [f"<body><form action=x>{story}{side}</form>"]
    pages += [f'<body><article>{story}</article><div id="comments"><article class="comment-body"><p>I liked it a lot, as did all of my many friends and family.</p></article><article><p>So did I, said another of them.</p></article></div>']
    pages += [f'<body><div>{story}</div><div id="comments">' + "<p>I liked it a lot, as did all of my friends.</p>" * 5 + "</div>"]
    rows = [(k, "u", x) for k, x in enumerate(pages)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), {}).collect()}
    assert {k: t.removeprefix("Home").strip() for k, t in got.items()} == {k: want for k in range(len(pages))}


ROWS = "".join(f"<tr><td>k{k}</td><td>{k * 7}</td></tr>" for k in range(40))
STORY = " ".join(f"word{k}" for k in range(60))
CELLS = "\n\n".join(f"k{k}\n\n{k * 7}" for k in range(40))
LINKS = "<ul>" + "<li><a href=x>More</a></li>" * 9 + "</ul>"


@pytest.mark.parametrize(("body", "want"), [
    (f"<div><p>{STORY}</p><table>{ROWS}</table></div>", f"{STORY}\n\n{CELLS}"),
    (f"<div><table><tbody>{ROWS}</tbody></table><p>{STORY}</p></div>", f"{CELLS}\n\n{STORY}"),
    (f"<div><p>{STORY}</p><table>{ROWS}</table><p>The end of it.</p></div>", f"{STORY}\n\n{CELLS}\n\nThe end of it."),
    (f"<div><p>{STORY}</p><dl><dt>a<dd>b<dt>c<dd>d</dl></div>", f"{STORY}\n\na\n\nb\n\nc\n\nd"),
    (f"<div><p>{STORY}</p><div class=ad>Buy this</div><ol><li>a<li>b</ol></div>", f"{STORY}\n\na\n\nb"),
    (f"<div><div><p>{STORY}</p></div><ul><li>x</ul></div>", f"{STORY}\n\nx"),
    (f"<table>{ROWS}<tr><td>{STORY}</td></tr></table>", f"{CELLS}\n\n{STORY}"),
    (f"<div><p>{STORY}</p>{LINKS}</div>", STORY),
    (f"<div>{LINKS}<p>{STORY}</p></div><ul class=menu><li>x</ul>", STORY),
    (f"<table><tr><td>{LINKS}</td><td><div><p>{STORY}</p><table>{ROWS}</table></div></td></tr></table>", f"{STORY}\n\n{CELLS}"),
    ("<div>" * 2000 + f"<p>{STORY}</p><table>{ROWS}</table>", f"{STORY}\n\n{CELLS}"),
])
def test_html_keeps_tables_and_lists(weights, body, want):
    """Short cells and items, whose tags cost more than their words gain, go with the text they touch; lists of links do not."""
    assert html_text.main_text(f"<html><body>{body}</body></html>", weights) == want


@pytest.fixture(scope="module")
def weights(spark, sf):
    return html_text.fit_weights(spark.read.parquet(f"{sf}/pages.parquet"))


def test_html_soft_words(spark):
    """related-work and social-science are topics, related-posts and social a part of the page."""
    story = "<p>The story of the day is told here in quite some words.</p>"
    page = f'<body><div>{story}<div class="related-work"><p>Others found the same thing in the year before.</p></div><section class="social-science"><p>It is a matter of the social sciences too.</p></section><div class="related-posts"><p>Read this one.</p></div><div class="social"><p>Follow us now.</p></div></div>'
    got = html_text.extract_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), {}).first()
    assert got.text == "The story of the day is told here in quite some words.\n\nOthers found the same thing in the year before.\n\nIt is a matter of the social sciences too."


def test_html_without_labels(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "<p>", "x"), (4, "u", "plain <b>words", "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got[1] == "The head\n\nFirst paragraph of the story with quite some words in it & more.\n\nSecond one, also with a number of words."
    assert (got[2], got[3], got[4]) == ("", "", "plain words")
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_benchmark_leaks(spark, documents, odd, empty):
    """Items of the larger table in its documents, whole and paraphrased, against a search of all places."""
    from ledgerscope.llm import decontam

    con = duckdb.connect()
    docs = dict(con.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    items = dict(con.sql("select item_id, text from '/root/testdata/sf0.01/benchmark.parquet'").fetchall())
    words = items[3].split()
    docs[5000] = documents[0] + " " + " ".join(w for k, w in enumerate(words) if k % 9 != 4) + " " + documents[1]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([*items.items(), (900, None), (901, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.benchmark_leaks(df, bench).collect()}
    assert got.keys() == {(d, i) for d, t in docs.items() for i, x in items.items() if x in t} | {(5000, 3)}
    assert got[5000, 3].covered < 1 and min(r.covered for k, r in got.items() if k[0] < 5000) == 1
    assert decontam.benchmark_leaks(odd, bench).count() == 0
    assert decontam.benchmark_leaks(empty, bench).count() == 0
    assert decontam.benchmark_leaks(odd, bench.limit(0)).count() == 0


def test_benchmark_leaks_of_common_words(spark, documents):
    """A verbatim item in a third of the rows, one with words replaced, and items in a table of few passages."""
    items = {3: " ".join(f"item{k}" for k in range(24)), 4: "one more thing that nobody ever said before noon"}
    words = items[3].split()
    shy = " ".join("other" if k % 6 == 4 else x for k, x in enumerate(words))
    apart = " ".join(x + " well" * (k % 2) for k, x in enumerate(words))
    docs = {i: " ".join(t.split()[:150]) + (" " + items[3] + " end" if i % 3 == 0 else "") for i, t in documents.items() if i < 150}
    docs |= {1000: f"so {shy} it is", 1001: f"so {apart} it is"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.benchmark_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench).collect()}
    assert got.keys() == {(i, 3) for i in docs if i % 3 == 0 or i >= 1000}
    assert got[0, 3].covered == 1 and got[1000, 3].covered == 20 / 24 and got[1001, 3].covered == 1
    few = [(0, f"a text with {items[4]} in it"), (1, "nothing"), (2, items[3]), (3, f"{items[3]} {items[4]}")]
    got = {(r.doc_id, r.item_id) for r in decontam.benchmark_leaks(spark.createDataFrame(few, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 4), (2, 3), (3, 3), (3, 4)}


def test_common_subsequence():
    from ledgerscope.llm.decontam import common_subsequence, has_run

    assert common_subsequence([1, 2, 3, 4, 2], [2, 9, 3, 2, 4]) == 3
    assert common_subsequence([], [1]) == 0 and has_run([2, 3], [1, 2, 2, 3]) and not has_run([3, 2], [2, 3])


def test_bounds_of_common_subsequences():
    rng = np.random.default_rng(5)
    raw = [" ".join(f"w{k}" for k in rng.integers(0, 60, n)).encode() for n in (1, 7, 40, 63, 64, 65, 130)]
    items = decontam.Items(list(range(len(raw))), raw, np.ones(decontam.BUCKETS, np.float32), np.ones((decontam.BUCKETS, 2), np.float32))
    words = decontam.words_of([" ".join(f"w{k}" for k in rng.integers(0, 90, 400)).encode()]).hash
    lo = rng.integers(0, 250, 40)
    hi = lo + rng.integers(1, 150, 40)
    item = rng.integers(0, len(raw), 40)
    most = items.bounds(item, (words % np.uint64(decontam.SLOTS)).astype(np.int64), lo, hi)
    for k in range(40):
        exact = decontam.common_subsequence(items.words[item[k]], words[lo[k] : hi[k]].tolist())
        assert exact <= most[k] <= len(items.words[item[k]])


def test_group_sums():
    rng = np.random.default_rng(6)
    table = np.vstack([rng.standard_normal((50, 3)), np.zeros((1, 3))])
    index = rng.integers(0, 50, 200)
    starts = np.array([0, 1, 9, 17, 18, 100, 199])
    want = [table[x].sum(0) for x in np.split(index, starts[1:])]
    assert np.allclose(decontam.group_sums(table, index, starts), want)


def test_language_model(spark, sf, documents, odd, empty):
    import math

    from ledgerscope.llm import lm_score

    toks = {i: [*t.encode().lower().split(), b""] for i, t in documents.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in documents}
    counts = collections.Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = lm_score.op7_lm_scores(spark, sf).collect()
    assert len(got) == len(documents)
    for r in got:
        ws = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), n)
        assert r.n_known == sum(w in counts for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    small = {r.doc_id: r for r in lm_score.lm_scores(odd).collect()}
    assert small[0].n_tokens == small[1].n_tokens == small[2].n_tokens == 1
    assert lm_score.lm_scores(empty).count() == 0


def test_language_model_does_not_depend_on_blocks(spark, sf):
    """Blocks, and so the number of tasks, change nothing; nor does a row's id beside who learns."""
    import math

    from ledgerscope.llm import lm_score

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = ({r.doc_id: r for r in lm_score.lm_scores(docs, block_bytes=b).collect()} for b in (16 << 20, 1 << 14))
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert r[:5] == many[k][:5] and math.isclose(r.base_score, many[k].base_score, rel_tol=1e-9)
        assert math.isclose(r.score, many[k].score, rel_tol=1e-6) and math.isclose(r.bits_per_byte, many[k].bits_per_byte, rel_tol=1e-6)
    nameless = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2").withColumn("doc_id", F.lit(None).cast("long"))
    got = sorted(r.score for r in lm_score.lm_scores(nameless, block_bytes=1 << 14).collect())
    assert len(got) == nameless.count() and all(not math.isnan(x) and x < 0 for x in got)


def test_spelling_is_a_distribution():
    """Over all bytes, next-byte probabilities add up to one."""
    import numpy as np

    from ledgerscope.llm import lm_score

    words = [b"abc", b"abd", b"bcd", b"xyz"] * 5
    where, bit, _, _ = lm_score.spelled(words)
    counts = np.bincount((2 * where + bit).ravel(), minlength=2 * lm_score.SLOTS).reshape(-1, 2)
    model = lm_score.Spelling(counts).fit(words)
    total = 0.0
    for b in range(256):
        where, bit, which, word = lm_score.spelled([bytes([b])])
        x, gate = model.inputs(where[:, :8], bit[:8], which[:8], own=0)
        z = (model.weights[gate] * x.T).sum(1)
        total += float(np.prod(lm_score.squash(np.where(bit[:8] == 1, z, -z))))
    assert abs(total - 1) < 1e-6


def test_pipeline(spark, sf, documents):
    """run() against plain versions of the first four stages, and the packed ids of what they keep."""
    import corpus_pipeline

    good = {r.doc_id: r.kept for r in quality.op9_quality_rules(spark, sf).collect()}
    kept = {i: t for i, t in documents.items() if good[i]}
    group = classes(kept)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    items = [x for (x,) in duckdb.connect().sql(f"select text from '{sf}/benchmark.parquet'").fetchall()]
    kept = {i: t for i, t in kept.items() if not any(x in t for x in items)}
    finder = secrets.Novelty()
    kept = {i: secrets.redact(t, finder) for i, t in kept.items()}
    encode = tokens.Encoder(tokens.tokenizer_file())
    want = {i: len(encode([t])[0]) // 4 + 1 for i, t in kept.items()}
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert got == want and 0 < len(got) < len(documents)


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        a = set(rng.integers(0, 1 << 62, n).tolist())
        b = set(list(a)[: n // 2]) | set(rng.integers(0, 1 << 62, n // 3 + 1).tolist())
        doc = np.repeat([0, 1], [len(a), len(b)])
        x, y = near_dup.parity_sketch(doc, np.array([*a, *b], np.uint64), 2)
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)
        assert (x == y).all() == (len(a ^ b) == 0)


def test_quality_stage_keeps_rows_and_columns(spark, odd, empty):
    """Columns that clash with the verdict's, and a null or repeated doc_id, pass through unchanged."""
    import corpus_pipeline

    more = odd.union(odd.where("doc_id = 6")).union(odd.where("doc_id = 6").withColumn("doc_id", corpus_pipeline.F.lit(None).cast("long")))
    got = corpus_pipeline.quality(spark, more, "")
    assert got.columns == odd.columns
    rows = got.select("doc_id", "kept", corpus_pipeline.F.length("text")).collect()
    assert sorted((r[0] is None, r[0] or 0) for r in rows) == [(False, 6), (False, 6), (True, 0)]
    assert all(r[1] == "x" and r[2] > 200_000 for r in rows)
    assert corpus_pipeline.quality(spark, empty, "").collect() == []


def test_later_stages_keep_odd_rows(spark, sf, odd, empty):
    """Null texts and ids, repeated rows and clashing columns, in every stage after the first; empty tables."""
    import corpus_pipeline

    F = corpus_pipeline.F
    more = odd.union(odd.where("doc_id in (4, 7)")).union(odd.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    count = lambda df: collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    for stage in (corpus_pipeline.decontaminated, corpus_pipeline.secrets):
        got = stage(spark, more, sf)
        assert got.columns == odd.columns and count(got) == count(more)
        assert stage(spark, empty, sf).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, more, sf)
    assert kept.columns == odd.columns and collections.Counter(r.text for r in kept.collect()) == collections.Counter(dict.fromkeys([r.text for r in odd.where("doc_id <> 5").collect()], 1))
    assert corpus_pipeline.near_duplicates(spark, empty, sf).count() == 0
    packed = corpus_pipeline.packing(spark, more, sf).where("piece = 0")
    assert collections.Counter(r.doc_id for r in packed.collect()) == collections.Counter(r.doc_id for r in more.collect())
    assert corpus_pipeline.packing(spark, empty, sf).count() == 0
