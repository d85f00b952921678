"""Ranked lexical search of many items at once, over sums that items share."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.llm.common import lists, numbered, rows, steps, table, texts
from ledgerscope.operators.order import running_sums

#: Bytes to terms: letters and digits of ASCII in lower case, all other ASCII a space, other bytes as they are.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of text that are cut into terms at a time.
PIECE = 1 << 22
#: Bytes of accumulators that a task holds.
HELD = 1 << 25


def split(text: bytes, kind: bytes = TERMS, piece: int = PIECE) -> Iterable[list[bytes]]:
    """The terms of a text, in lists of those of about piece bytes each, so that a long text is never a list as a whole."""
    plain = text.translate(kind)
    at = 0
    while at < len(plain):
        to = plain.find(b" ", at + piece)
        to = len(plain) if to < 0 else to
        yield plain[at:to].split()
        at = to


def _count(wanted: frozenset[bytes] | None):
    def run(batches):
        for batch, raw in steps(batches):
            n, terms, times, sizes = [], [], [], []
            for text in raw:
                found: Counter = Counter()
                for part in split(text):
                    found.update(part)
                n.append(found.total())
                kept = list(found) if wanted is None else [w for w in found if w in wanted] if len(found) < len(wanted) else [w for w in wanted if w in found]
                terms += kept
                times += map(found.__getitem__, kept)
                sizes.append(len(kept))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield rows(
                batch, batch.schema.names[:-1], n=pa.array(n, pa.int64()), terms=pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())),
                times=lists(np.asarray(times, np.int64), np.asarray(sizes, np.int64)),
            )

    return run


def term_counts(docs: DataFrame, key: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """Per row: key, its number of terms n, and its distinct terms (those in wanted, if given) with their times."""
    kind = docs.schema[key].dataType.simpleString()
    return texts(docs, key).mapInArrow(_count(wanted), f"`{key}` {kind}, n bigint, terms array<string>, times array<bigint>")


def _holders(batches):
    for batch in batches:
        counts = batch.column(0).flatten().value_counts()
        yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["term", "df"])


def document_frequencies(counts: DataFrame) -> DataFrame:
    """Rows (term, df) of term_counts(); they are counted inside each batch before they are shuffled."""
    return counts.select("terms").mapInArrow(_holders, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class SharedSums:
    """Sums over the terms of several items as a graph of additions, each shared set of terms added once.

    An item's terms are put in one order, those of most items first, and pairs of
    neighbours that occur in two items or more become nodes, round after round, until
    none is left: a node is thus a set of terms that items share. What is left of an
    item is added up in pairs to its root. Terms that occur k times in an item enter as
    a node of k times the term. levels lists the additions by depth.
    """

    def __init__(self, items: list[dict[int, int]], n_terms: int) -> None:
        self.n_terms = n_terms
        self.times: dict[tuple[int, int], int] = {}
        pairs: dict[tuple[int, int], int] = {}
        for item in items:
            for term, k in item.items():
                if k > 1:
                    self.times.setdefault((term, k), n_terms + len(self.times))
        self.size = n_terms + len(self.times)
        sets = [[self.times.get((term, k), term) for term, k in item.items()] for item in items]
        self.additions_apart = sum(max(0, len(s) - 1) for s in sets)
        often = Counter(x for s in sets for x in s)
        sets = [sorted(s, key=lambda x: (-often[x], x)) for s in sets]

        def node(pair: tuple[int, int]) -> int:
            if pair not in pairs:
                pairs[pair] = self.size
                self.size += 1
            return pairs[pair]

        while True:
            seen = Counter(p for s in sets for p in zip(s, s[1:], strict=False))
            picks, used = [], Counter()
            for s in sets:
                own, i = [], 0
                while i + 1 < len(s):
                    here = seen[s[i], s[i + 1]]
                    if here > 1 and (i + 2 == len(s) or here >= seen[s[i + 1], s[i + 2]]):
                        own.append(i)
                        used[s[i], s[i + 1]] += 1
                        i += 1
                    i += 1
                picks.append(own)
            shared = {p for p, n in used.items() if n > 1}
            if not shared:
                break
            for k, (s, own) in enumerate(zip(sets, picks, strict=True)):
                out, begun = [], 0
                for i in own:
                    if (s[i], s[i + 1]) in shared:
                        out += [*s[begun:i], node((s[i], s[i + 1]))]
                        begun = i + 2
                sets[k] = out + s[begun:]
        self.shared = len(pairs)
        while any(len(s) > 1 for s in sets):
            sets = [[node((s[i], s[i + 1])) if i + 1 < len(s) else s[i] for i in range(0, len(s), 2)] for s in sets]
        self.roots = np.array([s[0] if s else -1 for s in sets], np.int64)
        depth = np.zeros(self.size, np.int64)
        for (a, b), x in pairs.items():  # a node comes after its parts
            depth[x] = 1 + max(depth[a], depth[b])
        every = np.array([(x, a, b) for (a, b), x in pairs.items()], np.int64).reshape(-1, 3)
        self.levels = [every[depth[every[:, 0]] == d] for d in range(1, int(depth.max(initial=0)) + 1)]
        self.multiples = np.array([(x, term, k) for (term, k), x in self.times.items()], np.int64).reshape(-1, 3)

    def __call__(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
        """Scores (item, document) from the values of terms in documents 0 to width - 1; nodes without any value are passed over."""
        sums = np.zeros((self.size + 1, width), np.int64)  # the last row is that of items without terms
        live = np.zeros(self.size, bool)
        sums[term, doc] = value
        live[term] = True
        some = self.multiples[live[self.multiples[:, 1]]]
        sums[some[:, 0]] = sums[some[:, 1]] * some[:, 2:]
        live[some[:, 0]] = True
        for level in self.levels:
            some = level[live[level[:, 1]] | live[level[:, 2]]]
            sums[some[:, 0]] = sums[some[:, 1]] + sums[some[:, 2]]
            live[some[:, 0]] = True
        return sums[self.roots]


def _best(plan: dict, k: int):
    def run(batches):
        graph, weight, n_docs, n_all = plan["graph"], plan["weight"], plan["n_docs"], plan["n_all"]
        item = np.zeros(0, np.int64)
        best = {c: np.zeros(0, t) for c, t in (("score", np.int64), ("doc", np.int64), ("none", bool))}
        least = np.ones(len(graph.roots), np.int64)
        width = max(1, HELD // (8 * (graph.size + len(graph.roots))))
        for batch in batches:
            doc_id = batch.column(0)
            none, ids = np.asarray(doc_id.is_null()), np.asarray(doc_id.fill_null(0))
            n = np.asarray(batch.column(1))
            terms = batch.column(2)
            sizes = np.asarray(terms.value_lengths()).astype(np.int64)
            flat = terms.flatten().dictionary_encode()
            here = np.array([plan["terms"].get(t, -1) for t in flat.dictionary.to_pylist()], np.int64)
            term = here[np.asarray(flat.indices)] if len(flat) else np.zeros(0, np.int64)
            tf, doc = np.asarray(batch.column(3).flatten()), np.repeat(np.arange(len(n)), sizes)
            own = term >= 0
            term, tf, doc = term[own], tf[own], doc[own]
            m = 100 - 75 + (75 * n * n_docs) // max(n_all, 1)
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            some = np.unique(doc)
            for at in range(0, len(some), width):
                part = some[at : at + width]
                a, z = np.searchsorted(doc, [part[0], part[-1] + 1])
                scores = graph(term[a:z], np.searchsorted(part, doc[a:z]), value[a:z], len(part))
                i, d = np.nonzero(scores >= least[:, None])
                if not len(i):
                    continue
                new = {"score": scores[i, d], "doc": ids[part[d]], "none": none[part[d]]}
                item, best = np.concatenate([item, i]), {c: np.concatenate([best[c], new[c]]) for c in best}
                order = np.lexsort((best["doc"], best["none"], -best["score"], item))
                item = item[order]
                kept = np.arange(len(item)) - np.searchsorted(item, item) < k
                item, best = item[kept], {c: v[order][kept] for c, v in best.items()}
                full = np.flatnonzero(np.bincount(item, minlength=len(least)) == k)
                least[full] = best["score"][np.searchsorted(item, full, "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(plan["items"][item]), pa.array(best["doc"], mask=best["none"]), pa.array(best["score"])], names=["item", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 200_000, wanted_bytes: int = 1 << 26) -> DataFrame:
    """For every row of items (item_id, text) the k documents (doc_id, text) of the highest score above 0: (item_id, rank, doc_id, score).

    Texts are whole; null ones have no terms. Scores are integers, by term frequency,
    length and rarity; equal ones go by doc_id, null last. Rows with one item_id are
    ranked apart, rows with one doc_id each count; an empty table on either side gives no
    rows; other columns are left out.

    Documents are read once: the terms that items hold are written with their times, all
    terms if those of the items have more than wanted_bytes. Items go in blocks of about
    block_terms distinct terms, of which each is one pass over what was written. In a
    task SharedSums gives the scores of some documents for all items of the block; it
    keeps k an item, and those of all tasks are ranked in two steps.
    """
    spark = docs.sparkSession
    named = numbered(items, "item_id", "text").withColumnRenamed("row", "item")
    asked = running_sums(term_counts(named, "item"), ["item"], before=F.size("terms"))
    asked = staged(asked.withColumn("block", F.floor(F.col("before") / block_terms)), "asked")
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    held = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    wanted = frozenset(r[0].encode() for r in vocabulary.toLocalIterator()) if held <= wanted_bytes else None
    counts = staged(term_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted), "terms")
    n_docs, n_all = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    rare = staged(document_frequencies(counts).join(vocabulary, "term", "left_semi"), "frequencies")
    found = None
    for (block,) in asked.select("block").distinct().orderBy("block").collect():
        own = asked.where(F.col("block") == block)
        df = dict(own.select(F.explode("terms").alias("term")).distinct().join(rare, "term").collect())
        some = own.orderBy("item").collect()
        at = {t: i for i, t in enumerate(df)}  # terms that no document holds add nothing
        plan = {
            "graph": SharedSums([{at[t]: c for t, c in zip(r["terms"], r["times"], strict=True) if t in at} for r in some], len(at)), "terms": at, "items": np.array([r["item"] for r in some], np.int64),
            "weight": np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.values()], np.int64), "n_docs": n_docs, "n_all": n_all,
        }
        part = counts.mapInArrow(_best(plan, k), "item bigint, doc_id bigint, score bigint")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "salt"], ["item"]):
        found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    return found.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
