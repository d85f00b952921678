"""Benchmark leaks by latent semantic retrieval, then longest common subsequences.

Words are hashed to buckets and weighted by TF-IDF over passages of the corpus. A
randomised subspace iteration, summed over all passages, gives the leading right
singular vectors, each divided by its share of the variance, so that directions that
tell languages and not contents don't outweigh the others. Passages and items are compared by cosine in that space. What shares one of an
item's telling runs of words is a candidate whatever the words weigh, and so is, for an
item whose words all weigh nothing, what holds enough of its words. Candidates are compared
by the longest common subsequence of words and by the item's last words, its answer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import MULTIPLIER, Words, mix, rows, steps, table, taken, texts

BUCKETS, RANK = 1 << 14, 64
#: Taken off every inverse frequency, so that words in a twentieth of all passages or more weigh nothing; of few passages half the largest is taken off.
COMMON = 3.0
WINDOW, STRIDE = 32, 16
COSINE, COVERED, COVERED_WITH_ANSWER, ANSWER = 0.48, 0.8, 0.6, 5
#: Items compared at once; more are taken in blocks.
ITEM_BLOCK = 20_000
#: Slots that words fall in, to bound common subsequences.
SLOTS = 512
#: Slots that runs of words fall in before they are looked up, and pairs of place and item that are compared at once.
RUN_SLOTS, PAIRS = 1 << 20, 1 << 18

#: ASCII letters and digits and all bytes of other characters make words.
PART = np.ones(256, bool)
PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(raw: list[bytes]) -> Words:
    return Words([t.lower() for t in raw], PART)


def passages(words: Words, size: int) -> np.ndarray:
    """Number of each word's passage: consecutive runs of size words of one text."""
    first = np.cumsum(words.per_text) - words.per_text
    inside = np.arange(len(words.text)) - first[words.text]
    return np.cumsum((inside % size == 0)) - 1


def _document_frequency(window: int):
    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for _, raw in steps(batches):
            w = words_of(raw)
            if len(w.hash):
                p = passages(w, window)
                pair = np.unique(p * BUCKETS + (w.hash % np.uint64(BUCKETS)).astype(np.int64))
                df += np.bincount(pair % BUCKETS, minlength=BUCKETS)
                n += int(p[-1]) + 1
        full = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(df[full], n))], names=["bucket", "n"])

    return run


def inverse_frequency(docs: DataFrame, window: int = WINDOW) -> np.ndarray:
    """ln((1 + passages) / (1 + passages with the bucket)) less COMMON or half of ln(1 + passages), 0 at least, of every bucket, over all documents."""
    counts = docs.mapInArrow(_document_frequency(window), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    known = counts["bucket"] >= 0
    df[counts["bucket"][known]] = counts["n"][known]
    most = math.log(1 + counts["n"][~known].sum())
    return np.maximum(most - np.log(1 + df) - min(COMMON, most / 2), 0).astype(np.float32)


def _products(idf, basis, window: int):
    """A^T A V of the task's passages: for each bucket a row of sums."""

    def run(batches):
        weight, v = idf.value, basis.value
        none = np.zeros((1, v.shape[1]), np.float32)
        scaled = np.vstack([v * weight[:, None], none])
        total = np.zeros(v.shape, np.float32)
        for _, raw in steps(batches, limit=1 << 20):
            w = words_of(raw)
            if not len(w.hash):
                continue
            b = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
            p = passages(w, window)
            tells = np.flatnonzero(weight[b])  # words without weight add nothing
            if not len(tells):
                continue
            b, p = b[tells], p[tells]
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            p = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(p))))
            g = weight[b]
            squares = np.add.reduceat(g * g, starts)
            y = np.vstack([group_sums(scaled, b, starts) / squares[:, None], none])
            order = np.argsort(b, kind="stable")
            b, p = b[order], p[order]
            cut = np.flatnonzero(np.diff(b, prepend=-1))
            total[b[cut]] += group_sums(y, p, cut) * weight[b[cut], None]
        full = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(total[full, k]) for k in range(v.shape[1]))], names=["bucket", *(f"z{k}" for k in range(v.shape[1]))])

    return run


def latent_basis(docs: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = 1, window: int = WINDOW, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors (BUCKETS x rank) of the corpus's passages, whitened.

    Only sums of fixed size, BUCKETS x rank, come to the driver.
    """
    spark, size = docs.sparkSession, rank
    v = np.random.default_rng(seed).standard_normal((BUCKETS, size)).astype(np.float32)
    for _ in range(rounds):
        task = _products(spark.sparkContext.broadcast(idf), spark.sparkContext.broadcast(v), window)
        names = [f"z{k}" for k in range(size)]
        sums = docs.mapInArrow(task, "bucket bigint, " + ", ".join(f"{k} float" for k in names)).groupBy("bucket").agg(*(F.sum(k).alias(k) for k in names)).toPandas()
        z = np.zeros((BUCKETS, size))
        z[sums["bucket"]] = sums[names].to_numpy()
        if not z.any():
            return v
        q, r = np.linalg.qr(z)
        u, s, _ = np.linalg.svd(r)
        v = (q @ u).astype(np.float32)
    return np.ascontiguousarray(v / np.maximum(s, 1e-6 * s[0]).astype(np.float32))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for y in b:
        m = row & where.get(y, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def has_run(run: list[int], words: list[int]) -> bool:
    return any(words[k : k + len(run)] == run for k in range(len(words) - len(run) + 1) if words[k] == run[0])


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words."""
    n = max(len(h) - size + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(MULTIPLIER) + h[j : j + n]
    return mix(total)


def telling_runs(words: list[list[int]], covered: float, answer: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: hashes of runs of the items' words, sorted, and the items' numbers.

    An item that lacks at most m of its words has one of any m + 1 disjoint runs left, so
    a place that holds the rest in order, whatever stands for the lacking words, has that
    run. Of the choices the one that items share least is taken. The answer is a run too.
    """
    plan, seen = [], {}
    for i, item in enumerate(words):
        if item:
            lacks = min(int((1 - covered) * len(item) + 1e-9), len(item) - 1)
            size = max(1, min(answer, len(item) // (lacks + 1)))
            h = run_hashes(np.array(item, np.uint64), size).tolist()
            plan.append((i, size, lacks + 1, h))
            for x in h:
                seen[size, x] = seen.get((size, x), 0) + 1
    found: dict[int, set[tuple[int, int]]] = {}
    for i, size, n, h in plan:
        choices = [h[k : k + n * size : size] for k in range(len(words[i]) - n * size + 1)]
        best = min(choices, key=lambda c: sum(seen[size, x] for x in c))
        found.setdefault(size, set()).update((x, i) for x in best)
        last = words[i][-answer:]
        found.setdefault(len(last), set()).add((int(run_hashes(np.array(last, np.uint64), len(last))[0]), i))
    return {size: (np.array([x for x, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)], int)) for size, v in found.items()}


class Items:
    """Benchmark items as latent unit vectors, word hashes and telling runs."""

    def __init__(self, ids: list[int], raw: list[bytes], idf: np.ndarray, basis: np.ndarray, covered: float = COVERED, answer: int = ANSWER) -> None:
        w = words_of(raw)
        cuts = np.cumsum(w.per_text)[:-1] if len(raw) else []
        self.words = [x.tolist() for x in np.split(w.hash, cuts)]
        self.sets = [frozenset(x) for x in self.words]
        self.ids = ids
        place = np.arange(len(w.text)) - (np.cumsum(w.per_text) - w.per_text)[w.text]
        early = np.flatnonzero(place < 64)
        self.masks = np.zeros((len(raw), SLOTS), np.uint64)
        np.bitwise_or.at(self.masks, (w.text[early], (w.hash[early] % np.uint64(SLOTS)).astype(np.int64)), np.uint64(1) << place[early].astype(np.uint64))
        self.past = np.maximum(w.per_text - 64, 0)
        b = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
        v = np.zeros((len(raw), basis.shape[1]), np.float32)
        np.add.at(v, w.text, basis[b] * idf[b][:, None])
        self.vectors = v / np.maximum(np.sqrt((v * v).sum(1)), 1e-9)[:, None]
        self.runs = telling_runs(self.words, covered, answer)
        self.marks = {}
        for k, (x, _) in self.runs.items():
            self.marks[k] = np.zeros(RUN_SLOTS, bool)
            self.marks[k][x % np.uint64(RUN_SLOTS)] = True
        self.blind = np.flatnonzero((w.per_text > 0) & (np.bincount(w.text, idf[b], len(raw)) == 0))

    def sharing(self, w: Words):
        """Words of w at which an item's run begins and the items, some pairs at a time."""
        for size, (known, item) in self.runs.items():
            h = run_hashes(w.hash, size)
            at = np.flatnonzero(self.marks[size][h % np.uint64(RUN_SLOTS)] & (w.text[: len(h)] == w.text[size - 1 :]))
            lo, hi = (np.searchsorted(known, h[at], side) for side in ("left", "right"))
            n = hi - lo
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS, prepend=0))
            for at_, lo_, n_ in zip(*(np.split(x, cuts) for x in (at, lo, n)), strict=True):
                yield np.repeat(at_, n_), item[np.repeat(lo_ - (np.cumsum(n_) - n_), n_) + np.arange(int(n_.sum()))]

    def bounds(self, item: np.ndarray, slots: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each pair of item and place, lo to hi, a length that no common subsequence exceeds.

        Words are told by their slots, and all of an item's words past the 64th count as common.
        """
        row = np.full(len(item), ~np.uint64(0))
        for k in range(int((hi - lo).max(initial=0))):
            match = self.masks[item, slots[np.minimum(lo + k, hi - 1)]]
            m = row & match
            row = np.where(lo + k < hi, (row + m) | (row - m), row)
        return np.bitwise_count(~row).astype(np.int64) + self.past[item]


def group_sums(table: np.ndarray, index: np.ndarray, starts: np.ndarray, chunk: int = 8) -> np.ndarray:
    """Sums of table[index] over the runs of index that begin at starts; the last row of table is zero."""
    size = np.diff(np.append(starts, len(index)))
    parts = -(-size // chunk)
    first = np.cumsum(parts) - parts
    at = np.repeat(starts, parts) + (np.arange(int(parts.sum())) - np.repeat(first, parts)) * chunk
    end = np.repeat(starts + size, parts)
    total = table[index[at]]
    for k in range(1, chunk):
        total += table[np.where(at + k < end, index[np.minimum(at + k, len(index) - 1)], len(table) - 1)]
    return np.add.reduceat(total, first)


def block_sums(w: Words, scaled: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the words' vectors at blocks of unit words, and each text's first block."""
    per = -(-w.per_text // unit)
    block = np.cumsum(per) - per
    first = np.cumsum(w.per_text) - w.per_text
    sums = np.zeros((int(per.sum()) + 1, scaled.shape[1]))
    b = (w.hash % np.uint64(BUCKETS)).astype(np.int64)
    tells = np.flatnonzero(scaled.any(1)[b])
    if len(tells):
        at = block[w.text[tells]] + (tells - first[w.text[tells]]) // unit
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        sums[at[cut] + 1] = group_sums(scaled, b[tells], cut)
    return np.cumsum(sums, axis=0), block


def _search(items, idf, basis, cosine: float, covered: float, with_answer: float, answer: int, window: int, stride: int):
    def run(batches):
        own = items.value
        scaled = np.vstack([basis.value * idf.value[:, None], np.zeros((1, basis.value.shape[1]), np.float32)])
        unit = math.gcd(window, stride, window // 2, stride // 2)
        size = np.array([len(x) for x in own.words], int)
        longest = int(size.max(initial=0))
        everything, short = np.flatnonzero(size), np.flatnonzero((size > 0) & (size <= 5 * window // 8))
        for batch, raw in steps(batches, limit=1 << 20):
            w = words_of(raw)
            first = np.cumsum(w.per_text) - w.per_text
            best: dict[tuple[int, int], tuple] = {}
            sums, block = block_sums(w, scaled, unit)
            slots = (w.hash % np.uint64(SLOTS)).astype(np.int64)
            for width, step, some in ((window, stride, everything), (window // 2, stride // 2, short)):
                if not len(some):
                    continue
                n = np.maximum(1, -(-np.maximum(w.per_text - (width - step), 0) // step)) * (w.per_text > 0)
                text = np.repeat(np.arange(len(raw)), n)
                start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
                end = np.minimum(start + width, (first + w.per_text)[text])
                from_, to = np.maximum(first[text], start - longest), np.minimum((first + w.per_text)[text], end + longest)

                def vectors_of(k):
                    lo, hi = (block[text[k]] + -(-(x[k] - first[text[k]]) // unit) for x in (start, end))
                    v = (sums[hi] - sums[lo]).astype(np.float32)
                    return v / np.maximum(np.sqrt((v * v).sum(1)), 1e-9)[:, None]

                def compare(k, i):
                    """Windows k with items i."""
                    may = np.concatenate([[], *(c + np.flatnonzero(own.bounds(i[c : c + PAIRS], slots, from_[k[c : c + PAIRS]], to[k[c : c + PAIRS]]) >= with_answer * size[i[c : c + PAIRS]]) for c in range(0, len(k), PAIRS))]).astype(int)
                    k, i = k[may], i[may]
                    near = np.einsum("ij,ij->i", vectors_of(k), own.vectors[i])
                    before = -1
                    for k, i, c in zip(k.tolist(), i.tolist(), near.tolist(), strict=True):
                        item = own.words[i]
                        if k != before:
                            place, before = w.hash[from_[k] : to[k]].tolist(), k
                            known = frozenset(place)
                        if len(own.sets[i] & known) < with_answer * len(own.sets[i]) - (len(item) - len(own.sets[i])):
                            continue
                        share = common_subsequence(item, place) / len(item)
                        if share < with_answer:
                            continue
                        hit = has_run(item[-answer:], place)
                        if share >= covered or hit:
                            t = int(text[k])
                            best[t, i] = max(best.get((t, i), (0.0, False, 0.0, 0)), (share, hit, c, -int(start[k] - first[t])))

                for at in range(0, len(text), 20_000):
                    k, j = np.nonzero(vectors_of(np.arange(at, min(at + 20_000, len(text)))) @ own.vectors[some].T >= cosine)
                    compare(at + k, some[j])
                if width < window:
                    continue
                upto = np.cumsum(n)
                for p, i in own.sharing(w):
                    t = w.text[p]
                    pair = np.unique((upto[t] - n[t] + np.minimum((p - first[t]) // step, n[t] - 1)) * len(size) + i)
                    compare(pair // len(size), pair % len(size))
                for i in own.blind:
                    in_item = np.zeros(SLOTS, bool)
                    in_item[np.array(own.words[i], np.uint64) % np.uint64(SLOTS)] = True
                    held = np.append(0, np.cumsum(in_item[slots]))
                    k = np.flatnonzero(held[to] - held[from_] >= with_answer * size[i])
                    compare(k, np.full(len(k), i))
            found = sorted(best)
            values = [best[x] for x in found]
            yield rows(
                taken(batch, [t for t, _ in found], "doc_id"), ["doc_id"], item_id=pa.array([own.ids[i] for _, i in found], pa.int64()),
                covered=pa.array([x[0] for x in values], pa.float64()), answer=pa.array([x[1] for x in values], pa.bool_()),
                cosine=pa.array([x[2] for x in values], pa.float64()), near_word=pa.array([-x[3] for x in values], pa.int64()),
            )

    return run


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, covered: float = COVERED, with_answer: float = COVERED_WITH_ANSWER,
    answer: int = ANSWER, window: int = WINDOW, stride: int = STRIDE, item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """One row per document and leaked item: (doc_id, item_id, covered, answer, cosine, near_word).

    covered is the share of the item's words in its longest common subsequence with the
    place; a leak has covered of at least covered, or at least with_answer together with
    the item's last answer words in one run (answer). near_word is the word at which
    the best window starts. Words are lower-case letters and digits. Every window of
    every document meets every item, and windows of half the size the short items; a text that
    holds an item with words replaced or left out within these shares is found however common
    the words are. Items are taken in blocks of item_block, the only thing that is broadcast
    besides tables of fixed size. Null or empty texts and items
    leak nothing; repeated rows are reported each; empty tables give no rows.
    """
    spark = docs.sparkSession
    source = texts(docs, "doc_id")
    idf = inverse_frequency(source, window)
    basis = latent_basis(source, idf, window=window)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, covered double, answer boolean, cosine double, near_word bigint"
    weights, vectors = spark.sparkContext.broadcast(idf), spark.sparkContext.broadcast(basis)
    known = texts(benchmark.where("item_id IS NOT NULL"), "item_id")
    blocks = max(1, math.ceil(known.count() / item_block))
    out = None
    for k in range(blocks):
        block = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect()
        items = spark.sparkContext.broadcast(Items([r["item_id"] for r in block], [r["text"].encode() for r in block], idf, basis, covered, answer))
        found = source.mapInArrow(_search(items, weights, vectors, cosine, covered, with_answer, answer, window, stride), schema)
        out = found if out is None else out.union(found)
    return out


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
