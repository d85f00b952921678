"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Shingles are runs of five words. All of a text's distinct shingles weigh the same, as
links are defined on their sets: weights by count would hide links of texts that repeat
a part unequally often. Each shingle sends a Poisson process of arrivals; an arrival
falls on a random register, and each register keeps its earliest arrival. A shingle
stops as soon as its next arrival is later than every register's. Two texts agree in
a register with the Jaccard similarity of their shingle sets. Bands of registers give
candidates; the exact similarity verifies them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.llm.common import Words, lists, mix, own_rows, rows, shingles, steps, table, texts
from ledgerscope.operators.components import connected_components

REGISTERS, BANDS, PER_BAND = 128, 24, 5
#: Of the registers, so many standard deviations below the threshold still are candidates.
SLACK = 4.3
#: 64-bit words of the parity sketch of a shingle set.
PARITY = 16
#: Bits of the filter of candidates for each of them and at most: 32 MiB. More candidates let more other texts through it, and lose none.
FILTER_EACH, FILTER_MOST = 16, 1 << 28
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def distinct_shingles(text_bytes: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct shingle, sorted by text and hash."""
    doc, h = shingles(Words(text_bytes), size)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n_docs x registers) of weighted elements; texts without elements get zeros."""
    best = np.full(n_docs * registers, np.inf)
    who = np.zeros(n_docs * registers, np.uint64)
    when = np.zeros(len(h))
    k = 0
    while len(h):
        u = mix(h + np.full(1, 2 * k + 1, np.uint64) * _GOLDEN)
        when = when - np.log((((u >> np.uint64(11)).astype(np.float64)) + 0.5) * 2.0**-53) / weight
        at = doc * registers + (mix(u ^ _GOLDEN) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, at, when)
        won = best[at] == when
        who[at[won]] = h[won]
        last = best.reshape(n_docs, registers).max(1)
        stays = when < last[doc]
        doc, h, weight, when = doc[stays], h[stays], weight[stays], when[stays]
        k += 1
    return who.reshape(n_docs, registers)


def parity_sketch(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Per text, 64 * PARITY bits: whether an odd number of its shingles falls on the bit.

    Two sketches differ in no more bits than the sets differ in elements.
    """
    bits = 64 * PARITY
    at = doc * bits + (mix(h + _GOLDEN) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n_docs * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n_docs, PARITY)


def _signatures(size: int):
    def run(batches):
        for batch, raw in steps(batches):
            n = len(raw)
            doc, h, _ = distinct_shingles(raw, size)
            sig = mix(prob_minhash(doc, h, np.ones(len(h)), n))
            n_sh = np.bincount(doc, minlength=n)
            prints = []
            for salt in (np.uint64(1), np.uint64(2)):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.full(1, salt) * _GOLDEN))])
                ends = np.cumsum(n_sh)
                prints.append((sums[ends] - sums[ends - n_sh]).view(np.int64))
            bands = np.zeros((n, BANDS), np.uint64)
            for j in range(PER_BAND):
                bands = bands * _GOLDEN + sig[:, j : BANDS * PER_BAND : PER_BAND]
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
            two = (sig & np.uint64(3)).reshape(n, 4, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, None, :]
            packed = np.bitwise_or.reduce(two, axis=2).view(np.int64)
            yield rows(
                batch, ["doc_id", "id"], n=pa.array(n_sh.astype(np.int64)), f1=prints[0], f2=prints[1],
                **{f"s{i}": np.ascontiguousarray(packed[:, i]) for i in range(4)},
                bands=lists(bands.ravel(), np.full(n, BANDS)),
            )

    return run


def filter_bits(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each id in a filter of bits, a power of two."""
    h = mix(ids.view(np.uint64) + _GOLDEN)
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the n values of the bigint column doc_id, as bytes; what comes to the driver is at most FILTER_MOST bits."""
    bits = min(FILTER_MOST, max(1 << 12, 1 << (FILTER_EACH * n - 1).bit_length()))

    def places(batches):
        for batch in batches:
            at = np.concatenate(filter_bits(batch.column(0).to_numpy(zero_copy_only=False), bits))
            word, where = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, where, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "bits"])

    words = ids.select("doc_id").mapInArrow(places, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def _shingle_rows(size: int, met):
    def run(batches):
        bits = met.value
        for batch in batches:
            x, y = filter_bits(batch.column(batch.schema.get_field_index("doc_id")).to_numpy(), 8 * len(bits))
            held = (bits[x >> 3] >> (x & 7).astype(np.uint8)) & (bits[y >> 3] >> (y & 7).astype(np.uint8)) & 1
            yield from of(batch.take(pa.array(np.flatnonzero(held))))

    def of(candidates):
        for batch, raw in steps([candidates]):
            doc, h, _ = distinct_shingles(raw, size)
            odd = parity_sketch(doc, h, len(raw))
            yield rows(
                batch, ["doc_id"], sh=lists(h.view(np.int64), np.bincount(doc, minlength=len(raw))),
                **{f"p{i}": np.ascontiguousarray(odd[:, i]) for i in range(PARITY)},
            )

    return run


def _alike(threshold: float, registers: int = REGISTERS):
    """Whether the packed two-bit registers of a. and b. leave a similarity of threshold possible."""
    differ = F.lit(0)
    for i in range(4):
        x = F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    p = 0.75 * (1 - threshold)
    sizes = (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9)
    return sizes & (differ <= int(registers * p + SLACK * (registers * p * (1 - p)) ** 0.5))


def _within(threshold: float):
    """Whether the parity sketches of a. and b. leave a similarity of threshold possible; this excludes no link."""
    differ = F.lit(0)
    for i in range(PARITY):
        differ = differ + F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}")))
    return differ <= (F.col("a.n") + F.col("b.n")) * ((1 - threshold) / (1 + threshold)) + 1e-6


def _verified(pairs: DataFrame, sh: DataFrame) -> DataFrame:
    """Pairs (x, y) with the Jaccard similarity of their shingle sets; merged at every size, as shingles grow with the texts."""
    left = pairs.join(sh.select(F.col("doc_id").alias("y"), F.col("sh").alias("sh_y")).hint("merge"), "y")
    both = left.join(sh.select(F.col("doc_id").alias("x"), F.col("sh").alias("sh_x")).hint("merge"), "x")
    both = both.select("x", "y", F.size("sh_x").alias("nx"), F.size("sh_y").alias("ny"), F.size(F.array_intersect("sh_x", "sh_y")).alias("common"))
    return both.select("x", "y", (F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))).alias("jaccard"))


def near_duplicate_rows(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """Rows (row, doc_id, first_row, class_id, n_shingles) of a table (row, doc_id, text).

    row must be unique, not null and stable. class_id is the least doc_id of the class and
    first_row the least row that has it. Classes are the connected parts of the links "Jaccard similarity of the sets of
    size-word shingles is at least threshold". A text of fewer words has one shingle,
    of all its words; a text without words (or null) is a class of its own. Repeated
    texts and texts with the same shingle set fall into one class at once. doc_id may be
    null or repeated; class_id is null only where every doc_id of the class is. An empty
    table gives no rows.

    Texts with equal sets are stood for by one row. In each bucket only links to a hub,
    the text met most often over all buckets, are verified; what then lies outside the
    part that holds most of a bucket is compared with the rest of it unless the
    registers, the parity sketches or, by the triangle inequality, the distances to a
    common hub exclude a link. Two texts that share several buckets are compared in the
    first of them. Texts are not shuffled: the second pass over them takes those that a
    filter of the candidates lets through.
    """
    source = texts(docs.select(F.col("row").alias("doc_id"), F.col("doc_id").cast("long").alias("id"), "text"), "doc_id", "id")
    scheme = "doc_id bigint, id bigint, n bigint, f1 bigint, f2 bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, bands array<bigint>"
    sig = staged(source.mapInArrow(_signatures(size), scheme), "signatures")

    same = staged(sig.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("row"))).alias("low")), "sets")
    members = (
        sig.where("n > 0").select("doc_id", "id", "n", "f1", "f2").join(same, ["n", "f1", "f2"]).select("doc_id", "id", "rep", "n", "low.id", "low.row")
        .union(sig.where("n = 0").select("doc_id", "id", F.col("doc_id").alias("rep"), "n", "id", "doc_id"))
        .toDF("row", "doc_id", "rep", "n", "low_id", "low_row")
    )
    reps = sig.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    buckets = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    met = staged(buckets.join(shared, "bucket").select("bucket", "doc_id", "c"), "buckets")
    weight = met.groupBy("doc_id").agg(F.sum("c").alias("met"))
    info = staged(reps.select("doc_id", "n", "s0", "s1", "s2", "s3").join(weight, "doc_id"), "candidates")
    met = met.select("bucket", "doc_id")
    hubs = met.join(info.select("doc_id", "met"), "doc_id").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("low"))).alias("h"))
    hubs = hubs.select("bucket", (-F.col("h.low")).alias("x"))
    spokes = met.join(hubs, "bucket").where("x <> doc_id").select("x", F.col("doc_id").alias("y")).distinct()
    spokes = spokes.join(info.withColumnRenamed("doc_id", "x").alias("a"), "x").join(info.withColumnRenamed("doc_id", "y").alias("b"), "y").where(_alike(threshold)).select("x", "y")
    let = source.sparkSession.sparkContext.broadcast(id_filter(info, info.count()))
    sh = source.select("doc_id", "text").mapInArrow(_shingle_rows(size, let), "doc_id bigint, sh array<bigint>, " + ", ".join(f"p{i} bigint" for i in range(PARITY)))
    sh = staged(sh.join(info.select("doc_id"), "doc_id", "left_semi"), "shingles")
    stars = staged(_verified(spokes, sh), "stars")
    near = F.col("jaccard") >= threshold - 1e-12
    parts = connected_components(stars.where(near).select("x", "y"), "x", "y")

    pivot = stars.groupBy("y").agg(F.max_by(F.struct("x", "jaccard"), F.struct("jaccard", (-F.col("x")).alias("l"))).alias("p"))
    pivot = pivot.select(F.col("y").alias("doc_id"), F.col("p.x").alias("pivot"), (1 - F.col("p.jaccard")).alias("away"))
    pivot = pivot.union(stars.select("x").distinct().select(F.col("x").alias("doc_id"), F.col("x").alias("pivot"), F.lit(0.0).alias("away")).join(pivot, "doc_id", "left_anti"))
    placed = (
        info.drop("met").join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").join(pivot, "doc_id", "left")
        .withColumn("component", F.coalesce("component", "doc_id"))
    )
    filed = met.join(placed, "doc_id")
    mixed = filed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    filed = filed.join(mixed, "bucket", "left_semi").join(sh.drop("sh"), "doc_id").join(reps.select("doc_id", "bands"), "doc_id")
    filed = staged(filed, "mixed")
    most = filed.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("most"))
    outside = filed.join(most, "bucket").where("component <> most")
    apart = (F.col("a.pivot") != F.col("b.pivot")) | F.col("a.pivot").isNull() | F.col("b.pivot").isNull() | (F.abs(F.col("a.away") - F.col("b.away")) <= 1 - threshold + 1e-9)
    across = (
        outside.alias("a").join(filed.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & ((F.col("a.doc_id") < F.col("b.doc_id")) | (F.col("b.component") == F.col("a.most"))) & (F.col("a.component") != F.col("b.component")) & apart & _alike(threshold) & _within(threshold) & (F.array_intersect("a.bands", "b.bands")[0] == F.col("a.bucket")))
        .select(F.least("a.doc_id", "b.doc_id").alias("x"), F.greatest("a.doc_id", "b.doc_id").alias("y"))
        .join(stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
    )
    more = staged(_verified(across, sh).where(near), "links")
    links = stars.where(near).select("x", "y").union(more.select("x", "y"))
    parts = connected_components(links, "x", "y") if more.take(1) else parts
    linked = same.join(parts.select(F.col("node").alias("rep"), "component"), "rep").select("rep", "low", "component")
    lowest = linked.select("rep", "component").join(linked.groupBy("component").agg(F.min("low").alias("first")), "component").select("rep", "first")
    alone = F.col("first").isNull()
    return members.join(lowest, "rep", "left").select(
        "row", "doc_id", F.when(alone, F.col("low_row")).otherwise(F.col("first.row")).alias("first_row"),
        F.when(alone, F.col("low_id")).otherwise(F.col("first.id")).alias("class_id"), F.col("n").alias("n_shingles"),
    )


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """Rows (doc_id, class_id, n_shingles), one for each row of docs, as near_duplicate_rows() finds them; other columns are ignored."""
    return near_duplicate_rows(own_rows(docs, "doc_id", "text"), threshold, size).select("doc_id", "class_id", "n_shingles")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
