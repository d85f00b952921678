"""Removal of bytes that repeat an earlier string of 100 bytes, by sharded suffix arrays.

Every 100-byte window holds a content-chosen anchor: the 32-byte string in it with the
least hash. Equal windows have equal anchors, at equal distances, so only windows whose
anchor occurs elsewhere can repeat. Runs of windows with one anchor and equal bytes all
around are told by one hash; what differs somewhere goes, whole anchors together, into
shards of bounded size whose suffix arrays give the repeated windows. The runs of an
anchor that fills more than a shard are cut in two, by the side on which a window reaches
further, and each half takes the longer string that all its windows hold as its anchor.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.llm.common import mix, prefix_sums, rows, span_hashes, steps, table, taken
from ledgerscope.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH, GRAM = 100, 32
SHARD_BYTES = 2 << 20
#: A document: its doc_id, and the hash of its text where a doc_id is repeated.
KEY = ["k", "f"]


def anchored_runs(text_bytes: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: text number, first start, number of starts, anchor hash, hash of all their bytes."""
    data = np.frombuffer(b"".join(text_bytes), np.uint8)
    sizes = np.array([len(t) for t in text_bytes])
    base = np.cumsum(sizes) - sizes
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hashes(sums, at, at + gram)
    key = (grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    low, width, wanted = key, 1, length - gram + 1
    while 2 * width <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wanted:
        low = np.minimum(low[: len(low) - (wanted - width)], low[wanted - width :])
    anchor = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    valid = np.arange(n) + length <= (base + sizes)[text]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    lo, hi = lo[valid[lo]], hi[valid[lo]]
    a = anchor[lo]
    around = mix(span_hashes(sums, lo, hi - 1 + length) + (a - lo).astype(np.uint64) * np.uint64(1 << 32) + (hi - lo).astype(np.uint64))
    return text[lo], lo - base[text[lo]], hi - lo, grams[a], around


def _runs(length: int, gram: int):
    def run(batches):
        for batch, raw in steps(batches, limit=1 << 19):  # a dozen arrays of eight bytes for each byte
            text, lo, n, h, around = anchored_runs(raw, length, gram)
            yield rows(taken(batch, text, *KEY), KEY, h=h.view(np.int64), around=around.view(np.int64), lo=lo.astype(np.int64), n=n.astype(np.int32))

    return run


def _met(batches):
    """Of rows sorted by anchor, bytes around and place: those whose anchor is met again; known if a row before has the same bytes around.

    Where a partition or batch begins or ends inside an anchor, its rows are kept. Of
    rows that are equal in their place too, one is kept.
    """
    held = last = None
    twin = False
    for batch in batches:
        if not len(batch):
            continue
        batch = pa.Table.from_batches([held, batch]) if held is not None else pa.Table.from_batches([batch])
        names = [c for c in batch.column_names if c != "around"]
        h, around = batch.column("h").to_numpy(), batch.column("around").to_numpy()
        n = len(h)
        same = np.zeros(n + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        same[0] = last is None or last[0] == h[0]
        known = np.zeros(n, bool)
        known[1:] = same[1:-1] & (around[1:] == around[:-1])
        known[0] = last is not None and last == (h[0], around[0])
        group = np.cumsum(~same[:-1])
        kinds = np.bincount(group, ~known)[group]
        inner = (group != group[0]) & (group != group[-1])
        keep = (same[:-1] | same[1:]) & (known | ~inner | (kinds > 1))
        place = [batch.column(c).to_numpy() for c in (*KEY, "lo")]
        keep[1:] &= ~(known[1:] & np.logical_and.reduce([x[1:] == x[:-1] for x in place]))
        keep[0] &= not twin
        keep[-1] = False  # told with the next batch
        told = pa.Table.from_arrays([*(batch.column(c).take(pa.array(np.flatnonzero(keep))) for c in names), pa.chunked_array([pa.array(known[keep])])], names=[*names, "known"])
        yield from told.to_batches()
        if n > 1:
            last = (h[-2], around[-2])
            twin = bool(known[-1] and all(x[-1] == x[-2] for x in place))
        held = batch.slice(n - 1).combine_chunks().to_batches()[0]
    if held is not None and not twin:
        final = last is not None and last == (held.column("h")[0].as_py(), held.column("around")[0].as_py())
        yield pa.RecordBatch.from_arrays([*(held.column(held.schema.get_field_index(c)) for c in names), pa.array([final])], names=[*names, "known"])


def _segments(length: int, gram: int):
    def run(batches):
        for batch, raw in steps(batches):
            which, h, lo, n, seg = [], [], [], [], []
            for k, (t, runs) in enumerate(zip(raw, batch.column(batch.schema.get_field_index("runs")).to_pylist(), strict=True)):
                for r in runs:
                    which.append(k)
                    h.append(r["h"])
                    lo.append(r["lo"])
                    n.append(r["n"])
                    seg.append(t[r["lo"] : r["lo"] + r["n"] - 1 + length])
            yield rows(
                taken(batch, which, *KEY), KEY, h=pa.array(h, pa.int64()), lo=pa.array(lo, pa.int64()), n=pa.array(n, pa.int32()),
                at=pa.array(np.full(len(h), -1, np.int32)), width=pa.array(np.full(len(h), gram, np.int32)), seg=pa.array(seg, pa.binary()),
            )

    return run


def halves(h: np.ndarray, n: np.ndarray, at: np.ndarray, width: np.ndarray, segments: list[bytes], length: int = LENGTH):
    """The runs of anchors cut in two: number of the run, first window in it, windows, anchor hash, hash of all bytes, anchor place and width.

    at is where in the segment the anchor begins, -1 if that is still to be found by its hash.
    """
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    base = np.cumsum(sizes) - sizes
    sums = prefix_sums(data)
    for k in np.flatnonzero(at < 0):
        p = np.arange(n[k] - 1, length - width[k] + 1) + base[k]
        at[k] = p[span_hashes(sums, p, p + width[k]).view(np.int64) == h[k]][0] - base[k]
    more = -((width - length) // 2)
    cut = np.clip(at - more + 1, 0, n)  # windows before it hold more bytes to the left of the anchor
    out = []
    for first, end, place, wide, side in ((0 * cut, cut, at - more, width + more, 1), (cut, n, at, length - more + 1, 2)):
        k = np.flatnonzero(end > first)
        lo, hi = base[k] + first[k], base[k] + end[k] - 1 + length
        a = base[k] + place[k]
        own = mix(span_hashes(sums, a, a + wide[k]) + h[k].astype(np.uint64) * np.uint64(2 * side + 1))
        around = mix(span_hashes(sums, lo, hi) + (a - lo).astype(np.uint64) * np.uint64(1 << 32) + (end - first)[k].astype(np.uint64))
        out.append((k, first[k], (end - first)[k], own, around, place[k] - first[k], wide[k]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _halves(length: int):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: E731, B023
                seg = column("seg").to_pylist()
                ints = [column(c).to_numpy().astype(np.int64) for c in ("h", "n", "at", "width")]
                k, first, n, h, around, place, width = halves(*ints, seg, length)
                yield rows(
                    taken(part, k, *KEY), KEY, h=h.view(np.int64), around=around.view(np.int64), lo=column("lo").to_numpy()[k] + first, n=n.astype(np.int32),
                    at=place.astype(np.int32), width=width.astype(np.int32),
                    seg=pa.array([seg[i][f : f + m - 1 + length] for i, f, m in zip(k.tolist(), first.tolist(), n.tolist(), strict=True)], pa.binary()),
                )

    return run


def shard_windows(segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment number, start in it and group of every window of the segments; equal windows share a group."""
    data = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8)
    sizes = np.array([len(s) for s in segments])
    base = np.cumsum(sizes + 1) - sizes - 1
    text = np.empty(len(data) + 1, np.int32)
    text[:-1] = data
    text[:-1] += 2
    text[base + sizes] = 1
    text[-1] = 0
    sa = suffix_array(text)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    inside = np.arange(len(data)) - base[owner]
    left = np.append(sizes[owner] - inside, 0)
    apart = permuted_common_prefixes(text, sa, left)[sa] < length
    windows = left[sa] >= length
    places = sa[windows].astype(np.int64)
    return owner[places], inside[places], np.cumsum(apart)[windows]


_SPANS = "k bigint, f bigint, start bigint, stop bigint"


def _shards(length: int, shard_bytes: int):
    def settle(held):
        k, f, h, lo, seg = zip(*held, strict=True)
        k, f, lo = np.array(k), np.array(f), np.array(lo)
        owner, start, group = shard_windows(seg, length)
        k, f, at = k[owner], f[owner], lo[owner] + start
        order = np.lexsort((at, f, k, group))
        k, f, at, group = k[order], f[order], at[order], group[order]
        repeat = np.zeros(len(group), bool)
        repeat[1:] = group[1:] == group[:-1]
        k, f, at = k[repeat], f[repeat], at[repeat]
        order = np.lexsort((at, f, k))
        k, f, at = k[order], f[order], at[order]
        apart = (k[1:] != k[:-1]) | (f[1:] != f[:-1]) | (at[1:] > at[:-1] + 1)
        cut = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), apart]))
        ends = np.append(cut[1:], len(k))[: len(cut)] - 1
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (k[cut], f[cut], at[cut], at[ends] + length)], names=["k", "f", "start", "stop"])

    def run(batches):
        held, size, own, own_size = [], 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*KEY, "h", "lo", "seg")), strict=True):
                if own and own[-1][2] != row[2]:  # an anchor is complete
                    if held and size + own_size > shard_bytes:
                        yield settle(held)
                        held, size = [], 0
                    held, size, own, own_size = held + own, size + own_size, [], 0
                own.append(row)
                own_size += len(row[4])
        if held and size + own_size > shard_bytes:
            yield settle(held)
            held = []
        if held or own:
            yield settle(held + own)

    return run


def _kept(length: int):
    def run(batches):
        for batch, raw in steps(batches):
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")}
            for t, spans, copy in zip(raw, *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("spans", "copy")), strict=True):
                merged: list[list[int]] = []
                if copy > 1 and len(t) >= length:
                    merged.append([0, len(t)])
                else:
                    for a, b in sorted((x["start"], x["stop"]) for x in spans or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(t[at:a])
                    at = b
                kept.update(t[at:])
                out["n_bytes"].append(len(t))
                out["n_removed"].append(sum(b - a for a, b in merged))
                out["n_spans"].append(len(merged))
                out["kept_sha256"].append(kept.hexdigest())
                out["removed"].append([{"start": a, "stop": b} for a, b in merged])
            spans = pa.array(out.pop("removed"), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            digest = pa.array(out.pop("kept_sha256"), pa.string())
            yield rows(batch, ["doc_id"], **{k: pa.array(v, pa.int64()) for k, v in out.items()}, kept_sha256=digest, removed=spans)

    return run


#: Stands for a null doc_id in the order of documents.
LEAST = -(1 << 63)


def repeated_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document what is left without the bytes covered by a string of length bytes that starts earlier too.

    Earlier means in a document with a smaller doc_id, or before in the same one;
    overlaps count; strings are judged on the input and never cross documents. A null
    text is empty, a null doc_id comes before all others. Rows with one doc_id are
    documents of their own: different texts come in the order of their hashes, and of
    equal rows the first is judged and each other loses all its bytes, if it has length
    of them. Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and removed, the runs. Other columns are ignored; an empty table gives
    no rows.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    repeated = bool(source.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").take(1))
    source = source.select(
        "doc_id", F.coalesce(F.col("doc_id"), F.lit(LEAST)).alias("k"), (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("f"), "text"
    )
    order = ["h", "around", *KEY, "lo"]
    met_rows = lambda df, more="": staged(
        df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_met, f"k bigint, f bigint, h bigint, lo bigint, n int{more}, known boolean"), "anchors"
    )
    met = met_rows(source.drop("doc_id").mapInArrow(_runs(length, gram), "k bigint, f bigint, h bigint, around bigint, lo bigint, n int"))
    known = [met.where("known").select(*KEY, "lo", "n")]
    unsure = met.where("NOT known").groupBy(*KEY).agg(F.collect_list(F.struct("h", "lo", "n")).alias("runs"))
    columns = "k bigint, f bigint, h bigint, lo bigint, n int, at int, width int, seg binary"
    once = source.drop("doc_id").dropDuplicates(KEY) if repeated else source.drop("doc_id")
    left = staged(once.join(unsure, KEY).mapInArrow(_segments(length, gram), columns), "segments")
    whole = []
    while True:  # the anchors of each turn are longer, up to a whole window
        large = left.groupBy("h").agg(F.sum(F.length("seg")).alias("b"), F.max("width").alias("w")).where((F.col("b") > shard_bytes) & (F.col("w") < length))
        large = staged(large.select("h"), "large-anchors")
        if not large.take(1):
            break
        whole.append(left.join(large, "h", "left_anti").select(*KEY, "h", "lo", "seg"))
        cut = left.join(large, "h", "left_semi").select(*(c.split()[0] for c in columns.split(", "))).mapInArrow(_halves(length), columns.replace("h bigint,", "h bigint, around bigint,"))
        met = met_rows(cut, ", at int, width int, seg binary")
        known.append(met.where("known").select(*KEY, "lo", "n"))
        left = met.where("NOT known").drop("known")
    whole.append(left.select(*KEY, "h", "lo", "seg"))
    shards = reduce(DataFrame.unionByName, whole).repartition("h").sortWithinPartitions("h", *KEY, "lo")
    every = staged(shards.mapInArrow(_shards(length, shard_bytes), _SPANS), "spans")
    for df in known:
        every = every.union(df.select(*KEY, "lo", F.col("lo") + F.col("n") - 1 + length))
    per_doc = every.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    judged = source.join(per_doc, KEY, "left")
    copy = F.row_number().over(Window.partitionBy(*KEY).orderBy("doc_id")) if repeated else F.lit(1)
    return judged.select("doc_id", "text", "spans", copy.alias("copy")).mapInArrow(
        _kept(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start:bigint,stop:bigint>>"
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents")).drop("removed")
