"""Packing of documents into token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.llm.common import rows, steps, table, taken, texts
from ledgerscope.llm.tokens import encoder, tokenizer_file

CAPACITY, END_ID, GROUP = 1024, 2, 64_000


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of n ids: all of capacity but the first, which may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _cut(path: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = encoder(path)
        for batch, raw in steps(batches):
            which, out = [], {k: [] for k in ("piece", "start", "length", "ids_crc32")}
            for k, ids in enumerate(encode([t.decode("utf-8", "replace") for t in raw])):
                ids += end
                for i, (s, n) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    which.append(k)
                    out["piece"].append(i)
                    out["start"].append(s)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
            yield rows(taken(batch, which, "doc_id"), ["doc_id"], piece=pa.array(out.pop("piece"), pa.int32()), **{k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


class Packing:
    """Bins of item numbers under a capacity, with the open bins filed by free space."""

    def __init__(self, size: list[int], capacity: int) -> None:
        self.size, self.capacity = size, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def file(self, b: int) -> None:
        if f := self.free[b]:
            self.open[f].append(b)
            self.mask |= 1 << f

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(items)
        self.free.append(self.capacity - sum(self.size[i] for i in items))
        self.file(len(self.bins) - 1)

    def best_fit(self, items: list[int]) -> None:
        for i in items:
            s = self.size[i]
            if fits := self.mask >> s << s:
                f = (fits & -fits).bit_length() - 1
                b = self.open[f].pop()
                if not self.open[f]:
                    self.mask ^= 1 << f
                self.bins[b].append(i)
                self.free[b] -= s
                self.file(b)
            else:
                self.add_bin([i])

    def worth(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.bins), sum(((self.capacity - f) / self.capacity) ** 2 for f in self.free)


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """Inject well-filled bins of b whole into a, drop a's bins that share items, best-fit what that displaces."""
    good = sorted(range(len(b.bins)), key=lambda k: b.free[k])[: max(1, len(b.bins) // 2)]
    injected = [b.bins[k] for k in rng.sample(good, max(1, len(good) // 2))]
    taken = {i for items in injected for i in items}
    child = Packing(a.size, a.capacity)
    for items in injected:
        child.add_bin(list(items))
    displaced = []
    for items in a.bins:
        if taken.isdisjoint(items):
            child.add_bin(list(items))
        else:
            displaced += [i for i in items if i not in taken]
    child.best_fit(sorted(displaced, key=lambda i: (-a.size[i], i)))
    return child


def least_bins(size: list[int], capacity: int) -> int:
    """No packing has fewer bins: for every k, items above half fill bins of their own, and those from k to half fit only beside such as leave k."""
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    count = np.cumsum(np.bincount(size, minlength=capacity + 1))
    total = np.cumsum(np.bincount(size, size, capacity + 1).astype(np.int64))
    room = (count[capacity - k] - count[half]) * capacity - (total[capacity - k] - total[half])
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    return int((count[-1] - count[half] + np.maximum(0, -(-(small - room) // capacity))).max())


def packed(size: list[int], capacity: int, bins: list[int]) -> Packing:
    """A packing from the bin number of every item."""
    items: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        items.setdefault(b, []).append(i)
    one = Packing(size, capacity)
    for x in items.values():
        one.add_bin(x)
    return one


def best_fit_decreasing(size: list[int], capacity: int, rng: random.Random | None = None) -> Packing:
    """Best fit of the items from large to small; with rng their sizes are blurred for the order."""
    one = Packing(size, capacity)
    one.best_fit(sorted(range(len(size)), key=lambda i: (-size[i] * (rng.uniform(0.8, 1.2) if rng else 1), i)))
    return one


def evolve(size: list[int], capacity: int, seed: int, given: list[Packing] = (), population: int = 6, generations: int = 24) -> Packing:
    """The best packing found from the given ones, best fit and blurred best fits; stops at once with the least bins there can be."""
    rng = random.Random(seed)
    least = least_bins(size, capacity)
    people = list(given) or [best_fit_decreasing(size, capacity)]
    for k in range(population):
        if max(len(x.bins) for x in people) <= least or len(people) >= population:
            break
        people.append(best_fit_decreasing(size, capacity, rng))
    worth = [x.worth() for x in people]
    top = max(worth)
    best = people[worth.index(top)]
    for _ in range(generations):
        if len(best.bins) <= least or len(people) < 2:
            break
        a, b = rng.sample(range(len(people)), 2)
        child = crossover(people[a], people[b], rng)
        value, worst = child.worth(), worth.index(min(worth))
        if value > worth[worst]:
            people[worst], worth[worst] = child, value
        if value > top:
            best, top = child, value
    return best


def _first(capacity: int):
    """A group's best fit, and by how many bins it may be improved."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "u"], ascending=[False, True]).reset_index(drop=True)
        size = df["length"].tolist()
        return _placed(df, best_fit_decreasing(size, capacity), least_bins(size, capacity))

    return run


def _placed(df: pd.DataFrame, best: Packing, least: int) -> pd.DataFrame:
    bins, offsets, left, first = [0] * len(df), [0] * len(df), [0] * len(df), [0] * len(df)
    u = df["u"].tolist()
    for k, items in enumerate(best.bins):
        at, low = 0, min(u[i] for i in items)
        for i in items:
            bins[i], offsets[i], left[i], first[i] = k, at, best.free[k], low
            at += best.size[i]
    return df.assign(bin=bins, offset=offsets, left=left, first=first, bins=len(best.bins), over=len(best.bins) - least)[_columns(_PLACED)]


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_PLACED = "grp bigint, island int, u bigint, length bigint, bin int, offset bigint, left int, first bigint, bins int, over int"


def _island(capacity: int, epoch: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "u"], ascending=[False, True]).reset_index(drop=True)
        size = df["length"].tolist()
        given = [packed(size, capacity, df[c].tolist()) for c in ("bin", "guest") if df[c].notna().all()]
        seed = hash((int(df["grp"].iloc[0]), int(df["island"].iloc[0]), epoch)) & 0xFFFFFFFF
        return _placed(df, evolve(size, capacity, seed, given), least_bins(size, capacity))

    return run


def evolved(first: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """Groups of pieces with a better packing where islands find one.

    Each island evolves all pieces of its group by itself; after each epoch its best
    packing, the elite, migrates to the next island of the ring and joins its population.
    """
    state = first.drop("island").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("guest", F.lit(None).cast("int"))
    for epoch in range(epochs):
        state = staged(state.groupBy("grp", "island").applyInPandas(_island(capacity, epoch), _PLACED), "islands")
        if epoch + 1 < epochs:
            elite = state.select("grp", ((F.col("island") + 1) % islands).alias("island"), "u", F.col("bin").alias("guest"))
            state = state.join(elite, ["grp", "island", "u"])
    best = state.groupBy("grp").agg(F.min(F.struct("bins", "island")).alias("b")).select("grp", F.col("b.island").alias("island"))
    return state.join(best, ["grp", "island"])


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every document: its ids, then end_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs, "doc_id").mapInArrow(
        _cut(path or tokenizer_file(), capacity, end_id), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    ).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = 3, epochs: int = 2) -> DataFrame:
    """pieces with sequence_id and offset: sequences of at most capacity tokens, gapless from 0.

    A full piece is a sequence of its own. The others are numbered and dealt by the hash
    of their number to groups of about group pieces. A group is packed by best fit; where
    that may have more bins than needed, islands evolve the pieces of its open bins and
    of a quarter of its full ones, and leave the other full bins be. Bins of which more than
    half is full are settled; the pieces of the others, at most one or two bins a group,
    are dealt anew to fewer groups, until one holds them. A sequence bears the number of
    one of its pieces, so no two are alike. Repeated and null doc_ids are packed each; an
    empty table gives no rows.
    """
    columns = pieces.columns
    pieces = staged(pieces.select(F.struct(*columns).alias("p"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("u")), "pieces")
    done = [pieces.where(F.col("length") >= capacity).select("u", F.col("u").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.where(F.col("length") < capacity).select("u", "length")
    n = rest.count()
    for turn in range(1, 1 << 20):
        if not n:
            break
        groups = math.ceil(n / group)
        dealt = rest.select("u", "length", F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(groups)).alias("grp"), F.lit(0).alias("island"))
        placed = staged(dealt.groupBy("grp").applyInPandas(_first(capacity), _PLACED), "groups")
        short = placed.where("over > 0")
        if short.take(1):
            mixed = (F.col("left") > 0) | (F.pmod(F.xxhash64("first"), F.lit(4)) == 0)
            better = evolved(short.where(mixed), capacity, islands, epochs)
            placed = staged(placed.where("over = 0").unionByName(short.where(~mixed)).unionByName(better), "evolved")
        settled = placed.where(F.col("left") * 2 < capacity) if groups > 1 else placed
        done.append(settled.select("u", F.col("first").alias("sequence_id"), "offset"))
        rest = placed.select("u", "length", "left").join(settled.select("u"), "u", "left_anti").select("u", "length")
        n = rest.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return pieces.join(out, "u").select("p.*", "sequence_id", "offset")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents")))
