"""Helpers shared by the corpus operators: Arrow batches, words and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged

#: Bytes of text that one step of a vectorised task holds; a longer text is a step of its own.
STEP_BYTES = 1 << 20

#: The ASCII white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and the text, null as empty; other columns are left out."""
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))


def numbered(docs: DataFrame, *columns) -> DataFrame:
    """The columns of every row with a number of its own (row), written once so that it stays."""
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "rows")


def own_rows(docs: DataFrame, *columns, key: str = "doc_id") -> DataFrame:
    """The columns of every row with a number of its own (row): its key where no key is null or repeated, else one that is written."""
    if docs.groupBy(F.col(key).cast("long").alias("own")).agg(F.count("*").alias("c")).where("c > 1 OR own IS NULL").take(1):
        return numbered(docs, *columns)
    return docs.select(F.col(key).cast("long").alias("row"), *columns)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about limit bytes of text, each with its texts as bytes, null as empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset + 1 : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            base = ends[at - 1] if at else (ends[0] - len(column[0].as_py()))
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at), column.slice(at, to - at).to_pylist()
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of MULTIPLIER and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
                for base in (MULTIPLIER, INVERSE)
            )
        return self.up, self.down


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * MULTIPLIER**i before each place, modulo 2**64."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they are."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


class Words:
    """The words of some texts: start and end in the joined bytes, text number, 64-bit hash."""

    def __init__(self, texts: list[bytes], space: np.ndarray = SPACE) -> None:
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = ~space[self.data]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = turns[::2], turns[1::2]
        self.text = np.searchsorted(ends, self.start, "left")
        self.hash = span_hashes(prefix_sums(self.data), self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        self.per_text = np.bincount(self.text, minlength=len(texts))


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of all runs of size words; a shorter text has one run, of all its words."""
    n = len(words.hash)
    first = np.concatenate([[0], np.cumsum(words.per_text)[:-1]]) if len(words.per_text) else np.zeros(0, int)
    left = (first + words.per_text)[words.text] - np.arange(n) if n else np.zeros(0, int)
    total = np.zeros(n, np.uint64)
    padded = np.concatenate([words.hash, np.zeros(size, np.uint64)])
    for j in range(size):
        total = total * np.uint64(MULTIPLIER) + np.where(left > j, padded[j : j + n], np.uint64(j + 1))
    starts = (left >= size) | ((words.per_text[words.text] < size) & (left == words.per_text[words.text]))
    return words.text[starts], mix(total[starts])


def rows(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """The kept columns of batch with new ones."""
    arrays = [batch.column(batch.schema.get_field_index(k)) for k in keep]
    return pa.RecordBatch.from_arrays([*arrays, *(v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values())], names=[*keep, *columns])


def taken(batch: pa.RecordBatch, at, *keep: str) -> pa.RecordBatch:
    """The kept columns of batch at the given places; texts, which are long, are not repeated."""
    return batch.select(list(keep)).take(pa.array(at, pa.int64()))


def lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the count of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
