"""Token ids of a public tokenizer, and exact counts for every context limit."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.llm.common import rows, steps, table, texts

#: White space beside white space: then words can't be encoded one by one.
_JOINED = re.compile(r"\s\s")
#: Words that one worker remembers.
_CACHE = 800_000
#: Characters below this one are classed alike by both libraries' patterns.
_LATIN = "\u0250"


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Byte-level BPE cuts a text before every single space and around every single line
    feed between other characters, so words are encoded one by one and remembered;
    other texts are encoded whole. If the same vocabulary in tiktoken's form lies
    beside the file, new Latin words are encoded with it, many in one call.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.begins = np.zeros(max(table.values()) + 1, bool)
            self.begins[[i for b, i in table.items() if b[:1] in (b" ", b"\n")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Remember words, each as it stands after a space, or by itself if it begins with a line feed."""
        plain, rest = [], []
        for w in words:
            (plain if self.fast and w and max(w) < _LATIN and not w[-1].isspace() else rest).append(w)
        whole = lambda w: w if w[:1] == "\n" else " " + w
        self.known.update(zip(rest, self._encode([whole(w) for w in rest]), strict=True))
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = np.asarray(self.fast.encode_ordinary("".join(map(whole, part))), "<u4")
            cuts = np.append(np.flatnonzero(self.begins[ids]), len(ids))
            if len(cuts) != len(part) + 1:
                raise ValueError("words and ids fell out of step")
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            self.known.update((w, raw[a:b]) for w, a, b in zip(part, cuts, cuts[1:], strict=False))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _CACHE:
            self.known, self.firsts = {}, {}
        cut = [None if _JOINED.search(t) else t.replace("\n", " \n").split(" ") for t in texts]
        self._learn(list(set().union(*(c for c in cut if c)) - self.known.keys()))
        new = list({c[0] for c in cut if c} - self.firsts.keys())
        self.firsts.update(zip(new, self._encode(new), strict=True))
        whole = iter(self._encode([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [next(whole) if c is None else self.firsts[c[0]] + b"".join(map(self.known.__getitem__, c[1:])) for c in cut]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder; what it remembers serves later tasks too."""
    return Encoder(path)


def _count(path: str):
    def run(batches):
        encode = encoder(path)
        for batch, raw in steps(batches):
            ids = encode([t.decode("utf-8", "replace") for t in raw])
            yield rows(batch, ["doc_id"], n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()))

    return run


def token_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens): the ids of each whole text, without special ones; null and empty texts have 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs, "doc_id").mapInArrow(_count(path or tokenizer_file()), f"doc_id {kind}, n_tokens bigint")


def length_histogram(lengths: DataFrame, per_block: int = 4096) -> DataFrame:
    """One row per occurring length, read as a context limit.

    n_docs documents have just this many tokens; docs_within and tokens_within count
    those of at most this length, docs_over and tokens_over the longer ones;
    tokens_truncated is the total if each text is cut at the limit; quantile is the
    share of documents within. Between two occurring limits a < b the truncated total
    is that of a plus (limit - a) * docs_over of a, and the other columns are those of
    a, so every context limit can be answered. Null lengths are ignored; an empty table
    gives no rows.

    Sums run inside blocks of per_block lengths, and over the blocks' totals, so no
    task holds all lengths.
    """
    hist = staged(
        lengths.where("n_tokens IS NOT NULL").groupBy(F.col("n_tokens").alias("context_limit")).agg(F.count("*").alias("n_docs"))
        .withColumn("block", F.floor(F.col("context_limit") / per_block)), "lengths",
    )
    total = hist.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("context_limit")).alias("tokens"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = total.select("block", F.coalesce(F.sum("docs").over(over), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("later_tokens"))
    whole = total.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    rest = Window.partitionBy("block").orderBy(F.desc("context_limit")).rowsBetween(Window.unboundedPreceding, -1)
    df = hist.join(later, "block").withColumns({
        "docs_over": F.col("later_docs") + F.coalesce(F.sum("n_docs").over(rest), F.lit(0)),
        "tokens_over": F.col("later_tokens") + F.coalesce(F.sum(F.col("n_docs") * F.col("context_limit")).over(rest), F.lit(0)),
    })
    return df.join(F.broadcast(whole)).select(
        "context_limit", "n_docs",
        (F.col("all_docs") - F.col("docs_over")).alias("docs_within"), "docs_over",
        (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_within"), "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("context_limit")).alias("tokens_truncated"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
