"""Alignment of two tokenizers' tokens over whole texts, and how often pairs of tokens end together in the corpus."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.llm.common import lists, rows, steps, table, texts
from ledgerscope.llm.tokens import encoder, tokenizer_file

#: The mark that the piece model puts for a space.
MARK = "▁"
#: Words that one worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 400_000, 64
#: Tokens of a lane.
LANE = 256


class Pieces:
    """Ids of texts under a sentencepiece model as little-endian unsigned 32-bit bytes.

    If no piece has a space after another character, or a line feed, texts are encoded
    by words, which are remembered: a word stands after its space, or after a line feed.
    Otherwise, and where white space meets white space, texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        plain = [p for i, p in enumerate(names) if not self.model.is_byte(i)]
        self.by_words = not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain) and [names[i] for i in self.model.encode("\n")] == [MARK, "<0x0A>"]
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]

    def _learn(self, words: list[str]) -> None:
        """A word that begins with a line feed is encoded after the model's own leading space, whose id is taken off."""
        self.known.update((w, x[4:] if w[:1] == "\n" else x) for w, x in zip(words, self._encode(words), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        apart = [self.by_words and bool(t) and not t.isspace() and MARK not in t and "  " not in t and t[0] not in " \n" and t[-1] not in " \n" and not any(x in t for x in (" \n", "\n ", "\n\n")) for t in texts]
        cut = [t.replace("\n", " \n").split(" ") if a else None for t, a in zip(texts, apart, strict=True)]
        new = list(set().union(*(c for c in cut if c)) - self.known.keys())
        self._learn(new)
        whole = iter(self._encode([t for t, c in zip(texts, cut, strict=True) if c is None]))
        out = [next(whole) if c is None else b"".join(map(self.known.__getitem__, c)) for c in cut]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return out


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def byte_level(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, whose characters stand for one byte each."""
    own = encoder(path)
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
    names = {i: t for t, i in own.tokenizer.get_vocab(with_added_tokens=True).items()}
    return [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))]


class Side:
    """Bytes of a vocabulary's tokens in one array, to spell ids out, and their decimal ids after a mark."""

    def __init__(self, spelled: list[bytes], marks: tuple[str, str]) -> None:
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.blank = np.array([x[:1] == b" " for x in spelled])
        self.named = [f"{m}{i}".encode() for m in marks for i in range(len(spelled))]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        shift = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.bytes[shift + np.arange(len(shift))]


@lru_cache(maxsize=1)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    return Side(byte_level(path_a), (";", ",")), Side(pieces(path_b).bytes, ("|", ","))


class Spelled:
    """Ids of some texts under one vocabulary: ids, ends in the joined bytes, first and last place of each text."""

    def __init__(self, side: Side, encoded: list[bytes]) -> None:
        self.side = side
        self.ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int64)
        self.last = np.cumsum([len(x) // 4 for x in encoded])
        self.first = self.last - [len(x) // 4 for x in encoded]
        self.ends = np.cumsum(side.size[self.ids])

    def n_bytes(self) -> np.ndarray:
        ends = np.concatenate([[0], self.ends])
        return ends[self.last] - ends[self.first]


def lanes(a: Spelled, b: Spelled, size: int = LANE) -> tuple[np.ndarray, ...]:
    """Ranges of tokens of a and b that are walked by themselves: whole texts, long ones cut where a token of either side begins with a space."""
    blank = np.flatnonzero(a.side.blank[a.ids])
    starts = a.ends[blank] - a.side.size[a.ids[blank]]
    there = np.searchsorted(b.ends, starts)  # the token of b that ends there
    met = (there < len(b.ends)) & (b.ends[np.minimum(there, len(b.ends) - 1)] == starts)
    blank, there = blank[met], there[met] + 1
    text = np.searchsorted(a.last, blank, "right")
    inner = blank > a.first[text]
    blank, there, text = blank[inner], there[inner], text[inner]
    turn = (blank - a.first[text]) // size
    new = np.concatenate([[True], (turn[1:] != turn[:-1]) | (text[1:] != text[:-1])])[: len(turn)] & (turn > 0)
    own = np.flatnonzero(a.last > a.first)
    a0, b0 = np.concatenate([a.first[own], blank[new]]), np.concatenate([b.first[own], there[new]])
    order = np.argsort(a0, kind="stable")
    a0, b0 = a0[order], b0[order]
    return a0, np.append(a0[1:], len(a.ids)), b0, np.append(b0[1:], len(b.ids))


def walk(a_ends: np.ndarray, b_ends: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray) -> np.ndarray:
    """For each token of a the token of b that ends with it, or -1.

    All lanes go in step: at each step the pointer of the side whose token ends first
    moves on, both where they end together, which is a link and a cut; lanes that are
    at their end leave the vectors.
    """
    link = np.full(len(a_ends), -1, np.int64)
    i, j, end = a0.copy(), b0.copy(), a1.copy()
    while len(i):
        x, y = a_ends[i], b_ends[j]
        tie = x == y
        link[i[tie]] = j[tie]
        i += x <= y
        j += y <= x
        on = i < end
        if not on.all():
            i, j, end = i[on], j[on], end[on]
    return link


def _aligned(path_a: str, path_b: str):
    def run(batches):
        encode_a, encode_b = encoder(path_a), pieces(path_b)
        side_a, side_b = sides(path_a, path_b)
        n_b = len(encode_b.bytes)
        for batch, raw in steps(batches):
            some = [i for i, t in enumerate(raw) if t]
            cut = [raw[i].decode("utf-8") for i in some]
            a, b = Spelled(side_a, encode_a([" " + t for t in cut])), Spelled(side_b, encode_b(cut))
            size = np.array([len(raw[i]) + 1 for i in some], np.int64)
            good = (a.n_bytes() == size) & (b.n_bytes() == size)
            if not good.all():  # spell the others by themselves, so that places agree
                ids_a, ids_b = a, b
                a, b = (Spelled(s.side, [s.ids[f:l].astype("<u4").tobytes() if g else b"" for f, l, g in zip(s.first, s.last, good, strict=True)]) for s in (ids_a, ids_b))
            truth = np.frombuffer(b"".join(b" " + raw[i] for i, g in zip(some, good, strict=True) if g), np.uint8)
            wrong = (side_a.spell(a.ids) != truth) | (side_b.spell(b.ids) != truth)
            if wrong.any():
                at = np.searchsorted(np.cumsum(np.where(good, size, 0)), np.flatnonzero(wrong), "right")
                good[at] = False
                a, b = (Spelled(s.side, [s.ids[f:l].astype("<u4").tobytes() if g else b"" for f, l, g in zip(s.first, s.last, good, strict=True)]) for s in (a, b))
            link = walk(a.ends, b.ends, *lanes(a, b)[:3]) if len(a.ids) else np.zeros(0, np.int64)
            met = np.flatnonzero(link >= 0)
            text = np.searchsorted(a.last, met, "right")
            n_links = np.bincount(text, minlength=len(some))
            # A token's group is the number of cuts before it; a group's tokens of a come before those of b.
            group_a = np.cumsum(link >= 0) - (link >= 0)
            met_b = link[met]
            group_b = np.searchsorted(met_b, np.arange(len(b.ids)), "left")
            ends_a, ends_b = np.concatenate([[0], met + 1]), np.concatenate([[0], met_b + 1])
            begins_a, begins_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
            begins_a[ends_a[:-1]] = begins_b[ends_b[:-1]] = True
            order = np.empty(len(a.ids) + len(b.ids), np.int64)
            place_a = np.arange(len(a.ids)) + ends_b[group_a]
            place_b = np.arange(len(b.ids)) + ends_a[group_b + 1]
            order[place_a] = a.ids + np.where(begins_a, 0, len(side_a.size))
            order[place_b] = b.ids + np.where(begins_b, 0, len(side_b.size)) + len(side_a.named)
            names = side_a.named + side_b.named
            spelled = list(map(names.__getitem__, order.tolist()))
            digests = [hashlib.sha256(b"".join(spelled[f:l])[1:]).hexdigest() if l > f else "" for f, l in zip(a.first + b.first, a.last + b.last, strict=True)]
            pair = a.ids[met] * n_b + b.ids[met_b]
            by = np.lexsort((pair, text))
            pair, text = pair[by], text[by]
            new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])])[: len(pair)])
            times, pair, text = np.diff(np.append(new, len(by))), pair[new], text[new]
            full = lambda x: np.bincount(some, x, minlength=len(raw)).astype(np.int64) if some else np.zeros(len(raw), np.int64)
            digest = np.full(len(raw), "", object)
            digest[some] = digests
            per = full(np.bincount(text, minlength=len(some)))
            yield rows(
                batch, batch.schema.names[:-1], n_a=full(a.last - a.first), n_b=full(b.last - b.first), n_groups=full(n_links), n_links=full(n_links),
                groups_sha256=pa.array(digest.tolist(), pa.string()), pairs=lists(pair, per), times=lists(times.astype(np.int64), per),
            )

    return run


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of docs (doc_id, text): tokens, groups and links, a digest of the groups, and the distinct linked pairs with their times.

    A pair is the id of A times the size of B's vocabulary, plus the id of B. Texts that
    are null, empty, or not spelled by both sides have no tokens.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs, "doc_id").mapInArrow(_aligned(path_a, path_b), f"doc_id {kind}, {ALIGNED}")


def _counted(most: int):
    def run(batches):
        pair, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def merged():
            p, t = np.concatenate(pair), np.concatenate(times)
            names, place = np.unique(p, return_inverse=True)
            return [names], [np.bincount(place, t, minlength=len(names)).astype(np.int64)]

        held = 0
        for batch in batches:
            pair.append(np.asarray(batch.column(0).flatten()))
            times.append(np.asarray(batch.column(1).flatten()))
            held += len(pair[-1])
            if held > most:
                pair, times = merged()
                held = 0
                if len(pair[0]) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(times[0])], names=["pair", "count"])
                    pair, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pair, times = merged()
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(times[0])], names=["pair", "count"])

    return run


def pair_counts(links: DataFrame, n_b: int, most: int = 2_000_000) -> DataFrame:
    """Rows (pair, count, best) of aligned(): how many links hold the pair, and whether no other pair of its B id has more.

    A task adds up at most some most pairs before they are shuffled.
    """
    counts = staged(links.select("pairs", "times").mapInArrow(_counted(most), "pair bigint, count bigint").groupBy("pair").agg(F.sum("count").alias("count")), "pairs")
    id_b = F.pmod(F.col("pair"), F.lit(n_b))
    top = counts.groupBy(id_b.alias("b")).agg(F.max("count").alias("top"))
    return staged(counts.join(top, id_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "pair-counts")


def _summed(pair: np.ndarray, count: np.ndarray, best: np.ndarray):
    def run(batches):
        for batch in batches:
            pairs, times = batch.column(batch.schema.get_field_index("pairs")), np.asarray(batch.column(batch.schema.get_field_index("times")).flatten())
            at = np.searchsorted(pair, np.asarray(pairs.flatten()))
            ends = np.concatenate([[0], np.cumsum(np.asarray(pairs.value_lengths()))])
            sums = (np.concatenate([[0], np.cumsum(times * x[at])]) for x in (best, count))
            n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            yield rows(batch, batch.schema.names[:-2], n_best=n_best, count_sum=count_sum)

    return run


def token_alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, broadcast_pairs: int = 4_000_000) -> DataFrame:
    """Per row of docs: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of its whole text.

    n_best counts the links whose pair is the most frequent one of its B id in the corpus,
    count_sum adds up the pairs' counts. The counts of all pairs go to every task if they
    are at most broadcast_pairs, 17 bytes each; more are joined. Rows are independent, so
    repeated and null doc_ids stay as they are; an empty table gives no rows.
    """
    path_a, path_b = path_a or tokenizer_file(), path_b or tokenizer_file("piece_bpe_32k.model")
    links = staged(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "links")
    counts = pair_counts(links, len(pieces(path_b).bytes))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    if counts.count() <= broadcast_pairs:
        own = counts.orderBy("pair").toArrow()
        arrays = [own.column(c).to_numpy() for c in ("pair", "count", "best")]
        out = links.select(*kept, "groups_sha256", "pairs", "times").mapInArrow(_summed(*arrays), f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    else:
        each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times").join(counts, F.col("pairs") == F.col("pair"))
        sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
        out = links.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
    return out.select(*kept, "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))
