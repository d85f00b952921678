"""Licence notices in texts: chains of long matches with known notices, found by a suffix automaton of their words."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import rows, steps, table, texts
from ledgerscope.llm.lexical import TERMS, split

#: Phrases whose places are counted, and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Notices of public licences and common statements of them, in lower case without punctuation, by label.
NOTICES = [
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "licensed under the bsd license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "licensed under the gnu general public license version 2"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-notice", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-notice", "licensed under cc by 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
]
#: Words of the shortest match that counts, the most words between two matches of a chain, and the words that make a chain of a long notice a find.
SHORTEST, GAP, ENOUGH = 3, 16, 24
#: The share of a shorter notice that a chain must cover.
SHARE = 0.8


class SuffixAutomaton:
    """All runs of words of some notices; a state's ends are the (notice, last word) places of its runs."""

    def __init__(self, notices: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(notices):
            state = 0
            for place, word in enumerate(words):
                state = self._extended(state, word)
                self.ends[state].add((k, place))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, before: int, word: int) -> int:
        """The state of the run of before and word, made from a longer one if need be."""
        there = self.next[before][word]
        if self.length[there] == self.length[before] + 1:
            return there
        own = self._state(self.length[before] + 1, self.link[there], dict(self.next[there]))
        self.link[there] = own
        while before >= 0 and self.next[before].get(word) == there:
            self.next[before][word] = own
            before = self.link[before]
        return own

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        own = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = own
            last = self.link[last]
        if last >= 0:
            self.link[own] = self._split(last, word)
        return own

    def statistics(self, words: list[int]):
        """For each word the length of the longest run of a notice that ends with it, and that run's state."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield length, state


class Notices:
    """Word numbers, notices and their automaton."""

    def __init__(self, notices: list[tuple[str, str]]) -> None:
        cut = [text.encode().split() for _, text in notices]
        phrases = [p.encode().split() for p, _ in PHRASES]
        words = sorted(set(chain(*cut, *phrases)))
        self.number = {w: i for i, w in enumerate(words)}
        self.labels = [label for label, _ in notices]
        self.sizes = [len(c) for c in cut]
        self.used = np.zeros(len(words) + 1, bool)  # the last is that of unknown words
        self.used[[self.number[w] for c in cut for w in c]] = True
        self.automaton = SuffixAutomaton([[self.number[w] for w in c] for c in cut])
        self.phrases = [[self.number[w] for w in p] for p in phrases]

    def least(self, k: int) -> int:
        return min(ENOUGH, -int(-SHARE * self.sizes[k] // 1))


@lru_cache(maxsize=4)
def notices(own: tuple[tuple[str, str], ...]) -> Notices:
    return Notices(list(own))


def matches(known: Notices, ids: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Longest matches of at least SHORTEST words as (text, notice, first word, first word of the notice, words), by place.

    Only runs of words that notices hold are streamed through the automaton; shorter
    ones can't hold a match. A match counts where it can't be made longer.
    """
    inside, new = known.used[ids], np.append(True, text[1:] != text[:-1])[: len(ids)]
    begins = np.flatnonzero(inside & (new | ~np.append(False, inside[:-1])[: len(ids)]))
    ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)[: len(ids)]) + 1
    out = []
    for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
        if z - a < SHORTEST:
            continue
        before, state = 0, 0
        for i, (length, now) in enumerate(chain(known.automaton.statistics(ids[a:z].tolist()), [(0, 0)])):
            if before >= SHORTEST and length != before + 1:
                last = a + i - 1
                out += [(int(text[a]), k, last - before + 1, e - before + 1, before) for k, e in sorted(known.automaton.ends[state])]
            before, state = length, now
    return out


def chained(found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Chains (first word, last word, words covered) of one notice's matches (first word, first word of the notice, words) in one text.

    In a chain both places grow and at most GAP words lie between two matches; what
    overlaps counts once. The best chain of a stretch is taken, then those before and after it.
    """
    found = sorted(found)
    out, stretches, far = [], [], -GAP - 1
    for f, t, n in found:
        if f - far > GAP:
            stretches.append([])
        stretches[-1].append((f, t, n))
        far = max(far, f + n)
    while stretches:
        own = stretches.pop()
        covered, back = [n for _, _, n in own], [-1] * len(own)
        for j, (f, t, n) in enumerate(own):
            for i in range(j - 1, -1, -1):
                g, u, m = own[i]
                if f - g > size + GAP:  # a match is no longer than its notice
                    break
                new = n - max(0, g + m - f, u + m - t)
                if f + n > g + m and t > u and f > g and f - g - m <= GAP and new > 0 and covered[i] + new > covered[j]:
                    covered[j], back[j] = covered[i] + new, i
        end = max(range(len(own)), key=covered.__getitem__)
        first = end
        while back[first] >= 0:
            first = back[first]
        a, z = own[first][0], own[end][0] + own[end][2]
        out.append((a, z - 1, min(covered[end], size)))
        stretches += [s for s in ([x for x in own if x[0] + x[2] <= a], [x for x in own if x[0] >= z]) if s]
    return sorted(out)


def spans_of(known: Notices, ids: np.ndarray, text: np.ndarray) -> list[tuple[int, str, int, int, float, bool]]:
    """Covered spans of all notices as (text, label, first word, last word, share of the notice, whether it is a find)."""
    by: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for t, k, f, u, n in matches(known, ids, text):
        by.setdefault((t, k), []).append((f, u, n))
    return [(t, known.labels[k], f, z, n / known.sizes[k], n >= known.least(k)) for (t, k), own in by.items() for f, z, n in chained(own, known.sizes[k])]


def _scan(own: tuple[tuple[str, str], ...]):
    def run(batches):
        known = notices(own)
        unknown = len(known.number)
        named = [label for _, label in PHRASES]
        for batch, raw in steps(batches):
            parts, counts = [], []
            for t in raw:
                n = 0
                for words in split(t, TERMS):
                    parts.append(np.fromiter((known.number.get(w, unknown) for w in words), np.int32, len(words)))
                    n += len(words)
                counts.append(n)
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            counts = np.array(counts, np.int64)
            begins = np.cumsum(counts) - counts
            text = np.repeat(np.arange(len(raw)), counts)
            place = np.arange(len(ids)) - begins[text]
            labels: list[set[str]] = [set() for _ in raw]
            n_base, first, last = np.zeros(len(raw), np.int64), np.full(len(raw), np.iinfo(np.int64).max), np.full(len(raw), -1)
            for phrase, label in zip(known.phrases, named, strict=True):
                at = np.flatnonzero(ids[: len(ids) - len(phrase) + 1] == phrase[0]) if len(ids) >= len(phrase) else np.zeros(0, int)
                for j, w in enumerate(phrase[1:], 1):
                    at = at[ids[at + j] == w]
                at = at[place[at] + len(phrase) <= counts[text[at]]]
                n_base += np.bincount(text[at], minlength=len(raw))
                np.minimum.at(first, text[at], place[at])
                np.maximum.at(last, text[at], place[at])
                for t in np.unique(text[at]).tolist():
                    labels[t].add(label)
            base = [",".join(sorted(x)) for x in labels]
            score, spans = np.zeros(len(raw)), [[] for _ in raw]
            for t, label, f, z, share, is_find in spans_of(known, ids, text):
                score[t] = max(score[t], share)
                if is_find:
                    labels[t].add(label)
                    spans[t].append({"label": label, "first_word": f - int(begins[t]), "last_word": z - int(begins[t]), "share": share})
            none = n_base == 0
            yield rows(
                batch, batch.schema.names[:-1], n_words=counts, n_base=n_base, first_word=pa.array(first, mask=none), last_word=pa.array(last, mask=none),
                base_labels=pa.array(base, pa.string()), labels=pa.array([",".join(sorted(x)) for x in labels], pa.string()), score=score,
                spans=pa.array([sorted(x, key=lambda s: (s["first_word"], s["last_word"], s["label"])) for x in spans], pa.list_(pa.struct({"label": pa.string(), "first_word": pa.int64(), "last_word": pa.int64(), "share": pa.float64()}))),
            )

    return run


SCANNED = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first_word: bigint, last_word: bigint, share: double>>"


def license_scan(docs: DataFrame, own: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): words, places of the fixed phrases, and licence notices in the whole text.

    A text is streamed through the suffix automaton of the notices (NOTICES, or own pairs
    of label and text), which tells for each word the longest run of a notice that ends
    there. Matches of SHORTEST words or more are chained; a chain that covers SHARE of its
    notice, or ENOUGH words, adds the notice's label and a span. score is the largest share
    of a notice that a chain covers, 0 without one. Rows are independent: null texts have
    no words, repeated and null doc_ids stay, an empty table gives no rows. A task holds
    four bytes for each word of a text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs, "doc_id").mapInArrow(_scan(tuple(own or NOTICES)), f"doc_id {kind}, {SCANNED}")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of all documents; the last column states the spans as label:first:last."""
    told = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first_word"].cast("string"), s["last_word"].cast("string")))
    return license_scan(table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(told, ","))
