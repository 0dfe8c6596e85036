"""License scans: exact phrases, and short notices found with a bounded number of edits.

A notice of n characters may be matched with up to k errors (insertions, deletions, changes). It
is cut into k + 1 seeds: whatever the k errors touch, one seed stays exact (pigeonhole). An
automaton finds all seeds in one pass over the text; around each hit the notice must lie within a
known stretch, and there the regex library's bounded-error matching verifies it and gives its span.
Stretches of one notice that start close by are verified as one window of bounded length: its best
place first, then what is left on both sides of it. So a text full of seeds costs time in proportion
to its length. Of places that overlap, the one with fewer errors counts, then the earlier one.

The text searched is the text's words, lower-cased and joined by one space, so spacing and
punctuation never count as errors; spans are given in words.

Defined cases: null is the empty text, with no words; a very long text is scanned whole, in time in
proportion to its length; a phrase's places may overlap; repeated rows give repeated results; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, table, utf8, worker_cache

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices of well-known licenses, as their words run, and their labels.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("agpl", "gnu affero general public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("bsl", "distributed under the boost software license version 1 0"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights"),
    ("artistic", "the artistic license 2 0"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license"),
)
#: One error for so many characters of a notice, MAX_ERRORS at most.
PER_ERROR, MAX_ERRORS = 16, 5

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Hit(NamedTuple):
    label: str
    first_word: int
    last_word: int
    errors: int
    exact: bool


class Notice(NamedTuple):
    label: str
    text: str
    errors: int
    pattern: regex.Pattern


def _errors(text: str) -> int:
    return min(MAX_ERRORS, len(text) // PER_ERROR)


def _seeds(notice: Notice) -> list[tuple[int, str]]:
    """(offset, seed): errors + 1 pieces of nearly equal length."""
    n, parts = len(notice.text), notice.errors + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = [(f" {p} ".encode(), label, len(p.split())) for p, label in phrases.items()]
        self.notices = [Notice(label, t, k := _errors(t), regex.compile(f"(?b)(?:{regex.escape(t)}){{e<={k}}}")) for label, t in notices]
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list] = {}
        for number, notice in enumerate(self.notices):
            for at, seed in _seeds(notice):
                seeds.setdefault(seed, []).append((number, at))
        for seed, of in seeds.items():
            self.automaton.add_word(seed, (len(seed), of))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[Hit]]:
        """The number of words, and all places of phrases and notices."""
        words = text.translate(_WORDS).split()
        if not words:
            return 0, []
        line = b" " + b" ".join(words) + b" "
        hits = []
        for phrase, label, n in self.phrases:
            first, counted = -1, 0
            at = line.find(phrase)
            while at >= 0:
                first += line.count(b" ", counted, at + 1)
                counted = at + 1
                hits.append(Hit(label, first, first + n - 1, 0, True))
                at = line.find(phrase, at + 1)
        hits += self._fuzzy(line.decode("utf-8", "replace"))
        return len(words), hits

    def _fuzzy(self, line: str) -> list[Hit]:
        stretches: dict[int, set[tuple[int, int]]] = {}
        for end, (size, of) in self.automaton.iter(line):
            start = end - size + 1
            for number, at in of:
                notice = self.notices[number]
                low, high = start - at - notice.errors, start - at + len(notice.text) + notice.errors
                stretches.setdefault(number, set()).add((max(0, low), min(len(line), high)))
        starts = None
        out = []
        for number, of in stretches.items():
            for m in self._places(self.notices[number], line, sorted(of)):
                if starts is None:
                    starts = list(accumulate((len(w) + 1 for w in line[1:-1].split(" ")), initial=1))
                body = m[0]
                first = bisect_right(starts, m.start() + len(body) - len(body.lstrip(" "))) - 1
                last = bisect_right(starts, m.end() - 1 - (len(body) - len(body.rstrip(" ")))) - 1
                out.append(Hit(self.notices[number].label, max(0, first), max(0, last), sum(m.fuzzy_counts), False))
        return out

    @staticmethod
    def _places(notice: Notice, line: str, stretches: list[tuple[int, int]]) -> list[regex.Match]:
        """The notice's places in the given stretches (ascending), none over another."""
        windows: list[list[int]] = []
        for low, high in stretches:
            if windows and low <= windows[-1][0] + len(notice.text):
                windows[-1][1] = max(high, windows[-1][1])
            else:
                windows.append([low, high])
        found = []
        for window in windows:
            left = [tuple(window)]
            while left:
                low, high = left.pop()
                m = notice.pattern.search(line, low, high) if high - low >= len(notice.text) - notice.errors else None
                if m:
                    found.append(m)
                    left += [(low, m.start()), (m.end(), high)]
        out: list[regex.Match] = []
        for m in sorted(found, key=lambda m: m.span()):
            if not out or m.start() >= out[-1].end():
                out.append(m)
            elif sum(m.fuzzy_counts) < sum(out[-1].fuzzy_counts):
                out[-1] = m
        return out


def scanner() -> Scanner:
    return worker_cache("license scanner", Scanner)


_HITS = "array<struct<label:string,first_word:bigint,last_word:bigint,errors:int,exact:boolean>>"
_HIT_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("exact", pa.bool_())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and hits: an array of (label, first_word, last_word, errors, exact)."""

    def run(batches):
        s = scanner()
        for b in batches:
            found = [s.scan(t or b"") for t in utf8(b.column("text"))]
            yield batch(doc_id=b.column("doc_id"), n_words=pa.array([n for n, _ in found], pa.int64()), hits=pa.array([[h._asdict() for h in hits] for _, hits in found], _HIT_TYPE))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, n_words long, hits {_HITS}")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("hits", lambda h: h["exact"]))
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    starts = F.transform("base", lambda h: h["first_word"])
    # 1 for an exact phrase, less for each error of the best notice; 0 for no hit.
    best = F.array_max(F.transform("hits", lambda h: 1.0 / (1.0 + h["errors"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
