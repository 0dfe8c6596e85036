"""Spelling variants: words of one edit, by dynamic programming over sorted lists.

Words are grouped so that any two that are one edit apart meet in exactly one group, in which they
share letters at the start or the end. Two near words whose shorter has m code points have a common
prefix of i code points, and, after the edit, a common suffix of m - 1 - i at least. A window
[lo, hi) of values of i therefore gives a key: the first lo and the last m - hi code points. Each
word goes to the two halves of 0..m, for m its own length and one less. A group of more than
``CROWDED`` words is cut into the halves of its window, again and again; at a window of one value
all words of a group are near one another, but for the two letters that may differ.

A task gets groups as sorted lists of words. Neighbours' longest common prefixes (LCPs) say which
stretches of a list share a prefix; for each such prefix the banded rows (three cells) of the edit
matrices against all words still in reach are worked out once and serve the whole stretch. A
stretch is skipped for a word whose row exceeds one edit. Rows are worked out prefix length by
prefix length, for all words and stretches of some lists at once.

Groups hold a bounded number of words: each falls apart at a window of one value, where only
letters in two places differ. Words travel four times; pairs are counted where they are found, and
a word sends on one row for each group in which it has near words.

Defined cases: a null text has no words; a null doc_id counts as the empty text in ``<doc_id>:``;
repeated rows count again; words of any length are compared whole; further columns are ignored; an
empty table gives an empty result. Ties go to the word that is first in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, discard, map_arrow, materialise, table, utf8

MIN_LENGTH = 7
MIN_COUNT = 2
DROP = 31
RATIO = 10
#: Words of a group beyond which it is cut, and words whose lists are worked on at once.
CROWDED, AT_ONCE = 8192, 16_384
#: Queries whose rows are held at once, and distinct words that a task holds before it sends counts on.
QUERIES, HOLD = 4096, 300_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile("[a-zÀ-ÿ]+")


def _words(batches):
    held: Counter = Counter()

    def sent():
        out = batch(word=pa.array(list(held), pa.string()), n=pa.array(list(held.values()), pa.int64()))
        held.clear()
        return out

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text"))):
            runs = Counter(w for w in _RUN.findall((text or b"").translate(_LOWER).decode()) if len(w) >= MIN_LENGTH)
            start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for word, n in runs.items():
                h = zlib.crc32(word.encode(), start)
                if h % DROP == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < MIN_LENGTH:
                        continue
                held[word] += n
            if len(held) >= HOLD:
                yield sent()
    if held:
        yield sent()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least MIN_LENGTH code points and MIN_COUNT occurrences."""
    counted = map_arrow(docs.select("doc_id", "text"), _words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of each row's window: the letters that two near words with it share for sure."""
    prefix = F.expr("left(word, lo)")
    suffix = F.expr("right(word, greatest(m - hi, 0))")
    return rows.withColumn("key", F.xxhash64(prefix, suffix))


_GROUP = ["m", "lo", "hi", "key"]


def _windows(words: DataFrame, crowded: int) -> DataFrame:
    """word, n, m, lo, hi, key: every word in its groups, none of which is crowded."""
    lengths = F.array_compact(F.array(F.length("word"), F.when(F.length("word") > MIN_LENGTH, F.length("word") - 1)))
    at = words.select("word", "n", F.explode(lengths).alias("m"))
    half = F.expr("m div 2").cast("int")
    ends = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")))
    rows = _keyed(at.select("word", "n", "m", F.explode(ends).alias("w")).select("word", "n", "m", "w.*"))
    done = None
    while True:
        sizes = rows.groupBy(*_GROUP).count()
        big = materialise(sizes.where((F.col("count") > crowded) & (F.col("hi") - F.col("lo") > 1)).drop("count"), "spelling-crowded")
        if big.isEmpty():
            return done.unionByName(rows) if done is not None else rows
        few = rows.join(big, _GROUP, "left_anti")
        done = done.unionByName(few) if done is not None else few
        middle = F.expr("(lo + hi) div 2").cast("int")
        ends = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
        cut = rows.join(big, _GROUP, "left_semi").select("word", "n", "m", F.explode(ends).alias("w"))
        rows = _keyed(materialise(cut.select("word", "n", "m", "w.*"), "spelling-cut"))


class _Lists:
    """Sorted lists of words as one array of code points, with the LCP of each word and the one before
    (-1 at the start of a list)."""

    def __init__(self, spelt: list[str], starts: np.ndarray):
        self.length = np.array([len(w) for w in spelt], np.int64)
        self.start = np.concatenate([[1], 1 + np.cumsum(self.length[:-1] + 3)]).astype(np.int64)
        self.points = np.frombuffer(("\0" + "\0\0\0".join(spelt) + "\0\0\0").encode("utf-32-le"), np.uint32)
        self.lcp = np.full(len(spelt), -1, np.int64)
        alike, d = np.setdiff1d(np.arange(1, len(spelt)), starts), 0
        while len(alike):
            same = (self.points[self.start[alike] + d] == self.points[self.start[alike - 1] + d]) & (self.length[alike] > d) & (self.length[alike - 1] > d)
            self.lcp[alike[~same]] = d
            alike, d = alike[same], d + 1

    def near(self, queries: np.ndarray, list_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) of the same list that are exactly one edit apart."""
        live = np.arange(len(self.length))  # the words that reach over the prefix
        node = list_of  # of each live word: the number of the stretch that shares its first d letters
        at, query = list_of[queries], queries  # a stretch and a query: the rows being worked on
        left, same, right = (np.full(len(queries), v, np.int8) for v in (2, 0, 1))
        found_q, found_w, d = [], [], 0
        while len(query):
            keep = self.length[live] > d
            live, node = live[keep], node[keep]
            if not len(live):
                break
            first = np.flatnonzero(self.lcp[live] <= d)  # where a stretch of one letter more starts
            parent = node[first]
            count = np.bincount(parent, minlength=int(at.max()) + 1)
            begin = np.cumsum(count) - count
            below = count[at]
            total = int(below.sum())
            if not total:
                break
            row = np.repeat(np.arange(len(query)), below)
            child = begin[at[row]] + (np.arange(total) - np.repeat(np.cumsum(below) - below, below))
            head = live[first]
            letter = self.points[self.start[head] + d][child]
            place = self.start[query[row]] + d
            new_left = np.minimum(left[row] + (self.points[place - 1] != letter), same[row] + 1)
            new_same = np.minimum(np.minimum(same[row] + (self.points[place] != letter), right[row] + 1), new_left + 1)
            new_right = np.minimum(right[row] + (self.points[place + 1] != letter), new_same + 1)
            within = np.flatnonzero(np.minimum(np.minimum(new_left, new_same), new_right) <= 1)
            at, query = child[within], query[row[within]]
            left, same, right = (np.minimum(x[within], 2).astype(np.int8) for x in (new_left, new_same, new_right))
            d += 1
            ends = np.flatnonzero(self.length[head[at]] == d)  # the stretch's first word is the prefix itself
            over = self.length[query[ends]] - d
            cell = np.where(over == 0, same[ends], np.where(over < 0, left[ends], right[ends]))
            hit = ends[(cell == 1) & (np.abs(over) <= 1)]
            found_q.append(query[hit])
            found_w.append(head[at[hit]])
            node = np.cumsum(self.lcp[live] < d) - 1
        none = [np.zeros(0, np.int64)]
        return np.concatenate(found_q or none), np.concatenate(found_w or none)

    def common(self, a: np.ndarray, b: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """The common prefixes' lengths of the words that a and b spell (from their ends, if backward)."""
        out, rest, d = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(rest):
            place = [np.where(backward[rest], self.length[x[rest]] - 1 - d, d) for x in (a, b)]
            inside = (self.length[a[rest]] > d) & (self.length[b[rest]] > d)
            p, q = (self.points[self.start[x[rest]] + np.where(inside, y, 0)] for x, y in zip((a, b), place))
            same = inside & (p == q)
            out[rest[~same]] = d
            rest, d = rest[same], d + 1
        return out


def _scan(words: list[str], n: list[int], where: list[tuple], backward: list[bool]):
    """Of some whole lists: word, number of near words found here, and the best of them."""
    starts = np.array([i for i in range(len(where)) if not i or where[i] != where[i - 1]], np.int64)
    sizes = np.diff(np.append(starts, len(where)))
    list_of = np.repeat(np.arange(len(starts)), sizes)
    back = np.array(backward)
    lists = _Lists([w[::-1] if r else w for w, r in zip(words, backward)], starts)
    count, order = np.array(n, np.int64), np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    m, lo, hi = (np.array([x[i] for x in where], np.int64) for i in range(3))
    asked = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    for low in range(0, len(asked), QUERIES):
        q, w = lists.near(asked[low : low + QUERIES], list_of)
        fits = np.minimum(lists.length[q], lists.length[w]) == m[q]
        q, w = q[fits], w[fits]
        prefix = lists.common(q, w, back[q])
        fits = (lo[q] <= prefix) & (prefix < hi[q])
        q, w = q[fits], w[fits]
        if len(q):
            by = np.lexsort((order[w], -count[w], q))
            q, w = q[by], w[by]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            yield batch(
                word=pa.array([words[i] for i in q[first]], pa.string()),
                n_near=pa.array(np.diff(np.append(first, len(q))), pa.int64()),
                near_n=pa.array(count[w[first]], pa.int64()),
                near=pa.array([words[i] for i in w[first]], pa.string()),
            )


def _near(batches):
    held: list[tuple] = []

    def scanned(rows):
        yield from _scan([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])

    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("word", "n", "backward", *_GROUP))
        for word, n, back, m, lo, hi, key in zip(*columns):
            group = (m, lo, hi, key)
            if len(held) >= AT_ONCE and held[-1][2] != group:
                yield from scanned(held)
                held = []
            held.append((word, n, group, back))
    if held:
        yield from scanned(held)


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """word, n, n_near and best (struct of minus n and the word: the near word of largest n)."""
    rows = _windows(words, crowded).withColumn("backward", F.col("lo") < F.col("m") - F.col("hi"))
    spelt = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    lists = rows.repartition(*_GROUP).withColumn("spelt", spelt).sortWithinPartitions(*_GROUP, "spelt").drop("spelt")
    found = map_arrow(lists, _near, "word string, n_near long, near_n long, near string")
    best = F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))
    each = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("best"))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<n:bigint,word:string>").alias("best"))
    return own.unionByName(each).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words with a form. A form has at least RATIO times the count, so chains are
    short; each round doubles the steps taken."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = now.join(further, "root", "left")
        after = materialise(step.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def group(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    takes = -F.col("best.n") >= RATIO * F.col("n")
    near = near_words(words, crowded).select("word", "n", "n_near", F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n"))
    near = materialise(near, "spelling-near")
    rooted = near.join(_roots(near.where("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(materialise(vocabulary(table(spark, sf_dir, "documents")), "spelling-words"))
