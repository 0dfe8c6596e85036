"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text. A document is parsed against each of
them: from where the last phrase ended, the automaton follows the text as long as it can, so that a
phrase is the longest stretch that occurs in the language's text (or one letter that doesn't). A
phrase costs the bits to point at a place of the language's text, log2(its length), so that a
language with less text has no advantage; the language with the fewest bits for a letter wins.

Text is lower-cased, cut to its letters (ASCII other than letters becomes one space) and parsed as
UTF-8 bytes, in blocks of ``BLOCK`` bytes, over whose ends no phrase runs. A task steps through many
blocks, and all languages, at once: automata are tables of next places, in which a missing step leads
to the place after that byte alone, marked as the start of a phrase.

The automata are fitted on a sample: ``ROWS`` rows of each language by hash order at most, cut into pieces of
``PIECE`` bytes, of which ``LETTERS`` bytes are taken by hash order, and ``ALL_LETTERS`` over all
languages. Rows with crc32(doc_id) mod 5 = 0 are held out. The sample is what passes through the
driver; every document is parsed whole.

Defined cases: a null text and one without a letter are ``und`` with score 0; so is every text if
nothing was learned. Ties go to the language with more labelled rows, then the first in code-point order. A null doc_id is not held out; a null lang teaches nothing;
copies of a text are sampled once for each language; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch, map_arrow, table, worker_cache

FOLDS = 5
UNKNOWN = "und"
#: The bounds of the sample: rows of a language, bytes of a piece, bytes of a language, bytes of all.
ROWS, PIECE, LETTERS, ALL_LETTERS = 600, 256, 40_000, 320_000
#: Bytes of a block, and blocks that are parsed at once.
BLOCK, AT_ONCE = 512, 4096

_KEPT = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def letters(text: str) -> bytes:
    """The text as it is parsed."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_KEPT).split())


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """The steps of each state (the first is the start) of the automaton of all substrings."""
    steps, link, length = [{}], [-1], [0]
    last = 0
    for c in text:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return steps


class Automata:
    """All languages' automata in one table, for steps by many blocks at once.

    Bytes are numbered by the sample (others share one number, and one more fills up blocks). A cell
    holds twice the start of the next state's cells, plus one where the step begins a phrase. The
    state after an unknown byte leads nowhere, so the byte after it begins a phrase as well."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = list(samples)
        known = sorted(set(b"".join(samples.values())))
        self.wide = wide = len(known) + 2
        self.number = bytearray([wide - 2] * 256)
        for i, c in enumerate(known):
            self.number[c] = i
        self.number, self.filler = bytes(self.number), wide - 1
        self.cost = np.array([np.log2(len(samples[n]) + 2) for n in self.names])
        tables, self.start, base = [], [], 0
        for name in self.names:
            steps = suffix_automaton(samples[name])
            lost = len(steps)  # the state before a text and after an unknown byte
            to = np.full((lost + 1, wide), -1, np.int64)
            for state, own in enumerate(steps):
                for c, t in own.items():
                    to[state, self.number[c]] = t
            again = np.where(to[0] >= 0, to[0], lost)
            begins = to < 0
            cells = np.where(begins, again[None, :], to)
            cells[:, self.filler], begins[:, self.filler] = lost, False
            tables.append((2 * (base + cells * wide) + begins).astype(np.int32).ravel())
            self.start.append(base + lost * wide)
            base += (lost + 1) * wide
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """The number of phrases of each text under each language."""
        sizes = [-(-len(t) // BLOCK) for t in texts]
        lines = b"".join(t.translate(self.number).ljust(n * BLOCK, bytes([self.filler])) for t, n in zip(texts, sizes))
        blocks = np.frombuffer(lines, np.uint8).reshape(-1, BLOCK)
        each = np.zeros((len(self.names), len(blocks) + 1), np.int64)
        for low in range(0, len(blocks), AT_ONCE):
            columns = np.ascontiguousarray(blocks[low : low + AT_ONCE].T).astype(np.int32)
            at = np.repeat(np.array(self.start, np.int32)[:, None], columns.shape[1], axis=1)
            count = np.zeros(at.shape, np.int32)
            for column in columns:
                step = self.table[at + column]
                count += step & 1
                at = step >> 1
            each[:, low : low + columns.shape[1]] = count
        ends = np.cumsum([0, *sizes])
        total = np.concatenate([np.zeros((len(self.names), 1), np.int64), np.cumsum(each, axis=1)], axis=1)
        return (total[:, ends[1:]] - total[:, ends[:-1]]).T


def samples(rows: DataFrame) -> dict[str, bytes]:
    """Each language's text to learn from, of the rows (text, lang): bounded, see above. Languages with
    more rows come first."""
    known = rows.where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").select("lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return {}
    place = F.xxhash64("text").cast("double") / 2.0**64 + 0.5
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * ROWS / n))))[F.col("lang")]
    some = known.withColumn("place", place).where(F.col("place") <= share).dropDuplicates(["lang", "text"])
    order = Window.partitionBy("lang").orderBy("place", "text")
    some = some.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= ROWS)
    each = min(LETTERS, ALL_LETTERS // len(sizes))
    pieces = map_arrow(some.select("lang", "text"), _pieces(each), "lang string, hash long, piece binary")
    nth = F.sum(F.octet_length("piece")).over(Window.partitionBy("lang").orderBy("hash", "piece").rowsBetween(Window.unboundedPreceding, -1))
    taken = pieces.withColumn("before", F.coalesce(nth, F.lit(0))).where(F.col("before") < each).select("lang", "hash", "piece")
    found = defaultdict(list)
    for r in taken.orderBy("lang", "hash", "piece").collect():  # ALL_LETTERS bytes and a piece for each language at most
        found[r["lang"]].append(bytes(r["piece"]))
    return {lang: b" ".join(found[lang])[:each] for lang in sorted(found, key=lambda x: (-sizes[x], x))}


def _pieces(each: int):
    """Pieces of the sampled texts; of a very long text, those whose hash is among the least that
    can be needed."""
    most = each // PIECE + 2

    def run(batches):
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                line = letters(text)
                cut = (line[i : i + PIECE] for i in range(0, len(line), PIECE))
                least = heapq.nsmallest(most, ((xxhash.xxh64_intdigest(p) >> 1, p) for p in cut))
                if least:
                    yield batch(lang=pa.array([lang] * len(least), pa.string()), hash=pa.array([h for h, _ in least], pa.int64()), piece=pa.array([p for _, p in least], pa.binary()))

    return run


def predict(docs: DataFrame, texts: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_letter for each document, by the languages' ``texts``."""
    sent, key = docs.sparkSession.sparkContext.broadcast(texts), uuid.uuid4().hex

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                held.append((doc_id, letters(text) if any(map(str.isalpha, text or "")) else b""))
                size += len(held[-1][1]) + 1
                if size >= AT_ONCE * BLOCK:
                    yield judged(held)
                    held, size = [], 0
        if held:
            yield judged(held)

    def judged(held):
        automata = worker_cache(("language", key), lambda: Automata(sent.value))
        names, score, bits = [UNKNOWN] * len(held), np.zeros(len(held)), [None] * len(held)
        if automata.names:
            cost = automata.phrases([t for _, t in held]) * automata.cost
            best, least = cost.argmin(axis=1), cost.min(axis=1)
            likely = 1 / np.exp2(-np.minimum(cost - least[:, None], 1000)).sum(axis=1)
            for i, (_, text) in enumerate(held):
                if text:
                    names[i], score[i], bits[i] = automata.names[best[i]], likely[i], least[i] / len(text)
        return batch(
            doc_id=pa.array([d for d, _ in held], pa.int64()),
            lang_pred=pa.array(names, pa.string()),
            score=pa.array(score, pa.float64()),
            bits_per_letter=pa.array(bits, pa.float64()),
        )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, bits_per_letter double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, samples(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_letter")
