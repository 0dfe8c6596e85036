"""Packing documents into windows of 4096 tokens by non-negative least squares.

Documents are tokenised once; ids are kept in the shared folder. Whole windows are cut off long
documents; what remains of each (under one window) is to be combined. Its length in units of 64
tokens, rounded down, goes into a histogram of 64 bins. Shallow combinations of bins (few
different lengths, perhaps repeated) that fill a window exactly are the columns of a non-negative
least squares problem, whose solution says how often to use each. The counts are rounded down
to what the histogram has, and documents are dealt to the slots by their rank within their bin.
Lengths were rounded down, so each combination fills its window and its last documents may reach
over the end; they are cut there. The parts cut off, the documents that no combination took, and
those under one unit are packed greedily one after the other, cut at window ends. The last,
partial window is cut into powers of two, which need no padding.

Ranks and running sums come from windows within (bin, input partition) and sums over partitions,
so no bin, however many documents it holds, is gathered in one task. Only the histogram and
single totals reach the driver.

Defined cases: null text is the empty text, whose only token is the end id; text that spells a
special token becomes that token, as the library has it by default; repeated rows and repeated or null doc_ids are packed row by row;
a very long text is cut over as many windows as it takes; further columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, materialise, table, utf8, worker_cache

LENGTH = 4096
UNIT = 64
END_ID = 2
#: Words of at most so many bytes are remembered, and so many of them.
_WORD_BYTES, _WORDS = 48, 800_000
_TAIL = b".,!?:;*#$%&|"
_STEM_END = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Characters that NFC leaves as they are, alone and side by side, that are no white space and that
#: lower-case one by one.
_PLAIN = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
#: Fixed value: how the vocabulary's file cuts text before merging.
_PRETOKENS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabets write a byte as the character of its number if that is printable, and
    number the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: 256 + i for i, b in enumerate(others)}


class WordIds(dict):
    """Ids of words between ASCII white space, in lower case, as packed 16-bit numbers.

    The tokenizer drops white space, lowers the case and never merges across it, so a text's ids
    are its words' ids in turn. Marks after a letter or digit are tokens apart, so a word that
    ends in them is its stem's ids and theirs. Words of plain characters, which normalisation
    leaves alone, go to the tokenizer's merges directly, others through all of it. Special tokens
    are found in the text as it stands, before the case is lowered, as the library does.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a word that spells one in another case is none
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cut = regex.compile(_PRETOKENS).findall
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = {t.content.encode(): self.packed([i]) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")").split if self.special else None

    def packed(self, ids: list[int]) -> bytes:
        made = array("H" if self.kind == "<u2" else "I", ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def merged(self, word: str) -> list[int]:
        """The ids of a word of plain characters."""
        if word.isascii() and word.isalpha():
            return [t.id for t in self.model.tokenize(word)]
        pieces = (p.encode().decode("latin-1").translate(self.letters) for p in self.cut(word.lower()))
        return [t.id for p in pieces for t in self.model.tokenize(p)]

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(_TAIL)
        if stem and stem != word and stem[-1] in _STEM_END:
            ids = self[stem] + self[word[len(stem) :]]
        else:
            text = word.decode()
            ids = self.packed(self.merged(text) if _PLAIN.fullmatch(text) else self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(word) <= _WORD_BYTES:
            if len(self) >= _WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if self.split_special and b"<|" in text:
            parts = self.split_special(text)
            return b"".join(self.special[p] if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.lower().split()))


def word_ids(path: str) -> WordIds:
    return worker_cache(("word ids", path), lambda: WordIds(path))


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """rid (its upper bits: the input partition), doc_id, n and ids (packed, the end id last)."""

    def run(batches):
        words = word_ids(path)
        end = np.array([END_ID], words.kind).tobytes()
        for b in batches:
            ids = [words.encode(t or b"") + end for t in utf8(b.column("text"))]
            width = len(end)
            yield batch(rid=b.column("rid"), doc_id=b.column("doc_id"), n=pa.array([len(x) // width for x in ids], pa.int64()), ids=pa.array(ids, pa.binary()))

    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(keyed, run, "rid long, doc_id long, n long, ids binary")


def combinations(units: int) -> np.ndarray:
    """Rows: how many of each length (in units, from 1) a combination has; each fills ``units``.

    One length repeated, then at most one other length repeated, or two others once.
    """
    found = set()
    for a in range(1, units + 1):
        for k in range(1, units // a + 1):
            rest = units - k * a
            if not rest:
                found.add(((a, k),))
                continue
            for b in range(1, rest + 1):
                if b != a and rest % b == 0:
                    found.add(tuple(sorted(((a, k), (b, rest // b)))))
                c = rest - b
                if 0 < c < b and a not in (b, c):
                    found.add(tuple(sorted(((a, k), (b, 1), (c, 1)))))
    out = np.zeros((len(found), units + 1))
    for row, parts in enumerate(sorted(found)):
        for length, times in parts:
            out[row, length] = times
    return out


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The x >= 0 that makes ``a @ x`` closest to ``y``, by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    slack = 1e-10 * max(1.0, float(np.abs(y).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (y - a @ x)
        gain[free] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= slack:
            break
        free[best] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                x = z
                break
            step = float(np.min(x[low] / np.maximum(x[low] - z[low], 1e-300)))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
            if not free.any():
                break
    return x


def repeats(histogram: np.ndarray, units: int) -> list[tuple[np.ndarray, int]]:
    """(combination, times): never more of a length than ``histogram`` (by units, from 0) has."""
    rows = combinations(units)
    rows = rows[(rows[:, histogram == 0] == 0).all(axis=1)]
    total = float(histogram[1:].sum())
    if not total or not len(rows):
        return []
    found = nnls(rows[:, 1:].T, histogram[1:] / total) * total
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-found, kind="stable"):
        need = rows[j].astype(np.int64)
        has = need > 0
        times = int(min(np.floor(found[j] + 1e-6), (left[has] // need[has]).min()))
        if times > 0:
            left -= times * need
            out.append((need, times))
    return out


def running(df: DataFrame, by: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows before, within ``by`` and in the order of
    ``order``, whose first column is the rid: first within input partitions, then over them."""
    part = F.shiftrightunsigned("rid", 33)
    df = df.withColumn("__part", part).withColumn("__w", weight)
    inner = Window.partitionBy(*by, "__part").orderBy(*order)
    df = df.withColumn("__in", F.coalesce(F.sum("__w").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = df.groupBy(*by, "__part").agg(F.sum("__w").alias("__sum"))
    outer = Window.partitionBy(*by).orderBy("__part") if by else Window.orderBy("__part")
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    return df.join(sums, [*by, "__part"]).withColumn(name, F.col("__in") + F.col("__before")).drop("__part", "__w", "__in", "__before")


_PIECE = ("rid", "start", "length", "sequence_id", "offset")


def plan(lengths: DataFrame, window: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """(rid, n) to pieces (rid, start, length, sequence_id, offset)."""
    spark = lengths.sparkSession
    units = window // unit
    base = lengths.select("rid", F.floor(F.col("n") / window).cast("long").alias("full"), (F.col("n") % window).alias("rest"))
    base = base.withColumn("bin", F.floor(F.col("rest") / unit).cast("long"))
    histogram = np.zeros(units + 1, np.int64)
    fulls = 0
    for r in base.groupBy("bin").agg(F.sum((F.col("rest") > 0).cast("long")).alias("n"), F.sum("full").alias("f")).collect():
        histogram[r["bin"]] = r["n"] or 0
        fulls += r["f"] or 0

    # Whole windows.
    whole = running(base.where("full > 0").select("rid", "full"), [], ["rid"], F.col("full"), "first")
    whole = whole.select("rid", "first", F.explode(F.expr("sequence(0L, full - 1)")).alias("k"))
    whole = whole.select("rid", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"), (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # Combinations: slot ranges by bin, (bin, low, high, times in one sequence, first sequence).
    used, next_id = np.zeros(units + 1, np.int64), fulls
    slots = []
    for need, times in repeats(histogram, units):
        for b in np.flatnonzero(need):
            slots.append((int(b), int(used[b]), int(used[b] + times * need[b]), int(need[b]), int(next_id)))
            used[b] += times * need[b]
        next_id += times
    rest = base.where("rest > 0").select("rid", "bin", (F.col("full") * window).alias("start"), F.col("rest").alias("length"))
    ranked = running(rest, ["bin"], ["rid"], F.lit(1), "rank")
    slot_table = spark.createDataFrame(slots, "bin long, low long, high long, times long, first long")
    took = spark.createDataFrame([(int(b), int(u)) for b, u in enumerate(used)], "bin long, used long")
    dealt = ranked.join(F.broadcast(took), "bin").where("rank < used").drop("used").join(F.broadcast(slot_table), "bin").where("rank >= low and rank < high")
    dealt = materialise(dealt.select("rid", "bin", "start", "length", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("times")).cast("long")).alias("sequence_id")), "pack-dealt")
    within = Window.partitionBy("sequence_id").orderBy(F.col("bin").desc(), "rid")
    dealt = dealt.withColumn("offset", F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fits = F.greatest(F.lit(0), F.least(F.col("length"), F.lit(window) - F.col("offset")))
    dealt = dealt.withColumn("fits", fits)
    placed = dealt.where("fits > 0").select("rid", "start", F.col("fits").alias("length"), "sequence_id", "offset")

    # All else, one after the other.
    over = dealt.where("fits < length").select("rid", (F.col("start") + F.col("fits")).alias("start"), (F.col("length") - F.col("fits")).alias("length"))
    left = ranked.join(F.broadcast(took), "bin").where("rank >= used").select("rid", "start", "length")
    stream = materialise(running(over.union(left), [], ["rid", "start"], F.col("length"), "at"), "pack-stream")
    total = stream.agg(F.max(F.col("at") + F.col("length"))).first()[0] or 0
    windows, tail = divmod(int(total), window)
    cuts = []
    low, seq = windows * window, next_id + windows
    for bit in reversed(range(window.bit_length())):
        if tail >> bit & 1:
            cuts.append((low, low + (1 << bit), seq))
            low, seq = low + (1 << bit), seq + 1
    ends = F.array(*[F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high"), F.lit(s).cast("long").alias("seq")) for a, b, s in cuts]) if cuts else F.expr("cast(array() as array<struct<low:bigint,high:bigint,seq:bigint>>)")
    last = F.least(F.floor((F.col("at") + F.col("length") - 1) / window).cast("long"), F.lit(windows - 1))
    first = F.floor(F.col("at") / window).cast("long")
    spans = F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<bigint>)")), lambda k: F.struct((k * window).alias("low"), ((k + 1) * window).alias("high"), (k + next_id).alias("seq")))
    cut = stream.select("rid", "start", "length", "at", F.explode(F.concat(spans, ends)).alias("w"))
    begin, end = F.greatest("at", F.col("w.low")), F.least(F.col("at") + F.col("length"), F.col("w.high"))
    streamed = cut.where(begin < end).select("rid", (F.col("start") + begin - F.col("at")).alias("start"), (end - begin).alias("length"), F.col("w.seq").alias("sequence_id"), (begin - F.col("w.low")).alias("offset"))
    return whole.select(*_PIECE).unionByName(placed.select(*_PIECE)).unionByName(streamed.select(*_PIECE))


def pack(docs: DataFrame, path: str, window: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (array of int), doc_tokens, sequence_id, offset."""
    return _pieces(docs, path, window, unit, "ids array<int>")


def _pieces(docs: DataFrame, path: str, window: int, unit: int, extra: str) -> DataFrame:
    kind = word_ids(path).kind
    tokens = materialise(tokenised(docs, path), "pack-ids")
    pieces = plan(tokens.select("rid", "n"), window, unit)
    # A document's pieces: its length in windows, and a few more.
    grouped = pieces.groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    # The pieces are the small side: a hash join spares sorting the ids.
    joined = tokens.join(grouped.withColumnRenamed("rid", "__rid").hint("shuffle_hash"), F.col("rid") == F.col("__rid")).select("doc_id", "n", "ids", "pieces")

    def run(batches):
        name = extra.split()[0]
        for b in batches:
            docs_, cols = [], {k: [] for k in ("start", "length", "sequence_id", "offset", "extra", "doc_tokens")}
            for doc_id, n, ids, found in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), b.column("pieces").to_pylist()):
                ids = np.frombuffer(ids, kind).astype("<u4")
                for p in found:
                    docs_.append(doc_id)
                    for k in ("start", "length", "sequence_id", "offset"):
                        cols[k].append(p[k])
                    part = ids[p["start"] : p["start"] + p["length"]]
                    cols["extra"].append(zlib.crc32(part.tobytes()) if name == "ids_crc32" else part.astype(np.int32))
                    cols["doc_tokens"].append(n)
            made = {"doc_id": pa.array(docs_, pa.int64())} | {k: pa.array(v, pa.int64()) for k, v in cols.items() if k != "extra"}
            made[name] = pa.array(cols["extra"], pa.list_(pa.int32()) if name == "ids" else pa.int64())
            yield batch(**{k: made[k] for k in ("doc_id", "start", "length", name, "doc_tokens", "sequence_id", "offset")})

    return map_arrow(joined, run, f"doc_id long, start long, length long, {extra}, doc_tokens long, sequence_id long, offset long")


def checksums(docs: DataFrame, path: str, window: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """As ``pack``, with ``ids_crc32`` of each piece's little-endian 32-bit ids in place of the ids."""
    return _pieces(docs, path, window, unit, "ids_crc32 long")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksums(table(spark, sf_dir, "documents"), word_bpe_path())
