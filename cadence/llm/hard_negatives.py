"""Hard negatives by inner product, with Kronecker-packed products.

Components are integers, floor(256 * x). A block of rows is turned round: for each dimension the
rows' components, biased so that none is negative, stand in separate fields of one wide integer. An
anchor's scores with the whole block are then one sum over dimensions, (anchor's component) times
(wide integer): one multiplication for each of its components. Fields are as wide as the largest
sum can be, in whole bytes, so they never run into each other, and biases are taken off as the
scores are unpacked. The same code serves components of any size; fields grow with them.

1. Each block of anchors meets each block of rows and gives an anchor's best rows of its own label;
   they are merged into its positives.
2. The positives' scores travel with the anchors. Each pair of blocks gives, for every positive, the
   best rows of other labels from ``LOW`` hundredths of its score up to that score; they are merged.

Blocks of anchors are broadcast while they take ``SENT_BYTES`` at most; beyond that each block of
anchors meets each block of rows by an equality join on its number and a group of row blocks.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component,
take no part, nor do rows whose vectors are of another length than the anchor's. A repeated vec_id is
several candidates and one anchor (that of least label, then vector), and never its own candidate. A positive
whose score is negative has no negatives. Scores beyond 64 bits are compared by their true value and
returned as the nearest long. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, materialise, table

POSITIVES, NEGATIVES = 5, 5
SHIFT = 8
#: A negative's score is between so many hundredths of the positive's and all of it.
LOW = 80
#: Vectors in a block of anchors and of rows, and row blocks in a group.
ANCHORS, ROWS, GROUP = 1024, 4096, 4
SENT_BYTES = 64 << 20
_EXACT = 2.0**52


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (with the planted noise), dim and vector (array of double) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    sound &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col("label").cast("long")
    noisy = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    fine = embeddings.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), noisy.alias("label"), x.alias("vector"))
    return fine.select("vec_id", "label", F.size("vector").alias("dim"), "vector")


_BLOCK = "dim int, ids array<long>, labels array<long>, data binary, bars array<array<binary>>"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Up to ``size`` vectors of one length in a row; bars: for each, the scores of its positives."""

    def run(batches):
        held: dict[int, list] = {}

        def sent(dim):
            some = held.pop(dim)
            data = np.array([v for _, _, v, _ in some], np.float64).tobytes()
            each = {n: pa.array([[r[i] for r in some]], pa.list_(pa.int64())) for i, n in enumerate(("ids", "labels"))}
            return batch(dim=pa.array([dim], pa.int32()), **each, data=pa.array([data], pa.binary()), bars=pa.array([[r[3] for r in some]], pa.list_(pa.list_(pa.binary()))))

        for b in batches:
            for dim, *row in zip(*(b.column(c).to_pylist() for c in ("dim", "vec_id", "label", "vector", "bars"))):
                held.setdefault(dim, []).append(row)
                if len(held[dim]) == size:
                    yield sent(dim)
        for dim in list(held):
            yield sent(dim)

    return map_arrow(rows.select("dim", "vec_id", "label", "vector", "bars"), run, _BLOCK)


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(x * 2**SHIFT), as int64 or, where that can't hold them, as Python integers."""
    if np.abs(x).max(initial=0) < _EXACT / (1 << SHIFT):
        return np.floor(x * (1 << SHIFT)).astype(np.int64)
    return np.array([int(v) << SHIFT if abs(v) >= _EXACT else int(np.floor(v * (1 << SHIFT))) for v in x.ravel()], object).reshape(x.shape)


class Packed:
    """A block of rows whose components of each dimension lie in fields of one wide integer.

    ``most``: the largest sum of an anchor's components, signs aside."""

    def __init__(self, rows: np.ndarray, most: int):
        self.n = len(rows)
        self.bias = -min(0, int(rows.min(initial=0)))
        self.offset = most * (int(rows.max(initial=0)) + self.bias)  # a field holds its sum plus this: from 0 to twice this
        width = max(1, (2 * self.offset).bit_length() + 7 >> 3)
        self.width = 4 if width <= 4 else -(-width // 8) * 8
        self.wide = [self._packed((column + self.bias).tolist()) for column in rows.T]
        self.start = self._packed([self.offset] * self.n)

    def _packed(self, fields: list[int]) -> int:
        if self.width <= 8:
            return int.from_bytes(np.array(fields, f"<u{self.width}").tobytes(), "little")
        return int.from_bytes(b"".join(f.to_bytes(self.width, "little") for f in fields), "little")

    def scores(self, anchor: list[int]) -> np.ndarray:
        total = self.start
        for component, wide in zip(anchor, self.wide):
            if component:
                total += component * wide
        raw, less = total.to_bytes(self.n * self.width, "little"), self.offset + self.bias * sum(anchor)
        if self.width <= 8 and self.offset.bit_length() < 62 and abs(less) < 1 << 62:
            return np.frombuffer(raw, f"<u{self.width}").astype(np.int64) - less
        return np.array([int.from_bytes(raw[i : i + self.width], "little") - less for i in range(0, len(raw), self.width)] or [0], object)[: self.n]


def score_key(score: int) -> bytes:
    """Bytes that sort as the scores do, of any size."""
    size = (score.bit_length() + 7) // 8
    if score < 0:
        return (0x8000 - size).to_bytes(2, "big") + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")
    return (0x8000 + size).to_bytes(2, "big") + score.to_bytes(size, "big")


def key_score(key: bytes) -> int:
    size, value = int.from_bytes(key[:2], "big") - 0x8000, int.from_bytes(key[2:], "big")
    return value if size >= 0 else value + 1 - (1 << -8 * size)


def _best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at``, the k best: score descending, id ascending."""
    if len(at) > 4 * k and scores.dtype != object:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge]
    return at[np.lexsort((ids[at], -scores[at]))][:k] if len(at) else at


_FOUND = "anchor_id long, place int, vec_id long, score long, score_key binary"


def _scored(wanted):
    """``wanted``: (scores, own label?, ids, bars) to (place, places of rows) of an anchor."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                dim, ids, labels = r["dim"], np.array(r["ids"], np.int64), np.array(r["labels"], np.int64)
                anchors = _whole(np.frombuffer(r["q_data"], np.float64).reshape(len(r["q_ids"]), dim)).tolist()
                packed = Packed(_whole(np.frombuffer(r["data"], np.float64).reshape(len(ids), dim)), max(sum(map(abs, a)) for a in anchors))
                out: list[tuple] = []
                for anchor_id, label, bars, anchor in zip(r["q_ids"], r["q_labels"], r["q_bars"], anchors):
                    bars = [key_score(k) for k in bars or ()]
                    if bars and max(bars) < 0:
                        continue
                    scores = packed.scores(anchor)
                    for place, at in wanted(scores, labels == label, ids, bars, ids != anchor_id):
                        out += [(anchor_id, place, int(ids[i]), s, score_key(s)) for i, s in ((i, int(scores[i])) for i in at)]
                a, p, v, s, k = zip(*out) if out else ((),) * 5
                s = [max(-(2**63), min(2**63 - 1, x)) for x in s]
                yield batch(anchor_id=pa.array(a, pa.int64()), place=pa.array(p, pa.int32()), vec_id=pa.array(v, pa.int64()), score=pa.array(s, pa.int64()), score_key=pa.array(k, pa.binary()))

    return run


def _own_label(scores, same, ids, bars, other):
    yield 0, _best(scores, ids, np.flatnonzero(same & other), POSITIVES)


def _other_label(scores, same, ids, bars, other):
    fit = np.flatnonzero(~same & other & (scores <= max(bars)))
    for place, bar in enumerate(bars, 1):
        if bar >= 0:
            within = fit[((scores[fit] <= bar) & (100 * scores[fit].astype(object if bar >= 1 << 55 else scores.dtype) >= LOW * bar)).astype(bool)]
            yield place, _best(scores, ids, within, NEGATIVES)


def _meet(anchors: DataFrame, rows: DataFrame, sent_bytes: int) -> DataFrame:
    """Every block of anchors beside every block of rows of its length."""
    asked = materialise(_blocks(anchors, ANCHORS).withColumn("q_block", F.monotonically_increasing_id()), "negatives-anchors")
    asked = asked.select("dim", "q_block", *(F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "data", "bars")))
    size = asked.agg(F.sum(F.octet_length("q_data") + 64 * F.size("q_ids"))).first()[0] or 0
    if size <= sent_bytes:
        return rows.join(F.broadcast(asked), "dim")
    groups = max(1, -(-rows.count() // GROUP))
    numbers = asked.groupBy("dim").agg(F.collect_list("q_block").alias("q_blocks"))  # 8 bytes for a block
    met = rows.withColumn("part", F.pmod(F.hash("ids"), F.lit(groups))).join(numbers, "dim").select("dim", "ids", "labels", "data", "part", F.explode("q_blocks").alias("q_block"))
    copies = asked.drop("dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return met.join(copies, ["q_block", "part"])


def mine(anchors: DataFrame, rows: DataFrame, sent_bytes: int = SENT_BYTES, size: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Both inputs: vec_id, label, dim, vector."""
    none = F.lit(None).cast("array<binary>")
    blocks = materialise(_blocks(rows.withColumn("bars", none), size).drop("bars"), "negatives-rows")
    blocks = blocks.repartition(max(1, -(-blocks.count() // 2)))
    first = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "vector")).alias("v")).select("vec_id", "v.*")
    order = (F.col("score_key").desc(), F.col("vec_id"))

    near = map_arrow(_meet(first.withColumn("bars", none), blocks, sent_bytes), _scored(_own_label), _FOUND)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(*order))
    positives = near.withColumn("place", place).where(F.col("place") <= POSITIVES)
    positives = materialise(positives.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "score_key"), "negatives-positives")

    listed = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score_key"))), lambda s: s["score_key"]).alias("bars"))  # POSITIVES at most
    hard = map_arrow(_meet(first.join(listed, "vec_id"), blocks, sent_bytes), _scored(_other_label), _FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(*order))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).select("anchor_id", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(positives, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"))
    return mine(rows.where("vec_id % 100 = 0"), rows)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.vector) = len(c.vector)
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same
), n AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
         s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
  WHERE place <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
