"""Exact top-k search by inner product, with a three-phase uniform threshold.

Vectors are integers, floor(1024 * x). Their dimensions are cut into ``LISTS`` lists; a score is
the sum of its parts, one from each list. For blocks of queries against blocks of rows:

1. each block gives the heads of its lists: of the ``HEADS`` rows that are longest in a list, those
   with a query's best parts are scored. The k-th best of all that were scored is reached by k rows
   for sure: the query's cutoff. This costs a small share of one product of all with all;
2. the cutoff goes out with the queries. A row that reaches it has a part of at least
   cutoff / LISTS in some list; only such rows are collected. Rows too short for any query's
   cutoff (length times length bounds a product) are left out before their parts are computed;
3. the scores of those collected are resolved exactly, and each block's k best that reach the
   cutoff are merged, ties to the smaller vec_id.

Blocks hold a bounded number of vectors. While all query blocks take ``SENT_BYTES`` at most, they
are broadcast and rows are not shuffled at all; beyond that every query block meets every row block
once, by an equality join on the query block's number and a small group of row blocks, so a row is
copied once for ``QUERIES`` queries. Nothing passes through the driver but the numbers and sizes
of blocks.

Sums are exact: by float64 while none can pass 2**53; vectors too large for that are cut into limbs
of 21 bits, whose products are summed as whole numbers of any size.
Defined cases: vectors that are null, or hold null or non-finite components, take no part; nor do
rows without vec_id and vectors whose length differs from the query's; every other finite vector
does. A score beyond 64 bits is ranked by its true value and returned as the nearest long. Rows that
repeat a vec_id are candidates each by itself, but none for a query of that vec_id; a repeated query
gives one list, that of its shortest, then least vector; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, materialise, table

K = 10
SCALE = 1024
LISTS = 4
#: Vectors in a block, queries worked on at once, row blocks in a group, and rows at a list's head.
QUERIES, ROWS, AT_ONCE, GROUP, HEADS = 8192, 8192, 64, 4, 256
#: Query blocks of so many bytes altogether are broadcast.
SENT_BYTES = 64 << 20
_NONE = np.iinfo(np.int64).min
_LIMB = 21
#: A score beyond 64 bits is told apart by itself plus this, in so many bytes.
_BIG_BYTES = 280
_OFFSET = 1 << (8 * _BIG_BYTES - 1)


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and vector (array of double: floor(SCALE * x) / SCALE, which is exact): the rows
    that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v) < 2.0**42, F.floor(v * SCALE).cast("double") / SCALE).otherwise(v)  # noqa: E731  (of those, SCALE * v is whole)
    fine = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("vector"))
    return fine.select("vec_id", F.size("vector").alias("dim"), "vector")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (dim, ids, data): up to ``size`` vectors of one length, as packed doubles."""

    def run(batches):
        held: dict[int, list] = {}

        def sent(dim):
            ids = np.array([i for i, _ in held[dim]], np.int64)
            data = np.array([v for _, v in held.pop(dim)], np.float64)
            return batch(dim=pa.array([dim], pa.int32()), ids=pa.array([ids.tobytes()], pa.binary()), data=pa.array([data.tobytes()], pa.binary()))

        for b in batches:
            for i, dim, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "dim", "vector"))):
                held.setdefault(dim, []).append((i, v))
                if len(held[dim]) == size:
                    yield sent(dim)
        for dim in list(held):
            yield sent(dim)

    return map_arrow(rows, run, "dim int, ids binary, data binary")


class Vectors:
    """A block: its ids and vectors, the integers of those small enough for exact float64 sums
    (``at``: their places), and the places of the others."""

    def __init__(self, ids: bytes, data: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.raw = np.frombuffer(data, np.float64).reshape(len(self.ids), dim)
        small = np.abs(self.raw).max(axis=1, initial=0) <= math.isqrt((1 << 52) // max(dim, 1)) / SCALE
        self.at, self.large = np.flatnonzero(small), np.flatnonzero(~small)
        self.x = self.raw[self.at] * SCALE
        self.cuts = np.linspace(0, dim, LISTS + 1).astype(int)

    def lists(self):
        return [self.x[:, a:b] for a, b in zip(self.cuts, self.cuts[1:])]


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers l0, l1, ... below 2**_LIMB (the last one may be negative) of which each
    SCALE * y is the sum of li * 2**(_LIMB * i)."""
    out, unit = [], 1.0 / SCALE
    while True:
        high = np.floor(y / (unit * 2.0**_LIMB))
        out.append((y - high * (unit * 2.0**_LIMB)) / unit)
        y, unit = high, 1.0
        if np.abs(y).max(initial=0) < 2.0**_LIMB:
            return [*out, y]


def _whole_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all of ``q`` with all of ``x`` (in units of 1 / SCALE), as Python integers."""
    out = np.zeros((len(q), len(x)), object)
    for a in range(0, q.shape[1], 1024):
        left, right = _limbs(q[:, a : a + 1024]), _limbs(x[:, a : a + 1024])
        for i, m in enumerate(left):
            for j, n in enumerate(right):
                out += (m @ n.T).astype(np.int64).astype(object) * (1 << _LIMB * (i + j))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: score descending, id ascending."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _list_heads(k: int):
    """Phase 1: (query_id, score) of the rows of a block that have a query's best parts at the heads
    of its lists. Vectors too large for float64 sums give none; their queries have no cutoff."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                queries, rows = Vectors(r["q_ids"], r["q_data"], r["dim"]), Vectors(r["ids"], r["data"], r["dim"])
                if not len(queries.at) or not len(rows.at):
                    continue
                heads = []
                for part in rows.lists():
                    length = (part * part).sum(axis=1)
                    heads.append(np.argpartition(-length, HEADS - 1)[:HEADS] if len(length) > HEADS else np.arange(len(length)))
                xi, qi = rows.ids[rows.at], queries.ids[queries.at]
                for low in range(0, len(qi), AT_ONCE):
                    some = slice(low, low + AT_ONCE)
                    near = []
                    for q, x, head in zip(queries.lists(), rows.lists(), heads):
                        n = min(len(head), k + 1)  # one more, as the query's own row may be among them
                        near.append(head[np.argpartition(-(q[some] @ x[head].T), n - 1, axis=1)[:, :n]])
                    near = np.concatenate(near, axis=1)
                    query, score = [], []
                    for j, (i, q) in enumerate(zip(qi[some], queries.x[some])):
                        at = np.unique(near[j])
                        at = at[xi[at] != i]
                        top = -np.sort(-(rows.x[at] @ q))[:k]
                        query.append(np.full(len(top), i))
                        score.append(top.astype(np.int64))
                    yield batch(query_id=pa.array(np.concatenate(query), pa.int64()), score=pa.array(np.concatenate(score), pa.int64()))

    return run


def _resolved(k: int):
    """Phases 2 and 3: each query's best rows of a block, as (query_id, vec_id, score, beyond, big):
    beyond is -1 or 1 for a score under or over 64 bits, whose order ``big`` has."""

    def ordinary(queries, rows, cutoff):
        xi, qi, cutoff = rows.ids[rows.at], queries.ids[queries.at], cutoff[queries.at]
        known = cutoff != _NONE
        need = np.where(known, cutoff, 0).astype(np.float64)
        least = np.where(known, np.ceil(need / LISTS), -np.inf)
        reach = np.sqrt((rows.x * rows.x).sum(axis=1)) * (1 + 1e-9)
        span = np.sqrt((queries.x * queries.x).sum(axis=1))
        short = np.where(known & (need > 0), need / np.maximum(span, 1e-300), -np.inf)  # a row must be as long
        for low in range(0, len(qi), AT_ONCE):
            some = slice(low, low + AT_ONCE)
            near = np.flatnonzero(reach >= short[some].min(initial=np.inf))
            parts = np.stack([q[some] @ x[near].T for q, x in zip(queries.lists(), rows.lists())])
            collected = (parts >= least[some][None, :, None]).any(axis=0)
            for j, (i, c) in enumerate(zip(qi[some], cutoff[some])):
                at = np.flatnonzero(collected[j] & (xi[near] != i))
                score = parts[:, j, at].sum(axis=0).astype(np.int64)
                at, score = near[at[score >= c]], score[score >= c]
                top = _best(score, xi[at], k)
                yield from ((int(i), int(v), int(s)) for v, s in zip(xi[at][top], score[top]))

    def others(queries, rows, cutoff):
        every = np.arange(len(rows.ids))
        for qs, xs in ((queries.at, rows.large), (queries.large, every)):
            for low in range(0, len(qs) if len(xs) else 0, AT_ONCE):
                q = qs[low : low + AT_ONCE]
                scores = _whole_products(queries.raw[q], rows.raw[xs])
                for j, at in enumerate(q):
                    ranked = sorted((-s, int(v)) for s, v in zip(scores[j], rows.ids[xs]) if v != queries.ids[at] and (cutoff[at] is None or s >= cutoff[at]))
                    yield from ((int(queries.ids[at]), v, -s) for s, v in ranked[:k])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                queries, rows = Vectors(r["q_ids"], r["q_data"], r["dim"]), Vectors(r["ids"], r["data"], r["dim"])
                cutoff = np.frombuffer(r["cutoffs"], np.int64)
                found = list(ordinary(queries, rows, cutoff)) if len(rows.at) and len(queries.at) else []
                found += others(queries, rows, [None if c == _NONE else c for c in cutoff.tolist()])
                beyond = [(s > 2**63 - 1) - (s < -(2**63)) for _, _, s in found]
                big = [(s + _OFFSET).to_bytes(_BIG_BYTES, "big") if x else None for (_, _, s), x in zip(found, beyond)]
                score = [max(-(2**63), min(2**63 - 1, s)) for _, _, s in found]
                ids = {n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id"))}
                yield batch(**ids, score=pa.array(score, pa.int64()), beyond=pa.array(beyond, pa.int32()), big=pa.array(big, pa.binary()))

    return run


def search(queries: DataFrame, rows: DataFrame, k: int = K, sent_bytes: int = SENT_BYTES, size: tuple[int, int] = (QUERIES, ROWS)) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows. Both inputs: vec_id, dim, vector."""
    first = queries.groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("v")).select("vec_id", "v.*")
    q_blocks = materialise(_blocks(first, size[0]).withColumn("q_block", F.monotonically_increasing_id()), "topk-queries")
    q_blocks = q_blocks.select("q_block", "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    x_blocks = materialise(_blocks(rows.select("vec_id", "dim", "vector"), size[1]), "topk-rows")
    total = q_blocks.agg(F.sum(F.octet_length("q_data") + F.octet_length("q_ids"))).first()[0] or 0
    groups = max(1, -(-x_blocks.count() // GROUP))

    def meeting(blocks: DataFrame) -> DataFrame:
        if total <= sent_bytes:
            return x_blocks.join(F.broadcast(blocks), "dim")
        per_dim = blocks.groupBy("dim").agg(F.collect_list("q_block").alias("q_blocks"))  # 8 bytes a block of queries
        grouped = x_blocks.withColumn("group", F.pmod(F.hash("ids"), F.lit(groups)))
        met = grouped.join(per_dim, "dim").select("dim", "ids", "data", "group", F.explode("q_blocks").alias("q_block"))
        copies = blocks.drop("dim").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return met.join(copies, ["q_block", "group"])

    # The k-th best of a query's gathered scores: rank within the k best of each task, then of all.
    gathered = map_arrow(meeting(q_blocks), _list_heads(k), "query_id long, score long")
    place = F.row_number().over(_by_query(F.col("score").desc()))
    cutoffs = gathered.withColumn("place", place).where(f"place <= {k}").groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("cutoff"))
    cutoffs = materialise(cutoffs, "topk-cutoffs")

    # Broadcast of the cutoffs: they travel within the query blocks.
    listed = map_arrow(q_blocks.select("q_block", "q_ids"), _numbered, "q_block long, place int, query_id long")
    per_block = listed.join(cutoffs, "query_id", "left").groupBy("q_block").agg(F.array_sort(F.collect_list(F.struct("place", "cutoff"))).alias("cutoffs"))
    packed = map_arrow(per_block.select("q_block", F.transform("cutoffs", lambda c: F.coalesce(c["cutoff"], F.lit(_NONE))).alias("cutoffs")), _packed, "q_block long, cutoffs binary")
    found = map_arrow(meeting(q_blocks.join(packed, "q_block")), _resolved(k), "query_id long, vec_id long, score long, beyond int, big binary")
    order = _by_query(F.col("beyond").desc(), F.col("big").desc(), F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _by_query(*order):
    return Window.partitionBy("query_id").orderBy(*order)


def _numbered(batches):
    for b in batches:
        for r in b.to_pylist():
            ids = np.frombuffer(r["q_ids"], np.int64)
            yield batch(q_block=pa.array(np.full(len(ids), r["q_block"]), pa.int64()), place=pa.array(np.arange(len(ids)), pa.int32()), query_id=pa.array(ids, pa.int64()))


def _packed(batches):
    for b in batches:
        cutoffs = [np.array(c, np.int64).tobytes() for c in b.column("cutoffs").to_pylist()]
        yield batch(q_block=b.column("q_block"), cutoffs=pa.array(cutoffs, pa.binary()))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    return search(rows.where("vec_id % 100 = 0"), rows)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
