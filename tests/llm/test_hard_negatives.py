"""Hard negatives against brute force over whole numbers, and against the query's SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from cadence.llm import hard_negatives as hn
from cadence.llm import registry

from .helpers import rows

SCHEMA = "vec_id long, embedding array<double>, label int"


def exact(x):
    return int(x) * 256 if abs(x) > 2**52 else math.floor(x * 256)


def brute(table):
    fine = []
    for i, v, label in table:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, (label + 1) % 10 if i % 7 == 0 else label, [exact(x) for x in v], v))
    first = {}
    for i, label, w, v in fine:
        if i % 100 == 0:
            first[i] = min(first.get(i, (label, len(v), v, w)), (label, len(v), v, w))
    out, clip = [], lambda s: max(-(2**63), min(2**63 - 1, s))
    for a, (label, size, _, w) in first.items():
        scored = sorted((-sum(x * y for x, y in zip(w, u)), i, other) for i, other, u, _ in fine if i != a and len(u) == size)
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            within = [(n, i) for n, i, other in scored if other != label and 80 * -s <= 100 * -n <= 100 * -s]
            out += [(a, p, rank, i, clip(-s), clip(-n)) for rank, (n, i) in enumerate(within[:5], 1)]
    return sorted(out, key=repr)


def made(seed, n=260, scale=1.0, dim=6):
    r = random.Random(seed)
    return [(i * 5, [r.gauss(0.4, 1) * scale for _ in range(dim)], r.randrange(3)) for i in range(n)]


AWKWARD = [
    (100, None, 1),
    (200, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
    (300, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0], 1),
    (400, [math.inf] * 6, 1),
    (500, [], 1),
    (505, [], 1),
    (600, [1.0, 2.0], 1),
    (601, [1.0, 2.0], 1),
    (602, [1.0, 1.9], 2),
    (None, [1.0] * 6, 1),
    (800, [1.0] * 6, None),
    (0, [9.0] * 6, 2),
    (0, [0.5] * 6, 1),
    (15, [0.5] * 6, 1),
    (15, [0.5] * 6, 1),
    (900, [0.0] * 6, 2),
    (-100, [0.3] * 6, -4),
]


@pytest.mark.parametrize("seed,scale", [(1, 1.0), (2, 0.001), (3, 1e6), (4, 1e12), (5, 1e30), (6, 1e200)])
def test_scores_of_any_size(spark, seed, scale):
    table = made(seed, scale=scale) + AWKWARD
    v = hn.vectors(spark.createDataFrame(table, SCHEMA))
    want = brute(table)
    assert want and rows(hn.mine(v.where("vec_id % 100 = 0"), v)) == want


def test_blocks_that_are_not_broadcast(spark):
    table = made(9) + AWKWARD
    v = hn.vectors(spark.createDataFrame(table, SCHEMA).repartition(3))
    assert rows(hn.mine(v.where("vec_id % 100 = 0"), v, sent_bytes=0, size=16)) == brute(table)


def test_packed_fields_hold_the_widest_sums():
    r = np.random.default_rng(3)
    for top in (2, 300, 2**20, 2**40):
        x = r.integers(-top, top, (50, 7))
        anchors = [[top] * 7, [-top] * 7, r.integers(-top, top, 7).tolist(), [0] * 7]
        packed = hn.Packed(x, max(sum(map(abs, a)) for a in anchors))
        for a in anchors:
            assert packed.scores(a).tolist() == [sum(p * int(q) for p, q in zip(a, row)) for row in x]


def test_keys_sort_as_scores():
    scores = sorted([0, 1, -1, 255, 256, -255, -256, 257, 2**63, -(2**63), 10**40, -(10**40)])
    assert sorted(scores, key=hn.score_key) == scores and [hn.key_score(hn.score_key(s)) for s in scores] == scores


def test_empty_and_further_columns(spark):
    v = hn.vectors(spark.createDataFrame([], SCHEMA))
    assert hn.mine(v.where("vec_id % 100 = 0"), v).collect() == []
    table = made(11)
    more = spark.createDataFrame([(*r, "x", 1) for r in table], SCHEMA + ", bars string, dim long")
    v = hn.vectors(more)
    assert rows(hn.mine(v.where("vec_id % 100 = 0"), v)) == brute(table)


def test_query_and_sql(spark, sf):
    df = registry.queries()["op12_hard_negatives"](spark, sf)
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    q = duckdb.sql(hn.OP12_SQL)
    assert q.columns == df.columns and rows(df) == sorted(q.fetchall(), key=repr)
