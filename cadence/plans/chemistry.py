"""Low-rank pair effects of lineups: fits, strength, ensembles, and their effects on lineups.

A pair (a, b) of a lineup adds p_a . q_b + p_b . q_a. Over a lineup these sum to P . Q less the
members' own p . q, with P and Q the sums of its members' vectors, so a lineup's effect under any
number of models is worked out in its own row.

With few pairs, the statistics over (pair, pair) of all games' resampled weights, or of all folds, come
from one pass, and every member of an ensemble, fold and strength is solved from them. With many, a
half-step is a pass over the rows, whose design has ``rank`` columns a player.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ordered
from . import linear

#: Up to so many pairs the statistics over (pair, pair) are gathered; beyond, each half-step reads the rows.
MAX_PAIRS = 4_000
RANK, SWEEPS, TOLERANCE = 2, 20, 1e-7
STRENGTHS = (8.0, 25.0, 70.0, 200.0)
FOLDS, MEMBERS, SEED = 3, 8, 4242
#: Random lineups on which effects sum to zero, and their seed.
REFERENCE, REFERENCE_SEED = 4_000, 991


@dataclass
class Interactions:
    """Provision and need vectors of the players, in units of ``scale``; ``centre``: their mean effect on the reference lineups."""

    players: list[int]
    p: np.ndarray
    q: np.ndarray
    scale: float
    centre: float = 0.0

    def raw(self, places: np.ndarray) -> np.ndarray:
        """The effects, not centred, of lineups as rows of players' places."""
        p, q = self.p[places], self.q[places]
        return self.scale * ((p.sum(axis=1) * q.sum(axis=1)).sum(axis=1) - (p * q).sum(axis=(1, 2)))


def _fives(n: int, size: int, seed: int) -> np.ndarray:
    """The same lineups as ``random_fives`` draws, as places."""
    out = np.zeros((size, 5), np.int64)
    for row in range(size):
        chosen: list[int] = []
        for k in range(5):
            x = int(hashlib.md5(f"{seed}|{row}|{k}".encode()).hexdigest()[:8], 16) % (n - k)
            for c in sorted(chosen):
                x += x >= c
            chosen.append(x)
        out[row] = chosen
    return out


def random_fives(spark: SparkSession, n: int, size: int = REFERENCE, seed: int = REFERENCE_SEED) -> DataFrame:
    """row, five: five different places of 0..n-1 for each row, drawn within the row: the k-th draw is
    one of the n - k places left, counted past those already taken."""
    if n < 5:
        raise ValueError("a lineup needs five players")
    taken: Column = F.array().cast("array<bigint>")
    for k in range(5):
        free = S.draw(n - k, F.lit(seed), F.col("row"), F.lit(k))
        taken = F.concat(taken, F.array(F.aggregate(F.array_sort(taken), free, lambda x, c: x + F.when(x >= c, 1).otherwise(0))))
    return spark.range(size).select(F.col("id").alias("row")).select("row", taken.alias("five"))


def centred(m: Interactions, size: int = REFERENCE, seed: int = REFERENCE_SEED) -> Interactions:
    """With its effects' mean over random lineups of its players taken off."""
    if len(m.players) < 5:
        return m
    return replace(m, centre=float(m.raw(_fives(len(m.players), size, seed)).mean()))


def effects(rows: DataFrame, models: list[Interactions], members: str = "offense_player_ids", name: str = "effects") -> DataFrame:
    """``rows`` with ``effects``, the centred effect of their lineup under each model, and ``known``;
    lineups with a player that the models don't know have zeros."""
    known_players = models[0].players if models else []
    sent = rows.sparkSession.sparkContext.broadcast((known_players, [(m.p, m.q, m.scale, m.centre) for m in models]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` array<double>, known boolean"])

    def run(batches):
        players, fits = sent.value
        values = pa.array(players, pa.int64())
        for b in batches:
            lists, n = pa.array(b.column(members)), len(b)
            flat = lists.flatten().cast(pa.int64())
            row = np.repeat(np.arange(n), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            at = pc.index_in(flat, value_set=values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = (np.bincount(row[at < 0], minlength=n) == 0) & (np.bincount(row, minlength=n) > 0)
            row, at = row[at >= 0], at[at >= 0]
            out = np.zeros((n, len(fits)))
            for k, (p, q, scale, centre) in enumerate(fits):
                total = np.zeros(n)
                for c in range(p.shape[1]):
                    x, y = p[at, c], q[at, c]
                    total += np.bincount(row, x, n) * np.bincount(row, y, n) - np.bincount(row, x * y, n)
                out[:, k] = np.where(known, scale * total - centre, 0.0)
            found = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(fits)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, found, pa.array(known)], names=[*b.schema.names, name, "known"])

    return rows.mapInArrow(run, schema)


def _pair_rows(residuals: DataFrame, keep: list[str]) -> DataFrame:
    """The residuals with a cell for each pair of the lineup."""
    m = F.array_sort("offense_player_ids")
    pairs = F.flatten(F.transform(m, lambda a: F.transform(F.filter(m, lambda b: b > a), lambda b: F.struct(F.concat_ws("-", a.cast("string"), b.cast("string")).alias("col"), F.lit(1.0).alias("val")))))
    return residuals.select("e", *keep, pairs.alias("cells"))


def _players(residuals: DataFrame, rank: int) -> list[int]:
    found = [r[0] for r in residuals.select(F.explode("offense_player_ids").alias("p")).distinct().orderBy("p").collect()]  # the model's columns
    if len(found) * rank > linear.MAX_COLUMNS:
        raise ValueError(f"{len(found)} players are too many for rank {rank}")
    return found


def _alternate(half, n: int, rank: int, strength: float, sweeps: int, tolerance: float, start: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Alternating ridge: ``half(q)`` gives the normal equations of p, by symmetry those of q for p."""
    p, q = np.random.default_rng(0).normal(0, 0.1, (2, n, rank)) if start is None else start
    for _ in range(sweeps):
        before = p @ q.T
        for _side in range(2):
            g, b = half(q)
            p = np.linalg.solve(g + strength * np.eye(len(b)), b).reshape(n, rank)
            p, q = q, p
        if np.abs(p @ q.T - before).max() < tolerance:
            break
    return p, q


def _by_pairs(s: linear.Statistics, players: list[int]):
    """Half-steps from the pairs' statistics. The target is the residual less its mean, in units of its
    size; as a pair's cell is one, its sums with the mean are on the diagonal."""
    at = {p: k for k, p in enumerate(players)}
    pairs = [tuple(at[int(x)] for x in c.split("-")) for c in s.columns]
    a, b = np.array([x for x, _ in pairs], np.int64), np.array([y for _, y in pairs], np.int64)
    mu = s.swy / s.sw if s.sw else 0.0
    scale = float(np.sqrt(s.q / s.sw)) if s.sw and s.q else 1.0
    target = (s.b - mu * np.diag(s.g)) / scale

    def half(q: np.ndarray):
        rank = q.shape[1]
        m = np.zeros((len(pairs), len(players) * rank))
        for k in range(rank):
            m[np.arange(len(pairs)), a * rank + k] += q[b, k]
            m[np.arange(len(pairs)), b * rank + k] += q[a, k]
        return m.T @ s.g @ m, m.T @ target

    return half, scale


def member_cells(rows: DataFrame, players: list[int], q: np.ndarray, members: str = "offense_player_ids", name: str = "{0}:{1}") -> DataFrame:
    """``rows`` with ``cells``: for each member of the lineup the sum of the others' vectors. Worked out
    within the row from the vectors, which every task gets; members without one add nothing to others."""
    sent = rows.sparkSession.sparkContext.broadcast((players, q))
    kept = [c for c in rows.columns if c != "cells"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), "cells array<struct<col:string,val:double>>"])

    def run(batches):
        players, q = sent.value
        rank = q.shape[1]
        q = np.vstack([q, np.zeros((1, rank))])
        for b in batches:
            lists, n = pa.array(b.column(members)), len(b)
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), size)
            flat = lists.flatten().cast(pa.int64())
            at = pc.index_in(flat, value_set=pa.array(players, pa.int64())).fill_null(len(players)).to_numpy(zero_copy_only=False).astype(np.int64)
            met = flat.dictionary_encode()  # cells are named by those present, be they known or not
            names = pa.array([name.format(p, k) for p in met.dictionary.to_pylist() for k in range(rank)], pa.string())
            spot = met.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            others = np.stack([np.bincount(row, q[at, k], n)[row] - q[at, k] for k in range(rank)], axis=1)
            cells = pa.StructArray.from_arrays([names.take(pa.array((spot[:, None] * rank + np.arange(rank)).ravel())), pa.array(others.ravel())], names=["col", "val"])
            ends = np.concatenate([[0], np.cumsum(size * rank)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(ends), cells)], names=[*kept, "cells"])

    return rows.select(*kept).mapInArrow(run, schema)


def _by_rows(rows: DataFrame, players: list[int], weights: str):
    """Half-steps by a pass over the rows each; what is shuffled is the sums alone."""
    moments = rows.agg(F.sum(F.col(weights) * F.col("e")).alias("we"), F.sum(weights).alias("w"), F.sum(F.col(weights) * F.col("e") * F.col("e")).alias("wee")).first()
    mu = moments["we"] / moments["w"] if moments["w"] else 0.0
    scale = float(np.sqrt(moments["wee"] / moments["w"])) if moments["w"] and moments["wee"] else 1.0
    plain = rows.select("offense_player_ids", ((F.col("e") - mu) / scale).alias("y"), F.col(weights).alias("w"))

    def half(q: np.ndarray):
        rank = q.shape[1]
        s = linear.collect(member_cells(plain, players, q))[None]
        place = {f"{p}:{k}": i * rank + k for i, p in enumerate(players) for k in range(rank)}
        spot = np.array([place[c] for c in s.columns], np.int64)
        g, b = np.zeros((len(place), len(place))), np.zeros(len(place))
        g[np.ix_(spot, spot)], b[spot] = s.g, s.b
        return g, b

    return half, scale


def few_pairs(residuals: DataFrame, max_pairs: int = MAX_PAIRS) -> bool:
    pairs = residuals.select(F.explode(S.pairs_of("offense_player_ids")).alias("p")).select("p.a", "p.b").distinct()
    return pairs.limit(max_pairs + 1).count() <= max_pairs


def low_rank(residuals: DataFrame, rank: int = RANK, strength: float = 25.0, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, weights: str = "w", max_pairs: int = MAX_PAIRS) -> Interactions:
    """The vectors fitted to residuals (offense_player_ids, e, and the weights). Both ways give the same."""
    players = _players(residuals, rank)
    if few_pairs(residuals, max_pairs):
        half, scale = _by_pairs(linear.collect_many(_pair_rows(residuals, [weights]), {"e": ("e", weights)})["e"][None], players)
    else:
        half, scale = _by_rows(residuals, players, weights)
    return Interactions(players, *_alternate(half, len(players), rank, strength, sweeps, tolerance), scale)


def path(half, scale: float, players: list[int], grid: tuple[float, ...] = STRENGTHS, rank: int = RANK, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> dict[float, Interactions]:
    """Fits over the grid, each started from that of the next weaker strength."""
    out, start = {}, None
    for strength in sorted(grid):
        start = _alternate(half, len(players), rank, strength, sweeps, tolerance, start)
        out[strength] = Interactions(players, *start, scale)
    return out


def choose_strength(residuals: DataFrame, grid: tuple[float, ...] = STRENGTHS, folds: int = FOLDS, rank: int = RANK, sweeps: int = SWEEPS, max_pairs: int = MAX_PAIRS) -> tuple[float, dict[float, float]]:
    """The grid value with the greatest mean gain over lineups of held-out games, and all gains; the
    largest if none gains. residuals: (stint_id, game_id, offense_player_ids, e, w).

    With few pairs one pass gives all folds' statistics, and one the held-out lineups' means; with many,
    each fold and value is a fit by rows.
    """
    rows = ordered.folds(residuals, "game_id", folds).persist()
    try:
        players = _players(rows, rank)
        models: dict[tuple, Interactions] = {}
        if few_pairs(rows, max_pairs):
            parts = linear.collect_many(_pair_rows(rows, ["w", "fold"]), {"e": ("e", "w")}, "fold")["e"]
            for held in parts:
                rest = [p for k, p in parts.items() if k != held]
                if rest:
                    models |= {(held, v): m for v, m in path(*_by_pairs(linear.total(rest), players), players, grid, rank, sweeps).items()}
            kept = list(parts)
        else:
            kept = [r[0] for r in rows.select("fold").distinct().collect()]  # folds
            for held in kept:
                rest = rows.where(F.col("fold") != held)
                models |= {(held, v): m for v, m in path(*_by_rows(rest, players, "w"), players, grid, rank, sweeps).items()}
        groups = rows.groupBy("fold", F.array_sort("offense_player_ids").alias("offense_player_ids")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("e")).where("n >= 2")
        order = list(models)
        scored = effects(groups, [models[k] for k in order])
        gain = []
        for held in kept:
            mine = [i for i, (f, _) in enumerate(order) if f == held]
            wrong = lambda c: F.sqrt(F.sum(F.col("w") * c * c) / F.sum("w"))
            found = scored.where(F.col("fold") == held).agg(*[(wrong(F.col("e")) - wrong(F.col("e") - F.get("effects", F.lit(i)))).alias(f"g{i}") for i in mine]) if mine else None
            if found is not None:
                r = found.first()
                gain += [(order[i][1], float(r[f"g{i}"] or 0.0)) for i in mine]
    finally:
        rows.unpersist()
    means = {v: float(np.mean([g for x, g in gain if x == v] or [0.0])) for v in grid}
    best, top = grid[-1], 0.0
    for v in grid:
        if means[v] > top:
            best, top = v, means[v]
    return best, means


def times(seed: Column | int, replicate: int) -> Column:
    """How often a game is drawn in a replicate: a Poisson count from a hash of the game."""
    u = S.draw(1_000_000, F.lit(seed), F.lit(replicate), F.col("game_id")) / 1_000_000
    return F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).otherwise(4)


def ensemble(residuals: DataFrame, strength: float = 25.0, members: int = MEMBERS, seed: int = 0, rank: int = RANK) -> list[Interactions]:
    """The point fit and ``members`` fits under game-resampled weights, all centred. With few pairs,
    products are made once and summed under each member's weights: one pass for all."""
    weighed = residuals.select("stint_id", "game_id", "offense_player_ids", "e", F.col("w").alias("w0"), *[(F.col("w") * times(seed, r)).alias(f"w{r + 1}") for r in range(members)])
    names = [f"w{k}" for k in range(members + 1)]
    players = _players(residuals, rank)
    out = []
    if few_pairs(residuals):
        stats = linear.collect_many(_pair_rows(weighed, names), {n: ("e", n) for n in names})
        halves = [_by_pairs(stats[n][None], players) for n in names]
    else:
        halves = [_by_rows(weighed.where(F.col(n) > 0), players, n) for n in names]
    for half, scale in halves:
        out.append(centred(Interactions(players, *_alternate(half, len(players), rank, strength, SWEEPS, TOLERANCE), scale)))
    return out


def _spread(values: Column, point: Column, known: Column, quantiles: tuple[float, float]) -> list[Column]:
    """low, high and p_positive of the members' effects, moved to lie about the point; a lineup that
    isn't known has its point twice, and 0.5."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    moved = F.array_sort(F.transform(values, lambda x: x - mean + point))

    def at(p):
        place = p * (n - 1)
        low = F.floor(place).cast("int")
        return F.get(moved, low) + (place - low) * (F.get(moved, F.least(low + 1, n - 1)) - F.get(moved, low))

    above = F.size(F.filter(moved, lambda x: x > 0)) / n
    return [F.when(known, at(quantiles[0])).otherwise(point).alias("low"), F.when(known, at(quantiles[1])).otherwise(point).alias("high"), F.when(known, above).otherwise(0.5).alias("p_positive")]


def intervals(lineups: DataFrame, models: list[Interactions], members: str = "offense_player_ids", quantiles: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """``lineups`` with point, low, high, p_positive and known: the interaction's effect with the
    spread of the ensemble (``models``: the point fit, then its members) about it."""
    scored = effects(lineups, models, members)
    point = F.get("effects", F.lit(0))
    values = F.slice("effects", 2, len(models) - 1) if len(models) > 1 else F.col("effects")
    return scored.select(*lineups.columns, point.alias("point"), *_spread(values, point, F.col("known"), quantiles), "known")


def group_rows(rows: DataFrame, models: list[Interactions], group: str) -> DataFrame:
    """group, stints, weight, actual, additive, full, interaction_mean, interaction_sd, p_positive of
    rows (group, offense_player_ids, y, additive, w): each member's weighted mean over the group
    first, then mean, deviation and share above zero over members."""
    scored = effects(rows, models)
    mean = lambda c: F.sum(F.col("w") * c) / F.sum("w")
    members = [mean(F.get("effects", F.lit(k))) for k in range(1, len(models))]
    g = scored.groupBy(group).agg(F.count(F.lit(1)).alias("stints"), F.sum("w").alias("weight"), mean(F.col("y")).alias("actual"), mean(F.col("additive")).alias("additive"), mean(F.col("additive") + F.get("effects", F.lit(0))).alias("full"), F.array(*members).alias("m"))
    average = F.aggregate("m", F.lit(0.0), lambda s, x: s + x) / F.size("m")
    square = F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x) / F.size("m")
    return g.select(group, "stints", "weight", "actual", "additive", "full", average.alias("interaction_mean"), F.sqrt(F.greatest(square - average * average, F.lit(0.0))).alias("interaction_sd"), (F.size(F.filter("m", lambda x: x > 0)) / F.size("m")).alias("p_positive"))
