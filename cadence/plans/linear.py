"""Models over sufficient statistics: one pass in Spark, small solves on the driver.

Rows never reach the driver. What does is the Gram matrix and right-hand side, whose size is that
of the model (context columns and players), not of the data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shared

#: The largest number of columns whose Gram matrix is solved on the driver (8 bytes a cell, squared).
MAX_COLUMNS = 12_000


@dataclass
class Statistics:
    """Normal equations: Gram matrix ``g``, right-hand side ``b``, and moments of the rows."""

    columns: list[str]
    g: np.ndarray
    b: np.ndarray
    n: float
    q: float
    var_y: float
    slogw: float
    sw: float = 0.0
    swy: float = 0.0

    def block(self, prefixes: tuple[str, ...]) -> np.ndarray:
        return np.array([c.startswith(prefixes) for c in self.columns])

    def residual(self, coef: np.ndarray) -> float:
        """The weighted residual sum of squares, without reading rows again."""
        return max(0.0, float(self.q - 2 * coef @ self.b + coef @ self.g @ coef))


def collect(rows: DataFrame, fold: str | None = None) -> dict[object, Statistics]:
    """Statistics of all rows (key None) or of each fold, from one pass over the design."""
    return collect_many(rows, {"y": ("y", "w")}, fold)["y"]


def collect_many(rows: DataFrame, responses: dict[str, tuple[str, str]], fold: str | None = None) -> dict[str, dict[object, Statistics]]:
    """Statistics for each response (name: value and weight columns) and fold (None: all rows), over
    the columns of all variants (see ``operators.shared``), from one pass over the rows.

    What comes to the driver is bounded: columns and keys are counted first, and columns squared,
    times folds, times responses, may be ``MAX_COLUMNS`` squared at most.
    """
    return fetched(shared.sums(rows, list(responses.values()), fold), list(responses), fold)


def fetched(sums: DataFrame, responses: list[str], fold: str | None = None) -> dict[str, dict[object, Statistics]]:
    """``collect_many`` of sums already made, as those of ``shared.sums``: g0, g1, ... are those of ``responses`` in order."""
    lead = [fold] if fold else []
    sums = sums.persist()
    try:
        columns = [r[0] for r in sums.where("i = j and i < '~'").select("i").distinct().orderBy("i").limit(MAX_COLUMNS + 1).collect()]
        keys = [r[0] for r in sums.where("i = '~n'").select(*lead or [F.lit(None)]).distinct().limit(MAX_COLUMNS).collect()] or ([] if fold else [None])
        if len(columns) > MAX_COLUMNS or len(columns) ** 2 * len(keys) * len(responses) > MAX_COLUMNS**2:
            raise ValueError(f"{len(columns)} columns of {len(keys)} parts and {len(responses)} responses are more than the driver may hold")
        cells = sums.toArrow()
    finally:
        sums.unpersist()
    known = pa.array([*columns, shared.OUTCOME, *shared.MOMENTS], pa.string())
    i, j = (pc.index_in(cells.column(c), value_set=known).combine_chunks().to_numpy() for c in ("i", "j"))
    code = pc.index_in(cells.column(fold), value_set=pa.array(keys, cells.column(fold).type)).combine_chunks().to_numpy() if fold else np.zeros(len(i), np.int64)
    size = len(columns)
    out: dict[str, dict[object, Statistics]] = {}
    for r, name in enumerate(responses):
        g, out[name] = cells.column(f"g{r}").to_numpy(), {}
        for k, key in enumerate(keys):
            mine = code == k
            inner, outer = mine & (j < size), mine & (j == size)
            moment = dict(zip(i[mine & (i > size)] - size - 1, g[mine & (i > size)]))
            n, sw, slogw, q, sy, syy, swy = (float(moment.get(m, 0.0)) for m in range(len(shared.MOMENTS)))
            if not n and fold:
                continue
            s = out[name][key] = Statistics(columns, np.zeros((size, size)), np.zeros(size), int(n), q, max(0.0, syy / n - (sy / n) ** 2), slogw, sw, swy)
            s.g[i[inner], j[inner]] = s.g[j[inner], i[inner]] = g[inner]
            s.b[i[outer]] = g[outer]
    return out


def cut(s: Statistics, keep: np.ndarray) -> Statistics:
    """The statistics of the model that has only the columns ``keep`` (a mask)."""
    at = np.flatnonzero(keep)
    return replace(s, columns=[s.columns[k] for k in at], g=s.g[np.ix_(at, at)], b=s.b[at])


def total(parts: list[Statistics]) -> Statistics:
    n = sum(p.n for p in parts)
    add = lambda f: sum(f(p) for p in parts)
    return Statistics(parts[0].columns, add(lambda p: p.g), add(lambda p: p.b), n, add(lambda p: p.q), add(lambda p: p.var_y * p.n) / max(n, 1), add(lambda p: p.slogw), add(lambda p: p.sw), add(lambda p: p.swy))


def dependent(s: Statistics, blocks: tuple[str, ...] = ("c_",), tolerance: float = 1e-10) -> np.ndarray:
    """A mask of the columns of ``blocks`` that say nothing beyond the others: dead ones (all zero), and
    those that are sums of multiples of others, such as constants beside the intercept and copies.

    A pivoted Cholesky factorisation of their scaled Gram matrix: the column with the most left to
    say is taken, the intercept before all and of equals the first; what is left under ``tolerance`` is dependent.
    """
    at = np.flatnonzero(s.block(blocks))
    at = at[np.argsort([s.columns[k] != "c_intercept" for k in at], kind="stable")]
    size = np.diag(s.g)[at]
    scale = np.where(size > 0, 1 / np.sqrt(np.where(size > 0, size, 1.0)), 0.0)
    g = s.g[np.ix_(at, at)] * np.outer(scale, scale)
    left, free, steps = np.diag(g).copy(), np.ones(len(at), bool), np.zeros((0, len(at)))
    while free.any():
        k = 0 if not len(steps) and left[0] > 0 else int(np.argmax(np.where(free, left, -1.0)))
        if left[k] <= tolerance:
            break
        step = (g[k] - steps[:, k] @ steps) / np.sqrt(left[k])
        steps, free[k] = np.vstack([steps, step]), False
        left = left - step * step
    out = np.zeros(len(s.columns), bool)
    out[at[free]] = True
    return out


def ridge(s: Statistics, penalty: float, context_penalty: float = 1e-3) -> np.ndarray:
    """Coefficients of all columns; dependent ones have none."""
    some = np.flatnonzero(~dependent(s))
    weight = np.where(s.block(("c_",)), context_penalty, penalty)
    coef = np.zeros(len(s.columns))
    coef[some] = np.linalg.solve(s.g[np.ix_(some, some)] + np.diag(weight[some]), s.b[some])
    return coef


def choose_penalty(folds: dict[object, Statistics], grid: tuple[float, ...] = (3.0, 10.0, 30.0, 100.0)) -> float:
    """The grid value with the least mean error over folds; the earlier if equal. A fold's error
    comes from its own statistics, so the rows are read once for all folds and values."""
    best, least = grid[0], np.inf
    for value in grid:
        errors = []
        for held, s in folds.items():
            coef = ridge(total([p for k, p in folds.items() if k != held]), value)
            errors.append(np.sqrt(s.residual(coef) / max(s.n, 1)))
        if np.mean(errors) < least:
            best, least = value, float(np.mean(errors))
    return best


@dataclass
class Fit:
    columns: list[str]
    coef: np.ndarray
    covariance_factor: np.ndarray  # the Cholesky factor of the posterior precision
    variances: dict[str, float]
    sigma2: float
    log_likelihoods: list[float]

    def on(self, columns: list[str]) -> np.ndarray:
        """The coefficients of ``columns``; zero for those that the fit doesn't have."""
        known = dict(zip(self.columns, self.coef))
        return np.array([known.get(c, 0.0) for c in columns])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, float(v)) for c, v in zip(self.columns, self.coef)], "col string, coef double")


def expectation_maximisation(s: Statistics, blocks: dict[str, tuple[str, ...]], tolerance: float = 1e-6, rounds: int = 200) -> Fit:
    """Variance components by EM: one variance for each block of columns, a wide fixed prior for the
    context, one noise variance. The likelihood must not fall; every step uses the statistics only.
    Dependent columns are left out of the fit, so they add nothing to a prediction either."""
    s = cut(s, ~dependent(s))
    p = len(s.columns)
    masks = {k: s.block(v) for k, v in blocks.items()}
    masks = {k: m for k, m in masks.items() if m.any()}
    variances, sigma2 = {k: 1.0 for k in masks}, max(s.var_y, 1e-9)
    log: list[float] = []
    mu, chol = np.zeros(p), np.eye(p)
    for _ in range(rounds):
        prior = np.full(p, 1e6)
        for k, m in masks.items():
            prior[m] = variances[k]
        chol = np.linalg.cholesky(s.g / sigma2 + np.diag(1 / prior))
        half = np.linalg.solve(chol, s.b / sigma2)
        mu = np.linalg.solve(chol.T, half)
        inverse = np.linalg.inv(chol)
        v = (inverse**2).sum(axis=0)  # the posterior variances
        log.append(float(-0.5 * (s.n * np.log(2 * np.pi * sigma2) - s.slogw + s.q / sigma2 - half @ half + np.log(prior).sum() + 2 * np.log(np.diag(chol)).sum())))
        trace = sigma2 * (p - float((v / prior).sum()))
        new = {k: max(1e-12, float((mu[m] @ mu[m] + v[m].sum()) / m.sum())) for k, m in masks.items()}
        new_sigma2 = max(1e-12, 1e-6 * s.var_y, (s.residual(mu) + trace) / s.n)  # an exact outcome leaves no noise
        step = max([abs(np.log(new[k] / variances[k])) for k in masks] + [abs(np.log(new_sigma2 / sigma2))])
        variances, sigma2 = new, new_sigma2
        if step < tolerance:
            break
    return Fit(s.columns, mu, chol, variances, sigma2, log)


#: A posterior covariance of so many bytes at most goes to every task; a larger one is cut into tiles
#: of ``TILE`` columns a side, which meet the groups' pieces by a join.
SENT_BYTES, TILE = 64 << 20, 1024
#: Groups whose pieces meet one copy of a tile.
AT_ONCE = 20_000


#: Prior variances of lifts.
LIFT_GRID = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0)


def evidence(s: Statistics, sigma2: float, grid: tuple[float, ...] = LIFT_GRID) -> np.ndarray:
    """Coefficients under a normal prior, whose variance has the greatest marginal likelihood over the grid."""
    best, top = np.zeros(len(s.b)), -np.inf
    for tau2 in grid:
        chol = np.linalg.cholesky(s.g / sigma2 + np.eye(len(s.b)) / tau2)
        half = np.linalg.solve(chol, s.b / sigma2)
        score = 0.5 * half @ half - np.log(np.diag(chol)).sum() - 0.5 * len(s.b) * np.log(tau2)
        if score > top:
            top, best = score, np.linalg.solve(chol.T, half)
    return best


def _forms(group: np.ndarray, a: np.ndarray, x: np.ndarray, other: np.ndarray, b: np.ndarray, y: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """For each group of 0..n-1 the sum of x * matrix[a, b] * y over its entries of both kinds."""
    out = np.zeros(n)
    for i, j in shared.ragged(group, np.bincount(other, minlength=n)):
        out += np.bincount(group[i], x[i] * matrix[a[i], b[j]] * y[j], n)
    return out


def group_predictive(fit: Fit, group_rows: DataFrame, group: str, sent_bytes: int = SENT_BYTES, tile: int = TILE) -> DataFrame:
    """group, mean, sd, weight: the posterior of each group's mean design row plus noise / weight.

    A group uses only the entries of the posterior covariance between its own columns. They are
    looked up where the group lies, in a covariance that every task has, or, if that is larger than
    ``sent_bytes``, tile by tile: a group's row is cut into pieces of a tile's columns, each two of
    which meet the tile of theirs, and the sums of all tiles are added up.
    """
    at = {c: k for k, c in enumerate(fit.columns)}
    half = np.linalg.inv(fit.covariance_factor)
    covariance = half.T @ half
    small, wide = covariance.nbytes <= sent_bytes, len(fit.columns)
    spark = group_rows.sparkSession
    model = spark.sparkContext.broadcast((fit.columns, fit.coef, covariance if small else None))
    listed = group_rows.groupBy(group, "weight").agg(F.collect_list(F.struct("col", "val")).alias("cells"))
    kind = group_rows.schema[group].dataType.simpleString()

    def entries(b):
        columns, coef, covariance = model.value
        cells = pa.array(b.column("cells"))
        flat = cells.flatten()
        row = np.repeat(np.arange(len(b)), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
        k = pc.index_in(flat.field("col"), value_set=pa.array(columns, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        x = flat.field("val").to_numpy(zero_copy_only=False).astype(float)
        some = k >= 0
        row, k, x = row[some], k[some], x[some]
        return row, k, x, np.bincount(row, x * coef[k], len(b)), covariance

    def run(batches):
        for b in batches:
            row, k, x, mean, covariance = entries(b)
            spread = _forms(row, k, x, row, k, x, covariance, len(b))
            sd = np.sqrt(np.maximum(spread, 0) + sigma2 / b.column("weight").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(group), b.column("weight"), pa.array(mean), pa.array(sd)], names=[group, "weight", "mean", "sd"])

    sigma2 = fit.sigma2
    if small:
        return listed.mapInArrow(run, f"{group} {kind}, weight double, mean double, sd double")

    salts = max(1, -(-listed.count() // AT_ONCE))
    blocks = range(-(-wide // tile))
    cut_up = [(i, j, covariance[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].tobytes()) for i in blocks for j in blocks if i <= j]
    tiles = spark.createDataFrame(cut_up, "bi int, bj int, data binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def pieces(batches):
        for b in batches:
            row, k, x, mean, _ = entries(b)
            order = np.lexsort((k, row))
            row, k, x = row[order], k[order], x[order]
            part = row * len(blocks) + k // tile
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            bounds = np.append(first, len(part))
            owner, block = row[first], k[first] // tile
            i, j = ([*z] for z in zip(*((u, v) for u, v in shared.ragged(owner, np.bincount(owner, minlength=len(b)))))) if len(first) else ([], [])
            i, j = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (i, j))
            i, j = i[block[i] <= block[j]], j[block[i] <= block[j]]
            slab = lambda u, what: pa.array([what[bounds[m] : bounds[m + 1]].tobytes() for m in u], pa.binary())
            local = k % tile
            yield pa.RecordBatch.from_arrays(
                [b.column(group).take(pa.array(owner[i])), b.column("weight").take(pa.array(owner[i])), pa.array(mean[owner[i]]), pa.array(block[i].astype(np.int32)), pa.array(block[j].astype(np.int32)), slab(i, local), slab(i, x), slab(j, local), slab(j, x)],
                names=[group, "weight", "mean", "bi", "bj", "a", "x", "b", "y"],
            )

    def met(left, right):
        if not right.num_rows or not left.num_rows:
            return pa.table({group: left.column(group)[:0], "weight": left.column("weight")[:0], "mean": left.column("mean")[:0], "spread": pa.array([], pa.float64())})
        bi, bj = right.column("bi")[0].as_py(), right.column("bj")[0].as_py()
        matrix = np.frombuffer(right.column("data")[0].as_py(), np.float64).reshape(-1, min(tile, wide - bj * tile))
        a, x, b, y = (left.column(c).to_pylist() for c in "axby")
        number = lambda z: np.repeat(np.arange(len(z)), [len(v) // 8 for v in z])
        whole = lambda z, t: np.frombuffer(b"".join(z), t)
        found = _forms(number(a), whole(a, np.int64), whole(x, float), number(b), whole(b, np.int64), whole(y, float), matrix, len(a)) * (1 if bi == bj else 2)
        return pa.table({group: left.column(group), "weight": left.column("weight"), "mean": left.column("mean"), "spread": pa.array(found)})

    cut = listed.mapInArrow(pieces, f"{group} {kind}, weight double, mean double, bi int, bj int, a binary, x binary, b binary, y binary")
    cut = cut.withColumn("salt", F.pmod(F.xxhash64(group), F.lit(salts)).cast("int"))
    parts = cut.groupBy("bi", "bj", "salt").cogroup(tiles.groupBy("bi", "bj", "salt")).applyInArrow(met, f"{group} {kind}, weight double, mean double, spread double")
    total = parts.groupBy(group, "weight").agg(F.first("mean").alias("mean"), F.sum("spread").alias("spread"))
    return total.select(group, "weight", "mean", F.sqrt(F.greatest("spread", F.lit(0.0)) + F.lit(sigma2) / F.col("weight")).alias("sd"))


def with_role_pairs(rows: DataFrame, bins: DataFrame) -> DataFrame:
    """Design rows with the counts of role-pair bins (row, bin, n)."""
    cells = bins.groupBy(F.col("row").alias("stint_id")).agg(F.collect_list(F.struct(F.concat(F.lit("r"), F.col("bin").cast("string")).alias("col"), F.col("n").cast("double").alias("val"))).alias("extra"))
    return _with_extra(rows, cells)


def _with_extra(rows: DataFrame, cells: DataFrame) -> DataFrame:
    return rows.join(cells, "stint_id", "left").withColumn("cells", F.when(F.col("extra").isNull(), F.col("cells")).otherwise(F.concat("cells", "extra"))).drop("extra")


def shrunk_lineup_shifts(residuals: DataFrame) -> DataFrame:
    """(lineup, e, w), residuals of the context model, to lineup, shrinkage, shift: each lineup's mean
    residual, shrunk towards zero by the share of its variance that lies between lineups."""
    groups = residuals.groupBy("lineup").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("e")).alias("we"), F.sum(F.col("w") * F.col("e") * F.col("e")).alias("wee"))
    groups = groups.select("lineup", "w", (F.col("we") / F.col("w")).alias("mean"), (F.col("wee") - F.col("we") * F.col("we") / F.col("w")).alias("ss"))
    sums = groups.agg((F.sum("ss") / F.sum("w")).alias("sigma2"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("mean") * F.col("mean")).alias("s2"), F.sum(F.col("w") * F.col("mean")).alias("s1"), F.sum(F.col("w") / F.greatest("w", F.lit(1.0))).alias("sn"))
    parts = sums.select("sigma2", F.greatest(F.lit(0.0), F.col("s2") / F.col("sw") - (F.col("s1") / F.col("sw")) * (F.col("s1") / F.col("sw")) - F.col("sigma2") * F.col("sn") / F.col("sw")).alias("tau2"))
    b = F.when(F.col("tau2") > 0, F.col("tau2") / (F.col("tau2") + F.col("sigma2") / F.greatest("w", F.lit(1.0)))).otherwise(0.0)
    return groups.crossJoin(F.broadcast(parts)).select("lineup", b.alias("shrinkage"), (F.col("mean") * b).alias("shift"))  # parts: one row
