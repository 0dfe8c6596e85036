"""Normal equations that stay distributed: a Gram matrix in tiles, solved by conjugate gradients.

Columns are numbered in order; a cell (i, j) belongs to the tile of its numbers' blocks of ``TILE``.
The driver holds vectors of the columns' length, and the few context columns of the matrix, but no
matrix of all columns. A product with the matrix is one job: vectors go to the tasks, each sums over
its tiles, and a task's sums of each block are added up.

Context columns are dense and nearly collinear with the sums of players, so they are eliminated
exactly (their Schur complement); the rest is preconditioned by its diagonal. Many right-hand sides
share each product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shared
from .linear import Fit, Statistics, dependent

TILE = 1024
#: Columns of context that the driver holds beside one another.
MAX_CONTEXT = 500


@dataclass
class Tiled:
    """``tiles``: (bi, bj, i, j, g) packed cells of the upper triangle; ``wide``: the matrix's context columns."""

    columns: list[str]
    tiles: DataFrame
    b: np.ndarray
    diagonal: np.ndarray
    context: np.ndarray  # the numbers of the context columns that the fits use
    gone: np.ndarray  # of those that depend on others
    wide: np.ndarray  # all rows of those columns
    n: float
    q: float
    var_y: float
    slogw: float
    sw: float

    def block(self, prefixes: tuple[str, ...]) -> np.ndarray:
        return np.array([c.startswith(prefixes) for c in self.columns])

    def close(self) -> None:
        self.tiles.unpersist()

    def product(self, v: np.ndarray) -> np.ndarray:
        """The matrix times the columns of ``v``."""
        p, k = v.shape
        sent = self.tiles.sparkSession.sparkContext.broadcast(v)

        def multiplied(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for bi, bj, i, j, g in zip(*(b.column(c).to_pylist() for c in ("bi", "bj", "i", "j", "g"))):
                    i, j, g = np.frombuffer(i, np.int32), np.frombuffer(j, np.int32), np.frombuffer(g, np.float64)
                    off = g if bi != bj else np.where(i == j, 0.0, g)
                    for block, to, other, of, value in ((bi, i, bj, j, g), (bj, j, bi, i, off)):
                        x = sent.value[other * TILE : (other + 1) * TILE]
                        total = sums.setdefault(block, np.zeros((TILE, k)))
                        for c in range(k):
                            total[:, c] += np.bincount(to, value * x[of, c], TILE)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "part"])

        def added(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for block, part in zip(b.column("block").to_pylist(), b.column("part").to_pylist()):
                    sums[block] = sums.get(block, 0.0) + np.frombuffer(part, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "part"])

        blocks = -(-p // TILE)
        parts = self.tiles.mapInArrow(multiplied, "block int, part binary").repartition(min(blocks, 64), "block").mapInArrow(added, "block int, part binary")
        out = np.zeros((blocks * TILE, k))
        for r in parts.collect():  # as long as the vectors
            out[r["block"] * TILE : (r["block"] + 1) * TILE] = np.frombuffer(r["part"], np.float64).reshape(TILE, k)
        sent.unpersist()
        return out[:p]

    def solve(self, penalty: np.ndarray, right: np.ndarray, scale: float = 1.0, start: np.ndarray | None = None, tolerance: float = 1e-11, rounds: int = 500) -> np.ndarray:
        """x of (scale * matrix + diag(penalty)) x = right, column by column of ``right``; dependent
        columns are left out and have zeros."""
        right = right.reshape(len(self.columns), -1)
        c, rest = self.context, np.setdiff1d(np.arange(len(self.columns)), np.concatenate([self.context, self.gone]))
        inner = scale * self.wide[c] + np.diag(penalty[c])
        cross = scale * self.wide[rest]
        lower = np.linalg.solve(inner, right[c]) if len(c) else np.zeros((0, right.shape[1]))
        b = right[rest] - cross @ lower

        def times(x):
            full = np.zeros((len(self.columns), x.shape[1]))
            full[rest] = x
            y = scale * self.product(full)
            head = np.linalg.solve(inner, y[c]) if len(c) else y[c]
            return y[rest] + penalty[rest, None] * x - cross @ head

        diagonal = (scale * self.diagonal + penalty)[rest, None]
        x = np.zeros_like(b) if start is None else start.reshape(len(self.columns), -1)[rest].copy()
        r = b - times(x) if start is not None else b.copy()
        z = r / diagonal
        d, rz = z.copy(), (r * z).sum(axis=0)
        enough = tolerance * np.maximum(np.sqrt((b * b / diagonal).sum(axis=0)), 1e-300)
        for _ in range(rounds):
            open_ = np.flatnonzero(np.sqrt(np.maximum(rz, 0)) > enough)
            if not len(open_):
                break
            a = times(d[:, open_])
            step = rz[open_] / np.maximum((d[:, open_] * a).sum(axis=0), 1e-300)
            x[:, open_] += step * d[:, open_]
            r[:, open_] -= step * a
            z = r[:, open_] / diagonal
            new = (r[:, open_] * z).sum(axis=0)
            d[:, open_] = z + (new / np.maximum(rz[open_], 1e-300)) * d[:, open_]
            rz[open_] = new
        out = np.zeros(right.shape)
        out[rest] = x
        if len(c):
            out[c] = lower - np.linalg.solve(inner, cross.T @ x)
        return out


def collect(rows: DataFrame) -> Tiled:
    """The tiles of a design's Gram matrix, from one pass over the rows."""
    sums = shared.sums(rows, [("y", "w")]).persist()
    heads = sums.where("i = j AND i < '~'").select("i", "g0").orderBy("i").toArrow()  # a row for each column
    columns = heads.column("i").to_pylist()
    at = {c: k for k, c in enumerate(columns)}
    p, context = len(columns), np.array([k for k, c in enumerate(columns) if c.startswith("c_")], np.int64)
    if len(context) > MAX_CONTEXT:
        raise ValueError(f"there are more than {MAX_CONTEXT} context columns")
    tail = {r["i"]: r["g0"] for r in sums.where("i >= '~'").collect()}
    n, sw, slogw, q, sy, syy, _ = (float(tail.get(m) or 0.0) for m in shared.MOMENTS)
    b, wide = np.zeros(p), np.zeros((p, len(context)))
    for r in sums.where(F.col("j") == shared.OUTCOME).select("i", "g0").collect():  # a row for each column
        b[at[r["i"]]] = r["g0"]
    place = {int(k): m for m, k in enumerate(context)}
    for r in sums.where("j < '~' AND (i LIKE 'c\\_%' OR j LIKE 'c\\_%')").collect():  # a few columns of the matrix
        i, j = at[r["i"]], at[r["j"]]
        for x, y in ((i, j), (j, i)):
            if y in place:
                wide[x, place[y]] = r["g0"]
    sent = sums.sparkSession.sparkContext.broadcast(columns)

    def numbered(batches):
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            i, j = (pc.index_in(batch.column(c), value_set=known).to_numpy(zero_copy_only=False).astype(np.int32) for c in ("i", "j"))
            yield pa.RecordBatch.from_arrays([pa.array(i // TILE), pa.array(j // TILE), pa.array(i % TILE), pa.array(j % TILE), batch.column("g0")], names=["bi", "bj", "i", "j", "g"])

    def packed(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            bi, bj, i, j, g = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bi", "bj", "i", "j", "g"))
            key = bi.astype(np.int64) << 32 | bj
            for k in np.unique(key):
                mine = key == k
                held.setdefault((int(k >> 32), int(k & 0xFFFFFFFF)), []).append((i[mine], j[mine], g[mine]))
        for (bi, bj), parts in held.items():
            i, j, g = (np.concatenate([x[k] for x in parts]) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([bi], pa.int32()), pa.array([bj], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (i, j, g))], names=["bi", "bj", "i", "j", "g"])

    cells = sums.where("j < '~'").select("i", "j", "g0").mapInArrow(numbered, "bi int, bj int, i int, j int, g double")
    tiles = cells.repartition("bi", "bj").mapInArrow(packed, "bi int, bj int, i binary, j binary, g binary").persist()
    tiles.count()
    sums.unpersist()
    diagonal = heads.column("g0").to_numpy()
    flat = Statistics([columns[k] for k in context], wide[context], b[context], n, q, 0.0, slogw, sw)
    drop = dependent(flat) if len(context) else np.zeros(0, bool)
    return Tiled(columns, tiles, b, diagonal, context[~drop], context[drop], wide[:, ~drop], n, q, max(0.0, syy / max(n, 1) - (sy / max(n, 1)) ** 2), slogw, sw)


def ridge(t: Tiled, penalty: float, context_penalty: float = 1e-3) -> np.ndarray:
    """As ``linear.ridge``."""
    return t.solve(np.where(t.block(("c_",)), context_penalty, penalty), t.b)[:, 0]


def expectation_maximisation(t: Tiled, blocks: dict[str, tuple[str, ...]], probes: int = 32, seed: int = 0, tolerance: float = 1e-4, rounds: int = 60) -> Fit:
    """As ``linear.expectation_maximisation``, but that the sums of posterior variances are estimated
    by ``probes`` random signs, the same in each round; they are exact with as many probes as columns. Each round
    starts from the last one's solutions. The fit has no factor: see ``quadratic_forms``."""
    p = len(t.columns)
    masks = {k: t.block(v) for k, v in blocks.items()}
    masks = {k: m for k, m in masks.items() if m.any()}
    z = np.eye(p) if probes >= p else np.random.default_rng(seed).choice([-1.0, 1.0], (p, probes))
    share = 1.0 if probes >= p else 1.0 / probes
    variances, sigma2 = {k: 1.0 for k in masks}, max(t.var_y, 1e-9)
    x = None
    for _ in range(rounds):
        prior = np.full(p, 1e6)
        for k, m in masks.items():
            prior[m] = variances[k]
        x = t.solve(1 / prior, np.column_stack([t.b / sigma2, z]), 1 / sigma2, x)
        mu, v = x[:, 0], share * (z * x[:, 1:]).sum(axis=1)
        fitted = (t.b / sigma2 - mu / prior) * sigma2  # the matrix times mu
        residual = max(0.0, float(t.q - 2 * mu @ t.b + mu @ fitted))
        live = np.setdiff1d(np.arange(p), t.gone)
        trace = sigma2 * (len(live) - float((v[live] / prior[live]).sum()))
        new = {k: max(1e-12, float((mu[m] @ mu[m] + v[m].sum()) / m.sum())) for k, m in masks.items()}
        new_sigma2 = max(1e-12, 1e-6 * t.var_y, (residual + trace) / t.n)
        step = max([abs(np.log(new[k] / variances[k])) for k in masks] + [abs(np.log(new_sigma2 / sigma2))])
        variances, sigma2 = new, new_sigma2
        if step < tolerance:
            break
    return Fit(t.columns, mu, np.zeros((0, 0)), variances, sigma2, [])


def quadratic_forms(t: Tiled, fit: Fit, designs: np.ndarray, blocks: dict[str, tuple[str, ...]], at_once: int = 64) -> np.ndarray:
    """g' C g for each row g of ``designs``, C the posterior covariance: each by a solve of its own,
    ``at_once`` of them sharing their products."""
    prior = np.full(len(t.columns), 1e6)
    for k, prefixes in blocks.items():
        if k in fit.variances:
            prior[t.block(prefixes)] = fit.variances[k]
    out = [np.zeros(0)]
    for low in range(0, len(designs), at_once):
        g = designs[low : low + at_once].T
        out.append((g * t.solve(1 / prior, g, 1 / fit.sigma2)).sum(axis=0))
    return np.concatenate(out)
