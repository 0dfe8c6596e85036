"""Variants of the lineup design, worked out within a stint's own row.

A variant adds columns for the offense's pairs: one for each admitted pair, one for each pair of
roles, or the concentration of each feature. What a variant knows of players (roles, vectors, admitted
pairs) is of the model's size: it goes to every task, after a count. All variants' cells stand in one row, so that
``linear.collect_many`` gets the statistics of all of them from one pass.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shared
from .linear import MAX_COLUMNS

MEMBERS = "offense_player_ids"
_CELLS = "array<array<struct<col:string,val:double>>>"


def _bounded(df: DataFrame, columns: list[str]) -> list:
    found = df.select(*columns).limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"a variant knows more than {MAX_COLUMNS} players or pairs")
    return found


@dataclass
class Variant:
    """Its columns start with ``prefix``. ``k`` roles by member; or admitted ``pairs``; or ``vectors``
    by member, with a ``shift`` and a ``scale`` of each concentration."""

    name: str
    k: int = 0
    roles: dict[int, int] = field(default_factory=dict)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    features: tuple[str, ...] = ()
    vectors: dict[int, list[float]] = field(default_factory=dict)
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    tag: str | None = None

    @property
    def prefix(self) -> str:
        return self.tag or f"v:{self.name}|"

    def players(self) -> set[int]:
        return {*self.roles, *self.vectors, *(m for p in self.pairs for m in p)}


def of_roles(name: str, roles: DataFrame, k: int, tag: str | None = None) -> Variant:
    """roles: (member, role), null for none."""
    return Variant(name, k=k, tag=tag, roles={int(r[0]): int(r[1]) for r in _bounded(roles.where("role IS NOT NULL"), ["member", "role"])})


def of_pairs(name: str, admitted: DataFrame, tag: str | None = None) -> Variant:
    """admitted: (a, b), a < b."""
    return Variant(name, tag=tag, pairs=sorted((int(r[0]), int(r[1])) for r in _bounded(admitted, ["a", "b"])))


def of_vectors(name: str, vectors: DataFrame, train: DataFrame, tag: str | None = None) -> Variant:
    """vectors: (member, features...). Concentrations are scaled by their mean and deviation over ``train``."""
    names = [c for c in vectors.columns if c != "member"]
    rows = _bounded(vectors, ["member", *names])
    return scaled(Variant(name, tag=tag, features=tuple(names), vectors={int(r[0]): [float(x or 0.0) for x in r[1:]] for r in rows}), train)


def scaled(v: Variant, train: DataFrame) -> Variant:
    plain = replace(v, shift=None, scale=None)
    cells = add(train.select(MEMBERS), [plain]).select(F.explode(F.flatten("extras")).alias("c"))
    found = {r["col"]: (r["m"], r["s"]) for r in cells.groupBy("c.col").agg(F.avg("c.val").alias("m"), F.stddev_pop("c.val").alias("s")).collect()}  # a row for each feature
    scale = [found.get(plain.prefix + n, (0.0, 1.0)) for n in v.features]
    return replace(v, shift=np.array([m for m, _ in scale]), scale=np.array([s or 1.0 for _, s in scale]))


def dealt(v: Variant, name: str, seed: int) -> Variant:
    """The placebo: what is known of players dealt out anew among them, as ``profiles.permuted`` does
    (the player at each place of the ids' order gets what stands at that place of a seeded hash order)."""
    def again(known: dict) -> dict:
        order = sorted(known, key=lambda m: (hashlib.md5(f"{seed}|{m}".encode()).hexdigest(), m))
        return {m: known[x] for m, x in zip(sorted(known), order)}

    return replace(v, name=name, roles=again(v.roles), vectors=again(v.vectors))


def role_pair_bin(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    low, high = np.minimum(a, b), np.maximum(a, b)
    return low * k - low * (low - 1) // 2 + high - low


class _Lookup:
    """A variant in a task: the cells of the pairs of rows, as (row, column number, value)."""

    def __init__(self, v: Variant, known: list[int]):
        self.v, at = v, {m: i for i, m in enumerate(known)}
        if v.k:
            self.names = [f"{v.prefix}{b}" for b in range(v.k * (v.k + 1) // 2)]
            self.role = np.full(len(known) + 1, -1, np.int64)
            for m, role in v.roles.items():
                self.role[at[m]] = role
        elif v.features:
            self.names = [v.prefix + n for n in v.features]
            self.z = np.zeros((len(known) + 1, len(v.features)))
            for m, x in v.vectors.items():
                self.z[at[m]] = x
        else:
            self.names = [f"{v.prefix}{a}-{b}" for a, b in v.pairs]
            self.wide = len(known) + 1
            keys = np.array([at[a] * self.wide + at[b] for a, b in v.pairs], np.int64)
            self.order = np.argsort(keys)
            self.keys = keys[self.order]

    def cells(self, row: np.ndarray, player: np.ndarray, n: int, pair: tuple[np.ndarray, np.ndarray]):
        if self.v.features:
            total = np.stack([np.bincount(row, z, n) for z in self.z[player].T], axis=1)
            square = np.stack([np.bincount(row, z * z, n) for z in self.z[player].T], axis=1)
            value = total * total - square
            if self.v.scale is not None:
                value = (value - self.v.shift) / self.v.scale
            d = len(self.v.features)
            return np.repeat(np.arange(n), d), np.tile(np.arange(d), n), value.ravel()
        a, b = player[pair[0]], player[pair[1]]
        if self.v.k:
            a, b = self.role[a], self.role[b]
            some = np.flatnonzero((a >= 0) & (b >= 0))
            return row[pair[0]][some], role_pair_bin(a[some], b[some], self.v.k), np.ones(len(some))
        key = a * self.wide + b
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        some = np.flatnonzero(self.keys[at] == key) if len(self.keys) else np.zeros(0, np.int64)
        return row[pair[0]][some], self.order[at[some]], np.ones(len(some))


def add(rows: DataFrame, variants: list[Variant]) -> DataFrame:
    """``rows`` with ``extras``: for each variant the cells of the row's offense."""
    sent = rows.sparkSession.sparkContext.broadcast(variants)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"extras {_CELLS}"])

    def run(batches):
        known = sorted(set().union(*(v.players() for v in sent.value)))
        looks = [_Lookup(v, known) for v in sent.value]
        for b in batches:
            n, members = len(b), pa.array(b.column(MEMBERS))
            flat = members.flatten().cast(pa.int64())
            size = pc.list_value_length(members).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), size)
            player = pc.index_in(flat, value_set=pa.array(known, pa.int64())).fill_null(len(known)).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = flat.to_numpy(zero_copy_only=False)
            chunks = [(i[ids[i] < ids[j]], j[ids[i] < ids[j]]) for i, j in shared.ragged(row, size)]
            pair = tuple(np.concatenate([np.zeros(0, np.int64), *(c[k] for c in chunks)]) for k in (0, 1))
            rows_of, columns, values, lists, names = [], [], [], [], []
            for k, look in enumerate(looks):
                r, c, v = look.cells(row, player, n, pair)
                rows_of.append(r)
                columns.append(c + len(names))
                values.append(v)
                lists.append(r * len(looks) + k)
                names += look.names
            where = np.concatenate([np.zeros(0, np.int64), *lists])
            order = np.argsort(where, kind="stable")
            column = pa.array(names, pa.string()).take(pa.array(np.concatenate([np.zeros(0, np.int64), *columns])[order]))
            cells = pa.StructArray.from_arrays([column, pa.array(np.concatenate([np.zeros(0), *values])[order])], names=["col", "val"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n * len(looks)))]).astype(np.int32)
            inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)
            outer = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(looks)), inner)
            yield pa.RecordBatch.from_arrays([*b.columns, outer], names=[*b.schema.names, "extras"])

    return rows.mapInArrow(run, schema)


def flattened(rows: DataFrame) -> DataFrame:
    """``rows`` with all cells in one list, as ``gram.scored`` takes them."""
    return rows.withColumn("cells", F.concat("cells", F.flatten("extras"))).drop("extras")
