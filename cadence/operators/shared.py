"""Sufficient statistics of many linear models from one pass over their rows.

A row has the cells of a common design and, in ``extras``, a list of cells for each variant of it. It may have
several responses, each with a weight of its own, be they outcomes or replicates of a bootstrap.
Products are made of common cells with one another, of common cells with a variant's, and of a
variant's own; never of two variants'. All responses weigh the same products. Every model, be it of
a variant or of a response, is then cut from the sums by its columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a response's moments are called, as i and j; they sort behind all columns.
MOMENTS = ("~n", "~sw", "~slogw", "~q", "~sy", "~syy", "~swy")
OUTCOME = "~y"
#: Products made at once, and cells of a dense table of sums.
_AT_ONCE, _DENSE = 1 << 21, 1 << 22


class _Sums:
    """Sums over (spot) for each response: a dense table while it is small, else sorted pieces."""

    def __init__(self, cells: int, responses: int):
        self.n, self.responses = cells, responses
        self.dense = [np.zeros(cells) for _ in range(responses)] if cells <= _DENSE else None
        self.hit = np.zeros(cells if self.dense else 0, bool)
        self.pieces: list[tuple] = []

    def add(self, spot: np.ndarray, row: np.ndarray, value: np.ndarray, weights: np.ndarray) -> None:
        if self.dense:
            self.hit[spot] = True
            for r in range(self.responses):
                self.dense[r] += np.bincount(spot, value * weights[r][row], self.n)
        elif len(spot):
            found, where = np.unique(spot, return_inverse=True)
            self.pieces.append((found, [np.bincount(where, value * weights[r][row]) for r in range(self.responses)]))

    def result(self) -> tuple[np.ndarray, list[np.ndarray]]:
        if self.dense:
            spot = np.flatnonzero(self.hit)
            return spot, [d[spot] for d in self.dense]
        spot = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in self.pieces)])
        return spot, [np.concatenate([np.zeros(0), *(p[1][r] for p in self.pieces)]) for r in range(self.responses)]


def ragged(a_group: np.ndarray, b_count: np.ndarray):
    """Chunks of pairs (place in a, place in b) of the same group; both in the order of their groups.
    ``b_count``: b's entries in each group."""
    b_first = np.cumsum(b_count) - b_count
    each = b_count[a_group]
    ends = np.cumsum(each)
    low = 0
    while low < len(a_group):
        start = ends[low] - each[low]
        high = max(low + 1, int(np.searchsorted(ends, start + _AT_ONCE, "right")))
        n = each[low:high]
        a = np.repeat(np.arange(low, high), n)
        yield a, b_first[a_group[a]] + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        low = high


def upper(row: np.ndarray, col: np.ndarray, n: int):
    """Chunks of pairs (place, place) of the same row, each pair of its cells once and a cell with itself;
    cells are in the order of row and column."""
    last = np.cumsum(np.bincount(row, minlength=n))[row]
    each = last - np.arange(len(row))
    ends, low = np.cumsum(each), 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - each[low] + _AT_ONCE, "right")))
        m = each[low:high]
        a = np.repeat(np.arange(low, high), m)
        yield a, a + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
        low = high


class _Held:
    """The sums of a task's batches, added up by key and labels while they are of a bounded number, so
    that a task gives each sum about once, not once a batch."""

    WIDTH = 1 << 21

    def __init__(self, responses: int, most: int):
        self.responses, self.most = responses, max(1, most // (responses + 1))
        self.labels: dict = {}
        self.keys: dict = {}
        self.pieces: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.n = 0

    @staticmethod
    def _numbers(known: dict, values: list) -> np.ndarray:
        return np.array([known.setdefault(v, len(known)) for v in values], np.int64)

    def add(self, keys: list, labels: list[str], key: np.ndarray, i: np.ndarray, j: np.ndarray, g: list[np.ndarray]) -> None:
        k, at = self._numbers(self.keys, keys), self._numbers(self.labels, labels)
        self.pieces.append(((k[key] * self.WIDTH + at[i]) * self.WIDTH + at[j], g))
        self.n += len(key)
        if self.n > self.most:
            self._merge()

    def _merge(self) -> None:
        codes, where = np.unique(np.concatenate([c for c, _ in self.pieces]), return_inverse=True)
        self.pieces = [(codes, [np.bincount(where, np.concatenate([g[r] for _, g in self.pieces]), len(codes)) for r in range(self.responses)])]
        self.n = len(codes)

    def full(self) -> bool:
        """Whether merging no longer helps, so that what is held has to go on; or numbers run out."""
        return self.n > self.most // 2 or len(self.labels) > self.WIDTH // 2 or len(self.keys) > self.WIDTH // 4

    def take(self):
        """keys, labels, and key, i, j, sums of all that is held; nothing is held then."""
        if not self.pieces:
            return None
        self._merge()
        codes, g = self.pieces[0]
        out = list(self.keys), list(self.labels), codes // self.WIDTH**2, codes // self.WIDTH % self.WIDTH, codes % self.WIDTH, g
        self.labels, self.keys, self.pieces, self.n = {}, {}, [], 0
        return out


#: Numbers that a task holds at most (8 bytes each).
_HELD = 1 << 22


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _doubles(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)


def sums(rows: DataFrame, responses: list[tuple[str, str]], by: str | None = None) -> DataFrame:
    """(by), i, j and g0, g1, ... for each response (value column, weight column): weighted sums of
    products of columns i <= j, of a column and the response (j = ``~y``), and the response's moments.
    Rows whose value or weight is null, or whose weight is not above zero, are none of the response's."""
    lead = [by] if by else []
    extras = "extras" in rows.columns
    kind = f"{rows.schema[by].dataType.simpleString()}" if by else ""
    schema = ", ".join([*(f"`{c}` {kind}" for c in lead), "i string", "j string", *(f"g{r} double" for r in range(len(responses)))])
    used = list(dict.fromkeys(c for pair in responses for c in pair))

    def emitted(taken):
        keys, labels, key, i, j, g = taken
        texts = pa.array(labels, pa.string())
        first = [pa.array(keys, key_type[0]).take(pa.array(key))] if by else []
        return pa.RecordBatch.from_arrays([*first, texts.take(pa.array(i)), texts.take(pa.array(j)), *map(pa.array, g)], names=[*lead, "i", "j", *(f"g{r}" for r in range(len(g)))])

    key_type: list[pa.DataType] = []

    def run(batches):
        held = _Held(len(responses), _HELD)
        for b in batches:
            cells = pa.array(b.column("cells"))
            flat, size = cells.flatten(), _lengths(cells)
            rows_of = [np.repeat(np.arange(len(size)), size)]
            names, values = [flat.field("col")], [_doubles(flat.field("val"))]
            groups = np.zeros(0, np.int64)  # an extra cell's list
            if extras:
                outer = pa.array(b.column("extras"))
                inner = outer.flatten()
                flat, size = inner.flatten(), _lengths(inner)
                groups = np.repeat(np.arange(len(size)), size)
                rows_of.append(np.repeat(np.repeat(np.arange(len(b)), _lengths(outer)), size))
                names.append(flat.field("col"))
                values.append(_doubles(flat.field("val")))
            codes = pa.chunked_array(names).combine_chunks().dictionary_encode()
            labels = codes.dictionary
            order = np.argsort(np.array(labels.to_pylist(), object), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            p, col = len(order), rank[codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
            parts = np.split(col, [len(values[0])])
            weights, y = np.zeros((len(responses), len(b))), np.zeros((len(responses), len(b)))
            for r, (value, weight) in enumerate(responses):
                w = _doubles(b.column(weight))
                sound = pc.and_(pc.is_valid(b.column(value)), pc.is_valid(b.column(weight))).to_numpy(zero_copy_only=False)
                weights[r], y[r] = np.where(sound & (w > 0), w, 0.0), _doubles(b.column(value))
            if by:
                keyed = b.column(by).dictionary_encode()
                key_type[:] = [b.column(by).type]
                if not len(keyed.dictionary):
                    continue
                keys, code = keyed.dictionary, keyed.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                weights[:, code < 0] = 0.0
                code = np.maximum(code, 0)
            else:
                keys, code = [None], np.zeros(len(b), np.int64)
            table = _Sums(len(keys) * p * p, len(responses))
            line = _Sums(len(keys) * p, len(responses))
            some = [np.flatnonzero(v != 0) for v in values]
            (r0, c0, v0), *rest = [(r[s], c[s], v[s]) for r, c, v, s in zip(rows_of, parts, values, some)]
            at = np.argsort(r0 * p + c0, kind="stable")
            r0, c0, v0 = r0[at], c0[at], v0[at]
            again = bool(((r0[1:] == r0[:-1]) & (c0[1:] == c0[:-1])).any())  # a column that stands twice in a row
            for i, j in upper(r0, c0, len(b)):
                value = v0[i] * v0[j]
                if again:
                    value = value * (1 + ((i != j) & (c0[i] == c0[j])))
                table.add((code[r0[i]] * p + c0[i]) * p + c0[j], r0[i], value, weights)
            line.add(code[r0] * p + c0, r0, v0, weights * y)
            for r1, c1, v1 in rest:
                g1 = groups[some[1]]
                for i, j in ragged(r1, np.bincount(r0, minlength=len(b))):
                    a, z = np.minimum(c1[i], c0[j]), np.maximum(c1[i], c0[j])
                    table.add((code[r1[i]] * p + a) * p + z, r1[i], v1[i] * v0[j], weights)
                for i, j in ragged(g1, np.bincount(g1, minlength=len(size))):
                    keep = c1[i] <= c1[j]
                    i, j = i[keep], j[keep]
                    table.add((code[r1[i]] * p + c1[i]) * p + c1[j], r1[i], v1[i] * v1[j], weights)
                line.add(code[r1] * p + c1, r1, v1, weights * y)
            names = [*labels.take(pa.array(order)).to_pylist(), OUTCOME, *MOMENTS]
            spot, g = table.result()
            at, h = line.result()
            part = weights > 0
            logs = np.log(np.where(part, weights, 1.0))
            moment = [part, weights, logs, weights * y * y, np.where(part, y, 0.0), np.where(part, y * y, 0.0), weights * y]
            m = [[np.bincount(code, x[r], len(keys)) for r in range(len(responses))] for x in moment]
            key = np.concatenate([spot // (p * p) if p else spot, at // p if p else at, *[np.arange(len(keys))] * len(MOMENTS)])
            tail = np.repeat(p + 1 + np.arange(len(MOMENTS)), len(keys))
            i = np.concatenate([spot // p % p if p else spot, at % p if p else at, tail])
            j = np.concatenate([spot % p if p else spot, np.full(len(at), p), tail])
            held.add(keys.to_pylist() if by else keys, names, key, i, j, [np.concatenate([g[r], h[r], *(x[r] for x in m)]) for r in range(len(responses))])
            if held.full():
                yield emitted(held.take())
        if (left := held.take()) is not None:
            yield emitted(left)

    found = rows.select(*lead, *used, "cells", *(["extras"] if extras else [])).mapInArrow(run, schema)
    return found.groupBy(*lead, "i", "j").agg(*[F.sum(f"g{r}").alias(f"g{r}") for r in range(len(responses))])
