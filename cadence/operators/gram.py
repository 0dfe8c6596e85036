"""Sufficient statistics of weighted linear models, from one distributed pass.

A design is a long table (row, col, val) with (row, y, w) aside, or the array forms below; the
results are (i, j, g) with i <= j and (i, b). Their size depends on the columns, not on the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import MOMENTS, OUTCOME

#: What context columns are worked out from, beside the season.
CONTEXT = ("home_offense", "score_margin_offense", "period", "playoff", "days_rest_offense", "garbage_time_weight")


def scaler(stints: DataFrame, *more: Column) -> DataFrame:
    """One row of training means and deviations of margin and rest (zero deviation: 1)."""
    sd = lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
    return stints.agg(F.avg("score_margin_offense").alias("m_margin"), sd("score_margin_offense").alias("s_margin"), F.avg("days_rest_offense").alias("m_rest"), sd("days_rest_offense").alias("s_rest"), *more)


def context_columns(seasons: list[int], scale: dict[str, Column], periods: tuple[int, ...] = (2, 3, 4)) -> dict[str, Column]:
    """The context columns in order; period 4 means the fourth or later, and the first season is the
    baseline. ``scale`` has ``scaler``'s four values."""
    z = lambda c, k: (F.col(c) - scale[f"m_{k}"]) / scale[f"s_{k}"]
    cols = {"intercept": F.lit(1.0), "home": F.col("home_offense").cast("double"), "margin": z("score_margin_offense", "margin"), "margin2": z("score_margin_offense", "margin") * z("score_margin_offense", "margin")}
    for p in periods:
        cols[f"period_{p}"] = (F.col("period") >= p if p == max(periods) else F.col("period") == p).cast("double")
    cols |= {"playoff": F.col("playoff").cast("double"), "rest": z("days_rest_offense", "rest"), "garbage": F.col("garbage_time_weight") - 1}
    return cols | {f"season_{s}": (F.col("season_index") == s).cast("double") for s in seasons[1:]}


_SCALE = ("m_margin", "s_margin", "m_rest", "s_rest")


def context(stints: DataFrame, scale: DataFrame, seasons: list[int], periods: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """stint_id and the context columns in order."""
    cols = context_columns(seasons, {k: F.col(k) for k in _SCALE}, periods)
    return stints.crossJoin(F.broadcast(scale)).select("stint_id", *[v.alias(k) for k, v in cols.items()])  # scale: one row


def _response() -> tuple[Column, Column]:
    return 100.0 * F.col("points_scored") / F.col("offensive_possessions"), F.col("offensive_possessions").cast("double")


def design(stints: DataFrame, context: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """stint_id, the columns ``keep``, y, w and ``cells``: an array of (col, val). Offense counts +1,
    defense -1. Context columns are worked out in the same row, so a stint is read once."""
    y, w = _response()
    side = lambda members, tag, v: F.transform(members, lambda p: F.struct(F.concat(F.lit(tag), p.cast("string")).alias("col"), F.lit(v).alias("val")))
    cells = F.concat(side("offense_player_ids", "o", 1.0), side("defense_player_ids", "d", -1.0))
    if context:
        cells = F.concat(F.array(*[F.struct(F.lit(f"c_{n}").alias("col"), c.alias("val")) for n, c in context.items()]), cells)
    return stints.select("stint_id", *keep, y.alias("y"), w.alias("w"), cells.alias("cells"))


def season_parts(stints: DataFrame, context: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the statistics of ``design`` are made of, as plain groupings of the stints: (contexts, members, pairs).

    contexts: season_index, each context column, n, sw, slogw, q, sy, syy, swy over the stints of one context;
    members: season_index, team, on (offense), player, w, wy and the sums of w times each context column;
    pairs: season_index, team, a_on, a, b_on, b, g: sums of w over the stints of both, defense before offense and a <= b.
    The team is that of the offense, null where only defenders stand. Stints without a rating or of no weight are left out.
    """
    y, w = _response()
    five, against = F.col("offense_player_ids"), F.col("defense_player_ids")
    sound = lambda *keep: stints.select("season_index", *keep, y.alias("y"), w.alias("w")).where("season_index IS NOT NULL AND y IS NOT NULL AND w > 0")
    names = [f"c_{k}" for k in context]
    # the context columns are worked out once for the stints of one context
    sums = {"n": F.count(F.lit(1)), "sw": F.sum("w"), "slogw": F.sum(F.ln("w")), "q": F.sum(F.col("w") * F.col("y") * F.col("y")), "sy": F.sum("y"), "syy": F.sum(F.col("y") * F.col("y")), "swy": F.sum(F.col("w") * F.col("y"))}
    contexts = sound(*CONTEXT).groupBy("season_index", *CONTEXT).agg(*[v.alias(k) for k, v in sums.items()]).select("season_index", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, context.values())], *sums)
    seats = lambda df, of, *keep: df.select("season_index", "team", "w", "size", *keep, F.posexplode(of).alias("place", "player")).withColumn("on", F.col("place") < F.col("size"))
    seated = [F.col("offense_team_id").alias("team"), F.size(five).alias("size"), five.alias("five"), F.concat(five, against).alias("members")]
    one = seats(sound(*seated, *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(names, context.values())]), "members", "y", *names)
    members = one.groupBy("season_index", F.when(F.col("on"), F.col("team")).alias("team"), "on", "player").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"), *[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])
    two = seats(sound(*seated), "members", "five", "members").withColumnsRenamed({"player": "a", "on": "a_on"})
    met = F.when(F.col("a_on"), F.col("five")).otherwise(F.col("members"))
    two = seats(two, met, "a", "a_on").withColumnsRenamed({"player": "b", "on": "b_on"}).where("b_on AND NOT a_on OR a_on = b_on AND a <= b")
    pairs = two.groupBy("season_index", F.when(F.col("b_on"), F.col("team")).alias("team"), "a_on", "a", "b_on", "b").agg(F.sum("w").alias("g"))
    return contexts, members, pairs


def column(on: Column, player: Column) -> Column:
    """The column of a player on offense or defense."""
    return F.concat(F.when(on, "o").otherwise("d"), player.cast("string"))


def _sign(on: Column) -> Column:
    return F.when(on, 1.0).otherwise(-1.0)


def _unpivoted(df: DataFrame, names: list[str], *keep: Column | str) -> DataFrame:
    """``keep``, col and val for each of the columns ``names``; zeros are left out."""
    cells = F.array(*[F.struct(F.lit(n).alias("col"), F.col(n).cast("double").alias("val")) for n in names])
    return df.select(*keep, F.explode(cells).alias("c")).select("*", "c.col", "c.val").drop("c").where("val <> 0")


def season_sums(contexts: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """season_index, i, j, g0 as ``shared.sums`` gives them, from ``season_parts``."""
    names = [c for c in contexts.columns if c.startswith("c_")]
    numbered = dict(zip(MOMENTS, ("n", "sw", "slogw", "q", "sy", "syy", "swy")))
    g = lambda v: F.sum(v).alias("g0")
    added = lambda df, i, j, v: df.groupBy("season_index", i.alias("i"), j.alias("j")).agg(g(v))
    listed = _unpivoted(contexts, names, "season_index", "sw", "swy", *names)
    both = _unpivoted(listed.withColumnsRenamed({"col": "left", "val": "x"}), names, "season_index", "sw", "left", "x").where("left <= col")
    total = contexts.groupBy("season_index").agg(*[F.sum(v).cast("double").alias(k) for k, v in numbered.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("i"), F.col(k).alias("g0")) for k in MOMENTS])
    moments = total.select("season_index", F.explode(cells).alias("c")).select("season_index", F.col("c.i").alias("i"), F.col("c.i").alias("j"), "c.g0")
    own, outcome = column(F.col("on"), F.col("player")), F.lit(OUTCOME)
    signed = _unpivoted(members, names, "season_index", "on", "player")
    parts = [
        added(both, F.col("left"), F.col("col"), F.col("sw") * F.col("x") * F.col("val")),
        added(listed, F.col("col"), outcome, F.col("swy") * F.col("val")),
        added(signed, F.col("col"), own, _sign(F.col("on")) * F.col("val")),
        added(members, own, outcome, _sign(F.col("on")) * F.col("wy")),
        added(pairs, column(F.col("a_on"), F.col("a")), column(F.col("b_on"), F.col("b")), _sign(F.col("a_on")) * _sign(F.col("b_on")) * F.col("g")),
    ]
    for p in parts:
        moments = moments.unionByName(p)
    return moments


def member_scores(members: DataFrame, pairs: DataFrame, coefficients: DataFrame) -> DataFrame:
    """season_index, team, player, y, w, predicted: the weighted mean rating and prediction over an
    offense player's stints, by coefficients (season_index, col, coef) of each season. A prediction is a
    sum over cells, so its sum over stints follows from the cells' sums."""
    names, key = [c for c in members.columns if c.startswith("c_")], ["season_index", "team", "player"]
    seasons = coefficients.select("season_index").distinct()
    offense = members.where("on").join(F.broadcast(seasons), "season_index", "left_semi")  # a few seasons
    first = pairs.where("b_on").select("season_index", "team", F.col("b").alias("player"), column(F.col("a_on"), F.col("a")).alias("col"), (_sign(F.col("a_on")) * F.col("g")).alias("val"))
    second = pairs.where("a_on AND a <> b").select("season_index", "team", F.col("a").alias("player"), column(F.col("b_on"), F.col("b")).alias("col"), F.col("g").alias("val"))
    cells = _unpivoted(offense, names, *key).unionByName(first).unionByName(second)
    total = cells.join(coefficients, ["season_index", "col"]).groupBy(*key).agg(F.sum(F.col("val") * F.col("coef")).alias("p"))
    return offense.join(total, key, "left").select(*key, (F.col("wy") / F.col("w")).alias("y"), "w", (F.coalesce("p", F.lit(0.0)) / F.col("w")).alias("predicted"))


#: Products of a batch are summed in a dense table of so many cells at most, else by sorting.
_DENSE = 1 << 23


def gram(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(i, j, g), i <= j: sums of w times the product of two cells of a row. Pairs are made within
    the row's own array and summed within each Arrow batch, so the shuffle holds sums only."""
    by = by or []
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema), "i string", "j string", "g double"])

    def run(batches):
        for b in batches:
            cells = pa.array(b.column("cells"))
            lengths = np.diff(cells.offsets.to_numpy()) if len(cells) else np.zeros(0, np.int64)
            flat = cells.flatten()
            names = flat.field("col").dictionary_encode()
            order = np.argsort(np.array(names.dictionary.to_pylist(), object)) if len(names.dictionary) else np.zeros(0, np.int64)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            col, val = rank[names.indices.to_numpy()], flat.field("val").cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            used = val != 0
            row, col, val = row[used], col[used], val[used]
            at = np.lexsort((col, row))
            row, col, val = row[at], col[at], val[at]
            size = np.bincount(row, minlength=len(lengths))
            first = np.cumsum(size) - size
            w = b.column("w").cast(pa.float64()).to_numpy(zero_copy_only=False)
            group = pa.StructArray.from_arrays([b.column(c) for c in by], by).to_pylist() if by else None
            keys = {k: n for n, k in enumerate(dict.fromkeys(tuple(g.values()) for g in group))} if by else {(): 0}
            code = np.array([keys[tuple(g.values())] for g in group], np.int64) if by else np.zeros(len(w), np.int64)
            p = len(order)
            dense = np.zeros(len(keys) * p * p) if len(keys) * p * p <= _DENSE else None
            hit = np.zeros(0 if dense is None else len(dense), bool)  # sums of zero count too
            spots, sums = [], []
            for n in np.unique(size[size > 0]):
                u, v = np.triu_indices(n)
                some = np.flatnonzero(size == n)
                for low in range(0, len(some), step := max(1, (1 << 20) // len(u))):
                    part = some[low : low + step]
                    place = first[part][:, None] + np.arange(n)
                    c, x = col[place], val[place]
                    twice = 1 + ((u < v) & (c[:, u] == c[:, v]))  # a column that stands twice in a row
                    spot = ((code[part][:, None] * p + c[:, u]) * p + c[:, v]).ravel()
                    weight = (w[part][:, None] * x[:, u] * x[:, v] * twice).ravel()
                    if dense is not None:
                        dense += np.bincount(spot, weight, len(dense))
                        hit[spot] = True
                    else:
                        found, where = np.unique(spot, return_inverse=True)
                        spots.append(found)
                        sums.append(np.bincount(where, weight))
            if dense is not None:
                spot = np.flatnonzero(hit)
                g = dense[spot]
            else:
                spot, g = np.concatenate([np.zeros(0, np.int64), *spots]), np.concatenate([np.zeros(0), *sums])
            labels = names.dictionary.take(pa.array(order))
            every = list(keys)
            kinds = [b.schema.field(c).type for c in by]
            lead = [pa.array([k[n] for k in every], t).take(pa.array(spot // (p * p))) for n, t in enumerate(kinds)] if p else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*lead, labels.take(pa.array(spot // p % p if p else spot)), labels.take(pa.array(spot % p if p else spot)), pa.array(g)], names=[*by, "i", "j", "g"])

    return rows.select(*by, "w", "cells").mapInArrow(run, schema).groupBy(*by, "i", "j").agg(F.sum("g").alias("g"))


def rhs(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(i, b): sums of w times y times the cell."""
    by = by or []
    return rows.select(*by, "w", "y", F.explode("cells").alias("c")).groupBy(*by, F.col("c.col").alias("i")).agg(F.sum(F.col("w") * F.col("y") * F.col("c.val")).alias("b"))


def moments(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, sum of w, of ln w, of w y^2, and the plain population variance of y."""
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.ln("w")).alias("slogw"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("q"), F.var_pop("y").alias("var_y"))


def group_rows(rows: DataFrame, group: str) -> DataFrame:
    """(group, col, val): the weighted mean design row of each group."""
    total = rows.groupBy(group).agg(F.sum("w").alias("total"))
    cells = rows.select(group, "w", F.explode("cells").alias("c")).groupBy(group, F.col("c.col").alias("col")).agg(F.sum(F.col("w") * F.col("c.val")).alias("v"))
    return cells.join(total, group).select(group, "col", (F.col("v") / F.col("total")).alias("val"), F.col("total").alias("weight"))


def scored(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``rows`` without their cells, with a prediction for each coefficient column (``coef`` gives
    ``predicted``): unseen columns contribute nothing. Each row is finished where it lies; the
    coefficients (a model's, so of bounded number) go to every task."""
    table = coefficients.toArrow()
    names = [c for c in coefficients.columns if c != "col"]
    known = table.column("col").combine_chunks()
    values = np.column_stack([table.column(c).to_numpy() for c in names] or [np.zeros(len(known))])
    model = rows.sparkSession.sparkContext.broadcast((known.to_pylist(), np.vstack([values, np.zeros((1, values.shape[1]))])))
    kept = [c for c in rows.columns if c != "cells"]

    def run(batches):
        known, values = model.value
        known = pa.array(known, pa.string())
        for b in batches:
            cells = pa.array(b.column("cells"))
            flat = cells.flatten()
            at = pc.index_in(flat.field("col"), value_set=known).fill_null(len(known)).to_numpy()
            val = flat.field("val").cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy())) if len(cells) else np.zeros(0, np.int64)
            out = [np.bincount(row, values[at, k] * val, len(cells)) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *map(pa.array, out)], names=[*kept, *(_predicted(n) for n in names)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), *(f"`{_predicted(n)}` double" for n in names)])
    return rows.select(*kept, "cells").mapInArrow(run, schema)


def _predicted(name: str) -> str:
    return "predicted" if name == "coef" else name


def predict(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """stint_id and the predictions of ``scored``."""
    return scored(rows.select("stint_id", "cells"), coefficients)
