"""Error, calibration and bootstrap statistics over grouped rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered

#: Two-sided normal quantiles of the coverage levels.
LEVELS = {"50": 0.6744897501960817, "80": 1.2815515655446004, "95": 1.959963984540054}


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(weight) * F.col(value)) / F.sum(weight)


def rmse(error: Column, weight: Column | None = None) -> Column:
    if weight is None:
        return F.sqrt(F.avg(error * error))
    return F.sqrt(F.sum(weight * error * error) / F.sum(weight))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null where either has no spread."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def grouped(rows: DataFrame, group: str, actual: str, predicted: str, weight: str) -> DataFrame:
    """group, support, weight, and the weighted means of both."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("support"), F.sum(weight).cast("double").alias("weight"), weighted_mean(actual, weight).alias("actual"), weighted_mean(predicted, weight).alias("predicted"))


def micro_macro(rows: DataFrame, group: str, actual: str, predicted: str, weight: str) -> DataFrame:
    """One row: micro errors over rows by weight, macro errors over groups' means, all groups alike."""
    error = F.col(actual) - F.col(predicted)
    micro = rows.agg(rmse(error, F.col(weight)).alias("micro_rmse"), (F.sum(F.col(weight) * F.abs(error)) / F.sum(weight)).alias("micro_mae"), F.count(F.lit(1)).alias("rows"))
    gap = F.col("actual") - F.col("predicted")
    macro = grouped(rows, group, actual, predicted, weight).agg(rmse(gap).alias("macro_rmse"), F.avg(F.abs(gap)).alias("macro_mae"), F.count(F.lit(1)).alias("groups"))
    return micro.crossJoin(macro)  # one row each


def group_rmse_gain(rows: DataFrame, group: str, actual: str, base: str, model: str, weight: str) -> DataFrame:
    """One row: by how much the model's error over groups is under the base's; groups of one row go."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"), *[weighted_mean(c, weight).alias(c) for c in (actual, base, model)]).where("n >= 2")
    return g.agg(rmse(F.col(actual) - F.col(base), F.col("w")).alias("base_rmse"), rmse(F.col(actual) - F.col(model), F.col("w")).alias("model_rmse"), F.count(F.lit(1)).alias("groups")).withColumn("gain", F.col("base_rmse") - F.col("model_rmse"))


def gain_percent(rows: DataFrame, group: str, actual: str, base: str, model: str, weight: str) -> DataFrame:
    """One row: micro and macro errors of base and model, and by how many per cent of the base's error
    the model's is smaller."""
    one = lambda c, tag: micro_macro(rows, group, actual, c, weight).select(F.col("micro_rmse").alias(f"{tag}_micro"), F.col("macro_rmse").alias(f"{tag}_macro"))
    both = one(base, "base").crossJoin(one(model, "model"))  # one row each
    percent = lambda k: (100.0 * F.try_divide(F.col(f"base_{k}") - F.col(f"model_{k}"), F.col(f"base_{k}"))).alias(f"{k}_gain_percent")
    return both.select("*", percent("micro"), percent("macro"))


def calibration(groups: DataFrame, point: str, sd: str, actual: str) -> DataFrame:
    """One row: coverage at each level, z moments, calibration line by 1/sd^2, width against error."""
    z = (F.col(actual) - F.col(point)) / F.col(sd)
    w, x, y = 1 / (F.col(sd) * F.col(sd)), F.col(point), F.col(actual)
    out = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        *[F.avg((F.abs(z) <= c).cast("double")).alias(f"coverage_{k}") for k, c in LEVELS.items()],
        F.avg(z).alias("z_mean"),
        F.coalesce(F.stddev_samp(z), F.lit(0.0)).alias("z_sd"),
        F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"),
        F.coalesce(correlation(F.col(sd), F.abs(F.col(actual) - F.col(point))), F.lit(0.0)).alias("width_vs_error"),
    )
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    usable = (F.col("groups") >= 2) & (F.abs(det) > 1e-12)
    slope = F.when(usable, F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), det)).otherwise(1.0)
    return out.withColumn("slope", slope).withColumn("intercept", F.when(usable, (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).otherwise(0.0)).drop("sw", "sx", "sy", "sxx", "sxy")


def summary(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.avg(F.abs(v)).alias("mean_abs"), F.sqrt(F.avg(v * v)).alias("rmse"), F.avg((v > 0).cast("double")).alias("share_positive"))


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope, intercept and correlation; zeros for fewer than five rows, (0, mean, 0) without spread."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), correlation(F.col(y), F.col(x)).alias("c"), F.avg(y).alias("m"), (F.max(x) - F.min(x)).alias("r"))
    few, flat = F.col("n") < 5, F.col("r") == 0
    pick = lambda v, f: F.when(few, 0.0).when(flat, f).otherwise(F.coalesce(v, F.lit(0.0)))
    return s.select("n", pick(F.col("s"), F.lit(0.0)).alias("slope"), pick(F.col("i"), F.col("m")).alias("intercept"), pick(F.col("c"), F.lit(0.0)).alias("correlation"))


def draws(groups: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """replicate, place, times, and ``groups`` with their ``place`` and number: draws with
    replacement by hash, as many as groups.

    Draw d of replicate r takes the group at place md5(seed|r|d) mod n. Draws are made where the
    groups lie and counted by place, so the join is on the place, not a product of all rows.
    """
    placed, n = ordered.numbered(groups, [F.col(key)])
    each = placed.select(F.col("place").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    taken = each.select("replicate", S.draw(F.lit(max(n, 1)), F.lit(seed), F.col("replicate"), F.col("d")).alias("place")).groupBy("replicate", "place").agg(F.count(F.lit(1)).alias("times"))
    return taken.join(placed, "place")


#: Values of groups (8 bytes each) of so many bytes altogether go to every task.
SENT_BYTES = 64 << 20


def bootstrap(groups: DataFrame, key: str, replicates: int, seed: int, sent_bytes: int = SENT_BYTES, **sums: Column) -> DataFrame:
    """replicate, sums over groups drawn with replacement, and the number of draws.

    While the groups' values take ``sent_bytes`` at most, they go to every task, which makes the
    draws of its own groups' places and adds up a vector of all replicates' sums: what is shuffled is one row for each
    task and replicate. Beyond that, draws are counted by place and joined with the groups.
    """
    names = list(sums)
    wanted = groups.select(key, *[c.cast("double").alias(name) for name, c in sums.items()]).persist()
    try:
        n = wanted.count()
        table = wanted.toArrow() if n * (len(names) + 1) * 8 <= sent_bytes else None
    finally:
        wanted.unpersist()
    if table is None:
        joined = draws(groups, key, replicates, seed)
        return joined.groupBy("replicate").agg(*[F.sum(F.col("times") * c).alias(name) for name, c in sums.items()], F.sum("times").alias("draws"))
    table = table.take(pc.sort_indices(table, sort_keys=[(key, "ascending")], null_placement="at_start"))  # a group's place is its key's
    values = np.column_stack([table.column(name).fill_null(0.0).to_numpy() for name in names])
    sent = groups.sparkSession.sparkContext.broadcast(values)

    def run(batches):
        started = [hashlib.md5(f"{seed}|{r}|".encode()) for r in range(replicates)]
        total, count = np.zeros((replicates, len(names))), 0
        for b in batches:
            for d in b.column("id").to_pylist():
                last, at = str(d).encode(), np.empty(replicates, np.int64)
                for r, base in enumerate(started):
                    one = base.copy()
                    one.update(last)
                    at[r] = int.from_bytes(one.digest()[:4], "big") % n
                total += sent.value[at]
                count += 1
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates), pa.int32()), *map(pa.array, total.T.copy()), pa.array(np.full(replicates, count), pa.int64())], names=["replicate", *names, "draws"])

    places = groups.sparkSession.range(0, n, 1, max(1, min(256, n * replicates // 200_000)))
    parts = places.mapInArrow(run, ", ".join(["replicate int", *(f"`{name}` double" for name in names), "draws bigint"]))
    return parts.groupBy("replicate").agg(*[F.sum(name).alias(name) for name in names], F.sum("draws").alias("draws"))


def interval(replicates: DataFrame, value: str, low: float = 0.025, high: float = 0.975, fewest: int = 3) -> DataFrame:
    """One row: the sorted values at floor(low B) and min(floor(high B), B - 1), and the share above
    0; zeros if fewer than ``fewest`` groups were drawn from, as so few say nothing."""
    s = replicates.agg(F.array_sort(F.collect_list(value)).alias("v"), F.max("draws").alias("groups"))  # B values
    b = F.size("v")
    known = F.coalesce(F.col("groups") >= fewest, F.lit(False))
    at = lambda p: F.when(known, F.get("v", F.least(F.floor(p * b).cast("int"), b - 1))).otherwise(0.0)
    return s.select(at(low).alias("low"), at(high).alias("high"), F.when(known, F.size(F.filter("v", lambda x: x > 0)) / b).otherwise(0.0).alias("share_positive"))


def by_context(rows: DataFrame, actual: str, predicted: str, weight: str) -> DataFrame:
    """context (all, clutch, other), rows and weighted RMSE, from one pass over labelled copies."""
    labelled = rows.withColumn("context", F.explode(F.array(F.lit("all"), F.when(S.is_clutch(F.col("score_margin_offense"), F.col("period")), "clutch").otherwise("other"))))
    return labelled.groupBy("context").agg(F.count(F.lit(1)).alias("rows"), rmse(F.col(actual) - F.col(predicted), F.col(weight)).alias("rmse"))


def holdout_groups(rows: DataFrame, kind: str, held: DataFrame | None = None) -> DataFrame:
    """(stint_id, group): a test row's groups are its lineup, its held pairs (perhaps several), or
    its calendar month."""
    if kind == "lineup":
        return rows.select("stint_id", S.lineup_id("offense_player_ids").alias("group"))
    if kind == "month":
        return rows.select("stint_id", F.date_format("game_date", "yyyy-MM").alias("group"))
    pairs = rows.select("stint_id", F.explode(S.pairs_of("offense_player_ids")).alias("p")).select("stint_id", "p.a", "p.b")
    return pairs.join(held.select("a", "b"), ["a", "b"], "left_semi").select("stint_id", S.pair_id("a", "b").alias("group"))


def pair_coverage(groups: DataFrame, fives: DataFrame, admitted: DataFrame, actual: str, predicted: str) -> DataFrame:
    """covered, lineups, rmse: lineups all of whose pairs are admitted, and the others."""
    pairs = fives.select("lineup", F.explode(S.pairs_of("five")).alias("p")).select("lineup", "p.a", "p.b")
    known = pairs.join(admitted.select("a", "b", F.lit(1).alias("k")), ["a", "b"], "left").groupBy("lineup").agg((F.min(F.coalesce("k", F.lit(0))) == 1).alias("covered"))
    return groups.join(known, "lineup").groupBy("covered").agg(F.count(F.lit(1)).alias("lineups"), rmse(F.col(actual) - F.col(predicted)).alias("rmse"))


def pair_errors(rows: DataFrame, actual: str, predicted: str, weight: str, minimum: int = 5) -> DataFrame:
    """a, b, stints, actual, predicted of pairs with at least ``minimum`` test stints."""
    pairs = rows.select(F.explode(S.pairs_of("offense_player_ids")).alias("p"), actual, predicted, weight)
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("stints"), weighted_mean(actual, weight).alias("actual"), weighted_mean(predicted, weight).alias("predicted")).where(F.col("stints") >= minimum)


def abs_gap(real: DataFrame, phantom: DataFrame, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """replicate, gap: mean |value| of a resampled cohort less that of the other, draws by hash."""
    size = F.abs(F.col(value))
    one = lambda df, s, n: bootstrap(df, key, replicates, s, total=size).select("replicate", (F.col("total") / F.col("draws")).alias(n))
    return one(real, seed, "a").join(one(phantom, seed + 1, "b"), "replicate").select("replicate", (F.col("a") - F.col("b")).alias("gap"))


def mediation(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """One row: groups that both have, and the correlation of their values."""
    both = first.select(key, F.col(value).alias("x")).join(second.select(key, F.col(value).alias("y")), key)
    return both.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(correlation(F.col("x"), F.col("y")), F.lit(0.0)).alias("correlation"))
