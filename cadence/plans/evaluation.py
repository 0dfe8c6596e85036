"""Evaluations beside the model ladder: what a prediction is made of, how much of a known truth a fit
finds, receivers' production with their teammates' lift, and outcomes carried to another table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import gram, metrics, ordered, profiles, splits
from . import confirmation, linear, models, variants

#: Penalties of a receiver's own level, and prior variances of teammates' lift.
BASE_GRID = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
TEAMMATE_GRID = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
#: Pairs are compared with the truth only between players of so many possessions, and only so many
#: pairs at least say anything.
SUPPORTED, FEWEST_PAIRS = 400, 8


def decomposed(rows: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``rows`` without cells, with talent (intercept and players), context (the other columns of it),
    their sum ``predicted`` and the ``residual``; players that the fit doesn't know add nothing."""
    outer = F.col("col").startswith("c_") & (F.col("col") != "c_intercept")
    parts = coefficients.select("col", F.when(outer, 0.0).otherwise(F.col("coef")).alias("talent"), F.when(outer, F.col("coef")).otherwise(0.0).alias("context"))
    total = F.col("talent") + F.col("context")
    return gram.scored(rows, parts).withColumn("predicted", total).withColumn("residual", F.col("y") - total)


def unseen_examples(train: DataFrame, test: DataFrame, coefficients: DataFrame, n: int = 6, seed: int = 3) -> DataFrame:
    """``n`` of the test side's lineups that train never saw, by a seeded hash order, with their novelty
    and the means of their stints' talent, context and rating."""
    new = splits.novelty(train, test).where("novelty <> 'seen'").select("lineup", "novelty")
    chosen = profiles.hash_sample(new, "lineup", n, seed)
    stints = test.withColumn("lineup", S.lineup_id("offense_player_ids")).join(F.broadcast(chosen), "lineup")  # n rows
    parts = decomposed(models.design_rows(stints, train, ("lineup", "novelty")), coefficients)
    means = [metrics.weighted_mean(c, "w").alias(c) for c in ("talent", "context", "predicted")]
    return parts.groupBy("lineup", "novelty").agg(F.sum("w").alias("possessions"), *means, metrics.weighted_mean("y", "w").alias("actual"))


def recovery(talent: DataFrame, pairs: DataFrame, exposure: DataFrame, least: int = SUPPORTED) -> DataFrame:
    """One row: how far estimates follow a known truth. talent: (side, member, truth, estimate), pairs:
    (a, b, truth, estimate), exposure: (member, possessions).

    Of the players with ``least`` possessions, numbered by id, the pairs at places i < j with
    (7 i + j) mod 11 = 0 are compared; fewer than eight give no pair correlation."""
    side = lambda s: metrics.correlation(F.when(F.col("side") == s, F.col("truth")), F.when(F.col("side") == s, F.col("estimate"))).alias(f"{s}_correlation")
    by_side = talent.agg(side("offense"), side("defense"))
    supported, _ = ordered.numbered(exposure.where(F.col("possessions") >= least).select("member"), [F.col("member")])
    supported = supported.persist()
    at = lambda end: supported.select(F.col("member").alias(end), F.col("place").alias(f"at_{end}"))
    compared = pairs.join(at("a"), "a").join(at("b"), "b").where("at_a < at_b and (7 * at_a + at_b) % 11 = 0")
    by_pair = compared.agg(F.count(F.lit(1)).alias("pairs"), F.when(F.count(F.lit(1)) >= FEWEST_PAIRS, F.coalesce(metrics.correlation(F.col("truth"), F.col("estimate")), F.lit(0.0))).alias("pair_correlation"))
    number = supported.agg(F.count(F.lit(1)).alias("supported"))
    out = by_side.crossJoin(number).crossJoin(by_pair)  # one row each
    rows = out.collect()
    supported.unpersist()
    return talent.sparkSession.createDataFrame(rows, out.schema)


def _receivers(production: DataFrame, dealt: DataFrame | None) -> DataFrame:
    """The receiver design, in which teammates perhaps stand for others: dealt is (member, giver)."""
    rows = models.receiver_design(production)
    if dealt is None:
        return rows
    names = dealt.select(F.concat(F.lit("t"), F.col("member").cast("string")).alias("col"), F.concat(F.lit("t"), F.col("giver").cast("string")).alias("other"))
    cells = rows.select("stint_id", "receiver", F.explode("cells").alias("c")).select("stint_id", "receiver", "c.col", "c.val").join(names, "col", "left")
    renamed = cells.groupBy("stint_id", "receiver").agg(F.collect_list(F.struct(F.coalesce("other", "col").alias("col"), "val")).alias("cells"))  # a row's few cells
    return rows.drop("cells").join(renamed, ["stint_id", "receiver"])


def production_lift(production: DataFrame, dealt: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(base, lift) of (stint_id, game_date, member, fg, ft, assisted, w): coefficients by column.

    Stage one is a ridge of the receiver's own columns whose penalty has the least residual sum for
    each degree of freedom; stage two regresses its residuals on the teammates present, with the prior
    variance of greatest marginal likelihood. Each stage is one pass of statistics."""
    spark = production.sparkSession
    rows = _receivers(production, dealt)
    of = lambda keep: rows.withColumn("cells", F.filter("cells", lambda c: c["col"].startswith("t") == F.lit(not keep)))
    s = linear.collect(of(True))[None]
    freedom = max(s.n - len(s.columns), 1.0)
    coef = min((linear.ridge(s, p) for p in BASE_GRID), key=s.residual)
    base = spark.createDataFrame([(c, float(v)) for c, v in zip(s.columns, coef)], "col string, coef double")
    kept = gram.scored(rows, base).select("stint_id", "receiver", (F.col("y") - F.col("predicted")).alias("y"), "w")
    second = linear.collect(of(False).drop("y", "w").join(kept, ["stint_id", "receiver"]))[None]
    effects = linear.evidence(second, max(s.residual(coef) / freedom, 1e-12), TEAMMATE_GRID)
    return base, spark.createDataFrame([(c, float(v)) for c, v in zip(second.columns, effects)], "col string, coef double")


def evaluate_production(production: DataFrame, permute: int = 29) -> DataFrame:
    """model, macro_rmse, micro_rmse over receivers: their own level, with teammates' lift, and with a
    lift fitted to teammates dealt out anew, which says nothing of those present; on rows from the cut date on, all of whose players are known
    from before it."""
    sided = splits.date_cut(production, "game_date", ["stint_id"])
    train, test = (sided.where(F.col("side") == s).drop("side") for s in ("train", "test"))
    known = train.select("member").distinct()
    strange = test.join(known, "member", "left_anti").select("stint_id").distinct()
    test = test.join(strange, "stint_id", "left_anti")
    scored = None
    dealt = profiles.permuted(known.withColumn("giver", F.col("member")), "member", "giver", permute)
    for name, names in (("lift", None), ("lift_placebo", dealt)):
        base, lift = production_lift(train, names)
        both = base.select("col", F.col("coef").alias("base"), F.lit(0.0).alias(name)).union(lift.select("col", F.lit(0.0), "coef"))
        one = gram.scored(_receivers(test, None), both).withColumn(name, F.col("base") + F.col(name))
        scored = one if scored is None else scored.join(one.select("stint_id", "receiver", name), ["stint_id", "receiver"])
    return models.rung_errors(scored, "receiver", ("base", "lift", "lift_placebo")).select(F.col("rung").alias("model"), "macro_rmse", "micro_rmse")


def transport_outcome(train: DataFrame, test: DataFrame, counts: DataFrame, roles: DataFrame, k: int, outcome: str = "three_share", minimum: int = 3, least: int = 5, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """model, lineups, macro_rmse, and how far the role model's macro error lies under the model's over
    resampled lineups (low, high, share_positive): an outcome's hierarchical fit of one table, that with
    role pairs, and with roles (member, role) dealt out anew, on another table's lineups of ``least``
    stints and more."""
    spark = train.sparkSession
    valued = profiles.outcome(counts, outcome, minimum).select("stint_id", F.col("value").alias("y"), F.col("weight").alias("w"))
    dealt = profiles.permuted(roles, "member", "role", seed + 1)
    known = {"role": variants.of_roles("role", roles, k), "role_placebo": variants.of_roles("placebo", dealt, k)}
    named = lambda s: s.withColumn("lineup", S.lineup_id("offense_player_ids"))
    rows = lambda s: variants.add(models.design_rows(named(s), train, ("lineup", variants.MEMBERS)).drop("y", "w").join(valued, "stint_id"), list(known.values()))
    # One pass over the train side for all models' statistics, and one over the test side for all predictions.
    stats = linear.collect(rows(train))[None]
    fits = {name: linear.expectation_maximisation(confirmation.model_part(stats, v), models.PLAYERS | {"roles": ("v:",)}, rounds=30) for name, v in ({"rung3": None} | known).items()}
    columns = sorted({c for f in fits.values() for c in f.columns})
    coefs = np.stack([f.on(columns) for f in fits.values()], axis=1)
    table = spark.createDataFrame([(c, *map(float, v)) for c, v in zip(columns, coefs)], "col string, " + ", ".join(f"{n} double" for n in fits))
    scored = gram.scored(variants.flattened(rows(test)), table)
    groups = scored.groupBy("lineup").agg(F.count(F.lit(1)).alias("stints"), *[metrics.weighted_mean(c, "w").alias(c) for c in ("y", *fits)]).where(F.col("stints") >= least)
    groups = groups.persist()
    square = lambda c: (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))
    drawn = metrics.bootstrap(groups, "lineup", replicates, seed, **{n: square(n) for n in fits}).persist()
    root = lambda c: F.sqrt(F.col(c) / F.col("draws"))
    out = None
    for name in fits:
        error = groups.agg(F.count(F.lit(1)).alias("lineups"), metrics.rmse(F.col("y") - F.col(name)).alias("macro_rmse"))
        gap = metrics.interval(drawn.withColumn("gap", root(name) - root("role")), "gap")
        one = error.crossJoin(gap).select(F.lit(name).alias("model"), "*")  # one row each
        out = one if out is None else out.union(one)
    rows_out = out.collect()  # a row for each model
    for held in (drawn, groups):
        held.unpersist()
    return spark.createDataFrame(rows_out, out.schema)
