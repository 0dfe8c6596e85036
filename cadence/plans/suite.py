"""The whole model on every holdout: additive against full, by rows and by groups, and what it recovers.

Of each holdout the train side gives one additive and one interaction fit (with its ensemble); the test
side is scored in one pass, from which all errors, group rows and resampled games follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contract, gram, metrics
from . import chemistry, evaluation, models

BLOCKS = 400


def scored_holdout(train: DataFrame, test: DataFrame, members: int = 0, seed: int = 0) -> tuple[DataFrame, list[chemistry.Interactions]]:
    """Test stints (stint_id, game_id, game_date, offense_player_ids, y, w, additive, full), and the fits."""
    fits, _, _ = models.chemistry_of(train, members, seed)
    keep = ("game_id", "game_date", "offense_player_ids")
    rows = gram.scored(models.design_rows(test, train, keep), models.fit_ridge(train).table(train.sparkSession)).withColumnRenamed("predicted", "additive")
    scored = chemistry.effects(rows, fits[:1])
    return scored.withColumn("full", F.col("additive") + F.get("effects", F.lit(0))).drop("effects", "known"), fits


def _errors(rows: DataFrame, target: str, tag: str) -> DataFrame:
    """One row: micro and macro RMSE and MAE of additive and full predictions against ``target``."""
    out = None
    for name in ("additive", "full"):
        one = metrics.micro_macro(rows, "group", target, name, "w").select(*[F.col(f"{k}").alias(f"{name}_{k}{tag}") for k in ("micro_rmse", "micro_mae", "macro_rmse", "macro_mae")])
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def evaluate(stints: DataFrame, holdouts: dict[str, tuple], truth: DataFrame | None = None, members: int = 0, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """A row for each holdout: stints and groups, micro and macro errors of the additive and the full
    model (and against a known ``truth``: stint_id, truth), by how many per cent the full one's macro
    error is smaller (against the truth, if known), and the difference of micro errors with its 80 %
    interval over resampled games and the share in which the full model is better.

    holdouts: name to (split, kind of groups, held pairs or None). A test stint in several groups
    counts once in micro errors.
    """
    spark, out, schema = stints.sparkSession, [], None
    for name, (split, kind, held) in holdouts.items():
        sided = stints.join(split.where("side <> 'drop'"), "stint_id")
        train, test = sided.where("side = 'train'").drop("side").persist(), sided.where("side = 'test'").drop("side")
        rows, _ = scored_holdout(train, test, members, seed)
        if truth is not None:
            rows = rows.join(truth.select("stint_id", "truth"), "stint_id")
        rows = rows.persist()
        grouped = rows.join(metrics.holdout_groups(rows, kind, held), "stint_id").persist()
        single = rows.withColumn("group", F.lit("all"))
        micro = lambda t, tag: _errors(single, t, tag).select(*[f"{m}_micro_{e}{tag}" for m in ("additive", "full") for e in ("rmse", "mae")])
        macro = lambda t, tag: _errors(grouped, t, tag).select(*[f"{m}_macro_{e}{tag}" for m in ("additive", "full") for e in ("rmse", "mae")])
        errors = micro("y", "").crossJoin(macro("y", ""))  # one row each
        target, tag = "y", ""
        if truth is not None:
            target, tag = "truth", "_truth"
            errors = errors.crossJoin(micro("truth", tag)).crossJoin(macro("truth", tag))
        square = lambda c: (F.col(target) - F.col(c)) * (F.col(target) - F.col(c))
        games = rows.groupBy("game_id").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * square(c)).alias(c) for c in ("additive", "full")])
        drawn = metrics.bootstrap(games, "game_id", blocks, seed + 7, w=F.col("w"), a=F.col("additive"), f=F.col("full"))
        delta = metrics.interval(drawn.withColumn("delta", F.sqrt(F.col("a") / F.col("w")) - F.sqrt(F.col("f") / F.col("w"))), "delta", 0.1, 0.9, 2)
        percent = 100.0 * (1.0 - F.try_divide(F.col(f"full_macro_rmse{tag}"), F.col(f"additive_macro_rmse{tag}")))
        sizes = grouped.agg(F.countDistinct("stint_id").alias("stints"), F.countDistinct("group").alias("groups"))
        one = sizes.crossJoin(errors).crossJoin(delta).select(F.lit(name).alias("holdout"), "*", percent.alias("improvement_percent"), (F.col(f"additive_micro_rmse{tag}") - F.col(f"full_micro_rmse{tag}")).alias("delta"))  # one row each
        out, schema = out + one.collect(), one.schema  # a row for each holdout
        for frame in (grouped, rows, train):
            frame.unpersist()
    return spark.createDataFrame(out, schema)


def recovered(stints: DataFrame, talent: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: how far a fit of ``stints`` finds a known truth. talent: (side, member, truth); pairs: (a,
    b, truth)."""
    spark = stints.sparkSession
    fit = models.fit_ridge(stints).table(spark)
    side = lambda tag, name: fit.where(F.col("col").rlike(f"^{tag}[0-9]")).select(F.lit(name).alias("side"), F.expr("cast(substring(col, 2) as bigint)").alias("member"), F.col("coef").alias("estimate"))
    found = talent.join(side("o", "offense").union(side("d", "defense")), ["side", "member"]).select("side", "member", "truth", "estimate")
    model = models.chemistry_of(stints)[0][0]
    known = pairs.join(models.interactions(model, pairs).withColumnRenamed("effect", "estimate"), ["a", "b"]).select("a", "b", "truth", "estimate")
    exposure = contract.player_exposure(stints).select(F.col("player").alias("member"), F.col("off_possessions").alias("possessions")).where("possessions > 0")
    return evaluation.recovery(found, known, exposure)
