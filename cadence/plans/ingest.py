"""Possessions to stints: validation, reconciliation, runs and the three outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered, reconcile


def ingest(possessions: DataFrame, games: DataFrame) -> dict[str, DataFrame]:
    """possessions: game_id, period, sequence, offense, lineup_a, lineup_b, start_seconds, margin,
    known_team, events, lineup_size, raw_points, technical_points, split_lineup.
    games: game_id, team, points (official final scores by team).

    Returns stints, quarantine (excluded possessions), games (status, reason, counts) and totals.
    A game whose score can't be reconciled loses its accepted possessions; one whose possessions
    don't alternate is quarantined but keeps their count. The score's reason stands if both fail.
    """
    checked = reconcile.validated(possessions).withColumn("points", F.col("raw_points") - F.col("technical_points"))
    scored = checked.where("counted").select("game_id", F.col("offense").alias("team"), F.col("raw_points").alias("points"))
    by_team = reconcile.reconcile(scored, games, ["game_id", "team"])
    score = by_team.groupBy("game_id").agg(F.max((F.col("status") == "quarantined").cast("int")).alias("mismatch"))
    repeats = ordered.alternation_failures(checked, ["game_id", "period"], "sequence", "offense")
    failing = repeats.groupBy("game_id").agg(F.min("period").alias("failing_period"))
    counts = checked.groupBy("game_id").agg(F.sum(F.col("reason").isNull().cast("long")).alias("accepted"), F.sum(F.col("reason").isNotNull().cast("long")).alias("excluded"))
    status = counts.join(score, "game_id", "left").join(failing, "game_id", "left").select(
        "game_id",
        F.when((F.coalesce("mismatch", F.lit(1)) == 1) | F.col("failing_period").isNotNull(), "quarantined").otherwise("accepted").alias("status"),
        F.when(F.coalesce("mismatch", F.lit(1)) == 1, "score_mismatch").when(F.col("failing_period").isNotNull(), F.concat(F.lit("alternation_period_"), F.col("failing_period").cast("string"))).alias("reason"),
        F.when(F.coalesce("mismatch", F.lit(1)) == 1, 0).otherwise(F.col("accepted")).alias("possessions"),
        "excluded",
    )
    fine = status.where("status = 'accepted'").select("game_id")
    stints = ordered.run_rows(checked.where("reason is null").join(fine, "game_id", "left_semi"))
    emitted = stints.groupBy("game_id").agg(F.count(F.lit(1)).alias("stints"))
    listed = status.join(emitted, "game_id", "left").na.fill(0, ["stints"])
    return {"stints": stints, "quarantine": reconcile.quarantine_feed(checked), "games": listed, "totals": reconcile.manifest_totals(listed)}


def write(outputs: dict[str, DataFrame], folder: str) -> dict:
    """The outputs of ``ingest`` as JSON lines in a folder each, the totals as one row (``manifest``),
    which is returned. Files that stand there already are refused."""
    for name in ("stints", "quarantine", "games"):
        outputs[name].write.json(f"{folder}/{name}")
    outputs["totals"].coalesce(1).write.json(f"{folder}/manifest")  # one row
    return outputs["totals"].sparkSession.read.json(f"{folder}/manifest").first().asDict()
