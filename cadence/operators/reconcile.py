"""Possession validation, score reconciliation, coverage manifests and archive checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def exclusion() -> Column:
    """The first test that a possession fails, in order; null if it stands. Columns: known_team,
    events, lineup_size, raw_points, technical_points, split_lineup."""
    settled = S.settled_points(F.col("raw_points"), F.col("technical_points"))
    return (
        F.when(~F.col("known_team"), "unknown_team")
        .when(F.col("events") == 0, "empty_possession")
        .when(F.col("lineup_size") != 5, "lineup_not_five")
        .when(S.ambiguous(settled), "ambiguous_scoring")
        .when(F.col("split_lineup"), "split_lineup")
    )


def validated(possessions: DataFrame) -> DataFrame:
    """With ``reason`` (null: accepted) and ``counted``, whether its points enter the reconciliation:
    split lineups are counted before they are excluded, the other excluded ones are not."""
    reason = exclusion()
    return possessions.withColumn("reason", reason).withColumn("counted", F.col("reason").isNull() | (F.col("reason") == "split_lineup"))


def reconcile(derived: DataFrame, official: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Derived and official totals by ``keys``, their difference and the status."""
    d = derived.groupBy(*keys).agg(F.sum("points").alias("derived"))
    both = official.groupBy(*keys).agg(F.sum("points").alias("official")).join(d, keys, "full")
    gap = F.coalesce("derived", F.lit(0)) - F.coalesce("official", F.lit(0))
    return both.select(*keys, F.coalesce("derived", F.lit(0)).alias("derived"), F.coalesce("official", F.lit(0)).alias("official"), gap.alias("gap"), F.when(F.abs(gap) <= tolerance, "accepted").otherwise("quarantined").alias("status"))


def with_fallback(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Each game from the surface that accepts it, the primary first, with both reasons if neither does."""
    p = primary.select(key, F.col("status").alias("s1"), F.col("reason").alias("r1"))
    s = secondary.select(key, F.col("status").alias("s2"), F.col("reason").alias("r2"))
    both = p.join(s, key, "full")
    ok1, ok2 = F.coalesce(F.col("s1") == "accepted", F.lit(False)), F.coalesce(F.col("s2") == "accepted", F.lit(False))
    return both.select(key, F.when(ok1, "primary").when(ok2, "fallback").alias("surface"), F.when(ok1 | ok2, "accepted").otherwise("quarantined").alias("status"), F.when(~ok1 & ~ok2, F.concat_ws("; ", "r1", "r2")).alias("reason"))


def manifest_totals(games: DataFrame) -> DataFrame:
    """One row from games (status, stints, possessions, excluded): totals that children add up to."""
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(f"games_{s}")
    return games.agg(F.count(F.lit(1)).alias("games"), n("accepted"), n("quarantined"), F.sum(F.when(F.col("status") == "accepted", F.col("stints")).otherwise(0)).alias("stints_written"), F.sum("possessions").alias("possessions"), F.sum("excluded").alias("excluded"))


def reason_histogram(possessions: DataFrame) -> DataFrame:
    return possessions.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("possessions"))


def status_histogram(games: DataFrame) -> DataFrame:
    """status, reason (null: none), games: how often each outcome of a game's checks came up."""
    return games.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("games"))


def score_sums(possessions: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Points by ``keys`` and period, and by ``keys`` alone (period null). Technical free throws, within
    raw_points, count for the final score only, as no period's official score lists them apart."""
    settled = F.sum(F.col("raw_points") - F.col("technical_points"))
    sums = possessions.where("counted").rollup(*keys, period).agg(F.when(F.grouping(period) == 1, F.sum("raw_points")).otherwise(settled).cast("long").alias("points"), F.grouping(keys[-1]).alias("g"))
    return sums.where("g = 0").drop("g")


def quarantine_feed(possessions: DataFrame) -> DataFrame:
    """Excluded possessions, but for empty ones, which only the manifest lists."""
    return possessions.where("reason is not null and reason <> 'empty_possession'")


def provider_presence(provided: DataFrame, key: str, providers: list[str]) -> DataFrame:
    """Each key with the providers it lacks; complete if none."""
    wanted = F.array(*map(F.lit, providers))
    return provided.groupBy(key).agg(F.collect_set("provider").alias("have")).select(key, F.array_join(F.array_sort(F.array_except(wanted, "have")), ",").alias("missing"), (F.size(F.array_except(wanted, F.col("have"))) == 0).alias("complete"))


def first_names(df: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """The first name that isn't empty for each key."""
    return df.where(F.col(name).isNotNull() & (F.col(name) != "")).groupBy(key).agg(F.min_by(name, F.struct(*order)).alias(name))


def event_histogram(df: DataFrame, counts: str) -> DataFrame:
    """Sums of a map column's values by key."""
    return df.select(F.explode(counts).alias("event", "n")).groupBy("event").agg(F.sum("n").alias("n"))


def missing_context(games: DataFrame) -> DataFrame:
    """game_id and what its metadata lacks, for games (game_date, home/away team, days_rest, final_score maps)."""
    lacks = F.array_compact(
        F.array(
            F.when(F.col("game_date").isNull(), "game_date"),
            *[F.when(F.try_element_at("days_rest", F.col(f"{s}_team_id")).isNull(), f"days_rest_{s}") for s in ("home", "away")],
            *[F.when(F.try_element_at("final_score", F.col(f"{s}_team_id")).isNull(), f"final_score_{s}") for s in ("home", "away")],
        )
    )
    return games.select("game_id", lacks.alias("missing")).where("size(missing) > 0")


def correction_set_id(entries: DataFrame, key: str, value: str) -> DataFrame:
    """The first 16 hex digits of the sha256 of the sorted entries as a JSON object; entries are few."""
    parts = F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col(key).cast("string"), F.lit('":"'), F.col(value).cast("string"), F.lit('"'))))
    return entries.agg(F.substring(F.sha2(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")), 256), 1, 16).alias("correction_set_id"))
