"""Ordered operators: runs, stints from runs, windows, schedules, alternation, running scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def runs(df: DataFrame, by: list[str], key: list[str], sequence: str) -> DataFrame:
    """``df`` with ``run``: rows of ``by`` whose ``key`` is the same and whose ``sequence`` goes up
    by one share a run; a change or a gap starts the next."""
    w = Window.partitionBy(*by).orderBy(sequence)
    same = F.col(sequence) == F.lag(sequence).over(w) + 1
    for k in key:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    started = df.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return started.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def run_rows(possessions: DataFrame) -> DataFrame:
    """Possessions (game_id, period, sequence, offense, lineup_a, lineup_b, start_seconds, margin,
    points) to one-sided rows: each run of unchanged lineups gives a row for each offense in it.

    The start is clamped to the period; margin and clock are those of the run's first possession.
    """
    grouped = runs(possessions, ["game_id", "period"], ["lineup_a", "lineup_b"], "sequence")
    first = Window.partitionBy("game_id", "period", "run").orderBy("sequence")
    grouped = grouped.withColumns({"run_start": F.first("start_seconds").over(first), "run_margin": F.first("margin").over(first), "run_offense": F.first("offense").over(first)})
    length = S.period_length("period")
    clamped = F.greatest(F.lit(0.0), F.least(F.col("run_start"), length.cast("double")))
    return grouped.groupBy("game_id", "period", "run", "offense").agg(
        F.min(clamped).alias("start_seconds"),
        F.count(F.lit(1)).alias("possessions"),
        F.sum("points").alias("points"),
        F.min(F.when(F.col("offense") == F.col("run_offense"), F.col("run_margin")).otherwise(-F.col("run_margin"))).alias("margin"),
        F.min(S.garbage_weight(F.col("period"), length - clamped, F.col("run_margin"))).alias("weight"),
    )


def windows(df: DataFrame, by: list[str], start: str, tie: str, last_end) -> DataFrame:
    """``df`` with ``window_end``: the next start within ``by``; ``last_end`` for the last. Equal
    starts give empty windows but for the last of them by ``tie``."""
    w = Window.partitionBy(*by).orderBy(start, tie)
    return df.withColumn("window_end", F.coalesce(F.lead(start).over(w), last_end))


def alternation_failures(df: DataFrame, by: list[str], sequence: str, offense: str) -> DataFrame:
    """Adjacent rows of ``by`` (sequence goes up by one) with the same offense."""
    w = Window.partitionBy(*by).orderBy(sequence)
    return df.withColumn("previous", F.lag(offense).over(w)).withColumn("__gap", F.col(sequence) - F.lag(sequence).over(w)).where((F.col("__gap") == 1) & (F.col("previous") == F.col(offense))).drop("__gap")


def contiguity(df: DataFrame, by: list[str], sequence: str) -> DataFrame:
    """Whether each group's numbers are a consecutive range without repeats."""
    return df.groupBy(*by).agg(((F.max(sequence) - F.min(sequence) + 1 == F.count(F.lit(1))) & (F.countDistinct(sequence) == F.count(F.lit(1)))).alias("contiguous"))


def period_scores(df: DataFrame, game: str, period: str, order: list[str], score: str) -> DataFrame:
    """Points of each period from a running score: its last value less the last of the period before."""
    ends = df.groupBy(game, period).agg(F.max_by(score, F.struct(*order)).alias("running"))
    w = Window.partitionBy(game).orderBy(period)
    return ends.withColumn("points", F.col("running") - F.coalesce(F.lag("running").over(w), F.lit(0)))


def carried_score(df: DataFrame, by: list[str], order: list[str], score: str) -> DataFrame:
    """``df`` with ``score_in``: the row before's score within ``by``, zero for the first."""
    return df.withColumn("score_in", F.coalesce(F.lag(score).over(Window.partitionBy(*by).orderBy(*order)), F.lit(0)))


def first_rise(df: DataFrame, game: str, order: list[str], score: str, team: str) -> DataFrame:
    """The team of each game's first row whose score is above the row before's."""
    w = Window.partitionBy(game).orderBy(*order)
    rises = df.withColumn("__was", F.lag(score).over(w)).where((F.col(score) > F.coalesce(F.col("__was"), F.lit(0))) & F.col(team).isNotNull())
    return rises.groupBy(game).agg(F.min_by(team, F.struct(*order)).alias("team"))


def rest_days(schedule: DataFrame, team: str, season: str, day: str) -> DataFrame:
    """Distinct (team, season, day) with ``rest``: days off since the team's latest earlier game of
    the season; null for its first. Games on one day don't count for each other."""
    days = schedule.select(team, season, day).distinct()
    before = F.lag(day).over(Window.partitionBy(team, season).orderBy(day))
    return days.withColumn("rest", F.when(before.isNotNull(), F.greatest(F.datediff(F.col(day), before) - 1, F.lit(0))))


def game_rest(games: DataFrame, rest: DataFrame) -> DataFrame:
    """(game_id, season, day, home, away) with both teams' rest; null for both if either has none."""
    r = lambda side: rest.select(F.col("team").alias(side), F.col("season"), F.col("day"), F.col("rest").alias(f"{side}_rest"))
    both = games.join(r("home"), ["home", "season", "day"], "left").join(r("away"), ["away", "season", "day"], "left")
    known = F.col("home_rest").isNotNull() & F.col("away_rest").isNotNull()
    return both.withColumns({s: F.when(known, F.col(s)) for s in ("home_rest", "away_rest")})


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the zero-based rank of ``column``'s distinct values, by a join with the few there are."""
    values = df.select(column).distinct()
    ranked = values.withColumn(name, F.dense_rank().over(Window.orderBy(column)) - 1)
    return df.join(ranked, column)


def folds(df: DataFrame, game: str, k: int) -> DataFrame:
    """``df`` with ``fold``: the rank of its game in order, modulo k. Only distinct games are ranked."""
    return dense_index(df, game, "__rank").withColumn("fold", (F.col("__rank") % k).cast("int")).drop("__rank")


def highest_exposure(df: DataFrame, by: str, weight: str, order: list[str]) -> DataFrame:
    """One row for each ``by``: the highest weight; the later row by ``order`` if equal."""
    w = Window.partitionBy(by).orderBy(F.desc(weight), *[F.desc(c) for c in order])
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def live_changes(df: DataFrame, possession: list[str], order: str, lineup: str) -> DataFrame:
    """Possessions during which a non-empty lineup differs from the first non-empty one."""
    live = df.where(F.size(lineup) > 0)
    first = F.first(lineup).over(Window.partitionBy(*possession).orderBy(order))
    return live.withColumn("__first", first).groupBy(*possession).agg(F.max((F.col(lineup) != F.col("__first")).cast("int")).cast("boolean").alias("split"))


def numbered(df: DataFrame, order: list[Column], parts: int = 64) -> tuple[DataFrame, int]:
    """``df`` with ``place`` from 0 in the given order, and the number of rows.

    No task ranks all rows: the order is cut at keys of a hash sample (``parts`` ranges), rows are
    ranked within ranges, and the ranges' sizes give each its first place. The keys of the sample and
    the sizes, ``parts`` of each, are all that passes through the driver. Ranges follow from the keys
    themselves, so a lost task is ranked alike again.
    """
    keyed = df.withColumn("__key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    some = sorted(tuple(r[0]) for r in keyed.select("__key").orderBy(F.xxhash64("__key"), "__key").limit(16 * parts).collect())
    cuts = some[len(some) // parts :: max(1, len(some) // parts)]
    kind = keyed.schema["__key"].dataType
    below = F.size(F.filter(F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kind)]) for c in cuts]), lambda c: c <= F.col("__key"))) if cuts else F.lit(0)
    ranged = keyed.withColumn("__range", below)
    sizes = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    before, total = [], 0
    for k in range(len(cuts) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("__key")) - 1
    place = F.get(F.array(*[F.lit(int(n)) for n in before]), F.col("__range")) + rank
    return ranged.withColumn("place", place.cast("long")).drop("__key", "__range"), total
