"""The stint contract: schema, row rules, ids, gates on exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from . import ordered

VERSION = 2
_FIVE = T.ArrayType(T.LongType(), True)
SCHEMA = T.StructType(
    [
        T.StructField(n, t, True)
        for n, t in (
            ("stint_id", T.StringType()), ("game_id", T.StringType()), ("game_date", T.StringType()), ("season", T.StringType()), ("season_index", T.IntegerType()),
            ("period", T.IntegerType()), ("start_time_seconds", T.DoubleType()), ("offense_team_id", T.LongType()), ("defense_team_id", T.LongType()),
            ("offense_player_ids", _FIVE), ("defense_player_ids", _FIVE), ("offensive_possessions", T.IntegerType()), ("points_scored", T.IntegerType()),
            ("home_offense", T.BooleanType()), ("score_margin_offense", T.IntegerType()), ("playoff", T.BooleanType()), ("days_rest_offense", T.IntegerType()),
            ("garbage_time_weight", T.DoubleType()), ("source", T.StringType()), ("schema_version", T.IntegerType()),
        )
    ]
)
#: The context fields that models may read, in order.
CONTEXT_FIELDS = ("home_offense", "score_margin_offense", "period", "playoff", "days_rest_offense", "garbage_time_weight", "season_index")


def unknown_fields(df: DataFrame) -> list[str]:
    return sorted(set(df.columns) - set(SCHEMA.names))


def missing_fields(df: DataFrame) -> list[str]:
    return sorted(set(SCHEMA.names) - {"schema_version"} - set(df.columns))


def canonical(df: DataFrame) -> DataFrame:
    """Lineups in ascending order."""
    return df.withColumns({c: F.array_sort(c) for c in ("offense_player_ids", "defense_player_ids")})


def violation() -> Column:
    """The first rule that a row breaks; null if it breaks none."""
    five = lambda c: (F.size(c) == 5) & (F.size(F.array_distinct(c)) == 5)
    date = F.col("game_date").cast("string")
    rules = (
        ("offense_not_five", ~F.coalesce(five("offense_player_ids"), F.lit(False))),
        ("defense_not_five", ~F.coalesce(five("defense_player_ids"), F.lit(False))),
        ("lineups_overlap", F.arrays_overlap("offense_player_ids", "defense_player_ids")),
        ("no_possessions", ~F.coalesce(F.col("offensive_possessions") > 0, F.lit(False))),
        ("negative_points", ~F.coalesce(F.col("points_scored") >= 0, F.lit(False))),
        ("bad_period", ~F.coalesce(F.col("period") > 0, F.lit(False))),
        ("bad_weight", ~F.coalesce((F.col("garbage_time_weight") > 0) & (F.col("garbage_time_weight") <= 1), F.lit(False))),
        ("bad_season_index", ~F.coalesce(F.col("season_index") >= 0, F.lit(False))),
        ("same_team", F.col("offense_team_id") == F.col("defense_team_id")),
        ("bad_date", ~F.coalesce(date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)) | F.try_to_date(date).isNull()),
    )
    out = F.when(rules[0][1], rules[0][0])
    for name, broken in rules[1:]:
        out = out.when(broken, name)
    return out


def duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy("stint_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def violations(df: DataFrame) -> DataFrame:
    """stint_id and reason: rows that break a rule, and ids that aren't unique."""
    broken = df.select("stint_id", violation().alias("reason")).where("reason is not null")
    return broken.union(duplicates(df).select("stint_id", F.lit("duplicate_id")))


def subset(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("stint_id"), "stint_id", "left_semi")


def chronological(df: DataFrame) -> DataFrame:
    return df.orderBy("game_date", "game_id", "period", "start_time_seconds", "stint_id")


def overview(df: DataFrame) -> DataFrame:
    """One row: stints, games, seasons in order, players and possessions."""
    players = df.select(F.explode(F.concat("offense_player_ids", "defense_player_ids")).alias("p")).agg(F.countDistinct("p").alias("players"))
    seasons = df.groupBy("season").agg(F.min("season_index").alias("i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "season"))), lambda s: s["season"]), ",").alias("season_order"))
    totals = df.agg(F.count(F.lit(1)).alias("stints"), F.countDistinct("game_id").alias("games"), F.sum("offensive_possessions").alias("possessions"), F.sum("points_scored").alias("points"))
    return totals.crossJoin(players).crossJoin(seasons)  # one row each


def selected(df: DataFrame, game: str | None = None, team: int | None = None, player: int | None = None) -> DataFrame:
    """The stints of a game, an offense's team and a player of it, as far as they are given."""
    if game is not None:
        df = df.where(F.col("game_id") == game)
    if team is not None:
        df = df.where(F.col("offense_team_id") == team)
    if player is not None:
        df = df.where(F.array_contains("offense_player_ids", F.lit(player)))
    return df


def selection_totals(df: DataFrame, minimum: int, game: str | None = None, team: int | None = None, player: int | None = None) -> DataFrame:
    """One row: totals of the whole selection, with the number of lineups and of those that reach the
    minimum, which bounds no total."""
    per = selected(df, game, team, player).groupBy(S.lineup_id("offense_player_ids").alias("lineup")).agg(
        F.sum("offensive_possessions").alias("n"), F.sum("points_scored").alias("p"), F.count(F.lit(1)).alias("s"), F.sum((F.col("garbage_time_weight") < 1).cast("long")).alias("d")
    )
    totals = per.agg(F.sum("n").alias("possessions"), F.sum("p").alias("points"), F.sum("s").alias("stints"), F.sum("d").alias("downweighted"), F.count(F.lit(1)).alias("lineups"), F.sum((F.col("n") >= minimum).cast("long")).alias("listed"))
    return totals.withColumn("rating", S.rating(F.col("points"), F.col("possessions")))


def lineup_observations(df: DataFrame, minimum: int, game: str | None = None, team: int | None = None, player: int | None = None) -> DataFrame:
    """Lineups' totals and rates; the minimum holds for lineups, not for the selection's totals."""
    if not 1 <= minimum <= 1_000_000:
        raise ValueError("minimum possessions must be from 1 to 1,000,000")
    df = selected(df, game, team, player)
    grouped = df.groupBy(S.lineup_id("offense_player_ids").alias("lineup")).agg(
        F.sum("offensive_possessions").alias("possessions"),
        F.sum("points_scored").alias("points"),
        F.count(F.lit(1)).alias("stints"),
        F.countDistinct("game_id").alias("games"),
        F.array_join(F.array_sort(F.collect_set(F.col("defense_team_id"))).cast("array<string>"), ",").alias("opponents"),
        F.min("game_date").alias("first_date"),
        F.max("game_date").alias("last_date"),
        F.sum((F.col("garbage_time_weight") < 1).cast("long")).alias("downweighted"),
    )
    return grouped.where(F.col("possessions") >= minimum).withColumn("rating", S.rating(F.col("points"), F.col("possessions")))


def player_pool(df: DataFrame) -> DataFrame:
    """team, player, possessions on either side."""
    side = lambda team, members: df.select(F.col(team).alias("team"), F.explode(members).alias("player"), "offensive_possessions")
    both = side("offense_team_id", "offense_player_ids").union(side("defense_team_id", "defense_player_ids"))
    return both.groupBy("team", "player").agg(F.sum("offensive_possessions").alias("possessions"))


def player_exposure(df: DataFrame) -> DataFrame:
    """player: possessions on offense and on defense, games. A long form summed once, no outer joins."""
    o = df.select(F.explode("offense_player_ids").alias("player"), "game_id", F.col("offensive_possessions").alias("o"), F.lit(0).alias("d"))
    d = df.select(F.explode("defense_player_ids").alias("player"), "game_id", F.lit(0).alias("o"), F.col("offensive_possessions").alias("d"))
    return o.union(d).groupBy("player").agg(F.sum("o").alias("off_possessions"), F.sum("d").alias("def_possessions"), F.countDistinct("game_id").alias("games"))


def pair_exposure(df: DataFrame, minimum: int) -> DataFrame:
    """a, b, stints and possessions of pairs that share at least ``minimum`` offensive stints."""
    pairs = df.select(F.explode(S.pairs_of("offense_player_ids")).alias("p"), "offensive_possessions")
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("stints"), F.sum("offensive_possessions").alias("possessions")).where(F.col("stints") >= minimum)


def top_stints(df: DataFrame, n: int = 8) -> DataFrame:
    """Each game's n longest stints by possessions."""
    from pyspark.sql import Window

    order = Window.partitionBy("game_id").orderBy(F.desc("offensive_possessions"), "stint_id")
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def listed(lineups: DataFrame) -> DataFrame:
    """Lineups with their ``place`` from 1: most possessions first, ties by lineup."""
    placed, _ = ordered.numbered(lineups, [-F.col("possessions"), F.col("lineup")])
    return placed.withColumn("place", F.col("place") + 1)
