"""Views that give the engine's shapes to the given tables.

Each view has its Spark form and the same in SQL (``SQL``, common table expressions by name), so
that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .held import spread

#: Teams, and the players of each; and how far apart the slots of a lineup lie.
TEAMS, ROSTER, STEPS = 12, 10, (1, 3, 7, 9)
#: Player ids are under this number on offense, and from 1000 on defense.
PLAYERS = TEAMS * ROSTER
#: Stints, and lines of orders, that a partition holds where the session's number would make larger ones.
STINTS_EACH, LINES_EACH = 100_000, 150_000
#: Players in these slots and above belong to another team each season.
MOVERS = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _five(start, step, lines, player):
    """Five different slots of a roster: ``step`` apart from ``start`` on, the last one further in
    orders of six lines and more; each as the id that ``player`` gives it, in order."""
    apart = F.element_at(F.array(*map(F.lit, STEPS)), (step % len(STEPS) + 1).cast("int"))
    slots = F.transform(F.array(*map(F.lit, range(5))), lambda i: (start + (i + F.when((i == 4) & (lines >= 6), 1).otherwise(0)) * apart) % ROSTER)
    return F.array_sort(F.transform(slots, player))


def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stint for each order with lines. Its customer gives the offense's team and the order the
    defense's; its highest part and supplier say which five of a team's ten players play."""
    orders = table(spark, sf_dir, "orders")
    n = orders.count()  # of Parquet rows: reads footers only
    # Both sides of the join are dealt alike: else it takes the number of the side that isn't.
    lines = spread(table(spark, sf_dir, "lineitem"), n, STINTS_EACH, "l_orderkey")
    sides = lines.groupBy("l_orderkey").agg(
        F.max("l_suppkey").alias("a"),
        F.max("l_partkey").alias("b"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").cast("int").alias("offensive_possessions"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).cast("int").alias("points_scored"),
    )
    orders = spread(orders, n, STINTS_EACH, "o_orderkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    season = F.year("o_orderdate") - 1992
    period, remaining, margin = (cust % 5 + 1).cast("int"), (key % 720).cast("double"), (key % 61 - 30).cast("int")
    moved = lambda slot: ((cust + F.when(slot >= MOVERS, season).otherwise(0)) % TEAMS) * ROSTER + slot
    return orders.join(sides, key == F.col("l_orderkey")).select(
        key.cast("string").alias("stint_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("game_id"),
        F.to_date("o_orderdate").alias("game_date"),
        F.year("o_orderdate").cast("string").alias("season"),
        season.cast("int").alias("season_index"),
        period.alias("period"),
        remaining.alias("start_time_seconds"),
        (cust % TEAMS).alias("offense_team_id"),
        (100 + key % TEAMS).alias("defense_team_id"),
        _five(F.col("a"), F.col("b"), F.col("lines"), moved).alias("offense_player_ids"),
        _five(F.col("b"), F.col("a"), F.col("lines"), lambda slot: 1000 + key % TEAMS * ROSTER + slot).alias("defense_player_ids"),
        "offensive_possessions",
        "points_scored",
        (key % 2 == 0).alias("home_offense"),
        margin.alias("score_margin_offense"),
        (F.col("o_orderpriority") == "1-URGENT").alias("playoff"),
        (cust % 4).cast("int").alias("days_rest_offense"),
        S.garbage_weight(period, remaining, margin).alias("garbage_time_weight"),
    )


def possessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as possessions: a game is a user, the lineup key is the event type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("game_id"),
        F.to_date("ts").alias("day"),
        F.col("event_type").alias("lineup"),
        F.row_number().over(_by_user()).alias("sequence_index"),
        "event_id",
        "ts",
        F.col("value").alias("points"),
    )


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``view`` events open a window for their user and day; start is the second of the day."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return e.select(F.col("event_id").alias("window_id"), F.col("user_id").alias("team"), F.to_date("ts").alias("day"), _second().alias("start"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    return e.select("event_id", F.col("user_id").alias("team"), F.to_date("ts").alias("day"), _second().alias("at"), F.col("event_type").alias("kind"), "value")


def _second():
    return (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as exposure of a player (customer) to a team (priority) in a season (year)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("player_id"), (F.year("o_orderdate") - 1992).alias("season_index"), F.col("o_orderpriority").alias("team"), F.lit(1).cast("long").alias("possessions"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts and rates of each user."""
    e = table(spark, sf_dir, "events")
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    counts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), n("view").alias("views"), n("click").alias("clicks"), n("purchase").alias("purchases"), F.sum(F.when(F.col("event_type") == "purchase", F.round("value", 2).cast("decimal(18,2)")).otherwise(0)).alias("spent"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return counts.select(F.col("user_id").alias("player_id"), "events", "views", "clicks", "purchases", rate("clicks", "views").alias("click_rate"), rate("purchases", "clicks").alias("buy_rate"), rate("spent", "purchases").alias("basket"))


_SLOTS_SQL = "list_transform(range(0, 5), lambda i: ({start} + (i + CASE WHEN i = 4 AND lines >= 6 THEN 1 ELSE 0 END) * [1, 3, 7, 9][{step} % 4 + 1]) % 10)"

STINT_SQL = f"""
sides AS (
  SELECT l_orderkey, max(l_suppkey) AS a, max(l_partkey) AS b, count(*) AS lines,
    CAST(sum(l_quantity) AS INTEGER) AS offensive_possessions,
    CAST(round(sum(l_extendedprice * (1 - l_discount)) / 1000) AS INTEGER) AS points_scored
  FROM lineitem GROUP BY l_orderkey
), seated AS (
  SELECT *, year(o_orderdate) - 1992 AS season_no, {_SLOTS_SQL.format(start="a", step="b")} AS oslots, {_SLOTS_SQL.format(start="b", step="a")} AS dslots
  FROM orders JOIN sides ON o_orderkey = l_orderkey
), fives AS (
  SELECT *, list_sort(list_transform(oslots, lambda j: ((o_custkey + CASE WHEN j >= 9 THEN season_no ELSE 0 END) % 12) * 10 + j)) AS o,
    list_sort(list_transform(dslots, lambda j: 1000 + o_orderkey % 12 * 10 + j)) AS d FROM seated
), stint AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS stint_id, strftime(o_orderdate, '%Y-%m-%d') AS game_id, CAST(o_orderdate AS DATE) AS game_date,
    CAST(year(o_orderdate) AS VARCHAR) AS season, CAST(season_no AS INTEGER) AS season_index,
    CAST(o_custkey % 5 + 1 AS INTEGER) AS period, CAST(o_orderkey % 720 AS DOUBLE) AS start_time_seconds,
    o_custkey % 12 AS offense_team_id, 100 + o_orderkey % 12 AS defense_team_id,
    o AS offense_player_ids, d AS defense_player_ids,
    offensive_possessions, points_scored, o_orderkey % 2 = 0 AS home_offense, CAST(o_orderkey % 61 - 30 AS INTEGER) AS score_margin_offense,
    o_orderpriority = '1-URGENT' AS playoff, CAST(o_custkey % 4 AS INTEGER) AS days_rest_offense,
    CASE WHEN o_custkey % 5 + 1 >= 4 AND o_orderkey % 720 < 300 AND abs(o_orderkey % 61 - 30) > 25 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS garbage_time_weight,
    array_to_string(o, '-') AS lineup
  FROM fives
)"""

POSSESSION_SQL = """
possession AS (
  SELECT user_id AS game_id, CAST(ts AS DATE) AS day, event_type AS lineup, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence_index, event_id, ts, value AS points FROM events
)"""

WINDOW_SQL = """
win AS (
  SELECT event_id AS window_id, user_id AS team, CAST(ts AS DATE) AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS start FROM events WHERE event_type = 'view'
), probe AS (
  SELECT event_id, user_id AS team, CAST(ts AS DATE) AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS at, event_type AS kind, value FROM events WHERE event_type IN ('click', 'purchase')
)"""

PROFILE_SQL = """
counts AS (
  SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases,
    sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value, 2) AS DECIMAL(18,2)) ELSE 0 END) AS spent
  FROM events GROUP BY user_id
), profile AS (
  SELECT user_id AS player_id, events, views, clicks, purchases, clicks / nullif(views, 0) AS click_rate, purchases / nullif(clicks, 0) AS buy_rate, CAST(spent AS DOUBLE) / nullif(purchases, 0) AS basket FROM counts
)"""
