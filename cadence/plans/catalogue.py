"""The query catalogue: each operator over the given tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contract, gram, intervals, metrics, ordered, profiles, reconcile, shared, splits
from ..sources import views as V
from ..sources.held import materialise, spread
from ..sources.views import POSSESSION_SQL, PROFILE_SQL, STINT_SQL, WINDOW_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


STINT = f"WITH {STINT_SQL}"
PAIRS = """, pair AS (
  SELECT stint_id, a, b, offensive_possessions FROM (SELECT stint_id, offensive_possessions, offense_player_ids AS m, unnest(offense_player_ids) AS a FROM stint) x, (SELECT unnest(range(0, 120)) AS b) y WHERE b > a AND list_contains(m, b)
)"""

# -- contract and exposure ------------------------------------------------------------------------


@query(f"""{STINT} SELECT lineup, sum(offensive_possessions) AS possessions, sum(points_scored) AS points, count(*) AS stints, count(DISTINCT game_id) AS games,
  array_to_string(list_sort(list_distinct(list(defense_team_id))), ',') AS opponents, min(game_date) AS first_date, max(game_date) AS last_date,
  count(*) FILTER (garbage_time_weight < 1) AS downweighted, round(100.0 * sum(points_scored) / sum(offensive_possessions), 6) AS rating
  FROM stint GROUP BY lineup HAVING sum(offensive_possessions) >= 200""")
def lineup_rates(spark, sf):
    return _round(contract.lineup_observations(V.stints(spark, sf), 200), "rating")


@query(f"{STINT}, l AS (SELECT lineup, sum(offensive_possessions) AS possessions FROM stint GROUP BY lineup HAVING sum(offensive_possessions) >= 200) SELECT lineup, possessions, row_number() OVER (ORDER BY possessions DESC, lineup) AS place FROM l")
def listed_lineups(spark, sf):
    return contract.listed(contract.lineup_observations(V.stints(spark, sf), 200)).select("lineup", "possessions", "place")


@query(f"""{STINT}, bad AS (SELECT stint_id, CASE WHEN len(list_distinct(offense_player_ids)) <> 5 THEN 'offense_not_five' WHEN len(list_distinct(defense_player_ids)) <> 5 THEN 'defense_not_five'
  WHEN offensive_possessions <= 100 THEN 'no_possessions' WHEN points_scored < 0 THEN 'negative_points' WHEN period <= 0 THEN 'bad_period' WHEN season_index < 0 THEN 'bad_season_index' END AS reason FROM stint)
  SELECT reason, count(*) AS stints FROM bad WHERE reason IS NOT NULL GROUP BY reason""")
def contract_violations(spark, sf):
    # possessions are counted from 100 on, so that the rule has something to find
    shifted = V.stints(spark, sf).withColumn("offensive_possessions", F.col("offensive_possessions") - 100)
    return contract.violations(shifted).groupBy("reason").agg(F.count(F.lit(1)).alias("stints"))


@query(f"""{STINT}, p AS (SELECT unnest(list_concat(offense_player_ids, defense_player_ids)) AS p FROM stint), s AS (SELECT string_agg(season, ',' ORDER BY i) AS season_order FROM (SELECT season, min(season_index) AS i FROM stint GROUP BY season))
  SELECT count(*) AS stints, count(DISTINCT game_id) AS games, sum(offensive_possessions) AS possessions, sum(points_scored) AS points, (SELECT count(DISTINCT p) FROM p) AS players, (SELECT season_order FROM s) AS season_order FROM stint""")
def coverage_overview(spark, sf):
    return contract.overview(V.stints(spark, sf))


@query(f"{STINT}{PAIRS} SELECT a, b, count(*) AS stints, sum(offensive_possessions) AS possessions FROM pair GROUP BY a, b HAVING count(*) >= 5")
def pair_exposure(spark, sf):
    return contract.pair_exposure(V.stints(spark, sf), 5)


@query(f"""{STINT}, long AS (SELECT unnest(offense_player_ids) AS player, game_id, offensive_possessions AS o, 0 AS d FROM stint UNION ALL SELECT unnest(defense_player_ids), game_id, 0, offensive_possessions FROM stint)
  SELECT player, sum(o) AS off_possessions, sum(d) AS def_possessions, count(DISTINCT game_id) AS games FROM long GROUP BY player""")
def player_exposure(spark, sf):
    return contract.player_exposure(V.stints(spark, sf))


@query(f"""{STINT}, long AS (SELECT offense_team_id AS team, unnest(offense_player_ids) AS player, offensive_possessions AS n FROM stint UNION ALL SELECT defense_team_id, unnest(defense_player_ids), offensive_possessions FROM stint)
  SELECT team, player, sum(n) AS possessions FROM long GROUP BY team, player""")
def team_player_pool(spark, sf):
    return contract.player_pool(V.stints(spark, sf))


@query(f"{STINT} SELECT game_id, stint_id, place, offensive_possessions FROM (SELECT *, CAST(row_number() OVER (PARTITION BY game_id ORDER BY offensive_possessions DESC, stint_id) AS INTEGER) AS place FROM stint) WHERE place <= 8")
def top_stints_per_game(spark, sf):
    return contract.top_stints(V.stints(spark, sf)).select("game_id", "stint_id", "place", "offensive_possessions")


@query(f"{STINT} SELECT stint_id, round(100.0 * points_scored / offensive_possessions, 6) AS rating, abs(score_margin_offense) <= 6 AND period >= 4 AS clutch, garbage_time_weight FROM stint WHERE list_contains(offense_player_ids, 3) AND offense_team_id = 7")
def observation_filter(spark, sf):
    s = V.stints(spark, sf).where((F.col("offense_team_id") == 7) & F.array_contains("offense_player_ids", F.lit(3)))
    return s.select("stint_id", F.round(S.rating(F.col("points_scored"), F.col("offensive_possessions")), 6).alias("rating"), S.is_clutch(F.col("score_margin_offense"), F.col("period")).alias("clutch"), "garbage_time_weight")


# -- ordered --------------------------------------------------------------------------------------


@query(f"""WITH {POSSESSION_SQL}, flagged AS (SELECT *, CASE WHEN lineup = lag(lineup) OVER w AND day = lag(day) OVER w THEN 0 ELSE 1 END AS new FROM possession WINDOW w AS (PARTITION BY game_id ORDER BY sequence_index)),
  numbered AS (SELECT *, sum(new) OVER (PARTITION BY game_id ORDER BY sequence_index ROWS UNBOUNDED PRECEDING) AS run FROM flagged)
  SELECT game_id, run, min(lineup) AS lineup, count(*) AS possessions, min(sequence_index) AS first_index, max(sequence_index) AS last_index FROM numbered GROUP BY game_id, run""")
def possession_runs(spark, sf):
    r = ordered.runs(V.possessions(spark, sf), ["game_id"], ["lineup", "day"], "sequence_index")
    return r.groupBy("game_id", "run").agg(F.min("lineup").alias("lineup"), F.count(F.lit(1)).alias("possessions"), F.min("sequence_index").alias("first_index"), F.max("sequence_index").alias("last_index"))


_PBP_SQL = f"""{POSSESSION_SQL}, pbp AS (
  SELECT game_id, CAST(sequence_index % 4 + 1 AS INTEGER) AS period, sequence_index // 4 AS sequence, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS offense, lineup AS lineup_a, CAST(month(day) % 2 AS VARCHAR) AS lineup_b,
    CAST(event_id % 800 AS DOUBLE) AS start_seconds, CAST(event_id % 81 - 40 AS INTEGER) AS margin, CAST(event_id % 4 AS BIGINT) AS points FROM possession)"""


def _play_by_play(spark, sf):
    p, i = V.possessions(spark, sf), F.col("event_id")
    return p.select(
        "game_id", (F.col("sequence_index") % 4 + 1).cast("int").alias("period"), F.floor(F.col("sequence_index") / 4).alias("sequence"), F.when(i % 2 == 0, "A").otherwise("B").alias("offense"),
        F.col("lineup").alias("lineup_a"), (F.month("day") % 2).cast("string").alias("lineup_b"), (i % 800).cast("double").alias("start_seconds"), (i % 81 - 40).cast("int").alias("margin"), (i % 4).alias("points"),
    )


@query(f"""WITH {_PBP_SQL}, flagged AS (SELECT *, CASE WHEN sequence = lag(sequence) OVER w + 1 AND lineup_a = lag(lineup_a) OVER w AND lineup_b = lag(lineup_b) OVER w THEN 0 ELSE 1 END AS new FROM pbp WINDOW w AS (PARTITION BY game_id, period ORDER BY sequence)),
  numbered AS (SELECT *, sum(new) OVER (PARTITION BY game_id, period ORDER BY sequence ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
  firsts AS (SELECT game_id, period, run, offense AS run_offense, margin AS run_margin, greatest(0.0, least(start_seconds, 720.0)) AS run_start FROM numbered WHERE new = 1)
  SELECT game_id, period, run, offense, min(run_start)::DOUBLE AS start_seconds, count(*) AS possessions, sum(points) AS points, min(CASE WHEN offense = run_offense THEN run_margin ELSE -run_margin END) AS margin,
    min(CASE WHEN period >= 4 AND 720 - run_start < 300 AND abs(run_margin) > 25 THEN 0.2 ELSE 1.0 END)::DOUBLE AS weight
  FROM numbered JOIN firsts USING (game_id, period, run) GROUP BY game_id, period, run, offense""")
def run_stints(spark, sf):
    return ordered.run_rows(_play_by_play(spark, sf))


@query("""WITH d AS (SELECT DISTINCT o_custkey AS team, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(o_orderdate AS DATE) AS day FROM orders), l AS (SELECT *, lag(day) OVER (PARTITION BY team, season ORDER BY day) AS before FROM d)
  SELECT team, season, day, CAST(CASE WHEN before IS NOT NULL THEN greatest(date_diff('day', before, day) - 1, 0) END AS INTEGER) AS rest FROM l""")
def rest_days(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("team"), F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("day"))
    return ordered.rest_days(o, "team", "season", "day")


@query("""WITH games AS (SELECT o_orderkey AS game_id, year(o_orderdate) AS season, CAST(o_orderdate AS DATE) AS day, o_custkey % 40 AS home, 40 + o_orderkey % 40 AS away FROM orders),
  d AS (SELECT DISTINCT team, season, day FROM (SELECT home AS team, season, day FROM games UNION ALL SELECT away, season, day FROM games)),
  r AS (SELECT team, season, day, greatest(date_diff('day', lag(day) OVER w, day) - 1, 0) AS rest, lag(day) OVER w AS p FROM d WINDOW w AS (PARTITION BY team, season ORDER BY day))
  SELECT g.game_id, CAST(CASE WHEN h.p IS NOT NULL AND a.p IS NOT NULL THEN h.rest END AS INTEGER) AS home_rest, CAST(CASE WHEN h.p IS NOT NULL AND a.p IS NOT NULL THEN a.rest END AS INTEGER) AS away_rest
  FROM games g JOIN r h ON h.team = g.home AND h.season = g.season AND h.day = g.day JOIN r a ON a.team = g.away AND a.season = g.season AND a.day = g.day""")
def game_rest(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    games = V.table(spark, sf, "orders").select(k.alias("game_id"), F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("day"), (c % 40).alias("home"), (40 + k % 40).alias("away"))
    schedule = games.select(F.col("home").alias("team"), "season", "day").union(games.select("away", "season", "day"))
    return ordered.game_rest(games, ordered.rest_days(schedule, "team", "season", "day")).select("game_id", "home_rest", "away_rest")


@query(f"""WITH {POSSESSION_SQL}, p AS (SELECT *, lag(lineup) OVER (PARTITION BY game_id ORDER BY sequence_index) AS previous FROM possession)
  SELECT game_id, sequence_index, lineup, previous FROM p WHERE previous = lineup""")
def alternation_failures(spark, sf):
    return ordered.alternation_failures(V.possessions(spark, sf), ["game_id"], "sequence_index", "lineup").select("game_id", "sequence_index", "lineup", "previous")


@query("SELECT conv_id, max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def turn_contiguity(spark, sf):
    return ordered.contiguity(V.table(spark, sf, "conversations"), ["conv_id"], "turn")


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS period, ts, event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events),
  e AS (SELECT day, period, max(running) AS running FROM c GROUP BY day, period)
  SELECT day, CAST(period AS INTEGER) AS period, CAST(running AS BIGINT) AS running, CAST(running - coalesce(lag(running) OVER (PARTITION BY day ORDER BY period), 0) AS BIGINT) AS points FROM e""")
def running_score_periods(spark, sf):
    e = V.table(spark, sf, "events").select(F.to_date("ts").alias("day"), F.hour("ts").alias("period"), "ts", "event_id", (F.col("event_type") == "purchase").cast("long").alias("scored"))
    w = Window.partitionBy("day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.period_scores(e.withColumn("score", F.sum("scored").over(w)), "day", "period", ["ts", "event_id"], "score")


@query("""WITH c AS (SELECT user_id, event_type, ts, event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS score, props FROM events),
  r AS (SELECT *, lag(score) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM c)
  SELECT user_id, arg_min(event_id, (ts, event_id)) AS team FROM r WHERE score > coalesce(was, 0) GROUP BY user_id""")
def first_rise(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "purchase").cast("long").alias("scored"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return ordered.first_rise(e.withColumn("score", F.sum("scored").over(w)), "user_id", ["ts", "event_id"], "score", "event_id")


@query(f"{STINT} SELECT stint_id, CAST((dense_rank() OVER (ORDER BY game_id) - 1) % 3 AS INTEGER) AS fold FROM stint")
def fold_assignment(spark, sf):
    return ordered.folds(V.stints(spark, sf), "game_id", 3).select("stint_id", "fold")


@query("SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS season, CAST(dense_rank() OVER (ORDER BY year(o_orderdate)) - 1 AS INTEGER) AS season_index FROM orders")
def season_index(spark, sf):
    o = V.table(spark, sf, "orders").select(F.year("o_orderdate").cast("string").alias("season")).distinct()
    return ordered.dense_index(o, "season", "season_index").select("season", F.col("season_index").cast("int").alias("season_index"))


@query("""WITH t AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season, count(*) AS n FROM orders GROUP BY ALL)
  SELECT o_custkey, season, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, season DESC) AS p FROM t) WHERE p = 1""")
def highest_exposure_season(spark, sf):
    t = V.table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.count(F.lit(1)).alias("n"))
    return ordered.highest_exposure(t, "o_custkey", "n", ["season"])


# -- intervals ------------------------------------------------------------------------------------

_SPAN_SQL = f"""WITH {WINDOW_SQL}, span AS (SELECT *, coalesce(lead(start) OVER w, least(start + 900, 86400)::DOUBLE) AS window_end, row_number() OVER (PARTITION BY team, day ORDER BY start DESC, window_id DESC) = 1 AS is_last FROM win WINDOW w AS (PARTITION BY team, day ORDER BY start, window_id)),
matched AS (SELECT p.*, coalesce(s.window_id, t.window_id) AS window_id FROM probe p
  LEFT JOIN span s ON s.team = p.team AND s.day = p.day AND s.start <= p.at AND p.at < s.window_end
  LEFT JOIN span t ON t.team = p.team AND t.day = p.day AND t.is_last AND t.start <= p.at AND abs(p.at - t.window_end) < 1)"""


def _spans(spark, sf):
    return intervals.spans(V.windows(spark, sf), ["team", "day"], "start", "window_id", F.least(F.col("start") + 900, F.lit(86400.0)))


def _matched(spark, sf):
    return intervals.attribute(V.probes(spark, sf), _spans(spark, sf), ["team", "day"], "at", "start", "window_id")


@query(f"{_SPAN_SQL} SELECT window_id, count(*) FILTER (kind = 'click') AS clicks, count(*) FILTER (kind = 'purchase') AS purchases, count(*) AS events FROM matched WHERE window_id IS NOT NULL GROUP BY window_id")
def interval_attribution(spark, sf):
    return intervals.window_counts(_matched(spark, sf), "window_id", clicks=F.col("kind") == "click", purchases=F.col("kind") == "purchase", events=F.lit(True))


@query(f"""{_SPAN_SQL} SELECT count(*) AS total, count(*) FILTER (window_id IS NOT NULL AND event_id % 5 <> 0) AS matched, count(*) FILTER (window_id IS NULL) AS unmatched, count(*) FILTER (window_id IS NOT NULL AND event_id % 5 = 0) AS off_roster,
  round(count(*) FILTER (window_id IS NOT NULL AND event_id % 5 <> 0) / count(*), 6) AS match_rate FROM matched""")
def attribution_coverage(spark, sf):
    return _round(intervals.coverage(_matched(spark, sf), "window_id", F.col("event_id") % 5 != 0), "match_rate")


@query(f"""{_SPAN_SQL}, member AS (SELECT window_id, unnest(range(0, 5)) AS member FROM span), got AS (SELECT window_id, event_id % 7 AS member, count(*) AS events, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) AS credit FROM matched WHERE window_id IS NOT NULL AND event_id % 7 < 5 GROUP BY ALL)
  SELECT window_id, member, coalesce(events, 0) AS events, round(coalesce(credit, 0), 2) AS credit FROM member LEFT JOIN got USING (window_id, member)""")
def member_production_zero_fill(spark, sf):
    members = _spans(spark, sf).select("window_id", F.explode(F.expr("sequence(0L, 4L)")).alias("member"))
    got = _matched(spark, sf).where("window_id is not null").withColumn("member", F.col("event_id") % 7).where("member < 5").groupBy("window_id", "member").agg(F.count(F.lit(1)).alias("events"), F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double").alias("credit"))
    return _round(intervals.zero_filled(members, got, ["window_id", "member"], ["events", "credit"]), "credit", digits=2)


@query(f"""{_SPAN_SQL}, member AS (SELECT window_id, unnest(range(0, 5)) AS member FROM span), got AS (SELECT window_id, CASE WHEN event_id % 7 < 5 THEN event_id % 7 END AS member, count(*) AS events, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) AS credit FROM matched WHERE window_id IS NOT NULL GROUP BY ALL)
  SELECT window_id, member, coalesce(events, 0) AS events, round(coalesce(credit, 0), 2) AS credit FROM member LEFT JOIN got USING (window_id, member) UNION ALL SELECT window_id, member, events, round(credit, 2) FROM got WHERE member IS NULL""")
def member_production_off_roster(spark, sf):
    members = _spans(spark, sf).select("window_id", F.explode(F.expr("sequence(0L, 4L)")).alias("member"))
    events = _matched(spark, sf).withColumn("member", F.col("event_id") % 7)
    got = intervals.credited(events, members, "window_id", "member", events=F.count(F.lit(1)), credit=F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double"))
    return _round(got, "credit", digits=2)


# -- reconciliation and archive -------------------------------------------------------------------


_REASON_SQL = """CASE WHEN l_discount >= 0.095 THEN 'unknown_team' WHEN l_quantity < 2 THEN 'empty_possession' WHEN l_linenumber > 6 THEN 'lineup_not_five' WHEN l_linenumber - l_suppkey % 4 NOT BETWEEN 0 AND 6 THEN 'ambiguous_scoring' WHEN l_tax > 0.07 THEN 'split_lineup' END"""


@query(f"""WITH p AS (SELECT l_orderkey, {_REASON_SQL} AS reason, l_quantity AS points FROM lineitem),
  d AS (SELECT l_orderkey, sum(points) AS derived FROM p WHERE reason IS NULL OR reason = 'split_lineup' GROUP BY l_orderkey), o AS (SELECT l_orderkey, sum(l_quantity) AS official FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, coalesce(derived, 0) AS derived, official, coalesce(derived, 0) - official AS gap, CASE WHEN coalesce(derived, 0) = official THEN 'accepted' ELSE 'quarantined' END AS status FROM o LEFT JOIN d USING (l_orderkey)""")
def reconciliation(spark, sf):
    p = _line_possessions(spark, sf)
    return reconcile.reconcile(p.where("counted"), V.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("points")), ["l_orderkey"])


def _line_possessions(spark, sf):
    lines = V.table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_discount") < 0.095).alias("known_team"), F.when(F.col("l_quantity") < 2, 0).otherwise(1).alias("events"), F.when(F.col("l_linenumber") > 6, 4).otherwise(5).alias("lineup_size"),
        F.col("l_linenumber").alias("raw_points"), (F.col("l_suppkey") % 4).cast("int").alias("technical_points"), (F.col("l_tax") > 0.07).alias("split_lineup"), F.col("l_quantity").alias("points"),
        (F.col("l_suppkey") % 2).alias("team"), (F.col("l_linenumber") % 4 + 1).alias("period"),
    )
    return reconcile.validated(lines)


@query(f"""SELECT {_REASON_SQL} AS reason, count(*) AS possessions FROM lineitem WHERE {_REASON_SQL} IS NOT NULL GROUP BY 1""")
def exclusion_reasons(spark, sf):
    return reconcile.reason_histogram(_line_possessions(spark, sf))


@query(f"""WITH p AS (SELECT l_orderkey, l_quantity AS q, {_REASON_SQL} AS r FROM lineitem),
  g AS (SELECT l_orderkey, CASE WHEN sum(CASE WHEN r IS NOT NULL AND r <> 'split_lineup' THEN q ELSE 0 END) = 0 THEN 'accepted' ELSE 'quarantined' END AS status, count(*) FILTER (r IS NULL) AS possessions, count(*) FILTER (r IS NOT NULL) AS excluded FROM p GROUP BY l_orderkey)
  SELECT count(*) AS games, count(*) FILTER (status = 'accepted') AS games_accepted, count(*) FILTER (status = 'quarantined') AS games_quarantined, CAST(sum(CASE WHEN status = 'accepted' THEN possessions ELSE 0 END) AS BIGINT) AS stints_written, CAST(sum(possessions) AS BIGINT) AS possessions, CAST(sum(excluded) AS BIGINT) AS excluded FROM g""")
def manifest_totals(spark, sf):
    p = _line_possessions(spark, sf)
    games = p.groupBy("l_orderkey").agg(F.sum(F.when(~F.col("counted"), F.col("points")).otherwise(0)).alias("lost"), F.sum(F.col("reason").isNull().cast("long")).alias("possessions"), F.sum(F.col("reason").isNotNull().cast("long")).alias("excluded"))
    return reconcile.manifest_totals(games.select(F.when(F.col("lost") == 0, "accepted").otherwise("quarantined").alias("status"), F.col("possessions").alias("stints"), "possessions", "excluded"))


@query("""WITH k AS (SELECT o_orderkey AS k, 'a' AS p FROM orders UNION SELECT l_orderkey, 'b' FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, 'c' FROM lineitem WHERE l_linestatus = 'O'), h AS (SELECT k, list(p) AS have FROM k GROUP BY k)
  SELECT k, array_to_string(list_filter(['a', 'b', 'c'], lambda x: NOT list_contains(have, x)), ',') AS missing, len(list_filter(['a', 'b', 'c'], lambda x: NOT list_contains(have, x))) = 0 AS complete FROM h""")
def provider_presence(spark, sf):
    lines = V.table(spark, sf, "lineitem")
    one = lambda df, key, p: df.select(F.col(key).alias("k"), F.lit(p).alias("provider"))
    provided = one(V.table(spark, sf, "orders"), "o_orderkey", "a").union(one(lines.where("l_returnflag = 'R'"), "l_orderkey", "b")).union(one(lines.where("l_linestatus = 'O'"), "l_orderkey", "c"))
    return reconcile.provider_presence(provided, "k", ["a", "b", "c"])


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events WHERE event_type <> 'view' GROUP BY user_id")
def first_names(spark, sf):
    e = V.table(spark, sf, "events").withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(""))
    return reconcile.first_names(e, "user_id", "event_type", ["ts", "event_id"])


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY event_type")
def event_histogram(spark, sf):
    # a map of counts for each user and day, merged
    per = V.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = per.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    return reconcile.event_histogram(maps, "counts")


@query("""WITH e AS (SELECT r_name AS k, count(*) AS v FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name)
  SELECT substr(sha256('{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}'), 1, 16) AS correction_set_id FROM e""")
def correction_set(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    e = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("v"))
    return reconcile.correction_set_id(e, "r_name", "v")


@query("""WITH g AS (SELECT o_orderkey, lpad(CAST(20000000 + (o_orderkey % 30) * 100000 + CASE WHEN o_orderkey % 7 = 0 THEN 20000000 ELSE 0 END + o_orderkey % 1000 AS VARCHAR), 10, '0') AS game_id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END AS raw FROM orders)
  SELECT o_orderkey, game_id, (2000 + CAST(substr(game_id, 4, 2) AS INTEGER)) || '-' || lpad(CAST((2001 + CAST(substr(game_id, 4, 2) AS INTEGER)) % 100 AS VARCHAR), 2, '0') AS season, CASE substr(game_id, 3, 1) WHEN '2' THEN 'Regular Season' WHEN '4' THEN 'Playoffs' END AS kind, coalesce(substr(game_id, 3, 1) = '4', false) AS playoff,
  CASE WHEN regexp_full_match(raw, '[0-9]{8}') THEN CAST(strptime(raw, '%Y%m%d') AS DATE) WHEN regexp_full_match(raw, '[0-9]{4}-.*') THEN CAST(raw AS DATE) END AS day FROM g""")
def game_identity(spark, sf):
    k = F.col("o_orderkey")
    raw = (20000000 + (k % 30) * 100000 + F.when(k % 7 == 0, 20000000).otherwise(0) + k % 1000).cast("string")
    date = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("unknown")
    g = V.table(spark, sf, "orders").select(k, S.game_id(raw).alias("game_id"), date.alias("raw")).withColumn("kind", S.season_type(F.col("game_id")))
    return g.select("o_orderkey", "game_id", S.season_of(F.col("game_id")).alias("season"), "kind", F.coalesce(S.is_playoff(F.col("kind")), F.lit(False)).alias("playoff"), S.iso_date("raw").alias("day"))


@query("""WITH c AS (SELECT event_id, CAST(event_id % 6 + 1 AS INTEGER) AS period, CASE event_id % 5 WHEN 0 THEN 'bad' WHEN 1 THEN event_id % 12 || ':xx' ELSE event_id % 12 || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') END AS clock FROM events)
  SELECT event_id, CASE WHEN regexp_full_match(clock, '[0-9]+:[0-9]+') THEN CAST(split_part(clock, ':', 1) AS INTEGER) * 60 + CAST(split_part(clock, ':', 2) AS DOUBLE) END AS remaining, CASE WHEN regexp_full_match(clock, '[0-9]+:[0-9]+') THEN (CASE WHEN period <= 4 THEN 720 ELSE 300 END) - (CAST(split_part(clock, ':', 1) AS INTEGER) * 60 + CAST(split_part(clock, ':', 2) AS DOUBLE)) END AS elapsed FROM c""")
def clock_parsing(spark, sf):
    i = F.col("event_id")
    clock = F.when(i % 5 == 0, "bad").when(i % 5 == 1, F.concat((i % 12).cast("string"), F.lit(":xx"))).otherwise(F.concat_ws(":", (i % 12).cast("string"), F.lpad((i % 60).cast("string"), 2, "0")))
    c = V.table(spark, sf, "events").select(i, (i % 6 + 1).cast("int").alias("period"), clock.alias("clock")).withColumn("remaining", S.clock_seconds("clock"))
    return c.select("event_id", "remaining", S.elapsed(F.col("period"), F.col("remaining")).alias("elapsed"))


@query("""WITH s AS (SELECT l_suppkey, CASE WHEN l_quantity >= 30 THEN '3PT Field Goal' ELSE '2PT Field Goal' END AS t, CASE l_linenumber WHEN 1 THEN 'Restricted Area' WHEN 2 THEN 'Left Corner 3' WHEN 3 THEN 'Mid-Range' ELSE 'Backcourt' END AS z FROM lineitem)
  SELECT l_suppkey, CASE WHEN t LIKE '3%' AND z LIKE '%Corner 3%' THEN 'corner3' WHEN t LIKE '3%' THEN 'three' WHEN z = 'Restricted Area' THEN 'rim' WHEN z = 'Mid-Range' THEN 'mid' ELSE 'other' END AS class, count(*) AS shots FROM s GROUP BY ALL""")
def shot_classes(spark, sf):
    n = F.col("l_linenumber")
    kind = F.when(F.col("l_quantity") >= 30, "3PT Field Goal").otherwise("2PT Field Goal")
    zone = F.when(n == 1, "Restricted Area").when(n == 2, "Left Corner 3").when(n == 3, "Mid-Range").otherwise("Backcourt")
    return V.table(spark, sf, "lineitem").groupBy("l_suppkey", S.shot_class(kind, zone).alias("class")).agg(F.count(F.lit(1)).alias("shots"))


@query("""WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'MISS Free Throw' WHEN 1 THEN 'Miss Free Throw' WHEN 2 THEN 'Free Throw Technical' ELSE 'Player REBOUND (Off:' || event_id % 5 || ' Def:' || event_id % 9 || ')' END AS t FROM events)
  SELECT event_id, CASE WHEN t LIKE '%Technical%' THEN 'technical' WHEN t LIKE 'MISS%' THEN 'missed' ELSE 'made' END AS profile_ft, CASE WHEN t LIKE '%Technical%' THEN 'technical' WHEN upper(t) LIKE 'MISS%' THEN 'missed' ELSE 'made' END AS production_ft,
  CAST(nullif(regexp_extract(t, 'Off:(\\d+)\\s+Def:(\\d+)', 1), '') AS INTEGER) AS off_total, CAST(nullif(regexp_extract(t, 'Off:(\\d+)\\s+Def:(\\d+)', 2), '') AS INTEGER) AS def_total FROM d""")
def description_rules(spark, sf):
    i = F.col("event_id")
    t = F.when(i % 4 == 0, "MISS Free Throw").when(i % 4 == 1, "Miss Free Throw").when(i % 4 == 2, "Free Throw Technical").otherwise(F.concat(F.lit("Player REBOUND (Off:"), (i % 5).cast("string"), F.lit(" Def:"), (i % 9).cast("string"), F.lit(")")))
    d = V.table(spark, sf, "events").select(i, F.lit(None).cast("string").alias("home"), F.lit("").alias("visitor"), t.alias("neutral")).select("event_id", S.first_text("home", "visitor", "neutral").alias("t"))
    return d.select("event_id", S.free_throw(F.col("t")).alias("profile_ft"), S.free_throw(F.col("t"), True).alias("production_ft"), S.rebounds(F.col("t"))["off"].alias("off_total"), S.rebounds(F.col("t"))["def"].alias("def_total"))


# -- splits ---------------------------------------------------------------------------------------

_CHRONO_SQL = f"""{STINT}, game AS (SELECT game_date, game_id, sum(offensive_possessions) AS n FROM stint GROUP BY ALL),
reached AS (SELECT *, coalesce(sum(n) OVER (ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM game),
split AS (SELECT stint_id, CASE WHEN before < 0.6::DOUBLE * total THEN 'train' ELSE 'test' END AS side FROM stint JOIN reached USING (game_date, game_id))"""
_HELD_LINEUP_SQL = """, ranked AS (SELECT lineup, stint_id, row_number() OVER (ORDER BY game_date, game_id, period, start_time_seconds, stint_id) AS place FROM stint),
held AS (SELECT lineup FROM (SELECT lineup, count(*) AS n, min(place) AS f FROM ranked GROUP BY lineup HAVING count(*) >= 3) ORDER BY n DESC, f DESC, lineup LIMIT 20),
side AS (SELECT stint_id, CASE WHEN held.lineup IS NULL THEN 'train' ELSE 'test' END AS side FROM stint LEFT JOIN held USING (lineup))"""


@query(f"{_CHRONO_SQL} SELECT stint_id, side FROM split")
def chronological_split(spark, sf):
    return splits.chronological(V.stints(spark, sf))


@query(f"""{_CHRONO_SQL}, x AS (SELECT * FROM stint JOIN split USING (stint_id)) SELECT 'train_after_test' AS "check", CAST(CASE WHEN max(CASE WHEN side = 'train' THEN game_date END) >= min(CASE WHEN side = 'test' THEN game_date END) THEN 1 ELSE 0 END AS BIGINT) AS violations FROM x
  UNION ALL SELECT 'straddling_games', count(*) FROM (SELECT game_id FROM x GROUP BY game_id HAVING count(DISTINCT side) > 1)""")
def chronological_gate(spark, sf):
    s = V.stints(spark, sf)
    return splits.chronological_gate(s, splits.chronological(s))


@query(f"""{_CHRONO_SQL} SELECT 'overlap' AS "check", (SELECT count(*) FROM (SELECT stint_id FROM split WHERE side = 'train' INTERSECT SELECT stint_id FROM split WHERE side = 'test')) AS violations UNION ALL SELECT 'unknown', count(*) FROM split WHERE stint_id NOT IN (SELECT stint_id FROM stint)
  UNION ALL SELECT 'missing', count(*) FROM stint WHERE stint_id NOT IN (SELECT stint_id FROM split) UNION ALL SELECT 'empty_test', CAST(CASE WHEN (SELECT count(*) FROM split WHERE side = 'test') = 0 THEN 1 ELSE 0 END AS BIGINT)""")
def split_verification(spark, sf):
    s = V.stints(spark, sf)
    return splits.verify(s, splits.chronological(s))


@query(f"{STINT}{_HELD_LINEUP_SQL} SELECT stint_id, side FROM side")
def unseen_lineup_split(spark, sf):
    s = V.stints(spark, sf)
    return splits.hold_out_lineups(s, splits.unseen_lineups(s, 20))


@query(f"""{STINT}{_HELD_LINEUP_SQL}, leaky AS (SELECT stint_id, CASE WHEN CAST(stint_id AS BIGINT) % 2 = 0 THEN 'train' ELSE side END AS side FROM side),
  k AS (SELECT lineup, max(CASE WHEN side = 'train' THEN 1 ELSE 0 END) AS tr, max(CASE WHEN side = 'test' THEN 1 ELSE 0 END) AS te FROM stint JOIN leaky USING (stint_id) GROUP BY lineup)
  SELECT 'seen_in_train' AS "check", count(*) FILTER (tr = 1) AS violations FROM held LEFT JOIN k USING (lineup) UNION ALL SELECT 'absent_from_test', count(*) FILTER (coalesce(te, 0) = 0) FROM held LEFT JOIN k USING (lineup)""")
def lineup_gate(spark, sf):
    # half of the held stints are put back into train, so that the gate has something to report
    s = V.stints(spark, sf)
    held = splits.unseen_lineups(s, 20)
    leaky = splits.hold_out_lineups(s, held).withColumn("side", F.when(F.col("stint_id").cast("long") % 2 == 0, "train").otherwise(F.col("side")))
    return splits.lineup_gate(s, leaky, held)


_HELD_PAIR_SQL = """, cand AS (SELECT a, b, count(*) AS n FROM pair GROUP BY a, b HAVING count(*) >= 3), hp AS (SELECT a, b FROM cand ORDER BY n, a, b LIMIT 4),
side AS (SELECT s.stint_id, CASE WHEN EXISTS (SELECT 1 FROM pair JOIN hp USING (a, b) WHERE pair.stint_id = s.stint_id) THEN 'test' ELSE 'train' END AS side FROM stint s)"""


@query(f"""{STINT}{PAIRS}{_HELD_PAIR_SQL}, seen AS (SELECT a, b, max(CASE WHEN side = 'train' THEN 1 ELSE 0 END) AS tr, max(CASE WHEN side = 'test' THEN 1 ELSE 0 END) AS te FROM pair JOIN side USING (stint_id) GROUP BY a, b),
  alone AS (SELECT DISTINCT unnest(offense_player_ids) AS p FROM stint JOIN side USING (stint_id) WHERE side = 'train')
  SELECT 'together_in_train' AS "check", count(*) FILTER (tr = 1) AS violations FROM hp LEFT JOIN seen USING (a, b) UNION ALL SELECT 'never_in_test', count(*) FILTER (coalesce(te, 0) = 0) FROM hp LEFT JOIN seen USING (a, b)
  UNION ALL SELECT 'player_unseen', count(*) FROM hp WHERE a NOT IN (SELECT p FROM alone) OR b NOT IN (SELECT p FROM alone)""")
def pair_gate(spark, sf):
    s = V.stints(spark, sf)
    held = splits.pair_candidates(s, 3, 1_000_000_000).orderBy("stints", "a", "b").limit(4)
    return splits.pair_gate(s, splits.hold_out_pairs(s, held), held)


@query()
def unseen_pair_split(spark, sf):
    s = V.stints(spark, sf)
    taken = splits.unseen_pairs(s, n_pairs=4, budget=0.5, cap_share=1.0)
    return splits.hold_out_pairs(s, spark.createDataFrame(taken, "a long, b long"))


@query(f"""{_CHRONO_SQL}, tr AS (SELECT * FROM stint JOIN split USING (stint_id) WHERE side = 'train'), te AS (SELECT * FROM stint JOIN split USING (stint_id) WHERE side = 'test'),
  l AS (SELECT lineup, any_value(offense_player_ids) AS m, count(*) AS stints, sum(offensive_possessions) AS possessions FROM te GROUP BY lineup),
  trp AS (SELECT DISTINCT x.a, b FROM (SELECT offense_player_ids AS m, unnest(offense_player_ids) AS a FROM tr) x, (SELECT unnest(range(0, 120)) AS b) y WHERE b > a AND list_contains(m, b)),
  lp AS (SELECT lineup, a, b FROM (SELECT lineup, m, unnest(m) AS a FROM l) x, (SELECT unnest(range(0, 120)) AS b) y WHERE b > a AND list_contains(m, b)),
  am AS (SELECT lineup, bool_and(trp.a IS NOT NULL) AS ok FROM lp LEFT JOIN trp ON trp.a = lp.a AND trp.b = lp.b GROUP BY lineup)
  SELECT lineup, CASE WHEN lineup IN (SELECT lineup FROM tr) THEN 'seen' WHEN ok THEN 'partially_seen' ELSE 'unseen' END AS novelty, stints, possessions FROM l LEFT JOIN am USING (lineup)""")
def novelty_classes(spark, sf):
    s = V.stints(spark, sf)
    sided = s.join(splits.chronological(s), "stint_id")
    return splits.novelty(sided.where("side = 'train'"), sided.where("side = 'test'"))


@query(f"""{STINT} SELECT 'shared_ids' AS "check", (SELECT count(*) FROM (SELECT stint_id FROM stint WHERE CAST(stint_id AS BIGINT) % 3 < 2 INTERSECT SELECT stint_id FROM stint WHERE CAST(stint_id AS BIGINT) % 3 > 0)) AS violations UNION ALL SELECT 'shared_games', count(*) FROM (SELECT game_id FROM stint WHERE CAST(stint_id AS BIGINT) % 3 < 2 INTERSECT SELECT game_id FROM stint WHERE CAST(stint_id AS BIGINT) % 3 > 0) UNION ALL SELECT 'empty_test', CAST(count(*) = 0 AS BIGINT) FROM stint WHERE CAST(stint_id AS BIGINT) % 3 > 0""")
def transport_gate(spark, sf):
    s = V.stints(spark, sf)
    # the tables overlap, so that the gate has something to report
    return splits.transport_gate(s.where("cast(stint_id as bigint) % 3 < 2"), s.where("cast(stint_id as bigint) % 3 > 0"))


@query("""WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS p, count(*) OVER () AS n FROM orders), c AS (SELECT day AS cut FROM r WHERE p = floor(0.7::DOUBLE * n) + 1)
  SELECT o_orderkey, CASE WHEN day < cut THEN 'train' ELSE 'test' END AS side FROM r, c""")
def date_cut_split(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return splits.date_cut(o, "day", ["o_orderkey"]).select("o_orderkey", "side")


# -- profiles, roles, cohorts ---------------------------------------------------------------------


@query("""WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY user_id),
  l AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS k FROM events GROUP BY ALL), s AS (SELECT user_id, sum(k) AS k_total FROM l GROUP BY user_id)
  SELECT user_id, CAST(views AS DOUBLE) AS views, CAST(clicks AS DOUBLE) AS clicks, CAST(purchases AS DOUBLE) AS purchases, CAST(k_total AS DOUBLE) AS k_total, round((clicks + 0.44 * purchases) / nullif(views, 0), 6) AS usage FROM n JOIN s USING (user_id)""")
def profile_rates(spark, sf):
    e = V.table(spark, sf, "events")
    kind = lambda k: F.col("event_type") == k
    counts = profiles.tally(e, ["user_id"], views=kind("view"), clicks=kind("click"), purchases=kind("purchase"))
    k = e.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k_total"))
    totals = profiles.last_then_sum(k, ["user_id"], "day", ["ts", "event_id"], ["k_total"])
    both = profiles.assemble([counts, totals], ["user_id"], ["views", "clicks", "purchases", "k_total"])
    return _round(both.withColumn("usage", profiles.usage(F.col("clicks"), F.col("purchases"), F.lit(0.0), F.nullif(F.col("views"), F.lit(0.0)))), "usage")


_ROLE_SQL = f"""WITH {PROFILE_SQL}, complete AS (SELECT * FROM profile WHERE click_rate IS NOT NULL AND buy_rate IS NOT NULL AND basket IS NOT NULL),
z AS (SELECT player_id, (click_rate - avg(click_rate) OVER ()) / coalesce(nullif(stddev_pop(click_rate) OVER (), 0), 1) AS z1, (buy_rate - avg(buy_rate) OVER ()) / coalesce(nullif(stddev_pop(buy_rate) OVER (), 0), 1) AS z2, (basket - avg(basket) OVER ()) / coalesce(nullif(stddev_pop(basket) OVER (), 0), 1) AS z3 FROM complete)"""
_FEATURES = ["click_rate", "buy_rate", "basket"]


def _roles(spark, sf):
    z = profiles.standardised(V.profiles(spark, sf), _FEATURES)
    return z.select("player_id", *[F.col(f"z_{f}").alias(f"z{i + 1}") for i, f in enumerate(_FEATURES)])


@query(f"{_ROLE_SQL} SELECT player_id, round(z1, 6) AS z1, round(z2, 6) AS z2, round(z3, 6) AS z3 FROM z")
def role_standardised(spark, sf):
    return _round(_roles(spark, sf), "z1", "z2", "z3")


_MEMBER_SQL = """, member AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events), team AS (SELECT DISTINCT day, user_id FROM member)"""


def _day_members(spark, sf):
    return V.table(spark, sf, "events").select(F.to_date("ts").alias("row"), F.col("user_id").alias("member")).distinct()


@query(f"{_ROLE_SQL}{_MEMBER_SQL} SELECT day AS \"row\", round(sum(z1) * sum(z1) - sum(z1 * z1), 4) AS z1, round(sum(z2) * sum(z2) - sum(z2 * z2), 4) AS z2, round(sum(z3) * sum(z3) - sum(z3 * z3), 4) AS z3 FROM team JOIN z ON user_id = player_id GROUP BY day")
def concentration(spark, sf):
    joined = _day_members(spark, sf).join(_roles(spark, sf), F.col("member") == F.col("player_id"))
    return _round(profiles.concentration(joined, "row", ["z1", "z2", "z3"]), "z1", "z2", "z3", digits=4)


@query(f"""{STINT}, m AS (SELECT stint_id, unnest(offense_player_ids) AS p FROM stint), q AS (SELECT x.stint_id, x.p % 4 AS a, y.p % 4 AS b FROM m x JOIN m y ON x.stint_id = y.stint_id AND x.p < y.p WHERE x.p <> 11 AND y.p <> 11)
  SELECT stint_id AS "row", CAST(least(a, b) * 4 - least(a, b) * (least(a, b) - 1) // 2 + greatest(a, b) - least(a, b) AS BIGINT) AS bin, count(*) AS n FROM q GROUP BY ALL""")
def role_pair_bins(spark, sf):
    m = V.stints(spark, sf).select(F.col("stint_id").alias("row"), F.explode("offense_player_ids").alias("member"))
    m = spread(m, V.table(spark, sf, "orders").count(), V.STINTS_EACH, "row")
    return profiles.role_pairs(m.withColumn("role", F.when(F.col("member") != 11, F.col("member") % 4)), 4)


_MOVE_SQL = """WITH t AS (SELECT o_custkey AS player_id, CAST(year(o_orderdate) - 1992 AS INTEGER) AS season_index, o_orderpriority AS team, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 1),
d AS (SELECT player_id, season_index, min(team) AS team, min(n) AS n FROM t GROUP BY ALL HAVING count(*) = 1)
SELECT a.player_id, a.season_index, a.team AS from_team, a.n AS before, b.team AS to_team, b.n AS after FROM d a JOIN d b ON b.player_id = a.player_id AND b.season_index = a.season_index + 1 WHERE a.team {} b.team"""


@query(_MOVE_SQL.format("<>"))
def clean_moves(spark, sf):
    return profiles.moves(V.memberships(spark, sf), 1)


@query(_MOVE_SQL.format("="))
def phantom_moves(spark, sf):
    return profiles.moves(V.memberships(spark, sf), 1, changed=False)


@query("SELECT c_custkey FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 50")
def hash_sample(spark, sf):
    return profiles.hash_sample(V.table(spark, sf, "customer").select("c_custkey"), "c_custkey", 50, 7)


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) AS p, c_custkey FROM customer), b AS (SELECT row_number() OVER (ORDER BY md5('11|' || c_custkey), c_custkey) AS p, c_mktsegment FROM customer) SELECT c_custkey, c_mktsegment FROM a JOIN b USING (p)""")
def permutation_placebo(spark, sf):
    return profiles.permuted(V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 11)


@query("""WITH g AS (SELECT l_orderkey, sum(l_linenumber) AS points, count(*) FILTER (l_returnflag = 'R') AS rim, count(*) AS attempts FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey, CAST(coalesce(attempts, 0) AS DOUBLE) AS weight, round(coalesce(points / nullif(attempts, 0), 0), 6) AS value FROM orders LEFT JOIN g ON l_orderkey = o_orderkey WHERE coalesce(attempts, 0) >= 2""")
def outcome_rates(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("points"), F.count(F.lit(1)).alias("attempts"))
    o = V.table(spark, sf, "orders").join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return _round(profiles.outcome(o, "pts_per_shot", 2).select("o_orderkey", "weight", "value"), "value")


@query(f"""{STINT}, v AS (SELECT 'period' AS "column", CAST(period AS DOUBLE) AS x FROM stint UNION ALL SELECT 'season_index', season_index FROM stint UNION ALL SELECT 'days_rest_offense', days_rest_offense FROM stint UNION ALL SELECT 'zero', 0 FROM stint)
  SELECT "column", max(x) - min(x) AS range, round(stddev_pop(x), 6) AS deviation, stddev_pop(x) < 1e-9 AND max(abs(x)) < 1e-9 AS dead, max(x) = min(x) AS constant FROM v GROUP BY "column\"""")
def column_health(spark, sf):
    s = V.stints(spark, sf).withColumn("zero", F.lit(0))
    return _round(profiles.dead_columns(s, ["period", "season_index", "days_rest_offense", "zero"]), "deviation")


# -- linear statistics ----------------------------------------------------------------------------


_SEASONS = tuple(range(0, 8))
_CONTEXT_SQL = f"""{STINT}, k AS (SELECT avg(score_margin_offense) AS mm, coalesce(nullif(stddev_pop(score_margin_offense), 0), 1) AS sm, avg(days_rest_offense) AS mr, coalesce(nullif(stddev_pop(days_rest_offense), 0), 1) AS sr FROM stint),
c AS (SELECT stint_id, 100.0::DOUBLE * points_scored / offensive_possessions AS y, offensive_possessions::DOUBLE AS w, 1.0::DOUBLE AS intercept, CAST(home_offense AS INTEGER)::DOUBLE AS home, (score_margin_offense - mm) / sm AS margin, power((score_margin_offense - mm) / sm, 2) AS margin2,
  CASE WHEN period = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS period_2, CASE WHEN period = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS period_3, CASE WHEN period >= 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS period_4, CAST(playoff AS INTEGER)::DOUBLE AS playoff, (days_rest_offense - mr) / sr AS rest, garbage_time_weight - 1 AS garbage, {", ".join(f"CASE WHEN season_index = {s} THEN 1.0 ELSE 0.0 END::DOUBLE AS season_{s}" for s in _SEASONS[1:])} FROM stint, k)"""
_CONTEXT_NAMES = ["intercept", "home", "margin", "margin2", "period_2", "period_3", "period_4", "playoff", "rest", "garbage", *(f"season_{s}" for s in _SEASONS[1:])]


def _context(spark, sf):
    s = V.stints(spark, sf)
    return s, gram.context(s, gram.scaler(s), list(_SEASONS))


def _context_rows(spark, sf):
    s = V.stints(spark, sf)
    scale = gram.scaler(s)
    return gram.design(s.crossJoin(F.broadcast(scale)), gram.context_columns(list(_SEASONS), {c: F.col(c) for c in scale.columns}))  # scale: one row


@query(f"{_CONTEXT_SQL} SELECT stint_id, {', '.join(f'round({n}, 6) AS {n}' for n in _CONTEXT_NAMES)} FROM c")
def context_design(spark, sf):
    return _round(_context(spark, sf)[1], *_CONTEXT_NAMES)


_CELL_SQL = """, cell AS (SELECT stint_id, 'o' || p AS col, 1.0::DOUBLE AS val, y, w FROM (SELECT stint_id, unnest(offense_player_ids) AS p, 100.0::DOUBLE * points_scored / offensive_possessions AS y, offensive_possessions::DOUBLE AS w FROM stint)
UNION ALL SELECT stint_id, 'd' || p, -1.0::DOUBLE, y, w FROM (SELECT stint_id, unnest(defense_player_ids) AS p, 100.0::DOUBLE * points_scored / offensive_possessions AS y, offensive_possessions::DOUBLE AS w FROM stint))"""


@query(f"{STINT}{_CELL_SQL} SELECT a.col AS i, b.col AS j, round(sum(a.w * a.val * b.val), 4) AS g FROM cell a JOIN cell b ON a.stint_id = b.stint_id AND a.col <= b.col GROUP BY ALL")
def gram_blocks(spark, sf):
    return _round(gram.gram(gram.design(V.stints(spark, sf))), "g", digits=4)


@query(f"{STINT}{_CELL_SQL} SELECT col AS i, round(sum(w * y * val), 3) AS b FROM cell GROUP BY col")
def gram_rhs(spark, sf):
    return _round(gram.rhs(gram.design(V.stints(spark, sf))), "b", digits=3)


@query(f"""{_CONTEXT_SQL}, u AS (UNPIVOT (SELECT stint_id, w, {', '.join(_CONTEXT_NAMES)} FROM c) ON {', '.join(_CONTEXT_NAMES)} INTO NAME col VALUE val)
  SELECT 'c_' || a.col AS i, 'c_' || b.col AS j, round(sum(a.w * a.val * b.val), 3) AS g FROM u a JOIN u b ON a.stint_id = b.stint_id AND a.col <= b.col WHERE a.val <> 0 AND b.val <> 0 GROUP BY ALL""")
def rung0_gram(spark, sf):
    rows = _context_rows(spark, sf).withColumn("cells", F.filter("cells", lambda x: x["col"].startswith("c_")))
    return _round(gram.gram(rows), "g", digits=3)


@query(f"""{STINT}, r AS (SELECT lineup, CAST(home_offense AS INTEGER)::DOUBLE AS h, 100.0::DOUBLE * points_scored / offensive_possessions AS y, offensive_possessions::DOUBLE AS w FROM stint),
  k AS (SELECT sum(w) + 1e-3 AS a, sum(w * h) AS b, sum(w * h * h) + 1e-3 AS c, sum(w * y) AS u, sum(w * h * y) AS v FROM r),
  e AS (SELECT lineup, w, y - (u * c - b * v) / (a * c - b * b) - h * (a * v - b * u) / (a * c - b * b) AS e FROM r, k),
  g AS (SELECT lineup, sum(w) AS w, sum(w * e) / sum(w) AS mean, sum(w * e * e) - power(sum(w * e), 2) / sum(w) AS ss FROM e GROUP BY lineup),
  s AS (SELECT sum(ss) / sum(w) AS sigma2 FROM g), t AS (SELECT greatest(0, sum(w * power(mean, 2)) / sum(w) - power(sum(w * mean) / sum(w), 2) - sum(w * (sigma2 / greatest(w, 1))) / sum(w)) AS tau2, any_value(sigma2) AS sigma2 FROM g, s)
  SELECT lineup, round(CASE WHEN tau2 > 0 THEN tau2 / (tau2 + sigma2 / greatest(w, 1)) ELSE 0 END, 6) AS shrinkage, round(CASE WHEN tau2 > 0 THEN mean * tau2 / (tau2 + sigma2 / greatest(w, 1)) ELSE 0 END, 5) AS shift FROM g, t""")
def rung1_eb(spark, sf):
    from . import models

    # of the context, the two columns whose fit SQL can solve
    return _round(_round(models.lineup_shifts(V.stints(spark, sf), ("intercept", "home")), "shrinkage"), "shift", digits=5)


# -- error, calibration, bootstrap ----------------------------------------------------------------

_SCORED_SQL = f"""{_CHRONO_SQL}, sided AS (SELECT s.*, side, 100.0::DOUBLE * points_scored / offensive_possessions AS y, offensive_possessions::DOUBLE AS w FROM stint s JOIN split USING (stint_id)),
mu AS (SELECT sum(w * y) / sum(w) AS mu FROM sided WHERE side = 'train'), tm AS (SELECT offense_team_id, sum(w * y) / sum(w) AS team_mu FROM sided WHERE side = 'train' GROUP BY 1),
scored AS (SELECT t.*, mu AS base, coalesce(team_mu, mu) AS model FROM sided t CROSS JOIN mu LEFT JOIN tm USING (offense_team_id) WHERE side = 'test')"""


def _scored(spark, sf):
    """Test stints with the training mean as ``base`` and the team's training mean as ``model``."""
    s = V.stints(spark, sf)
    s = s.join(splits.chronological(s), "stint_id").withColumns({"y": S.rating(F.col("points_scored"), F.col("offensive_possessions")), "w": F.col("offensive_possessions").cast("double"), "lineup": S.lineup_id("offense_player_ids")})
    train = s.where("side = 'train'")
    mu = train.agg(metrics.weighted_mean("y", "w").alias("base"))
    team = train.groupBy("offense_team_id").agg(metrics.weighted_mean("y", "w").alias("team_mu"))
    test = s.where("side = 'test'").crossJoin(F.broadcast(mu)).join(team, "offense_team_id", "left")  # mu: one row
    return test.withColumn("model", F.coalesce("team_mu", "base")).drop("team_mu")


@query(f"""{_SCORED_SQL}, g AS (SELECT lineup, sum(w * y) / sum(w) AS a, sum(w * model) / sum(w) AS p FROM scored GROUP BY lineup)
  SELECT round(sqrt(sum(w * power(y - model, 2)) / sum(w)), 6) AS micro_rmse, round(sum(w * abs(y - model)) / sum(w), 6) AS micro_mae, count(*) AS rows, (SELECT round(sqrt(avg(power(a - p, 2))), 6) FROM g) AS macro_rmse, (SELECT round(avg(abs(a - p)), 6) FROM g) AS macro_mae, (SELECT count(*) FROM g) AS groups FROM scored""")
def micro_macro_error(spark, sf):
    return _round(metrics.micro_macro(_scored(spark, sf), "lineup", "y", "model", "w"), "micro_rmse", "micro_mae", "macro_rmse", "macro_mae")


@query(f"""{_SCORED_SQL}, g AS (SELECT lineup, sum(w * y) / sum(w) AS a, sum(w * base) / sum(w) AS b, sum(w * model) / sum(w) AS m FROM scored GROUP BY lineup),
  e AS (SELECT (SELECT sqrt(sum(w * power(y - base, 2)) / sum(w)) FROM scored) AS bi, (SELECT sqrt(avg(power(a - b, 2))) FROM g) AS ba, (SELECT sqrt(sum(w * power(y - model, 2)) / sum(w)) FROM scored) AS mi, (SELECT sqrt(avg(power(a - m, 2))) FROM g) AS ma)
  SELECT round(bi, 6) AS base_micro, round(ba, 6) AS base_macro, round(mi, 6) AS model_micro, round(ma, 6) AS model_macro, round(100 * (bi - mi) / bi, 5) AS micro_gain_percent, round(100 * (ba - ma) / ba, 5) AS macro_gain_percent FROM e""")
def baseline_gain(spark, sf):
    g = metrics.gain_percent(_scored(spark, sf), "lineup", "y", "base", "model", "w")
    return _round(_round(g, "base_micro", "base_macro", "model_micro", "model_macro"), "micro_gain_percent", "macro_gain_percent", digits=5)


@query(f"""{_SCORED_SQL}, g AS (SELECT lineup, sum(w) AS w, sum(w * y) / sum(w) AS a, sum(w * base) / sum(w) AS b, sum(w * model) / sum(w) AS m FROM scored GROUP BY lineup HAVING count(*) >= 2)
  SELECT round(sqrt(sum(w * power(a - b, 2)) / sum(w)), 6) AS base_rmse, round(sqrt(sum(w * power(a - m, 2)) / sum(w)), 6) AS model_rmse, count(*) AS groups, round(sqrt(sum(w * power(a - b, 2)) / sum(w)) - sqrt(sum(w * power(a - m, 2)) / sum(w)), 6) AS gain FROM g""")
def group_rmse_gain(spark, sf):
    return _round(metrics.group_rmse_gain(_scored(spark, sf), "lineup", "y", "base", "model", "w"), "base_rmse", "model_rmse", "gain")


@query(f"""{_SCORED_SQL}, x AS (SELECT *, unnest(['all', CASE WHEN abs(score_margin_offense) <= 6 AND period >= 4 THEN 'clutch' ELSE 'other' END]) AS context FROM scored) SELECT context, count(*) AS rows, round(sqrt(sum(w * power(y - model, 2)) / sum(w)), 6) AS rmse FROM x GROUP BY context""")
def error_by_context(spark, sf):
    return _round(metrics.by_context(_scored(spark, sf), "y", "model", "w"), "rmse")


_GROUP_SQL = f"""{_SCORED_SQL}, g AS (SELECT lineup, sum(w) AS weight, sum(w * y) / sum(w) AS actual, sum(w * model) / sum(w) AS point, sum(w * base) / sum(w) AS base, sqrt(100 + 90000 / sum(w)) AS sd FROM scored GROUP BY lineup)"""


def _groups(spark, sf):
    g = _scored(spark, sf).groupBy("lineup").agg(F.sum("w").alias("weight"), *[metrics.weighted_mean(c, "w").alias(n) for c, n in (("y", "actual"), ("model", "point"), ("base", "base"))])
    return g.withColumn("sd", F.sqrt(100 + 90000 / F.col("weight")))


@query(f"""{_GROUP_SQL}, s AS (SELECT *, (actual - point) / sd AS z, 1 / (sd * sd) AS w FROM g), a AS (SELECT count(*) AS groups, avg(CASE WHEN abs(z) <= 0.6744897501960817 THEN 1.0 ELSE 0 END) AS c50, avg(CASE WHEN abs(z) <= 1.2815515655446004 THEN 1.0 ELSE 0 END) AS c80, avg(CASE WHEN abs(z) <= 1.959963984540054 THEN 1.0 ELSE 0 END) AS c95,
  avg(z) AS zm, coalesce(stddev_samp(z), 0) AS zs, corr(sd, abs(actual - point)) AS we, sum(w) AS sw, sum(w * point) AS sx, sum(w * actual) AS sy, sum(w * point * point) AS sxx, sum(w * point * actual) AS sxy FROM s)
  SELECT groups, round(c50, 6) AS coverage_50, round(c80, 6) AS coverage_80, round(c95, 6) AS coverage_95, round(zm, 6) AS z_mean, round(zs, 6) AS z_sd, round(we, 6) AS width_vs_error, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 5) AS slope, round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 3) AS intercept FROM a""")
def calibration_report(spark, sf):
    c = metrics.calibration(_groups(spark, sf), "point", "sd", "actual")
    return _round(_round(_round(c, *[n for n in c.columns if n not in ("groups", "slope", "intercept")]), "slope", digits=5), "intercept", digits=3)


@query(f"""{_GROUP_SQL} SELECT count(*) AS n, round(avg(actual - point), 6) AS mean, round(median(actual - point), 6) AS median, round(stddev_samp(actual - point), 6) AS sd, round(avg(abs(actual - point)), 6) AS mean_abs, round(sqrt(avg(power(actual - point, 2))), 6) AS rmse, round(avg(CASE WHEN actual > point THEN 1.0 ELSE 0 END), 6) AS share_positive FROM g""")
def error_summary(spark, sf):
    s = metrics.summary(_groups(spark, sf).withColumn("e", F.col("actual") - F.col("point")), "e")
    return _round(s, *[c for c in s.columns if c != "n"])


@query(f"{_GROUP_SQL} SELECT count(*) AS n, round(regr_slope(actual, point), 5) AS slope, round(regr_intercept(actual, point), 3) AS intercept, round(corr(actual, point), 6) AS correlation FROM g")
def error_regression(spark, sf):
    r = metrics.regression(_groups(spark, sf), "actual", "point")
    return _round(_round(_round(r, "slope", digits=5), "intercept", digits=3), "correlation")


_DRAW_SQL = """, p AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS place, count(*) OVER () AS n FROM {table}),
d AS (SELECT r AS replicate, ('0x' || substr(md5('{seed}|' || r || '|' || p.place), 1, 8))::BIGINT % n AS place FROM p, (SELECT unnest(range(0, {times})) AS r))"""


@query(f"""{_GROUP_SQL}{_DRAW_SQL.format(key="lineup", table="g", seed=5, times=50)} SELECT CAST(replicate AS INTEGER) AS replicate, round(sqrt(avg(power(actual - base, 2))) - sqrt(avg(power(actual - point, 2))), 6) AS delta FROM d JOIN p USING (place) GROUP BY replicate""")
def bootstrap_delta(spark, sf):
    sq = lambda c: (F.col("actual") - F.col(c)) * (F.col("actual") - F.col(c))
    b = metrics.bootstrap(_groups(spark, sf), "lineup", 50, 5, base=sq("base"), model=sq("point"))
    return _round(b.select("replicate", (F.sqrt(F.col("base") / F.col("draws")) - F.sqrt(F.col("model") / F.col("draws"))).alias("delta")), "delta")


@query(f"""{_GROUP_SQL}{_DRAW_SQL.format(key="lineup", table="g", seed=5, times=50)}, b AS (SELECT replicate, sqrt(avg(power(actual - base, 2))) - sqrt(avg(power(actual - point, 2))) AS delta FROM d JOIN p USING (place) GROUP BY replicate), s AS (SELECT list_sort(list(delta)) AS v FROM b)
  SELECT round(v[2], 6) AS low, round(v[49], 6) AS high, round(len(list_filter(v, lambda x: x > 0)) / 50, 6) AS share_positive FROM s""")
def bootstrap_interval(spark, sf):
    sq = lambda c: (F.col("actual") - F.col(c)) * (F.col("actual") - F.col(c))
    b = metrics.bootstrap(_groups(spark, sf), "lineup", 50, 5, base=sq("base"), model=sq("point"))
    i = metrics.interval(b.withColumn("delta", F.sqrt(F.col("base") / F.col("draws")) - F.sqrt(F.col("model") / F.col("draws"))), "delta")
    return _round(i, "low", "high", "share_positive")


@query(f"""{_SCORED_SQL}, k AS (SELECT game_id, sum(w) AS w, sum(w * power(y - base, 2)) AS b, sum(w * power(y - model, 2)) AS m FROM scored GROUP BY game_id){_DRAW_SQL.format(key="game_id", table="k", seed=9, times=40)}
  SELECT CAST(replicate AS INTEGER) AS replicate, round(sqrt(sum(b) / sum(w)) - sqrt(sum(m) / sum(w)), 6) AS delta FROM d JOIN p USING (place) GROUP BY replicate""")
def block_bootstrap(spark, sf):
    e = lambda c: F.sum(F.col("w") * (F.col("y") - F.col(c)) * (F.col("y") - F.col(c)))
    k = _scored(spark, sf).groupBy("game_id").agg(F.sum("w").alias("w"), e("base").alias("b"), e("model").alias("m"))
    b = metrics.bootstrap(k, "game_id", 40, 9, w=F.col("w"), b=F.col("b"), m=F.col("m"))
    return _round(b.select("replicate", (F.sqrt(F.col("b") / F.col("w")) - F.sqrt(F.col("m") / F.col("w"))).alias("delta")), "delta")


# -- fitted models (compared by invariants in the tests, not by SQL) --------------------------------


def _held_stints(spark, sf):
    """The stints, worked out once for a query that reads them several times."""
    return materialise(V.stints(spark, sf), "stints")


def _halves(spark, sf):
    sided = materialise(splits.chronological_sides(_held_stints(spark, sf)), "halves")
    return sided.where("side = 'train'").drop("side"), sided.where("side = 'test'").drop("side")


def _coefficients(fit, spark) -> DataFrame:
    return fit.table(spark).select("col", F.round("coef", 6).alias("coef"))


@query()
def ridge_fit(spark, sf):
    from . import models

    return _coefficients(models.fit_ridge(V.stints(spark, sf)), spark)


@query()
def em_fit(spark, sf):
    from . import models

    return _coefficients(models.fit_hierarchical(V.stints(spark, sf)), spark)


@query()
def pair_em_fit(spark, sf):
    from . import models

    return _coefficients(models.fit_pairs(V.stints(spark, sf), 20), spark)


@query()
def role_pair_fit(spark, sf):
    from . import models

    roles = spark.range(V.PLAYERS).select(F.col("id").alias("member"), (F.col("id") % 3).alias("role"))
    return _coefficients(models.fit_role_pairs(V.stints(spark, sf), roles, 3), spark)


@query()
def redundancy_fit(spark, sf):
    from . import models

    s = V.stints(spark, sf)
    e = contract.player_exposure(s).withColumns({"a": F.col("off_possessions") / 1000, "b": F.col("games").cast("double")}).select(F.col("player").alias("member"), "a", "b")
    return _coefficients(models.fit_redundancy(s, e, ["a", "b"]), spark)


@query()
def low_rank_interactions(spark, sf):
    from . import chemistry, models

    s = _held_stints(spark, sf)
    return models.interactions(chemistry.low_rank(models.residual_rows(s)), models.pairs_met(s))


@query()
def interaction_intervals(spark, sf):
    from . import models

    return models.bootstrap_interactions(V.stints(spark, sf))


@query()
def player_lift(spark, sf):
    from . import models

    return models.lift(V.stints(spark, sf))


@query()
def receiver_model(spark, sf):
    from . import models

    return models.evaluate_receivers(_produced(spark, sf))


@query()
def role_clusters(spark, sf):
    from . import models

    return models.kmeans(_roles(spark, sf), "player_id", ["z1", "z2", "z3"], 4)


@query()
def rung_comparison(spark, sf):
    from . import models

    s = V.stints(spark, sf)
    return models.compare_rungs(s, splits.chronological(s))


@query()
def transport_evaluation(spark, sf):
    from . import models

    return models.transport(*_halves(spark, sf))


@query()
def group_calibration(spark, sf):
    from . import models

    return models.calibrated_groups(*_halves(spark, sf))


@query()
def transaction_backtest(spark, sf):
    from . import models

    s = _held_stints(spark, sf)
    teams = s.select(F.explode("offense_player_ids").alias("p"), "season_index", "offense_team_id", "offensive_possessions").groupBy("p", "season_index", "offense_team_id").agg(F.sum("offensive_possessions").alias("n"))
    threshold = int(teams.agg(F.percentile_approx("n", 0.1)).first()[0])
    return models.backtest(s, threshold=threshold)


@query()
def lineup_prediction(spark, sf):
    from . import models

    s = V.stints(spark, sf)
    fives = s.select(S.lineup_id("offense_player_ids").alias("lineup"), F.array_sort("offense_player_ids").alias("five"), F.lit(100.0).alias("weight")).distinct()
    return models.predict_lineups(models.fit_hierarchical(s), fives)


@query()
def ridge_band(spark, sf):
    from . import models

    return models.ridge_band(*_halves(spark, sf))


def _supplier_roles(spark, sf, k):
    return V.table(spark, sf, "supplier").select((F.col("s_suppkey") % V.PLAYERS).alias("member")).distinct().withColumn("role", F.col("member") % k)


def _exposure_vectors(stints):
    """member, a, b: what a player's possessions and games say of them."""
    return contract.player_exposure(stints).select(F.col("player").alias("member"), (F.col("off_possessions") / 1000).alias("a"), F.col("games").cast("double").alias("b"))


@query()
def interaction_comparison(spark, sf):
    from . import confirmation

    s = V.stints(spark, sf)
    return confirmation.compare(*_halves(spark, sf), _supplier_roles(spark, sf, 3), 3, 20, _exposure_vectors(s))


@query()
def mechanistic_outcome(spark, sf):
    from . import models

    counts = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("stint_id")).agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("rim"), F.count(F.lit(1)).alias("attempts"))
    return models.mechanistic(*_halves(spark, sf), counts, "rim_share")


# -- further groupings and coverage ---------------------------------------------------------------


@query(f"""{_CHRONO_SQL}{PAIRS}, cand AS (SELECT a, b FROM pair GROUP BY a, b HAVING count(*) >= 3), t AS (SELECT * FROM stint JOIN split USING (stint_id) WHERE side = 'test') SELECT 'lineup' AS kind, stint_id, lineup AS "group" FROM t UNION ALL SELECT 'month', stint_id, strftime(game_date, '%Y-%m') FROM t
  UNION ALL SELECT 'pair', stint_id, a || '-' || b FROM t JOIN pair USING (stint_id) JOIN cand USING (a, b)""")
def holdout_groups(spark, sf):
    _, test = _halves(spark, sf)
    held = splits.pair_candidates(V.stints(spark, sf), 3, 1_000_000_000)
    parts = [metrics.holdout_groups(test, k, held).select(F.lit(k).alias("kind"), "stint_id", "group") for k in ("lineup", "month", "pair")]
    return parts[0].union(parts[1]).union(parts[2])


_SIDES_SQL = f"""{_CHRONO_SQL}, tr AS (SELECT * FROM stint JOIN split USING (stint_id) WHERE side = 'train'), te AS (SELECT * FROM stint JOIN split USING (stint_id) WHERE side = 'test'),
trp AS (SELECT a, b, count(*) AS n FROM (SELECT offense_player_ids AS m, unnest(offense_player_ids) AS a FROM tr) x, (SELECT unnest(range(0, 120)) AS b) y WHERE b > a AND list_contains(m, b) GROUP BY ALL),
tep AS (SELECT DISTINCT a, b FROM (SELECT offense_player_ids AS m, unnest(offense_player_ids) AS a FROM te) x, (SELECT unnest(range(0, 120)) AS b) y WHERE b > a AND list_contains(m, b)),
l AS (SELECT lineup, any_value(offense_player_ids) AS m FROM te GROUP BY lineup), lp AS (SELECT lineup, a, b FROM (SELECT lineup, m, unnest(m) AS a FROM l) x, (SELECT unnest(range(0, 120)) AS b) y WHERE b > a AND list_contains(m, b)),
nov AS (SELECT lineup, CASE WHEN lineup IN (SELECT lineup FROM tr) THEN 'seen' WHEN bool_and(trp.a IS NOT NULL) THEN 'partially_seen' ELSE 'unseen' END AS novelty, bool_and(coalesce(n, 0) >= 10) AS covered FROM lp LEFT JOIN trp ON trp.a = lp.a AND trp.b = lp.b GROUP BY lineup)"""


@query(f"""{_SIDES_SQL}, a AS (SELECT DISTINCT unnest(list_concat(offense_player_ids, defense_player_ids)) AS p FROM te), b AS (SELECT DISTINCT unnest(list_concat(offense_player_ids, defense_player_ids)) AS p FROM tr)
  SELECT (SELECT count(*) FROM a) AS players, (SELECT count(*) FROM a WHERE p NOT IN (SELECT p FROM b)) AS unseen_players, (SELECT count(*) FROM tep) AS pairs, (SELECT count(*) FROM tep JOIN trp USING (a, b) WHERE n >= 10) AS admitted_pairs,
  count(*) FILTER (novelty = 'seen') AS lineups_seen, count(*) FILTER (novelty = 'partially_seen') AS lineups_partially_seen, count(*) FILTER (novelty = 'unseen') AS lineups_unseen FROM nov""")
def transport_coverage(spark, sf):
    return splits.transport_coverage(*_halves(spark, sf), 10)


_NOVEL_SQL = _SIDES_SQL + f""", {_SCORED_SQL.split("AS side FROM stint JOIN reached USING (game_date, game_id)), ", 1)[1]}, grp AS (SELECT lineup, sum(w * y) / sum(w) AS actual, sum(w * model) / sum(w) AS point FROM scored GROUP BY lineup)"""


@query(f"{_NOVEL_SQL} SELECT novelty, count(*) AS lineups, round(sqrt(avg(power(actual - point, 2))), 6) AS rmse FROM grp JOIN nov USING (lineup) GROUP BY novelty")
def error_by_novelty(spark, sf):
    kinds = splits.novelty(*_halves(spark, sf)).select("lineup", "novelty")
    g = _groups(spark, sf).join(kinds, "lineup").groupBy("novelty").agg(F.count(F.lit(1)).alias("lineups"), metrics.rmse(F.col("actual") - F.col("point")).alias("rmse"))
    return _round(g, "rmse")


@query(f"{_NOVEL_SQL} SELECT covered, count(*) AS lineups, round(sqrt(avg(power(actual - point, 2))), 6) AS rmse FROM grp JOIN nov USING (lineup) GROUP BY covered")
def pair_coverage_breakdown(spark, sf):
    train, test = _halves(spark, sf)
    fives = test.select(S.lineup_id("offense_player_ids").alias("lineup"), F.array_sort("offense_player_ids").alias("five")).distinct()
    return _round(metrics.pair_coverage(_groups(spark, sf), fives, contract.pair_exposure(train, 10), "actual", "point"), "rmse")


@query(f"""{_SCORED_SQL} SELECT a, b, count(*) AS stints, round(sum(w * y) / sum(w), 6) AS actual, round(sum(w * model) / sum(w), 6) AS predicted FROM (SELECT y, model, w, offense_player_ids AS m, unnest(offense_player_ids) AS a FROM scored) x, (SELECT unnest(range(0, 120)) AS b) z WHERE b > a AND list_contains(m, b) GROUP BY a, b HAVING count(*) >= 5""")
def pair_level_errors(spark, sf):
    return _round(metrics.pair_errors(_scored(spark, sf), "y", "model", "w"), "actual", "predicted")


@query(f"""WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_nationkey < 12), b AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_nationkey >= 12),
  pa AS (SELECT v, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n FROM a), pb AS (SELECT v, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n FROM b),
  da AS (SELECT r AS replicate, ('0x' || substr(md5('21|' || r || '|' || place), 1, 8))::BIGINT % n AS place FROM pa, (SELECT unnest(range(0, 20)) AS r)), db AS (SELECT r AS replicate, ('0x' || substr(md5('22|' || r || '|' || place), 1, 8))::BIGINT % n AS place FROM pb, (SELECT unnest(range(0, 20)) AS r)),
  ma AS (SELECT replicate, avg(abs(v)) AS m FROM da JOIN pa USING (place) GROUP BY replicate), mb AS (SELECT replicate, avg(abs(v)) AS m FROM db JOIN pb USING (place) GROUP BY replicate)
  SELECT CAST(replicate AS INTEGER) AS replicate, round(ma.m - mb.m, 3) AS gap FROM ma JOIN mb USING (replicate)""")
def abs_gap_bootstrap(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), "c_nationkey")
    return _round(metrics.abs_gap(c.where("c_nationkey < 12"), c.where("c_nationkey >= 12"), "k", "v", 20, 21), "gap", digits=3)


@query("""WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, avg(s_acctbal) AS v FROM supplier GROUP BY 1) SELECT count(*) AS groups, round(corr(a.v, b.v), 6) AS correlation FROM a JOIN b USING (k)""")
def mediation_correlation(spark, sf):
    a = V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    b = V.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("v"))
    return _round(metrics.mediation(a, b, "k", "v"), "correlation")


@query(f"WITH {_PBP_SQL} SELECT game_id, period, sequence, coalesce(lag(points) OVER (PARTITION BY game_id, period ORDER BY sequence), 0) AS score_in FROM pbp")
def carried_scores(spark, sf):
    return ordered.carried_score(_play_by_play(spark, sf), ["game_id", "period"], ["sequence"], "points").select("game_id", "period", "sequence", "score_in")


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, CASE event_type WHEN 'view' THEN [] ELSE [event_type] END AS lineup, ts FROM events), l AS (SELECT *, first_value(lineup) OVER (PARTITION BY user_id, day ORDER BY event_id) AS f FROM e WHERE len(lineup) > 0)
  SELECT user_id, day, bool_or(lineup <> f) AS split FROM l GROUP BY user_id, day""")
def live_lineup_changes(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("lineup"))
    return ordered.live_changes(e, ["user_id", "day"], "event_id", "lineup")


@query("""WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'accepted' ELSE 'quarantined' END AS s, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'primary failed' END AS r FROM orders), s AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'accepted' ELSE 'quarantined' END AS s, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE 'second failed' END AS r FROM orders WHERE o_orderstatus <> 'P')
  SELECT k, CASE WHEN p.s = 'accepted' THEN 'primary' WHEN s.s = 'accepted' THEN 'fallback' END AS surface, CASE WHEN p.s = 'accepted' OR s.s = 'accepted' THEN 'accepted' ELSE 'quarantined' END AS status, CASE WHEN NOT (p.s = 'accepted' OR coalesce(s.s, '') = 'accepted') THEN concat_ws('; ', p.r, s.r) END AS reason FROM p LEFT JOIN s USING (k)""")
def fallback_surface(spark, sf):
    o = V.table(spark, sf, "orders")
    one = lambda df, ok, why: df.select(F.col("o_orderkey").alias("k"), F.when(ok, "accepted").otherwise("quarantined").alias("status"), F.when(~ok, why).alias("reason"))
    return reconcile.with_fallback(one(o, F.col("o_orderkey") % 3 == 0, "primary failed"), one(o.where("o_orderstatus <> 'P'"), F.col("o_custkey") % 2 == 0, "second failed"), "k")


@query(f"""SELECT {_REASON_SQL} AS reason, l_orderkey, l_quantity AS points FROM lineitem WHERE {_REASON_SQL} <> 'empty_possession'""")
def quarantine_feed(spark, sf):
    return reconcile.quarantine_feed(_line_possessions(spark, sf)).select("reason", "l_orderkey", "points")


@query(f"""{_CONTEXT_SQL}{_CELL_SQL.replace("cell AS", "pl AS")}, u AS (UNPIVOT (SELECT stint_id, {', '.join(_CONTEXT_NAMES)} FROM c) ON {', '.join(_CONTEXT_NAMES)} INTO NAME col VALUE val)
  SELECT 'c_' || u.col AS i, pl.col AS j, round(sum(pl.w * u.val * pl.val), 3) AS g FROM u JOIN pl USING (stint_id) WHERE u.val <> 0 GROUP BY ALL""")
def gram_context_cross(spark, sf):
    g = gram.gram(_context_rows(spark, sf)).where("i like 'c\\\\_%' and j not like 'c\\\\_%'")
    return _round(g, "g", digits=3)


# -- designs and further pieces of the models -------------------------------------------------------


@query(f"""{STINT} SELECT stint_id, offensive_possessions FROM stint WHERE stint_id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')""")
def subset_rows(spark, sf):
    ids = V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("stint_id"))
    return contract.subset(V.stints(spark, sf), ids).select("stint_id", "offensive_possessions")


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber - l_suppkey % 4 AS BIGINT) AS settled, l_linenumber - l_suppkey % 4 < 0 OR l_linenumber - l_suppkey % 4 > 6 AS ambiguous FROM lineitem")
def settled_scores(spark, sf):
    settled = S.settled_points(F.col("l_linenumber"), F.col("l_suppkey") % 4)
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", settled.cast("long").alias("settled"), S.ambiguous(settled).alias("ambiguous"))


@query(f"{STINT}, r AS (SELECT season, 100.0::DOUBLE * points_scored / offensive_possessions AS y, offensive_possessions::DOUBLE AS w FROM stint) SELECT season, count(*) AS n, sum(w) AS sw, round(sum(ln(w)), 4) AS slogw, round(sum(w * y * y), 1) AS q, round(var_pop(y), 4) AS var_y FROM r GROUP BY season")
def row_moments(spark, sf):
    m = gram.moments(gram.design(V.stints(spark, sf), keep=("season",)), ["season"])
    return _round(_round(m, "slogw", "var_y", digits=4), "q", digits=1)


def _produced(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")
    lines = spread(lines, lines.count(), V.LINES_EACH, "l_orderkey").join(V.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("game_date")), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(F.col("l_orderkey").alias("stint_id"), "game_date", (F.col("l_suppkey") % V.PLAYERS).alias("member")).agg(F.sum("l_quantity").alias("fg"), F.sum("l_tax").alias("ft"), F.sum("l_discount").alias("assisted"), F.count(F.lit(1)).cast("double").alias("w"))


_RECEIVER_SQL = """WITH p AS (SELECT l_orderkey AS stint_id, l_suppkey % 120 AS member, sum(l_quantity) + sum(l_tax) + 0.5::DOUBLE * sum(l_discount) AS y, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT *, count(*) OVER (PARTITION BY stint_id) AS n FROM p), r AS (SELECT * FROM m WHERE n > 1),
cell AS (SELECT stint_id, member, w, y, 'c_intercept' AS col FROM r UNION ALL SELECT stint_id, member, w, y, 'u' || member FROM r UNION ALL SELECT a.stint_id, a.member, a.w, a.y, 't' || b.member FROM r a JOIN r b ON a.stint_id = b.stint_id AND a.member <> b.member)"""


@query(f"{_RECEIVER_SQL} SELECT a.col AS i, b.col AS j, round(sum(a.w), 4) AS g FROM cell a JOIN cell b ON a.stint_id = b.stint_id AND a.member = b.member AND a.col <= b.col GROUP BY ALL")
def receiver_gram(spark, sf):
    from . import models

    return _round(gram.gram(models.receiver_design(_produced(spark, sf))), "g", digits=4)


@query(f"{_RECEIVER_SQL} SELECT col AS i, round(sum(w * y), 3) AS b FROM cell GROUP BY col")
def receiver_rhs(spark, sf):
    from . import models

    return _round(gram.rhs(models.receiver_design(_produced(spark, sf))), "b", digits=3)


_LIFT_SQL = f"""{STINT}, m AS (SELECT stint_id, offensive_possessions::DOUBLE AS w, unnest(defense_player_ids) AS p FROM stint), v AS (SELECT stint_id, w, p, (p % 7 - 3)::DOUBLE AS alpha FROM m),
t AS (SELECT *, -1.0::DOUBLE * (sum(alpha) OVER (PARTITION BY stint_id) - alpha) AS val FROM v)"""


@query(f"{_LIFT_SQL} SELECT 'l' || a.p AS i, 'l' || b.p AS j, round(sum(a.w * a.val * b.val), 3) AS g FROM t a JOIN t b ON a.stint_id = b.stint_id AND 'l' || a.p <= 'l' || b.p WHERE a.val <> 0 AND b.val <> 0 GROUP BY ALL")
def lift_gram(spark, sf):
    from . import models

    s = V.stints(spark, sf)
    alpha = s.select(F.explode("defense_player_ids").alias("member")).distinct().withColumn("alpha", (F.col("member") % 7 - 3).cast("double"))
    present = s.select("stint_id", F.lit(0.0).alias("y"), F.col("offensive_possessions").cast("double").alias("w"), F.explode("defense_player_ids").alias("member"))
    return _round(gram.gram(models.lift_rows(present, alpha, -1.0)), "g", digits=3)


@query(f"{STINT}{_CELL_SQL}, b AS (SELECT col, round(sum(w * y * val), 3) AS coef FROM cell GROUP BY col) SELECT col, coef FROM b ORDER BY abs(coef) DESC, col LIMIT 10")
def strongest_columns(spark, sf):
    from . import models

    totals = gram.rhs(gram.design(V.stints(spark, sf))).select(F.col("i").alias("col"), F.round("b", 3).alias("coef"))
    return models.strongest(totals, 10)


_OUTCOME_COLUMNS = {"points": "sum(l_linenumber)", "rim": "count(*) FILTER (l_returnflag = 'R')", "threes": "count(*) FILTER (l_returnflag = 'A')", "turnovers": "count(*) FILTER (l_linestatus = 'O')", "assisted": "count(*) FILTER (l_tax > 0.04)", "attempts": "count(*)", "made": "count(*) FILTER (l_discount > 0.02)", "possessions": "sum(l_quantity)"}


def _outcome_counts(spark, sf):
    n = lambda c: F.sum(c.cast("long"))
    return V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_linenumber").alias("points"), n(F.col("l_returnflag") == "R").alias("rim"), n(F.col("l_returnflag") == "A").alias("threes"), n(F.col("l_linestatus") == "O").alias("turnovers"), n(F.col("l_tax") > 0.04).alias("assisted"), F.count(F.lit(1)).alias("attempts"), n(F.col("l_discount") > 0.02).alias("made"), F.sum("l_quantity").alias("possessions"),
    )


@query(f"""WITH g AS (SELECT l_orderkey, {", ".join(f"{v} AS {k}" for k, v in _OUTCOME_COLUMNS.items())} FROM lineitem GROUP BY l_orderkey)
  {" UNION ALL ".join(f"SELECT '{name}' AS outcome, l_orderkey, CAST({bottom} AS DOUBLE) AS weight, round(coalesce(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0), 0), 6) AS value FROM g WHERE {bottom} >= 1" for name, (top, bottom) in profiles.OUTCOMES.items())}""")
def outcome_values(spark, sf):
    counts, out = _outcome_counts(spark, sf), None
    for name in profiles.OUTCOMES:
        one = profiles.outcome(counts, name).select(F.lit(name).alias("outcome"), "l_orderkey", "weight", "value")
        out = one if out is None else out.union(one)
    return _round(out, "value")


@query(f"""{STINT}{PAIRS}, l AS (SELECT lineup, a, b, CAST((a * 7 + b) % 11 - 5 AS DOUBLE) AS effect FROM (SELECT DISTINCT lineup, a, b FROM pair JOIN stint USING (stint_id))), s AS (SELECT lineup, sum(effect) AS effect FROM l GROUP BY lineup),
  r AS (SELECT lineup, sum(offensive_possessions)::DOUBLE AS weight FROM stint GROUP BY lineup), c AS (SELECT sum(weight * effect) / sum(weight) AS centre FROM s JOIN r USING (lineup)) SELECT lineup, round(effect - centre, 6) AS effect FROM s, c""")
def centred_lineup_effects(spark, sf):
    from . import models

    s = V.stints(spark, sf)
    effects = models.lineup_effects(s, models.pairs_met(s).withColumn("effect", ((F.col("a") * 7 + F.col("b")) % 11 - 5).cast("double")))
    reference = s.groupBy(S.lineup_id("offense_player_ids").alias("lineup")).agg(F.sum("offensive_possessions").cast("double").alias("weight"))
    return _round(models.reference_centred(effects, reference), "effect")


@query()
def ladder(spark, sf):
    from . import models

    s = _held_stints(spark, sf)
    pairs = spark.createDataFrame(splits.unseen_pairs(s, n_pairs=4, budget=0.5, cap_share=1.0), "a long, b long")
    holdouts = {"chronological": splits.chronological(s), "unseen_lineup": splits.hold_out_lineups(s, splits.unseen_lineups(s, 20)), "unseen_pair": splits.hold_out_pairs(s, pairs)}
    return models.ladder(s, holdouts)


@query()
def lift_evaluation(spark, sf):
    from . import models

    return models.evaluate_lift(*_halves(spark, sf))


_RULED_SQL = """cell AS (SELECT stint_id, 'o' || unnest(offense_player_ids) AS col, unnest(offense_player_ids) % 7 - 3 AS v, 1.0::DOUBLE AS val, offensive_possessions::DOUBLE AS w FROM stint
  UNION ALL SELECT stint_id, 'd' || unnest(defense_player_ids), unnest(defense_player_ids) % 5 - 2, -1.0, offensive_possessions FROM stint UNION ALL SELECT stint_id, 'c_intercept', 100, 1.0, offensive_possessions FROM stint)"""


@query(f"""{STINT}, {_RULED_SQL}, r AS (SELECT stint_id, sum(val * v) AS fitted FROM cell GROUP BY stint_id)
  SELECT col, round(sum(w * val * fitted), 2) AS product FROM cell JOIN r USING (stint_id) GROUP BY col""")
def gram_product(spark, sf):
    from . import tiled

    t = tiled.collect(gram.design(V.stints(spark, sf), {"intercept": F.lit(1.0)}))
    rule = {"c": lambda c: 100, "o": lambda c: int(c[1:]) % 7 - 3, "d": lambda c: int(c[1:]) % 5 - 2}
    v = np.array([[float(rule[c[0]](c))] for c in t.columns])
    found = t.product(v)[:, 0]
    t.close()
    return _round(spark.createDataFrame([(c, float(x)) for c, x in zip(t.columns, found)], "col string, product double"), "product", digits=2)


@query()
def tiled_fit(spark, sf):
    from . import models, tiled

    t = tiled.collect(models.design_rows(V.stints(spark, sf)))
    coef = tiled.ridge(t, 30.0)
    t.close()
    return spark.createDataFrame([(c, round(float(v), 6)) for c, v in zip(t.columns, coef)], "col string, coef double")


_FIVES_SQL = """roster AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT unnest(offense_player_ids) AS p FROM stint)),
  draw AS (SELECT t AS row, k, ('0x' || substr(md5('991|' || t || '|' || k), 1, 8))::BIGINT % (n - k) AS x FROM (SELECT unnest(range(0, 4000)) AS t), (SELECT unnest(range(0, 5)) AS k), (SELECT any_value(n) AS n FROM roster)),
  d AS (SELECT row, max(x) FILTER (k = 0) AS x0, max(x) FILTER (k = 1) AS x1, max(x) FILTER (k = 2) AS x2, max(x) FILTER (k = 3) AS x3, max(x) FILTER (k = 4) AS x4 FROM draw GROUP BY row),
  a1 AS (SELECT *, [x0] AS c FROM d), a2 AS (SELECT * REPLACE (list_append(c, {0}1{1}) AS c) FROM a1), a3 AS (SELECT * REPLACE (list_append(c, {0}2{1}) AS c) FROM a2), a4 AS (SELECT * REPLACE (list_append(c, {0}3{1}) AS c) FROM a3), a5 AS (SELECT * REPLACE (list_append(c, {0}4{1}) AS c) FROM a4),
  five AS (SELECT a.row, r.p FROM (SELECT row, unnest(c) AS place FROM a5) a JOIN roster r USING (place))""".format("list_reduce(list_prepend(x", ", list_sort(c)), lambda x, y: x + CASE WHEN x >= y THEN 1 ELSE 0 END)")


def _roster(stints) -> DataFrame:
    return ordered.numbered(stints.select(F.explode("offense_player_ids").alias("p")).distinct(), [F.col("p")])


@query(f"""{STINT}, {_FIVES_SQL} SELECT row, array_to_string(list_sort(list(p)), '-') AS five FROM five GROUP BY row""")
def random_fives(spark, sf):
    from . import chemistry

    roster, n = _roster(V.stints(spark, sf))
    places = chemistry.random_fives(spark, n).select("row", F.explode("five").alias("place"))
    return places.join(roster, "place").groupBy("row").agg(F.concat_ws("-", F.transform(F.array_sort(F.collect_list("p")), lambda p: p.cast("string"))).alias("five"))


def _ruled_vectors(players: list[int]):
    from . import chemistry

    p = np.array([[m % 5 - 2, m % 3 - 1] for m in players], float)
    q = np.array([[m % 7 - 3, m % 4 - 1.5] for m in players], float)
    return chemistry.centred(chemistry.Interactions(players, p, q, 2.0))


_EFFECT_SQL = "2 * (sum(p % 5 - 2) * sum(p % 7 - 3) - sum((p % 5 - 2) * (p % 7 - 3)) + sum(p % 3 - 1) * sum(p % 4 - 1.5) - sum((p % 3 - 1) * (p % 4 - 1.5)))"


@query(f"""{STINT}, {_FIVES_SQL}, f AS (SELECT {_EFFECT_SQL} AS e FROM five GROUP BY row), l AS (SELECT lineup, unnest(any_value(offense_player_ids)) AS p FROM stint GROUP BY lineup)
  SELECT lineup, round({_EFFECT_SQL} - (SELECT avg(e) FROM f), 6) AS effect FROM l GROUP BY lineup""")
def lineup_chemistry(spark, sf):
    from . import chemistry

    s = V.stints(spark, sf)
    players = [r[0] for r in _roster(s)[0].orderBy("place").select("p").collect()]  # the model's columns
    lineups = s.select(S.lineup_id("offense_player_ids").alias("lineup"), F.array_sort("offense_player_ids").alias("offense_player_ids")).distinct()
    return chemistry.effects(lineups, [_ruled_vectors(players)]).select("lineup", F.round(F.get("effects", F.lit(0)), 6).alias("effect"))


@query()
def lineup_intervals(spark, sf):
    from . import models

    train, test = _halves(spark, sf)
    lineups = test.select(S.lineup_id("offense_player_ids").alias("lineup"), F.array_sort("offense_player_ids").alias("offense_player_ids")).distinct()
    return models.lineup_intervals(train, lineups).drop("offense_player_ids")


@query()
def ensemble_groups(spark, sf):
    from . import models

    return models.ensemble_groups(*_halves(spark, sf))


@query()
def strength_choice(spark, sf):
    from . import chemistry, models

    rows = models.residual_rows(_held_stints(spark, sf)).persist()
    best, gains = chemistry.choose_strength(rows)
    rows.unpersist()
    return spark.createDataFrame([(float(v), float(g), v == best) for v, g in gains.items()], "strength double, gain double, chosen boolean")


@query()
def lineup_matchup(spark, sf):
    from . import models

    s = V.stints(spark, sf)
    top = lambda side: list(s.groupBy(side).agg(F.sum("offensive_possessions").alias("n")).orderBy(F.desc("n"), side).first()[0])
    return models.matchup(models.fit_hierarchical(s), top("offense_player_ids"), top("defense_player_ids"), spark)


@query(f"""{STINT}, m AS (SELECT season_index, count(*) AS n, sum(score_margin_offense)::DOUBLE AS m, sum(power(score_margin_offense, 2)) AS mm, sum(days_rest_offense)::DOUBLE AS r, sum(power(days_rest_offense, 2)) AS rr FROM stint GROUP BY 1),
  p AS (SELECT a.season_index, sum(b.n) AS n, sum(b.m) AS m, sum(b.mm) AS mm, sum(b.r) AS r, sum(b.rr) AS rr FROM m a JOIN m b ON b.season_index < a.season_index GROUP BY 1)
  SELECT season_index, CAST(n AS BIGINT) AS n, round(m / n, 6) AS m_margin, round(coalesce(nullif(sqrt(greatest(mm / n - power(m / n, 2), 0)), 0), 1), 6) AS s_margin, round(r / n, 6) AS m_rest, round(CASE WHEN rr / n - power(r / n, 2) > 1e-18 THEN sqrt(rr / n - power(r / n, 2)) ELSE 1 END, 6) AS s_rest FROM p""")
def season_scale(spark, sf):
    from . import models

    return _round(models.prefix_scale(models.season_moments(V.stints(spark, sf))), "m_margin", "s_margin", "m_rest", "s_rest")


@query(f"""{STINT}, t AS (SELECT stint_id, season_index, CAST(offense_team_id AS VARCHAR) AS team, unnest(offense_player_ids) AS p, offensive_possessions AS n, 100.0::DOUBLE * points_scored / offensive_possessions AS y,
    (100 + CASE WHEN home_offense THEN 1.5 ELSE 0 END + list_sum(list_transform(offense_player_ids, lambda q: q % 7 - 3)) - list_sum(list_transform(defense_player_ids, lambda q: q % 5 - 2)))::DOUBLE AS f FROM stint),
  e AS (SELECT p, season_index, team, sum(n) AS n FROM t GROUP BY ALL HAVING sum(n) >= 50), d AS (SELECT p, season_index, min(team) AS team FROM e GROUP BY ALL HAVING count(*) = 1),
  m AS (SELECT a.p, b.season_index, b.team, CASE WHEN a.team = b.team THEN 'phantom' ELSE 'real' END AS cohort FROM d a JOIN d b ON a.p = b.p AND b.season_index = a.season_index + 1)
  SELECT cohort, season_index, p AS player_id, round(sum(n * y) / sum(n) - sum(n * f) / sum(n), 6) AS delta FROM t JOIN m USING (p, season_index, team) GROUP BY ALL""")
def ruled_backtest(spark, sf):
    from . import models

    s = V.stints(spark, sf)
    rows = gram.design(s, {"intercept": F.lit(1.0), "home": F.col("home_offense").cast("int").cast("double")}, ("season_index", "offense_team_id", "offense_player_ids"))
    scored = gram.scored(rows, _ruled(s)).select("season_index", F.col("offense_team_id").cast("string").alias("to_team"), F.explode("offense_player_ids").alias("player_id"), "y", "w", "predicted")
    return _round(models.move_deltas(scored, s, 50), "delta")


@query()
def evaluation_suite(spark, sf):
    from . import suite

    s = _held_stints(spark, sf)
    held = spark.createDataFrame(splits.unseen_pairs(s, n_pairs=4, budget=0.5, cap_share=1.0), "a long, b long")
    holdouts = {"chronological": (splits.chronological(s), "month", None), "unseen_lineup": (splits.hold_out_lineups(s, splits.unseen_lineups(s, 120)), "lineup", None), "unseen_pair": (splits.hold_out_pairs(s, held), "pair", held)}
    return suite.evaluate(s, holdouts)


@query()
def pair_stability(spark, sf):
    from . import models

    s = _held_stints(spark, sf)
    return models.pair_stability([s.where("season_index % 2 = 0"), s.where("season_index % 2 = 1")])


@query()
def confirmation_sweep(spark, sf):
    from . import confirmation

    s = _held_stints(spark, sf)
    held = spark.createDataFrame(splits.unseen_pairs(s), "a long, b long")
    holdouts = {"unseen_lineup": (splits.hold_out_lineups(s, splits.unseen_lineups(s, 120)), "lineup", None), "unseen_pair": (splits.hold_out_pairs(s, held), "pair", held)}
    counts = _outcome_counts(spark, sf).withColumn("stint_id", F.col("l_orderkey").cast("string"))
    return confirmation.confirm(s, holdouts, {k: _supplier_roles(spark, sf, k) for k in (3, 5, 7)}, _exposure_vectors(s), counts, ("three_share",))[0]


_VARIANT_SQL = f"""{STINT}, n AS (SELECT CAST(l_orderkey AS VARCHAR) AS stint_id, count(*) FILTER (l_returnflag = 'A') AS threes, count(*) AS attempts FROM lineitem GROUP BY 1),
  r AS (SELECT stint_id, offense_player_ids AS o, defense_player_ids AS d, 100.0::DOUBLE * points_scored / offensive_possessions AS y, offensive_possessions::DOUBLE AS w, CASE WHEN attempts >= 3 THEN threes::DOUBLE / attempts END AS ys, CASE WHEN attempts >= 3 THEN attempts::DOUBLE END AS ws FROM stint LEFT JOIN n USING (stint_id)),
  m AS (SELECT stint_id, unnest(o) AS p FROM r), q AS (SELECT x.stint_id, x.p AS p, z.p AS q FROM m x JOIN m z ON x.stint_id = z.stint_id AND x.p < z.p),
  role AS (SELECT stint_id, 'role' AS v, p % 3 AS a, q % 3 AS b, 3 AS k FROM q WHERE p <> 11 AND q <> 11 UNION ALL SELECT stint_id, 'other', (p // 3) % 4, (q // 3) % 4, 4 FROM q),
  cell AS (SELECT stint_id, '' AS v, 'o' || unnest(o) AS col, 1.0::DOUBLE AS val FROM r UNION ALL SELECT stint_id, '', 'd' || unnest(d), -1.0 FROM r
    UNION ALL SELECT stint_id, v, 'v:' || v || '|' || CAST(least(a, b) * k - least(a, b) * (least(a, b) - 1) // 2 + greatest(a, b) - least(a, b) AS BIGINT), count(*) FROM role GROUP BY ALL
    UNION ALL SELECT stint_id, 'alike', 'v:alike|z', power(sum(p % 5 - 2), 2) - sum(power(p % 5 - 2, 2)) FROM m GROUP BY stint_id),
  pair AS (SELECT v.stint_id, v.v AS variant, v.col AS i, u.col AS j, v.val * u.val AS x FROM cell v JOIN cell u ON v.stint_id = u.stint_id AND v.col <= u.col AND (v.v = u.v OR v.v = '' OR u.v = '')),
  prod AS (SELECT stint_id, i, j, x FROM pair UNION ALL SELECT stint_id, col, '~y', val FROM cell)
  SELECT i, j, round(sum(x * w * CASE WHEN j = '~y' THEN y ELSE 1 END), 3) AS points, round(coalesce(sum(x * ws * CASE WHEN j = '~y' THEN ys ELSE 1 END), 0), 3) AS shots FROM prod JOIN r USING (stint_id) GROUP BY i, j HAVING bool_or(x <> 0)"""


@query(_VARIANT_SQL)
def variant_statistics(spark, sf):
    from . import confirmation, variants

    s, members = V.stints(spark, sf), spark.range(V.PLAYERS).select(F.col("id").alias("member"))
    counts = _outcome_counts(spark, sf).withColumn("stint_id", F.col("l_orderkey").cast("string"))
    known = [
        variants.of_roles("role", members.select("member", F.when(F.col("member") != 11, F.col("member") % 3).alias("role")), 3),
        variants.of_roles("other", members.select("member", (F.floor(F.col("member") / 3) % 4).alias("role")), 4),
        variants.Variant("alike", features=("z",), vectors={m: [float(m % 5 - 2)] for m in range(V.PLAYERS)}),
    ]
    valued = confirmation.with_outcomes(s, counts, ("three_share",), 3)
    rows = variants.add(gram.design(valued, keep=(variants.MEMBERS, "y_three_share", "w_three_share")), known)
    return shared.sums(rows, [("y", "w"), ("y_three_share", "w_three_share")]).where("i < '~'").select("i", "j", F.round("g0", 3).alias("points"), F.round("g1", 3).alias("shots"))


_FLAT = {"constant": "1.0", "copy": "CASE WHEN home_offense THEN 1.0 ELSE 0 END", "half": "0.5 * abs(score_margin_offense)", "size": "abs(score_margin_offense)::DOUBLE", "zero": "0.0"}


@query(f"""{STINT}, v AS (SELECT stint_id, 'home' AS col, CASE WHEN home_offense THEN 1.0 ELSE 0 END::DOUBLE AS x FROM stint {" ".join(f"UNION ALL SELECT stint_id, '{n}', CAST({e} AS DOUBLE) FROM stint" for n, e in _FLAT.items())}),
  f AS (SELECT col FROM v GROUP BY col HAVING max(x) = min(x)), c AS (SELECT a.col AS a, b.col AS b, corr(a.x, b.x) AS r FROM v a JOIN v b USING (stint_id) WHERE a.col < b.col AND a.col NOT IN (FROM f) AND b.col NOT IN (FROM f) GROUP BY ALL)
  SELECT 'c_' || col AS col FROM f UNION SELECT 'c_' || b FROM c WHERE abs(r) > 1 - 1e-9""")
def dropped_columns(spark, sf):
    from . import linear

    m = F.abs("score_margin_offense").cast("double")
    home = F.col("home_offense").cast("int").cast("double")
    columns = {"intercept": F.lit(1.0), "home": home, "constant": F.lit(1.0), "copy": home, "half": 0.5 * m, "size": m, "zero": F.lit(0.0)}
    rows = gram.design(V.stints(spark, sf).withColumns({c: F.array().cast("array<bigint>") for c in ("offense_player_ids", "defense_player_ids")}), columns)
    # a column that is all zero has no cell to be seen by: it is found by its absence
    s = linear.collect(rows)[None]
    gone = [c for c, x in zip(s.columns, linear.dependent(s)) if x] + [f"c_{n}" for n in columns if f"c_{n}" not in s.columns]
    return spark.createDataFrame([(c,) for c in gone], "col string")


@query()
def redundancy_evaluation(spark, sf):
    from . import confirmation

    s = V.stints(spark, sf)
    return confirmation.redundancy_effects(s, _exposure_vectors(s).where(F.col("member") < V.PLAYERS))


@query()
def mechanistic_transport(spark, sf):
    from . import models

    counts = _outcome_counts(spark, sf).withColumn("stint_id", F.col("l_orderkey").cast("string"))
    return models.mechanistic_outcomes(*_halves(spark, sf), counts)


@query()
def lineup_duel(spark, sf):
    from . import models

    s = V.stints(spark, sf)
    first, second = (list(r["offense_player_ids"]) for r in s.groupBy("offense_player_ids").agg(F.sum("offensive_possessions").alias("n")).orderBy(F.desc("n"), "offense_player_ids").limit(2).collect())
    return models.compare_lineups(models.fit_hierarchical(s), first, second, spark)


# -- selections, sums and evaluations beside the ladder --------------------------------------------


@query(f"""{STINT}, l AS (SELECT lineup, sum(offensive_possessions) AS n, sum(points_scored) AS p, count(*) AS s, count(*) FILTER (garbage_time_weight < 1) AS d FROM stint WHERE offense_team_id = 3 GROUP BY lineup)
  SELECT CAST(sum(n) AS BIGINT) AS possessions, CAST(sum(p) AS BIGINT) AS points, CAST(sum(s) AS BIGINT) AS stints, CAST(sum(d) AS BIGINT) AS downweighted, count(*) AS lineups, count(*) FILTER (n >= 20) AS listed, round(100.0::DOUBLE * sum(p) / sum(n), 6) AS rating FROM l""")
def selection_totals(spark, sf):
    return _round(contract.selection_totals(V.stints(spark, sf), 20, team=3), "rating")


@query(f"""WITH g AS (SELECT l_orderkey, min(CASE WHEN r <> 'split_lineup' THEN r END) AS reason FROM (SELECT l_orderkey, {_REASON_SQL} AS r FROM lineitem) GROUP BY l_orderkey)
  SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'quarantined' END AS status, reason, count(*) AS games FROM g GROUP BY ALL""")
def status_histogram(spark, sf):
    games = _line_possessions(spark, sf).groupBy("l_orderkey").agg(F.min(F.when(~F.col("counted"), F.col("reason"))).alias("reason"))
    return reconcile.status_histogram(games.withColumn("status", F.when(F.col("reason").isNull(), "accepted").otherwise("quarantined")))


@query(f"""WITH p AS (SELECT l_orderkey, l_suppkey % 2 AS team, l_linenumber % 4 + 1 AS period, l_linenumber AS raw, l_suppkey % 4 AS technical, {_REASON_SQL} AS r FROM lineitem), c AS (SELECT * FROM p WHERE r IS NULL OR r = 'split_lineup')
  SELECT l_orderkey, team, period, CAST(sum(raw - technical) AS BIGINT) AS points FROM c GROUP BY ALL UNION ALL SELECT l_orderkey, team, NULL, CAST(sum(raw) AS BIGINT) FROM c GROUP BY ALL""")
def score_sums(spark, sf):
    return reconcile.score_sums(_line_possessions(spark, sf), ["l_orderkey", "team"], "period")


def _ruled(s: DataFrame) -> DataFrame:
    """Coefficients of a fixed rule for the players that the stints hold, the intercept and the home side."""
    side = lambda ids, tag, m, shift: s.select(F.explode(ids).alias("p")).distinct().select(F.concat(F.lit(tag), F.col("p").cast("string")).alias("col"), (F.col("p") % m - shift).cast("double").alias("coef"))
    fixed = s.sparkSession.createDataFrame([("c_intercept", 100.0), ("c_home", 1.5)], "col string, coef double")
    return side("offense_player_ids", "o", 7, 3).union(side("defense_player_ids", "d", 5, 2)).union(fixed)


@query(f"""{STINT}, t AS (SELECT stint_id, offensive_possessions::DOUBLE AS w, 100.0::DOUBLE * points_scored / offensive_possessions AS y, CASE WHEN home_offense THEN 1.5 ELSE 0 END::DOUBLE AS context,
    (100 + list_sum(list_transform(offense_player_ids, lambda p: p % 7 - 3)) - list_sum(list_transform(defense_player_ids, lambda p: p % 5 - 2)))::DOUBLE AS talent FROM stint)
  SELECT stint_id, round(y, 6) AS y, w, talent, context, talent + context AS predicted, round(y - talent - context, 6) AS residual FROM t""")
def decomposition(spark, sf):
    from . import evaluation

    s = V.stints(spark, sf)
    rows = gram.design(s, {"intercept": F.lit(1.0), "home": F.col("home_offense").cast("int").cast("double")})
    return _round(evaluation.decomposed(rows, _ruled(s)), "y", "residual")


@query(f"""{STINT}{PAIRS}, o AS (SELECT p, 100.0::DOUBLE * sum(pts) / sum(n) AS estimate, sum(n) AS n FROM (SELECT unnest(offense_player_ids) AS p, points_scored AS pts, offensive_possessions AS n FROM stint) GROUP BY p),
  d AS (SELECT p, -100.0::DOUBLE * sum(pts) / sum(n) AS estimate FROM (SELECT unnest(defense_player_ids) AS p, points_scored AS pts, offensive_possessions AS n FROM stint) GROUP BY p),
  s AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS at FROM o WHERE n >= 400), q AS (SELECT a, b, 100.0::DOUBLE * sum(points_scored) / sum(stint.offensive_possessions) AS estimate FROM pair JOIN stint USING (stint_id) GROUP BY a, b),
  c AS (SELECT (q.a * 5 + q.b * 3) % 13 - 6 AS truth, estimate FROM q JOIN s x ON x.p = q.a JOIN s y ON y.p = q.b WHERE x.at < y.at AND (7 * x.at + y.at) % 11 = 0)
  SELECT (SELECT round(corr(p % 7 - 3, estimate), 6) FROM o) AS offense_correlation, (SELECT round(corr(p % 5 - 2, estimate), 6) FROM d) AS defense_correlation, (SELECT count(*) FROM s) AS supported,
    (SELECT count(*) FROM c) AS pairs, (SELECT CASE WHEN count(*) >= 8 THEN round(coalesce(corr(truth, estimate), 0), 6) END FROM c) AS pair_correlation""")
def effect_recovery(spark, sf):
    from . import evaluation

    s = V.stints(spark, sf)
    rating = 100.0 * F.sum("points_scored") / F.sum("offensive_possessions")
    by = lambda ids: s.select(F.explode(ids).alias("member"), "points_scored", "offensive_possessions").groupBy("member").agg(rating.alias("rating"), F.sum("offensive_possessions").alias("possessions"))
    o, d = by("offense_player_ids"), by("defense_player_ids")
    talent = o.select(F.lit("offense").alias("side"), "member", (F.col("member") % 7 - 3).cast("double").alias("truth"), F.col("rating").alias("estimate"))
    talent = talent.union(d.select(F.lit("defense"), "member", (F.col("member") % 5 - 2).cast("double"), -F.col("rating")))
    pairs = s.select(F.explode(S.pairs_of("offense_player_ids")).alias("x"), "points_scored", "offensive_possessions").groupBy("x.a", "x.b").agg(rating.alias("estimate"))
    return _round(evaluation.recovery(talent, pairs.withColumn("truth", ((F.col("a") * 5 + F.col("b") * 3) % 13 - 6).cast("double")), o), "offense_correlation", "defense_correlation", "pair_correlation")


@query()
def unseen_examples(spark, sf):
    from . import evaluation

    return evaluation.unseen_examples(*_halves(spark, sf), _ruled(V.stints(spark, sf)))


@query()
def production_evaluation(spark, sf):
    from . import evaluation

    return evaluation.evaluate_production(_produced(spark, sf))


@query()
def outcome_transport(spark, sf):
    from . import evaluation

    counts = _outcome_counts(spark, sf).withColumn("stint_id", F.col("l_orderkey").cast("string"))
    roles = V.table(spark, sf, "supplier").select((F.col("s_suppkey") % V.PLAYERS).alias("member")).distinct().withColumn("role", F.col("member") % 3)
    return evaluation.transport_outcome(*_halves(spark, sf), counts, roles, 3)
