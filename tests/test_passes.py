"""Work that must not be done again and again: passes over the rows, groupings, sums given by tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import gram, profiles, shared, splits
from cadence.plans import evaluation, linear, models
from cadence.sources import held
from cadence.sources import views as V


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _counted(monkeypatch):
    calls, plain = [], linear.collect_many
    monkeypatch.setattr(linear, "collect_many", lambda *a, **k: calls.append(1) or plain(*a, **k))
    return calls


def test_all_outcomes_come_from_one_pass(spark, sf, monkeypatch):
    from cadence.plans.catalogue import _halves, _outcome_counts

    calls = _counted(monkeypatch)
    counts = _outcome_counts(spark, sf).withColumn("stint_id", F.col("l_orderkey").cast("string"))
    halves = _halves(spark, sf)
    found = models.mechanistic_outcomes(*halves, counts)
    assert found.count() == len(profiles.OUTCOMES) and len(calls) == 1
    roles = spark.createDataFrame([(m, m % 3) for m in range(V.PLAYERS)], "member long, role int")
    assert evaluation.transport_outcome(*halves, counts, roles, 3, minimum=1, least=1, replicates=20).count() == 3
    assert len(calls) == 2


def test_receivers_and_role_pairs_are_grouped_once(spark):
    made = spark.createDataFrame([(1, "2020-01-01", m, 1.0, 0.0, 0.0, 1.0) for m in (1, 2, 3)] + [(2, "2020-01-01", 4, 1.0, 0.0, 0.0, 1.0)], "stint_id long, game_date string, member long, fg double, ft double, assisted double, w double")
    rows = models.receiver_design(made)
    assert "Join" not in _plan(rows)
    assert sorted((r.receiver, sorted(c.col for c in r.cells)) for r in rows.collect()) == [(1, ["c_intercept", "t2", "t3", "u1"]), (2, ["c_intercept", "t1", "t3", "u2"]), (3, ["c_intercept", "t1", "t2", "u3"])]
    roles = spark.createDataFrame([(1, m, m % 2) for m in range(4)] + [(1, 9, None)], "row long, member long, role int")
    bins = profiles.role_pairs(roles, 2)
    assert _plan(bins).count("Exchange") == 1
    assert sorted(tuple(r) for r in bins.collect()) == [(1, 0, 1), (1, 1, 4), (1, 2, 1)]


def test_lift_cells_are_those_of_lift_rows(spark):
    alpha = spark.createDataFrame([(1, 0.5), (2, -1.0), (3, 2.0)], "member long, alpha double")
    lists = spark.createDataFrame([("a", [1, 2, 3, 4], 1.0, 2.0), ("b", [4, 5], 0.0, 1.0)], "stint_id string, five array<long>, y double, w double")
    cells = lambda df: {(r.stint_id, c.col): c.val for r in df.collect() for c in r.cells}
    plain = models.lift_rows(lists.select("stint_id", "y", "w", F.explode("five").alias("member")), alpha, -1.0)
    assert cells(models.lift_cells(lists, "five", alpha, -1.0)) == cells(plain)


def test_a_task_gives_a_sum_once(spark):
    held = shared._Held(1, 1000)
    one = ([None], ["a", "b", "~y"], np.array([0, 0]), np.array([0, 0]), np.array([0, 1]), [np.array([1.0, 2.0])])
    for _ in range(600):
        held.add(*one)
    keys, labels, key, i, j, (g,) = held.take()
    assert [(labels[x], labels[y], v) for x, y, v in zip(i, j, g)] == [("a", "a", 600.0), ("a", "b", 1200.0)] and held.take() is None


def test_a_side_comes_with_its_game(spark, sf):
    stints = V.stints(spark, sf)
    sided = splits.chronological_sides(stints)
    assert sided.columns == [*stints.columns, "side"]
    assert sorted(map(tuple, sided.select("stint_id", "side").collect())) == sorted(map(tuple, stints.join(splits.chronological(stints), "stint_id").select("stint_id", "side").collect()))


def test_partitions_follow_the_rows_where_the_session_has_too_few(spark, sf, monkeypatch):
    df = spark.range(1000)
    assert held.spread(df, 1000, 100, "id").rdd.getNumPartitions() == 10
    assert held.spread(df, 1000, 1000, "id") is df  # the session's partitions do
    before = {tuple(map(str, r)) for r in V.stints(spark, sf).collect()}
    monkeypatch.setattr(V, "STINTS_EACH", 200)
    many = V.stints(spark, sf)
    assert "REPARTITION_BY_NUM" in _plan(many) and {tuple(map(str, r)) for r in many.collect()} == before


def test_both_sides_of_the_stints_join_are_dealt_by_rows(spark, sf, monkeypatch):
    before = {tuple(map(str, r)) for r in V.stints(spark, sf).collect()}
    monkeypatch.setattr(V, "STINTS_EACH", 200)
    n = -(-V.table(spark, sf, "orders").count() // 200)
    large = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where orders are too many to broadcast
    try:
        many = V.stints(spark, sf)
        assert n > 4 and many.rdd.getNumPartitions() == n and {tuple(map(str, r)) for r in many.collect()} == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", large)


def test_backtest_gives_no_stint_to_python_and_equals_predicting_each(spark, monkeypatch):
    stints, _ = models.synthetic(spark, players=24, stints=1200, truth_sd=4.0)
    season = (F.expr("cast(substring(game_id, 2) as int)") % 200 / 50).cast("int")
    stints = stints.withColumns({"season_index": season, "season": (season + 2020).cast("string"), "offense_team_id": F.element_at("offense_player_ids", 1) % 3}).cache()
    fits, rows, seasons = models.prefix_fits(stints)
    # the same statistics as one pass over the design's cells, and each stint's own prediction
    parts = linear.fetched(gram.season_sums(*gram.season_parts(stints, models._unscaled_context(seasons))), ["y"], "season_index")["y"]
    for season, s in linear.collect(rows, "season_index").items():
        own = parts[season]
        assert own.columns == s.columns and own.n == s.n
        assert np.allclose(own.g, s.g, rtol=1e-9) and np.allclose(own.b, s.b, rtol=1e-9)
        assert [own.q, own.var_y, own.slogw, own.sw, own.swy] == pytest.approx([s.q, s.var_y, s.slogw, s.sw, s.swy])
    one = None
    for season, fit in fits.items():
        scored = gram.scored(rows.where(F.col("season_index") == season), fit.table(spark))
        one = scored if one is None else one.union(scored)
    one = one.select("season_index", F.col("offense_team_id").cast("string").alias("to_team"), F.explode("offense_player_ids").alias("player_id"), "y", "w", "predicted")
    each = {tuple(r)[:3]: r.delta for r in models.move_deltas(one, stints, 50).collect()}
    monkeypatch.setattr(shared, "sums", None)  # no design's cells are made
    monkeypatch.setattr(gram, "scored", None)
    found = models.backtest(stints, threshold=50)
    assert "InArrow" not in _plan(found)
    deltas = {tuple(r)[:3]: r.delta for r in found.collect()}
    assert each and deltas.keys() == each.keys() and max(abs(deltas[k] - each[k]) for k in each) < 1e-9


def test_a_player_who_stands_twice_counts_twice(spark):
    rows = [(0, 1, [1, 1, 2], [7, 8], 10, 12, True, 3, 1, False, 1, 1.0), (0, 2, [1, 3], [7, 7], 20, 18, False, -2, 4, True, 0, 0.2), (1, 1, [2, 3], [8], 5, 5, True, 0, 2, False, 2, 1.0)]
    names = "season_index int, offense_team_id int, offense_player_ids array<int>, defense_player_ids array<int>, offensive_possessions int, points_scored int, " + "home_offense boolean, score_margin_offense int, period int, playoff boolean, days_rest_offense int, garbage_time_weight double"
    stints = spark.createDataFrame(rows, names).withColumn("stint_id", F.col("offensive_possessions").cast("string"))
    context = models._unscaled_context([0, 1])
    contexts, members, pairs = gram.season_parts(stints, context)
    own = linear.fetched(gram.season_sums(contexts, members, pairs), ["y"], "season_index")["y"]
    design = gram.design(stints, context, ("season_index", "offense_team_id", "offense_player_ids"))
    plain = linear.collect(design, "season_index")
    assert own.keys() == plain.keys() and all(own[k].columns == plain[k].columns and np.allclose(own[k].g, plain[k].g) and np.allclose(own[k].b, plain[k].b) for k in plain)
    coef = {c: 0.5 * n - 3 for n, c in enumerate(own[0].columns)}
    got = gram.member_scores(members, pairs, spark.createDataFrame([(0, c, v) for c, v in coef.items()], "season_index int, col string, coef double"))
    scored = gram.scored(design.where("season_index = 0"), spark.createDataFrame(list(coef.items()), "col string, coef double"))
    want = scored.select("offense_team_id", F.explode("offense_player_ids").alias("p"), "y", "w", "predicted").groupBy("offense_team_id", "p").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"), (F.sum(F.col("w") * F.col("predicted")) / F.sum("w")).alias("f"))
    a = {(int(r.team), r.player): (r.w, r.y, r.predicted) for r in got.collect()}
    b = {(r.offense_team_id, r.p): (r.w, r.y, r.f) for r in want.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in b)
