"""Models by invariants: planted effects come back, likelihoods don't fall, sums agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import gram, splits
from cadence.plans import chemistry, evaluation, linear, models


@pytest.fixture(scope="module")
def league(spark):
    stints, truth = models.synthetic(spark, players=24, stints=1500, truth_sd=4.0)
    return stints.cache(), {r.member: r.effect for r in truth.collect()}


def test_planted_effects_are_recovered(league):
    stints, truth = league
    for fit in (models.fit_ridge(stints), models.fit_hierarchical(stints)):
        found = {int(c[1:]): v for c, v in zip(fit.columns, fit.coef) if c[0] == "o"}
        pairs = [(truth[m], v) for m, v in found.items()]
        assert np.corrcoef(*zip(*pairs))[0, 1] > 0.9


def test_likelihood_does_not_fall(league):
    log = models.fit_hierarchical(league[0]).log_likelihoods
    assert len(log) > 2 and (np.diff(log) > -1e-6 * abs(log[-1])).all()


def test_residual_sum_from_statistics(league):
    rows = models.design_rows(league[0])
    s = linear.collect(rows)[None]
    coef = linear.ridge(s, 10.0)
    table = league[0].sparkSession.createDataFrame([(c, float(v)) for c, v in zip(s.columns, coef)], "col string, coef double")
    direct = rows.join(gram.predict(rows, table), "stint_id").agg(F.sum(F.col("w") * (F.col("y") - F.col("predicted")) ** 2)).first()[0]
    assert abs(s.residual(coef) / direct - 1) < 1e-8


def test_folds_add_up(league):
    from cadence.operators import ordered

    rows = models.design_rows(league[0])
    whole = linear.collect(rows)[None]
    parts = linear.collect(rows.join(ordered.folds(league[0], "game_id", 3).select("stint_id", "fold"), "stint_id"), "fold")
    added = linear.total(list(parts.values()))
    assert np.allclose(added.g, whole.g) and np.allclose(added.b, whole.b) and added.n == whole.n


def test_ladder_and_calibration(league):
    stints = league[0]
    found = {r.rung: r for r in models.compare_rungs(stints, splits.chronological(stints)).collect()}
    assert found["2_ridge"].micro_rmse < found["0_context"].micro_rmse and found["3_hierarchical"].micro_rmse < found["0_context"].micro_rmse
    sided = stints.join(splits.chronological(stints), "stint_id")
    report = models.calibrated_groups(sided.where("side = 'train'").drop("side"), sided.where("side = 'test'").drop("side")).first()
    assert 0.8 < report.coverage_95 <= 1 and 0.6 < report.z_sd < 1.5


def test_kmeans_finds_planted_clusters(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(c[0] + rng.normal(0, 0.1)), float(c[1] + rng.normal(0, 0.1))) for i, c in enumerate([(0, 0), (5, 0), (9, 9)] * 20)]
    found = {r.k: r.cluster for r in models.kmeans(spark.createDataFrame(data, "k long, x double, y double"), "k", ["x", "y"], 3).collect()}
    assert all(found[i] == i % 3 for i in range(60))
    with pytest.raises(ValueError):
        models.kmeans(spark.createDataFrame(data[:2], "k long, x double, y double"), "k", ["x", "y"], 3)


def test_same_input_same_output(league):
    stints = league[0].limit(300).cache()
    a, b = (chemistry.low_rank(models.residual_rows(stints)) for _ in range(2))
    assert a.players == b.players and np.allclose(a.p, b.p) and np.allclose(a.q, b.q)


def test_too_few_rows_are_refused(league):
    stints = league[0].limit(20)
    with pytest.raises(ValueError):
        models.compare_rungs(stints, splits.chronological(stints))


def test_low_rank_by_rows_is_that_by_pairs(league):
    rows = models.residual_rows(league[0].limit(300)).cache()
    a, b = (chemistry.low_rank(rows, sweeps=3, max_pairs=n) for n in (10_000, 1))
    assert a.players == b.players and np.allclose(a.p, b.p, atol=1e-8) and np.allclose(a.q, b.q, atol=1e-8)
    plan = chemistry.member_cells(rows.select("offense_player_ids", "e", "w"), a.players, a.q)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0]  # a half-step shuffles its sums alone


def test_lift_changes_sign_with_the_side(spark):
    present = spark.createDataFrame([("s", m, 1.0, 2.0) for m in (1, 2, 3)], "stint_id string, member long, y double, w double")
    alpha = spark.createDataFrame([(1, 1.0), (2, 4.0)], "member long, alpha double")
    for sign in (1.0, -1.0):
        found = {c["col"]: c["val"] for c in models.lift_rows(present, alpha, sign).first()["cells"]}
        assert found == {"l1": sign * 4.0, "l2": sign * 1.0, "l3": sign * 5.0}


def test_evaluators_on_planted_effects(league):
    stints = league[0].cache()
    spark = stints.sparkSession
    sided = stints.join(splits.chronological(stints), "stint_id")
    train, test = sided.where("side = 'train'").drop("side").cache(), sided.where("side = 'test'").drop("side").cache()
    found = models.ladder(stints, {"chronological": splits.chronological(stints)}, replicates=20).collect()
    rungs = {r.rung: r for r in found}
    assert set(rungs) == set(models.RUNGS) and rungs["2_ridge"].low == rungs["2_ridge"].high == 0
    assert rungs["0_context"].high < 0  # worse than the ridge, whatever the draw
    band = models.ridge_band(train, test, replicates=5).collect()
    assert len(band) == test.select("offense_player_ids").distinct().count() and all(r.sd > 0 for r in band)
    lifted = {r.model: r.macro_rmse for r in models.evaluate_lift(train, test).collect()}
    assert set(lifted) == {"base", "lift", "lift_placebo"}
    sweep = models.pair_stability([train, test], (25.0,)).collect()
    assert len(sweep) == 1 and sweep[0].groups > 0 and -1 <= sweep[0].correlation <= 1
    fit = models.fit_hierarchical(stints)
    best = sorted(range(12), key=lambda m: league[1][m])
    duel = models.compare_lineups(fit, best[-5:], best[:5], spark).first()
    assert duel.difference > 0 and duel.p_first > 0.8
    game = models.matchup(fit, best[:5], list(range(12, 17)), spark).first()
    assert abs(game.context + game.offense + game.defense - game.mean) < 1e-9
    assert game.low_95 < game.low_80 < game.mean < game.high_80 < game.high_95 and (game.known_offense, game.known_defense) == (5, 5)
    stranger = models.matchup(fit, [*best[:4], 999], list(range(12, 17)), spark).first()
    assert stranger.known_offense == 4
    with pytest.raises(ValueError):
        models.matchup(fit, best[:5], best[:5], spark)


def test_places_follow_the_order(spark):
    from cadence.operators import metrics, ordered

    keys = [(f"k{(i * 37) % 1000:04d}",) for i in range(1000)]
    found, n = ordered.numbered(spark.createDataFrame(keys, "k string").repartition(7), [F.col("k")], parts=8)
    assert n == 1000 and [r.place for r in found.orderBy("k").collect()] == list(range(1000))
    few = metrics.bootstrap(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), "k", 10, 1, v=F.col("v"))
    assert tuple(metrics.interval(few, "v").first()) == (0.0, 0.0, 0.0)


def test_a_fit_of_the_size_of_a_league(spark):
    """300 players and 15,000 stints: the additive and hierarchical fits and group predictions."""
    import time

    stints, truth = models.synthetic(spark, players=330, stints=15_500, truth_sd=3.0)
    stints = stints.cache()
    stints.count()
    start = time.time()
    fit = models.fit_hierarchical(stints)
    assert time.time() - start < 60
    effects = {r.member: r.effect for r in truth.collect()}
    found = [(effects[int(c[1:])], v) for c, v in zip(fit.columns, fit.coef) if c[0] == "o"]
    assert len(found) > 150 and np.corrcoef(*zip(*found))[0, 1] > 0.6
    stints.unpersist()


def test_decomposition_adds_up_and_recovers_the_truth(league):
    stints, truth = league
    spark = stints.sparkSession
    fit = models.fit_hierarchical(stints).table(spark)
    rows = models.design_rows(stints)
    found = evaluation.decomposed(rows, fit).join(gram.predict(rows, fit).withColumnRenamed("predicted", "whole"), "stint_id")
    worst = found.agg(F.max(F.abs(F.col("talent") + F.col("context") - F.col("whole"))), F.max(F.abs(F.col("y") - F.col("whole") - F.col("residual")))).first()
    assert max(worst) < 1e-9
    known = spark.createDataFrame(list(truth.items()), "member long, truth double")
    side = lambda tag, name: fit.where(F.col("col").startswith(tag) & ~F.col("col").startswith("c_")).select(F.lit(name).alias("side"), F.expr("cast(substring(col, 2) as bigint)").alias("member"), F.col("coef").alias("estimate")).join(known, "member").select("side", "member", "truth", "estimate")
    pairs = spark.createDataFrame([(0, 11, 1.0, 2.0)], "a long, b long, truth double, estimate double")
    exposure = known.select("member", F.lit(1000).alias("possessions"))
    got = evaluation.recovery(side("o", "offense").union(side("d", "defense")), pairs, exposure).first()
    assert got.offense_correlation > 0.9 and got.defense_correlation > 0.9 and got.supported == len(truth)
    assert got.pairs == 1 and got.pair_correlation is None  # too few pairs say nothing


def test_unseen_examples_are_unseen(league):
    stints = league[0]
    sided = stints.join(splits.chronological(stints), "stint_id")
    train, test = sided.where("side = 'train'").drop("side"), sided.where("side = 'test'").drop("side")
    found = evaluation.unseen_examples(train, test, models.fit_ridge(train).table(stints.sparkSession), 4).collect()
    seen = {tuple(sorted(r[0])) for r in train.select("offense_player_ids").collect()}
    assert len(found) == 4 and all(tuple(map(int, r.lineup.split("-"))) not in seen for r in found)
    assert all(abs(r.talent + r.context - r.predicted) < 1e-9 for r in found)


def test_planted_lift_beats_its_placebo(spark):
    rng = np.random.default_rng(5)
    gift = {m: float(v) for m, v in enumerate(np.linspace(-3, 3, 12))}
    rows = []
    for s in range(900):
        five = [int(m) for m in rng.choice(12, 5, replace=False)]
        for m in five:
            made = 10 + m + sum(gift[x] for x in five if x != m) + rng.normal(0, 1)
            rows.append((f"s{s}", f"2020-{1 + s // 75:02d}-01", m, made, 0.0, 0.0, 1.0))
    production = spark.createDataFrame(rows, "stint_id string, game_date string, member long, fg double, ft double, assisted double, w double").withColumn("game_date", F.to_date("game_date"))
    _, lift = evaluation.production_lift(production)
    found = {int(r.col[1:]): r.coef for r in lift.collect()}
    assert np.corrcoef([gift[m] for m in found], list(found.values()))[0, 1] > 0.95
    errors = {r.model: r.micro_rmse for r in evaluation.evaluate_production(production).collect()}
    assert errors["lift"] < 0.6 * errors["base"] and errors["lift_placebo"] > errors["lift"]


def test_dependent_columns_change_no_prediction(league):
    stints = league[0]
    rows = models.design_rows(stints)
    cell = lambda name, v: F.struct(F.lit(f"c_{name}").alias("col"), v.alias("val"))
    home = F.filter("cells", lambda c: c["col"] == "c_home")[0]["val"]
    more = rows.withColumn("cells", F.concat("cells", F.array(cell("constant", F.lit(4.0)), cell("copy", home), cell("mixed", 2 * home - 3.0), cell("dead", F.lit(0.0)))))
    one, two = (linear.collect(r)[None] for r in (rows, more))
    gone = {c for c, x in zip(two.columns, linear.dependent(two)) if x}
    assert {"c_constant", "c_mixed"} <= gone and gone & {"c_copy", "c_home"} and "c_intercept" not in gone
    for fit in (lambda s: linear.ridge(s, 10.0), lambda s: linear.expectation_maximisation(s, models.PLAYERS)):
        found = []
        for s, r in ((one, rows), (two, more)):
            f = fit(s)
            names, coef = (s.columns, f) if isinstance(f, np.ndarray) else (f.columns, f.coef)
            table = stints.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(names, coef)], "col string, coef double")
            found.append({x.stint_id: x.predicted for x in gram.predict(r, table).collect()})
        assert max(abs(found[0][k] - found[1][k]) for k in found[0]) < 1e-4


def test_a_column_dead_in_train_adds_nothing_in_test(league):
    stints = league[0]
    train, test = stints.where("days_rest_offense = 1"), stints.where("days_rest_offense = 2")
    fit = models.fit_hierarchical(train)
    assert "c_rest" not in fit.columns or fit.coef[fit.columns.index("c_rest")] == 0
    moved = test.withColumn("days_rest_offense", F.lit(40))
    of = lambda t: {r.stint_id: r.predicted for r in gram.scored(models.design_rows(t, train), fit.table(stints.sparkSession)).collect()}
    assert of(test) == of(moved)


def test_prefix_fits_equal_a_fit_for_each_cutover(spark):
    stints, _ = models.synthetic(spark, players=24, stints=1200, truth_sd=4.0)
    season = (F.expr("cast(substring(game_id, 2) as int)") % 200 / 50).cast("int")
    stints = stints.withColumns({"season_index": season, "season": (season + 2020).cast("string"), "offense_team_id": F.element_at("offense_player_ids", 1) % 3}).cache()
    fits, rows, seasons = models.prefix_fits(stints)
    assert seasons == [0, 1, 2, 3] and list(fits) == [1, 2, 3]
    for cut, fit in fits.items():
        train, after = stints.where(F.col("season_index") < cut), stints.where(F.col("season_index") == cut)
        own = models.fit_hierarchical(train)
        a = {r.stint_id: r.predicted for r in gram.scored(rows.where(F.col("season_index") == cut), fit.table(spark)).collect()}
        b = {r.stint_id: r.predicted for r in gram.scored(models.design_rows(after, train), own.table(spark)).collect()}
        assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-3
        assert fit.sigma2 == pytest.approx(own.sigma2, rel=1e-4)
    found = models.backtest(stints, threshold=50).collect()
    assert found and {r.cohort for r in found} <= {"real", "phantom"} and {r.season_index for r in found} <= {1, 2, 3}
    r = found[0]
    theirs = stints.where((F.col("season_index") == r.season_index) & F.array_contains("offense_player_ids", F.lit(r.player_id)))
    assert theirs.count() > 0 and np.isfinite(r.delta)
    with pytest.raises(ValueError):
        models.backtest(stints.where("season_index = 0"))
    with pytest.raises(ValueError):
        models.backtest(stints, min_rows=10**6)
