"""Low-rank pair effects: ensembles from one pass, strength, random fives, intervals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.plans import chemistry, linear, models


def made(spark, effect: float, n: int = 2500, players: int = 14):
    """Residual rows of lineups, a pair effect of planted vectors and noise."""
    r = np.random.default_rng(8)
    p, q = r.normal(size=(players, 1)), r.normal(size=(players, 1))
    data = []
    for s in range(n):
        five = [int(x) for x in r.choice(players, 5, replace=False)]
        e = effect * sum(p[a, 0] * q[b, 0] for a in five for b in five if a != b) + r.normal(0, 6)
        data.append((f"s{s}", f"g{s % 60:03d}", five, float(e), float(r.integers(5, 40))))
    return spark.createDataFrame(data, "stint_id string, game_id string, offense_player_ids array<long>, e double, w double"), p, q


@pytest.fixture(scope="module")
def planted(spark):
    rows, p, q = made(spark, 2.0)
    return rows.cache(), p, q


def test_a_planted_effect_picks_a_small_penalty_and_noise_the_largest(spark, planted):
    best, gains = chemistry.choose_strength(planted[0])
    assert best == min(chemistry.STRENGTHS) and gains[best] > 0
    noise, _, _ = made(spark, 0.0, 900)
    best, gains = chemistry.choose_strength(noise.cache())
    assert best == max(chemistry.STRENGTHS)


def test_strength_by_rows_is_that_by_pairs(planted):
    few = planted[0].limit(200).cache()
    one, two = (chemistry.choose_strength(few, grid=(25.0, 70.0), folds=2, sweeps=2, max_pairs=n) for n in (10_000, 1))
    assert one[0] == two[0] and one[1] == pytest.approx(two[1], abs=1e-6)


def test_vectors_recover_the_planted_effects(planted):
    rows, p, q = planted
    m = chemistry.low_rank(rows, rank=1, strength=8.0)
    want = 2.0 * (p @ q.T + q @ p.T)
    got = m.scale * (m.p @ m.q.T + m.q @ m.p.T)
    off = ~np.eye(len(p), dtype=bool)
    assert np.corrcoef(want[off], got[off])[0, 1] > 0.9


def test_an_ensemble_from_one_pass_equals_fits_of_each_weight(planted):
    rows = planted[0]
    fits = chemistry.ensemble(rows, members=3, seed=5)
    for r, m in enumerate(fits[1:]):
        alone = chemistry.low_rank(rows.withColumn("w", F.col("w") * chemistry.times(5, r)).where("w > 0"))
        assert np.allclose(m.p @ m.q.T, alone.p @ alone.q.T, atol=1e-6) and m.scale == pytest.approx(alone.scale)
    assert not np.allclose(fits[1].p, fits[2].p)


def test_effects_within_the_row_are_sums_over_pairs(spark, planted):
    m = chemistry.centred(chemistry.low_rank(planted[0], sweeps=3))
    found = chemistry.effects(spark.createDataFrame([([3, 1, 7, 9, 2],), ([3, 1, 7, 9, 99],), ([],)], "offense_player_ids array<long>"), [m, m]).collect()
    five = [3, 1, 7, 9, 2]
    want = m.scale * sum(float(m.p[a] @ m.q[b]) for a in five for b in five if a != b) - m.centre
    assert found[0].effects == pytest.approx([want, want]) and found[0].known
    assert not found[1].known and found[1].effects == [0.0, 0.0] and not found[2].known


def test_random_fives_are_different_even_and_zero_sum(spark, planted):
    got = [r.five for r in chemistry.random_fives(spark, 14).orderBy("row").collect()]
    assert len(got) == 4000 and all(len(set(f)) == 5 and min(f) >= 0 and max(f) < 14 for f in got)
    assert (np.array(got) == chemistry._fives(14, 4000, chemistry.REFERENCE_SEED)).all()
    seats = np.bincount(np.array(got).ravel(), minlength=14)
    assert (abs(seats - 4000 * 5 / 14) < 5 * np.sqrt(4000 * 5 / 14)).all()
    m = chemistry.centred(chemistry.low_rank(planted[0], sweeps=2))
    fives = spark.createDataFrame([([m.players[k] for k in f],) for f in got], "offense_player_ids array<long>")
    assert abs(chemistry.effects(fives, [m]).agg(F.avg(F.get("effects", F.lit(0)))).first()[0]) < 1e-9
    with pytest.raises(ValueError):
        chemistry.random_fives(spark, 4)


def test_intervals_lie_about_the_point_and_strangers_have_none(spark, planted):
    fits = chemistry.ensemble(planted[0], members=5)
    lineups = spark.createDataFrame([("known", [0, 1, 2, 3, 4]), ("stranger", [0, 1, 2, 3, 77])], "lineup string, offense_player_ids array<long>")
    found = {r.lineup: r for r in chemistry.intervals(lineups, fits).collect()}
    k, s = found["known"], found["stranger"]
    raw = np.array([m.raw(np.array([[0, 1, 2, 3, 4]]))[0] - m.centre for m in fits])
    moved = raw[1:] - raw[1:].mean() + raw[0]
    assert (k.point, k.low, k.high, k.p_positive) == pytest.approx((raw[0], np.quantile(moved, 0.1), np.quantile(moved, 0.9), (moved > 0).mean()))
    assert (s.point, s.low, s.high, s.p_positive, s.known) == (0.0, 0.0, 0.0, 0.5, False)


def test_group_rows_average_members_before_they_spread(spark, planted):
    fits = chemistry.ensemble(planted[0], members=4)
    data = [("a", [0, 1, 2, 3, 4], 100.0, 90.0, 2.0), ("a", [5, 6, 7, 8, 9], 110.0, 95.0, 6.0), ("b", [1, 3, 5, 7, 9], 80.0, 85.0, 1.0)]
    rows = spark.createDataFrame(data, "group string, offense_player_ids array<long>, y double, additive double, w double")
    found = {r.group: r for r in chemistry.group_rows(rows, fits, "group").collect()}
    e = np.array([[m.raw(np.array([f]))[0] - m.centre for _, f, *_ in data[:2]] for m in fits])
    w = np.array([2.0, 6.0])
    members = (e[1:] * w).sum(axis=1) / 8
    a = found["a"]
    assert (a.stints, a.weight, a.actual, a.additive) == (2, 8.0, 107.5, 93.75)
    assert (a.full, a.interaction_mean, a.interaction_sd, a.p_positive) == pytest.approx((93.75 + (e[0] * w).sum() / 8, members.mean(), members.std(), (members > 0).mean()))


def test_the_whole_model_over_stints(spark):
    stints, _ = models.synthetic(spark, players=24, stints=900)
    stints = stints.cache()
    fits, strength, gains = models.chemistry_of(stints, members=2)
    assert len(fits) == 3 and strength in gains and all(isinstance(m, chemistry.Interactions) for m in fits)
    sided = stints.withColumn("late", F.col("game_id") >= "g0150")
    groups = models.ensemble_groups(sided.where("NOT late").drop("late"), sided.where("late").drop("late"), members=2).collect()
    assert groups and all(0 <= g.p_positive <= 1 and g.interaction_sd >= 0 for g in groups)
    pairs = models.bootstrap_interactions(stints, members=2).collect()
    assert pairs and all(r.low <= r.high for r in pairs) and linear.MAX_COLUMNS > 0
