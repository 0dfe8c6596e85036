"""The evaluation suite and recovery on a league of known talents and pair effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import metrics, splits
from cadence.plans import models, suite


@pytest.fixture(scope="module")
def league(spark):
    """Stints of 12 and 12 players whose rating adds talents and pairs' p . q; (stints, talent, pairs, truth)."""
    base, _ = models.synthetic(spark, players=24, stints=1600, truth_sd=0.0)
    r = np.random.default_rng(11)
    talent, p, q = r.normal(0, 5, 24), r.normal(size=12) * 2.5, r.normal(size=12) * 2.5
    effect = F.array(*[F.lit(float(t)) for t in talent])
    vector = {n: F.array(*[F.lit(float(x)) for x in v]) for n, v in (("p", p), ("q", q))}
    total = lambda ids, of: F.aggregate(F.transform(ids, lambda m: F.get(of, m.cast("int"))), F.lit(0.0), lambda s, x: s + x)
    o, d = F.col("offense_player_ids"), F.col("defense_player_ids")
    both = F.aggregate(F.transform(o, lambda m: F.get(vector["p"], m.cast("int")) * F.get(vector["q"], m.cast("int"))), F.lit(0.0), lambda s, x: s + x)
    chemistry = total(o, vector["p"]) * total(o, vector["q"]) - both
    rated = base.withColumns({"truth": 110.0 + total(o, effect) - total(d, effect) + chemistry, "offensive_possessions": F.col("offensive_possessions") * 20})
    noise = (F.pmod(F.xxhash64("stint_id"), F.lit(2001)) - 1000) / 100.0
    stints = rated.withColumn("points_scored", F.greatest(F.lit(0), F.round((F.col("truth") + noise) * F.col("offensive_possessions") / 100)).cast("int"))
    pair = np.outer(p, q) + np.outer(q, p)
    np.fill_diagonal(pair, 0.0)
    lasting = talent.copy()
    lasting[:12] += 4 / 11 * pair.sum(axis=1)  # what an additive model sees of a player's pairs
    known = spark.createDataFrame([(s, m, float(lasting[m])) for s, ids in (("offense", range(12)), ("defense", range(12, 24))) for m in ids], "side string, member long, truth double")
    pairs = spark.createDataFrame([(a, b, float(p[a] * q[b] + p[b] * q[a])) for a in range(12) for b in range(a + 1, 12)], "a long, b long, truth double")
    stints = stints.cache()
    return stints.drop("truth"), known, pairs, stints.select("stint_id", "truth")


def test_the_full_model_is_better_where_pairs_matter(league):
    stints, _, _, truth = league
    holdouts = {"chronological": (splits.chronological(stints), "month", None), "unseen_lineup": (splits.hold_out_lineups(stints, splits.unseen_lineups(stints, 100)), "lineup", None)}
    found = {r.holdout: r for r in suite.evaluate(stints, holdouts, truth, members=1, blocks=100).collect()}
    assert set(found) == set(holdouts) and found["unseen_lineup"].groups == 100
    for r in found.values():
        assert r.full_macro_rmse_truth < r.additive_macro_rmse_truth or r.holdout == "chronological"
        assert r.full_micro_rmse_truth < r.additive_micro_rmse_truth and r.full_micro_rmse < r.additive_micro_rmse
        assert r.low <= r.delta <= r.high and r.share_positive > 0.95
    lineups = found["unseen_lineup"]
    assert lineups.improvement_percent == pytest.approx(100 * (1 - lineups.full_macro_rmse_truth / lineups.additive_macro_rmse_truth)) and lineups.improvement_percent > 20


def test_errors_are_those_of_the_scored_rows(league):
    stints = league[0]
    split = splits.chronological(stints)
    sided = stints.join(split, "stint_id")
    rows, fits = suite.scored_holdout(sided.where("side = 'train'").drop("side"), sided.where("side = 'test'").drop("side"), members=0)
    assert len(fits) == 1
    rows = rows.collect()
    got = suite.evaluate(stints, {"chronological": (split, "month", None)}, members=0, blocks=5).first()
    w = np.array([r.w for r in rows])
    for name in ("additive", "full"):
        e = np.array([r.y - r[name] for r in rows])
        assert got[f"{name}_micro_rmse"] == pytest.approx(np.sqrt((w * e * e).sum() / w.sum())) and got[f"{name}_micro_mae"] == pytest.approx((w * abs(e)).sum() / w.sum())
    assert got.stints == len(rows) and "full_micro_rmse_truth" not in got.asDict() and metrics.LEVELS


def test_a_fit_recovers_talents_and_pairs(league):
    stints, talent, pairs, _ = league
    found = suite.recovered(stints, talent, pairs).first()
    assert found.supported == 12 and found.pairs >= 5 and found.defense_correlation > 0.95
    assert found.offense_correlation > 0.9 and found.pair_correlation is None  # too few pairs by the rule to tell
    model = models.chemistry_of(stints)[0][0]
    every = models.interactions(model, pairs).join(pairs, ["a", "b"]).agg(F.corr("effect", "truth")).first()[0]
    assert every > 0.8
