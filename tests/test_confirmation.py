"""Shared statistics, variants and the confirmation sweep."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import gram, metrics, profiles, shared, splits
from cadence.plans import confirmation, linear, models, variants


@pytest.fixture(scope="module")
def league(spark):
    """A league whose offenses gain 25 points a 100 for each pair of role-0 players."""
    stints, _ = models.synthetic(spark, players=24, stints=1500, truth_sd=2.0)
    zeros = F.size(F.filter("offense_player_ids", lambda p: p % 3 == 0))
    gain = 25.0 * zeros * (zeros - 1) / 2
    points = F.greatest(F.lit(0), F.round(F.col("points_scored") + gain * F.col("offensive_possessions") / 100)).cast("int")
    return stints.withColumn("points_scored", points).cache()


@pytest.fixture(scope="module")
def roles(spark):
    return spark.range(24).select(F.col("id").alias("member"), (F.col("id") % 3).alias("role"))


def brute(rows, responses):
    out = {}
    for r, (value, weight) in enumerate(responses):
        for row in rows:
            y, w = row[value], row[weight]
            if y is None or w is None or not w > 0:
                continue
            lists = [row["cells"] or [], *(row["extras"] or [])]
            for k, cells in enumerate(lists):
                for c in cells:
                    v = c["val"] or 0.0
                    if not v:
                        continue
                    out.setdefault((c["col"], "~y"), {}).setdefault(r, 0.0)
                    out[c["col"], "~y"][r] += v * w * y
                    for d in [*(lists[0] if k else []), *cells]:
                        u = d["val"] or 0.0
                        if u and (c["col"] <= d["col"] or (k and any(d is x for x in lists[0]))):
                            key = (min(c["col"], d["col"]), max(c["col"], d["col"]))
                            out.setdefault(key, {}).setdefault(r, 0.0)
                            out[key][r] += v * u * w
    return out


def test_sums_by_brute_force(spark, monkeypatch):
    r = random.Random(3)
    cell = lambda abc: (f"{r.choice(abc)}{r.randint(0, 3)}", r.choice([0.0, 1.0, -2.0, 0.5, None]))
    data = []
    for _ in range(60):
        extras = [[cell("st") for _ in range(r.randint(0, 3))], [cell("uv") for _ in range(r.randint(0, 3))]]
        data.append((r.choice(["x", "y"]), [cell("ab") for _ in range(r.randint(0, 4))], extras, r.choice([None, 1.0, 2.5]), r.choice([None, 0.0, 1.0, 3.0]), 2.0, r.choice([1.0, 2.0])))
    kind = "struct<col:string,val:double>"
    df = spark.createDataFrame(data, f"f string, cells array<{kind}>, extras array<array<{kind}>>, y double, w double, z double, u double").repartition(3)
    responses = [("y", "w"), ("z", "u")]
    for dense in (1 << 22, 0):
        monkeypatch.setattr(shared, "_DENSE", dense)
        got = {(x.i, x.j): (x.g0, x.g1) for x in shared.sums(df, responses).where("i < '~'").collect()}
        want = brute(df.collect(), responses)
        assert all(abs(got[k][n] - want.get(k, {}).get(n, 0.0)) < 1e-9 for k in got for n in (0, 1)) and set(want) <= set(got)
    parts = linear.collect_many(df, {"p": responses[0], "q": responses[1]}, "f")
    whole = linear.collect_many(df, {"p": responses[0], "q": responses[1]})
    for name in "pq":
        assert np.allclose(linear.total(list(parts[name].values())).g, whole[name][None].g)
        assert sum(p.n for p in parts[name].values()) == whole[name][None].n
    rows = df.where("y IS NOT NULL AND w > 0")
    m = gram.moments(rows).first()
    s = whole["p"][None]
    assert (s.n, s.sw, s.slogw, s.q) == pytest.approx((m.n, m.sw, m.slogw, m.q)) and s.var_y == pytest.approx(m.var_y)


def test_a_callers_cache_is_kept(spark, league):
    rows = models.design_rows(league).persist()
    rows.count()
    linear.collect(rows)
    assert rows.storageLevel.useMemory
    rows.unpersist()


def test_cells_are_bounded_before_they_are_fetched(league, monkeypatch):
    monkeypatch.setattr(linear, "MAX_COLUMNS", 50)
    linear.collect(models.design_rows(league))
    from cadence.operators import ordered

    folded = models.design_rows(ordered.folds(league, "game_id", 3), league, ("fold",))
    with pytest.raises(ValueError):  # three times as many cells
        linear.collect(folded, "fold")


def test_variants_in_the_row_by_plain_counting(spark):
    rows = spark.createDataFrame([("s", [4, 1, 9]), ("t", [1, 2, 3, 4, 7]), ("u", [])], "stint_id string, offense_player_ids array<long>")
    known = [
        variants.Variant("r", k=2, roles={1: 0, 4: 1, 9: 1, 2: 0}),
        variants.Variant("p", pairs=[(1, 4), (4, 9), (2, 7)]),
        variants.Variant("v", features=("a", "b"), vectors={1: [1.0, 2.0], 4: [3.0, -1.0]}),
    ]
    got = {r.stint_id: [{(c["col"], c["val"]) for c in e} for e in r.extras] for r in variants.add(rows, known).collect()}
    assert got["s"] == [{("v:r|1", 1.0), ("v:r|2", 1.0)}, {("v:p|1-4", 1.0), ("v:p|4-9", 1.0)}, {("v:v|a", 6.0), ("v:v|b", -4.0)}]
    assert got["t"][1] == {("v:p|1-4", 1.0), ("v:p|2-7", 1.0)} and got["u"] == [set(), set(), {("v:v|a", 0.0), ("v:v|b", 0.0)}]
    bins = [c["col"] for c in variants.add(rows, known[:1]).where("stint_id = 's'").first().extras[0]]
    assert sorted(bins) == ["v:r|1", "v:r|1", "v:r|2"]  # 1 with 4, 1 with 9, 4 with 9


def test_cut_statistics_equal_a_separate_fit(spark, league, roles):
    a = variants.of_roles("a", roles, 3)
    b = variants.dealt(a, "b", 5)
    assert b.roles == {r.member: r.role for r in profiles.permuted(roles, "member", "role", 5).collect()}
    s = confirmation.model_statistics(league, [a, b])[confirmation.POINTS]
    alone = confirmation.model_statistics(league, [b])[confirmation.POINTS]
    part = confirmation.model_part(s, b)
    assert part.columns == alone.columns and np.allclose(part.g, alone.g) and np.allclose(part.b, alone.b)
    plain = linear.collect(models.design_rows(league))[None]
    part = confirmation.model_part(s, None)
    assert part.columns == plain.columns and np.allclose(part.g, plain.g)
    assert np.allclose(confirmation._fit(part)[1], linear.expectation_maximisation(plain, models.PLAYERS, rounds=confirmation.ROUNDS).coef)
    assert confirmation._fit(part)[0] == [c for c, x in zip(plain.columns, linear.dependent(plain)) if not x]


def test_a_planted_role_effect_is_confirmed_and_its_placebo_not(spark, league, roles):
    vectors = roles.select("member", (F.col("role") == 0).cast("double").alias("zero"), F.rand(1).alias("noise"))
    counts = league.select("stint_id", (F.size(F.filter("offense_player_ids", lambda p: p % 3 == 0)) * 4).alias("threes"), F.lit(40).alias("attempts"))
    split = splits.hold_out_lineups(league, splits.unseen_lineups(league, 150))
    held = spark.createDataFrame([(0, 3), (1, 5), (2, 8), (4, 7)], "a long, b long")
    holdouts = {"unseen_lineup": (split, "lineup", None), "unseen_pair": (splits.hold_out_pairs(league, held), "pair", held)}
    found, mediation = confirmation.confirm(league, holdouts, {3: roles}, vectors, counts, ("three_share",), replicates=300, mediation_k=3)
    rows = {(r.model, r.holdout, r.outcome): r for r in found.collect()}
    assert len(rows) == 2 * 4 and all(r.k == (0 if r.model == "rung2" else 3) for r in rows.values())
    for model in ("role", "redundancy"):
        r = rows[model, "unseen_lineup", confirmation.POINTS]
        assert r.rmse_model < r.rmse_rung3 and r.rmse_model < r.rmse_placebo and r.rung3_share > 0.95 and r.placebo_share > 0.9
        assert r.rung3_low <= r.rung3_mean <= r.rung3_high
    shots = rows["mechanistic_role", "unseen_lineup", "three_share"]
    assert abs(shots.rmse_rung3) < 0.02  # additive by construction: nothing is left for roles to explain
    assert mediation["lineups"] == rows["role", "unseen_lineup", confirmation.POINTS].groups and -1 <= mediation["correlation"] <= 1


def test_comparison_and_redundancy(spark, league, roles):
    sided = league.join(splits.chronological(league), "stint_id")
    train, test = sided.where("side = 'train'").drop("side"), sided.where("side = 'test'").drop("side")
    vectors = roles.select("member", (F.col("role") == 0).cast("double").alias("zero"))
    found = {r.model: r.macro_rmse for r in confirmation.compare(train, test, roles, 3, 20, vectors).collect()}
    assert set(found) == {"base", "pairs", "pairs_placebo", "roles", "roles_placebo", "redundancy", "redundancy_placebo"}
    assert found["roles"] < min(found["base"], found["roles_placebo"]) and found["redundancy"] < min(found["base"], found["redundancy_placebo"])
    assert confirmation.redundancy_effects(league, vectors).first().effect > 0


def test_fits_with_a_variant(spark, league, roles):
    fit = models.fit_role_pairs(league, roles, 3)
    found = dict(zip(fit.columns, fit.coef))
    assert max((c for c in found if c.startswith("r")), key=found.get) == "r0"  # the planted bin
    pairs = models.fit_pairs(league, 60)
    assert any(c.startswith("p") and "-" in c for c in pairs.columns)
    dense = models.fit_redundancy(league, roles.select("member", (F.col("role") == 0).cast("double").alias("zero")), ["zero"])
    assert dense.coef[dense.columns.index("x_zero")] > 0


def test_bootstrap_sums_equal_the_join(spark):
    groups = spark.createDataFrame([(f"g{i}", float(i), None if i % 7 == 0 else i * 0.5) for i in range(40)], "k string, a double, b double").repartition(3)
    one, two = ({r.replicate: (r.a, r.b, r.draws) for r in metrics.bootstrap(groups, "k", 50, 4, sent_bytes=n, a=F.col("a"), b=F.col("b")).collect()} for n in (1 << 20, 0))
    assert set(one) == set(range(50)) and all(one[r] == pytest.approx(two[r]) for r in one)
    assert metrics.bootstrap(groups.limit(0), "k", 5, 4, a=F.col("a")).collect() == []


def test_two_thousand_draws(spark):
    groups = spark.range(2000).select("id", (F.col("id") % 10).cast("double").alias("v"))
    found = metrics.bootstrap(groups, "id", 2000, 1, v=F.col("v"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    means = [r.v / r.draws for r in found.collect()]
    assert len(means) == 2000 and abs(np.mean(means) - 4.5) < 0.02 and abs(np.std(means) - np.sqrt(8.25 / 2000)) < 0.01


@pytest.fixture(scope="module")
def halves(league):
    sided = league.join(splits.chronological(league), "stint_id")
    train, test = (sided.where(F.col("side") == s).drop("side").cache() for s in ("train", "test"))
    return train, test


def test_transport_to_another_table(halves):
    train, test = halves
    found = {(r.kind, r.level): r for r in models.transport(train, test).collect()}
    lineups = test.select(F.array_sort("offense_player_ids")).distinct().count()
    assert sum(r.lineups for (kind, _), r in found.items() if kind == "novelty") == lineups
    assert sum(r.lineups for (kind, _), r in found.items() if kind == "pairs") == lineups
    assert found["context", "all"].lineups == test.count() == found["context", "clutch"].lineups + found["context", "other"].lineups
    with pytest.raises(ValueError):
        models.transport(train, test.limit(3))


def test_an_outcome_that_follows_players_is_predicted(halves, league):
    train, test = halves
    made = F.size(F.filter("offense_player_ids", lambda p: p % 3 == 0))
    counts = league.select("stint_id", (made * 3).alias("rim"), (made * 0 + 1).alias("threes"), F.lit(30).alias("attempts"))
    one = models.mechanistic(train, test, counts, "rim_share").first()
    assert one.model_rmse < 0.3 * one.base_rmse and one.gain > 0
    every = {r.outcome: r for r in models.mechanistic_outcomes(train, test, counts).collect()}
    assert set(every) == {"rim_share", "three_share"} and every["rim_share"].gain == pytest.approx(one.gain)
    assert abs(every["three_share"].gain) < 1e-3  # the same everywhere


def test_an_outcomes_role_model_is_carried_over(halves, league, roles):
    from cadence.plans import evaluation

    train, test = halves
    zeros = F.size(F.filter("offense_player_ids", lambda p: p % 3 == 0))
    noise = F.pmod(F.xxhash64("stint_id"), F.lit(3))
    counts = league.select("stint_id", (zeros * (zeros - 1) * 2 + noise).alias("threes"), F.lit(40).alias("attempts"))
    found = {r.model: r for r in evaluation.transport_outcome(train, test, counts, roles, 3, least=1, replicates=200).collect()}
    assert set(found) == {"rung3", "role", "role_placebo"} and len({r.lineups for r in found.values()}) == 1
    assert found["role"].macro_rmse < min(found["rung3"].macro_rmse, found["role_placebo"].macro_rmse)
    assert found["rung3"].low > 0 and found["rung3"].share_positive == 1.0 and found["role"].low == found["role"].high == 0.0


def test_planted_teammates_show_in_receivers(spark):
    rng = np.random.default_rng(3)
    gift = np.linspace(-4, 4, 12)
    rows = []
    for s in range(500):
        five = [int(m) for m in rng.choice(12, 5, replace=False)]
        rows += [(f"s{s}", f"2021-{1 + s // 50:02d}-01", m, float(12 + m + sum(gift[x] for x in five if x != m) + rng.normal()), 0.0, 0.0, 1.0) for m in five]
    production = spark.createDataFrame(rows, "stint_id string, game_date string, member long, fg double, ft double, assisted double, w double").withColumn("game_date", F.to_date("game_date"))
    found = models.evaluate_receivers(production).first()
    assert found.gain > 0 and found.model_rmse < 0.85 * found.base_rmse


def test_hypothetical_lineups(spark, league):
    fit = models.fit_hierarchical(league)
    effect = {int(c[1:]): v for c, v in zip(fit.columns, fit.coef) if c[0] == "o"}
    order = sorted(effect, key=effect.get)
    data = [("best", order[-5:], 100.0), ("worst", order[:5], 100.0), ("light", order[-5:], 10.0), ("stranger", [*order[-4:], 999], 100.0)]
    found = {r.lineup: r for r in models.predict_lineups(fit, spark.createDataFrame(data, "lineup string, five array<long>, weight double")).collect()}
    assert found["best"].mean > found["worst"].mean and found["light"].mean == pytest.approx(found["best"].mean) and found["light"].sd > found["best"].sd
    assert all(r.low_95 < r.low_80 < r.mean < r.high_80 < r.high_95 for r in found.values())
    assert found["best"].known_members == 5 and found["stranger"].known_members == 4
    with pytest.raises(ValueError):
        models.predict_lineups(fit, spark.createDataFrame([("x", [1, 1, 2, 3, 4], 1.0)], "lineup string, five array<long>, weight double"))


def test_nothing_stays_cached(halves):
    train, test = halves
    spark = train.sparkSession
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    models.transport(train, test).collect()
    metrics.bootstrap(train.groupBy("game_id").agg(F.sum("points_scored").alias("p")), "game_id", 10, 1, p=F.col("p")).collect()
    models.kmeans(spark.range(20).select("id", (F.col("id") % 4).cast("double").alias("x")), "id", ["x"], 2).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= held
