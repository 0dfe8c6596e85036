"""Tiles and conjugate gradients against dense solves; group predictions without the whole covariance."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import gram
from cadence.plans import linear, models, tiled


@pytest.fixture(scope="module")
def league(spark):
    stints, _ = models.synthetic(spark, players=330, stints=6000, truth_sd=3.0)
    rows = models.design_rows(stints, keep=("offense_player_ids",)).cache()
    return stints.cache(), rows, linear.collect(rows)[None]


@pytest.fixture(scope="module")
def tiles(league):
    small = tiled.TILE
    tiled.TILE = 64
    t = tiled.collect(league[1])
    yield t
    t.close()
    tiled.TILE = small


def test_a_product_is_that_of_the_dense_matrix(league, tiles):
    s = league[2]
    assert tiles.columns == s.columns and np.allclose(tiles.b, s.b) and np.allclose(tiles.diagonal, np.diag(s.g))
    v = np.random.default_rng(1).normal(size=(len(s.columns), 3))
    assert np.allclose(tiles.product(v), s.g @ v, rtol=1e-9)


def test_coefficients_of_a_league_equal_the_dense_solve(league, tiles):
    s = league[2]
    for penalty in (3.0, 300.0):
        assert np.abs(tiled.ridge(tiles, penalty) - linear.ridge(s, penalty)).max() < 1e-6


def test_variance_components_with_all_probes_equal_the_dense_ones(league, tiles):
    dense = linear.expectation_maximisation(league[2], models.PLAYERS, rounds=4)
    fit = tiled.expectation_maximisation(tiles, models.PLAYERS, probes=10**6, rounds=4)
    assert fit.sigma2 == pytest.approx(dense.sigma2, rel=1e-6) and fit.variances == pytest.approx(dense.variances, rel=1e-6)
    assert np.abs(fit.on(dense.columns) - dense.coef).max() < 1e-6


def test_variance_components_by_estimated_traces(league, tiles):
    dense = linear.expectation_maximisation(league[2], models.PLAYERS, rounds=6)
    fit = tiled.expectation_maximisation(tiles, models.PLAYERS, probes=24, rounds=6)
    assert fit.variances == pytest.approx(dense.variances, rel=0.05)
    assert np.corrcoef(fit.on(dense.columns), dense.coef)[0, 1] > 0.999


def test_selected_solves_give_the_posterior_spread(league, tiles):
    dense = linear.expectation_maximisation(league[2], models.PLAYERS, rounds=4)
    fit = tiled.expectation_maximisation(tiles, models.PLAYERS, probes=10**6, rounds=4)
    # the factor of the last round belongs to the variances before its step: take those of the fit
    prior = np.array([fit.variances.get("player", 1.0) if c[0] in "od" else 1e6 for c in dense.columns])
    keep = [league[2].columns.index(c) for c in dense.columns]
    covariance = np.linalg.inv(league[2].g[np.ix_(keep, keep)] / fit.sigma2 + np.diag(1 / prior))
    g = np.zeros((5, len(fit.columns)))
    r = np.random.default_rng(2)
    g[:, r.choice(keep, 20, replace=False)] = r.normal(size=(5, 20))
    want = np.einsum("gi,ij,gj->g", g[:, keep], covariance, g[:, keep])
    assert np.allclose(tiled.quadratic_forms(tiles, fit, g, models.PLAYERS, at_once=2), want, rtol=1e-6)


def test_groups_by_tiles_equal_groups_by_the_whole_covariance(spark, league):
    stints, rows, s = league
    fit = linear.expectation_maximisation(s, models.PLAYERS, rounds=5)
    named = rows.withColumn("lineup", F.concat_ws("-", "offense_player_ids"))
    groups = gram.group_rows(named, "lineup").where(F.abs(F.hash("lineup")) % 15 == 0).cache()
    n = groups.select("lineup").distinct().count()
    assert n >= 300
    start = time.time()
    one = {r.lineup: r for r in linear.group_predictive(fit, groups, "lineup").collect()}
    assert time.time() - start < 5 and len(one) == n
    two = {r.lineup: r for r in linear.group_predictive(fit, groups, "lineup", sent_bytes=0, tile=100).collect()}
    assert set(one) == set(two) and all(one[g].mean == pytest.approx(two[g].mean) and one[g].sd == pytest.approx(two[g].sd, rel=1e-9) for g in one)
    half = np.linalg.inv(fit.covariance_factor)
    at = {c: k for k, c in enumerate(fit.columns)}
    name = next(iter(one))
    x = np.zeros(len(at))
    for r in groups.where(F.col("lineup") == name).collect():
        if r.col in at:
            x[at[r.col]] = r.val
    assert one[name].sd == pytest.approx(np.sqrt(((half @ x) ** 2).sum() + fit.sigma2 / one[name].weight))
