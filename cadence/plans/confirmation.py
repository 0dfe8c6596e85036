"""Interaction models held against the additive one and against placebos, from shared statistics.

One pass over the training stints gives the statistics of every model: each number of roles, its
placebo, redundancy and its placebo are variants of one design, and each outcome is a response with
its own weights. One pass over the test stints gives every model's predictions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contract, gram, metrics, profiles
from . import linear, variants
from .models import PLAYERS, design_rows, pairs_met, rung_errors

POINTS = "points_per_100"
_BLOCKS = PLAYERS | {"extra": ("v:",)}
ROUNDS = 30
#: Groups that a mediation needs at least.
FEWEST = 5


def _responses(outcomes: tuple[str, ...]) -> dict[str, tuple[str, str]]:
    return {POINTS: ("y", "w")} | {o: (f"y_{o}", f"w_{o}") for o in outcomes}


def with_outcomes(stints: DataFrame, counts: DataFrame | None, outcomes: tuple[str, ...], minimum: int) -> DataFrame:
    """Stints with value and weight of each outcome (null under ``minimum`` of its own denominator):
    one join for all of them. counts: (stint_id, counters)."""
    if not outcomes:
        return stints
    one = lambda o: (S.safe_ratio(F.coalesce(F.col(profiles.OUTCOMES[o][0]), F.lit(0)), F.col(profiles.OUTCOMES[o][1])), F.col(profiles.OUTCOMES[o][1]).cast("double"))
    cols = [F.when(one(o)[1] >= minimum, one(o)[k]).alias(f"{n}_{o}") for o in outcomes for k, n in enumerate("yw")]
    return stints.join(counts.select("stint_id", *cols), "stint_id", "left")


def model_statistics(train: DataFrame, known: list[variants.Variant], outcomes: tuple[str, ...] = ()) -> dict[str, linear.Statistics]:
    """Statistics over all variants' columns for each response, from one pass. ``train``: stints with
    the outcomes' values."""
    keep = (variants.MEMBERS, *(f"{n}_{o}" for o in outcomes for n in "yw"))
    found = linear.collect_many(variants.add(design_rows(train, keep=keep), known), _responses(outcomes))
    return {name: parts[None] for name, parts in found.items() if parts and parts[None].n}


def model_part(s: linear.Statistics, variant: variants.Variant | None) -> linear.Statistics:
    """The statistics of the additive model, or of that with one variant's columns."""
    names = np.array([not c.startswith("v:") or (variant is not None and c.startswith(variant.prefix)) for c in s.columns])
    return linear.cut(s, names)


def _table(train: DataFrame, coefs: dict[str, tuple[list[str], np.ndarray]]) -> DataFrame:
    columns = sorted({c for names, _ in coefs.values() for c in names})
    at = {c: k for k, c in enumerate(columns)}
    values = np.zeros((len(columns), len(coefs)))
    for m, (names, v) in enumerate(coefs.values()):
        values[[at[c] for c in names], m] = v
    return train.sparkSession.createDataFrame([(c, *map(float, v)) for c, v in zip(columns, values)], "col string, " + ", ".join(f"`{n}` double" for n in coefs))


def _fit(s: linear.Statistics) -> tuple[list[str], np.ndarray]:
    fit = linear.expectation_maximisation(s, _BLOCKS, rounds=ROUNDS)
    return fit.columns, fit.coef


def _deltas(groups: DataFrame, pairs: dict[str, tuple[str, str]], replicates: int, seed: int) -> dict[str, tuple]:
    """For each name (base column, model column): mean, low, high and share above zero of the base's
    error over resampled groups less the model's. All of them from the same draws."""
    used = sorted({c for pair in pairs.values() for c in pair})
    square = lambda c: (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))
    drawn = metrics.bootstrap(groups, "group", replicates, seed, **{f"s{k}": square(c) for k, c in enumerate(used)})
    root = {c: F.sqrt(F.col(f"s{k}") / F.col("draws")) for k, c in enumerate(used)}
    long = drawn.select("draws", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (root[b] - root[m]).alias("delta")) for n, (b, m) in pairs.items()])).alias("x")).select("draws", "x.*")
    s = long.groupBy("name").agg(F.array_sort(F.collect_list("delta")).alias("v"), F.avg("delta").alias("mean"), F.max("draws").alias("n"))  # replicates
    at = lambda p: F.get("v", F.least(F.floor(p * F.size("v")).cast("int"), F.size("v") - 1))
    rows = s.select("name", *[F.when(F.col("n") >= 3, c).otherwise(0.0).alias(n) for n, c in (("mean", F.col("mean")), ("low", at(0.025)), ("high", at(0.975)), ("share", F.size(F.filter("v", lambda x: x > 0)) / F.size("v")))]).collect()  # a row for each model
    return {r["name"]: tuple(float(r[c]) for c in ("mean", "low", "high", "share")) for r in rows}


ROW = "model string, k int, holdout string, outcome string, groups long, rmse_model double, rmse_rung3 double, rmse_placebo double, " + ", ".join(f"{base}_{n} double" for base in ("rung3", "placebo") for n in ("mean", "low", "high", "share"))


def confirm(stints: DataFrame, holdouts: dict[str, tuple], roles: dict[int, DataFrame], vectors: DataFrame, counts: DataFrame | None = None, outcomes: tuple[str, ...] = (), replicates: int = 2000, seed: int = 0, minimum: int = 3, mediation_k: int = 5) -> tuple[DataFrame, dict[str, float]]:
    """A row for each (model, k, holdout, outcome): its error over held-out groups beside those of the
    hierarchical fit and of its placebo, and by how much it is under them over resampled groups; and
    the mediation found (empty without enough groups).

    holdouts: name to (split, kind of groups, held pairs or None). roles: for each k, (member, role).
    vectors: (member, features). counts: (stint_id, counters of the outcomes). Models: ``rung2``
    (additive ridge), ``role`` and ``redundancy`` on points, ``mechanistic_role`` on each outcome.
    """
    spark, out, mediation = stints.sparkSession, [], {}
    for holdout, (split, kind, held) in holdouts.items():
        sided = with_outcomes(stints, counts, outcomes, minimum).join(split.where("side <> 'drop'"), "stint_id")
        train, test = sided.where("side = 'train'").drop("side").persist(), sided.where("side = 'test'").drop("side").persist()
        try:
            known = {}
            for k, r in sorted(roles.items()):
                known["role", k] = variants.of_roles(f"role{k}", r, k)
                known["role_placebo", k] = variants.dealt(known["role", k], f"role_placebo{k}", seed + 1)
            known["redundancy", 0] = variants.of_vectors("redundancy", vectors, train)
            known["redundancy_placebo", 0] = variants.scaled(variants.dealt(known["redundancy", 0], "redundancy_placebo", seed + 1), train)
            stats = model_statistics(train, list(known.values()), outcomes)
            coefs: dict[str, tuple] = {}
            for response, s in stats.items():
                coefs[f"{response}/rung3"] = _fit(model_part(s, None))
                if response == POINTS:
                    coefs[f"{response}/rung2"] = (model_part(s, None).columns, linear.ridge(model_part(s, None), 30.0))
                for (name, k), v in known.items():
                    if response == POINTS or name.startswith("role"):
                        coefs[f"{response}/{name}/{k}"] = _fit(model_part(s, v))
            keep = ("stint_id", variants.MEMBERS, "game_date", *(f"{n}_{o}" for o in outcomes for n in "yw"))
            rows = variants.flattened(variants.add(design_rows(test, train, keep[1:]), list(known.values())))
            scored = gram.scored(rows, _table(train, coefs)).join(metrics.holdout_groups(test, kind, held), "stint_id").persist()
            surprise = None
            for response, (y, w) in _responses(outcomes).items():
                if response not in stats:
                    continue
                mine = {n.split("/", 1)[1]: n for n in coefs if n.startswith(response + "/")}
                groups = scored.where(F.col(w).isNotNull() & F.col(y).isNotNull()).groupBy("group").agg(metrics.weighted_mean(y, w).alias("y"), *[(F.sum(F.col(w) * F.col(f"`{c}`")) / F.sum(w)).alias(n) for n, c in mine.items()]).persist()
                asked = {"rung2": ("rung2", 0, "rung3", "rung3", "rung2")} if response == POINTS else {}
                for k in sorted(roles):
                    asked[f"role/{k}"] = ("role" if response == POINTS else "mechanistic_role", k, "rung3", f"role_placebo/{k}", f"role/{k}")
                    if response == POINTS:
                        asked[f"redundancy/{k}"] = ("redundancy", k, "rung3", "redundancy_placebo/0", "redundancy/0")
                sizes = groups.agg(F.count(F.lit(1)).alias("n"), *[metrics.rmse(F.col("y") - F.col(f"`{c}`")).alias(c) for c in mine]).first()
                if sizes["n"]:
                    renamed = groups.select("group", "y", *[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(mine)])
                    number = {c: f"p{i}" for i, c in enumerate(mine)}
                    deltas = [_deltas(renamed, {n: (number[a[which]], number[a[4]]) for n, a in asked.items()}, replicates, seed + which - 2) for which in (2, 3)]
                    for n, (model, k, base, placebo, own) in asked.items():
                        out.append((model, k, holdout, response, sizes["n"], float(sizes[own]), float(sizes[base]), float(sizes[placebo]), *deltas[0][n], *deltas[1][n]))
                if kind == "lineup" and response == POINTS:
                    surprise = groups.select("group", (F.col("y") - F.col("rung3")).alias("points"))
                if kind == "lineup" and response == "three_share" and f"role/{mediation_k}" in mine:
                    both = groups.select("group", (F.col(f"`role/{mediation_k}`") - F.col("rung3")).alias("shots")).join(surprise, "group")
                    m = both.agg(F.count(F.lit(1)).alias("n"), metrics.correlation(F.col("shots"), F.col("points")).alias("c"), F.avg(F.abs("shots")).alias("size")).first()
                    if m["n"] >= FEWEST:
                        mediation = {"lineups": float(m["n"]), "correlation": float(m["c"] or 0.0), "mean_abs_shots": float(m["size"])}
                groups.unpersist()
            scored.unpersist()
        finally:
            train.unpersist()
            test.unpersist()
    return spark.createDataFrame(out, ROW), mediation


def compare(train: DataFrame, test: DataFrame, roles: DataFrame, k: int, minimum: int, vectors: DataFrame | None = None) -> DataFrame:
    """model, macro_rmse, micro_rmse: pair, role-pair and (with ``vectors``: member, features)
    redundancy terms, and their placebos (roles and vectors dealt out anew, pairs admitted at random),
    against the hierarchical fit, by lineup on the test side. One pass over either side."""
    admitted = contract.pair_exposure(train, minimum).select("a", "b")
    chosen = variants.of_pairs("pairs", admitted)
    random_pairs = pairs_met(train).orderBy(F.md5(S.pair_id("a", "b"))).limit(len(chosen.pairs))
    roled = variants.of_roles("roles", roles, k)
    known = [chosen, variants.of_pairs("pairs_placebo", random_pairs), roled, variants.dealt(roled, "roles_placebo", 17)]
    if vectors is not None:
        alike = variants.of_vectors("redundancy", vectors, train)
        known += [alike, variants.scaled(variants.dealt(alike, "redundancy_placebo", 19), train)]
    s = model_statistics(train, known)[POINTS]
    coefs = {"base": _fit(model_part(s, None))} | {v.name: _fit(model_part(s, v)) for v in known}
    named = test.withColumn("lineup", S.lineup_id(variants.MEMBERS))
    rows = variants.flattened(variants.add(design_rows(named, train, ("lineup", variants.MEMBERS)), known))
    errors = rung_errors(gram.scored(rows, _table(train, coefs)), "lineup", tuple(coefs))
    return errors.select(F.col("rung").alias("model"), "macro_rmse", "micro_rmse")


def redundancy_effects(stints: DataFrame, vectors: DataFrame) -> DataFrame:
    """feature, effect: what concentrating a feature in a lineup adds."""
    v = variants.of_vectors("redundancy", vectors, stints)
    columns, coef = _fit(model_part(model_statistics(stints, [v])[POINTS], v))
    found = [(c[len(v.prefix) :], float(x)) for c, x in zip(columns, coef) if c.startswith(v.prefix)]
    return stints.sparkSession.createDataFrame(found, "feature string, effect double")
