"""The model ladder over stints, and the evaluations built on it.

Every fit is one distributed pass (``linear.collect``) and a solve of the model's size.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contract, gram, metrics, ordered, profiles, splits
from ..sources.held import materialise
from . import chemistry, linear, variants

MIN_STINTS, MIN_TRANSPORT = 50, 10
PLAYERS = {"player": ("o", "d")}


def design_rows(stints: DataFrame, train: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Context and player cells, beside the columns ``keep``; scaler and seasons come from ``train``
    only: one row of it, which is all that reaches the driver."""
    train = stints if train is None else train
    seen = gram.scaler(train, F.array_sort(F.collect_set("season_index")).alias("seasons")).first()  # a few seasons
    scale = {k: F.lit(None if seen[k] is None else float(seen[k])).cast("double") for k in seen.asDict() if k != "seasons"}
    return gram.design(stints, gram.context_columns(seen["seasons"], scale), keep)


def _lineups(stints: DataFrame) -> DataFrame:
    return stints.withColumn("lineup", S.lineup_id("offense_player_ids"))


def fit_ridge(stints: DataFrame, folds: int = 3) -> linear.Fit:
    """Additive ridge, its strength chosen over game-blocked folds, from one pass."""
    parts = linear.collect(design_rows(ordered.folds(stints, "game_id", folds), stints, ("fold",)), "fold")
    penalty = linear.choose_penalty(parts)
    whole = linear.total(list(parts.values()))
    coef = linear.ridge(whole, penalty)
    return linear.Fit(whole.columns, coef, np.linalg.cholesky(whole.g + np.diag(np.where(whole.block(("c_",)), 1e-3, penalty))), {"penalty": penalty}, whole.residual(coef) / whole.n, [])


def fit_hierarchical(stints: DataFrame) -> linear.Fit:
    return linear.expectation_maximisation(linear.collect(design_rows(stints))[None], PLAYERS)


def _fit_with(stints: DataFrame, variant: variants.Variant, block: str, rounds: int = 200) -> linear.Fit:
    rows = variants.add(design_rows(stints, keep=(variants.MEMBERS,)), [variant])
    return linear.expectation_maximisation(linear.collect(rows)[None], PLAYERS | {block: (variant.prefix,)}, rounds=rounds)


def fit_pairs(stints: DataFrame, minimum: int) -> linear.Fit:
    """With a column for each pair of at least ``minimum`` shared stints."""
    return _fit_with(stints, variants.of_pairs("pairs", contract.pair_exposure(stints, minimum), "p"), "pair", 30)


def fit_role_pairs(stints: DataFrame, roles: DataFrame, k: int) -> linear.Fit:
    """roles: (member, role); members without a role form no pair."""
    return _fit_with(stints, variants.of_roles("roles", roles, k, "r"), "roles")


def fit_redundancy(stints: DataFrame, vectors: DataFrame, names: list[str]) -> linear.Fit:
    """vectors: (member, names...): concentration of each name, standardised, as dense columns."""
    return _fit_with(stints, variants.of_vectors("redundancy", vectors.select("member", *names), stints, "x_"), "redundancy")


def residual_rows(stints: DataFrame, folds: int = 4) -> DataFrame:
    """stint_id, game_id, offense_player_ids, e, w: residuals under fits that left the stint's game out."""
    rows = design_rows(ordered.folds(stints, "game_id", folds), stints, ("fold", "game_id", "offense_player_ids"))
    parts = linear.collect(rows, "fold")
    columns, table = next(iter(parts.values())).columns if parts else [], {}
    for held in parts:
        table[held] = linear.ridge(linear.total([p for k, p in parts.items() if k != held]), 30.0)
    held = sorted(table)
    coefs = stints.sparkSession.createDataFrame([(c, *[float(table[k][i]) for k in held]) for i, c in enumerate(columns)], "col string, " + ", ".join(f"f{k} double" for k in held))  # folds x columns
    predicted = F.coalesce(*[F.when(F.col("fold") == k, F.col(f"f{k}")) for k in held])
    return gram.scored(rows, coefs).select("stint_id", "game_id", "offense_player_ids", (F.col("y") - predicted).alias("e"), "w")


def interactions(model: chemistry.Interactions, met: DataFrame) -> DataFrame:
    """a, b, effect of the pairs ``met`` (a, b)."""
    plain = replace(model, centre=0.0)
    found = chemistry.effects(met.select("a", "b", F.array("a", "b").alias("pair")), [plain], "pair")
    return found.select("a", "b", F.get("effects", F.lit(0)).alias("effect"))


def pairs_met(stints: DataFrame) -> DataFrame:
    return stints.select(F.explode(S.pairs_of("offense_player_ids")).alias("p")).select("p.a", "p.b").distinct()


def reference_centred(effects: DataFrame, reference: DataFrame) -> DataFrame:
    """``effects`` (lineup, effect) less their mean over the ``reference`` lineups (lineup, weight), by
    weight, so that an effect says by how much a lineup differs from the usual."""
    mean = reference.join(effects, "lineup").agg((F.sum(F.col("weight") * F.col("effect")) / F.sum("weight")).alias("centre"))
    return effects.crossJoin(F.broadcast(mean)).select("lineup", (F.col("effect") - F.coalesce("centre", F.lit(0.0))).alias("effect"))  # mean: one row


def lineup_effects(stints: DataFrame, effects: DataFrame) -> DataFrame:
    """lineup, effect: the sum of its pairs' effects; pairs without one add nothing."""
    fives = _lineups(stints).select("lineup", F.array_sort("offense_player_ids").alias("five")).distinct()
    pairs = fives.select("lineup", F.explode(S.pairs_of("five")).alias("x")).select("lineup", "x.a", "x.b").join(effects.select("a", "b", "effect"), ["a", "b"], "left")
    return pairs.groupBy("lineup").agg(F.sum(F.coalesce("effect", F.lit(0.0))).alias("effect"))


def bootstrap_interactions(stints: DataFrame, members: int = 8, seed: int = 0) -> DataFrame:
    """a, b, effect, low, high, p_positive of the pairs that met: effects under game-resampled weights,
    centred on the point fit."""
    rows = residual_rows(stints).persist()
    try:
        fits = [replace(m, centre=0.0) for m in chemistry.ensemble(rows, members=members, seed=seed)]
    finally:
        rows.unpersist()
    pairs = pairs_met(stints).select("a", "b", F.array("a", "b").alias("pair"))
    return chemistry.intervals(pairs, fits, "pair").select("a", "b", F.col("point").alias("effect"), "low", "high", "p_positive")


def chemistry_of(stints: DataFrame, members: int = 0, seed: int = 0) -> tuple[list[chemistry.Interactions], float, dict[float, float]]:
    """The centred interaction fit of a table and its ensemble, the strength chosen by held-out games, and the
    gains of all strengths."""
    rows = residual_rows(stints).persist()
    try:
        strength, gains = chemistry.choose_strength(rows)
        return chemistry.ensemble(rows, strength, members, seed), strength, gains
    finally:
        rows.unpersist()


def lineup_intervals(stints: DataFrame, lineups: DataFrame, members: int = 8, seed: int = 0) -> DataFrame:
    """``lineups`` (with offense_player_ids) with the interaction's effect on each, its 80 % interval and
    the chance that it helps; a lineup with an unseen player has 0 and 0.5."""
    return chemistry.intervals(lineups, chemistry_of(stints, members, seed)[0])


def ensemble_groups(train: DataFrame, test: DataFrame, members: int = 8, seed: int = 0) -> DataFrame:
    """A row for each lineup of the test side: actual, additive and full means, and the ensemble's
    mean, deviation and share above zero."""
    fits, _, _ = chemistry_of(train, members, seed)
    additive = fit_ridge(train)
    rows = gram.scored(design_rows(_lineups(test), train, ("lineup", "offense_player_ids")), additive.table(train.sparkSession)).withColumnRenamed("predicted", "additive")
    return chemistry.group_rows(rows, fits, "lineup")


def lift(stints: DataFrame, side: str = "offense", grid: tuple[float, ...] = linear.LIFT_GRID, permute: int | None = None, base: linear.Fit | None = None) -> DataFrame:
    """member, lift: how much better teammates do beside a player, given additive effects. Defense
    enters the additive fit with a minus sign, and so do its teammates' effects here.

    Stage one is the ridge fit; stage two regresses its residuals on the sum of the four teammates'
    effects for each player present, with a ridge prior whose variance maximises the marginal
    likelihood over the grid. Both stages use statistics of one pass each; ``base`` is the first, if it is known.
    """
    base = fit_ridge(stints) if base is None else base
    tag, members, sign = ("o", "offense_player_ids", 1.0) if side == "offense" else ("d", "defense_player_ids", -1.0)
    alpha = base.table(stints.sparkSession).where(F.col("col").startswith(tag)).select(F.expr("cast(substring(col, 2) as bigint)").alias("member"), F.col("coef").alias("alpha"))
    if permute is not None:
        alpha = profiles.permuted(alpha, "member", "alpha", permute)
    scored = gram.scored(design_rows(stints, keep=(members,)), base.table(stints.sparkSession)).select(members, (F.col("y") - F.col("predicted")).alias("y"), "w")
    s = linear.collect(lift_cells(scored, members, alpha, sign))[None]
    best = linear.evidence(s, base.sigma2, grid)
    return stints.sparkSession.createDataFrame([(int(c[1:]), float(v)) for c, v in zip(s.columns, best)], "member long, lift double")


def lift_rows(residual: DataFrame, alpha: DataFrame, sign: float = 1.0) -> DataFrame:
    """Residuals by member present (stint_id, member, y, w) and effects (member, alpha) to design rows
    with a cell for each member: ``sign`` times the sum of the others' effects."""
    present = residual.join(F.broadcast(alpha), "member", "left").na.fill(0.0, ["alpha"])  # a row for each player of the model
    sums = present.groupBy("stint_id", "y", "w").agg(F.sum("alpha").alias("total"), F.collect_list(F.struct("member", "alpha")).alias("five"))  # five
    cells = F.transform("five", lambda m: F.struct(F.concat(F.lit("l"), m["member"].cast("string")).alias("col"), (sign * (F.col("total") - m["alpha"])).alias("val")))
    return sums.select("stint_id", "y", "w", cells.alias("cells"))


def lift_cells(rows: DataFrame, members: str, alpha: DataFrame, sign: float = 1.0) -> DataFrame:
    """``rows`` with the cells of ``lift_rows``, worked out within the row: effects (member, alpha) are as
    many as the model's players and go to every task; members without one add nothing."""
    known = sorted((int(r[0]), float(r[1] or 0.0)) for r in alpha.select("member", "alpha").collect())
    return chemistry.member_cells(rows, [m for m, _ in known], sign * np.array([[v] for _, v in known]).reshape(-1, 1), members, "l{0}")


def receiver_design(production: DataFrame, credit: float = 0.5) -> DataFrame:
    """Rows (stint_id, receiver, y, w, cells) of (stint_id, game_date, member, fg, ft, assisted, w):
    the receiver's production against the four beside; rows without teammates go."""
    y = F.col("fg") + F.col("ft") + credit * F.col("assisted")
    # A stint's few rows meet in one list, whose rows are made out of it again: one grouping, no join.
    present = production.where("stint_id is not null").groupBy("stint_id").agg(F.collect_list(F.struct("game_date", "member", y.alias("y"), "w")).alias("five"))
    made = present.where("size(filter(five.member, m -> m is not null)) > 1").select("stint_id", F.explode("five").alias("r"), F.col("five.member").alias("members"))
    mates = F.transform(F.filter("members", lambda m: m != F.col("r.member")), lambda m: F.struct(F.concat(F.lit("t"), m.cast("string")).alias("col"), F.lit(1.0).alias("val")))
    own = F.array(F.struct(F.lit("c_intercept").alias("col"), F.lit(1.0).alias("val")), F.struct(F.concat(F.lit("u"), F.col("r.member").cast("string")).alias("col"), F.lit(1.0).alias("val")))
    return made.select("stint_id", "r.game_date", F.col("r.member").alias("receiver"), "r.y", "r.w", F.concat(own, mates).alias("cells"))


def evaluate_receivers(production: DataFrame) -> DataFrame:
    """One row: errors over receivers with and without teammate effects, on rows from the cut date
    on whose receiver and teammates are all known from before it."""
    rows = splits.date_cut(receiver_design(production), "game_date", ["stint_id"])
    train, test = rows.where("side = 'train'"), rows.where("side = 'test'")
    s = linear.collect(train)[None]
    spark = production.sparkSession
    full = linear.ridge(s, 30.0)
    keep = ~s.block(("t",))
    plain = np.zeros(len(full))
    plain[keep] = np.linalg.solve(s.g[np.ix_(keep, keep)] + np.diag(np.where(s.block(("c_",))[keep], 1e-3, 30.0)), s.b[keep])
    # Cells are ones, so a row whose columns are all known counts as many as it has.
    coefs = spark.createDataFrame([(c, float(a), float(b), 1.0) for c, a, b in zip(s.columns, plain, full)], "col string, base double, model double, known double")
    scored = gram.scored(test.withColumn("size", F.size("cells")), coefs).where("known = size")
    return metrics.group_rmse_gain(scored, "receiver", "y", "base", "model", "w")


def kmeans(vectors: DataFrame, key: str, names: list[str], k: int, seed: int = 0, rounds: int = 100) -> DataFrame:
    """key, cluster: k-means++ starts by seeded hash draws, Lloyd rounds in Spark. Only the k
    centres pass through the driver; clusters are numbered by their centres' first feature."""
    spark = vectors.sparkSession
    plain = vectors.select(key, F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
    if plain.count() < k:
        raise ValueError("fewer rows than clusters")
    points = plain.alias("points").persist()
    u = (S.draw(1_000_000, F.lit(seed), F.col(key)) + 1) / 1_000_001
    centres = [points.orderBy(u, key).first()["x"]]

    def nearest(centres):
        d = lambda c: F.aggregate(F.zip_with("x", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        return F.array_min(F.array(*[F.struct(d(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))

    while len(centres) < k:
        # exponential race: the least -ln(u) / d^2 is a draw in proportion to d^2
        race = -F.ln((S.draw(1_000_000, F.lit(seed), F.lit(len(centres)), F.col(key)) + 1) / 1_000_001)
        far = points.withColumn("n", nearest(centres)).where("n.d > 0").orderBy(race / F.col("n.d"), key).first()
        centres.append(far["x"] if far else centres[-1])
    for _ in range(rounds):
        means = points.groupBy(nearest(centres)["i"].alias("i")).agg(*[F.avg(F.get("x", F.lit(j))).alias(f"m{j}") for j in range(len(names))]).collect()  # k rows
        new = list(centres)
        for r in means:
            new[r["i"]] = [r[f"m{j}"] for j in range(len(names))]
        if new == centres:
            break
        centres = new
    centres = sorted(centres)
    points.unpersist()
    return plain.select(key, nearest(centres)["i"].alias("cluster"))


RUNGS = ("0_context", "1_lineup", "2_ridge", "3_hierarchical", "4_interactions")


def rungs(train: DataFrame, test: DataFrame, interacting: bool = False) -> DataFrame:
    """stint_id, lineup, game_id, y, w and each rung's prediction of the test stints: context mean, plus
    shrunk lineup residuals, additive ridge, hierarchical fit, and (``interacting``) that with low-rank
    pair effects of its residuals."""
    spark = train.sparkSession
    keep = ("lineup", "game_id", "offense_player_ids")
    train, test = _lineups(train), _lineups(test)
    fit_rows, rows = design_rows(train, keep=keep), design_rows(test, train, keep)
    s = linear.collect(fit_rows)[None]
    mask = s.block(("c_",))
    zero = np.zeros(len(mask))
    zero[mask] = np.linalg.solve(s.g[np.ix_(mask, mask)] + 1e-3 * np.eye(mask.sum()), s.b[mask])
    fits = {"0_context": zero, "2_ridge": linear.ridge(s, 30.0), "3_hierarchical": linear.expectation_maximisation(s, PLAYERS).on(s.columns)}
    coefs = spark.createDataFrame([(c, *[float(v[i]) for v in fits.values()]) for i, c in enumerate(s.columns)], "col string, " + ", ".join(f"`{n}` double" for n in fits))
    residuals = gram.scored(fit_rows, coefs.select("col", F.col("0_context").alias("coef"))).select("lineup", (F.col("y") - F.col("predicted")).alias("e"), "w")
    shifts = linear.shrunk_lineup_shifts(residuals).select("lineup", "shift")
    scored = gram.scored(rows, coefs).join(shifts, "lineup", "left").withColumn("1_lineup", F.col("0_context") + F.coalesce("shift", F.lit(0.0)))
    if interacting:
        fitted, _, _ = chemistry_of(train)
        scored = chemistry.effects(scored, fitted).withColumn("4_interactions", F.col("3_hierarchical") + F.get("effects", F.lit(0)))
    return scored.select("stint_id", "lineup", "game_id", "y", "w", *RUNGS[: 4 + interacting])


def lineup_shifts(stints: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """lineup, shrinkage, shift: rung 1's shrunk residuals of the context model, perhaps with some of its
    columns only."""
    rows = design_rows(_lineups(stints), keep=("lineup",))
    wanted = (lambda c: c["col"].isin(*[f"c_{n}" for n in names])) if names else (lambda c: c["col"].startswith("c_"))
    rows = rows.withColumn("cells", F.filter("cells", wanted))
    s = linear.collect(rows)[None]
    coefs = stints.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(s.columns, linear.ridge(s, 0.0))], "col string, coef double")
    return linear.shrunk_lineup_shifts(gram.scored(rows, coefs).select("lineup", (F.col("y") - F.col("predicted")).alias("e"), "w"))


def rung_errors(scored: DataFrame, group: str, names: tuple[str, ...]) -> DataFrame:
    """rung, micro_rmse, macro_rmse, rows, groups: all rungs from one pass over rows and one over groups."""
    long = scored.select(group, "y", "w", F.explode(F.array(*[F.struct(F.lit(n).alias("rung"), F.col(n).alias("p")) for n in names])).alias("x")).select(group, "y", "w", "x.rung", "x.p")
    e = F.col("y") - F.col("p")
    groups = long.groupBy("rung", group).agg(F.sum("w").alias("w"), F.sum(F.col("w") * e * e).alias("see"), (F.sum(F.col("w") * e) / F.sum("w")).alias("gap"), F.count(F.lit(1)).alias("n"))
    return groups.groupBy("rung").agg(F.sqrt(F.sum("see") / F.sum("w")).alias("micro_rmse"), metrics.rmse(F.col("gap")).alias("macro_rmse"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"))


def compare_rungs(stints: DataFrame, split: DataFrame) -> DataFrame:
    """rung, micro_rmse, macro_rmse, rows, groups: rungs 0 to 3 of the train side, scored by lineup on
    the test side."""
    if stints.count() < MIN_STINTS:
        raise ValueError(f"at least {MIN_STINTS} stints are needed")
    sided = stints.join(split.where("side <> 'drop'"), "stint_id")
    train, test = sided.where("side = 'train'").drop("side").persist(), sided.where("side = 'test'").drop("side")
    try:
        return rung_errors(rungs(train, test), "lineup", RUNGS[:4])
    finally:
        train.unpersist()


def ladder(stints: DataFrame, holdouts: dict[str, DataFrame], replicates: int = 2000, seed: int = 0) -> DataFrame:
    """holdout, rung, micro_rmse, macro_rmse, groups, and how far the rung's macro error lies under the
    additive ridge's over resampled groups (low, high, share_positive), for rungs 0 to 4 on each split."""
    if stints.count() < MIN_STINTS:
        raise ValueError(f"at least {MIN_STINTS} stints are needed")
    out, schema = [], None
    for name, split in holdouts.items():
        sided = stints.join(split.where("side <> 'drop'"), "stint_id")
        train, test = sided.where("side = 'train'").drop("side").persist(), sided.where("side = 'test'").drop("side")
        scored = rungs(train, test, interacting=True).persist()
        errors = rung_errors(scored, "lineup", RUNGS)
        groups = scored.groupBy("lineup").agg(*[metrics.weighted_mean(c, "w").alias(c) for c in ("y", *RUNGS)])
        square = lambda c: (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))
        drawn = metrics.bootstrap(groups, "lineup", replicates, seed, **{f"s{i}": square(r) for i, r in enumerate(RUNGS)}).persist()
        root = lambda i: F.sqrt(F.col(f"s{i}") / F.col("draws"))
        deltas = None
        for i, rung in enumerate(RUNGS):
            one = metrics.interval(drawn.withColumn("delta", root(2) - root(i)), "delta").withColumn("rung", F.lit(rung))
            deltas = one if deltas is None else deltas.union(one)
        one = errors.join(deltas, "rung").select(F.lit(name).alias("holdout"), "rung", "micro_rmse", "macro_rmse", "groups", "low", "high", "share_positive")
        out, schema = out + one.collect(), one.schema  # a row for each rung
        for held in (drawn, scored, train):
            held.unpersist()
    return stints.sparkSession.createDataFrame(out, schema)


def transport(train: DataFrame, test: DataFrame) -> DataFrame:
    """kind, level, lineups, macro_rmse of the hierarchical fit of one table on another's lineups: by
    novelty, by whether train covers all the lineup's pairs, and by context (rows in place of lineups)."""
    if test.count() < MIN_TRANSPORT:
        raise ValueError(f"at least {MIN_TRANSPORT} test stints are needed")
    fit = fit_hierarchical(train)
    test = _lineups(test)
    scored = gram.scored(design_rows(test, train, ("lineup", "score_margin_offense", "period")), fit.table(train.sparkSession)).persist()
    groups = metrics.grouped(scored, "lineup", "y", "predicted", "w").persist()
    error = metrics.rmse(F.col("actual") - F.col("predicted")).alias("macro_rmse")
    novel = groups.join(splits.novelty(train, test).select("lineup", "novelty"), "lineup").groupBy(F.col("novelty").alias("level")).agg(F.count(F.lit(1)).alias("lineups"), error)
    fives = test.select("lineup", F.array_sort("offense_player_ids").alias("five")).distinct()
    covered = metrics.pair_coverage(groups, fives, contract.pair_exposure(train, MIN_TRANSPORT), "actual", "predicted").select(F.when(F.col("covered"), "covered").otherwise("uncovered").alias("level"), "lineups", F.col("rmse").alias("macro_rmse"))
    context = metrics.by_context(scored, "y", "predicted", "w").select(F.col("context").alias("level"), F.col("rows").alias("lineups"), F.col("rmse").alias("macro_rmse"))
    parts = [d.select(F.lit(k).alias("kind"), "level", "lineups", "macro_rmse") for k, d in (("novelty", novel), ("pairs", covered), ("context", context))]
    out = parts[0].union(parts[1]).union(parts[2])
    rows = out.collect()  # a row for each level
    for held in (groups, scored):
        held.unpersist()
    return train.sparkSession.createDataFrame(rows, out.schema)


def calibrated_groups(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: the calibration report of the hierarchical fit's group predictions."""
    fit = fit_hierarchical(train)
    rows = design_rows(_lineups(test), train, ("lineup",))
    predicted = linear.group_predictive(fit, gram.group_rows(rows, "lineup"), "lineup")
    actual = rows.groupBy("lineup").agg(metrics.weighted_mean("y", "w").alias("actual"))
    return metrics.calibration(predicted.join(actual, "lineup"), "mean", "sd", "actual")


def season_moments(stints: DataFrame) -> DataFrame:
    """season_index, n and the sums of margin and rest and of their squares: they add up over seasons."""
    sums = [F.sum(e).cast("double").alias(n) for n, e in (("m", F.col("score_margin_offense")), ("mm", F.col("score_margin_offense") * F.col("score_margin_offense")), ("r", F.col("days_rest_offense")), ("rr", F.col("days_rest_offense") * F.col("days_rest_offense")))]
    return stints.groupBy("season_index").agg(F.count(F.lit(1)).alias("n"), *sums)


def prefix_scale(moments: DataFrame) -> DataFrame:
    """season_index, n, and means and deviations (zero: 1) of margin and rest over the seasons before it."""
    before = Window.orderBy("season_index").rowsBetween(Window.unboundedPreceding, -1)  # a row for each season
    total = moments.select("season_index", *[F.sum(c).over(before).alias(c) for c in ("n", "m", "mm", "r", "rr")]).where("n IS NOT NULL")
    sd = lambda x, xx: F.sqrt(F.greatest(F.col(xx) / F.col("n") - (F.col(x) / F.col("n")) * (F.col(x) / F.col("n")), F.lit(0.0)))
    one = lambda c: F.when(c > 1e-9, c).otherwise(1.0)
    return total.select("season_index", "n", (F.col("m") / F.col("n")).alias("m_margin"), one(sd("m", "mm")).alias("s_margin"), (F.col("r") / F.col("n")).alias("m_rest"), one(sd("r", "rr")).alias("s_rest"))


_UNSCALED = {"m_margin": 0.0, "s_margin": 1.0, "m_rest": 0.0, "s_rest": 1.0}


def _rescaling(columns: list[str], scale: dict[str, float]) -> np.ndarray:
    """The matrix that makes scaled columns of unscaled ones: margin and rest less their means over
    their deviations, and the scaled margin squared."""
    t, at = np.eye(len(columns)), {c: k for k, c in enumerate(columns)}
    one, m, s = at.get("c_intercept"), scale["m_margin"], scale["s_margin"]
    if one is None:
        return t
    for name, mean, sd in (("c_margin", m, s), ("c_rest", scale["m_rest"], scale["s_rest"])):
        if name in at:
            t[at[name], at[name]], t[at[name], one] = 1 / sd, -mean / sd
    if "c_margin2" in at:
        k = at["c_margin2"]
        t[k, k], t[k, one] = 1 / s**2, m * m / s**2
        if "c_margin" in at:
            t[k, at["c_margin"]] = -2 * m / s**2
    return t


def prefix_fits(stints: DataFrame, min_rows: int = 50) -> tuple[dict[int, linear.Fit], DataFrame, list[int]]:
    """The hierarchical fit of the seasons before each season, all from the same sums: season to fit, whose
    coefficients are those of unscaled columns; the unscaled design; and all seasons.

    A season's statistics are mergeable, and those before a cutover are a running total. Each cutover
    has its own context scale, which follows from the seasons' moments; as scaled columns are sums of
    unscaled ones, its statistics do too.
    """
    fits, seasons, *_ = _prefix_fits(stints, min_rows)
    return fits, gram.design(stints, _unscaled_context(seasons), ("season_index", "offense_team_id", "offense_player_ids")), seasons


def _unscaled_context(seasons: list[int]) -> dict[str, Column]:
    return gram.context_columns(seasons, {k: F.lit(v) for k, v in _UNSCALED.items()})


def _prefix_fits(stints: DataFrame, min_rows: int) -> tuple[dict[int, linear.Fit], list[int], DataFrame, DataFrame]:
    """The fits and seasons of ``prefix_fits``, and the sums over members and pairs that they come from."""
    moments = season_moments(stints)
    moments = stints.sparkSession.createDataFrame(moments.orderBy("season_index").collect(), moments.schema)  # a row for each season
    seasons = [r[0] for r in moments.collect()]
    if len(seasons) < 2:
        raise ValueError("at least two seasons are needed")
    scales = {r["season_index"]: r.asDict() for r in prefix_scale(moments).collect()}
    parts = zip(gram.season_parts(stints, _unscaled_context(seasons)), ("contexts", "members", "pairs"))
    contexts, members, pairs = (materialise(p, label) for p, label in parts)  # each is read several times
    parts = linear.fetched(gram.season_sums(contexts, members, pairs), ["y"], "season_index")["y"]
    fits, before = {}, None
    for season in seasons:
        if before is not None and before.n >= min_rows:
            seen = linear.cut(before, np.diag(before.g) > 0)
            t = _rescaling(seen.columns, scales[season])
            fit = linear.expectation_maximisation(replace(seen, g=t @ seen.g @ t.T, b=t @ seen.b), PLAYERS)
            fits[season] = replace(fit, columns=seen.columns, coef=t.T @ fit.on(seen.columns))
        if season in parts:
            before = parts[season] if before is None else linear.total([before, parts[season]])
    return fits, seasons, members, pairs


def backtest(stints: DataFrame, threshold: int = 50, min_rows: int = 50) -> DataFrame:
    """cohort, season_index, player_id, delta: realised less predicted rating after moves and for the
    phantom cohort, by the fit of the seasons before each. The fits and all predictions come from the
    same sums, which are plain groupings; no stint is predicted by itself."""
    fits, _, members, pairs = _prefix_fits(stints, min_rows)
    if not fits:
        raise ValueError("no season has enough rows before it")
    kind = stints.schema["season_index"].dataType.simpleString()
    table = stints.sparkSession.createDataFrame([(season, c, float(v)) for season, f in fits.items() for c, v in zip(f.columns, f.coef)], f"season_index {kind}, col string, coef double")  # columns x seasons
    scored = gram.member_scores(members, pairs, table).select("season_index", F.col("team").cast("string").alias("to_team"), F.col("player").alias("player_id"), "y", "w", "predicted")
    return move_deltas(scored, stints, threshold)


def move_deltas(scored: DataFrame, stints: DataFrame, threshold: int) -> DataFrame:
    """cohort, season_index, player_id, delta of rows (season_index, to_team, player_id, y, w,
    predicted): weighted mean of y less that of the prediction for players who moved to a team between two seasons,
    in the later one, and for those who stayed (the phantom cohort)."""
    exposure = stints.select(F.explode("offense_player_ids").alias("player_id"), "season_index", F.col("offense_team_id").cast("string").alias("team"), F.col("offensive_possessions").cast("long").alias("possessions"))
    exposure = materialise(exposure.groupBy("player_id", "season_index", "team").agg(F.sum("possessions").alias("possessions")), "exposure")  # read four times
    moved = None
    for cohort, changed in (("real", True), ("phantom", False)):
        one = profiles.moves(exposure, threshold, changed).select(F.lit(cohort).alias("cohort"), "player_id", (F.col("season_index") + 1).alias("season_index"), "to_team")
        moved = one if moved is None else moved.union(one)
    delta = (metrics.weighted_mean("y", "w") - metrics.weighted_mean("predicted", "w")).alias("delta")
    return scored.join(moved, ["player_id", "season_index", "to_team"]).groupBy("cohort", "season_index", "player_id").agg(delta)


def synthetic(spark: SparkSession, players: int = 60, stints: int = 2000, seed: int = 0, truth_sd: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(stints, truth): stints of known player effects, all draws by hash; truth is (member, effect)."""
    unit = lambda *k: (S.draw(1_000_000, F.lit(seed), *k) + 0.5) / 1_000_000
    normal = lambda *k: F.sqrt(-2 * F.ln(unit(*k, F.lit("r")))) * F.cos(2 * np.pi * unit(*k, F.lit("t")))
    truth = spark.range(players).select(F.col("id").alias("member"), (truth_sd * normal(F.col("id"))).alias("effect"))
    seats = spark.range(stints).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(players - 1))).alias("p")).select("s", F.col("p").cast("long").alias("member"), unit(F.col("s"), F.col("p")).alias("u"))
    half = players // 2
    pick = lambda low, high: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("member").between(low, high), F.struct("u", "member")))), lambda x: x["member"]), 1, 5)
    fives = seats.groupBy("s").agg(F.array_sort(pick(0, half - 1)).alias("o"), F.array_sort(pick(half, players - 1)).alias("d"))
    gains = fives.select("s", F.explode(F.col("o")).alias("member")).join(truth, "member").groupBy("s").agg(F.sum("effect").alias("go"))
    losses = fives.select("s", F.explode(F.col("d")).alias("member")).join(truth, "member").groupBy("s").agg(F.sum("effect").alias("gd"))
    rows = fives.join(gains, "s").join(losses, "s")
    poss = (20 + S.draw(30, F.lit(seed), F.col("s"), F.lit("n"))).cast("int")
    rating = 110 + F.col("go") - F.col("gd") + 20 * normal(F.col("s"), F.lit("e"))
    table = rows.select(
        F.concat(F.lit("s"), F.col("s").cast("string")).alias("stint_id"), F.concat(F.lit("g"), F.lpad((F.col("s") % 200).cast("string"), 4, "0")).alias("game_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s") % 200).cast("int")).alias("game_date"),
        F.when(F.col("s") % 200 < 100, "2020").otherwise("2021").alias("season"), F.when(F.col("s") % 200 < 100, 0).otherwise(1).alias("season_index"), (F.col("s") % 4 + 1).cast("int").alias("period"), (F.col("s") % 700).cast("double").alias("start_time_seconds"),
        (F.col("s") % 8).alias("offense_team_id"), (100 + F.col("s") % 8).alias("defense_team_id"), F.col("o").alias("offense_player_ids"), F.col("d").alias("defense_player_ids"), poss.alias("offensive_possessions"),
        F.greatest(F.lit(0), F.round(rating * poss / 100)).cast("int").alias("points_scored"), (F.col("s") % 2 == 0).alias("home_offense"), (F.col("s") % 21 - 10).cast("int").alias("score_margin_offense"), F.lit(False).alias("playoff"), (F.col("s") % 3).cast("int").alias("days_rest_offense"), F.lit(1.0).alias("garbage_time_weight"),
    )
    return table, truth


def predict_lineups(fit: linear.Fit, lineups: DataFrame) -> DataFrame:
    """lineup, mean, sd, 80 and 95 % bounds and known members of hypothetical offenses (lineup,
    five, weight): talent only, the context at its baseline."""
    if not lineups.where("size(array_distinct(five)) <> 5").isEmpty():
        raise ValueError("a lineup has five different members")
    own = F.transform("five", lambda p: F.struct(F.concat(F.lit("o"), p.cast("string")).alias("col"), F.lit(1.0).alias("val")))
    cells = lineups.select("lineup", "weight", F.explode(F.concat(F.array(F.struct(F.lit("c_intercept").alias("col"), F.lit(1.0).alias("val"))), own)).alias("c")).select("lineup", "weight", F.col("c.col").alias("col"), F.col("c.val").alias("val"))
    known = cells.join(fit.table(lineups.sparkSession).select("col", F.lit(1).alias("k")), "col", "left").where("col <> 'c_intercept'").groupBy("lineup").agg(F.count("k").alias("known_members"))
    out = linear.group_predictive(fit, cells, "lineup").join(known, "lineup")
    z80, z95 = metrics.LEVELS["80"], metrics.LEVELS["95"]
    return out.select("lineup", "mean", "sd", *[(F.col("mean") + s * z * F.col("sd")).alias(f"{n}_{k}") for k, z in (("80", z80), ("95", z95)) for n, s in (("low", -1), ("high", 1))], "known_members")


def ridge_band(train: DataFrame, test: DataFrame, replicates: int = 20, seed: int = 3, penalty: float = 30.0) -> DataFrame:
    """lineup, weight, point, sd: the additive ridge's group predictions, with the spread of fits over
    resampled games and the noise of a group's own weight: sqrt(variance + sigma^2 / weight). A game's
    rows weigh as often as it was drawn, so all replicates' statistics come from one pass, in which a row stands once."""
    spark = train.sparkSession
    rows = design_rows(train, keep=("game_id",))
    base = linear.collect(rows)[None]
    coef = linear.ridge(base, penalty)
    drawn = metrics.draws(train.select("game_id").distinct(), "game_id", replicates, seed).select("game_id", "replicate", "times")
    drawn = drawn.groupBy("game_id").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "times"))).alias("times"))  # a game's replicates
    names = [f"w{k}" for k in range(replicates)]
    weighed = rows.join(drawn, "game_id").select("y", "cells", *[(F.col("w") * F.coalesce(F.try_element_at("times", F.lit(k)), F.lit(0))).alias(n) for k, n in enumerate(names)])
    parts = {n: found[None] for n, found in linear.collect_many(weighed, {n: ("y", n) for n in names}).items() if found[None].n}
    at = {c: i for i, c in enumerate(base.columns)}
    fits = np.zeros((len(parts), len(coef)))
    for k, s in enumerate(parts.values()):
        fits[k, [at[c] for c in s.columns]] = linear.ridge(s, penalty)
    table = spark.createDataFrame([(c, float(coef[i]), *map(float, fits[:, i])) for c, i in at.items()], "col string, point double, " + ", ".join(f"r{k} double" for k in range(len(parts))))
    scored = gram.scored(design_rows(_lineups(test), train, ("lineup",)), table)
    groups = scored.groupBy("lineup").agg(F.sum("w").alias("weight"), metrics.weighted_mean("point", "w").alias("point"), *[metrics.weighted_mean(f"r{k}", "w").alias(f"r{k}") for k in range(len(parts))])
    sigma2 = base.residual(coef) / float(base.sw)
    spread = groups.select("lineup", "weight", "point", F.explode(F.array(*[f"r{k}" for k in range(len(parts))])).alias("r")).groupBy("lineup", "weight", "point").agg(F.var_samp("r").alias("v"))
    return spread.select("lineup", "weight", "point", F.sqrt(F.coalesce("v", F.lit(0.0)) + F.lit(sigma2) / F.col("weight")).alias("sd"))


def evaluate_lift(train: DataFrame, test: DataFrame, side: str = "offense", permute: int = 23) -> DataFrame:
    """model, macro_rmse, micro_rmse: the additive ridge, with players' lift of their teammates added, and
    with the lift of effects dealt out anew, by lineup on the test side."""
    base = fit_ridge(train)
    spark = train.sparkSession
    tag, members, sign = ("o", "offense_player_ids", 1.0) if side == "offense" else ("d", "defense_player_ids", -1.0)
    alpha = base.table(spark).where(F.col("col").startswith(tag)).select(F.expr("cast(substring(col, 2) as bigint)").alias("member"), F.col("coef").alias("alpha"))
    scored = gram.scored(design_rows(_lineups(test), train, ("lineup", members)), base.table(spark)).withColumnRenamed("predicted", "base")
    for name, dealt in (("lift", None), ("lift_placebo", permute)):
        found = lift(train, side, permute=dealt, base=base)
        used = alpha if dealt is None else profiles.permuted(alpha, "member", "alpha", dealt)
        coefs = found.select(F.concat(F.lit("l"), F.col("member").cast("string")).alias("col"), F.col("lift").alias("extra"))
        scored = gram.scored(lift_cells(scored, members, used, sign), coefs).withColumn(name, F.col("base") + F.col("extra")).drop("extra")
    names = ("base", "lift", "lift_placebo")
    return rung_errors(scored, "lineup", names).select(F.col("rung").alias("model"), "macro_rmse", "micro_rmse")


def mechanistic(train: DataFrame, test: DataFrame, counts: DataFrame, outcome: str, minimum: int = 1) -> DataFrame:
    """One row: errors of an outcome's additive fit (its own denominators as weights) by lineup, of the
    training mean, and its gain over that. ``test`` may be another table, for transport."""
    return _mechanistic(train, test, counts, [outcome], minimum).drop("outcome")


def mechanistic_outcomes(train: DataFrame, test: DataFrame, counts: DataFrame, minimum: int = 1) -> DataFrame:
    """``mechanistic`` for every outcome whose columns ``counts`` has, a row each."""
    return _mechanistic(train, test, counts, [n for n, (top, bottom) in profiles.OUTCOMES.items() if top in counts.columns and bottom in counts.columns], minimum)


def outcome_columns(outcomes: list[str], minimum: int) -> list[Column]:
    """y0, w0, y1, ...: value and weight of each outcome of a table of counters, null under ``minimum``
    of its own denominator."""
    out = []
    for k, name in enumerate(outcomes):
        top, bottom = (F.coalesce(F.col(c), F.lit(0)) for c in profiles.OUTCOMES[name])
        sound = bottom.cast("double") >= minimum
        out += [F.when(sound, S.safe_ratio(top, bottom)).alias(f"y{k}"), F.when(sound, bottom.cast("double")).alias(f"w{k}")]
    return out


def _mechanistic(train: DataFrame, test: DataFrame, counts: DataFrame, outcomes: list[str], minimum: int) -> DataFrame:
    """A row for each outcome. Each outcome is a response with weights of its own, so one pass over the
    train side gives all statistics, and one over the test side all predictions and errors."""
    spark, each = train.sparkSession, range(len(outcomes))
    valued = counts.select("stint_id", *outcome_columns(outcomes, minimum))
    rows = lambda s: design_rows(_lineups(s), train, ("lineup",)).drop("y", "w").join(valued, "stint_id")
    found = linear.collect_many(rows(train), {f"m{k}": (f"y{k}", f"w{k}") for k in each})
    stats = [found[f"m{k}"][None] for k in each]
    columns = stats[0].columns
    coefs = np.stack([linear.ridge(s, 30.0) for s in stats], axis=1)
    table = spark.createDataFrame([(c, *map(float, v)) for c, v in zip(columns, coefs)], "col string, " + ", ".join(f"m{k} double" for k in each))
    one = columns.index("c_intercept")
    means = [float(s.b[one] / s.g[one, one]) if s.g[one, one] else 0.0 for s in stats]
    cells = [F.struct(F.lit(n).alias("outcome"), F.col(f"y{k}").alias("y"), F.col(f"w{k}").alias("w"), F.lit(means[k]).alias("base"), F.col(f"m{k}").alias("model")) for k, n in enumerate(outcomes)]
    long = gram.scored(rows(test), table).select("lineup", F.explode(F.array(*cells)).alias("x")).select("lineup", "x.*").where("y is not null and w is not null")
    error, total = F.col("y") - F.col("model"), F.sum("w")
    groups = long.groupBy("outcome", "lineup").agg(F.count(F.lit(1)).alias("n"), total.alias("w"), F.sum(F.col("w") * error * error).alias("see"), F.sum(F.col("w") * F.abs(error)).alias("sae"), *[metrics.weighted_mean(c, "w").alias(c) for c in ("y", "base", "model")])
    gap, several = F.col("y") - F.col("model"), F.when(F.col("n") >= 2, F.col("w"))
    shared = lambda c: F.sqrt(F.sum(several * (F.col("y") - F.col(c)) * (F.col("y") - F.col(c))) / F.sum(several))
    out = groups.groupBy("outcome").agg(
        F.sqrt(F.sum("see") / total).alias("micro_rmse"), (F.sum("sae") / total).alias("micro_mae"), F.sum("n").alias("rows"), metrics.rmse(gap).alias("macro_rmse"), F.avg(F.abs(gap)).alias("macro_mae"), F.count(F.lit(1)).alias("groups"), shared("base").alias("base_rmse"), shared("model").alias("model_rmse"),
    )
    return out.select("micro_rmse", "micro_mae", "rows", "macro_rmse", "macro_mae", "groups", "base_rmse", "model_rmse", (F.col("base_rmse") - F.col("model_rmse")).alias("gain"), "outcome")


def pair_stability(parts: list[DataFrame], strengths: tuple[float, ...] = (8.0, 25.0, 70.0)) -> DataFrame:
    """first, second, strength, groups, correlation: whether pair effects fitted on one part of the data
    come back on another, over the pairs that both have."""
    fits = [residual_rows(p).persist() for p in parts]
    met = [pairs_met(p) for p in parts]
    out = None
    for value in strengths:
        effects = [interactions(chemistry.low_rank(f, strength=value), m).select(S.pair_id("a", "b").alias("pair"), "effect") for f, m in zip(fits, met)]
        for i in range(len(effects)):
            for j in range(i + 1, len(effects)):
                one = metrics.mediation(effects[i], effects[j], "pair", "effect").select(F.lit(i).alias("first"), F.lit(j).alias("second"), F.lit(value).alias("strength"), "groups", "correlation")
                out = one if out is None else out.union(one)
    for f in fits:
        f.unpersist()
    return out


def compare_lineups(fit: linear.Fit, first: list[int], second: list[int], spark: SparkSession, weight: float = 100.0) -> DataFrame:
    """One row: two offenses' predictions, their difference, its sd (shared terms cancel) and the
    chance that the first is better."""
    if len(set(first)) != 5 or len(set(second)) != 5:
        raise ValueError("a lineup has five different members")
    at = {c: k for k, c in enumerate(fit.columns)}
    x = np.zeros((2, len(at)))
    for row, five in enumerate((first, second)):
        for c in ("c_intercept", *(f"o{p}" for p in five)):
            if c in at:
                x[row, at[c]] = 1.0
    gap = x[0] - x[1]
    spread = float((np.linalg.solve(fit.covariance_factor, gap) ** 2).sum()) + 2 * fit.sigma2 / weight
    mean, sd = float(gap @ fit.coef), float(np.sqrt(spread))
    better = 0.5 * (1 + math.erf(mean / (sd * math.sqrt(2)))) if sd else float(mean > 0)
    return spark.createDataFrame([(float(x[0] @ fit.coef), float(x[1] @ fit.coef), mean, sd, better)], "first double, second double, difference double, sd double, p_first double")


def matchup(fit: linear.Fit, offense: list[int], defense: list[int], spark: SparkSession, weight: float = 100.0) -> DataFrame:
    """One row: an offense's prediction against a defense, with its talent and context parts, 80 and
    95 % bounds, and how many of either five the fit knows."""
    if len(set(offense)) != 5 or len(set(defense)) != 5 or set(offense) & set(defense):
        raise ValueError("two disjoint lineups of five different members are needed")
    at = {c: k for k, c in enumerate(fit.columns)}
    x = np.zeros(len(at))
    for c, v in [("c_intercept", 1.0), *((f"o{p}", 1.0) for p in offense), *((f"d{p}", -1.0) for p in defense)]:
        if c in at:
            x[at[c]] = v
    part = lambda tag: float(sum(x[k] * fit.coef[k] for c, k in at.items() if c.startswith(tag)))
    mean, sd = float(x @ fit.coef), math.sqrt(float((np.linalg.solve(fit.covariance_factor, x) ** 2).sum()) + fit.sigma2 / weight)
    bounds = [mean + sign * metrics.LEVELS[k] * sd for k in ("80", "95") for sign in (-1, 1)]
    known = [sum(f"{tag}{p}" in at for p in five) for tag, five in (("o", offense), ("d", defense))]
    names = "context double, offense double, defense double, mean double, sd double, low_80 double, high_80 double, low_95 double, high_95 double, known_offense int, known_defense int"
    return spark.createDataFrame([(part("c_"), part("o"), part("d"), mean, sd, *bounds, *known)], names)


def strongest(coefficients: DataFrame, n: int, prefix: str = "", value: str = "coef") -> DataFrame:
    """The n columns of greatest size that start with ``prefix``, ties by name."""
    return coefficients.where(F.col("col").startswith(prefix)).orderBy(F.desc(F.abs(F.col(value))), "col").limit(n)
