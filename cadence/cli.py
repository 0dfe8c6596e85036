"""Command line: each verb reads tables with Spark, runs an operator or model, and writes a table.

    python -m cadence.cli lineups --stints stints.jsonl --out out/ --minimum 200
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import contract, profiles, splits
from .plans import confirmation, evaluation, ingest, models, report, suite
from .sources import archive, records


KINDS = ("chronological", "unseen_lineup", "unseen_pair")


def _session() -> SparkSession:
    return SparkSession.builder.appName("cadence").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _validate(a, s: DataFrame) -> DataFrame:
    return contract.violations(s)


def _split(a, s: DataFrame) -> DataFrame:
    if a.kind == "chronological":
        return splits.chronological(s, a.fraction)
    if a.kind == "all":
        parts = [_split(argparse.Namespace(**{**vars(a), "kind": k}), s).select(F.lit(k).alias("kind"), "stint_id", "side") for k in KINDS]
        return parts[0].union(parts[1]).union(parts[2])
    if a.kind == "unseen_lineup":
        return splits.hold_out_lineups(s, splits.unseen_lineups(s, a.count))
    return splits.hold_out_pairs(s, s.sparkSession.createDataFrame(splits.unseen_pairs(s, a.count), "a long, b long"))


def _fit(a, s: DataFrame) -> DataFrame:
    fit = {"ridge": models.fit_ridge, "hierarchical": models.fit_hierarchical, "pairs": lambda x: models.fit_pairs(x, a.minimum)}[a.model](s)
    if a.save:
        records.save_fit(fit, s.sparkSession, a.save)
    return fit.table(s.sparkSession)


def _predict(a, s: DataFrame) -> DataFrame:
    from .operators import gram

    fit = records.load_fit(s.sparkSession, a.fit)
    return gram.predict(models.design_rows(s), fit.table(s.sparkSession))


def _halves(a, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The second table, if given, is the test side; else the later part of the first."""
    if a.test:
        return s, records.read_stints(s.sparkSession, a.test)
    sided = s.join(splits.chronological(s, a.fraction), "stint_id")
    return sided.where("side = 'train'").drop("side"), sided.where("side = 'test'").drop("side")


def _table(a, s: DataFrame, name: str) -> DataFrame:
    path = getattr(a, name)
    if not path:
        raise ValueError(f"this verb needs --{name}")
    return s.sparkSession.read.parquet(path)


def _ladder(a, s: DataFrame) -> DataFrame:
    return models.ladder(s, {k: _split(argparse.Namespace(**{**vars(a), "kind": k}), s) for k in KINDS})


def _roles(a, s: DataFrame) -> DataFrame:
    v = _table(a, s, "features")
    return models.kmeans(v, "member", [c for c in v.columns if c != "member"], a.count)


def _confirm(a, s: DataFrame) -> DataFrame:
    held = s.sparkSession.createDataFrame(splits.unseen_pairs(s, a.count), "a long, b long")
    holdouts = {"unseen_lineup": (splits.hold_out_lineups(s, splits.unseen_lineups(s, 120)), "lineup", None), "unseen_pair": (splits.hold_out_pairs(s, held), "pair", held)}
    roles = _table(a, s, "roles")
    k = (roles.agg(F.max("role")).first()[0] or 0) + 1
    outcomes = (a.outcome,) if a.outcomes else ()
    return confirmation.confirm(s, holdouts, {k: roles}, _table(a, s, "features"), _table(a, s, "outcomes") if a.outcomes else None, outcomes)[0]


def _suite(a, s: DataFrame) -> DataFrame:
    held = s.sparkSession.createDataFrame(splits.unseen_pairs(s, a.count), "a long, b long")
    kinds = {"chronological": (splits.chronological(s, a.fraction), "month", None), "unseen_lineup": (splits.hold_out_lineups(s, splits.unseen_lineups(s, a.count)), "lineup", None)}
    if not held.isEmpty():
        kinds["unseen_pair"] = (splits.hold_out_pairs(s, held), "pair", held)
    return suite.evaluate(s, kinds)


def _stability(a, s: DataFrame) -> DataFrame:
    seasons = [r[0] for r in s.select("season_index").distinct().orderBy("season_index").collect()]  # a few
    return models.pair_stability([s.where(F.col("season_index") == k) for k in seasons])


def _against(a, s: DataFrame) -> DataFrame:
    fit = records.load_fit(s.sparkSession, a.fit)
    five = lambda text: [int(x) for x in (text or "").split(",") if x]
    if a.defense:
        return models.matchup(fit, five(a.first), five(a.defense), s.sparkSession)
    return models.compare_lineups(fit, five(a.first), five(a.second), s.sparkSession)


def _compare(a, s: DataFrame) -> DataFrame:
    return models.compare_rungs(s, splits.chronological(s, a.fraction))


def _decompose(a, s: DataFrame) -> DataFrame:
    fit = records.load_fit(s.sparkSession, a.fit)
    return evaluation.decomposed(models.design_rows(s), fit.table(s.sparkSession))


def _examples(a, s: DataFrame) -> DataFrame:
    train, test = _halves(a, s)
    return evaluation.unseen_examples(train, test, models.fit_ridge(train).table(s.sparkSession), a.count)


def _carried(a, s: DataFrame) -> DataFrame:
    roles = _table(a, s, "roles")
    return evaluation.transport_outcome(*_halves(a, s), _table(a, s, "outcomes"), roles, a.count, a.outcome)


def _ingest(a, spark: SparkSession) -> None:
    ingest.write(ingest.ingest(spark.read.parquet(a.stints), spark.read.parquet(a.games)), a.out)


VERBS = {
    "validate": (_validate, "rows that break the contract"),
    "lineups": (lambda a, s: contract.lineup_observations(s, a.minimum, a.game, a.team, a.player), "observed lineups"),
    "pool": (lambda a, s: contract.player_pool(s), "players by team"),
    "overview": (lambda a, s: contract.overview(s), "totals"),
    "exposure": (lambda a, s: contract.player_exposure(s), "possessions by player"),
    "pairs": (lambda a, s: contract.pair_exposure(s, a.minimum), "pairs by shared stints"),
    "split": (_split, "a train/test split"),
    "fit": (_fit, "a model's coefficients"),
    "predict": (_predict, "a saved model's predictions"),
    "compare": (_compare, "the model ladder on a chronological split"),
    "interactions": (lambda a, s: models.bootstrap_interactions(s, a.count), "pair effects with intervals"),
    "lift": (lambda a, s: models.lift(s, a.side), "players' lift of their teammates"),
    "backtest": (lambda a, s: models.backtest(s, a.minimum), "moves against predictions"),
    "ladder": (_ladder, "the model ladder on all three splits, with intervals"),
    "transport": (lambda a, s: models.transport(*_halves(a, s)), "one table's fit on another"),
    "calibrate": (lambda a, s: models.calibrated_groups(*_halves(a, s)), "calibration of group predictions"),
    "roles": (_roles, "clusters of players' features"),
    "redundancy": (lambda a, s: confirmation.compare(*_halves(a, s), _table(a, s, "roles"), a.count, a.minimum, _table(a, s, "features")), "interaction terms and placebos"),
    "evaluate_lift": (lambda a, s: models.evaluate_lift(*_halves(a, s), a.side), "lift against its placebo"),
    "mechanistic": (lambda a, s: models.mechanistic_outcomes(*_halves(a, s), _table(a, s, "outcomes")), "outcomes' own fits"),
    "receivers": (lambda a, s: models.evaluate_receivers(_table(a, s, "production")), "teammates' effects on receivers"),
    "confirm": (_confirm, "role and redundancy models against placebos on held-out lineups and pairs, with intervals"),
    "stability": (_stability, "whether pair effects of a season come back in others"),
    "against": (_against, "two lineups against each other, or an offense against a defense"),
    "totals": (lambda a, s: contract.selection_totals(s, a.minimum, a.game, a.team, a.player), "totals of a selection"),
    "decompose": (_decompose, "talent, context and residual under a saved model"),
    "examples": (_examples, "lineups never seen before, with what their predictions are made of"),
    "production": (lambda a, s: evaluation.evaluate_production(_table(a, s, "production")), "receivers' own level and their teammates' lift"),
    "outcome_transport": (_carried, "an outcome's role model on another table"),
    "ingest": (None, "possessions (Parquet at --stints) and --games to stints, quarantine and manifest"),
    "suite": (_suite, "additive against full model on all three splits"),
    "intervals": (lambda a, s: models.lineup_intervals(s, s.select("offense_player_ids").distinct(), a.count), "the interaction's effect on every lineup, with intervals"),
    "convert": (None, "the providers' CSV files of --archive to a snapshot, with index and provenance"),
    "manifest": (None, "rows, possessions and file hashes of --stints, as JSON"),
    "strongest": (lambda a, s: models.strongest(_fit(a, s), a.count), "the coefficients of greatest size"),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cadence", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("verb", choices=VERBS, help="; ".join(f"{k}: {v[1]}" for k, v in VERBS.items()))
    p.add_argument("--stints")
    p.add_argument("--archive", help="folders of provider CSV files, comma-joined")
    p.add_argument("--out", required=True, help="folder of the Parquet result")
    p.add_argument("--report", help="also write the first rows as an HTML page")
    p.add_argument("--minimum", type=int, default=200)
    p.add_argument("--count", type=int, default=8)
    p.add_argument("--fraction", type=float, default=0.6)
    p.add_argument("--kind", choices=(*KINDS, "all"), default="chronological")
    p.add_argument("--model", choices=("ridge", "hierarchical", "pairs"), default="ridge")
    p.add_argument("--side", choices=("offense", "defense"), default="offense")
    p.add_argument("--game")
    p.add_argument("--team", type=int)
    p.add_argument("--player", type=int)
    p.add_argument("--test", help="a second table of stints, for the test side")
    p.add_argument("--roles", help="Parquet of (member, role)")
    p.add_argument("--features", help="Parquet of (member, features)")
    p.add_argument("--outcomes", help="Parquet of (stint_id, counts)")
    p.add_argument("--outcome", default="three_share", choices=tuple(profiles.OUTCOMES), help="which outcome is carried over")
    p.add_argument("--games", help="Parquet of (game_id, team, points)")
    p.add_argument("--production", help="Parquet of (stint_id, game_date, member, fg, ft, assisted, w)")
    p.add_argument("--first", help="five ids, comma-joined")
    p.add_argument("--second", help="five ids, comma-joined")
    p.add_argument("--defense", help="five ids, comma-joined")
    p.add_argument("--save", help="where fit keeps the model")
    p.add_argument("--fit", help="the model that predict reads")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = _session()
    try:
        if a.verb == "convert":
            if not a.archive:
                raise ValueError("this verb needs --archive")
            archive.convert_archive(spark, a.archive.split(","), a.out)
            return 0
        if not a.stints:
            raise ValueError("this verb needs --stints")
        if a.verb == "manifest":
            with open(a.out, "w", encoding="utf-8") as f:
                json.dump(records.stints_manifest(spark, a.stints), f, sort_keys=True)
            return 0
        if a.verb == "ingest":
            if not a.games:
                raise ValueError("this verb needs --games")
            _ingest(a, spark)
            return 0
        stints = records.read_stints(spark, a.stints)
        out = VERBS[a.verb][0](a, stints)
        out.write.mode("overwrite").parquet(a.out)
        if a.report:
            with open(a.report, "w", encoding="utf-8") as f:
                f.write(report.page(a.verb, report.table(spark.read.parquet(a.out), VERBS[a.verb][1])))
    except ValueError as e:
        print(f"cadence: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
