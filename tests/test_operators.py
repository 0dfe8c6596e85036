"""Operators on hand-made tables: contract rules, runs, windows, gates, validation."""

import datetime

import pytest
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import contract, gram, intervals, metrics, ordered, profiles, reconcile, splits
from cadence.plans import ingest

GOOD = ("s1", "g1", "2024-01-02", "2024", 0, 1, 0.0, 1, 2, [5, 4, 3, 2, 1], [6, 7, 8, 9, 10], 10, 20, True, 0, False, 1, 1.0, "x", 2)


def stints(spark, *changes):
    base = dict(zip(contract.SCHEMA.names, GOOD))
    rows = [tuple((base | {"stint_id": f"s{i}"} | c)[n] for n in contract.SCHEMA.names) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, contract.SCHEMA)


def test_each_rule_is_reported(spark):
    broken = {
        "offense_not_five": {"offense_player_ids": [1, 1, 2, 3, 4]},
        "defense_not_five": {"defense_player_ids": None},
        "lineups_overlap": {"defense_player_ids": [1, 7, 8, 9, 10]},
        "no_possessions": {"offensive_possessions": 0},
        "negative_points": {"points_scored": -1},
        "bad_period": {"period": 0},
        "bad_weight": {"garbage_time_weight": 1.5},
        "bad_season_index": {"season_index": -1},
        "same_team": {"defense_team_id": 1},
        "bad_date": {"game_date": "2024-13-01"},
    }
    found = {r.stint_id: r.reason for r in contract.violations(stints(spark, {}, *broken.values())).collect()}
    assert found == {f"s{i + 1}": k for i, k in enumerate(broken)}
    assert {r.reason for r in contract.violations(stints(spark, {"stint_id": "a"}, {"stint_id": "a"})).collect()} == {"duplicate_id"}


def test_rates_come_from_totals(spark):
    s = stints(spark, {"offensive_possessions": 10, "points_scored": 20}, {"offensive_possessions": 30, "points_scored": 30, "offense_player_ids": [1, 2, 3, 4, 5]})
    one = contract.lineup_observations(s, 1).collect()
    assert len(one) == 1 and one[0].lineup == "1-2-3-4-5" and one[0].rating == 125.0 and one[0].stints == 2
    assert contract.lineup_observations(s, 41).count() == 0
    with pytest.raises(ValueError):
        contract.lineup_observations(s, 0)


def test_ids_sort_by_number(spark):
    r = spark.range(1).select(S.lineup_id(F.array(F.lit(10), F.lit(9), F.lit(100))).alias("l"), S.pair_id(F.lit(10), F.lit(9)).alias("p")).first()
    assert (r.l, r.p) == ("9-10-100", "9-10")


def test_scalars(spark):
    r = spark.sql("select '11:05' as a, 'x:1' as b, '20240203' as c, '2024-02-03T00:00' as d, 'no' as e, '22100123' as g").select(
        S.clock_seconds("a").alias("a"), S.clock_seconds("b").alias("b"), S.iso_date("c").alias("c"), S.iso_date("d").alias("d"), S.iso_date("e").alias("e"), S.season_of(S.game_id("g")).alias("g"),
        S.garbage_weight(F.lit(4), F.lit(299), F.lit(-26)).alias("w"), S.role_pair_bin(F.lit(2), F.lit(1), 4).alias("bin"),
    ).first()
    day = datetime.date(2024, 2, 3)
    assert tuple(r) == (665.0, None, day, day, None, "2021-22", 0.2, 5)
    every = {spark.range(1).select(S.role_pair_bin(F.lit(a), F.lit(b), 4).alias("x")).first().x for a in range(4) for b in range(a, 4)}
    assert every == set(range(10))


def test_a_gap_breaks_a_run(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 4, "a"), (1, 5, "b"), (2, 1, "a"), (1, 6, None), (1, 7, None)], "g int, s int, k string")
    assert [r.run for r in ordered.runs(df, ["g"], ["k"], "s").orderBy("g", "s").collect()] == [1, 1, 2, 3, 4, 4, 1]


def test_windows_ties_and_tail(spark):
    w = spark.createDataFrame([(1, 10, 0.0), (2, 10, 300.0), (3, 10, 300.0), (4, 20, 0.0)], "window_id int, team int, start double")
    spans = intervals.spans(w, ["team"], "start", "window_id", F.lit(720.0))
    events = spark.createDataFrame([(1, 10, 5.0), (2, 10, 300.0), (3, 10, 720.3), (4, 10, 721.0), (5, 20, 719.0), (6, 30, 1.0), (7, 10, -0.5)], "event int, team int, at double")
    found = intervals.attribute(events, spans, ["team"], "at", "start", "window_id")
    assert {r.event: r.window_id for r in found.collect()} == {1: 1, 2: 3, 3: 3, 4: None, 5: 4, 6: None, 7: None}
    c = intervals.coverage(found, "window_id").first()
    assert (c.total, c.matched, c.unmatched, c.match_rate) == (7, 4, 3, 4 / 7)


def test_rest_days_need_both_teams(spark):
    d = datetime.date
    games = spark.createDataFrame([(1, "s", d(2024, 1, 1), 1, 2), (2, "s", d(2024, 1, 4), 1, 3), (3, "s", d(2024, 1, 5), 2, 3), (4, "t", d(2024, 1, 6), 1, 2)], "game_id int, season string, day date, home int, away int")
    schedule = games.select(F.col("home").alias("team"), "season", "day").union(games.select("away", "season", "day"))
    rest = ordered.rest_days(schedule, "team", "season", "day")
    assert {r.game_id: (r.home_rest, r.away_rest) for r in ordered.game_rest(games, rest).collect()} == {1: (None, None), 2: (None, None), 3: (3, 0), 4: (None, None)}


def test_split_gates_report_corruption(spark):
    fives = [[1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 3, 5, 6], [2, 3, 4, 5, 6]]
    s = stints(spark, *[{"game_id": f"g{i // 2}", "game_date": f"2024-01-{i // 2 + 1:02d}", "offense_player_ids": fives[i % 4], "defense_player_ids": [16, 17, 18, 19, 20]} for i in range(12)])
    split = splits.chronological(s, 0.5)
    bad = lambda df: {r.check: r.violations for r in df.collect() if r.violations}
    assert bad(splits.verify(s, split)) == {} and bad(splits.chronological_gate(s, split)) == {}
    flipped = split.withColumn("side", F.when(F.col("stint_id") == "s0", "test").otherwise(F.col("side")))
    assert bad(splits.chronological_gate(s, flipped)) == {"straddling_games": 1, "train_after_test": 1}
    doubled = split.union(spark.createDataFrame([("s0", "test"), ("zz", "train")], "stint_id string, side string")).where("stint_id <> 's1'")
    assert bad(splits.verify(s, doubled)) == {"overlap": 1, "unknown": 1, "missing": 1}
    held = splits.unseen_lineups(s, 1, 3)
    by_lineup = splits.hold_out_lineups(s, held)
    assert bad(splits.lineup_gate(s, by_lineup, held)) == {}
    assert bad(splits.lineup_gate(s, by_lineup.withColumn("side", F.lit("train")), held)) == {"seen_in_train": 1, "absent_from_test": 1}
    with pytest.raises(ValueError):
        splits.unseen_pairs(s, budget=0.0)


def test_greedy_pairs_stay_within_the_budget(spark):
    import itertools

    fives = [list(x) for x in itertools.combinations(range(1, 9), 5)]
    s = stints(spark, *[{"offense_player_ids": fives[(i * 11) % len(fives)], "defense_player_ids": [21, 22, 23, 24, 25]} for i in range(120)])
    taken = splits.unseen_pairs(s, n_pairs=3, minimum=1, solo=2, budget=0.5, cap_share=1.0)
    held = spark.createDataFrame(taken, "a long, b long")
    split = splits.hold_out_pairs(s, held)
    assert split.where("side = 'test'").count() <= 60
    assert {r.check: r.violations for r in splits.pair_gate(s, split, held).collect()} == {"together_in_train": 0, "never_in_test": 0, "player_unseen": 0}


def test_greedy_pairs_equal_a_plain_scan_and_list_no_stints(spark, monkeypatch):
    import itertools
    from collections import Counter

    from pyspark.sql import functions

    fives = [list(x) for x in itertools.combinations(range(1, 9), 5)]
    used = [fives[(i * i * 11) % len(fives)] for i in range(120)]
    s = stints(spark, *[{"offense_player_ids": five, "defense_player_ids": [21, 22, 23, 24, 25]} for five in used])

    def plain(n_pairs, minimum, solo, budget):
        pairs = Counter(p for five in used for p in itertools.combinations(five, 2))
        left, removed, players, taken = Counter(p for five in used for p in five), set(), set(), []
        for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            new = [i for i, five in enumerate(used) if n >= minimum and a in five and b in five and i not in removed]
            loss = Counter(p for i in new for p in used[i])
            if n < minimum or len(removed) + len(new) > budget * len(used) or any(left[p] - loss[p] < solo for p in players | {a, b}):
                continue
            taken, players, removed, left = [*taken, (a, b)], players | {a, b}, removed | set(new), left - loss
            if len(taken) == n_pairs:
                break
        return taken

    def refused(*_):
        raise AssertionError("stints of a pair gathered into one row")

    monkeypatch.setattr(functions, "collect_list", refused)
    for args in ((4, 1, 2, 0.5), (4, 1, 40, 0.9), (2, 3, 2, 0.4)):
        n_pairs, minimum, solo, budget = args
        want = plain(*args)
        if want:
            assert splits.unseen_pairs(s, n_pairs=n_pairs, minimum=minimum, solo=solo, budget=budget, cap_share=1.0) == want


def test_cumulative_totals_take_the_last_of_each_game(spark):
    e = spark.createDataFrame([(1, "a", 1, 1, 2), (1, "a", 2, 2, 4), (1, "b", 1, 2, 6)], "p int, g string, o int, off int, def int")
    assert tuple(profiles.last_then_sum(e, ["p"], "g", ["o"], ["off", "def"]).first()) == (1, 4, 10)


def test_moves_need_one_team_in_each_season(spark):
    e = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "b", 5), (2, 0, "a", 5), (2, 0, "b", 5), (2, 1, "b", 5), (3, 0, "a", 5), (3, 1, "a", 5), (4, 0, "a", 5), (4, 2, "b", 5), (5, 0, "a", 9), (5, 0, "b", 1), (5, 1, "c", 9)], "player_id int, season_index int, team string, possessions long")
    assert {r.player_id for r in profiles.moves(e, 5).collect()} == {1, 5}
    assert {r.player_id for r in profiles.moves(e, 5, changed=False).collect()} == {3}


def test_possessions_fail_in_order(spark):
    rows = [(False, 0, 4, 9, 0, True), (True, 0, 4, 9, 0, True), (True, 1, 4, 9, 0, True), (True, 1, 5, 9, 0, True), (True, 1, 5, 2, 0, True), (True, 1, 5, 7, 1, False)]
    df = spark.createDataFrame(rows, "known_team boolean, events int, lineup_size int, raw_points int, technical_points int, split_lineup boolean")
    found = [(r.reason, r.counted) for r in reconcile.validated(df).collect()]
    assert found == [("unknown_team", False), ("empty_possession", False), ("lineup_not_five", False), ("ambiguous_scoring", False), ("split_lineup", True), (None, True)]


def test_score_sums_take_technical_points_in_the_final_only(spark):
    p = spark.createDataFrame([("g", "x", 1, 3, 1, True), ("g", "x", 2, 2, 0, True), ("g", "x", 2, 9, 0, False), ("g", "y", 1, 0, 0, True)], "game_id string, team string, period int, raw_points int, technical_points int, counted boolean")
    found = {(r.team, r.period): r.points for r in reconcile.score_sums(p, ["game_id", "team"], "period").collect()}
    assert found == {("x", 1): 2, ("x", 2): 2, ("x", None): 5, ("y", 1): 0, ("y", None): 0}
    assert reconcile.score_sums(p.limit(0), ["game_id", "team"], "period").count() == 0


def test_totals_of_a_selection_ignore_the_minimum(spark):
    df = stints(spark, {}, {"stint_id": "b"})
    few, many = (contract.selection_totals(df, n).first() for n in (1, 1_000_000))
    assert few.possessions == many.possessions and few.stints == 2 and (few.listed, many.listed) == (1, 0)
    none = contract.selection_totals(df, 1, player=-1).first()
    assert none.lineups == 0 and none.possessions is None and none.rating is None


def test_ingest_quarantines_and_emits(spark, tmp_path):
    cols = "game_id string, period int, sequence int, offense string, lineup_a string, lineup_b string, start_seconds double, margin int, known_team boolean, events int, lineup_size int, raw_points int, technical_points int, split_lineup boolean"
    row = lambda g, s, o, pts, la="A", size=5, period=1: (g, period, s, o, la, "B", 10.0 * s, 0, True, 1, size, pts, 0, False)
    poss = [row("ok", 1, "x", 2), row("ok", 2, "y", 0), row("ok", 3, "x", 3, la="A2"), row("score", 1, "x", 2), row("score", 2, "y", 1, size=4), row("twice", 1, "x", 2), row("twice", 2, "x", 1)]
    games = spark.createDataFrame([("ok", "x", 5), ("ok", "y", 0), ("score", "x", 2), ("score", "y", 1), ("twice", "x", 3)], "game_id string, team string, points int")
    out = ingest.ingest(spark.createDataFrame(poss, cols), games)
    status = {r.game_id: (r.status, r.reason, r.possessions, r.stints) for r in out["games"].collect()}
    assert status == {"ok": ("accepted", None, 3, 3), "score": ("quarantined", "score_mismatch", 0, 0), "twice": ("quarantined", "alternation_period_1", 2, 0)}
    assert {r.game_id for r in out["stints"].collect()} == {"ok"}
    assert out["totals"].first().stints_written == 3 and out["quarantine"].count() == 1
    assert ingest.write(out, str(tmp_path / "kept"))["stints_written"] == 3
    assert spark.read.json(str(tmp_path / "kept" / "stints")).count() == 3


def test_gram_equals_the_dense_product(spark):
    import numpy as np

    s = stints(spark, {}, {"points_scored": 3, "offense_player_ids": [1, 2, 3, 4, 11]}, {"offensive_possessions": 4, "defense_player_ids": [6, 7, 8, 9, 12]})
    rows = gram.design(s)
    dense = {r.stint_id: {c.col: c.val for c in r.cells} for r in rows.collect()}
    names = sorted({c for d in dense.values() for c in d})
    a = np.array([[d.get(n, 0.0) for n in names] for d in dense.values()])
    w = np.diag([r.w for r in rows.collect()])
    full = a.T @ w @ a
    for r in gram.gram(rows).collect():
        assert full[names.index(r.i), names.index(r.j)] == r.g
    assert {r.i: r.b for r in gram.rhs(rows).collect()} == dict(zip(names, a.T @ w @ np.array([r.y for r in rows.collect()])))


def test_calibration_degenerate_cases(spark):
    one = metrics.calibration(spark.createDataFrame([(1.0, 1.0, 2.0)], "p double, s double, a double"), "p", "s", "a").first()
    assert (one.slope, one.intercept, one.z_sd, one.coverage_50, one.coverage_80) == (1.0, 0.0, 0.0, 0.0, 1.0)
    few = metrics.regression(spark.createDataFrame([(1.0, 2.0)] * 4, "y double, x double"), "y", "x").first()
    flat = metrics.regression(spark.createDataFrame([(float(i), 2.0) for i in range(5)], "y double, x double"), "y", "x").first()
    assert tuple(few)[1:] == (0, 0, 0) and tuple(flat)[1:] == (0, 2.0, 0)
