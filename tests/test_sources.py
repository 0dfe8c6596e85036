"""Readers and writers: round trips, refusals, archives, streaming forms, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from cadence import cli
from cadence.plans import models, report
from cadence.sources import archive, records
from cadence.streaming import ordered as streaming

from .test_operators import GOOD, contract, stints


def line(**changes):
    return json.dumps(dict(zip(contract.SCHEMA.names, GOOD)) | changes)


def test_stints_round_trip(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text(line() + "\n\n" + line(stint_id="s2") + "\n")
    first = records.read_stints(spark, str(path))
    assert first.count() == 2 and first.first().offense_player_ids == [1, 2, 3, 4, 5]
    records.write_stints(first, str(tmp_path / "out"))
    assert sorted(map(tuple, records.read_stints(spark, str(tmp_path / "out")).collect()), key=repr) == sorted(map(tuple, first.collect()), key=repr)
    (tmp_path / "b.json").write_text(json.dumps({"stints": [json.loads(line())]}))
    assert records.read_stints(spark, str(tmp_path / "b.json")).count() == 1


@pytest.mark.parametrize("bad", ["[1, 2]", "{not json", line(extra=1), line(schema_version=1), json.dumps({"stint_id": "x"})])
def test_broken_lines_are_refused(spark, tmp_path, bad):
    path = tmp_path / "a.jsonl"
    path.write_text(line() + "\n" + bad + "\n")
    with pytest.raises(records.ContractError):
        records.read_stints(spark, str(path))


def test_production_meta_row_is_kept_apart(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, 2.0)], "stint_id string, player_id long, fg_points double")
    records.write_production(rows, {"credit": 0.5}, str(tmp_path / "p"))
    back, meta = records.read_production(spark, str(tmp_path / "p"))
    assert meta == {"credit": 0.5} and back.count() == 1 and "_meta" not in back.columns


def test_fit_round_trip(spark, tmp_path):
    table, _ = models.synthetic(spark, players=20, stints=200)
    fit = models.fit_ridge(table)
    records.save_fit(fit, spark, str(tmp_path / "fit"))
    back = records.load_fit(spark, str(tmp_path / "fit"))
    assert back.columns == fit.columns and (back.coef == fit.coef).all() and back.sigma2 == fit.sigma2


def test_snapshot_checks(spark, tmp_path):
    game = lambda i, files, rest: {"game_id": i, "game_date": "20240102", "season": "2023-24", "season_type": "Playoffs", "home_team_id": 1, "away_team_id": 2, "days_rest": rest, "reconciliation": {"final_score": {"1": 9, "2": 8}, "period_scores": {}}, "files": files}
    snap = tmp_path / "snap"
    (snap / "pbp").mkdir(parents=True)
    (snap / "pbp" / "g1.json").write_text(json.dumps({"resultSets": [{"name": "PlayByPlay", "headers": ["GAME_ID", "EVENTNUM"], "rowSet": [["g1", 7], ["g1", 3]]}]}))
    (snap / "index.json").write_text(json.dumps({"snapshot_format": "v2", "games": [game("g1", ["pbp/g1.json"], {"1": 2, "2": None}), game("g2", ["../x.json", "pbp/none.json"], {"1": 1, "2": 1}), game("g2", [], {})]}))
    games = archive.snapshot_games(spark, str(snap))
    assert games.where("game_id = 'g1'").first().days_rest == {1: 2}
    from cadence.operators import reconcile

    assert {r.game_id: r.missing for r in reconcile.missing_context(games.where("game_id = 'g1'")).collect()} == {"g1": ["days_rest_away"]}
    problems = {(r.game_id, r.problem.split(":")[0]) for r in archive.snapshot_problems(spark, str(snap)).collect()}
    assert problems == {("g2", "repeated game"), ("g2", "path leaves the snapshot"), ("g2", "missing file")}
    rows = archive.result_rows(spark, str(snap / "pbp"), ["EVENTNUM", "ABSENT"]).orderBy("place").collect()
    assert [(r.EVENTNUM, r.ABSENT) for r in rows] == [("7", None), ("3", None)]


def test_archive_conversion(spark, tmp_path):
    (tmp_path / "nbastats_1.csv").write_text("GAME_ID,EVENTNUM,PLAYER1_ID,PLAYER1_NAME\n22100001,5,9,\n22100001,2,9,Nine\n22100002,1,9,Other\n")
    (tmp_path / "datanba_1.csv").write_text("GAME_ID,PERIOD,hs,vs,tid\n22100001,1,0,2,20\n22100001,1,3,2,10\n22100001,2,3,6,20\n")
    (tmp_path / "shotdetail_1.csv").write_text("GAME_ID,GAME_DATE,TEAM_ID\n22100001,20211019,10\n22100001,20211019,20\n")
    out = archive.convert(*[archive.provider_csv(spark, [str(tmp_path)], p) for p in ("nbastats", "datanba", "shotdetail")])
    g = out["games"].first()
    assert (g.game_id, g.home_team_id, g.away_team_id, g.home_score, g.away_score, g.season, g.season_type) == ("0022100001", 10, 20, 3, 6, "2021-22", "Regular Season")
    assert sorted((r.side, r.period, r.points) for r in out["period_scores"].collect()) == [("hs", 1, 3), ("hs", 2, 0), ("vs", 1, 2), ("vs", 2, 4)]
    assert [r.EVENTNUM for r in out["play_by_play"].orderBy("place").collect()] == ["5", "2"]
    assert {(r.game_id, r.missing) for r in out["incomplete"].collect()} == {("0022100002", "datanba,shotdetail")}
    assert json.loads(archive.envelope(out["play_by_play"], "PlayByPlay", ["EVENTNUM"]).first().payload)["resultSets"][0]["rowSet"] == [["5"], ["2"]]
    listed = archive.write_snapshot(out, str(tmp_path / "snap"), ["EVENTNUM"], ["TEAM_ID"]).select("file", "sha256").collect()
    listed = spark.createDataFrame(listed, "file string, sha256 string")
    plain = lambda d: d.where(~F.col("file").endswith("_SUCCESS") & ~F.col("file").endswith(".crc") & ~F.col("file").rlike("^(index.json|provenance)/"))
    assert spark.read.json(str(tmp_path / "snap" / "play_by_play")).count() == 1
    assert plain(archive.changed_files(spark, str(tmp_path / "snap"), listed)).count() == 0
    (tmp_path / "snap" / "more.json").write_text("{}")
    other = listed.withColumn("sha256", F.when(F.col("file").startswith("names/"), "0").otherwise(F.col("sha256"))).union(spark.createDataFrame([("gone.json", "0")]))
    assert {r.problem for r in plain(archive.changed_files(spark, str(tmp_path / "snap"), other)).collect()} == {"missing", "changed", "not recorded"}
    nested = archive.nested_periods(spark.createDataFrame([("g", 2, 1, "b"), ("g", 1, 0, "a")], "game_id string, period int, place int, tid string"), ["tid"])
    assert json.loads(nested.first().payload) == {"g": {"pd": [{"p": 1, "pla": [{"tid": "a"}]}, {"p": 2, "pla": [{"tid": "b"}]}]}}


def archive_of(folder, games):
    plays, live, shots = ["GAME_ID,EVENTNUM,PLAYER1_ID,PLAYER1_NAME"], ["GAME_ID,PERIOD,hs,vs,tid"], ["GAME_ID,GAME_DATE,TEAM_ID"]
    for k in range(games):
        g = 22100001 + k
        plays += [f"{g},{n},9,Nine" for n in (5, 2, 8)]
        live += [f"{g},1,0,2,20", f"{g},1,3,2,10", f"{g},2,3,{6 + k},20"]
        shots += [f"{g},202110{19 + k % 9},10", f"{g},202110{19 + k % 9},20"]
    for name, rows in (("nbastats", plays), ("datanba", live), ("shotdetail", shots)):
        (folder / f"{name}_1.csv").write_text("\n".join(rows) + "\n")


def test_a_converted_archive_is_read_back(spark, tmp_path, monkeypatch):
    archive_of(tmp_path, 7)
    snap = str(tmp_path / "snap")
    monkeypatch.setattr(archive, "INDEXED", 3)
    assert cli.main(["convert", "--archive", str(tmp_path), "--out", snap]) == 0
    assert archive.snapshot_problems(spark, snap).count() == 0
    games = {g.game_id: g for g in archive.snapshot_games(spark, snap).collect()}
    assert len(games) == 7
    g = games["0022100003"]
    assert str(g.game_date) == "2021-10-21" and (g.home_team_id, g.away_team_id, g.season) == (10, 20, "2021-22")
    assert g.final_score == {10: 3, 20: 8} and g.period_scores == {10: [3, 0], 20: [2, 6]} and g.days_rest == {10: 0, 20: 0}
    assert games["0022100001"].days_rest == {} and len(g.files) == 3
    rows = archive.payloads(spark, snap, "play_by_play", ["0022100003", "0022100005"])
    assert sorted(r.game_id for r in rows.collect()) == ["0022100003", "0022100005"]
    assert [r[1] for r in json.loads(rows.first().payload)["resultSets"][0]["rowSet"]] == ["5", "2", "8"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")
    assert archive.payloads(spark, snap, "shots_home").count() == 7
    kept = spark.read.json(snap + "/provenance")
    assert {r.file for r in kept.where("kind = 'source'").collect()} == {"nbastats_1.csv", "datanba_1.csv", "shotdetail_1.csv"}
    recorded = kept.where("kind = 'snapshot'").select("file", "sha256")
    assert archive.changed_files(spark, snap, recorded).where("problem <> 'not recorded'").count() == 0
    with pytest.raises(archive.ArchiveError):  # it holds a snapshot
        archive.convert_archive(spark, [str(tmp_path)], snap)


def test_a_broken_write_leaves_no_index(spark, tmp_path):
    archive_of(tmp_path, 2)
    out = archive.convert(*[archive.provider_csv(spark, [str(tmp_path)], p) for p in archive.PROVIDERS])
    snap = str(tmp_path / "snap")
    broken = out | {"period_scores": out["period_scores"].withColumn("points", F.raise_error(F.lit("lost")).cast("long"))}
    with pytest.raises(Exception, match="lost"):
        archive.write_snapshot(broken, snap, ["EVENTNUM"], ["TEAM_ID"])
    assert not archive.committed(spark, snap)
    with pytest.raises(archive.ArchiveError):
        archive.payloads(spark, snap, "play_by_play")
    archive.write_snapshot(out, snap, ["EVENTNUM"], ["TEAM_ID"])  # may be repeated
    assert archive.snapshot_games(spark, snap).count() == 2


def test_fingerprints(spark, tmp_path):
    texts = spark.createDataFrame([('{"a": 1}',), ('{"a": 2, "b": "x"}',)], "value string")
    same = spark.createDataFrame([('{"b": "y", "a": 9}',), ('{"a": 5}',)], "value string")
    assert records.schema_fingerprint(texts).first().fingerprint == records.schema_fingerprint(same).first().fingerprint
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3,4\n")
    assert records.csv_fingerprints(spark, [str(tmp_path / "x.csv")]).first().rows == 2


def test_streaming_runs_equal_batch(spark, tmp_path, sf):
    from cadence.operators import ordered
    from cadence.sources import views

    p = views.possessions(spark, sf).select("game_id", "lineup", "sequence_index")
    p.repartition(1).sortWithinPartitions("game_id", "sequence_index").write.parquet(str(tmp_path / "in"))
    stream = streaming.streaming_runs(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("closed_runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.game_id, r.first_index): r.possessions for r in spark.table("closed_runs").collect()}
    batch = ordered.runs(p, ["game_id"], ["lineup"], "sequence_index").groupBy("game_id", "run").agg(F.min("sequence_index").alias("a"), F.count(F.lit(1)).alias("n"), F.max("sequence_index").alias("b"))
    last = {r[0]: r[1] for r in p.groupBy("game_id").agg(F.max("sequence_index")).collect()}
    closed = {(r.game_id, r.a): r.n for r in batch.collect() if r.b != last[r.game_id]}
    assert got == closed


def test_command_line(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(line(stint_id=f"s{i}") for i in range(3)))
    assert cli.main(["lineups", "--stints", str(path), "--out", str(tmp_path / "o"), "--minimum", "10", "--report", str(tmp_path / "r.html")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).first().stints == 3 and "<table>" in (tmp_path / "r.html").read_text()
    assert cli.main(["lineups", "--stints", str(path), "--out", str(tmp_path / "o"), "--minimum", "0"]) == 2
    assert cli.main(["totals", "--stints", str(path), "--out", str(tmp_path / "t")]) == 0 and spark.read.parquet(str(tmp_path / "t")).first().stints == 3
    assert cli.main(["ingest", "--stints", str(path), "--out", str(tmp_path / "i")]) == 2
    assert report.bars([("a", 1.0)], "t").startswith("<h2>t</h2><svg")
    assert stints(spark, {}).count() == 1


def test_provider_files_are_read_in_path_order(spark, tmp_path):
    """The larger file is the later one, which Spark puts into a task of its own first."""
    from cadence.operators import reconcile

    for n, rows in ((1, 3), (2, 5000)):
        (tmp_path / f"nbastats_{n}.csv").write_text("PLAYER1_ID,PLAYER1_NAME\n" + "".join(f"7,name {n}.{i}\n" for i in range(rows)))
    rows = archive.provider_csv(spark, [str(tmp_path)], "nbastats")
    names = [r.PLAYER1_NAME for r in rows.orderBy("place").collect()]
    assert names == [f"name 1.{i}" for i in range(3)] + [f"name 2.{i}" for i in range(5000)]
    assert reconcile.first_names(rows, "PLAYER1_ID", "PLAYER1_NAME", ["place"]).first().PLAYER1_NAME == "name 1.0"


def test_stints_are_held_against_their_manifest(spark, tmp_path):
    import hashlib

    path = tmp_path / "stints.jsonl"
    path.write_text(line(offensive_possessions=7) + "\n")
    listed = {"stints_sha256": hashlib.sha256(path.read_bytes()).hexdigest(), "stints_written": 1, "accepted_possessions": 7}
    assert records.checked_stints(spark, str(path), listed).count() == 1
    with pytest.raises(ValueError, match="stints_sha256"):
        records.checked_stints(spark, str(path), listed | {"stints_sha256": "0"})


def test_a_folder_of_stints_is_held_against_its_manifest(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text("\n".join(line(stint_id=f"s{i}", offensive_possessions=i + 1) for i in range(40)))
    records.write_stints(records.read_stints(spark, str(tmp_path / "a.jsonl")).repartition(3), str(tmp_path / "out"))
    listed = records.stints_manifest(spark, str(tmp_path / "out"))
    assert len(listed["files"]) == 3 and (listed["stints_written"], listed["accepted_possessions"]) == (40, 820)
    assert records.checked_stints(spark, str(tmp_path / "out"), listed).count() == 40
    name = sorted(listed["files"])[1]
    with pytest.raises(ValueError, match=name):
        records.checked_stints(spark, str(tmp_path / "out"), listed | {"files": listed["files"] | {name: "0"}})
    with pytest.raises(ValueError, match="gone.json"):
        records.checked_stints(spark, str(tmp_path / "out"), listed | {"files": listed["files"] | {"gone.json": "0"}})
    monkeypatch.setattr(records, "MAX_FILE", 10)
    with pytest.raises(ValueError, match="parts"):
        records.stint_files(spark, str(tmp_path / "out"))
