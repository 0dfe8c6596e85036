"""Raw archives: snapshots of games (JSON) and provider CSVs, as tables.

Files are listed and read by Spark, so a path may lie in any store it knows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ordered, reconcile

PROVIDERS = {"nbastats": "nbastats_*.csv", "datanba": "datanba_*.csv", "shotdetail": "shotdetail_*.csv"}
INDEX = """snapshot_format string, games array<struct<game_id:string,game_date:string,season:string,season_type:string,home_team_id:bigint,away_team_id:bigint,
  days_rest:map<string,int>,reconciliation:struct<final_score:map<string,int>,period_scores:map<string,array<int>>>,files:array<string>>>"""


class ArchiveError(ValueError):
    """A snapshot or archive that can't be used."""


def snapshot_games(spark: SparkSession, path: str) -> DataFrame:
    """A row for each game of ``index.json``: maps get integer keys, unknown rest is left out."""
    index = spark.read.schema(INDEX).option("multiLine", True).option("mode", "FAILFAST").json(f"{path}/index.json")
    g = index.select(F.explode("games").alias("g")).select("g.*")
    by_team = lambda m: F.transform_keys(m, lambda k, _: k.cast("bigint"))
    return g.select(
        "game_id", S.iso_date("game_date").alias("game_date"), "season", "season_type", "home_team_id", "away_team_id",
        by_team(F.map_filter("days_rest", lambda _, v: v.isNotNull())).alias("days_rest"),
        by_team(F.col("reconciliation.final_score")).alias("final_score"),
        by_team(F.col("reconciliation.period_scores")).alias("period_scores"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files"),
    )


def snapshot_problems(spark: SparkSession, path: str) -> DataFrame:
    """(game_id, problem): repeated games, files that leave the snapshot, files that aren't there."""
    games = snapshot_games(spark, path)
    repeated = games.groupBy("game_id").count().where("count > 1").select("game_id", F.lit("repeated game").alias("problem"))
    files = games.select("game_id", F.explode("files").alias("file"))
    leaving = files.where(F.col("file").startswith("/") | F.col("file").rlike(r"(^|/)\.\.(/|$)")).select("game_id", F.concat(F.lit("path leaves the snapshot: "), "file").alias("problem"))
    there = snapshot_files(spark, path).select("file")
    absent = files.join(there, "file", "left_anti").select("game_id", F.concat(F.lit("missing file: "), "file").alias("problem"))
    return repeated.union(leaving).union(absent)


def snapshot_files(spark: SparkSession, path: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """file (relative), length, sha256; of some folders only, if any are named."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{path}/{f}" for f in folders] or path)
    tail = F.element_at(F.split("path", path.rstrip("/").split("/")[-1] + "/", 2), 2)
    return raw.select(tail.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def changed_files(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """(file, problem) where a snapshot's files differ from those ``recorded`` (file, sha256): missing,
    changed, or not recorded."""
    found = snapshot_files(spark, path).select("file", F.col("sha256").alias("found"))
    both = recorded.select("file", F.col("sha256").alias("recorded")).join(found, "file", "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("recorded").isNull(), "not recorded").when(F.col("found") != F.col("recorded"), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")


PAYLOADS = ("play_by_play", "shots_home", "shots_away")
#: Payloads lie in so many folders by game, so that a few games are read from a few of them.
BUCKETS = 32
#: Games in a document of the index.
INDEXED = 1000


def bucket(game_id) -> F.Column:
    return F.pmod(F.crc32(game_id.cast("string")), F.lit(BUCKETS)).cast("int")


def committed(spark: SparkSession, path: str) -> bool:
    """Whether the snapshot has its index, which is written last: a file, or a folder whose job ended."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/index.json")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")
    return store.exists(done) or (store.exists(target) and store.getFileStatus(target).isFile())


def write_snapshot(parts: dict[str, DataFrame], path: str, plays: list[str], shots: list[str], sources: DataFrame | None = None) -> DataFrame:
    """Writes what ``convert`` gives so that ``snapshot_games`` and ``payloads`` read it back, and
    returns the provenance, which is kept beside it: each file written, and each source file
    (``sources``: file, length, sha256), with its length and sha256.

    Payloads come first, one JSON line a game; then names, the games that lack a provider, and the
    provenance; the index comes last. A write that is broken off leaves no index, and may be
    repeated; one that has its index is refused. The index is a folder of documents of ``INDEXED``
    games, so no task and no driver holds all of them.
    """
    spark, path = parts["games"].sparkSession, path.rstrip("/")
    if committed(spark, path):
        raise ArchiveError(f"{path} holds a snapshot")
    sides = {side: envelope(parts["shots"].where(F.col("side") == side), "Shots", shots) for side in ("home", "away")}
    written = dict(zip(PAYLOADS, (envelope(parts["play_by_play"], "PlayByPlay", plays), sides["home"], sides["away"])))
    for name, payload in written.items():
        payload.withColumn("bucket", bucket(F.col("game_id"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(f"{path}/{name}")
    for name in ("names", "incomplete"):
        parts[name].write.mode("overwrite").json(f"{path}/{name}")
    provenance = snapshot_files(spark, path, (*PAYLOADS, "names", "incomplete")).where(F.col("file").endswith(".json")).withColumn("kind", F.lit("snapshot"))
    if sources is not None:
        provenance = provenance.unionByName(sources.select("file", "length", "sha256", F.lit("source").alias("kind")))
    provenance.write.mode("overwrite").json(f"{path}/provenance")

    files = None
    for name in PAYLOADS:
        one = spark.read.schema("game_id string, bucket int").json(f"{path}/{name}").select("game_id", F.concat(F.lit(f"{name}/bucket="), F.col("bucket").cast("string"), F.lit("/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias("file"))
        files = one if files is None else files.union(one)
    files = files.groupBy("game_id").agg(F.array_sort(F.collect_set("file")).alias("files"))  # three a game
    team = lambda side: F.col(f"{side}_team_id").cast("string")
    scores = parts["period_scores"].groupBy("game_id").pivot("side", ["hs", "vs"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "points"))), lambda x: x["points"].cast("int")))  # a game's periods
    both = lambda h, v: F.map_from_arrays(F.array(team("home"), team("away")), F.array(h, v))
    none = F.array().cast("array<int>")
    games = parts["games"].join(scores, "game_id", "left").join(files, "game_id", "left").select(
        "game_id", F.date_format("game_date", "yyyyMMdd").alias("game_date"), "season", "season_type", F.col("home_team_id").cast("bigint").alias("home_team_id"), F.col("away_team_id").cast("bigint").alias("away_team_id"),
        both(F.col("home_rest").cast("int"), F.col("away_rest").cast("int")).alias("days_rest"),
        F.struct(both(F.col("home_score").cast("int"), F.col("away_score").cast("int")).alias("final_score"), both(F.coalesce("hs", none), F.coalesce("vs", none)).alias("period_scores")).alias("reconciliation"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files"),
    )
    count = max(1, -(-games.count() // INDEXED))
    documents = games.groupBy(F.pmod(F.crc32("game_id"), F.lit(count)).alias("document")).agg(F.array_sort(F.collect_list(F.struct(*games.columns)), lambda a, b: F.when(a["game_id"] < b["game_id"], -1).when(a["game_id"] > b["game_id"], 1).otherwise(0)).alias("games"))
    documents.select(F.lit("v2").alias("snapshot_format"), "games").write.option("maxRecordsPerFile", 1).mode("overwrite").json(f"{path}/index.json")
    return spark.read.schema("file string, length bigint, sha256 string, kind string").json(f"{path}/provenance")


def payloads(spark: SparkSession, path: str, kind: str, games: list[str] | None = None) -> DataFrame:
    """game_id, payload of a snapshot with an index; of some games, from their folders only."""
    path = path.rstrip("/")
    if not committed(spark, path):
        raise ArchiveError(f"{path} has no index")
    rows = spark.read.schema("game_id string, payload string, bucket int").json(f"{path}/{kind}")
    if games is not None:
        named = spark.createDataFrame([(g,) for g in games], "game_id string")
        rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(g.encode()) % BUCKETS for g in games}))).join(F.broadcast(named), "game_id", "left_semi")  # as many as asked for
    return rows.select("game_id", "payload")


def source_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """file, length, sha256 of the providers' CSV files."""
    globs = [f"{f.rstrip('/')}/{g}" for f in folders for g in PROVIDERS.values()]
    raw = spark.read.format("binaryFile").load(globs)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def convert_archive(spark: SparkSession, folders: list[str], path: str) -> DataFrame:
    """The providers' CSV files of ``folders`` as a snapshot at ``path``; the provenance."""
    tables = [provider_csv(spark, folders, p) for p in PROVIDERS]
    columns = [[c for c in t.columns if c not in ("file", "place")] for t in tables]
    return write_snapshot(convert(*tables), path, columns[0], columns[2], source_files(spark, folders))


def result_rows(spark: SparkSession, paths: list[str] | str, columns: list[str]) -> DataFrame:
    """Rows of ``resultSets[0]`` envelopes (names and rows apart): file, place and the named columns
    as strings, in the archive's order, never sorted by event number."""
    schema = "resultSets array<struct<name:string,headers:array<string>,rowSet:array<array<string>>>>"
    first = spark.read.schema(schema).option("multiLine", True).json(paths).select(F.col("_metadata.file_path").alias("file"), F.col("resultSets")[0].alias("r"))
    rows = first.select("file", "r.headers", F.posexplode("r.rowSet").alias("place", "row"))
    return rows.select("file", "place", *[F.try_element_at("row", F.nullif(F.array_position("headers", F.lit(c)), F.lit(0)).cast("int")).alias(c) for c in columns])


def provider_csv(spark: SparkSession, folders: list[str], provider: str) -> DataFrame:
    """All of a provider's CSV files in the folders, with the file and the row's place in reading
    order (files by path), as strings; blanks are null. Spark packs files into tasks by size, so a
    place is the file, the block within it and the row's number within the task."""
    paths = [f"{f.rstrip('/')}/{PROVIDERS[provider]}" for f in folders]
    try:
        df = spark.read.option("header", True).option("nullValue", "").csv(paths)
    except Exception as e:
        raise ArchiveError(f"no {provider} files in {folders}") from e
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "*")


def typed(df: DataFrame, integers: list[str], nullable: list[str]) -> DataFrame:
    """Blank integers become 0, or null where allowed."""
    out = {c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)) for c in integers} | {c: F.col(c).try_cast("bigint") for c in nullable}
    return df.withColumns(out)


def convert(nbastats: DataFrame, datanba: DataFrame, shots: DataFrame) -> dict[str, DataFrame]:
    """Provider tables to a snapshot's parts: games (teams, scores, rest), play_by_play (archive
    order), shots by side, names, and the games that lack a provider."""
    padded = lambda df: df.withColumn("game_id", S.game_id(F.col("GAME_ID").cast("string")))
    nbastats, datanba, shots = padded(nbastats), padded(datanba), padded(shots)
    seen = lambda df, p: df.select("game_id", F.lit(p).alias("provider"))
    presence = reconcile.provider_presence(seen(nbastats, "nbastats").union(seen(datanba, "datanba")).union(seen(shots, "shotdetail")), "game_id", list(PROVIDERS))
    whole = presence.where("complete").select("game_id")
    live = datanba.join(whole, "game_id", "left_semi")
    scored = live.select("game_id", "place", F.col("PERIOD").cast("int").alias("period"), F.col("hs").cast("int").alias("hs"), F.col("vs").cast("int").alias("vs"), F.col("tid").cast("bigint").alias("tid"))
    home = ordered.first_rise(scored, "game_id", ["place"], "hs", "tid").withColumnRenamed("team", "home_team_id")
    teams = scored.where("tid > 0").groupBy("game_id").agg(F.array_sort(F.collect_set("tid")).alias("teams"))  # two a game
    final = scored.groupBy("game_id").agg(F.max("hs").alias("home_score"), F.max("vs").alias("away_score"))
    dates = shots.groupBy("game_id").agg(F.min(S.iso_date(F.col("GAME_DATE").cast("string"))).alias("game_date"))
    games = home.join(teams, "game_id").join(final, "game_id").join(dates, "game_id", "left").select(
        "game_id", "game_date", S.season_of(F.col("game_id")).alias("season"), S.season_type(F.col("game_id")).alias("season_type"), "home_team_id",
        F.get(F.filter("teams", lambda t: t != F.col("home_team_id")), F.lit(0)).alias("away_team_id"), "home_score", "away_score",
    )
    schedule = games.select(F.col("home_team_id").alias("team"), "season", F.col("game_date").alias("day")).union(games.select("away_team_id", "season", "game_date"))
    rested = ordered.game_rest(games.select("game_id", "season", F.col("game_date").alias("day"), F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away")), ordered.rest_days(schedule, "team", "season", "day"))
    periods = None
    for side in ("hs", "vs"):
        one = ordered.period_scores(scored, "game_id", "period", ["place"], side).select("game_id", "period", F.lit(side).alias("side"), "points")
        periods = one if periods is None else periods.union(one)
    sided = shots.join(games.select("game_id", "home_team_id"), "game_id").withColumn("side", F.when(F.col("TEAM_ID").cast("bigint") == F.col("home_team_id"), "home").otherwise("away"))
    names = reconcile.first_names(nbastats, "PLAYER1_ID", "PLAYER1_NAME", ["place"])
    return {
        "games": games.join(rested.select("game_id", "home_rest", "away_rest"), "game_id"),
        "period_scores": periods,
        "play_by_play": nbastats.join(whole, "game_id", "left_semi"),
        "shots": sided,
        "names": names,
        "incomplete": presence.where("not complete").select("game_id", "missing"),
    }


def nested_periods(rows: DataFrame, columns: list[str]) -> DataFrame:
    """game_id, payload: rows in order as ``{"g": {"pd": [{"p": 1, "pla": [...]}, ...]}}``."""
    plays = rows.groupBy("game_id", "period").agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("s"))  # a period's rows
    plays = plays.select("game_id", F.col("period").alias("p"), F.transform("s", lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("pla"))
    games = plays.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("p", "pla"))).alias("pd"))  # a game's periods
    return games.select("game_id", F.to_json(F.struct(F.struct("pd").alias("g"))).alias("payload"))


def envelope(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """game_id, payload: rows in archive order as a ``resultSets`` envelope."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    g = rows.groupBy("game_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", cells.alias("cells")))), lambda x: x["cells"]).alias("rowSet"))  # a game's rows
    one = F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, columns)).alias("headers"), "rowSet")
    return g.select("game_id", F.to_json(F.struct(F.array(one).alias("resultSets"))).alias("payload"))


