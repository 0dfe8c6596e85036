"""Member profiles, roles, concentration, cohorts of moves, and outcome columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ordered


def tally(events: DataFrame, by: list[str], **flags: Column) -> DataFrame:
    """Conditional counts by member."""
    return events.groupBy(*by).agg(*[F.sum(f.cast("long")).alias(n) for n, f in flags.items()])


def last_then_sum(events: DataFrame, by: list[str], game: str, order: list[str], values: list[str]) -> DataFrame:
    """Running totals: the last of each game, then their sum."""
    last = events.groupBy(*by, game).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return last.groupBy(*by).agg(*[F.sum(f"v.{c}").alias(c) for c in values])


def assemble(parts: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Rows of any of ``parts`` by key, zero where a part has none: one long form, one aggregate."""
    long = None
    for p in parts:
        p = p.select(*keys, *[F.col(v).cast("double").alias(v) if v in p.columns else F.lit(0.0).alias(v) for v in values])
        long = p if long is None else long.unionByName(p)
    return long.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def usage(attempts: Column, free_throws: Column, turnovers: Column, possessions: Column) -> Column:
    """Possessions used for each possession played; null without possessions."""
    return F.try_divide(attempts + 0.44 * free_throws + turnovers, possessions)


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows without null features, and each feature's z-score by population deviation (zero: 1)."""
    full = df.where(" and ".join(f"{f} is not null" for f in features))
    stats = full.agg(*[F.avg(f).alias(f"__m_{f}") for f in features], *[F.stddev_pop(f).alias(f"__s_{f}") for f in features])
    sd = lambda f: F.when(F.col(f"__s_{f}") > 0, F.col(f"__s_{f}")).otherwise(1.0)
    return full.crossJoin(F.broadcast(stats)).withColumns({f"z_{f}": (F.col(f) - F.col(f"__m_{f}")) / sd(f) for f in features}).drop(*[f"__{k}_{f}" for f in features for k in "ms"])  # stats: one row


def concentration(members: DataFrame, row: str, features: list[str]) -> DataFrame:
    """For each row and feature, (sum z)^2 - sum z^2 over its members: how alike they are."""
    return members.groupBy(row).agg(*[(F.sum(f) * F.sum(f) - F.sum(F.col(f) * F.col(f))).alias(f) for f in features])


def role_pairs(stint_roles: DataFrame, k: int) -> DataFrame:
    """(row, member, role) to counts of role-pair bins by row; members without role give no pair."""
    r = stint_roles.where("role is not null")
    listed = r.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("member", "role"))).alias("m"))  # five members
    # A row's bins are counted within the row, so nothing is grouped by row and bin.
    bins = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["member"] > a["member"]), lambda b: S.role_pair_bin(a["role"], b["role"], k).cast("long"))))
    counted = listed.select("row", bins.alias("bins")).select("row", F.explode(F.transform(F.array_distinct("bins"), lambda x: F.struct(x.alias("bin"), F.size(F.filter("bins", lambda y: y == x)).cast("long").alias("n")))).alias("c"))
    return counted.select("row", "c.bin", "c.n")


def dominant_teams(exposure: DataFrame, threshold: int) -> DataFrame:
    """player, season_index, team: seasons with exactly one team of at least ``threshold`` possessions."""
    totals = exposure.groupBy("player_id", "season_index", "team").agg(F.sum("possessions").alias("possessions")).where(F.col("possessions") >= threshold)
    return totals.groupBy("player_id", "season_index").agg(F.count(F.lit(1)).alias("teams"), F.first("team").alias("team"), F.first("possessions").alias("possessions")).where("teams = 1").drop("teams")


def moves(exposure: DataFrame, threshold: int, changed: bool = True) -> DataFrame:
    """Players with one team in each of two seasons running: another one (moves), or the same
    (the phantom cohort)."""
    dominant = dominant_teams(exposure, threshold)
    a = dominant.select("player_id", "season_index", F.col("team").alias("from_team"), F.col("possessions").alias("before"))
    b = dominant.select("player_id", (F.col("season_index") - 1).alias("season_index"), F.col("team").alias("to_team"), F.col("possessions").alias("after"))
    both = a.join(b, ["player_id", "season_index"])
    return both.where(F.col("from_team") != F.col("to_team") if changed else F.col("from_team") == F.col("to_team"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of their key."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def permuted(df: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """``value`` dealt out anew among keys: the key at each place of the keys' order gets the value at
    the same place of a seeded hash order."""
    source, _ = ordered.numbered(df.select(key), [F.col(key)])
    dealt, _ = ordered.numbered(df, [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)])
    return source.join(dealt.select("place", value), "place").select(key, value)


OUTCOMES = {
    "pts_per_shot": ("points", "attempts"),
    "rim_share": ("rim", "attempts"),
    "three_share": ("threes", "attempts"),
    "turnover_rate": ("turnovers", "possessions"),
    "assist_rate": ("assisted", "made"),
}


def outcome(df: DataFrame, name: str, minimum: int = 1) -> DataFrame:
    """``df`` with ``value`` and ``weight`` of an outcome; rows whose own denominator is under the minimum go."""
    top, bottom = OUTCOMES[name]
    weight = F.coalesce(F.col(bottom), F.lit(0))
    return df.withColumn("weight", weight.cast("double")).withColumn("value", S.safe_ratio(F.coalesce(F.col(top), F.lit(0)), weight)).where(F.col("weight") >= minimum)


def dead_columns(df: DataFrame, columns: list[str], tiny: float = 1e-9) -> DataFrame:
    """column, range, deviation, dead, constant: which columns carry nothing."""
    stats = df.agg(*[F.struct((F.max(c) - F.min(c)).cast("double").alias("range"), F.stddev_pop(c).alias("deviation"), F.max(F.abs(F.col(c))).cast("double").alias("top")).alias(c) for c in columns])
    rows = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("x"))
    return rows.select("x.column", "x.s.range", "x.s.deviation", ((F.col("x.s.deviation") < tiny) & (F.col("x.s.top") < tiny)).alias("dead"), (F.col("x.s.range") == 0).alias("constant"))
