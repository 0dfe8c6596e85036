"""Scalar rules: ids, clocks, dates, shot zones, weights. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD_SECONDS, OVERTIME_SECONDS = 720, 300


def lineup_id(members: str | Column) -> Column:
    """Members in numeric order, joined by ``-``."""
    return F.array_join(F.transform(F.array_sort(members), lambda x: x.cast("string")), "-")


def pair_id(a: str | Column, b: str | Column) -> Column:
    return F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def pairs_of(members: str | Column) -> Column:
    """All unordered pairs (a < b) of an array's members, as an array of structs."""
    m = F.array_sort(F.array_distinct(members))
    return F.flatten(F.transform(m, lambda a: F.transform(F.filter(m, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def rating(points: Column, possessions: Column) -> Column:
    """Points for each hundred possessions."""
    return 100.0 * points / possessions


def clock_seconds(clock: str | Column) -> Column:
    """``M:SS`` to seconds; null if malformed."""
    parts = F.split(clock, ":")
    minutes = F.try_element_at(parts, F.lit(1)).try_cast("int")
    seconds = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 2, minutes * 60 + seconds)


def period_length(period: str | Column) -> Column:
    return F.when(F.col(period) <= 4 if isinstance(period, str) else period <= 4, F.lit(PERIOD_SECONDS)).otherwise(F.lit(OVERTIME_SECONDS))


def elapsed(period: Column, remaining: Column) -> Column:
    return period_length(period) - remaining


def game_id(raw: str | Column) -> Column:
    """Ten digits, padded with zeros on the left."""
    return F.lpad(raw, 10, "0")


def season_of(padded: Column) -> Column:
    """``YYYY-YY`` from the fourth and fifth digits of a padded game id."""
    first = 2000 + F.substring(padded, 4, 2).cast("int")
    return F.concat_ws("-", first.cast("string"), F.lpad(((first + 1) % 100).cast("string"), 2, "0"))


def season_type(padded: Column) -> Column:
    return F.when(F.substring(padded, 3, 1) == "2", "Regular Season").when(F.substring(padded, 3, 1) == "4", "Playoffs")


def is_playoff(kind: Column) -> Column:
    return F.lower(kind).isin("playoffs", "playoff")


def iso_date(raw: str | Column) -> Column:
    """``YYYYMMDD`` or an ISO date, as a date; null otherwise."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    dashed = F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))
    return F.when(raw.rlike("^[0-9]{8}$"), F.try_to_date(dashed)).when(raw.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(raw, 1, 10)))


def first_text(*columns: str) -> Column:
    """The first of several columns that isn't null or empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def shot_class(shot_type: Column, zone: Column) -> Column:
    """corner3, three, rim, mid or other; a corner counts only for a three."""
    three = shot_type.startswith("3")
    return (
        F.when(three & zone.contains("Corner 3"), "corner3")
        .when(three, "three")
        .when(zone == "Restricted Area", "rim")
        .when(zone.isin("Mid-Range", "In The Paint (Non-RA)"), "mid")
        .otherwise("other")
    )


def free_throw(description: Column, fold_case: bool = False) -> Column:
    """made, missed or technical; profiles look for MISS as it is, production in any case."""
    text = F.upper(description) if fold_case else description
    return F.when(description.contains("Technical"), "technical").when(text.startswith("MISS"), "missed").otherwise("made")


def rebounds(description: Column) -> Column:
    """(off, def) running totals from a rebound's description; null if it names none."""
    pick = lambda g: F.nullif(F.regexp_extract(description, r"Off:(\d+)\s+Def:(\d+)", g), F.lit("")).cast("int")
    return F.struct(pick(1).alias("off"), pick(2).alias("def"))


def garbage_weight(period: Column, remaining: Column, margin: Column) -> Column:
    return F.when((period >= 4) & (remaining < 300) & (F.abs(margin) > 25), 0.2).otherwise(1.0)


def settled_points(raw: Column, technical: Column) -> Column:
    return raw - technical


def ambiguous(points: Column, limit: int = 6) -> Column:
    return (points < 0) | (points > limit)


def is_clutch(margin: Column, period: Column) -> Column:
    return (F.abs(margin) <= 6) & (period >= 4)


def role_pair_bin(a: Column, b: Column, k: int) -> Column:
    """The place of an unordered pair of roles among the k(k+1)/2 there are."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return lo * k - F.floor(lo * (lo - 1) / 2) + (hi - lo)


def draw(n: Column | int, *key: Column | str) -> Column:
    """A number from 0 to n - 1 from the first eight hex digits of the key's md5."""
    h = F.md5(F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in key]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or zero where b is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
