"""Events to intervals: which window an event falls into, with coverage and zero-filled results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import windows


def spans(df: DataFrame, by: list[str], start: str, tie: str, last_end: Column) -> DataFrame:
    """Windows with ``is_last``, for the tail rule."""
    found = windows(df, by, start, tie, last_end)
    order = Window.partitionBy(*by).orderBy(F.desc(start), F.desc(tie))
    return found.withColumn("is_last", F.row_number().over(order) == 1)


def attribute(events: DataFrame, windowed: DataFrame, by: list[str], at: str, start: str, window_id: str, tail: float = 1.0) -> DataFrame:
    """Events with the id of the window [start, end) they fall into; null if none.

    An event past all windows by less than ``tail`` seconds belongs to the last. Windows of a group
    don't overlap, so the latest start at or before the event decides: events and windows are
    merged into one stream for each group and the last window carries forward. One shuffle, no
    range join, and the work stays linear in a group of any size.
    """
    event_columns = events.columns
    marks = windowed.where(F.col(start) < F.col("window_end")).select(*by, F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(window_id).alias("id"), F.col("window_end").alias("end"), F.col("is_last").alias("last")).alias("__w"))
    lasts = windowed.where((F.col(start) >= F.col("window_end")) & F.col("is_last")).select(*by, F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.struct(F.col(window_id).alias("id"), F.col("window_end").alias("end"), F.col("is_last").alias("last")).alias("__w"))
    kind = "struct<id:{},end:double,last:boolean>".format(windowed.schema[window_id].dataType.simpleString())
    probes = events.select(*by, F.col(at).cast("double").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(kind).alias("__w"), F.struct(*event_columns).alias("__e"))
    stream = marks.union(lasts).withColumn("__e", F.lit(None).cast(probes.schema["__e"].dataType)).unionByName(probes)
    order = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = stream.withColumn("__in", F.last("__w", ignorenulls=True).over(order)).where("__kind = 1")
    inside = F.col("__at") < F.col("__in.end")
    late = F.col("__in.last") & (F.abs(F.col("__at") - F.col("__in.end")) < tail)
    return carried.select("__e.*", F.when(inside | late, F.col("__in.id")).alias(window_id))


def window_counts(matched: DataFrame, window_id: str, **flags: Column) -> DataFrame:
    """Counters of each window that has an event; windows without one are absent."""
    return matched.where(F.col(window_id).isNotNull()).groupBy(window_id).agg(*[F.sum(f.cast("long")).alias(n) for n, f in flags.items()])


def coverage(matched: DataFrame, window_id: str, on_roster: Column | None = None) -> DataFrame:
    """One row: total, matched, unmatched and off-roster events and the match rate."""
    hit = F.col(window_id).isNotNull()
    roster = F.lit(True) if on_roster is None else F.coalesce(on_roster, F.lit(False))
    total = F.count(F.lit(1))
    n = lambda c: F.sum(c.cast("long"))
    return matched.agg(total.alias("total"), n(hit & roster).alias("matched"), n(~hit).alias("unmatched"), n(hit & ~roster).alias("off_roster")).withColumn(
        "match_rate", F.coalesce(F.try_divide(F.col("matched").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    )


def zero_filled(members: DataFrame, counted: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every row of ``members``, with zero where nothing was counted."""
    return members.join(counted, keys, "left").withColumns({v: F.coalesce(F.col(v), F.lit(0)) for v in values})


def credited(matched: DataFrame, members: DataFrame, window_id: str, member: str, /, **sums: Column) -> DataFrame:
    """``sums`` over the events of each member of each window, zero where there are none, and a row with a
    null member for a window's events of others: no matched event is lost. members: (window_id, member)."""
    on = matched.where(F.col(window_id).isNotNull()).join(members.select(window_id, member, F.lit(True).alias("__on")), [window_id, member], "left")
    counted = on.groupBy(window_id, F.when(F.col("__on"), F.col(member)).alias(member)).agg(*[c.alias(n) for n, c in sums.items()])
    mine = zero_filled(members.select(window_id, member), counted.where(F.col(member).isNotNull()), [window_id, member], list(sums))
    return mine.unionByName(counted.where(F.col(member).isNull()))
