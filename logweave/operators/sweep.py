"""Boundary sweeps over intervals: concurrency, idle and solo time, time split by class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Default width of a shard of time: an hour in microseconds.
HOUR = 3_600_000_000


def running_sums(steps: DataFrame, by: list[str], at: str, sums: dict[str, str], width: float = HOUR) -> DataFrame:
    """``steps`` with the running sum of each column of ``sums`` (under its new name) and ``until``, the next ``at`` of the entity.

    ``at`` must be unique in an entity. Two levels: rows are ordered inside (entity,
    shard of time), and only one row a shard is ordered per entity, to carry the
    totals of earlier shards and the first instant of the next one.
    """
    sharded = steps.withColumn("__k", F.floor(F.col(at) / width))
    shards = sharded.groupBy(*by, "__k").agg(F.min(at).alias("__first"), *[F.sum(c).alias(f"__s_{c}") for c in sums])
    over = W.partitionBy(*by).orderBy("__k")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    carried = shards.select(
        *by, "__k", F.lead("__first").over(over).alias("__next"), *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__c_{c}") for c in sums]
    )
    inside = W.partitionBy(*by, "__k").orderBy(at)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    met = sharded.join(carried, [*by, "__k"]).withColumns({
        **{name: F.col(f"__c_{c}") + F.sum(c).over(upto) for c, name in sums.items()},
        "until": F.coalesce(F.lead(at).over(inside), "__next"),
    })
    return met.drop("__k", "__next", *[f"__c_{c}" for c in sums])


def levels(df: DataFrame, by: list[str], start: str, end: str, width: float = HOUR) -> DataFrame:
    """``by, t, up, down, level, until``: concurrency from each boundary to the next.

    Boundaries at one instant are summed before the sweep (map-side), so a burst
    of equal times is one row.
    """
    marks = df.select(*by, F.inline(F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col(end).alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )))
    steps = marks.groupBy(*by, "t").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).withColumn("step", F.col("up") - F.col("down"))
    return running_sums(steps, by, "t", {"step": "level"}, width).drop("step")


def concurrency(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """``by, peak, busy, wall, idle, solo`` of intervals with both ends (end >= start)."""
    sound = df.where(f"`{start}` is not null and `{end}` >= `{start}`")
    swept = levels(sound, by, start, end)
    span = F.coalesce(F.col("until") - F.col("t"), F.lit(0))
    swept = swept.groupBy(*by).agg(
        F.greatest(F.max("level"), F.lit(0)).alias("peak"), (F.max("t") - F.min("t")).alias("wall"),
        F.sum(F.when(F.col("level") == 0, span).otherwise(0)).alias("idle"),
        F.sum(F.when(F.col("level") == 1, span).otherwise(0)).alias("solo"),
        F.sum(F.col("level") * span).alias("busy"),
    )
    return swept


def covered_without(df: DataFrame, cuts: DataFrame, by: list[str], start: str, end: str, width: float = HOUR) -> DataFrame:
    """``by, kept, cut``: length of the union of intervals outside, and inside, the union of the ``cuts`` of the entity.

    Clip an interval to a window by taking what lies outside of the window as a cut.
    """
    of = lambda x, c: x.where(f"`{start}` is not null and `{end}` >= `{start}`").select(*by, start, end, F.lit(c).alias("__cut"))
    split = time_split(of(df, False).unionByName(of(cuts, True)), by, start, end, "__cut", width, inside=True)
    return split.select(*by, F.col("second_s").alias("kept"), F.col("both_s").alias("cut"))


def time_split(df: DataFrame, by: list[str], start: str, end: str, first_class: str, width: float = HOUR, inside: bool = False) -> DataFrame:
    """Wall time covered by class-one intervals, and by the others where class one is not: ``first_s, second_s``.

    ``first_class`` is a boolean column. With ``inside`` also the time both classes cover (``both_s``).
    """
    sound = df.where(f"`{start}` is not null and `{end}` >= `{start}`")
    one = F.col(first_class).cast("int")
    marks = sound.select(*by, F.inline(F.array(
        F.struct(F.col(start).alias("t"), one.alias("a"), (1 - one).alias("b")),
        F.struct(F.col(end).alias("t"), (-one).alias("a"), (one - 1).alias("b")),
    )))
    steps = marks.groupBy(*by, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    swept = running_sums(steps, by, "t", {"a": "ca", "b": "cb"}, width)
    span = F.coalesce(F.col("until") - F.col("t"), F.lit(0))
    return swept.groupBy(*by).agg(
        F.sum(F.when(F.col("ca") > 0, span).otherwise(0)).alias("first_s"),
        F.sum(F.when((F.col("ca") <= 0) & (F.col("cb") > 0), span).otherwise(0)).alias("second_s"),
        *([F.sum(F.when((F.col("ca") > 0) & (F.col("cb") > 0), span).otherwise(0)).alias("both_s")] if inside else []),
    )


def state_at(df: DataFrame, start: str, end: str, instant) -> DataFrame:
    """Replay: rows known at ``instant`` with ``state`` running or ended. The end instant counts as ended."""
    state = F.when(F.col(end).isNotNull() & (F.col(end) <= instant), "ended").otherwise("running")
    return df.where(F.col(start) <= instant).withColumn("state", state)
