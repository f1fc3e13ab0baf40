"""Binned and running series over event times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.sweep import running_sums


def binned(df: DataFrame, by: list[str], at: str, bins: int) -> DataFrame:
    """``df`` with ``bin`` (0..bins-1) over each entity's own span; the last instant is in the last bin."""
    span = df.where(F.col(at).isNotNull()).groupBy(*by).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    joined = df.where(F.col(at).isNotNull()).join(span, by)
    step = (F.col("__hi") - F.col("__lo")) / bins
    place = F.when(step > 0, F.floor((F.col(at) - F.col("__lo")) / step)).otherwise(0)
    return joined.withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int")).drop("__lo", "__hi")


def cumulative_bins(df: DataFrame, by: list[str], at: str, value: Column, bins: int) -> DataFrame:
    """``by, bin, total, running`` for every bin, also empty ones. At most ``bins`` rows an entity are ordered."""
    sums = binned(df, by, at, bins).groupBy(*by, "bin").agg(F.sum(value).alias("total"))
    spine = sums.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spine.join(sums, [*by, "bin"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    run = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return full.withColumn("running", F.sum("total").over(run))


def crossing(df: DataFrame, by: list[str], at: str, value: Column, limits: dict[str, float], width: float = 3600.0) -> DataFrame:
    """First ``at`` at which the running total of ``value`` reaches each limit; null if never.

    Values of one instant count together. Totals are carried over shards of ``width``, so no entity is ordered whole.
    """
    sums = df.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.sum(value).alias("__v"))
    total = running_sums(sums, by, at, {"__v": "__run"}, width)
    return total.groupBy(*by).agg(
        *[F.min(F.when(F.col("__run") >= limit, F.col(at))).alias(name) for name, limit in limits.items()]
    )


def peak_window(df: DataFrame, by: list[str], at_micros: str, value: Column, micros: int) -> DataFrame:
    """Costliest window ``[t, t + micros)`` that opens at an event: ``by, opened, total``; the first of equals."""
    frame = W.partitionBy(*by).orderBy(at_micros).rangeBetween(0, micros - 1)
    sums = df.withColumn("__sum", F.sum(value).over(frame))
    best = F.max_by(F.struct(F.col(at_micros).alias("opened"), F.col("__sum").alias("total")),
                    F.struct(F.col("__sum"), -F.col(at_micros)))
    return sums.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def pace(df: DataFrame, by: list[str], at: str, value: Column, window: float) -> DataFrame:
    """Sums over the last ``window`` before each entity's last event and over the one before: ``now, before``."""
    last = df.groupBy(*by).agg(F.max(at).alias("__now"))
    age = F.col("__now") - F.col(at)
    return df.join(last, by).groupBy(*by).agg(
        F.sum(F.when(age < window, value).otherwise(0)).alias("now"),
        F.sum(F.when((age >= window) & (age < 2 * window), value).otherwise(0)).alias("before"),
    )


def thinned(df: DataFrame, by: list[str], order: str, value: str, points: int) -> DataFrame:
    """At most ``points`` rows an entity: the greatest ``value`` of each of ``points`` stretches of equal number."""
    w = W.partitionBy(*by).orderBy(order)
    cutted = df.withColumn("__b", F.ntile(points).over(w))
    best = F.max_by(F.struct(order, value), F.struct(F.col(value), -F.col(order)))
    return cutted.groupBy(*by, "__b").agg(best.alias("b")).select(*by, "b.*")
