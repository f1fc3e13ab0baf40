"""Operators over ordered sequences of events within an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_repeat(df: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """Length of the run of equal values that ends each sequence: ``by, value, repeats``.

    Two aggregations instead of a sort: the last value, then the last place where
    the value differs from it.
    """
    base = df.select(*by, F.col(order).alias("__o"), value.alias("value"))
    last = base.groupBy(*by).agg(F.max_by("value", "__o").alias("value"))
    joined = base.withColumnRenamed("value", "__v").join(last, by)
    other = F.max(F.when(~F.col("__v").eqNullSafe(F.col("value")), F.col("__o")))
    broken = joined.groupBy(*by).agg(other.alias("__b"))
    tail = joined.join(broken, by).where("__b is null or __o > __b")
    return tail.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("repeats"))


def last_n(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The ``n`` last rows of each sequence with ``__back`` (1 is the last); top-k windows keep only ``n`` rows a group."""
    back = F.row_number().over(W.partitionBy(*by).orderBy(F.col(order).desc()))
    return df.withColumn("__back", back).where(F.col("__back") <= n)


def two_cycle(df: DataFrame, by: list[str], order: str, value: Column, length: int = 16) -> DataFrame:
    """Sequences whose last ``length`` events alternate strictly between two values: ``by, a, b``."""
    tail = last_n(df.select(*by, order, value.alias("value")), by, order, length)
    before = F.lag("value").over(W.partitionBy(*by).orderBy(order))
    tail = tail.withColumn("same", F.coalesce(F.col("value") == before, F.lit(False)))
    return tail.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values"), F.max("same").alias("same"),
        F.min("value").alias("a"), F.max("value").alias("b"),
    ).where(f"n = {length} and values = 2 and not same").select(*by, "a", "b")


def retry_chains(
    df: DataFrame, by: list[str], order: str, key: list[str], ok: str, gap: int = 3
) -> DataFrame:
    """Chains of attempts at the same call: ``by, key, first_order, last_order, attempts, worked``.

    Only completed calls (``ok`` not null) count and are numbered in the entity;
    an attempt goes on with a chain if the last one with its key failed and at
    most ``gap`` other calls lie between. Chains of one attempt are left out.
    """
    done = df.where(F.col(ok).isNotNull()).withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(order)))
    mine = W.partitionBy(*by, *key).orderBy("__rn")
    fresh = (
        F.lag("__rn").over(mine).isNull() | (F.col("__rn") - F.lag("__rn").over(mine) > gap + 1) | F.lag(ok).over(mine)
    )
    chained = done.withColumn("__new", fresh.cast("int")).withColumn(
        "__chain", F.sum("__new").over(mine.rowsBetween(W.unboundedPreceding, 0))
    )
    return chained.groupBy(*by, *key, "__chain").agg(
        F.min(order).alias("first_order"), F.max(order).alias("last_order"), F.count(F.lit(1)).alias("attempts"),
        F.max_by(ok, "__rn").alias("worked"), F.min("__rn").alias("first_rn"), F.max("__rn").alias("last_rn"),
    ).where("attempts > 1").drop("__chain")


def stuck(chains: DataFrame, totals: DataFrame, by: list[str], failures: int = 3, recent: int = 10) -> DataFrame:
    """The latest chain of an entity if it never worked, failed often, and is recent."""
    latest = chains.groupBy(*by).agg(F.max_by(F.struct(*[c for c in chains.columns if c not in by]), "last_rn").alias("c"))
    flat = latest.select(*by, "c.*").join(totals, by)
    return flat.where((~F.col("worked")) & (F.col("attempts") >= failures) & (F.col("n") - F.col("last_rn") < recent))


def split_turns(df: DataFrame, by: list[str], order: list[str], opens: Column) -> DataFrame:
    """``turn``: number of the latest opening row at or before each row (0 before the first)."""
    running = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("turn", F.sum(opens.cast("int")).over(running))


def transitions(df: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """Rows where ``state`` differs from the row before (the first row is one): alert edges."""
    before = F.lag(state).over(W.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(W.partitionBy(*by).orderBy(*order)) == 1
    return df.withColumn("was", before).withColumn("__first", first).where(
        F.col("__first") | ~F.col(state).eqNullSafe(F.col("was"))
    ).drop("__first")


def step_back(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``prev_<column>`` of the row before in the sequence."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def stall_islands(df: DataFrame, by: list[str], order: str, kind: str, at: str, is_reply: Column) -> DataFrame:
    """Runs of the same kind of failure before any reply: ``kind, first_at, repeats, resumed_at``.

    ``resumed_at`` is the least time of a later reply strictly after the run began.
    """
    w = W.partitionBy(*by).orderBy(order)
    marked = df.withColumn("__reply", is_reply.cast("int"))
    marked = marked.withColumn("__epoch", F.sum("__reply").over(w.rowsBetween(W.unboundedPreceding, 0)))
    back = W.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, -1)
    later = F.min(F.when(F.col("__reply") == 1, F.col(at))).over(back)
    errors = marked.withColumn("__resume", later).where("__reply = 0")
    inside = W.partitionBy(*by, "__epoch").orderBy(order)
    new = (~F.lag(kind).over(inside).eqNullSafe(F.col(kind))).cast("int")
    errors = errors.withColumn("__new", F.when(F.row_number().over(inside) == 1, 1).otherwise(new))
    errors = errors.withColumn("__isle", F.sum("__new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return errors.groupBy(*by, "__epoch", "__isle", kind).agg(
        F.min(at).alias("first_at"), F.count(F.lit(1)).alias("repeats"), F.min("__resume").alias("resumed_at")
    ).drop("__epoch", "__isle")
