"""Overlapping and gapped time intervals: continuous periods and the gaps between.

Two-level merge. Time is cut into shards of fixed width. Every interval gives a
piece in the shard of its start, a piece in the shard of its end, and, if whole
shards lie between, one *bridge* that names them. Pieces are merged inside
``(entity, shard)``, so an entity with a third of all rows is spread over its
shards. Only coverage that touches a shard boundary, at most two pieces and one
bridge a shard, is stitched per entity; all other periods are final already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: End of an interval that has none. Far beyond any date, far from overflow.
FOREVER = 1 << 61


def _shard_of(column: str, shard: int) -> Column:
    """Number of the shard that holds ``column``; exact, also below zero."""
    return F.expr(f"({column} - pmod({column}, {shard}L)) div {shard}L")


def _islands(df: DataFrame, by: list[str]) -> DataFrame:
    """Merge ``s, e, n`` rows that overlap or touch inside ``by``."""
    order = W.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    start = F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)
    numbered = df.withColumn("__new", start).withColumn(
        "__isle", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))
    )
    return numbered.groupBy(*by, "__isle").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")
    ).drop("__isle")


def merge_intervals(
    df: DataFrame, entity: str, start: str | Column, end: str | Column, shard: int
) -> DataFrame:
    """Continuous periods ``(entity, s, e, n)`` of integer intervals.

    ``start``/``end`` are whole numbers (micro- or milliseconds); ``shard`` is the
    shard width in the same unit. A null end is open for ever (``e`` is then
    ``FOREVER``). Rows with a null entity or start, or with an end before the
    start, are left out. An interval of no length counts, also as the second one
    of a period. ``n`` counts the intervals of a period. Intervals that touch
    form one period. Empty input gives an empty result.
    """
    first = F.col(start) if isinstance(start, str) else start
    last = F.col(end) if isinstance(end, str) else end
    base = (
        df.select(
            F.col(entity).alias("entity"),
            first.cast("long").alias("s"),
            F.coalesce(last.cast("long"), F.lit(FOREVER)).alias("e"),
        )
        .where("entity is not null and s is not null and e >= s")
        .withColumn("a", _shard_of("s", shard))
        .withColumn("z", F.when(F.col("e") == FOREVER, FOREVER).otherwise(_shard_of("e", shard)))
    )
    edge = lambda k: k * F.lit(shard)
    # An end on a shard's first instant also gives a piece there, so that it can touch a start.
    pieces = base.select(
        "entity",
        F.inline(
            F.filter(
                F.array(
                    F.struct(
                        F.col("a").alias("k"), F.col("s").alias("s"),
                        F.least(F.col("e"), edge(F.col("a") + 1)).alias("e"),
                        F.lit(1).cast("long").alias("n"),
                    ),
                    F.when(
                        (F.col("z") > F.col("a")) & (F.col("e") < FOREVER),
                        F.struct(
                            F.col("z").alias("k"), edge(F.col("z")).alias("s"),
                            F.col("e").alias("e"), F.lit(0).cast("long").alias("n"),
                        ),
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    local = _islands(pieces, ["entity", "k"])
    bridges = (
        base.where(F.col("z") > F.col("a") + 1)
        .groupBy("entity", (F.col("a") + 1).alias("k"))
        .agg(F.max("z").alias("to"))
        .select(
            "entity", edge(F.col("k")).alias("s"),
            F.when(F.col("to") == FOREVER, FOREVER).otherwise(edge(F.col("to"))).alias("e"),
            F.lit(0).cast("long").alias("n"),
        )
    )
    # Whole shards under a bridge swallow what lies in them; that is known per shard, not per row.
    spans = _islands(bridges, ["entity"]).select(
        "entity", F.col("s").alias("bs"), F.col("e").alias("be")
    )
    shards = local.groupBy("entity", "k").agg(
        F.min("s").alias("first_s"), F.max("e").alias("last_e")
    )
    tagged = shards.select("entity", edge(F.col("k")).alias("at"), "k", F.lit(None).cast("long").alias("be"))
    marks = spans.select("entity", F.col("bs").alias("at"), F.lit(None).cast("long").alias("k"), "be")
    # The running end of bridges up to each shard: rows per entity are bounded by its shards.
    run = W.partitionBy("entity").orderBy("at", F.col("k").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    covered = (
        tagged.unionByName(marks)
        .withColumn("reach", F.max("be").over(run))
        .where(F.col("k").isNotNull())
        .select("entity", "k", (F.col("reach") > F.col("at")).alias("under"))
    )
    known = local.join(covered, ["entity", "k"])
    touches = (
        F.coalesce(F.col("under"), F.lit(False))
        | (F.col("s") == edge(F.col("k")))
        | (F.col("e") == edge(F.col("k") + 1))
    )
    known = known.withColumn("touch", touches)
    final = known.where(~F.col("touch")).select("entity", "s", "e", "n")
    loose = (
        known.where("touch")
        .groupBy(
            "entity", "k",
            # under a bridge all pieces of a shard are one; else the (at most two) edge pieces stay apart
            F.when(F.coalesce(F.col("under"), F.lit(False)), F.lit(-1)).otherwise(F.col("s")).alias("g"),
        )
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"))
        .select("entity", "s", "e", "n")
    )
    stitched = _islands(
        loose.unionByName(spans.select("entity", F.col("bs").alias("s"), F.col("be").alias("e"),
                                       F.lit(0).cast("long").alias("n"))),
        ["entity"],
    )
    return final.unionByName(stitched)


def gaps_between(periods: DataFrame, shard: int) -> DataFrame:
    """``(entity, s, e)`` from the end of each period to the start of the next.

    Periods must not overlap (the result of :func:`merge_intervals`). The next
    period is looked up inside ``(entity, shard)``; only one summary row a shard
    is ordered per entity.
    """
    keyed = periods.withColumn("k", _shard_of("s", shard))
    inside = keyed.withColumn("nxt", F.lead("s").over(W.partitionBy("entity", "k").orderBy("s")))
    firsts = keyed.groupBy("entity", "k").agg(F.min("s").alias("first_s")).withColumn(
        "after", F.lead("first_s").over(W.partitionBy("entity").orderBy("k"))
    )
    return (
        inside.join(firsts.select("entity", "k", "after"), ["entity", "k"])
        .select("entity", F.col("e").alias("s"), F.coalesce("nxt", "after").alias("e"))
        .where("e is not null")
    )


def union_length(df: DataFrame, entity: str, start: str, end: str, shard: int) -> DataFrame:
    """Total covered length per entity, overlaps counted once; open periods are left out."""
    merged = merge_intervals(df, entity, start, end, shard).where(F.col("e") < FOREVER)
    return merged.groupBy("entity").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
