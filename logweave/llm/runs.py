"""Repeated consecutive events: collapse each run into one event.

Row numbers, twice: within the entity, and within (entity, value). Along a run
both rise by one, so their difference is constant and names the run. An entity
may hold a third of all rows, so it is cut into shards of ``shard`` consecutive
order keys: order keys are unique per entity once copies are removed, which
bounds a shard by its width. Runs are found inside shards; only the first and
the last run of a shard can go on in a neighbour. These are numbered and
differenced once more inside shards WIDER times as wide, so that sparse keys, of
which a narrow shard holds one, do not come together in one task either, and what
touches the ends of those once more per entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Consecutive order keys per shard.
SHARD = 4096
#: How much wider the shards of the second level are.
WIDER = 4096


def _differences(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``__run``: the row number less the row number within the value; constant along a run."""
    inside = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    alike = F.row_number().over(W.partitionBy(*by, "value").orderBy(*order))
    return df.withColumn("__run", inside - alike)


def collapse_runs(
    df: DataFrame, entity: str, order: str, value: Column, time: str | None = None, shard: int = SHARD
) -> DataFrame:
    """One row per run: ``entity, value, first_seq, last_seq, n, started, ended, duration``.

    ``value`` is the canonical value; null means the event has none and is the
    same as no other, so it is a run of its own. ``order`` is a whole number,
    unique per entity apart from copies; copies (the same entity and order) are
    one event, of disagreeing copies the smallest value and time count. Rows with
    a null entity or order have no place in a sequence and are left out.
    ``started``/``ended`` are the least and greatest known ``time`` of the run,
    null if none is known. A single event is a run with ``n`` 1. Empty input
    gives an empty result; extra columns do not matter.
    """
    at = F.col(time).cast("double") if time else F.lit(None).cast("double")
    events = (
        df.select(
            F.col(entity).alias("entity"), F.col(order).cast("long").alias("seq"),
            value.alias("value"), at.alias("at"),
        )
        .where("entity is not null and seq is not null")
        .withColumn("k", F.floor(F.col("seq") / F.lit(shard)).cast("long"))
        .repartition("entity", "k")  # serves the copies, both windows and the runs below
        .groupBy("entity", "k", "seq")
        .agg(F.min("value").alias("value"), F.min("at").alias("at"))
    )
    chain = events.select("entity", "k", "value", F.col("seq").cast("double").alias("place"), F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"),
                          F.lit(1).cast("long").alias("n"), F.col("at").alias("started"), F.col("at").alias("ended"))
    done, chain = _level(chain)
    wide = F.floor(F.col("place") / F.lit(shard * WIDER)).cast("long")
    more, chain = _level(chain.withColumn("k", wide))
    last = _runs(chain.withColumn("k", F.lit(0)), ["entity"]).where("value is not null").select(*COLUMNS)
    return done.unionByName(more).unionByName(last).withColumn("duration", F.col("ended") - F.col("started"))


COLUMNS = ["entity", "value", "first_seq", "last_seq", "n", "started", "ended"]


def _runs(chain: DataFrame, by: list[str]) -> DataFrame:
    """Runs of ``(entity, k, value, place, first_seq, last_seq, n, started, ended)`` inside ``by``; a row without a value is its own."""
    lone = F.when(F.col("value").isNull(), F.col("place"))
    return _differences(chain, by, ["place"]).groupBy(*by, "value", "__run", lone.alias("lone")).agg(
        F.min("place").alias("place"), F.max("place").alias("until"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        F.sum("n").alias("n"), F.min("started").alias("started"), F.max("ended").alias("ended"),
    )


def _level(chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished runs of all shards ``k``, and the chain of those that may go on in a neighbour.

    Between the head and the tail of a shard, and beside events without a value,
    nothing may join: a row without a value stands there, so that the numbers move on.
    """
    local = _runs(chain, ["entity", "k"])
    edge = W.partitionBy("entity", "k")
    local = local.withColumns({"head": F.col("place") == F.min("place").over(edge), "tail": F.col("until") == F.max("until").over(edge)})
    # An event without a value, and no other row of a chain, is counted by n.
    finished = local.where("n is not null and (value is null or not (head or tail))").select(*COLUMNS)
    ends = local.where("head or tail")
    wall = F.when(
        ~(F.col("head") & F.col("tail")) | F.col("value").isNull(),
        F.when(F.col("head"), F.col("until") + F.lit(0.5)).otherwise(F.col("place") - F.lit(0.5)),
    )
    # A wall that is at an end of a wider shard stays where it is.
    wall = F.when(F.col("value").isNull() & F.col("n").isNull(), F.col("place")).otherwise(wall)
    nothing = [F.lit(None).cast(chain.schema[c].dataType).alias(c) for c in COLUMNS[1:]]
    walls = ends.where(wall.isNotNull()).select("entity", nothing[0], wall.alias("place"), *nothing[1:])
    runs = ends.where("value is not null").select("entity", "value", "place", *COLUMNS[2:])
    return finished, runs.unionByName(walls)
