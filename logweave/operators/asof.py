"""As-of and interval joins without cross products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.runtime import cut


#: Default width of a shard of time: an hour in microseconds.
HOUR = 3_600_000_000


def forward_asof(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, slack=0, width: float = HOUR) -> DataFrame:
    """``left`` with ``next_at``: the least ``right_at`` of the entity strictly after ``at + slack``.

    Both sides are put into one sequence and read once backwards inside (entity,
    shard of time); what no later point of its shard answers gets the first point
    of the next shard that has one. No pairs, and no entity is ordered whole.
    """
    marked = left.select("*", (F.col(at) + slack).alias("__t"), F.lit(None).cast(right.schema[right_at].dataType).alias("__r"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields if f.name not in by]
    keys = [F.col(b) for b in by]
    points = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("__r")).distinct()
    points = points.select(*keys, *blank, F.col("__r").cast(marked.schema["__t"].dataType).alias("__t"), "__r")
    both = marked.withColumn("__left", F.lit(1)).unionByName(points.withColumn("__left", F.lit(0)))
    both = both.withColumn("__k", F.floor(F.col("__t") / width))
    shards = both.groupBy(*by, "__k").agg(F.min("__r").alias("__f"))
    ahead = W.partitionBy(*by).orderBy(F.col("__k").desc()).rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    later = shards.select(*by, "__k", F.min("__f").over(ahead).alias("__later"))
    # Read backwards: a frame that grows is carried on, one that shrinks is counted anew for every row.
    # At one instant points come last, so a row sees only what is strictly later.
    after = W.partitionBy(*by, "__k").orderBy(F.col("__t").desc(), F.col("__left").desc()).rowsBetween(W.unboundedPreceding, -1)
    met = both.withColumn("next_at", F.min("__r").over(after)).where("__left = 1")
    same = F.lit(True)
    for b in [*by, "__k"]:
        same = same & met[b].eqNullSafe(later[b])
    out = met.join(later, same, "left").select(*[met[c] for c in left.columns], F.coalesce(met["next_at"], later["__later"]).alias("next_at"))
    return out


def window_join(rows: DataFrame, windows: DataFrame, by: list[str], at: str, opened: str, number: str, width: float = HOUR) -> DataFrame:
    """``rows`` with ``number`` of the window they fall into: ``[opened, next opened)``, the last one open.

    Rows before the first window have none. Ordered inside (entity, shard of time); the
    window open at a shard's start is carried over by one row a shard.
    """
    r = rows.withColumns({"__t": F.col(at), "__n": F.lit(None).cast(windows.schema[number].dataType), "__i": F.lit(1)})
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in by]
    w = windows.where(F.col(opened).isNotNull()).select(*by, *blank, F.col(opened).alias("__t"), F.col(number).alias("__n"), F.lit(0).alias("__i"))
    both = r.unionByName(w).withColumn("__k", F.floor(F.col("__t") / width))
    shards = both.groupBy(*by, "__k").agg(F.max_by("__n", F.when(F.col("__i") == 0, F.struct("__t", "__n"))).alias("__l"))
    before = W.partitionBy(*by).orderBy("__k").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    earlier = shards.select(*by, "__k", F.last("__l", ignorenulls=True).over(before).alias("__open"))
    upto = W.partitionBy(*by, "__k").orderBy("__t", "__i", "__n").rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("__in", F.last("__n", ignorenulls=True).over(upto)).where("__i = 1")
    same = F.lit(True)
    for b in [*by, "__k"]:
        same = same & met[b].eqNullSafe(earlier[b])
    return met.join(earlier, same, "left").select(*[met[c] for c in rows.columns], F.coalesce(met["__in"], earlier["__open"]).alias(number))


#: Levels of halving: stretches of up to 2 ** LEVELS shards are one node.
LEVELS = 40


def _cover(first: Column, last: Column) -> Column:
    """The nodes ``(level, node)`` that cover shards ``first`` to ``last``: at most two a level, node ``n`` of level ``l``
    standing for the shards ``n << l`` to ``((n + 1) << l) - 1``."""
    node = lambda level, n: F.array(F.struct(level.alias("level"), n.alias("node")))
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    odd = lambda n: F.pmod(n, F.lit(2)) == 1

    def step(acc: Column, level: Column) -> Column:
        a, z = acc["a"], acc["z"]
        left = F.when((a < z) & odd(a), node(level, a)).otherwise(none)
        a1 = F.when(odd(a), a + 1).otherwise(a)
        right = F.when((a1 < z) & odd(z), node(level, z - 1)).otherwise(none)
        z1 = F.when(odd(z), z - 1).otherwise(z)
        return F.struct(F.shiftright(a1, 1).alias("a"), F.shiftright(z1, 1).alias("z"), F.concat(acc["out"], left, right).alias("out"))

    start = F.struct(first.cast("long").alias("a"), (last + 1).cast("long").alias("z"), none.alias("out"))
    needed = F.ceil(F.log2((last - first + 2).cast("double"))).cast("int") + 1  # after that the two ends have met
    return F.aggregate(F.sequence(F.lit(0), F.least(needed, F.lit(LEVELS))), start, step, lambda acc: acc["out"])


def best_overlap(
    left: DataFrame, right: DataFrame, by: list[str], left_id: str, right_id: str, start: str, end: str, width: int
) -> DataFrame:
    """For each left interval the right one of its entity that overlaps it most: ``left_id, right_id, overlap``. Ties: least right id.

    Two intervals overlap if one starts within the other, so every pair is met once,
    where the later start meets the other interval. An interval is cut into the
    few nodes that cover its shards of ``width`` (two a level of halving, however
    long it is); a start lies in one node a level. Only levels in use are looked up.
    """
    def sided(df: DataFrame, tag: str, ident: str) -> DataFrame:
        return df.where(F.col(end) >= F.col(start)).select(*by, F.col(ident).alias(f"{tag}id"), F.col(start).alias(f"{tag}s"), F.col(end).alias(f"{tag}e"))

    def meet(spans: DataFrame, tag: str, points: DataFrame, at: str) -> DataFrame:
        nodes = spans.withColumn("n", F.explode(_cover(F.floor(F.col(f"{tag}s") / width), F.floor(F.col(f"{tag}e") / width))))
        nodes = nodes.select("*", "n.level", "n.node").drop("n")
        used = sorted(r["level"] for r in nodes.select("level").distinct().collect())  # at most LEVELS + 1 numbers
        shard = F.floor(F.col(at) / width).cast("long")
        places = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(shard, n).alias("node")) for n in used]) if used else None
        asked = points.withColumn("n", F.explode(places)).select("*", "n.level", "n.node").drop("n") if used else points.limit(0).crossJoin(nodes.select("level", "node").limit(0))
        return asked.join(nodes, [*by, "level", "node"])

    one, two = cut(sided(left, "l", left_id)), cut(sided(right, "r", right_id))  # each is read three times
    columns = [*by, "lid", "ls", "le", "rid", "rs", "re"]
    met = meet(one, "l", two, "rs").where("ls <= rs and rs < le").select(*columns)
    met = met.unionByName(meet(two, "r", one, "ls").where("rs < ls and ls < re").select(*columns))
    met = met.withColumn("overlap", F.least("le", "re") - F.greatest("ls", "rs")).where("overlap > 0")
    best = F.min_by(F.struct("rid", "overlap"), F.struct(-F.col("overlap"), F.col("rid")))
    return met.groupBy(*by, "lid").agg(best.alias("b")).select(
        *by, F.col("lid").alias(left_id), F.col("b.rid").alias(right_id), F.col("b.overlap").alias("overlap")
    )
