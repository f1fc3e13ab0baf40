"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.runtime import cut, strip

#: The table of targets is one row per source; more rows than this are refused.
MAX_SOURCES = 10_000
#: Bits of a document's place by which a range is split, and of a place in all.
DIGIT, PLACE = 12, 60
#: A border range with at most this many documents is ordered; a larger one is split again.
ORDERED = 10_000


def water_fill(
    weights: Mapping[str, float], caps: Mapping[str, float], total: float
) -> dict[str, float]:
    """Share out ``total`` by ``weights`` with no source above its cap.

    Sources above their cap are clamped to it, what is left is shared out among
    the others by their weights, until none is above. If all are clamped the sum
    stays below ``total``. Weights that are null or not positive get nothing.
    """
    open_, out, left = {s: w for s, w in weights.items() if w and w > 0}, dict.fromkeys(weights, 0.0), float(total)
    while open_:
        share = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * share >= caps[s]]
        if not full:
            out.update({s: w * share for s, w in open_.items()})
            break
        for s in full:
            out[s] = float(caps[s])
            left -= caps[s]
            del open_[s]
        left = max(left, 0.0)
    return out


def largest_true_mix(weights: Mapping[str, float], caps: Mapping[str, float]) -> float:
    """The greatest total at which every source still holds its weight without going over its cap.

    Sources without any tokens cannot hold a weight and are left out of account.
    """
    fits = [caps[s] * sum(weights.values()) / w for s, w in weights.items() if w and w > 0 and caps[s] > 0]
    return min(fits, default=0.0)


def halfway(weights: Mapping[str, float], caps: Mapping[str, float]) -> float:
    """A total at which some sources are clamped and others take the excess (unless all hold their weight at their cap)."""
    return (largest_true_mix(weights, caps) + sum(caps[s] for s, w in weights.items() if w and w > 0)) / 2


def _borders(docs: DataFrame, rest: dict[str, int]) -> DataFrame:
    """``(source, rest, low, high, before)``: the range of places in which a source's ``rest`` tokens run out.

    ``before`` counts the tokens of all lower places. The range is split by DIGIT
    bits of the place at a time until it has at most ORDERED documents, so at most
    ``2 ** DIGIT`` rows a source leave the map side, however large the source.
    """
    spark, at = docs.sparkSession, {s: (0, 0, n) for s, n in rest.items() if n > 0}
    schema = "source string, low long, before long, rest long"
    done: list[tuple] = []
    for shift in range(PLACE - DIGIT, -1, -DIGIT):
        if not at:
            break
        border = F.broadcast(spark.createDataFrame([(s, *x) for s, x in at.items()], schema))  # one row a source
        inside = docs.join(border, "source").where(
            (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + F.lit(1 << (shift + DIGIT)))
        )
        digit = F.shiftright(F.col("place") - F.col("low"), shift)
        ranges = inside.groupBy("source", "low", "before", "rest", digit.alias("digit")).agg(
            F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")
        )
        running = F.sum("tokens").over(W.partitionBy("source").orderBy("digit").rowsBetween(W.unboundedPreceding, -1))
        falls = ranges.withColumn("before", F.col("before") + F.coalesce(running, F.lit(0))).where(
            (F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest"))
        )
        found = {r["source"]: r for r in falls.collect()}  # one row a source
        done += [(s, n, 1 << PLACE, 1 << PLACE, n) for s, (_, _, n) in at.items() if s not in found]  # all of it
        at = {}
        for s, r in found.items():
            low = r["low"] + (r["digit"] << shift)
            if r["n"] <= ORDERED or shift == 0:
                done.append((s, r["rest"], low, low + (1 << shift), r["before"]))
            else:
                at[s] = (low, r["before"], r["rest"])
    return spark.createDataFrame(done, "source string, rest long, low long, high long, before long")


def mix_sources(
    sized: DataFrame, targets: DataFrame, total: float | Callable[[dict, dict], float] | None = None, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """``(mix, report)`` for ``sized``: (doc_id, source, tokens) and ``targets``: (source, weight, max_repeats).

    ``mix`` has ``doc_id, source, tokens, repeats`` of every document taken at
    least once. Each source is taken whole as many times as fits its target, and
    once more in part: documents in the order of a seeded hash until the target is
    met as nearly as whole documents allow. No document is taken more than
    ``max_repeats`` times. ``total`` is the wanted number of tokens, or makes it of
    weights and caps; by default the largest at which every source holds its weight. ``report`` has, per source
    of ``targets``, sizes, target and actual shares and epochs.

    Sources are compared without case and outer white space; documents of a null
    or unlisted source, or with a null id, are left out. Equal targets given twice
    count once (the greatest weight and cap). Documents without tokens are never
    taken. Rows of one id and source are one document (the greatest size), so that
    no id goes over ``max_repeats``. Empty tables give an empty mix. More than
    MAX_SOURCES targets are refused.
    """
    name = F.lower(strip(F.col("source")))
    wanted = targets.select(name.alias("source"), "weight", "max_repeats").where("source is not null")
    wanted = wanted.groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("cap"))
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 64 - PLACE)
    docs = cut(
        sized.select("doc_id", name.alias("source"), F.col("tokens").cast("long").alias("tokens"))
        .where(F.col("doc_id").isNotNull() & (F.col("tokens") > 0) & F.col("source").isin([r["source"] for r in rows]))
        .groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens")).withColumn("place", place)
    )
    sizes = {r["source"]: r["t"] for r in docs.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    weights = {r["source"]: float(r["weight"] or 0) for r in rows}
    caps = {r["source"]: float(sizes.get(r["source"], 0) * max(r["cap"] or 0, 0)) for r in rows}
    asked = (total or largest_true_mix)(weights, caps) if total is None or callable(total) else float(total)
    shares = water_fill(weights, caps, asked)
    plan = []
    for r in rows:
        s, size = r["source"], sizes.get(r["source"], 0)
        whole = min(int(shares[s] // size), max(r["cap"] or 0, 0)) if size else 0
        rest = max(0, round(shares[s] - whole * size)) if whole < max(r["cap"] or 0, 0) else 0
        plan.append((s, weights[s], int(r["cap"] or 0), int(size), float(shares[s]), whole, int(rest)))
    spark = docs.sparkSession
    plan_df = spark.createDataFrame(
        plan, "source string, weight double, max_repeats int, available long, target double, whole int, rest long"
    )
    small = F.broadcast(plan_df)  # at most MAX_SOURCES rows, checked above
    edge = F.broadcast(_borders(docs, {p[0]: p[6] for p in plan}))  # one row a source
    known = docs.join(small.select("source", "whole"), "source").join(edge, "source", "left")
    # Only the range in which the target falls is ordered by document. The one on the border is taken if that comes nearer.
    order = W.partitionBy("source").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    inside = known.where("place >= low and place < high").withColumn("until", F.col("before") + F.sum("tokens").over(order))
    part = F.when(F.col("until") - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    outside = known.where("low is null or place < low or place >= high")
    below = F.when(F.col("place") < F.col("low"), 1).otherwise(0)
    columns = lambda extra: ["doc_id", "source", "tokens", (F.col("whole") + F.coalesce(extra, F.lit(0))).cast("int").alias("repeats")]
    mix = outside.select(*columns(below)).unionByName(inside.select(*columns(part))).where("repeats > 0")
    got = mix.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("actual"), F.max("repeats").alias("most_repeats")
    )
    everything = F.sum(F.coalesce("actual", F.lit(0))).over(W.partitionBy())  # one row a source
    report = plan_df.join(got, "source", "left").select(
        "source", "weight", "max_repeats", "available", F.round("target", 3).alias("target_tokens"),
        F.coalesce("actual", F.lit(0)).alias("actual_tokens"),
        F.try_divide(F.coalesce("actual", F.lit(0)), everything).alias("actual_share"),
        F.try_divide(F.coalesce("actual", F.lit(0)), F.col("available")).alias("epochs"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    return mix, report
