"""One row of each group by an order: latest, first, and one value per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column | str], values: list[str]) -> DataFrame:
    """``values`` of the row that is greatest by ``order`` in each group, by one aggregation
    with map-side partials (no sort of whole groups)."""
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = F.max_by(F.struct(*values), rank).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def first_by(df: DataFrame, keys: list[str], order: list[Column | str], values: list[str]) -> DataFrame:
    """As :func:`latest_by`, the least row by ``order``."""
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = F.min_by(F.struct(*values), rank).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def usage_latest_wins(
    df: DataFrame, keys: list[str], order: list[Column | str], first_values: list[str], last_values: list[str]
) -> DataFrame:
    """One row per message: ``first_values`` as first seen, ``last_values`` as last seen."""
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*first_values), rank).alias("__f"), F.max_by(F.struct(*last_values), rank).alias("__l")
    ).select(*keys, "__f.*", "__l.*")


def upsert(
    old: DataFrame, new: DataFrame, key: str, seen: str, first_seen: str, keep_after: Column | None = None,
    keep_rows: int | None = None,
) -> DataFrame:
    """History table after an upsert: the latest row per key, its least ``first_seen``,
    then retention by age and by number (the newest by ``seen``, ties by key)."""
    values = [c for c in old.columns if c not in (key, first_seen)]
    both = old.unionByName(new)
    out = both.groupBy(key).agg(
        F.min(first_seen).alias(first_seen), F.max_by(F.struct(*values), F.struct(*[F.col(c) for c in [seen, *values]])).alias("__r")
    ).select(key, first_seen, "__r.*")
    if keep_after is not None:
        out = out.where(F.col(seen) >= keep_after)
    if keep_rows is not None:
        out = out.orderBy(F.col(seen).desc(), F.col(key)).limit(keep_rows)
    return out.select(*old.columns)


def first_match_rule(df: DataFrame, subject: Column, rules: list[tuple[str, object]], default=None) -> Column:
    """Value of the first (pattern, value) rule whose lower-case glob matches ``subject``.

    Rules are a short ordered list, so the match is one CASE expression in the
    scan's projection: no join at all.
    """
    out, lowered = None, F.lower(subject)
    for pattern, value in rules:
        like = lowered.like(pattern.lower().replace("_", r"\_").replace("*", "%").replace("?", "_"))
        out = F.when(like, F.lit(value)) if out is None else out.when(like, F.lit(value))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)
