"""Search over rows: every term must be found in the (already redacted) text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TERMS, MAX_QUERY, LEAST_QUERY = 8, 200, 2


def terms_of(query: str) -> list[str]:
    """At most eight lower-case terms of a query of 2 to 200 characters; none if it is too short."""
    q = query.strip().lower()[:MAX_QUERY]
    return list(dict.fromkeys(q.split()))[:MAX_TERMS] if len(q) >= LEAST_QUERY else []


def matches(haystack: Column, query: str) -> Column:
    """True where every term of ``query`` is a substring of the lower-cased ``haystack``."""
    found = F.lit(bool(terms_of(query)))
    for term in terms_of(query):
        found = found & F.contains(F.lower(haystack), F.lit(term))
    return found


def search_calls(df: DataFrame, fields: list[str], query: str, group: list[str], at: str, ok: str, limit: int, failed_only: bool = False) -> DataFrame:
    """Matching calls, equal ones of a group collapsed: ``calls, failed, latest``; newest first, at most ``limit``.

    With ``failed_only`` an empty query is allowed and means all.
    """
    hit = matches(F.concat_ws("\n", *fields), query)
    if failed_only:
        hit = (hit if terms_of(query) else F.lit(True)) & ~F.coalesce(F.col(ok), F.lit(True))
    rows = df.where(hit).groupBy(*group).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col(ok)).alias("failed"), F.max(at).alias("latest")
    )
    return rows.orderBy(F.col("latest").desc_nulls_last(), *group).limit(limit)
