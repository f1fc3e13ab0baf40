"""Messages delivered more than once: keep exactly one copy of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.runtime import strip


def _identifier(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """``df`` with ``__id`` (trimmed identifier, null if blank) and ``__k0..`` (scope)."""
    trimmed = strip(F.col(id_col))
    scope = {f"__k{i}": F.col(k) for i, k in enumerate(keys)}
    return df.withColumns({"__id": F.when(F.length(trimmed) > 0, trimmed), **scope})


def earliest_deliveries(
    df: DataFrame, keys: list[str], id_col: str, time_col: str, tie_col: str
) -> DataFrame:
    """``tie_col`` of the one delivery to keep of every identified message.

    A hash aggregation per identifier takes ``min_by`` over a struct of delivery
    time and tie-break, so each map task hands on one row per message it saw: a
    message with a third of all deliveries costs one row per map task. A missing
    time comes after every known one. Rows without an identifier or a tie-break
    have no copies and are not part of this table.
    """
    scoped = _identifier(df, keys, id_col).where(F.col("__id").isNotNull() & F.col(tie_col).isNotNull())
    when = F.struct(F.col(time_col).isNull().alias("late"), F.col(time_col), F.col(tie_col))
    scope = [F.col(f"__k{i}") for i in range(len(keys))]
    return scoped.groupBy(*scope, "__id").agg(
        F.min_by(F.col(tie_col), when).alias("__kept"), F.count(F.lit(1)).alias("__copies")
    )


def surplus_deliveries(
    df: DataFrame,
    keys: list[str],
    id_col: str,
    time_col: str = "received_at",
    tie_col: str = "delivery_id",
) -> DataFrame:
    """Every delivery but the kept one of each message, with all columns of ``df``.

    Deliveries are of one message if ``keys`` are equal (null equals null) and the
    identifiers are equal without outer white space; a null or blank identifier
    equals none. ``tie_col`` must be unique per delivery and is the join key, so
    the anti join is spread evenly whatever the copies of one message number.
    A row whose ``tie_col`` is null cannot be named: it is compared with none and never surplus.
    An empty input gives an empty result; extra columns pass through.
    """
    kept = earliest_deliveries(df, keys, id_col, time_col, tie_col).select("__kept")
    identified = _identifier(df, keys, id_col).where(
        F.col("__id").isNotNull() & F.col(tie_col).isNotNull()
    )
    return (
        identified.join(kept, F.col(tie_col) == F.col("__kept"), "left_anti").select(
            *[identified[c] for c in df.columns]
        )
    )


def deduplicate_deliveries(
    df: DataFrame,
    keys: list[str],
    id_col: str,
    time_col: str = "received_at",
    tie_col: str = "delivery_id",
) -> DataFrame:
    """``df`` with exactly one delivery of each message; unidentified rows all stay."""
    surplus = surplus_deliveries(df, keys, id_col, time_col, tie_col)
    gone = surplus.select(F.col(tie_col).alias("__gone"))
    return df.join(gone, F.col(tie_col) == F.col("__gone"), "left_anti")
