"""Live forms of the batch operators: follow logs, recompute what changed, alert on changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from logweave.functions.lines import parse_line
from logweave.sources.tail import TailSource


def follow(spark: SparkSession, pattern: str, checkpoint: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Stream of ``file, generation, at_byte, line, v`` of the whole lines of growing files.

    ``checkpoint`` is the checkpoint of the query the stream goes into: a restarted reader finds its generations there.
    """
    spark.dataSource.register(TailSource)
    source = spark.readStream.format("tail_jsonl").option("path", pattern).option("maxBytes", str(max_bytes))
    lines = source.option("checkpoint", checkpoint).load()
    return lines.withColumn("v", parse_line(F.col("line")))


def newest_generation(lines: DataFrame) -> DataFrame:
    """Lines of the latest reading of each file (batch side): what a truncated file had before is gone."""
    last = lines.groupBy("file").agg(F.max("generation").alias("__g"))
    return lines.join(last, "file").where("generation = __g").drop("__g")


def keep_bronze(lines: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append followed lines to a Parquet table; the source's offsets and the file sink make it exactly once."""
    writer = lines.drop("v").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def recompute_changed(
    changes: DataFrame, key: str, compute: Callable[[DataFrame], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Call ``compute(keys)`` with the distinct keys each micro-batch touched: batch operators then redo just those."""

    def batch(df: DataFrame, _: int) -> None:
        keys = df.select(key).where(F.col(key).isNotNull()).distinct()
        if not keys.isEmpty():
            compute(keys)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "5 minutes", late: str | None = None) -> DataFrame:
    """Events of each kind per window.

    Without ``late`` no event is ever dropped: use it with the update mode, counts of a window are given
    again when a late event changes them. With ``late`` windows close when the watermark has passed them.
    """
    timed = events.withWatermark(at, late) if late else events
    return (
        timed.groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("opened"), kind, "n")
    )


def alert_edges(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """``key, order, state, was`` whenever a key's state differs from the one before, across micro-batches.

    Only the last order and state of a key are held; rows that come late (a lower
    order than what was seen) are passed over.
    """
    schema = f"{key} string, {order} long, {state} string, was string"

    def step(keys: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        seen, now = held.get if held.exists else (None, None)
        out = []
        for row in pd.concat(list(frames)).sort_values(order).itertuples(index=False):
            at, value = int(getattr(row, order)), getattr(row, state)
            if seen is not None and at <= seen:
                continue
            if value != now:
                out.append((keys[0], at, value, now))
            seen, now = at, value
        held.update((seen, now))
        yield pd.DataFrame(out, columns=[key, order, state, "was"])

    return events.groupBy(key).applyInPandasWithState(
        step, schema, "seen long, now string", "append", GroupStateTimeout.NoTimeout
    )
