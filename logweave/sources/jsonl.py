"""Append-only JSON-lines logs and small JSON documents, as tables with a VARIANT column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.lines import is_object, parse_line


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, block, pos, line, v, ok`` of every whole line of some files or globs.

    Lines part at ``\\n`` only. ``v`` is the parsed line, null if it is torn or no
    JSON; ``ok`` is true for JSON objects. ``(file, block, pos)`` orders lines as
    they stand in the file, also when a big file is read in several blocks.
    """
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    lines = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"),
    ).where("line <> ''")
    parsed = lines.withColumn("v", parse_line(F.col("line")))
    return parsed.withColumn("ok", is_object(F.col("v")))


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON object, counted per file."""
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("ok")).alias("bad"))


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, v`` of small JSON documents, one a file; ``v`` is null if it is no JSON."""
    whole = spark.read.option("wholetext", True).text(list(paths))
    return whole.select(F.col("_metadata.file_path").alias("file"), parse_line(F.col("value")).alias("v"))


def discover(spark: SparkSession, *paths: str, newest: int | None = None) -> DataFrame:
    """``file, session_id, size, modified``: sessions by their files, the newest first."""
    found = spark.read.format("binaryFile").load(list(paths)).select(
        F.col("path").alias("file"), F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_id"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    )
    found = found.orderBy(F.col("modified").desc(), "file")
    return found.limit(newest) if newest else found


def latest_title(lines: DataFrame) -> DataFrame:
    """The title of each file: the last one given by hand, else the last generated one."""
    get = lambda p: F.try_variant_get("v", p, "string")
    order = F.struct("block", "pos")
    return lines.where("ok").groupBy("file").agg(
        F.coalesce(
            F.max_by(get("$.customTitle"), F.when(get("$.customTitle").isNotNull(), order)),
            F.max_by(get("$.aiTitle"), F.when(get("$.aiTitle").isNotNull(), order)),
        ).alias("title")
    )


# The events a hook may report, and of each kind the details kept, with the field they come from.
HOOK_KINDS = {
    "SessionStart": "session_start", "SessionEnd": "session_end", "SubagentStart": "agent_start", "SubagentStop": "agent_stop",
    "Notification": "notification", "StopFailure": "error", "Stop": "turn_end",
}
HOOK_DETAILS = {
    "session_start": {"source": "source", "model": "model"}, "session_end": {"reason": "reason"},
    "agent_stop": {"message": "last_assistant_message"},
    "notification": {"notification_type": "notification_type", "message": "message"},
    "error": {"error_type": "error_type", "message": "error_message"},
}


def hook_events(lines: DataFrame, cut: int = 500) -> DataFrame:
    """Known hook events: ``session_id, kind, agent_id, agent_type, cwd, detail``; details are a fixed choice, redacted, then cut."""
    from logweave.functions.text import scrub

    get = lambda p: F.try_variant_get("v", f"$.{p}", "string")
    kinds = F.create_map(*[F.lit(x) for kv in HOOK_KINDS.items() for x in kv])
    kind = F.element_at(kinds, get("hook_event_name"))

    def details(fields: dict[str, str]):
        pairs = [c for name, field in fields.items() for c in (F.lit(name), F.substring(scrub(get(field)), 1, cut))]
        return F.map_filter(F.create_map(*pairs), lambda _, x: x.isNotNull() & (x != ""))

    detail = F.create_map().cast("map<string,string>")
    for name, fields in HOOK_DETAILS.items():
        detail = F.when(kind == name, details(fields)).otherwise(detail)
    out = lines.where("ok").select(
        get("session_id").alias("session_id"), kind.alias("kind"), get("agent_id").alias("agent_id"),
        get("agent_type").alias("agent_type"), get("cwd").alias("cwd"), detail.alias("detail"),
    )
    return out.where("kind is not null and session_id is not null")
