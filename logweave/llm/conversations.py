"""Rebuilding conversations from message rows, and dropping those that are unsound.

Rows are partitioned by conversation and sorted by the order key inside it, by
one range partitioning on (conversation, time, seq): a conversation with a third
of all rows spans many partitions instead of one. A finite-state automaton reads
each stretch of a conversation; its effect (first and last speaker, and whether
two user turns met inside) composes, so the stretches' effects are folded in
order to one verdict a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.lines import is_object, parse_line
from logweave.runtime import cut

#: Speakers as the automaton sees them: other roles, user, assistant.
OTHER, USER, ASSISTANT = 0, 1, 2


def _text(path: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(v, '{path}', '{kind}')")


def _is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)[^\s\p{Cntrl}\p{Z}]")


def _blank_content(content: Column) -> Column:
    """Absent, null, an empty list, or only blank text. Blocks other than text are not blank."""
    schema = F.schema_of_variant(content)
    block = lambda b: (
        F.when(F.schema_of_variant(b).startswith("OBJECT"), F.when(
            F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit("text")) == "text",
            _is_blank(F.try_variant_get(b, "$.text", "string"))).otherwise(False))
        .when(F.schema_of_variant(b) == "STRING", _is_blank(F.try_variant_get(b, "$", "string")))
        .when(F.schema_of_variant(b) == "VOID", True).otherwise(False)
    )
    return (
        F.when(content.isNull() | (schema == "VOID"), True)
        .when(schema == "STRING", _is_blank(F.try_variant_get(content, "$", "string")))
        .when(schema.startswith("ARRAY"), F.forall(F.try_variant_get(content, "$", "array<variant>"), block))
        .otherwise(False)
    )


def read_entries(df: DataFrame, content: bool = True) -> DataFrame:
    """One row per entry of ``(transcript_id, seq, generation, v)`` lines.

    Lines that are no JSON object are ignored. Entries with the same uuid are one:
    the lowest generation, then seq, counts. An entry without a uuid stands alone.
    Without ``content`` the contents themselves are left behind: verdicts need
    only whether they are blank, and nothing wide is shuffled then.
    """
    columns = [c for c in ("transcript_id", "generation", "seq", "at_s") if c in df.columns]
    parsed = df.select(*columns, parse_line(F.col("v")).alias("v"), F.xxhash64("v").alias("line"))
    parsed = parsed.where(F.col("transcript_id").isNotNull() & is_object(F.col("v")))
    side = F.lower(F.trim(_text("$.isSidechain")))
    stamp = _text("$.timestamp")
    when = F.coalesce(F.unix_micros(F.try_to_timestamp(stamp)), (F.col("at_s") * 1_000_000).cast("long"))
    body = F.try_variant_get(F.col("v"), "$.message.content", "variant")
    entries = parsed.select(
        "transcript_id", "generation", "seq", "line",
        _text("$.uuid").alias("uuid"), _text("$.parentUuid").alias("parent_uuid"),
        F.coalesce(_text("$.type"), F.lit("")).alias("type"),
        F.when(side.isin("true", "1"), 1).otherwise(0).alias("is_sidechain"),
        when.alias("at"), _text("$.message.role").alias("role"),
        _blank_content(body).alias("blank"), *([body.cast("string").alias("content")] if content else []),
    )
    first = F.struct(F.coalesce("generation", F.lit(0)), F.coalesce("seq", F.lit(1 << 62)), "line")
    known = entries.where("uuid is not null").groupBy("uuid").agg(
        F.min_by(F.struct(*entries.columns), first).alias("e")
    )
    return known.select("e.*").unionByName(entries.where("uuid is null"))


def _speaker(row_role: str = "role") -> Column:
    return F.when(F.col(row_role) == "user", USER).when(F.col(row_role) == "assistant", ASSISTANT).otherwise(OTHER)


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The automaton over one sorted partition: one row per conversation met in a batch."""
    serial = 0
    for pdf in batches:
        if pdf.empty:
            continue
        side = pdf["is_sidechain"].to_numpy()
        name = pdf["transcript_id"].to_numpy()
        speaker = pdf["speaker"].to_numpy()
        fresh = np.ones(len(pdf), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (side[1:] != side[:-1])
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(pdf)) - 1
        meets = np.zeros(len(pdf), bool)
        meets[1:] = (speaker[1:] == USER) & (speaker[:-1] == USER) & ~fresh[1:]
        yield pd.DataFrame({
            "transcript_id": name[starts], "is_sidechain": side[starts],
            "serial": np.arange(serial, serial + len(starts)),
            "first": speaker[starts].astype("int32"), "last": speaker[ends].astype("int32"),
            "doubled": np.logical_or.reduceat(meets, starts),
            "odd": np.logical_or.reduceat(speaker == OTHER, starts),
        })
        serial += len(starts)


_STRETCH = (
    "transcript_id string, is_sidechain int, part int, serial long, first int, last int, doubled boolean, odd boolean"
)


def _with_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One stretch a conversation and partition: stretches of batches are joined before they leave the worker."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held = None
    for pdf in _stretches(batches):
        pdf.insert(2, "part", np.int32(part))
        if held is not None:
            before, after = held.iloc[0], pdf.iloc[0]
            if before["transcript_id"] == after["transcript_id"] and before["is_sidechain"] == after["is_sidechain"]:
                meets = before["last"] == USER and after["first"] == USER
                pdf.loc[0, ["serial", "first", "doubled", "odd"]] = [
                    before["serial"], before["first"], bool(before["doubled"] or after["doubled"] or meets), bool(before["odd"] or after["odd"]),
                ]
            else:
                yield held
        held = pdf.iloc[[-1]].reset_index(drop=True)
        if len(pdf) > 1:
            yield pdf.iloc[:-1]
    if held is not None:
        yield held


def ordered_messages(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """Messages ranged and sorted by conversation, time, seq; hot conversations are split."""
    n = partitions or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["transcript_id", "is_sidechain", "late", "at", "seq", "uuid"]
    messages = entries.where(F.col("type").isin("user", "assistant")).withColumn("late", F.col("at").isNull())
    return messages.repartitionByRange(n, *order).sortWithinPartitions(*order)


def conversation_verdicts(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(transcript_id, is_sidechain, reason)`` for every conversation; reason null if sound.

    ``entries`` is :func:`read_entries`. Reasons, the first that holds: ``empty``
    (no message that is not blank), ``broken`` (a parent that is no entry of the
    transcript, a speaker that is neither user nor assistant, or an assistant who
    opens), ``missing_reply`` (a user turn that is last or meets another).
    Messages without a time come last.
    """
    entries = cut(entries.drop("content", "line"))
    messages = entries.where(F.col("type").isin("user", "assistant"))
    spoken = entries.where("not blank").withColumn("speaker", _speaker())
    ordered = ordered_messages(spoken, partitions).select("transcript_id", "is_sidechain", "speaker")
    parts = ordered.mapInPandas(_with_part, _STRETCH)
    # A conversation gives one row for each partition that holds some of it.
    folded = parts.groupBy("transcript_id", "is_sidechain").agg(
        F.sort_array(F.collect_list(F.struct("part", "serial", "first", "last", "doubled", "odd"))).alias("s")
    )
    start = F.struct(F.lit(-1).alias("last"), F.lit(False).alias("doubled"))
    fold = F.aggregate(
        "s", start,
        lambda a, x: F.struct(
            x["last"].alias("last"),
            (a["doubled"] | x["doubled"] | ((a["last"] == USER) & (x["first"] == USER))).alias("doubled"),
        ),
    )
    states = folded.select(
        "transcript_id", "is_sidechain", F.element_at("s", 1)["first"].alias("first"),
        fold["last"].alias("last"), fold["doubled"].alias("doubled"), F.exists("s", lambda x: x["odd"]).alias("odd"),
    )
    known = entries.select("transcript_id", F.col("uuid").alias("parent_uuid")).where("parent_uuid is not null")
    lost = (
        messages.where("parent_uuid is not null")
        .join(known.distinct(), ["transcript_id", "parent_uuid"], "left_anti")
        .select("transcript_id", "is_sidechain").distinct().withColumn("lost", F.lit(True))
    )
    every = messages.select("transcript_id", "is_sidechain").distinct()
    keys = ["transcript_id", "is_sidechain"]
    reason = (
        F.when(F.col("last").isNull(), "empty")
        .when(F.col("lost") | F.col("odd") | (F.col("first") == ASSISTANT), "broken")
        .when((F.col("last") == USER) | F.col("doubled"), "missing_reply")
    )
    return every.join(states, keys, "left").join(lost, keys, "left").select(*keys, reason.alias("reason"))


def conversations(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """Messages of the sound conversations, in order: one row per turn.

    ``(transcript_id, is_sidechain, at, seq, uuid, role, content)``, ranged and
    sorted, so a writer gets them as conversations without gathering any of them
    into one value. Blank messages are left out.
    """
    entries = cut(entries)
    verdicts = conversation_verdicts(entries, partitions).where("reason is null").drop("reason")
    kept = entries.where("not blank").join(verdicts, ["transcript_id", "is_sidechain"], "left_semi")
    return ordered_messages(kept, partitions).select(
        "transcript_id", "is_sidechain", "at", "seq", "uuid", "role", "content"
    )
