"""Queries on what state sessions and agents are in, and on what turns, errors, caches and contexts cost.

Every session is looked at in the instant of the last event known of it (``now``): a
round's start or end, a call for attention, or a tool call.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.config import DEFAULTS, EngineConfig
from logweave.functions import text as T
from logweave.functions.paths import canonical_text
from logweave.operators import intervals, lineage, sequences, status, transcripts
from logweave.operators.asof import forward_asof
from logweave.plans.call_queries import _C, calls
from logweave.plans.core_problems import ROUND_SHARD, agent_key
from logweave.plans.session_queries import agents, launches, rounds
from logweave.plans.state_sql import ORACLES as _SQL
from logweave.plans.transcript_queries import entries
from logweave.plans.usage_queries import messages
from logweave.runtime import cut, strip, table

#: Sessions of the test data write little to caches and contexts, so these thresholds are lower than the defaults.
SMALL = EngineConfig(rebuild_tokens=1_000, near_limit=0.01)
SESSION, AGENT = ["session_id"], ["session_id", "agent_id"]


def attention(spark, d):
    a = table(spark, d, "attention").dropDuplicates(["attention_id"])
    return a.withColumn("since", F.unix_micros("since"))


def _call_times(spark, d):
    return calls(spark, d).where("at_s is not null").select(
        "session_id", F.col("transcript_id").alias("agent_id"), F.round(F.col("at_s") * 1e6).cast("long").alias("seen")
    )


def session_states(spark, d):
    """Each session's last writing, the instant it is looked at, and whether it is live then."""
    written = _call_times(spark, d).groupBy("session_id").agg(F.max("seen").alias("written"))
    last = rounds(spark, d).groupBy("session_id").agg(F.max(F.greatest("s", "e")).alias("r"))
    asked = attention(spark, d).groupBy("session_id").agg(F.max("since").alias("a"))
    joined = written.join(last, "session_id", "full").join(asked, "session_id", "full")
    s = joined.select("session_id", "written", F.greatest("written", "r", "a").alias("now"), F.lit(None).cast("long").alias("ended_at"))
    return status.session_live(s, "written", "ended_at", "now").select("session_id", "written", "now", "live")


def _agent_seen(spark, d):
    """Last activity of every agent: its own word, or its last call."""
    own = agents(spark, d).select(*AGENT, F.unix_micros("last_activity_at").alias("seen"))
    return own.unionByName(_call_times(spark, d)).where("agent_id is not null").groupBy(*AGENT).agg(F.max("seen").alias("seen"))


def attention_pending(spark, d):
    """Calls for attention nothing has answered, the newest of each kind and agent."""
    seen = _agent_seen(spark, d)
    anyone = seen.groupBy("session_id").agg(F.max("seen").alias("seen"))
    return status.pending_attention(attention(spark, d), SESSION, seen, anyone)


def attention_shown(spark, d):
    """The call each session shows."""
    return status.most_urgent(attention_pending(spark, d), SESSION)


def agent_status(spark, d):
    """Status of every agent by its final round, the session's liveness, and what it waits for."""
    r = rounds(spark, d)
    final = r.groupBy(*AGENT).agg(F.max_by(F.struct("s", "e", "status"), F.struct("round_no", "s", "e")).alias("f"), F.lit(True).alias("known"))
    inside = calls(spark, d).groupBy("session_id", F.col("transcript_id").alias("agent_id")).agg(F.bool_or(F.col("ok").isNull()).alias("mid_tool"))
    waiting = attention_pending(spark, d).where(F.col("kind").isin(*status.BLOCKING) & F.col("agent_id").isNotNull())
    waiting = waiting.select(*AGENT).distinct().withColumn("waiting", F.lit(True))
    a = agents(spark, d).select(*AGENT).join(final.select(*AGENT, "f.*", "known"), AGENT, "left").join(inside, AGENT, "left")
    a = a.join(_agent_seen(spark, d), AGENT, "left").join(waiting, AGENT, "left").join(session_states(spark, d), "session_id", "left")
    word = status.status_of(*[F.col(c) for c in ("s", "e", "status", "mid_tool", "seen", "live", "waiting", "now", "known")])
    return a.select(*AGENT, word.alias("status"))


def status_counts(spark, d):
    return agent_status(spark, d).groupBy("session_id", "status").agg(F.count(F.lit(1)).alias("agents"))


def wait_states(spark, d):
    """Waits of agents and main sessions with their state and length."""
    times = _call_times(spark, d)
    return status.wait_states(attention(spark, d), SESSION, times, times.select("session_id", "seen"), session_states(spark, d), "now")


def waits_summary(spark, d):
    """Per session: time in which someone waited, waits summed, their numbers by state, the longest."""
    w = cut(wait_states(spark, d))
    spans = w.where("waited > 0").withColumn("until", F.col("since") + F.col("waited"))
    union = intervals.union_length(spans, "session_id", "since", "until", ROUND_SHARD).withColumnRenamed("entity", "session_id")
    count = lambda state: F.count_if(F.col("state") == state).alias(state)
    per = w.groupBy("session_id").agg(F.sum("waited").alias("summed"), F.max("waited").alias("longest"), *[count(x) for x in ("answered", "open", "unanswered")])
    return per.join(union, "session_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def assembled_agents(spark, d):
    """Agents with their launch by precedence, what they were asked, and who launched them."""
    metas = agents(spark, d).select(*AGENT, "tool_use_id", "description", "model", "launch_mode")
    made = launches(spark, d).select("session_id", "tool_use_id", "description", "model", "launcher_agent_id", "prompt", F.unix_micros("launched_at").alias("launched_at"))
    none = metas.limit(0).select(*AGENT, "tool_use_id", "launch_mode", F.lit(0).alias("seq"))
    return status.assemble_agents(metas, made, none, none.drop("launch_mode")).withColumn("brief", F.length("brief"))


def message_edges(spark, d):
    """Messages to agents the session knows, by their ids."""
    sent = calls(spark, d).where("tool = 'sendmessage'").select("session_id", F.col("transcript_id").alias("src"), agent_key(F.col("target")).alias("to"))
    known = agents(spark, d).select("session_id", agent_key(F.col("agent_id")).alias("to"), F.col("agent_id").alias("dst"))
    return lineage.message_edges(sent.where("to is not null"), known, SESSION)


def agent_verification(spark, d):
    """What followed the last code edit of each transcript: a check, or a run of the edited file, by its outcome.

    Calls are in the order of their times (none is 0), then of seq. Roles and files are those recorded with the calls.
    """
    kind = F.lower(strip("role"))
    name = T.file_name(F.col("ref"))
    c = calls(spark, d).where(kind.isin("edit", "check", "run")).select(
        "transcript_id", F.struct(F.coalesce("at_s", F.lit(0.0)).alias("t"), "seq").alias("o"), kind.alias("kind"), name.alias("file"), "ref", "ok"
    )
    last = c.where("kind = 'edit'").groupBy("transcript_id").agg(F.max_by(F.struct("o", "file"), "o").alias("e"))
    met = c.where("kind <> 'edit'").join(last, "transcript_id", "right")
    ran = F.exists(F.split(F.lower("ref"), "\n"), lambda x: T.file_name(x) == F.col("e.file"))
    counts = (F.col("kind") == "check") | ((F.col("kind") == "run") & (F.col("e.file") != "") & ran)
    after = F.when((F.col("o") > F.col("e.o")) & counts, F.col("o"))
    out = met.groupBy("transcript_id").agg(
        F.max_by(F.struct(F.coalesce("ok", F.lit(True)).alias("fine")), after).alias("c"),
        F.coalesce(F.bool_or((F.col("kind") == "check") & (F.col("o") < F.col("e.o"))), F.lit(False)).alias("checked_before"),
    )
    state = F.when(F.col("c").isNull(), "unchecked").when(F.col("c.fine"), "checked").otherwise("failing")
    return out.select("transcript_id", state.alias("state"), "checked_before")


def verification(spark, d):
    """Transcripts that edited code, by what came of it."""
    return agent_verification(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("transcripts"))


def failed_calls(spark, d):
    """Per session and tool: completed and failed calls, and the target that failed most often."""
    c = calls(spark, d).where("ok is not null")
    per = c.groupBy("session_id", "tool", F.coalesce(canonical_text(F.col("target")), F.lit("")).alias("t")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failed")
    )
    out = per.groupBy("session_id", "tool").agg(
        F.sum("calls").alias("calls"), F.sum("failed").alias("failed"), F.min_by("t", F.struct(-F.col("failed"), F.col("t"))).alias("most_common")
    )
    return out.where("failed > 0")


def api_errors(spark, d):
    """Per session and kind of API error: how often, and the time lost until the next message, overlaps once."""
    e = attention(spark, d).where("kind = 'error' and since is not null").select("session_id", "attention_id", F.coalesce("error_type", F.lit("error")).alias("error_type"), "since")
    m = messages(spark, d).where("at_s is not null").select("session_id", F.round(F.col("at_s") * 1e6).cast("long").alias("seen"))
    met = cut(forward_asof(e, m, SESSION, "since", "seen")).withColumn("who", F.struct("session_id", "error_type"))
    lost = intervals.union_length(met.where("next_at is not null"), "who", "since", "next_at", ROUND_SHARD).select("entity.*", "covered")
    per = met.groupBy("session_id", "error_type").agg(F.count(F.lit(1)).alias("errors"), F.count_if(F.col("next_at").isNull()).alias("ongoing"))
    return per.join(lost, ["session_id", "error_type"], "left").withColumn("lost", F.coalesce("covered", F.lit(0))).drop("covered")


def rebuilds(m, compactions=None, config: EngineConfig = DEFAULTS):
    """Messages that wrote much to the cache and read little back, beside the one before in their transcript, and why.

    ``compactions``: (session_id, transcript_id, compacted_at), optional.
    """
    keys = ["session_id", "transcript_id"]
    back = sequences.step_back(m.where("at_s is not null"), keys, ["at_s", "mid"], ["at_s", "model"]).where("prev_at_s is not null")
    back = back.where((F.col("cache_create") >= config.rebuild_tokens) & (F.col("cache_read") < config.rebuild_share * F.col("cache_create")))
    squeezed = F.lit(False)
    if compactions is not None:
        next_one = forward_asof(back.withColumn("__p", F.col("prev_at_s") - 1e-9), compactions, keys, "__p", "compacted_at", width=3600)
        back, squeezed = next_one.drop("__p"), F.coalesce(F.col("next_at") <= F.col("at_s"), F.lit(False))
    idle = F.col("at_s") - F.col("prev_at_s")
    cause = (
        F.when(squeezed, "compaction").when((F.col("prev_model") != F.col("model")) & (F.col("model") != "") & (F.col("prev_model") != ""), "model")
        .when(idle >= config.idle_long_s, "idle_long").when(idle >= config.idle_short_s, "idle_short").otherwise("unknown")
    )
    return back.withColumn("cause", cause).select(*keys, "mid", "at_s", "cache_create", "cause")


def waste_summary(spark, d):
    """Per session: rebuilt caches, their tokens by cause, and their share of all cache writes."""
    m = cut(messages(spark, d))
    r = rebuilds(m, config=SMALL)
    part = lambda cause: F.sum(F.when(F.col("cause") == cause, F.col("cache_create")).otherwise(0)).alias(cause)
    per = r.groupBy("session_id").agg(F.count(F.lit(1)).alias("rebuilds"), F.sum("cache_create").alias("rebuilt"),
                                      *[part(x) for x in ("model", "idle_long", "idle_short", "unknown")])
    written = m.groupBy("session_id").agg(F.sum("cache_create").alias("written"))
    return per.join(written, "session_id").withColumn("share", F.round(F.try_divide("rebuilt", "written"), 6)).drop("written")


def pressure_summary(spark, d):
    """The ten transcripts of each session with the greatest contexts: peak, limit, fill, and the latest fill."""
    size = F.col("cache_create") + F.col("cache_read") + F.col("input_tokens")
    limit = F.lit(DEFAULTS.context_limit)
    for part, n in reversed(DEFAULTS.context_limits):
        limit = F.when(F.contains(F.lower("model"), F.lit(part)), n).otherwise(limit)
    m = messages(spark, d).where("at_s is not null").withColumns({"size": size, "lim": limit})
    top = F.struct("size", -F.col("at_s"), "mid")
    per = m.groupBy("session_id", "transcript_id").agg(
        F.max("size").alias("peak"), F.max_by("lim", top).alias("lim"), F.max_by(F.struct("size", "lim"), F.struct("at_s", "mid")).alias("n")
    ).where("peak > 0")
    order = W.partitionBy("session_id").orderBy(F.col("peak").desc(), "transcript_id")
    per = per.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 10")
    return per.select("session_id", "transcript_id", "place", "peak", F.round(F.col("peak") / F.col("lim"), 6).alias("fill"),
                      F.round(F.col("n.size") / F.col("n.lim"), 6).alias("now_fill"))


def near_limit(spark, d):
    """Transcripts of live sessions whose agent goes on and whose context is nearly full now."""
    busy = agent_status(spark, d).where("status in ('running', 'waiting', 'stalled')").select("session_id", F.col("agent_id").alias("transcript_id"))
    live = session_states(spark, d).where("live").select("session_id")
    near = pressure_summary(spark, d).where(F.col("now_fill") >= SMALL.near_limit)
    return near.join(live, "session_id", "left_semi").join(busy, ["session_id", "transcript_id"], "left_semi").select("session_id", "transcript_id", "now_fill")


# Openings of user messages that nobody typed.
NOT_TYPED = ("<local-command", "<system-reminder>", "<task-notification", "<bash-input>", "<bash-stdout>", "<bash-stderr>", "Caveat:")


def typed_prompt(v: str = "v"):
    """What a user typed, white space collapsed; null for anything else. A slash command reads as it was typed."""
    get = lambda p, kind="string": F.try_variant_get(F.col(v), p, kind)
    content = get("$.message.content", "variant")
    kinds = F.transform(get("$.message.content", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string"))
    texts = F.filter(get("$.message.content", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "text")
    joined = F.array_join(F.transform(texts, lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))), " ")
    shape = F.schema_of_variant(content)
    body = F.when(shape == "STRING", get("$.message.content")).when(shape.startswith("ARRAY") & ~F.coalesce(F.array_contains(kinds, "tool_result"), F.lit(False)), joined)
    body = strip(body)
    tag = lambda t: F.regexp_extract(body, rf"(?s)<{t}>\s*(.*?)\s*</{t}>", 1)
    typed = F.when(tag("command-name") != "", strip(F.concat_ws(" ", tag("command-name"), tag("command-args")))).otherwise(body)
    truth = lambda p: F.coalesce(F.lower(get(p)).isin("true", "1"), F.lit(False))
    injected = F.lit(False)
    for start in NOT_TYPED:
        injected = injected | body.startswith(start)
    sound = (get("$.type") == "user") & ~truth("$.isMeta") & ~truth("$.isSidechain") & (F.length(body) > 0) & ~injected
    return F.when(sound, strip(F.regexp_replace(typed, r"(?U)\s+", " ")))


def _turns(spark, d):
    e = entries(spark, d).withColumn("prompt", typed_prompt())
    opens = F.col("prompt").isNotNull() & F.col("at").isNotNull()
    return cut(sequences.split_turns(e.drop("line"), ["transcript_id"], ["seq", "uuid"], opens).where("turn > 0"))


def turn_usage(spark, d, turns=None):
    """Per turn its start, seconds, and fresh tokens: a message stays with the turn it is first seen in, its latest usage counts."""
    e = turns or _turns(spark, d)
    span = e.groupBy("transcript_id", "turn").agg(F.min_by("at", F.struct("seq", "uuid")).alias("at"), F.max("at").alias("last_at"))
    used = e.where("type = 'assistant' and message_id <> ''").where(F.schema_of_variant(transcripts.get("$.message.usage", "variant")).startswith("OBJECT"))
    fresh = sum((transcripts._count(f"$.message.usage.{x}") for x in ("input_tokens", "output_tokens", "cache_creation_input_tokens")), F.lit(0))
    per = used.withColumn("fresh", fresh).groupBy("transcript_id", "message_id").agg(F.min("turn").alias("turn"), F.max_by("fresh", F.struct("seq", "uuid")).alias("fresh"))
    sums = per.groupBy("transcript_id", "turn").agg(F.sum("fresh").alias("fresh"), F.count(F.lit(1)).alias("messages"))
    out = span.join(sums, ["transcript_id", "turn"], "left")
    return out.select("transcript_id", "turn", F.round(F.greatest(F.col("last_at") - F.col("at"), F.lit(0.0)), 3).alias("seconds"),
                      F.coalesce("fresh", F.lit(0)).alias("fresh"), F.coalesce("messages", F.lit(0)).alias("messages"))


def prompt_summary(spark, d):
    """Per transcript: prompts, the median of their seconds, and the share of the costliest."""
    t = turn_usage(spark, d)
    return t.groupBy("transcript_id").agg(
        F.count(F.lit(1)).alias("prompts"), F.round(F.median("seconds"), 3).alias("median_s"),
        F.min_by("turn", F.struct(-F.col("fresh"), F.col("turn"))).alias("top_turn"),
        F.round(F.try_divide(F.max("fresh"), F.sum("fresh")), 6).alias("top_share"),
    )


def check_outcomes(spark, d):
    """Per session: checks that passed and failed, code files edited, and runs, by what the calls say."""
    c = calls(spark, d).withColumn("k", T.call_class(F.initcap("tool"), F.trim("target")))
    kind = lambda k: F.col("k.kind") == k
    return c.where("k is not null").groupBy("session_id").agg(
        F.count_if(kind("CHECK") & F.col("ok")).alias("passed"), F.count_if(kind("CHECK") & ~F.col("ok")).alias("failed"),
        F.count_distinct(F.when(kind("EDIT"), F.col("k.ref"))).alias("edited"), F.count_if(kind("RUN")).alias("runs"),
    )


QUERIES = {f.__name__: f for f in (
    session_states, attention_pending, attention_shown, agent_status, status_counts, wait_states, waits_summary, assembled_agents,
    message_edges, agent_verification, verification, failed_calls, api_errors, waste_summary, pressure_summary, near_limit,
    turn_usage, prompt_summary, check_outcomes,
)}

ORACLES = _SQL | {
    "failed_calls": _C + """, p AS (SELECT session_id, tool, coalesce(path, '') AS t, count(*) AS calls, count(*) FILTER (NOT ok) AS failed FROM c WHERE ok IS NOT NULL GROUP BY 1, 2, 3)
        SELECT session_id, tool, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(failed) AS BIGINT) AS failed, arg_min(t, (-failed, t)) AS most_common
        FROM p GROUP BY 1, 2 HAVING sum(failed) > 0""",
}
