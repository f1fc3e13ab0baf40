"""What state agents and sessions are in: waits, calls for attention, stops, liveness, status, assembly.

Times are whole microseconds; ``now`` is always an input. Every operator is a
projection, one aggregation or one ordered pass, keyed by session and agent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.config import DEFAULTS, EngineConfig
from logweave.operators.asof import forward_asof

# What is shown first when several things are pending, and what stops an agent until it is answered.
PRIORITY = {"permission": 4, "error": 3, "input": 2, "idle": 1}
BLOCKING = ("permission", "input")


def session_live(sessions: DataFrame, written: str, ended: str, now: str, config: EngineConfig = DEFAULTS) -> DataFrame:
    """``sessions`` with ``live``: written to within the last ten minutes, unless an end was reported and nothing came after it.

    A session that never wrote is not live.
    """
    over = F.col(ended).isNotNull() & (F.col(written) <= F.col(ended) + config.micros("grace_s"))
    recent = F.col(now) - F.col(written) <= config.micros("session_live_s")
    return sessions.withColumn("live", F.coalesce(recent & ~over, F.lit(False)))


def last_words(events: DataFrame, scope: list[str], kind: str, at: str) -> DataFrame:
    """``scope, ended_at, reason``: the end a session's events leave it with; a later start takes an end back."""
    ends = events.where(F.col(kind).isin("session_start", "session_end")).groupBy(*scope).agg(
        F.max_by(F.struct(F.col(kind).alias("k"), F.col(at).alias("t"), F.col("detail")["reason"].alias("reason")), F.struct(at, kind)).alias("e")
    )
    return ends.where("e.k = 'session_end'").select(*scope, F.col("e.t").alias("ended_at"), F.col("e.reason").alias("reason"))


def agent_stops(events: DataFrame, activity: DataFrame, scope: list[str], kind: str, at: str, config: EngineConfig = DEFAULTS) -> DataFrame:
    """``scope, agent_id, stopped_at`` of agents whose latest word is a stop without activity ``(scope, agent_id, seen)`` after it."""
    last = events.where(F.col(kind).isin("agent_start", "agent_stop") & (F.col("agent_id") != "")).groupBy(*scope, "agent_id").agg(
        F.max_by(F.struct(F.col(kind).alias("k"), F.col(at).alias("stopped_at")), F.struct(at, kind)).alias("e")
    )
    stops = last.where("e.k = 'agent_stop'").select(*scope, "agent_id", "e.stopped_at").join(activity, [*scope, "agent_id"], "left")
    quiet = F.col("seen").isNull() | (F.col("seen") <= F.col("stopped_at") + config.micros("grace_s"))
    return stops.where(quiet).select(*scope, "agent_id", "stopped_at")


def close_by_stop(finals: DataFrame, stops: DataFrame, scope: list[str]) -> DataFrame:
    """Final rounds ``(scope, agent_id, s, e, status, mid_tool)``; an open one ends at the agent's stop at or after its start.

    It failed if the agent stopped inside a call, else it is completed.
    """
    met = finals.join(stops, [*scope, "agent_id"], "left")
    closes = F.coalesce(F.col("e").isNull() & F.col("stopped_at").isNotNull() & (F.col("s").isNull() | (F.col("stopped_at") >= F.col("s"))), F.lit(False))
    by_stop = F.when(F.coalesce("mid_tool", F.lit(False)), "failed").otherwise("completed")
    return met.withColumns({
        "status": F.when(closes, by_stop).otherwise(F.col("status")), "e": F.when(closes, F.col("stopped_at")).otherwise(F.col("e")),
    }).drop("stopped_at")


def status_of(s: Column, e: Column, status: Column, mid_tool: Column, seen: Column, live: Column, waiting: Column, now: Column,
              known: Column, config: EngineConfig = DEFAULTS) -> Column:
    """An agent's status by its final round, the first rule that holds.

    No round (``known`` false): unknown. Ended: the round's own status. Session not
    live: failed inside a call, else orphaned. Waiting for an answer. Silent longer
    than the threshold: stalled. Else running.
    """
    silent = now - F.coalesce(seen, s) > config.micros("stall_s")
    false = F.lit(False)
    return (
        F.when(~F.coalesce(known, false), "unknown").when(e.isNotNull(), status)
        .when(~F.coalesce(live, false), F.when(F.coalesce(mid_tool, false), "failed").otherwise("orphaned"))
        .when(F.coalesce(waiting, false), "waiting").when(F.coalesce(silent, false), "stalled").otherwise("running")
    )


def pending_attention(attention: DataFrame, scope: list[str], agents: DataFrame, sessions: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Calls ``(scope, attention_id, kind, agent_id, since)`` that nothing has answered, the newest of each kind and agent.

    A call is answered by activity more than a second later: of its agent
    (``agents``: scope, agent_id, seen), or of anyone in the session if it names
    none (``sessions``: scope, seen). An agent never seen has not answered.
    """
    owner = F.nullif(F.trim("agent_id"), F.lit(""))
    asked = attention.where(F.col("kind").isin(*PRIORITY) & F.col("since").isNotNull()).withColumn("agent_id", owner)
    mine = asked.where("agent_id is not null").join(agents, [*scope, "agent_id"], "left")
    ours = asked.where("agent_id is null").join(sessions, scope, "left")
    open_ = mine.unionByName(ours).where(F.col("seen").isNull() | (F.col("seen") <= F.col("since") + config.micros("grace_s")))
    newest = F.max_by(F.struct("attention_id", "since"), F.struct("since", "attention_id"))
    return open_.groupBy(*scope, "agent_id", "kind").agg(newest.alias("a")).select(*scope, "agent_id", "kind", "a.*")


def most_urgent(pending: DataFrame, scope: list[str]) -> DataFrame:
    """The call each session shows: the highest priority, then the newest."""
    ranks = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    row = F.struct("attention_id", "kind", "agent_id", "since")
    best = F.max_by(row, F.struct(F.element_at(ranks, F.col("kind")), F.col("since"), F.col("attention_id")))
    return pending.groupBy(*scope).agg(best.alias("a")).select(*scope, "a.*")


def wait_states(
    attention: DataFrame, scope: list[str], by_agent: DataFrame, by_session: DataFrame, live: DataFrame, now: str, config: EngineConfig = DEFAULTS
) -> DataFrame:
    """``scope, agent_id, kind, since, answered_at, state, prompts, waited``: stretches in which an agent sat on a prompt.

    A wait goes from a blocking prompt to the first activity more than a second
    later (``by_agent``: scope, agent_id, seen; ``by_session``: scope, seen, for
    prompts without an agent). A prompt raised before that answer belongs to the
    same wait. Without an answer a wait is open while the session is live
    (``live``: scope, live, now), else unanswered, of unknown length (0). Three
    answers within one second of each other are the one case in which a prompt
    may count for the later of two waits.
    """
    owner = F.coalesce(F.trim("agent_id"), F.lit(""))
    asked = attention.where(F.col("kind").isin(*BLOCKING) & F.col("since").isNotNull())
    asked = asked.select(*scope, owner.alias("agent_id"), "attention_id", "kind", "since")
    grace = config.micros("grace_s")
    mine = forward_asof(asked.where("agent_id <> ''"), by_agent, [*scope, "agent_id"], "since", "seen", grace)
    ours = forward_asof(asked.where("agent_id = ''"), by_session, scope, "since", "seen", grace)
    never = 1 << 62
    ends = mine.unionByName(ours.select(*mine.columns)).withColumn("until", F.coalesce("next_at", F.lit(never)))
    answers = ends.groupBy(*scope, "agent_id", "until").agg(F.min("since").alias("__m"))
    before = F.lag("until").over(W.partitionBy(*scope, "agent_id").orderBy("until"))  # one row an answer
    known = ends.join(answers.select(*scope, "agent_id", "until", before.alias("__b")), [*scope, "agent_id", "until"])
    held = F.when(F.col("since") <= F.col("__b"), F.col("__b")).otherwise(F.col("until"))
    waits = known.withColumn("until", held).groupBy(*scope, "agent_id", "until").agg(
        F.min_by("kind", F.struct("since", "attention_id")).alias("kind"), F.min("since").alias("since"), F.count(F.lit(1)).alias("prompts")
    )
    waits = waits.join(live.select(*scope, "live", now), scope, "left")
    state = F.when(F.col("until") < never, "answered").when(F.col("live"), "open").otherwise("unanswered")
    waits = waits.withColumn("state", state)
    waited = F.when(F.col("state") == "answered", F.col("until") - F.col("since")).when(
        F.col("state") == "open", F.greatest(F.lit(0), F.col(now) - F.col("since"))).otherwise(0)
    return waits.select(*scope, "agent_id", "kind", "since", F.when(F.col("until") < never, F.col("until")).alias("answered_at"), "state", "prompts",
                        waited.alias("waited"))


def assemble_agents(metas: DataFrame, launches: DataFrame, results: DataFrame, notes: DataFrame) -> DataFrame:
    """Agents beside their launch, found by the agent's own word, else by a result, else by a notification.

    ``metas``: (session_id, agent_id, tool_use_id, description, model, launch_mode);
    ``launches``: (session_id, tool_use_id, description, model, launcher_agent_id, prompt, launched_at);
    ``results``: (session_id, agent_id, tool_use_id, launch_mode, seq), of which only those that
    answer a launch count; ``notes``: (session_id, agent_id, tool_use_id, seq). The
    launcher is the parent unless it is the agent itself.
    """
    keys = ["session_id", "agent_id"]
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    known = launches.select("session_id", "tool_use_id").distinct()
    answered = results.where("agent_id is not null").join(known, ["session_id", "tool_use_id"], "left_semi")
    by_result = answered.groupBy(*keys).agg(F.min_by("tool_use_id", "seq").alias("by_result"), F.min_by("launch_mode", "seq").alias("result_mode"))
    by_note = notes.where(F.col("agent_id").isNotNull() & blank("tool_use_id").isNotNull()).groupBy(*keys).agg(F.min_by("tool_use_id", "seq").alias("by_note"))
    universe = metas.select(*keys).unionByName(answered.select(*keys)).where("agent_id is not null").distinct()
    a = universe.join(metas.withColumnRenamed("tool_use_id", "own").withColumnRenamed("description", "own_description").withColumnRenamed("model", "own_model"), keys, "left")
    a = a.join(by_result, keys, "left").join(by_note, keys, "left")
    a = a.withColumn("tool_use_id", F.coalesce(blank("own"), "by_result", "by_note"))
    made = launches.withColumnRenamed("model", "asked_model").withColumnRenamed("description", "asked_description")
    a = a.join(made, ["session_id", "tool_use_id"], "left")
    return a.select(
        *keys, "tool_use_id", F.coalesce(blank("own_description"), "asked_description", F.lit("")).alias("description"),
        F.coalesce(blank("own_model"), blank("asked_model"), F.lit("")).alias("model"),
        F.when(F.col("launch_mode") == "background", "background").otherwise(F.coalesce("result_mode", "launch_mode", F.lit("inline"))).alias("launch_mode"),
        F.when(F.col("launcher_agent_id") != F.col("agent_id"), F.col("launcher_agent_id")).alias("parent_agent_id"),
        F.coalesce("prompt", F.lit("")).alias("brief"), "launched_at",
    )
