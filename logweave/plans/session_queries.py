"""Queries over agents, launches, rounds, attention, entries and texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.functions.lines import is_object, parse_line
from logweave.operators import asof, graph, intervals, latest, lineage, search, sequences, sweep
from logweave.plans.core_problems import ROUND_SHARD, agent_key
from logweave.plans.session_sql import ORACLES  # noqa: F401
from logweave.runtime import cut, strip, table


def rounds(spark, d):
    r = table(spark, d, "rounds").distinct()
    return r.withColumns({"s": F.unix_micros("started_at"), "e": F.unix_micros("ended_at")})


def agents(spark, d):
    return table(spark, d, "agents").dropDuplicates(["agent_id"])


def launches(spark, d):
    return table(spark, d, "launches").dropDuplicates(["session_id", "tool_use_id"])


def run_totals(spark, d):
    span = rounds(spark, d).groupBy("session_id").agg(F.min("s").alias("started"), F.max("e").alias("ended"), F.count(F.lit(1)).alias("rounds"))
    state = agents(spark, d).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("agents"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return state.join(span, "session_id", "left").withColumn("wall", F.col("ended") - F.col("started"))


def batches(spark, d):
    return launches(spark, d).where("turn_uuid is not null").groupBy("session_id", "turn_uuid").agg(
        F.count(F.lit(1)).alias("n"), F.min("tool_use_id").alias("first_id"), F.min(F.unix_micros("launched_at")).alias("launched")
    )


def agent_universe(spark, d):
    """Ids seen in any table, and in how many."""
    known = launches(spark, d).select("session_id", "tool_use_id").distinct()
    by_launch = agents(spark, d).join(known, ["session_id", "tool_use_id"], "left_semi").select(F.col("agent_id").alias("id"), F.lit("launch").alias("src"))
    by_round = table(spark, d, "rounds").select(F.col("agent_id").alias("id"), F.lit("rounds").alias("src")).distinct()
    by_call = table(spark, d, "tool_calls").select(F.col("transcript_id").alias("id"), F.lit("calls").alias("src")).distinct()
    return by_launch.unionByName(by_round).unionByName(by_call).where("id is not null").groupBy("id").agg(
        F.array_join(F.sort_array(F.collect_set("src")), ",").alias("seen_in")  # at most three values
    )


def parent_edges(spark, d):
    a = agents(spark, d).select("session_id", agent_key(F.col("agent_id")).alias("dst"), agent_key(F.col("parent_agent_id")).alias("p"))
    src = F.when(F.col("p").isNull() | (F.col("p") == F.col("dst")), "main").otherwise(F.col("p"))
    return a.select("session_id", src.alias("src"), "dst")


def hidden_fans(spark, d):
    """Edges from the main session to agents that another agent also launched."""
    exact = parent_edges(spark, d).unionByName(
        agents(spark, d).select("session_id", F.lit("main").alias("src"), agent_key(F.col("agent_id")).alias("dst"))
    ).distinct()
    return lineage.without_fans(exact, ["session_id"]).where("hidden").select("session_id", "src", "dst")


def _forward_edges(spark, d):
    """Parent edges that go forward in time, so that chains end."""
    spans = rounds(spark, d).where("s is not null and e >= s").groupBy("session_id", agent_key(F.col("agent_id")).alias("node")).agg(
        F.min("s").alias("start"), F.max("e").alias("end")
    )
    return spans, parent_edges(spark, d).where("src <> 'main'")


def rank_columns(spark, d):
    spans, edges = _forward_edges(spark, d)
    return graph.rank_columns(spans, edges, ["session_id"])


def _exact_edges(spark, d):
    """Launches and files written then read, between agents."""
    from logweave.plans.call_queries import artifact_edges

    files = artifact_edges(spark, d).select("session_id", agent_key(F.col("src")).alias("src"), agent_key(F.col("dst")).alias("dst"))
    return parent_edges(spark, d).where("src <> 'main'").unionByName(files).distinct()


def _critical_chains(spark, d):
    spans = cut(_forward_edges(spark, d)[0])
    state = graph.critical_path(spans, _exact_edges(spark, d), ["session_id"])
    best = state.groupBy("session_id").agg(F.max_by(F.struct("score", "steps", "chain"), F.struct("score", "end", "node")).alias("b"))
    wall = spans.groupBy("session_id").agg((F.max("end") - F.min("start")).alias("wall"))
    return best.select("session_id", "b.*").join(wall, "session_id")


def critical_path(spark, d):
    """Per session the time of the chain of agents that took longest, and its share of the session."""
    return _critical_chains(spark, d).select("session_id", "score", F.round(F.try_divide("score", "wall"), 6).alias("share"))


def critical_agents(spark, d):
    """The last agents of those chains in order, at most twelve a session, and how long the chains are."""
    return _critical_chains(spark, d).select("session_id", F.col("steps").cast("long").alias("steps"), F.posexplode("chain").alias("place", "agent_id"))


def longest_chain(spark, d):
    """Per session the greatest sum of durations along its launches."""
    spans, edges = _forward_edges(spark, d)
    state = graph.critical_path(spans, edges, ["session_id"], whole=True)
    return state.groupBy("session_id").agg(F.max("score").alias("score"))


def handoff_containment(spark, d):
    """Briefs that reuse at least half of the word shingles of a result of their session, by classes of equal texts."""
    a = agents(spark, d)
    out = lineage.containment(a, a, ["session_id"], "agent_id", "agent_id", "result", "brief", 8, 0.5)
    return out.groupBy("session_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max("score"), 6).alias("best"))


def handoff_pairs(spark, d):
    """Results reused by briefs of their session, by classes of equal texts: 0.15 of the word shingles, or 40 words in a row."""
    a = agents(spark, d)
    return lineage.containment(a, a, ["session_id"], "agent_id", "agent_id", "result", "brief", 8, 0.15, 40)


def handoff_members(spark, d):
    """Agents with the classes of their texts, their start, and their end once all their rounds have ended."""
    span = rounds(spark, d).groupBy("session_id", "agent_id").agg(
        F.min("s").alias("started"), F.when(F.count_if(F.col("e").isNull()) == 0, F.max("e")).alias("ended")
    )
    classes = [F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(n) for c, n in (("result", "src_class"), ("brief", "dst_class"))]
    return agents(spark, d).select("session_id", "agent_id", *classes).join(span, ["session_id", "agent_id"], "left")


def handoff_edges(spark, d):
    """Reuse edges: the brief of an agent that starts at or after the end of another reuses its result."""
    m = cut(handoff_members(spark, d))
    src = m.where("ended is not null").select("session_id", "src_class", F.col("agent_id").alias("src"), "ended")
    dst = m.where("started is not null").select("session_id", "dst_class", F.col("agent_id").alias("dst"), "started")
    met = handoff_pairs(spark, d).join(src, ["session_id", "src_class"]).join(dst, ["session_id", "dst_class"])
    return met.where("src <> dst and started >= ended").select("session_id", "src", "dst", F.round("score", 3).alias("score"))


def concurrency_sweep(spark, d):
    r = rounds(spark, d).where("e is not null")
    return sweep.concurrency(r, ["session_id"], "s", "e")


def round_union(spark, d):
    r = rounds(spark, d).where("s is not null and e >= s").select("session_id", "s", "e")
    return intervals.union_length(r, "session_id", "s", "e", ROUND_SHARD)


def time_split(spark, d):
    r = rounds(spark, d).where("e is not null").withColumn("good", F.coalesce(F.col("status") == "completed", F.lit(False)))
    return sweep.time_split(r, ["session_id"], "s", "e", "good")


def replay_as_of(spark, d):
    """State of all rounds at the median start."""
    r = rounds(spark, d).where("s is not null")
    at = 1772323200000000
    return sweep.state_at(r, "s", "e", F.lit(at)).groupBy("session_id", "state").agg(F.count(F.lit(1)).alias("n"))


def slowest_agents(spark, d):
    r = rounds(spark, d).where("s is not null and e > s")
    per = r.groupBy("session_id", "agent_id").agg(F.sum(F.col("e") - F.col("s")).alias("busy"))
    order = W.partitionBy("session_id").orderBy(F.col("busy").desc(), "agent_id")
    return per.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 5")


def resumed_rounds(spark, d):
    """Rounds that start after the end of the agent's round before, by number: idle time between."""
    r = rounds(spark, d).where("s is not null")
    back = sequences.step_back(r, ["agent_id"], ["round_no", "s", "e"], ["e"])
    return back.where("prev_e is not null").groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("resumed"), F.sum(F.greatest(F.col("s") - F.col("prev_e"), F.lit(0))).alias("idle")
    )


def step_lookup(spark, d):
    """Concurrency of the session at each call for attention (0 before its first round)."""
    swept = sweep.levels(rounds(spark, d).where("s is not null and e >= s"), ["session_id"], "s", "e").select("session_id", "t", "level")
    asked = table(spark, d, "attention").dropDuplicates(["attention_id"]).select("session_id", "attention_id", F.unix_micros("since").alias("at"))
    out = asof.window_join(asked.where("at is not null"), swept, ["session_id"], "at", "t", "level")
    return out.select("attention_id", F.coalesce("level", F.lit(0).cast("long")).alias("level"))


def attention_latest(spark, d):
    a = table(spark, d, "attention").dropDuplicates(["attention_id"])
    weight = F.when(F.col("kind") == "permission", 4).when(F.col("kind") == "error", 3).when(F.col("kind") == "input", 2).otherwise(1)
    return latest.latest_by(a.withColumn("w", weight), ["session_id"], ["w", "since", "attention_id"], ["attention_id", "kind"])


def first_activity_after(spark, d):
    """Answer to each call for attention: the session's first tool call more than a second later."""
    a = table(spark, d, "attention").dropDuplicates(["attention_id"]).select("session_id", "attention_id", F.unix_micros("since").alias("at"))
    c = table(spark, d, "tool_calls").where("at_s is not null").select("session_id", F.round(F.col("at_s") * 1e6).cast("long").alias("seen"))
    return asof.forward_asof(a.where("at is not null"), c, ["session_id"], "at", "seen", 1_000_000).select("attention_id", "next_at")


def wait_intervals(spark, d):
    """Waits of blocking kinds: repeats before the answer extend the same wait."""
    a = table(spark, d, "attention").dropDuplicates(["attention_id"]).where("kind in ('permission', 'input')")
    a = a.select("session_id", "kind", F.unix_micros("since").alias("at")).where("at is not null")
    c = table(spark, d, "tool_calls").where("at_s is not null").select("session_id", F.round(F.col("at_s") * 1e6).cast("long").alias("seen"))
    answered = asof.forward_asof(a, c, ["session_id"], "at", "seen", 1_000_000)
    return answered.groupBy("session_id", "kind", "next_at").agg(F.min("at").alias("since"), F.count(F.lit(1)).alias("prompts"))


def wait_overlap(spark, d):
    """For each wait of a session the round that it overlaps most."""
    w = wait_intervals(spark, d).where("next_at is not null").select(
        "session_id", F.concat_ws("/", "kind", "since").alias("wait"), F.col("since").alias("s"), F.col("next_at").alias("e"))
    r = rounds(spark, d).where("s is not null and e > s").select("session_id", F.concat_ws("#", "agent_id", "round_no", "s").alias("round"), "s", "e")
    return asof.best_overlap(w, r, ["session_id"], "wait", "round", "s", "e", 3_600_000_000)


def launches_in_turns(spark, d):
    """Launches per numbered attention window of their session."""
    w = table(spark, d, "attention").dropDuplicates(["attention_id"]).select("session_id", F.unix_micros("since").alias("opened"), F.col("attention_id").alias("number"))
    w = w.where("opened is not null").groupBy("session_id", "opened").agg(F.max("number").alias("number"))
    a = launches(spark, d).select("session_id", F.unix_micros("launched_at").alias("at")).where("at is not null")
    return asof.window_join(a, w, ["session_id"], "at", "opened", "number").groupBy("session_id", "number").agg(F.count(F.lit(1)).alias("launches"))


def parsed(spark, d):
    e = table(spark, d, "entries")
    return e.withColumn("j", parse_line(F.col("v"))).withColumn("object", is_object(F.col("j")))


def _get(path, kind="string"):
    return F.expr(f"try_variant_get(j, '{path}', '{kind}')")


def scanned_lines(spark, d):
    """Lines, bad lines and generations of each file."""
    return parsed(spark, d).groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("object")).alias("bad"), F.max("generation").alias("generation")
    )


def latest_generation(spark, d):
    """Lines of each transcript that the last reading of its file saw."""
    e = table(spark, d, "entries").select("transcript_id", "file", "generation", "seq")
    last = e.groupBy("file").agg(F.max("generation").alias("g"))
    return e.join(last, "file").where("generation = g").groupBy("transcript_id").agg(F.count_distinct("seq").alias("lines"))


def sessions_recent(spark, d):
    """Files and transcripts of each session, the newest first by name."""
    e = table(spark, d, "entries")
    project = F.regexp_extract("file", r"projects/([^/]+)/", 1)
    return e.groupBy("session_id", project.alias("project")).agg(F.count_distinct("file").alias("files"), F.count_distinct("transcript_id").alias("transcripts"))


def entry_times(spark, d):
    stamp = T.iso_seconds(_get("$.timestamp"))
    return parsed(spark, d).where("object").groupBy("session_id").agg(
        F.round(F.min(stamp), 3).alias("first_at"), F.round(F.max(stamp), 3).alias("last_at"), F.count_if(stamp.isNull()).alias("undated")
    )


def content_blocks(spark, d):
    """Blocks of message contents by kind; strings and other shapes are no blocks."""
    p = parsed(spark, d).where("object").withColumn("content", F.expr("try_variant_get(j, '$.message.content', 'array<variant>')"))
    p = p.where(F.schema_of_variant(F.expr("try_variant_get(j, '$.message.content', 'variant')")).startswith("ARRAY"))
    b = p.select(F.explode("content").alias("b"))
    return b.groupBy(F.coalesce(F.try_variant_get("b", "$.type", "string"), F.lit("?")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def user_prompts(spark, d):
    """Prompts typed by users: no sidechain, no tool results, not injected; white space collapsed."""
    body = _get("$.message.content")
    schema = F.schema_of_variant(F.expr("try_variant_get(j, '$.message.content', 'variant')"))
    flat = strip(F.regexp_replace(body, r"(?U)\s+", " "))
    p = parsed(spark, d).where("object").where((_get("$.type") == "user") & (schema == "STRING"))
    p = p.where(F.lower(F.coalesce(_get("$.isSidechain"), F.lit("false"))) != "true").select(_get("$.uuid").alias("uuid"), flat.alias("prompt"))
    p = p.where("prompt <> '' and not startswith(prompt, '<')").dropDuplicates(["uuid"])
    return p.select("uuid", T.scrub_and_cut(F.col("prompt"), 500).alias("prompt"))


def turn_split(spark, d):
    """Entries of each turn: a user message that is no tool result opens one."""
    p = parsed(spark, d).where("object").select("transcript_id", "seq", "generation", _get("$.type").alias("type"), _get("$.uuid").alias("uuid"),
        F.schema_of_variant(F.expr("try_variant_get(j, '$.message.content', 'variant')")).alias("shape"))
    p = p.groupBy("transcript_id", "uuid").agg(F.min_by(F.struct("type", "shape", "seq"), F.struct("generation", "seq")).alias("x")).select("transcript_id", "uuid", "x.*")
    opens = (F.col("type") == "user") & (F.coalesce(F.col("shape"), F.lit("")) == "STRING")
    turns = sequences.split_turns(p, ["transcript_id"], ["seq", "uuid"], F.coalesce(opens, F.lit(False)))
    return turns.groupBy("transcript_id", "turn").agg(F.count(F.lit(1)).alias("entries"))


def notifications(spark, d):
    """Task notifications inside texts: id, status and size of the result."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?is)(<task-notification>.*?</task-notification>)"), F.lit(1))
    b = table(spark, d, "documents").select("doc_id", F.explode(blocks).alias("b")).distinct()
    tag = lambda t: F.regexp_extract("b", rf"(?is)<{t}>\s*(.*?)\s*</{t}>", 1)
    return b.select("doc_id", F.lower(tag("task-id")).alias("task_id"), F.lower(tag("status")).alias("status"), F.length(tag("result")).alias("result_chars"))


def redacted_texts(spark, d):
    """Every document, brief and result without its secrets: the whole text is searched."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("row_key"), F.lit("text").alias("field"), "text")
    a = agents(spark, d)
    fields = [a.select(F.lit("agents").alias("src"), F.col("agent_id").alias("row_key"), F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("brief", "result")]
    every = docs.unionByName(fields[0]).unionByName(fields[1]).where("text is not null")
    clean = every.withColumn("clean", T.scrub(F.col("text")))
    return clean.select("src", "row_key", "field", "clean", (F.col("clean") != F.col("text")).alias("redacted"))


def report_gists(spark, d):
    return agents(spark, d).where("result is not null").select("agent_id", T.gist(F.col("result")).alias("gist"))


def first_lines(spark, d):
    return agents(spark, d).where("result is not null").select("agent_id", T.first_line(F.col("result"), 80).alias("line"))


def stated_objectives(spark, d):
    a = agents(spark, d).select("agent_id", T.stated_udf("objective")("brief", "description").alias("o"), T.stated_udf("output")("brief", "description").alias("w"))
    return a.select("agent_id", F.col("o.text").alias("objective"), F.col("o.source").alias("rule"), F.col("w.text").alias("output"), F.col("w.source").alias("output_rule"))


def search_agents(spark, d):
    hay = F.concat_ws("\n", "agent_type", "description", "brief", "result")
    return agents(spark, d).where(search.matches(hay, "price table")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def agent_flags(spark, d):
    """What stands out about each agent, in a fixed order."""
    def rule(cond, name):
        return F.when(cond, F.lit(name))

    flags = F.array_compact(F.array(
        rule(F.col("status") == "failed", "failed"), rule(strip(F.col("result")) == "", "blank result"),
        rule(F.col("result").isNull(), "no result"), rule(F.col("brief").isNull(), "no brief"), rule(F.col("spawn_depth") > 10, "deep"),
    ))
    return agents(spark, d).select("agent_id", F.array_join(flags, ",").alias("flags")).where("flags <> ''")


def agents_filtered(spark, d):
    """Agents with one of some statuses and a word in one of their fields, in table order."""
    a = agents(spark, d).where(F.col("status").isin("failed", "running") & F.contains(F.lower(F.concat_ws("\n", "agent_type", "description", "agent_id", "model")), F.lit("test")))
    return a.select("agent_id", "status", "description").orderBy("status", "description", "agent_id")


def fleet_ranking(spark, d):
    """Sessions by urgency of their newest open call for attention, then size."""
    latest_kind = attention_latest(spark, d).select("session_id", "kind")
    n = agents(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("agents"), F.count_if(F.col("status") == "failed").alias("failed"))
    urgency = F.when(F.col("kind") == "permission", 4).when(F.col("kind") == "error", 3).when(F.col("kind") == "input", 2).otherwise(0)
    return n.join(latest_kind, "session_id", "left").withColumn("urgency", urgency).orderBy(F.col("urgency").desc(), F.col("agents").desc(), "session_id")


def outcome_dedup(spark, d):
    """First document of each distinct text."""
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha1("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def big_results(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("chars"))
    return docs.orderBy(F.col("chars").desc(), "doc_id").limit(12).withColumn("tokens", F.floor(F.col("chars") / 4).cast("long"))


def coverage_missing(spark, d):
    """Sources a project has no document of."""
    docs = table(spark, d, "documents").select("project", F.lower(strip(F.col("source"))).alias("source")).where("project is not null and source <> ''").distinct()
    required = table(spark, d, "mix_targets").select(F.lower(strip(F.col("source"))).alias("source")).where("source <> ''").distinct()
    wanted = required.agg(F.collect_set("source").alias("wanted"))  # one row, the list of what is required
    have = docs.groupBy("project").agg(F.collect_set("source").alias("have"))  # no more than there are kinds of source
    lacking = F.array_except("wanted", "have")
    return have.crossJoin(wanted).select("project", F.explode(lacking).alias("source"))


def export_rows(spark, d):
    """Stable columns for a spreadsheet: ISO seconds, blanks for nulls, formula cells made text."""
    safe = lambda c: F.when(F.col(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.coalesce(c, F.lit("")))
    stamp = F.coalesce(F.date_format("last_activity_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return agents(spark, d).select("agent_id", safe("agent_type").alias("agent_type"), safe("description").alias("description"),
                                   F.coalesce(F.col("spawn_depth").cast("string"), F.lit("")).alias("depth"), stamp.alias("last_activity"))


def markers(spark, d):
    """Starts and ends of rounds as one series, the newest 40 of each session."""
    r = rounds(spark, d)
    m = r.where("s is not null").select("session_id", "agent_id", F.lit("start").alias("what"), F.col("s").alias("at")).unionByName(
        r.where("e is not null").select("session_id", "agent_id", F.when(F.col("status") == "failed", "fail").otherwise("done").alias("what"), F.col("e").alias("at"))
    )
    order = W.partitionBy("session_id").orderBy(F.col("at").desc(), "agent_id", "what")
    return m.distinct().withColumn("n", F.row_number().over(order).cast("long")).where("n <= 40")


QUERIES = {f.__name__: f for f in (
    run_totals, batches, agent_universe, parent_edges, hidden_fans, rank_columns, critical_path, critical_agents, longest_chain,
    handoff_containment, handoff_edges, concurrency_sweep, round_union, time_split, replay_as_of, slowest_agents, resumed_rounds, step_lookup,
    attention_latest, first_activity_after, wait_intervals, wait_overlap, launches_in_turns, scanned_lines, latest_generation,
    sessions_recent, entry_times, content_blocks, user_prompts, turn_split, notifications, redacted_texts, report_gists,
    first_lines, stated_objectives, search_agents, agent_flags, agents_filtered, fleet_ranking, outcome_dedup, big_results,
    coverage_missing, export_rows, markers,
)}
