"""From transcript lines to tables: entries, blocks, calls, usage, launches, results, rounds, changes, commits.

Every step is a projection or one aggregation over the one before; ``seq`` is the
order of the lines in their transcript, which most rules follow, not the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.lines import is_object, parse_line
from logweave.functions.text import command_line, iso_seconds, scrub, scrub_and_cut

# The field of a call's input that says what it is about.
TARGET_FIELDS = {
    "Read": "file_path", "Write": "file_path", "Edit": "file_path", "MultiEdit": "file_path", "NotebookEdit": "notebook_path",
    "Bash": "command", "PowerShell": "command", "Grep": "pattern", "Glob": "pattern", "WebFetch": "url", "WebSearch": "query",
    "Task": "description", "Agent": "description", "SendMessage": "to", "Skill": "skill",
}
EDITS = ("Edit", "Write", "MultiEdit", "NotebookEdit")


def get(path: str, kind: str = "string", column: str = "v") -> Column:
    return F.try_variant_get(F.col(column), path, kind)


def _count(path: str) -> Column:
    """A whole number of at least 0 at ``path``; booleans, fractions and other types are 0."""
    whole = F.schema_of_variant(get(path, "variant")) == "BIGINT"
    return F.when(whole, F.greatest(get(path, "long"), F.lit(0))).otherwise(F.lit(0).cast("long"))


def entry_table(lines: DataFrame, line: str = "v") -> DataFrame:
    """One row per JSON object line with its common fields; ``v`` is the whole entry.

    ``lines`` has ``transcript_id, seq`` and the text ``line``; of lines read again
    (the same transcript, uuid and text) one stays, the first.
    """
    parsed = lines.withColumn("__h", F.xxhash64(line)).withColumn("v", parse_line(F.col(line))).where(is_object(F.col("v")))
    once = parsed.groupBy("transcript_id", "__h", get("$.uuid").alias("uuid")).agg(
        F.min_by(F.struct("seq", F.col(line).alias("line")), "seq").alias("e")
    )
    out = once.select("transcript_id", "uuid", "e.seq", "e.line").withColumn("v", parse_line(F.col("line")))
    return out.select(
        "transcript_id", "seq", "uuid", get("$.type").alias("type"), iso_seconds(get("$.timestamp")).alias("at"),
        F.coalesce(F.lower(get("$.isSidechain")) == "true", F.lit(False)).alias("sidechain"), get("$.agentId").alias("agent_id"),
        get("$.message.id").alias("message_id"), get("$.message.model").alias("model"), "v", "line",
    )


def blocks(entries: DataFrame) -> DataFrame:
    """Blocks of message contents that are arrays of objects: ``..., pos, kind, b``.

    ``input_text`` is the input of a call as written, where it lacks the field TARGET_FIELDS names for its tool.
    """
    content = get("$.message.content", "variant")
    arrays = entries.where(F.schema_of_variant(content).startswith("ARRAY"))
    parts = arrays.select("transcript_id", "seq", "at", "uuid", "sidechain", "agent_id", "line",
                          F.posexplode(get("$.message.content", "array<variant>")).alias("pos", "b"))
    parts = parts.where(F.schema_of_variant("b").startswith("OBJECT")).withColumn("kind", get("$.type", column="b"))
    path = F.concat(F.lit("$.message.content["), F.col("pos"), F.lit("].input"))
    unknown = (F.col("kind") == "tool_use") & _named_target("b").isNull()
    raw = F.when(unknown, F.call_function("get_json_object", F.col("line"), path))
    return parts.withColumn("input_text", raw).drop("line")


def _named_target(block: str) -> Column:
    """What TARGET_FIELDS says a call is about; null if its input has no such text."""
    name = get("$.name", column=block)
    said = [F.when(name == tool, F.nullif(get(f"$.input.{field}", column=block), F.lit(""))) for tool, field in TARGET_FIELDS.items()]
    return F.coalesce(*said)


def _first_text(value: str, text: str) -> Column:
    """The first non-empty string among an object's fields, in the order they are written in."""
    fields = F.try_variant_get(F.col(value), "$", "map<string,variant>")
    texts = F.transform(F.json_object_keys(text), lambda k: F.try_element_at(fields, k))
    texts = F.transform(texts, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    return F.get(F.filter(texts, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def block_text(value: Column) -> Column:
    """Text of a content: a string as it is, of an array the texts of its text blocks, a line each."""
    kind = F.schema_of_variant(value)
    parts = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$.type", "string") == "text")
    joined = F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))), "\n")
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("ARRAY"), joined)


def calls(parts: DataFrame, cut: int | None = None) -> DataFrame:
    """Tool calls beside the first result that follows them in their transcript.

    ``ok`` is null while there is no result. Targets are redacted, and cut if ``cut`` is given.
    """
    uses = parts.where("kind = 'tool_use'").withColumn("input", get("$.input", "variant", "b"))
    name = get("$.name", column="b")
    target = F.coalesce(_named_target("b"), _first_text("input", "input_text"))
    uses = uses.select(
        "transcript_id", "seq", "pos", "at", "sidechain", "agent_id", get("$.id", column="b").alias("tool_use_id"), name.alias("name"),
        (scrub_and_cut(target, cut) if cut else scrub(target)).alias("target"), "input",
    )
    results = parts.where("kind = 'tool_result'").select(
        "transcript_id", get("$.tool_use_id", column="b").alias("tool_use_id"), F.col("seq").alias("result_seq"), F.col("at").alias("result_at"),
        (~F.coalesce(get("$.is_error", "boolean", "b"), F.lit(False))).alias("ok"), block_text(get("$.content", "variant", "b")).alias("result"),
    )
    keys = ["transcript_id", "tool_use_id"]
    paired = uses.where("tool_use_id is not null").select(*keys, "seq", "pos").join(results, keys).where("result_seq >= seq")
    first = paired.groupBy(*keys, "seq", "pos").agg(F.min_by(F.struct("result_seq", "result_at", "ok", "result"), "result_seq").alias("r"))
    return uses.join(first, [*keys, "seq", "pos"], "left").select(
        *uses.columns, F.col("r.result_seq").alias("result_seq"), F.col("r.result_at").alias("result_at"),
        F.col("r.ok").alias("ok"), F.col("r.result").alias("result"),
    )


def usage_totals(entries: DataFrame) -> DataFrame:
    """Usage per message: one written once per block counts once, the latest usage wins; without an id each line counts."""
    used = entries.where(F.schema_of_variant(get("$.message.usage", "variant")).startswith("OBJECT"))
    key = F.coalesce(F.nullif(F.trim("message_id"), F.lit("")), F.concat(F.lit("line "), F.col("seq")))
    values = used.select("transcript_id", key.alias("message"), "seq", "at", "model", *[
        _count(f"$.message.usage.{path}").alias(name) for name, path in
        (("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cache_read_input_tokens"), ("cache_create", "cache_creation_input_tokens"))])
    real = F.when(~F.coalesce(F.col("model"), F.lit("")).isin("", "<synthetic>"), F.col("seq"))
    return values.groupBy("transcript_id", "message").agg(
        F.min_by("at", "seq").alias("at"), F.max_by("model", real).alias("model"),
        *[F.max_by(c, "seq").alias(c) for c in ("input", "output", "cache_read", "cache_create")],
    )


def launches(tool_calls: DataFrame) -> DataFrame:
    """Launches of agents; the last call of a tool use id counts. The launcher is the agent of a sidechain."""
    made = tool_calls.where(F.col("name").isin("Agent", "Task") & F.col("tool_use_id").isNotNull())
    one = made.groupBy("tool_use_id").agg(F.max_by(F.struct(
        "transcript_id", get("$.description", column="input").alias("description"), get("$.prompt", column="input").alias("prompt"),
        get("$.model", column="input").alias("model"), F.col("at").alias("launched_at"),
        F.when(F.col("sidechain"), F.col("agent_id")).alias("launcher_agent_id"), "result", "result_at", "ok",
    ), "seq").alias("l"))
    return one.select("tool_use_id", "l.*")


def launch_results(made: DataFrame) -> DataFrame:
    """What a launch came back with: the agent's id, and whether it runs in the background or answered inline."""
    later = F.contains("result", F.lit("Async agent launched"))
    agent = F.nullif(F.regexp_extract("result", r"agentId:\s*([0-9a-f]{8,})", 1), F.lit(""))
    return made.where("result is not null").select(
        "tool_use_id", agent.alias("agent_id"), F.when(later, "background").otherwise("inline").alias("launch_mode"),
        F.when(~later, F.col("result")).alias("inline_result"), (~F.col("ok")).alias("is_error"), F.col("result_at").alias("at"),
    )


def notifications(entries: DataFrame) -> DataFrame:
    """Task notifications in messages, queue entries and attachments; exact repeats count once."""
    carriers = F.array_compact(F.array(
        F.when(F.schema_of_variant(get("$.message.content", "variant")) == "STRING", get("$.message.content")),
        F.when(get("$.operation") == "enqueue", get("$.content")),
        F.when(get("$.attachment.commandMode") == "task-notification", get("$.attachment.prompt")),
    ))
    found = entries.select("transcript_id", "seq", "at", F.explode(carriers).alias("t")).select(
        "transcript_id", "seq", "at", F.explode(F.regexp_extract_all("t", F.lit(r"(?s)(<task-notification>.*?</task-notification>)"), F.lit(1))).alias("n")
    )
    tag = lambda t: F.nullif(F.regexp_extract("n", rf"(?s)<{t}>\s*(.*?)\s*</{t}>", 1), F.lit(""))
    return found.groupBy("transcript_id", "n").agg(F.min("at").alias("at"), F.min("seq").alias("seq")).select(
        "transcript_id", "seq", "at", tag("task-id").alias("agent_id"), tag("tool-use-id").alias("tool_use_id"), tag("status").alias("status"), tag("result").alias("result")
    )


def build_rounds(made: DataFrame, results: DataFrame, notes: DataFrame, activity: DataFrame) -> DataFrame:
    """Rounds of each agent: ``agent_id, started_at, ended_at, status``.

    ``made``: (agent_id, launched_at); ``results``: (agent_id, launch_mode, is_error, at);
    ``notes``: (agent_id, status, at); ``activity``: (agent_id, last_activity_at). A
    notification ends a round that began at the launch or the one before; activity
    after the last opens a new one; else an inline result ends the only round; else it is open.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("agent_id").orderBy(F.col("at").asc_nulls_last())
    noted = notes.where("agent_id is not null").join(made, "agent_id", "left").select(
        "agent_id", F.when(F.row_number().over(order) == 1, F.col("launched_at")).otherwise(F.lag("at").over(order)).alias("started_at"),
        F.col("at").alias("ended_at"), F.when(F.lower(F.trim("status")) == "completed", "completed").otherwise("failed").alias("status"),
    )
    last = notes.where("agent_id is not null").groupBy("agent_id").agg(F.max("at").alias("end"))
    resumed = last.join(activity, "agent_id").where("last_activity_at > end").select(
        "agent_id", F.col("end").alias("started_at"), F.lit(None).cast("double").alias("ended_at"), F.lit("running").alias("status")
    )
    others = made.select("agent_id").unionByName(activity.select("agent_id")).distinct().join(last, "agent_id", "left_anti")
    single = others.join(made, "agent_id", "left").join(results, "agent_id", "left").join(activity, "agent_id", "left")
    inline = (F.col("launch_mode") == "inline") & F.col("at").isNotNull()
    done = F.coalesce(inline, F.lit(False))
    single = single.where(F.coalesce("launched_at", "last_activity_at").isNotNull() | done).select(
        "agent_id", F.col("launched_at").alias("started_at"), F.when(done, F.col("at")).alias("ended_at"),
        F.when(done, F.when(F.col("is_error"), "failed").otherwise("completed")).otherwise("running").alias("status"),
    )
    return noted.unionByName(resumed).unionByName(single)


def file_changes(entries: DataFrame) -> DataFrame:
    """Lines added and removed per transcript and file by recorded patches, in the order files were first touched."""
    result = get("$.toolUseResult", "variant")
    edits = entries.where(F.schema_of_variant(result).startswith("OBJECT")).select(
        "transcript_id", "seq", get("$.toolUseResult.filePath").alias("path"),
        F.coalesce(get("$.toolUseResult.type") == "create", F.lit(False)).alias("created"),
        get("$.toolUseResult.content").alias("content"), get("$.toolUseResult.structuredPatch", "array<variant>").alias("patch"),
    ).where("path is not null and path <> ''")
    lines = F.flatten(F.transform(F.coalesce("patch", F.array().cast("array<variant>")),
                                  lambda h: F.coalesce(F.try_variant_get(h, "$.lines", "array<string>"), F.array().cast("array<string>"))))
    count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign)))
    whole = F.when(F.col("content") == "", 0).otherwise(F.size(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")))
    fresh = F.col("created") & (F.size(lines) == 0) & F.col("content").isNotNull()
    per = edits.select("transcript_id", "seq", "path", "created", F.when(fresh, whole).otherwise(count("+")).alias("added"), count("-").alias("removed"))
    return per.groupBy("transcript_id", "path").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("edits"), F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.max("created").alias("created")
    )


def commit_message(command: Column) -> Column:
    """First line of the message a ``git commit`` gave by ``-m`` or a here-document; null without a commit."""
    tail = F.regexp_extract(command, r"(?s)(git\s+(?:-C\s+\S+\s+)?commit\b.*)", 1)
    said = F.coalesce(
        F.nullif(F.regexp_extract(tail, r'-m\s+"(?!\s*\$\(cat)((?:[^"\\]|\\.)*)"', 1), F.lit("")),
        F.nullif(F.regexp_extract(tail, r"-m\s+'([^']*)'", 1), F.lit("")),
        F.nullif(F.regexp_extract(tail, r"(?s)<<-?\s*['\"]?(\w+)['\"]?[^\n]*\n(.*?)\n\s*\1(?=\s|$)", 2), F.lit("")),
    )
    first = F.get(F.filter(F.transform(F.split(F.replace(said, F.lit("\\n"), F.lit("\n")), "\n"), F.trim), lambda x: x != ""), F.lit(0))
    return F.when(tail != "", F.substring(first, 1, 120))


# Fixed value: a commit on a command line, without those that only try.
COMMITS = r"(?<![\w.\-])git\s+(?:-C\s+\S+\s+)?commit\b(?![^;&|\n]*--dry-run)"


def git_operations(entries: DataFrame, tool_calls: DataFrame) -> DataFrame:
    """``transcript_id, seq, at, tool_use_id, command, op`` of shell calls that worked; ``op`` is what was recorded of git, or null.

    A record belongs to its entry's only tool result.
    """
    single = F.size(F.filter(F.coalesce(get("$.message.content", "array<variant>"), F.array().cast("array<variant>")),
                             lambda b: F.try_variant_get(b, "$.type", "string") == "tool_result")) == 1
    recorded = entries.where(single & get("$.toolUseResult.gitOperation", "variant").isNotNull()).select(
        "transcript_id", F.col("seq").alias("result_seq"), get("$.toolUseResult.gitOperation", "variant").alias("op")
    )
    shell = tool_calls.where(F.col("name").isin("Bash", "PowerShell") & F.col("ok")).select(
        "transcript_id", "result_seq", F.col("result_at").alias("at"), "tool_use_id", get("$.command", column="input").alias("command")
    )
    return shell.join(recorded, ["transcript_id", "result_seq"], "left").withColumnRenamed("result_seq", "seq")


def commits(operations: DataFrame) -> DataFrame:
    """``key, sha, branch, kind, at, message, transcript_id, transcripts``: each commit once.

    A commit without a recorded sha goes by its tool call. Of transcripts that
    replay the same history the first to record a commit counts.
    """
    sha = get("$.commit.sha", column="op")
    quiet = sha.isNull() & command_line(F.col("command")).rlike(COMMITS)
    made = operations.where(sha.isNotNull() | quiet).select(
        F.coalesce(sha, F.concat(F.lit("tool:"), "tool_use_id")).alias("key"), sha.alias("sha"),
        F.coalesce(get("$.commit.branch", column="op"), get("$.push.branch", column="op"), F.lit("")).alias("branch"),
        F.when(quiet, "committed").otherwise(F.coalesce(get("$.commit.kind", column="op"), F.lit(""))).alias("kind"),
        "at", commit_message(F.col("command")).alias("message"), "transcript_id", "seq",
    )
    first = F.struct(F.coalesce("at", F.lit(1e18)), "transcript_id", "seq")
    return made.groupBy("key").agg(
        F.min_by(F.struct("sha", "branch", "kind", "at", "message", "transcript_id"), first).alias("c"),
        F.count_distinct("transcript_id").alias("transcripts"),
    ).select("key", "c.*", "transcripts")


def pull_requests(entries: DataFrame, operations: DataFrame) -> DataFrame:
    """``url, number, repo, action, at, transcript_id``: each safe address once, by its first mention; ``created`` stays."""
    linked = entries.where("type = 'pr-link'").select(
        get("$.prUrl").alias("url"), get("$.prNumber", "long").alias("number"), get("$.prRepository").alias("repo"), F.lit("linked").alias("action"),
        "at", "transcript_id", "seq",
    )
    made = operations.where(get("$.pr", "variant", "op").isNotNull()).select(
        get("$.pr.url", column="op").alias("url"), get("$.pr.number", "long", "op").alias("number"), F.lit(None).cast("string").alias("repo"),
        F.coalesce(get("$.pr.action", column="op"), F.lit("")).alias("action"), "at", "transcript_id", "seq",
    )
    every = linked.unionByName(made).where(F.col("url").rlike(r"^https://[^\s\"'<>]+$"))
    of_url = F.regexp_extract("url", r"^https://github\.com/([^/]+/[^/]+)/", 1)
    first = F.struct(F.coalesce("at", F.lit(1e18)), "transcript_id", "seq")
    return every.groupBy("url").agg(
        F.min_by(F.struct("number", F.coalesce("repo", of_url).alias("repo"), "action", "at", "transcript_id"), first).alias("p"),
        F.bool_or(F.col("action") == "created").alias("created"),
    ).select("url", "p.number", "p.repo", F.when(F.col("created"), "created").otherwise(F.col("p.action")).alias("action"), "p.at", "p.transcript_id")


def outcome_counts(operations: DataFrame) -> DataFrame:
    """``transcript_id, pushes, merges`` of recorded operations."""
    has = lambda p: F.coalesce(get(p, "variant", "op").isNotNull().cast("int"), F.lit(0))
    return operations.groupBy("transcript_id").agg(F.sum(has("$.push")).alias("pushes"), F.sum(has("$.branch")).alias("merges"))


def context_files(entries: DataFrame) -> DataFrame:
    """First load of each instruction file of a transcript: type and size."""
    listed = entries.select("transcript_id", "seq", F.explode(get("$.attachment.files", "array<variant>")).alias("f"))
    nested = entries.where(get("$.attachment.type") == "nested_memory").select(
        "transcript_id", "seq", get("$.attachment.path").alias("path"), F.lit("nested").alias("type"), F.length(get("$.attachment.content")).alias("chars")
    )
    files = listed.where(F.schema_of_variant("f").startswith("OBJECT")).select(
        "transcript_id", "seq", get("$.path", column="f").alias("path"), get("$.type", column="f").alias("type"), F.length(get("$.content", column="f")).alias("chars")
    ).unionByName(nested)
    return files.where("path is not null").groupBy("transcript_id", "path").agg(
        F.min_by(F.struct("type", "chars"), "seq").alias("x"), F.min("seq").alias("first_seq")
    ).select("transcript_id", "path", "x.*", "first_seq")


# Fixed value: what stands in the place of a result that was handed back by a message.
HANDED_BACK = r"delivered to you as a message from \S+ \(its SubagentHandback call\)"


def handbacks(rounds: DataFrame, messages: DataFrame, slack: float = 5.0) -> DataFrame:
    """Rounds whose result only points to a message, filled with the latest one handed back until ``slack`` after their end.

    ``messages`` is (agent_id, seq, at, message); ``seq`` orders them, and a null time
    on either side passes. Results that are no pointer stay as they are. Every
    round meets one row: messages are reduced to running latest ones by a window.
    """
    from pyspark.sql import Window as W

    pointer = (F.length("result") < 400) & F.col("result").rlike(HANDED_BACK)
    asked = rounds.where(pointer).select(
        "agent_id", "round_no", (F.col("ended_at") + slack).alias("until"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("message")
    )
    told = messages.where("agent_id is not null and message <> ''").select(
        "agent_id", F.lit(None).cast(rounds.schema["round_no"].dataType).alias("round_no"), F.coalesce("at", F.lit(float("-inf"))).alias("until"),
        "seq", "message",
    )
    both = asked.withColumn("until", F.coalesce("until", F.lit(float("inf")))).unionByName(told)
    order = W.partitionBy("agent_id").orderBy("until", F.col("seq").isNull()).rowsBetween(W.unboundedPreceding, 0)
    latest = both.withColumn("handed", F.max_by("message", "seq").over(order)).where("seq is null")
    best = latest.groupBy("agent_id", "round_no").agg(F.max("handed").alias("handed"))
    filled = F.when(pointer, F.coalesce("handed", "result")).otherwise(F.col("result"))
    return rounds.join(best, ["agent_id", "round_no"], "left").withColumn("result", filled).drop("handed")
