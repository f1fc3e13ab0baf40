"""Queries over tool calls: mixes, files, repeats, retries, classes, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.functions import text as T
from logweave.functions.paths import canonical_text
from logweave.operators import lineage, search, sequences
from logweave.operators.asof import forward_asof
from logweave.runtime import table

SEQ = ["transcript_id"]


def calls(spark, d):
    """Tool calls without copies, with a clean name."""
    raw = table(spark, d, "tool_calls").dropDuplicates(["transcript_id", "seq"])
    return raw.withColumn("tool", F.lower(F.trim("name")))


def tool_mix(spark, d):
    by = calls(spark, d).groupBy("tool").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("transcript_id").alias("transcripts"),
        F.count_if(~F.col("ok")).alias("failed"),
    )
    total = by.agg(F.sum("n").alias("every"))
    return by.crossJoin(F.broadcast(total)).select(  # one row
        "tool", "n", "transcripts", "failed", F.round(F.col("n") / F.col("every"), 6).alias("share")
    )


def tool_buckets(spark, d):
    bucket = T.tool_bucket(F.col("name"))
    return calls(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def busiest_agent(spark, d):
    n = calls(spark, d).groupBy("session_id", "transcript_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(-F.col("n"), F.col("transcript_id"))
    return n.groupBy("session_id").agg(F.min_by("transcript_id", first).alias("transcript_id"), F.max("n").alias("n"))


def call_outcomes(spark, d):
    return calls(spark, d).groupBy("transcript_id").agg(
        F.count_if("ok").alias("worked"), F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("ok").isNull()).alias("open"),
        F.max_by(F.col("ok").isNull(), F.col("seq")).alias("ended_mid_tool"),
    )


def _touches(spark, d):
    return calls(spark, d).where(F.col("tool").isin("read", "write", "edit")).withColumn("path", canonical_text(F.col("target")))




def _writes():
    return F.col("tool").isin("write", "edit")


def _reads():
    return F.col("tool") == "read"


def files_touched(spark, d):
    t = _touches(spark, d).where("path is not null")
    return t.groupBy("transcript_id", "path").agg(
        F.min(F.when(_writes(), F.col("seq"))).alias("first_write"), F.min(F.when(_reads(), F.col("seq"))).alias("first_read")
    )


def contended_files(spark, d):
    t = _touches(spark, d).where("path is not null")
    return t.groupBy("session_id", "path").agg(
        F.count_distinct(F.when(_writes(), F.col("transcript_id"))).alias("writers"),
        F.count_distinct(F.when(_reads(), F.col("transcript_id"))).alias("readers"),
    ).where("writers > 1 or readers > 1")


def artifact_edges(spark, d):
    return lineage.artifact_edges(_touches(spark, d), ["session_id"], "transcript_id", "path", "at_s", _writes(), _reads())


def hub_files(spark, d):
    return lineage.hub_files(_touches(spark, d), ["session_id"], "transcript_id", "path", _writes(), _reads())


def write_conflicts(spark, d):
    return lineage.write_conflicts(_touches(spark, d), ["session_id"], "transcript_id", "path", _writes())


def messages_sent(spark, d):
    """Messages from each transcript to each recipient it names, known or not."""
    sent = calls(spark, d).where("tool = 'sendmessage'").select(
        "session_id", F.col("transcript_id").alias("src"), canonical_text(F.col("target")).alias("dst")
    )
    return sent.where("dst is not null").groupBy("session_id", "src", "dst").agg(F.count(F.lit(1)).alias("messages"))


def identity_hashes(spark, d):
    same = T.call_identity(F.col("target")) == F.col("same_hash")
    return calls(spark, d).where("target is not null").groupBy("tool").agg(
        F.count_if(same).alias("equal"), F.count_if(~same).alias("other"), F.count_if(F.col("same_hash").isNull()).alias("unknown")
    )


def trailing_repeat(spark, d):
    value = F.concat_ws("\n", F.col("tool"), canonical_text(F.col("target")))
    return sequences.trailing_repeat(calls(spark, d), SEQ, "seq", value).where("repeats >= 2")


def two_cycle(spark, d):
    value = F.concat_ws("\n", F.col("tool"), canonical_text(F.col("target")))
    return sequences.two_cycle(calls(spark, d), SEQ, "seq", value, length=4)


def _chains(spark, d):
    keyed = calls(spark, d).withColumn("what", canonical_text(F.col("target"))).where("what is not null")
    return keyed, sequences.retry_chains(keyed, SEQ, "seq", ["tool", "what"], "ok")


def retry_chains(spark, d):
    return _chains(spark, d)[1].drop("first_rn", "last_rn")


def stuck_calls(spark, d):
    keyed, chains = _chains(spark, d)
    totals = keyed.where("ok is not null").groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"))
    return sequences.stuck(chains, totals, SEQ, failures=2, recent=40).select("transcript_id", "tool", "what", "attempts")


def failure_stalls(spark, d):
    done = calls(spark, d).where("ok is not null and at_s is not null")
    out = sequences.stall_islands(done, SEQ, "seq", "tool", "at_s", F.col("ok"))
    return out.select("transcript_id", "tool", F.round("first_at", 3).alias("first_at"), "repeats", F.round("resumed_at", 3).alias("resumed_at"))


def errors_by_tool(spark, d):
    c = calls(spark, d).where("ok is not null")
    per = c.where("not ok").groupBy("tool", F.coalesce("target", F.lit("")).alias("t")).agg(F.count(F.lit(1)).alias("k"))
    most = per.groupBy("tool").agg(F.min_by("t", F.struct(-F.col("k"), F.col("t"))).alias("most_common"), F.sum("k").alias("failed"))
    return c.groupBy("tool").agg(F.count(F.lit(1)).alias("n")).join(most, "tool")


def rereads(spark, d):
    """Reads of a target in an unchanged spelling right after another one of it."""
    reads = calls(spark, d).where("tool = 'read' and target is not null").withColumn("path", canonical_text(F.col("target")))
    back = sequences.step_back(reads, ["transcript_id", "path"], ["seq"], ["same_hash"])
    return back.where("same_hash = prev_same_hash").groupBy("transcript_id", "path").agg(F.count(F.lit(1)).alias("rereads"))


def call_classes(spark, d):
    kind = T.call_class(F.initcap("tool"), F.trim("target"))
    return calls(spark, d).groupBy(kind["kind"].alias("class")).agg(F.count(F.lit(1)).alias("n"))


def search_all_terms(spark, d):
    hits = calls(spark, d).where(search.matches(F.concat_ws("\n", "name", "target"), "PY read"))
    return hits.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def search_failed_only(spark, d):
    return search.search_calls(calls(spark, d), ["name", "target"], "", ["transcript_id", "tool"], "seq", "ok", 300, failed_only=True)


def spelling_clusters(spark, d):
    """How many spellings each path goes by."""
    t = _touches(spark, d).where("path is not null")
    return t.groupBy("path").agg(F.count_distinct("target").alias("spellings"), F.count(F.lit(1)).alias("n"))


def alert_edges(spark, d):
    """Changes between working and failing in a transcript."""
    done = calls(spark, d).where("ok is not null")
    return sequences.transitions(done, SEQ, ["seq"], "ok").select("transcript_id", "seq", "ok", "was")


def next_check_after_edit(spark, d):
    c = calls(spark, d).where("at_s is not null")
    edits = c.where(_writes()).select("transcript_id", "seq", "at_s")
    checks = c.where("lower(role) in ('check', 'run')").select("transcript_id", F.col("at_s").alias("checked_at"))
    return forward_asof(edits, checks, SEQ, "at_s", "checked_at", width=3600).select(
        "transcript_id", "seq", F.round("next_at", 3).alias("next_at")
    )


QUERIES = {f.__name__: f for f in (
    tool_mix, tool_buckets, busiest_agent, call_outcomes, files_touched, contended_files, artifact_edges, hub_files,
    write_conflicts, messages_sent, identity_hashes, trailing_repeat, two_cycle, retry_chains, stuck_calls,
    failure_stalls, errors_by_tool, rereads, call_classes, search_all_terms, search_failed_only,
    spelling_clusters, alert_edges, next_check_after_edit,
)}

_PATH = (
    r"array_to_string([CASE WHEN contains(w, '/') THEN array_to_string("
    r"list_reduce(list_prepend(CASE WHEN starts_with(w, '/') THEN [''] ELSE CAST([] AS VARCHAR[]) END, "
    r"[[x] FOR x IN string_split(w, '/')]), "
    r"lambda a, b: CASE WHEN b[1] = '' OR b[1] = '.' THEN a "
    r"WHEN b[1] = '..' AND len(a) > 0 AND a[-1] NOT IN ('..', '') THEN a[1:len(a) - 1] ELSE list_concat(a, b) END), '/') "
    r"ELSE w END FOR w IN string_split(replace(trim(regexp_replace(lower(target), '\s+', ' ', 'g')), '\', '/'), ' ')], ' ')"
)
_C = f"WITH c AS (SELECT DISTINCT *, lower(trim(name)) AS tool, nullif({_PATH}, '') AS path FROM tool_calls)"
_V = "concat_ws(chr(10), tool, path)"
_CHAIN = _C + """,
  k AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY seq) AS rn FROM c WHERE ok IS NOT NULL AND path IS NOT NULL),
  f AS (SELECT *, lag(rn) OVER w AS prn, lag(ok) OVER w AS pok FROM k WINDOW w AS (PARTITION BY transcript_id, tool, path ORDER BY rn)),
  g AS (SELECT *, sum(CASE WHEN prn IS NULL OR rn - prn > 4 OR pok THEN 1 ELSE 0 END)
          OVER (PARTITION BY transcript_id, tool, path ORDER BY rn ROWS UNBOUNDED PRECEDING) AS ch FROM f),
  ch AS (SELECT transcript_id, tool, path AS what, min(seq) AS first_order, max(seq) AS last_order, count(*) AS attempts,
          arg_max(ok, rn) AS worked, max(rn) AS last_rn FROM g GROUP BY transcript_id, tool, path, ch HAVING count(*) > 1)
"""
ORACLES = {
    "tool_mix": _C + """SELECT tool, count(*) AS n, count(DISTINCT transcript_id) AS transcripts, count(*) FILTER (NOT ok) AS failed,
        round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY tool""",
    "tool_buckets": _C + """SELECT CASE WHEN name IN ('Read','Grep','Glob','NotebookRead','WebFetch','WebSearch') THEN 'Read'
        WHEN name IN ('Edit','Write','NotebookEdit') THEN 'Edit' WHEN name IN ('Bash','PowerShell') THEN 'Bash'
        WHEN name IN ('Task','Agent') THEN 'Task' ELSE 'Other' END AS bucket, count(*) AS n FROM c GROUP BY 1""",
    "busiest_agent": _C + """, n AS (SELECT session_id, transcript_id, count(*) AS n FROM c GROUP BY 1, 2)
        SELECT session_id, transcript_id, n FROM n QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, transcript_id) = 1""",
    "call_outcomes": _C + """SELECT transcript_id, count(*) FILTER (ok) AS worked, count(*) FILTER (NOT ok) AS failed,
        count(*) FILTER (ok IS NULL) AS open, arg_max(ok IS NULL, seq) AS ended_mid_tool FROM c GROUP BY 1""",
    "files_touched": _C + """SELECT transcript_id, path, min(seq) FILTER (tool IN ('write','edit')) AS first_write,
        min(seq) FILTER (tool = 'read') AS first_read FROM c WHERE tool IN ('read','write','edit') AND path IS NOT NULL GROUP BY 1, 2""",
    "contended_files": _C + """SELECT session_id, path, count(DISTINCT transcript_id) FILTER (tool IN ('write','edit')) AS writers,
        count(DISTINCT transcript_id) FILTER (tool = 'read') AS readers FROM c WHERE tool IN ('read','write','edit') AND path IS NOT NULL
        GROUP BY 1, 2 HAVING writers > 1 OR readers > 1""",
    "artifact_edges": _C + """, t AS (SELECT * FROM c WHERE path IS NOT NULL AND at_s IS NOT NULL)
        SELECT w.session_id, w.transcript_id AS src, r.transcript_id AS dst, count(DISTINCT w.path) AS paths, min(w.path) AS first_path
        FROM t w JOIN t r ON w.session_id = r.session_id AND w.path = r.path AND w.transcript_id <> r.transcript_id AND r.at_s >= w.at_s
        WHERE w.tool IN ('write','edit') AND r.tool = 'read' GROUP BY 1, 2, 3""",
    "hub_files": _C + """SELECT session_id, path, count(*) FILTER (tool = 'read') AS reads,
        count(DISTINCT transcript_id) FILTER (tool = 'read') AS readers FROM c WHERE tool IN ('read','write','edit') AND path IS NOT NULL
        GROUP BY 1, 2 HAVING count(*) FILTER (tool <> 'read') = 0 AND reads > 3""",
    "write_conflicts": _C + """SELECT session_id, path, count(DISTINCT transcript_id) AS writers, count(*) AS write_count FROM c
        WHERE tool IN ('write','edit') AND path IS NOT NULL GROUP BY 1, 2 HAVING writers > 1""",
    "messages_sent": _C + """SELECT session_id, transcript_id AS src, path AS dst, count(*) AS messages FROM c
        WHERE tool = 'sendmessage' AND path IS NOT NULL GROUP BY 1, 2, 3""",
    "identity_hashes": _C + """SELECT tool, count(*) FILTER (substr(sha1(target), 1, 16) = same_hash) AS equal,
        count(*) FILTER (substr(sha1(target), 1, 16) <> same_hash) AS other, count(*) FILTER (same_hash IS NULL) AS unknown
        FROM c WHERE target IS NOT NULL GROUP BY 1""",
    "trailing_repeat": _C + f""", v AS (SELECT transcript_id, seq, {_V} AS value FROM c),
        l AS (SELECT transcript_id, arg_max(value, seq) AS lastv FROM v GROUP BY 1),
        b AS (SELECT transcript_id, max(seq) FILTER (value <> lastv) AS brk, any_value(lastv) AS value FROM v JOIN l USING (transcript_id) GROUP BY 1)
        SELECT transcript_id, b.value, count(*) AS repeats FROM b JOIN v USING (transcript_id) WHERE brk IS NULL OR seq > brk
        GROUP BY 1, 2 HAVING count(*) >= 2""",
    "two_cycle": _C + f""", v AS (SELECT transcript_id, seq, {_V} AS value FROM c
          QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY seq DESC) <= 4),
        s AS (SELECT *, coalesce(value = lag(value) OVER (PARTITION BY transcript_id ORDER BY seq), false) AS same FROM v)
        SELECT transcript_id, min(value) AS a, max(value) AS b FROM s GROUP BY 1
        HAVING count(*) = 4 AND count(DISTINCT value) = 2 AND NOT bool_or(same)""",
    "retry_chains": _CHAIN + "SELECT transcript_id, tool, what, first_order, last_order, attempts, worked FROM ch",
    "stuck_calls": _CHAIN + """, z AS (SELECT transcript_id, max(rn) AS n FROM k GROUP BY 1),
        m AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY last_rn DESC) = 1)
        SELECT transcript_id, tool, what, attempts FROM m JOIN z USING (transcript_id)
        WHERE NOT worked AND attempts >= 2 AND n - last_rn < 40""",
    "failure_stalls": _C + """, e AS (SELECT *, sum(ok::INT) OVER (PARTITION BY transcript_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ep,
          min(CASE WHEN ok THEN at_s END) OVER (PARTITION BY transcript_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS res
          FROM c WHERE ok IS NOT NULL AND at_s IS NOT NULL),
        f AS (SELECT *, CASE WHEN lag(tool) OVER (PARTITION BY transcript_id, ep ORDER BY seq) IS DISTINCT FROM tool THEN 1 ELSE 0 END AS nw FROM e WHERE NOT ok),
        g AS (SELECT *, sum(nw) OVER (PARTITION BY transcript_id, ep ORDER BY seq ROWS UNBOUNDED PRECEDING) AS isle FROM f)
        SELECT transcript_id, tool, round(min(at_s), 3) AS first_at, count(*) AS repeats, round(min(res), 3) AS resumed_at
        FROM g GROUP BY transcript_id, ep, isle, tool""",
    "errors_by_tool": _C + """, p AS (SELECT tool, coalesce(target, '') AS t, count(*) AS k FROM c WHERE NOT ok GROUP BY 1, 2),
        m AS (SELECT tool, sum(k)::BIGINT AS failed FROM p GROUP BY 1),
        q AS (SELECT tool, t AS most_common FROM p QUALIFY row_number() OVER (PARTITION BY tool ORDER BY k DESC, t) = 1)
        SELECT tool, count(*) AS n, any_value(most_common) AS most_common, any_value(failed) AS failed
        FROM c JOIN m USING (tool) JOIN q USING (tool) WHERE ok IS NOT NULL GROUP BY 1""",
    "rereads": _C + """, r AS (SELECT *, lag(same_hash) OVER (PARTITION BY transcript_id, path ORDER BY seq) AS ph FROM c
          WHERE tool = 'read' AND target IS NOT NULL)
        SELECT transcript_id, path, count(*) AS rereads FROM r WHERE same_hash = ph GROUP BY 1, 2""",
    "search_all_terms": _C + """SELECT tool, count(*) AS n FROM c WHERE contains(lower(concat_ws(chr(10), name, target)), 'py')
        AND contains(lower(concat_ws(chr(10), name, target)), 'read') GROUP BY 1""",
    "search_failed_only": _C + """SELECT transcript_id, tool, count(*) AS calls, count(*) AS failed, max(seq) AS latest FROM c WHERE NOT ok
        GROUP BY 1, 2 ORDER BY latest DESC, transcript_id, tool LIMIT 300""",
    "spelling_clusters": _C + """SELECT path, count(DISTINCT target) AS spellings, count(*) AS n FROM c
        WHERE tool IN ('read','write','edit') AND path IS NOT NULL GROUP BY 1""",
    "alert_edges": _C + """, w AS (SELECT transcript_id, seq, ok, lag(ok) OVER (PARTITION BY transcript_id ORDER BY seq) AS was FROM c WHERE ok IS NOT NULL)
        SELECT * FROM w WHERE was IS NULL OR was <> ok""",
    "next_check_after_edit": _C + """SELECT e.transcript_id, e.seq, round(min(k.at_s), 3) AS next_at FROM c e
        LEFT JOIN c k ON k.transcript_id = e.transcript_id AND k.at_s > e.at_s AND lower(k.role) IN ('check', 'run')
        WHERE e.tool IN ('write','edit') AND e.at_s IS NOT NULL GROUP BY 1, 2""",
}
