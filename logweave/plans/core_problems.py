"""Queries p3, p4, p6 and p7 on the session tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.deliveries import deduplicate_deliveries, surplus_deliveries
from logweave.operators.hierarchy import descendant_pairs, hierarchy, with_paths
from logweave.operators.intervals import FOREVER, gaps_between, merge_intervals
from logweave.operators.schema_drift import consistent_table, schema_changes
from logweave.runtime import cut, strip, table

#: Shard width for rounds: one hour, in microseconds.
ROUND_SHARD = 3_600_000_000


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "api_calls").select(
        "delivery_id", "received_at", "session_id", "operation", "message_id"
    )
    return surplus_deliveries(calls, ["session_id", "operation"], "message_id").select("delivery_id")


def p3_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals over messages counted once, per model."""
    once = deduplicate_deliveries(
        table(spark, sf_dir, "api_calls"), ["session_id", "operation"], "message_id"
    )
    return once.groupBy("model").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def agent_key(column):
    """Ids without letter case, outer blanks and a leading ``agent-``; null if nothing is left."""
    key = F.regexp_replace(F.lower(strip(column)), "^agent-", "")
    return F.when(F.length(key) > 0, key)


def agent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(agent_id, spawn_depth, id, parent)`` one row per agent; the parent by its own
    word, or else by its launch's. Only agents that need their launch go through the join."""
    agents = (
        table(spark, sf_dir, "agents")
        .select("session_id", "tool_use_id", "agent_id", "parent_agent_id", "spawn_depth")
        .withColumn("id", agent_key(F.col("agent_id")))
        .withColumn("parent", agent_key(F.col("parent_agent_id")))
    )
    agents = agents.where("id is not null").groupBy("id").agg(
        F.min(F.struct("agent_id", "parent", "session_id", "tool_use_id", "spawn_depth")).alias("a")
    ).select("id", "a.*")
    launcher = agent_key(F.col("launcher_agent_id"))
    launches = (
        table(spark, sf_dir, "launches")
        .select("session_id", "tool_use_id", launcher.alias("launcher"))
        .where("launcher is not null and session_id is not null and tool_use_id is not null")
        .groupBy("session_id", "tool_use_id")
        .agg(F.min("launcher").alias("launcher"))
    )
    asks = "parent is null and session_id is not null and tool_use_id is not null"
    asked = agents.where(asks).join(launches, ["session_id", "tool_use_id"], "left")
    asked = asked.withColumn("parent", F.col("launcher"))
    columns = ["id", "agent_id", "spawn_depth", "parent"]
    return asked.select(*columns).unionByName(agents.where(f"not ({asks})").select(*columns))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cut(agent_links(spark, sf_dir))
    tree = hierarchy(links, "id", "parent").select("id", "kind", "depth")
    wrong = F.col("spawn_depth").isNotNull() & (F.col("spawn_depth") != F.col("depth"))
    issue = F.when(F.col("kind") != "root", F.col("kind")).when(wrong, "depth")
    found = links.select("id", "agent_id", "spawn_depth").join(tree, "id").withColumn("issue", issue)
    return found.where("issue is not null").select("agent_id", "issue")


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every agent; null on cycles."""
    tree = with_paths(hierarchy(agent_links(spark, sf_dir), "id", "parent"))
    return tree.select("id", "kind", "top", "depth", "descendants", "path")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every agent, one row each, and how many links below it they are."""
    return descendant_pairs(hierarchy(agent_links(spark, sf_dir), "id", "parent"))


def p4_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every agent not on or below a cycle its place in the tour of its tree: ranks from the end of the tour, so of one
    ``top`` the descendants are the agents whose ``enter`` is smaller and ``leave`` greater."""
    tree = hierarchy(agent_links(spark, sf_dir), "id", "parent").where("kind <> 'cycle'")
    named = tree.select(F.col("v").alias("top_v"), F.col("id").alias("top"))
    return tree.join(named, "top_v").select("id", "kind", "top", "depth", "enter", "leave")


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rounds: copies of a row are equal in every column, so a digest stands for the rest."""
    rounds = table(spark, sf_dir, "rounds")
    digest = F.xxhash64(*[F.col(c).cast("string") for c in rounds.columns])
    return (
        rounds.select("agent_id", "started_at", "ended_at", digest.alias("digest"))
        .where("started_at is not null")
        .distinct()
        .select("agent_id", F.unix_micros("started_at").alias("s"), F.unix_micros("ended_at").alias("e"))
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = cut(merge_intervals(_rounds(spark, sf_dir), "agent_id", "s", "e", ROUND_SHARD))
    merged = periods.where((F.col("n") > 1) & (F.col("e") < FOREVER)).select(
        F.col("entity"), F.lit("merged").alias("kind"), "s", "e"
    )
    gaps = gaps_between(periods, ROUND_SHARD).select("entity", F.lit("gap").alias("kind"), "s", "e")
    millis = lambda c: F.floor(F.col(c) / 1000).cast("long")
    return merged.unionByName(gaps).select(
        F.col("entity").alias("agent_id"), "kind",
        millis("s").alias("start_ms"), millis("e").alias("end_ms"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "raw_entries"))


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_table(table(spark, sf_dir, "raw_entries"))


QUERIES = {
    "p3_found": p3_found,
    "p3_messages": p3_messages,
    "p4_found": p4_found,
    "p4_hierarchy": p4_hierarchy,
    "p4_descendants": p4_descendants,
    "p4_tours": p4_tours,
    "p6_found": p6_found,
    "p6_table": p6_table,
    "p7_found": p7_found,
}

_P3_RANKED = r"""
  SELECT *, row_number() OVER (PARTITION BY session_id, operation, mid
                               ORDER BY received_at NULLS LAST, delivery_id) AS rn
  FROM (SELECT *, regexp_replace(message_id, '^\s+|\s+$', '', 'g') AS mid FROM api_calls) WHERE mid <> ''
"""
_AGENT_TREE = r"""
  WITH RECURSIVE a AS (
    SELECT DISTINCT session_id, tool_use_id, agent_id, spawn_depth,
      regexp_replace(lower(regexp_replace(agent_id, '^\s+|\s+$', '', 'g')), '^agent-', '') AS id,
      nullif(regexp_replace(lower(regexp_replace(parent_agent_id, '^\s+|\s+$', '', 'g')), '^agent-', ''), '') AS p
    FROM agents),
  l AS (SELECT DISTINCT session_id, tool_use_id,
      nullif(regexp_replace(lower(regexp_replace(launcher_agent_id, '^\s+|\s+$', '', 'g')), '^agent-', ''), '') AS p
    FROM launches),
  n AS (SELECT a.id, a.agent_id, a.spawn_depth, coalesce(a.p, l.p) AS parent
        FROM a LEFT JOIN l ON a.session_id = l.session_id AND a.tool_use_id = l.tool_use_id AND l.p IS NOT NULL),
  up(id, cur, seen, kind) AS (
    SELECT id, id, [id], CASE WHEN parent IS NULL THEN 'root' END FROM n
    UNION ALL
    SELECT up.id, n.parent, list_append(up.seen, n.parent),
      CASE WHEN m.id IS NULL THEN 'orphan' WHEN list_contains(up.seen, n.parent) THEN 'cycle'
           WHEN m.parent IS NULL THEN 'root' END
    FROM up JOIN n ON n.id = up.cur LEFT JOIN n m ON m.id = n.parent
    WHERE up.kind IS NULL)
"""  # noqa: E501
ORACLES = {
    "p3_found": f"SELECT delivery_id FROM ({_P3_RANKED}) WHERE rn > 1",
    "p3_messages": f"""
      SELECT model, count(*) AS messages, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
             CAST(sum(output_tokens) AS BIGINT) AS output_tokens
      FROM api_calls WHERE delivery_id NOT IN (SELECT delivery_id FROM ({_P3_RANKED}) WHERE rn > 1)
      GROUP BY model""",
    "p4_found": _AGENT_TREE + """
      SELECT n.agent_id, CASE WHEN up.kind <> 'root' THEN up.kind ELSE 'depth' END AS issue
      FROM n JOIN up ON up.id = n.id AND up.kind IS NOT NULL
      WHERE up.kind <> 'root' OR (n.spawn_depth IS NOT NULL AND n.spawn_depth <> len(up.seen))""",
    "p4_hierarchy": _AGENT_TREE + """,
      ends AS (SELECT id, kind, CASE WHEN kind = 'orphan' THEN list_reverse(seen)[2:] ELSE list_reverse(seen) END AS line
               FROM up WHERE kind IS NOT NULL),
      below AS (SELECT unnest(line) AS id, count(*) - 1 AS c FROM ends WHERE kind <> 'cycle' GROUP BY 1)
      SELECT e.id, e.kind, CASE WHEN kind <> 'cycle' THEN line[1] END AS top,
        CASE WHEN kind <> 'cycle' THEN CAST(len(line) AS BIGINT) END AS depth,
        CASE WHEN kind <> 'cycle' THEN CAST(b.c AS BIGINT) END AS descendants,
        CASE WHEN kind <> 'cycle' THEN array_to_string(line, '/') END AS path
      FROM ends e LEFT JOIN below b ON b.id = e.id""",
    "p7_found": """
      WITH r AS (SELECT DISTINCT * FROM rounds WHERE started_at IS NOT NULL AND (ended_at IS NULL OR ended_at >= started_at)),
      t AS (SELECT agent_id, epoch_ms(started_at) AS s, coalesce(epoch_ms(ended_at), 9000000000000000) AS e FROM r),
      m AS (SELECT *, max(e) OVER (PARTITION BY agent_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM t),
      g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
      p AS (SELECT agent_id, k, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY agent_id, k),
      q AS (SELECT *, lead(s) OVER (PARTITION BY agent_id ORDER BY s) AS nx FROM p)
      SELECT agent_id, 'merged' AS kind, s AS start_ms, e AS end_ms FROM p WHERE n > 1 AND e < 9000000000000000
      UNION ALL SELECT agent_id, 'gap', e, nx FROM q WHERE nx IS NOT NULL""",  # noqa: E501
}
