"""Queries that rebuild tables from the raw transcript lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.operators import transcripts
from logweave.runtime import table


def entries(spark, d):
    return transcripts.entry_table(table(spark, d, "entries").select("transcript_id", "seq", F.col("v").alias("line")), "line")


def rebuilt_calls(spark, d):
    """Tool calls out of the lines, with what came of them."""
    out = transcripts.calls(transcripts.blocks(entries(spark, d)))
    return out.select("transcript_id", "seq", "tool_use_id", "name", "target", "ok")


def rebuilt_usage(spark, d):
    return transcripts.usage_totals(entries(spark, d)).select("transcript_id", "message", F.round("at", 3).alias("at"), "model", "input", "output")


def rebuilt_text(spark, d):
    """Text blocks of each speaker."""
    b = transcripts.blocks(entries(spark, d)).where("kind = 'text'")
    return b.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length(transcripts.get("$.text", column="b"))).alias("chars"))


QUERIES = {f.__name__: f for f in (rebuilt_calls, rebuilt_usage, rebuilt_text)}

_E = """WITH p AS (SELECT transcript_id, min(seq) AS seq, v::JSON AS o FROM entries WHERE json_valid(v) GROUP BY transcript_id, v),
  e AS (SELECT * FROM p WHERE json_type(o) = 'OBJECT'),
  b AS (SELECT transcript_id, seq, unnest(CAST(o->'message'->'content' AS JSON[])) AS b FROM e WHERE json_type(o->'message'->'content') = 'ARRAY')
"""
ORACLES = {
    "rebuilt_calls": _E + """, u AS (SELECT transcript_id, seq, b->>'id' AS tool_use_id, b->>'name' AS name, b->'input' AS i FROM b WHERE b->>'type' = 'tool_use'),
        r AS (SELECT transcript_id, b->>'tool_use_id' AS tool_use_id, seq AS rs, NOT coalesce(CAST(b->>'is_error' AS BOOLEAN), false) AS ok FROM b WHERE b->>'type' = 'tool_result')
        SELECT u.transcript_id, u.seq, u.tool_use_id, name,
          coalesce(nullif(CASE WHEN name IN ('Read','Write','Edit','MultiEdit') THEN i->>'file_path' WHEN name = 'NotebookEdit' THEN i->>'notebook_path'
            WHEN name IN ('Bash','PowerShell') THEN i->>'command' WHEN name IN ('Grep','Glob') THEN i->>'pattern' WHEN name = 'WebFetch' THEN i->>'url'
            WHEN name = 'WebSearch' THEN i->>'query' WHEN name IN ('Task','Agent') THEN i->>'description' WHEN name = 'SendMessage' THEN i->>'to' WHEN name = 'Skill' THEN i->>'skill' END, ''),
            list_filter([json_extract_string(i, '$."' || k || '"') FOR k IN json_keys(i) IF json_type(json_extract(i, '$."' || k || '"')) = 'VARCHAR'], lambda x: x <> '')[1]) AS target,
          arg_min(r.ok, r.rs) AS ok
        FROM u LEFT JOIN r ON r.transcript_id = u.transcript_id AND r.tool_use_id = u.tool_use_id AND r.rs >= u.seq GROUP BY 1, 2, 3, 4, 5""",
    "rebuilt_usage": _E + """, u AS (SELECT transcript_id, seq, coalesce(nullif(trim(o->'message'->>'id'), ''), 'line ' || seq) AS message, o->'message'->>'model' AS model,
          epoch_us(CAST(regexp_replace(o->>'timestamp', 'Z+$', '') AS TIMESTAMP)) / 1e6 AS tm, o->'message'->'usage' AS g
          FROM e WHERE json_type(o->'message'->'usage') = 'OBJECT')
        SELECT transcript_id, message, round(arg_min(tm, seq), 3) AS at, arg_max(model, seq) FILTER (coalesce(model, '') NOT IN ('', '<synthetic>')) AS model,
          arg_max(CASE WHEN json_type(g->'input_tokens') IN ('UBIGINT', 'BIGINT') THEN greatest(CAST(g->>'input_tokens' AS BIGINT), 0) ELSE 0 END, seq) AS input,
          arg_max(CASE WHEN json_type(g->'output_tokens') IN ('UBIGINT', 'BIGINT') THEN greatest(CAST(g->>'output_tokens' AS BIGINT), 0) ELSE 0 END, seq) AS output
        FROM u GROUP BY 1, 2""",
    "rebuilt_text": _E + """SELECT transcript_id, count(*) AS texts, CAST(sum(length(b->>'text')) AS BIGINT) AS chars FROM b WHERE b->>'type' = 'text' GROUP BY 1""",
}
