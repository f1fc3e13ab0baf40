"""DuckDB SQL of the queries over agents, launches, rounds, attention, entries and texts."""

_R = "WITH r AS (SELECT *, epoch_us(started_at) AS s, epoch_us(ended_at) AS e FROM (SELECT DISTINCT * FROM rounds)) "
_A = "WITH a AS (SELECT DISTINCT * FROM agents), l AS (SELECT DISTINCT * FROM launches) "
_W = "WITH w AS (SELECT DISTINCT * FROM attention) "
_KEY = r"nullif(regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '^agent-', ''), '')"
_PARENTS = _A + f""", pe AS (SELECT session_id, CASE WHEN {_KEY.format('parent_agent_id')} IS NULL OR {_KEY.format('parent_agent_id')} = {_KEY.format('agent_id')}
    THEN 'main' ELSE {_KEY.format('parent_agent_id')} END AS src, {_KEY.format('agent_id')} AS dst FROM a)"""
_SPANS = _R + f""", sp AS (SELECT session_id, {_KEY.format('agent_id')} AS node, min(s) AS st, max(e) AS en FROM r
    WHERE s IS NOT NULL AND e >= s GROUP BY 1, 2),
  a AS (SELECT DISTINCT * FROM agents),
  pe AS (SELECT session_id, {_KEY.format('parent_agent_id')} AS src, {_KEY.format('agent_id')} AS dst FROM a
         WHERE {_KEY.format('parent_agent_id')} IS NOT NULL AND {_KEY.format('parent_agent_id')} <> {_KEY.format('agent_id')})"""
_FILES = (
    r"array_to_string([CASE WHEN contains(w, '/') THEN array_to_string("
    r"list_reduce(list_prepend(CASE WHEN starts_with(w, '/') THEN [''] ELSE CAST([] AS VARCHAR[]) END, "
    r"[[x] FOR x IN string_split(w, '/')]), "
    r"lambda a, b: CASE WHEN b[1] = '' OR b[1] = '.' THEN a "
    r"WHEN b[1] = '..' AND len(a) > 0 AND a[-1] NOT IN ('..', '') THEN a[1:len(a) - 1] ELSE list_concat(a, b) END), '/') "
    r"ELSE w END FOR w IN string_split(replace(trim(regexp_replace(lower(target), '\s+', ' ', 'g')), '\', '/'), ' ')], ' ')"
)
_J = """WITH j AS (SELECT *, CASE WHEN json_valid(v) THEN v::JSON END AS o FROM entries),
  p AS (SELECT * FROM j WHERE json_type(o) = 'OBJECT')
"""
_ANSWER = _W + """, b AS (SELECT session_id, attention_id, kind, epoch_us(since) AS t FROM w WHERE since IS NOT NULL),
  c AS (SELECT DISTINCT session_id, CAST(round(at_s * 1e6) AS BIGINT) AS seen FROM tool_calls WHERE at_s IS NOT NULL),
  n AS (SELECT b.*, (SELECT min(seen) FROM c WHERE c.session_id = b.session_id AND c.seen > b.t + 1000000) AS next_at FROM b)
"""
_SHINGLES = """, {n} AS (SELECT session_id, t, unnest(list_distinct([array_to_string(w[i:i + 7], ' ') FOR i IN range(1, len(w) - 6)])) AS g
    FROM (SELECT DISTINCT session_id, {c} AS t, list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '') AS w
          FROM a WHERE {c} IS NOT NULL) WHERE len(w) >= 8)"""

ORACLES = {
    "run_totals": _R + """, a AS (SELECT DISTINCT * FROM agents),
        t AS (SELECT session_id, min(s) AS started, max(e) AS ended, count(*) AS rounds FROM r GROUP BY 1)
        SELECT a.session_id, count(*) AS agents, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
        any_value(started) AS started, any_value(ended) AS ended, any_value(rounds) AS rounds, any_value(ended) - any_value(started) AS wall
        FROM a LEFT JOIN t ON a.session_id = t.session_id GROUP BY 1""",
    "batches": _A + """SELECT session_id, turn_uuid, count(*) AS n, min(tool_use_id) AS first_id, min(epoch_us(launched_at)) AS launched
        FROM l WHERE turn_uuid IS NOT NULL GROUP BY 1, 2""",
    "agent_universe": _A + """, u AS (SELECT agent_id AS id, 'launch' AS src FROM a SEMI JOIN l USING (session_id, tool_use_id)
        UNION SELECT agent_id, 'rounds' FROM rounds UNION SELECT transcript_id, 'calls' FROM tool_calls)
        SELECT id, string_agg(DISTINCT src, ',' ORDER BY src) AS seen_in FROM u WHERE id IS NOT NULL GROUP BY 1""",
    "parent_edges": _PARENTS + " SELECT * FROM pe",
    "hidden_fans": _PARENTS + """, x AS (SELECT * FROM pe UNION SELECT session_id, 'main', dst FROM pe)
        SELECT * FROM x WHERE src = 'main' AND EXISTS (SELECT 1 FROM x y WHERE y.session_id = x.session_id AND y.dst = x.dst AND y.src <> 'main')""",
    "rank_columns": _SPANS.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + """,
      e AS (SELECT pe.* FROM pe JOIN sp x ON x.session_id = pe.session_id AND x.node = pe.src JOIN sp y ON y.session_id = pe.session_id AND y.node = pe.dst),
      up AS (SELECT session_id, node, node AS cur, [node] AS seen, false AS round FROM sp
             UNION ALL SELECT up.session_id, up.node, e.src, list_append(seen, e.src), list_contains(seen, e.src)
             FROM up JOIN e ON e.session_id = up.session_id AND e.dst = up.cur WHERE NOT round)
      SELECT session_id, node, CAST(CASE WHEN bool_or(round) THEN 0 ELSE max(len(seen)) - 1 END AS INT) AS rank FROM up GROUP BY 1, 2""",
    "longest_chain": _SPANS.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + """,
      e AS (SELECT pe.session_id, src, dst, y.en - y.st AS own FROM pe JOIN sp x ON x.session_id = pe.session_id AND x.node = pe.src
            JOIN sp y ON y.session_id = pe.session_id AND y.node = pe.dst WHERE (x.st, x.en, x.node) < (y.st, y.en, y.node)),
      up AS (SELECT session_id, node, en - st AS score FROM sp
             UNION ALL SELECT up.session_id, e.dst, up.score + own FROM up JOIN e ON e.session_id = up.session_id AND e.src = up.node)
      SELECT session_id, max(score) AS score FROM up GROUP BY 1""",
    "critical_path": _SPANS.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + f""",
      c AS (SELECT DISTINCT session_id, transcript_id, at_s, lower(trim(name)) AS tool, nullif({_FILES}, '') AS path FROM tool_calls),
      t AS (SELECT session_id, path, {_KEY.format('transcript_id')} AS ag, min(at_s) FILTER (tool IN ('write', 'edit')) AS wa, max(at_s) FILTER (tool = 'read') AS ra
            FROM c WHERE path IS NOT NULL AND at_s IS NOT NULL GROUP BY 1, 2, 3),
      ex AS (SELECT * FROM pe UNION SELECT x.session_id, x.ag, y.ag FROM t x JOIN t y ON x.session_id = y.session_id AND x.path = y.path AND x.ag <> y.ag AND y.ra >= x.wa),
      e AS (SELECT ex.session_id, src, dst, greatest(0, y.en - greatest(y.st, x.en)) AS gain FROM ex JOIN sp x ON x.session_id = ex.session_id AND x.node = ex.src
            JOIN sp y ON y.session_id = ex.session_id AND y.node = ex.dst WHERE (x.st, x.en, x.node) < (y.st, y.en, y.node)),
      best(session_id, node, score) USING KEY (session_id, node) AS (SELECT session_id, node, en - st FROM sp
             UNION SELECT e.session_id, e.dst, max(b.score + e.gain) FROM best b JOIN e ON e.session_id = b.session_id AND e.src = b.node
             JOIN recurring.best k ON k.session_id = e.session_id AND k.node = e.dst WHERE b.score + e.gain > k.score GROUP BY 1, 2)
      SELECT b.session_id, max(score) AS score, round(max(score) / nullif(max(w), 0), 6) AS share FROM best b
      JOIN (SELECT session_id, max(en) - min(st) AS w FROM sp GROUP BY 1) v ON v.session_id = b.session_id GROUP BY 1""",
    "handoff_containment": _A + _SHINGLES.format(n="ss", c="result") + _SHINGLES.format(n="dd", c="brief") + """,
        z AS (SELECT session_id, t, count(*) AS n FROM ss GROUP BY 1, 2),
        k AS (SELECT ss.session_id, ss.t AS s, dd.t AS d, count(*) AS c FROM ss JOIN dd ON ss.session_id = dd.session_id AND ss.g = dd.g GROUP BY 1, 2, 3)
        SELECT k.session_id, count(*) AS pairs, round(max(c / n), 6) AS best FROM k JOIN z ON z.session_id = k.session_id AND z.t = k.s WHERE c / n >= 0.5 GROUP BY 1""",
    "concurrency_sweep": _R + """, k AS (SELECT session_id, s AS t, 1 AS d FROM r WHERE s IS NOT NULL AND e >= s
          UNION ALL SELECT session_id, e, -1 FROM r WHERE s IS NOT NULL AND e >= s),
        g AS (SELECT session_id, t, sum(d) AS d FROM k GROUP BY 1, 2),
        l AS (SELECT session_id, t, sum(d) OVER (PARTITION BY session_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS level,
              coalesce(lead(t) OVER (PARTITION BY session_id ORDER BY t) - t, 0) AS span FROM g)
        SELECT session_id, CAST(max(level) AS BIGINT) AS peak, CAST(sum(level * span) AS BIGINT) AS busy, max(t) - min(t) AS wall,
        CAST(sum(CASE WHEN level = 0 THEN span ELSE 0 END) AS BIGINT) AS idle, CAST(sum(CASE WHEN level = 1 THEN span ELSE 0 END) AS BIGINT) AS solo
        FROM l GROUP BY 1""",
    "round_union": _R + """, m AS (SELECT session_id, s, e, max(e) OVER (PARTITION BY session_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
          FROM r WHERE s IS NOT NULL AND e >= s),
        g AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
        i AS (SELECT session_id, k, max(e) - min(s) AS c FROM g GROUP BY 1, 2)
        SELECT session_id AS entity, CAST(sum(c) AS BIGINT) AS covered FROM i GROUP BY 1""",
    "time_split": _R + """, k AS (SELECT session_id, s AS t, CASE WHEN status = 'completed' THEN 1 ELSE 0 END AS a, CASE WHEN status = 'completed' THEN 0 ELSE 1 END AS b
          FROM r WHERE s IS NOT NULL AND e >= s UNION ALL
          SELECT session_id, e, CASE WHEN status = 'completed' THEN -1 ELSE 0 END, CASE WHEN status = 'completed' THEN 0 ELSE -1 END FROM r WHERE s IS NOT NULL AND e >= s),
        g AS (SELECT session_id, t, sum(a) AS a, sum(b) AS b FROM k GROUP BY 1, 2),
        l AS (SELECT session_id, sum(a) OVER o AS ca, sum(b) OVER o AS cb, coalesce(lead(t) OVER (PARTITION BY session_id ORDER BY t) - t, 0) AS span
              FROM g WINDOW o AS (PARTITION BY session_id ORDER BY t ROWS UNBOUNDED PRECEDING))
        SELECT session_id, CAST(sum(CASE WHEN ca > 0 THEN span ELSE 0 END) AS BIGINT) AS first_s,
        CAST(sum(CASE WHEN ca <= 0 AND cb > 0 THEN span ELSE 0 END) AS BIGINT) AS second_s FROM l GROUP BY 1""",
    "replay_as_of": _R + """SELECT session_id, CASE WHEN e IS NOT NULL AND e <= 1772323200000000 THEN 'ended' ELSE 'running' END AS state, count(*) AS n
        FROM r WHERE s <= 1772323200000000 GROUP BY 1, 2""",
    "slowest_agents": _R + """, p AS (SELECT session_id, agent_id, CAST(sum(e - s) AS BIGINT) AS busy FROM r WHERE s IS NOT NULL AND e > s GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY busy DESC, agent_id) AS place FROM p QUALIFY place <= 5""",
    "resumed_rounds": _R + """, b AS (SELECT *, lag(e) OVER (PARTITION BY agent_id ORDER BY round_no, s, e NULLS FIRST) AS pe FROM r WHERE s IS NOT NULL)
        SELECT agent_id, count(*) AS resumed, CAST(sum(greatest(s - pe, 0)) AS BIGINT) AS idle FROM b WHERE pe IS NOT NULL GROUP BY 1""",
    "step_lookup": _R + """, q AS (SELECT DISTINCT attention_id, session_id, epoch_us(since) AS t FROM attention WHERE since IS NOT NULL)
        SELECT attention_id, (SELECT count(*) FROM r WHERE r.session_id = q.session_id AND s <= t AND e >= s)
          - (SELECT count(*) FROM r WHERE r.session_id = q.session_id AND e <= t AND e >= s) AS level FROM q""",
    "attention_latest": _W + """SELECT session_id, attention_id, kind FROM w QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY
        CASE kind WHEN 'permission' THEN 4 WHEN 'error' THEN 3 WHEN 'input' THEN 2 ELSE 1 END DESC, since DESC NULLS LAST, attention_id DESC) = 1""",
    "first_activity_after": _ANSWER + "SELECT attention_id, next_at FROM n",
    "wait_intervals": _ANSWER + "SELECT session_id, kind, next_at, min(t) AS since, count(*) AS prompts FROM n WHERE kind IN ('permission', 'input') GROUP BY 1, 2, 3",
    "wait_overlap": _ANSWER + """, q AS (SELECT session_id, kind, next_at AS e, min(t) AS s FROM n WHERE kind IN ('permission', 'input') AND next_at IS NOT NULL GROUP BY 1, 2, 3),
        r AS (SELECT *, epoch_us(started_at) AS s, epoch_us(ended_at) AS e FROM (SELECT DISTINCT * FROM rounds)),
        x AS (SELECT q.session_id, q.kind || '/' || q.s AS wait, r.agent_id || '#' || r.round_no || '#' || r.s AS round, least(q.e, r.e) - greatest(q.s, r.s) AS overlap
              FROM q JOIN r ON r.session_id = q.session_id AND r.s < q.e AND r.e > q.s AND r.e > r.s)
        SELECT * FROM x WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY session_id, wait ORDER BY overlap DESC, round) = 1""",
    "launches_in_turns": _A + """, w AS (SELECT session_id, epoch_us(since) AS opened, max(attention_id) AS number FROM attention WHERE since IS NOT NULL GROUP BY 1, 2),
        x AS (SELECT l.session_id, (SELECT arg_max(number, opened) FROM w WHERE w.session_id = l.session_id AND w.opened <= epoch_us(l.launched_at)) AS number
              FROM l WHERE launched_at IS NOT NULL)
        SELECT session_id, number, count(*) AS launches FROM x GROUP BY 1, 2""",
    "scanned_lines": _J + """SELECT file, count(*) AS lines, count(*) FILTER (o IS NULL OR json_type(o) <> 'OBJECT') AS bad, max(generation) AS generation FROM j GROUP BY 1""",
    "latest_generation": """WITH g AS (SELECT file, max(generation) AS g FROM entries GROUP BY 1)
        SELECT transcript_id, count(DISTINCT seq) AS lines FROM entries JOIN g USING (file) WHERE generation = g GROUP BY 1""",
    "sessions_recent": """SELECT session_id, regexp_extract(file, 'projects/([^/]+)/', 1) AS project, count(DISTINCT file) AS files,
        count(DISTINCT transcript_id) AS transcripts FROM entries GROUP BY 1, 2""",
    "entry_times": _J + r""", t AS (SELECT session_id, CASE WHEN regexp_full_match(o->>'timestamp', '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d*)?Z*')
          THEN epoch_us(CAST(regexp_replace(o->>'timestamp', 'Z+$', '') AS TIMESTAMP)) / 1e6 END AS t FROM p)
        SELECT session_id, round(min(t), 3) AS first_at, round(max(t), 3) AS last_at, count(*) FILTER (t IS NULL) AS undated FROM t GROUP BY 1""",
    "content_blocks": _J + """, b AS (SELECT unnest(CAST(o->'message'->'content' AS JSON[])) AS b FROM p WHERE json_type(o->'message'->'content') = 'ARRAY')
        SELECT coalesce(b->>'type', '?') AS kind, count(*) AS n FROM b GROUP BY 1""",
    "user_prompts": _J + r""", q AS (SELECT DISTINCT o->>'uuid' AS uuid, regexp_replace(regexp_replace(o->'message'->>'content', '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM p
          WHERE o->>'type' = 'user' AND json_type(o->'message'->'content') = 'VARCHAR' AND lower(coalesce(o->>'isSidechain', 'false')) <> 'true')
        SELECT uuid, CASE WHEN length(t) > 500 THEN t[1:500] || '...' ELSE t END AS prompt FROM q WHERE t <> '' AND NOT starts_with(t, '<')""",
    "turn_split": _J + """, u AS (SELECT transcript_id, o->>'uuid' AS uuid, o->>'type' AS type, json_type(o->'message'->'content') AS shape, seq FROM p
          QUALIFY row_number() OVER (PARTITION BY transcript_id, o->>'uuid' ORDER BY generation, seq) = 1),
        t AS (SELECT transcript_id, CAST(sum(CASE WHEN type = 'user' AND shape = 'VARCHAR' THEN 1 ELSE 0 END)
              OVER (PARTITION BY transcript_id ORDER BY seq, uuid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM u)
        SELECT transcript_id, turn, count(*) AS entries FROM t GROUP BY 1, 2""",
    "notifications": r"""WITH b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?is)(<task-notification>.*?</task-notification>)', 1)) AS b FROM documents)
        SELECT doc_id, lower(regexp_extract(b, '(?is)<task-id>\s*(.*?)\s*</task-id>', 1)) AS task_id, lower(regexp_extract(b, '(?is)<status>\s*(.*?)\s*</status>', 1)) AS status,
        length(regexp_extract(b, '(?is)<result>\s*(.*?)\s*</result>', 1)) AS result_chars FROM b""",
    "search_agents": _A + """SELECT session_id, count(*) AS n FROM a WHERE contains(lower(concat_ws(chr(10), agent_type, description, brief, result)), 'price')
        AND contains(lower(concat_ws(chr(10), agent_type, description, brief, result)), 'table') GROUP BY 1""",
    "agent_flags": _A + r""", f AS (SELECT agent_id, concat_ws(',', CASE WHEN status = 'failed' THEN 'failed' END,
          CASE WHEN regexp_full_match(result, '\s*') THEN 'blank result' END, CASE WHEN result IS NULL THEN 'no result' END,
          CASE WHEN brief IS NULL THEN 'no brief' END, CASE WHEN spawn_depth > 10 THEN 'deep' END) AS flags FROM a)
        SELECT * FROM f WHERE flags <> ''""",
    "agents_filtered": _A + """SELECT agent_id, status, description FROM a WHERE status IN ('failed', 'running')
        AND contains(lower(concat_ws(chr(10), agent_type, description, agent_id, model)), 'test')""",
    "fleet_ranking": _W + """, k AS (SELECT session_id, kind FROM w QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY
          CASE kind WHEN 'permission' THEN 4 WHEN 'error' THEN 3 WHEN 'input' THEN 2 ELSE 1 END DESC, since DESC NULLS LAST, attention_id DESC) = 1),
        n AS (SELECT session_id, count(*) AS agents, count(*) FILTER (status = 'failed') AS failed FROM (SELECT DISTINCT * FROM agents) GROUP BY 1)
        SELECT n.session_id, agents, failed, kind, CASE kind WHEN 'permission' THEN 4 WHEN 'error' THEN 3 WHEN 'input' THEN 2 ELSE 0 END AS urgency
        FROM n LEFT JOIN k ON k.session_id = n.session_id""",
    "outcome_dedup": "SELECT sha1(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "big_results": "SELECT doc_id, length(text)::INT AS chars, length(text) // 4 AS tokens FROM documents WHERE text IS NOT NULL ORDER BY chars DESC, doc_id LIMIT 12",
    "coverage_missing": r"""WITH d AS (SELECT DISTINCT project, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source FROM documents)
        SELECT p.project, t.source FROM (SELECT DISTINCT project FROM d WHERE project IS NOT NULL AND source <> '') p CROSS JOIN mix_targets t
        WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.project = p.project AND d.source = t.source)""",
    "export_rows": _A + r"""SELECT agent_id, CASE WHEN regexp_matches(agent_type, '^[=+\-@]') THEN '''' || agent_type ELSE coalesce(agent_type, '') END AS agent_type,
        CASE WHEN regexp_matches(description, '^[=+\-@]') THEN '''' || description ELSE coalesce(description, '') END AS description,
        coalesce(CAST(spawn_depth AS VARCHAR), '') AS depth, coalesce(strftime(last_activity_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), '') AS last_activity FROM a""",
    "markers": _R + """, m AS (SELECT session_id, agent_id, 'start' AS what, s AS at FROM r WHERE s IS NOT NULL
          UNION SELECT session_id, agent_id, CASE WHEN status = 'failed' THEN 'fail' ELSE 'done' END, e FROM r WHERE e IS NOT NULL)
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "at" DESC, agent_id, what) AS n FROM m QUALIFY n <= 40""",
}
