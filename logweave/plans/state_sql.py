"""DuckDB SQL of the queries on states, turns and costs, written from the rules rather than from the queries."""

_S = """WITH a AS (SELECT DISTINCT * FROM agents), w AS (SELECT DISTINCT * FROM attention),
  r AS (SELECT *, epoch_us(started_at) AS s, epoch_us(ended_at) AS e FROM (SELECT DISTINCT * FROM rounds)),
  c AS (SELECT DISTINCT session_id, transcript_id, seq, ok, lower(trim(name)) AS tool, target, CAST(round(at_s * 1e6) AS BIGINT) AS us FROM tool_calls),
  wr AS (SELECT session_id, max(us) AS written FROM c GROUP BY 1),
  la AS (SELECT session_id, max(t) AS now FROM (SELECT session_id, us AS t FROM c UNION ALL SELECT session_id, greatest(s, e) FROM r
         UNION ALL SELECT session_id, epoch_us(since) FROM w) GROUP BY 1),
  ses AS (SELECT session_id, written, now, coalesce(now - written <= 600000000, false) AS live FROM la LEFT JOIN wr USING (session_id)),
  seen AS (SELECT session_id, agent_id, max(t) AS seen FROM (SELECT session_id, agent_id, epoch_us(last_activity_at) AS t FROM a
           UNION ALL SELECT session_id, transcript_id, us FROM c WHERE us IS NOT NULL) WHERE agent_id IS NOT NULL GROUP BY 1, 2),
  any_ AS (SELECT session_id, max(seen) AS seen FROM seen GROUP BY 1),
  ask AS (SELECT w.session_id, attention_id, kind, nullif(trim(w.agent_id), '') AS agent_id, epoch_us(since) AS since FROM w
          WHERE kind IN ('permission', 'error', 'input', 'idle') AND since IS NOT NULL),
  pend AS (SELECT k.* FROM ask k LEFT JOIN seen ON seen.session_id = k.session_id AND seen.agent_id = k.agent_id
           LEFT JOIN any_ ON any_.session_id = k.session_id
           WHERE coalesce(CASE WHEN k.agent_id IS NULL THEN any_.seen ELSE seen.seen END, 0) <= k.since + 1000000
           QUALIFY row_number() OVER (PARTITION BY k.session_id, k.agent_id, kind ORDER BY since DESC, attention_id DESC) = 1)
"""
_STATUS = _S + """, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session_id, agent_id ORDER BY round_no DESC NULLS LAST, s DESC NULLS LAST, e DESC NULLS LAST, status DESC NULLS LAST) = 1),
  mid AS (SELECT session_id, transcript_id AS agent_id, bool_or(ok IS NULL) AS mid FROM c GROUP BY 1, 2),
  wt AS (SELECT DISTINCT session_id, agent_id FROM pend WHERE kind IN ('permission', 'input') AND agent_id IS NOT NULL),
  st AS (SELECT a.session_id, a.agent_id, CASE WHEN f.agent_id IS NULL THEN 'unknown' WHEN f.e IS NOT NULL THEN f.status
      WHEN NOT coalesce(ses.live, false) THEN CASE WHEN coalesce(mid, false) THEN 'failed' ELSE 'orphaned' END
      WHEN wt.agent_id IS NOT NULL THEN 'waiting' WHEN coalesce(ses.now - coalesce(seen.seen, f.s) > 300000000, false) THEN 'stalled' ELSE 'running' END AS status
    FROM a LEFT JOIN f ON f.session_id = a.session_id AND f.agent_id = a.agent_id LEFT JOIN mid ON mid.session_id = a.session_id AND mid.agent_id = a.agent_id
    LEFT JOIN seen ON seen.session_id = a.session_id AND seen.agent_id = a.agent_id LEFT JOIN wt ON wt.session_id = a.session_id AND wt.agent_id = a.agent_id
    LEFT JOIN ses ON ses.session_id = a.session_id)
"""
_WAITS = _S + """, b AS (SELECT session_id, coalesce(trim(agent_id), '') AS agent_id, attention_id, kind, epoch_us(since) AS since FROM w
        WHERE kind IN ('permission', 'input') AND since IS NOT NULL),
  n AS (SELECT b.*, coalesce((SELECT min(us) FROM c WHERE c.session_id = b.session_id AND (b.agent_id = '' OR c.transcript_id = b.agent_id)
          AND us > since + 1000000), 4611686018427387904) AS until FROM b),
  g AS (SELECT *, lag(until) OVER (PARTITION BY session_id, agent_id ORDER BY until) AS bf FROM (SELECT DISTINCT session_id, agent_id, until FROM n)),
  h AS (SELECT n.* REPLACE (CASE WHEN n.since <= g.bf THEN g.bf ELSE n.until END AS until) FROM n JOIN g USING (session_id, agent_id, until)),
  q AS (SELECT session_id, agent_id, until, arg_min(kind, (since, attention_id)) AS kind, min(since) AS since, count(*) AS prompts FROM h GROUP BY 1, 2, 3),
  x AS (SELECT q.session_id, agent_id, kind, since, CASE WHEN until < 4611686018427387904 THEN until END AS answered_at,
      CASE WHEN until < 4611686018427387904 THEN 'answered' WHEN live THEN 'open' ELSE 'unanswered' END AS state, prompts,
      CASE WHEN until < 4611686018427387904 THEN until - since WHEN live THEN greatest(0, now - since) ELSE 0 END AS waited
    FROM q LEFT JOIN ses ON ses.session_id = q.session_id)
"""
_UNION = """, o AS (SELECT *, max(z) OVER (PARTITION BY {k} ORDER BY y, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pz FROM sp),
  i AS (SELECT *, sum(CASE WHEN pz IS NULL OR y > pz THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY y, z ROWS UNBOUNDED PRECEDING) AS isle FROM o),
  un AS (SELECT {k}, CAST(sum(z - y) AS BIGINT) AS covered FROM (SELECT {k}, isle, min(y) AS y, max(z) AS z FROM i GROUP BY ALL) GROUP BY {k})
"""
_MSG = r"""WITH d AS (SELECT *, regexp_replace(message_id, '^\s+|\s+$', '', 'g') AS mid FROM api_calls WHERE operation IS NULL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY session_id, transcript_id, mid ORDER BY received_at DESC, delivery_id DESC) AS rn,
          first_value(at_s) OVER (PARTITION BY session_id, transcript_id, mid ORDER BY received_at, delivery_id) AS at0 FROM d WHERE mid <> ''),
  m AS (SELECT * EXCLUDE (at_s, at0), at0 AS at_s, cache_create + cache_read + input_tokens AS size,
          CASE WHEN contains(lower(model), 'haiku') THEN 200000 ELSE 1000000 END AS lim FROM rk WHERE rn = 1)
"""
_PRESSURE = """, t AS (SELECT * FROM m WHERE at_s IS NOT NULL),
  pk AS (SELECT session_id, transcript_id, max(size) AS peak, arg_max(lim, (size, -at_s, mid)) AS lim, arg_max(size, (at_s, mid)) AS ns, arg_max(lim, (at_s, mid)) AS nl
         FROM t GROUP BY 1, 2 HAVING max(size) > 0),
  pr AS (SELECT session_id, transcript_id, row_number() OVER (PARTITION BY session_id ORDER BY peak DESC, transcript_id) AS place, peak,
           round(peak / lim, 6) AS fill, round(ns / nl, 6) AS now_fill FROM pk QUALIFY place <= 10)
"""
_TURNS = r"""WITH p AS (SELECT transcript_id, min(seq) AS seq, v::JSON AS o FROM entries WHERE json_valid(v) GROUP BY transcript_id, v),
  e AS (SELECT transcript_id, seq, o->>'uuid' AS uuid, o->>'type' AS type, json_type(o->'message'->'content') AS shape, o,
          epoch_us(TRY_CAST(regexp_replace(o->>'timestamp', 'Z+$', '') AS TIMESTAMP)) / 1e6 AS tm FROM p WHERE json_type(o) = 'OBJECT'),
  b AS (SELECT *, CASE WHEN shape = 'VARCHAR' THEN o->'message'->>'content' WHEN shape = 'ARRAY'
          AND NOT list_contains([x->>'type' FOR x IN CAST(o->'message'->'content' AS JSON[])], 'tool_result')
          THEN array_to_string([coalesce(x->>'text', '') FOR x IN CAST(o->'message'->'content' AS JSON[]) IF (x->>'type') = 'text'], ' ') END AS body FROM e),
  t AS (SELECT *, regexp_replace(body, '^\s+|\s+$', '', 'g') AS said FROM b),
  u AS (SELECT *, coalesce(type = 'user' AND lower(coalesce(o->>'isMeta', 'false')) NOT IN ('true', '1') AND lower(coalesce(o->>'isSidechain', 'false')) NOT IN ('true', '1')
          AND said <> '' AND NOT regexp_matches(said, '^(<local-command|<system-reminder>|<task-notification|<bash-input>|<bash-stdout>|<bash-stderr>|Caveat:)')
          AND tm IS NOT NULL, false) AS opens FROM t),
  n AS (SELECT *, CAST(sum(opens::INT) OVER (PARTITION BY transcript_id ORDER BY seq, uuid NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM u QUALIFY turn > 0),
  sp AS (SELECT transcript_id, turn, arg_min(tm, seq) FILTER (opens) AS at0, max(tm) AS at1 FROM n GROUP BY 1, 2),
  us AS (SELECT transcript_id, o->'message'->>'id' AS mid, min(turn) AS turn, arg_max(
           CASE WHEN json_type(o->'message'->'usage'->'input_tokens') IN ('UBIGINT', 'BIGINT') THEN greatest(CAST(o->'message'->'usage'->>'input_tokens' AS BIGINT), 0) ELSE 0 END
           + CASE WHEN json_type(o->'message'->'usage'->'output_tokens') IN ('UBIGINT', 'BIGINT') THEN greatest(CAST(o->'message'->'usage'->>'output_tokens' AS BIGINT), 0) ELSE 0 END
           + CASE WHEN json_type(o->'message'->'usage'->'cache_creation_input_tokens') IN ('UBIGINT', 'BIGINT') THEN greatest(CAST(o->'message'->'usage'->>'cache_creation_input_tokens' AS BIGINT), 0) ELSE 0 END,
           (seq, coalesce(uuid, ''))) AS fresh
         FROM n WHERE type = 'assistant' AND (o->'message'->>'id') <> '' AND json_type(o->'message'->'usage') = 'OBJECT' GROUP BY 1, 2),
  su AS (SELECT transcript_id, turn, CAST(sum(fresh) AS BIGINT) AS fresh, count(*) AS messages FROM us GROUP BY 1, 2),
  tu AS (SELECT sp.transcript_id, sp.turn, round(greatest(at1 - at0, 0), 3) AS seconds, coalesce(fresh, 0) AS fresh, coalesce(messages, 0) AS messages
         FROM sp LEFT JOIN su USING (transcript_id, turn))
"""
_FILE = r"lower(regexp_extract({}, '([^\\/]*)$', 1))"
_VERIFIED = rf"""WITH c AS (SELECT DISTINCT transcript_id, seq, coalesce(at_s, 0) AS tm, lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) AS kind, ref, ok FROM tool_calls),
  k AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY tm, seq) AS n FROM c WHERE kind IN ('edit', 'check', 'run')),
  e AS (SELECT transcript_id, max(n) AS n, arg_max({_FILE.format("trim(ref)")}, n) AS file FROM k WHERE kind = 'edit' GROUP BY 1),
  v AS (SELECT e.transcript_id, arg_max(coalesce(k.ok, true), k.n) FILTER (k.n > e.n AND (k.kind = 'check' OR k.kind = 'run' AND e.file <> ''
            AND list_contains([{_FILE.format("trim(x)")} FOR x IN string_split(k.ref, chr(10))], e.file))) AS fine,
          coalesce(bool_or(k.kind = 'check' AND k.n < e.n), false) AS checked_before
        FROM e LEFT JOIN k ON k.transcript_id = e.transcript_id GROUP BY 1),
  z AS (SELECT transcript_id, CASE WHEN fine IS NULL THEN 'unchecked' WHEN fine THEN 'checked' ELSE 'failing' END AS state, checked_before FROM v)
"""
_ENDINGS = (
    "py|pyi|ipynb|js|mjs|cjs|jsx|ts|tsx|mts|cts|vue|svelte|go|rs|java|kt|kts|scala|cs|fs|c|cc|cpp|cxx|h|hpp|m|mm|swift|rb|php|pl|lua|r|dart|ex|exs|erl|hs|clj|"
    "sql|sh|bash|zsh|ps1|psm1|bat|cmd|css|scss|sass|less|html|htm|json|yaml|yml|toml|ini|cfg|xml|gradle|proto|graphql|tf"
)
_CODE = rf"(?i)((^|[\\/])[^\\/]*\.({_ENDINGS})|(^|[\\/])(makefile|dockerfile|rakefile|gemfile|justfile))\s*$"
_CHECK = (
    r"(?i)(^|[^\w.\-])(pytest|python[\d.]*\s+-m\s+(pytest|unittest|mypy|pyright|ruff|flake8|pylint|tox|nox)|mypy|pyright|ruff|flake8|pylint|tox|nox|black\s+--check"
    r"|(npm|pnpm|yarn|bun)\s+(run\s+)?[\w:.-]*(test|lint|build|typecheck|type-check|check|verify)|(npx\s+)?(tsc|jest|vitest|mocha|eslint|biome|playwright\s+test|cypress\s+run)"
    r"|node\s+--test|deno\s+(test|check|lint)|cargo\s+(test|check|build|clippy|nextest)|go\s+(test|vet|build)|golangci-lint|mvn|mvnw|gradle|gradlew|dotnet\s+(test|build)"
    r"|swift\s+(test|build)|make\s+([\w-]*test|check|lint|build)|ctest|bazel\s+(test|build)|rspec|rubocop|phpunit|phpstan|(mix|stack|cabal|flutter|dart)\s+test"
    r"|claude\s+plugin\s+validate)($|[^\w.\-])"
)
_RUN = (
    r"(?is)(?:^|[^\w.\-])(?:python[\d.]*|py|node|deno\s+run|bun|tsx|ts-node|bash|sh|zsh|pwsh|powershell(?:\.exe)?|ruby|php|perl|Rscript|go\s+run)\s(.*)$"
)
#: Here-documents do not occur in the tables, so their bodies are not taken out here.
CLASSES = rf"""WITH c AS (SELECT DISTINCT session_id, transcript_id, seq, lower(trim(name)) AS tool, trim(target) AS t, ok FROM tool_calls),
  l AS (SELECT *, list_filter(regexp_extract_all(regexp_extract(t, '{_RUN}', 1), '[^\s"''|&;<>()]+'), lambda x: regexp_matches(x, '{_CODE}')) AS ran FROM c),
  k AS (SELECT *, CASE WHEN tool IN ('edit', 'write') AND regexp_matches(t, '{_CODE}') AND NOT regexp_matches(t, '(?i)(^|[\\/])(scratchpad|scratch|tmp|temp)[\\/]') THEN 'EDIT'
      WHEN tool = 'bash' AND regexp_matches(t, '{_CHECK}') THEN 'CHECK' WHEN tool = 'bash' AND len(ran) > 0 THEN 'RUN' END AS kind FROM l)
"""
ORACLES = {
    "session_states": _S + "SELECT session_id, written, now, live FROM ses",
    "attention_pending": _S + "SELECT session_id, agent_id, kind, attention_id, since FROM pend",
    "attention_shown": _S + """SELECT session_id, attention_id, kind, agent_id, since FROM pend QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY
        CASE kind WHEN 'permission' THEN 4 WHEN 'error' THEN 3 WHEN 'input' THEN 2 ELSE 1 END DESC, since DESC, attention_id DESC) = 1""",
    "agent_status": _STATUS + "SELECT * FROM st",
    "status_counts": _STATUS + "SELECT session_id, status, count(*) AS agents FROM st GROUP BY 1, 2",
    "wait_states": _WAITS + "SELECT * FROM x",
    "waits_summary": _WAITS + ", sp AS (SELECT session_id, since AS y, since + waited AS z FROM x WHERE waited > 0)" + _UNION.format(k="session_id") + """
        SELECT session_id, CAST(sum(waited) AS BIGINT) AS summed, max(waited) AS longest, count(*) FILTER (state = 'answered') AS answered,
          count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'unanswered') AS unanswered, coalesce(any_value(covered), 0) AS covered
        FROM x LEFT JOIN un USING (session_id) GROUP BY 1""",
    "assembled_agents": """WITH a AS (SELECT DISTINCT * FROM agents), l AS (SELECT DISTINCT * FROM launches)
        SELECT a.session_id, a.agent_id, a.tool_use_id, coalesce(nullif(trim(a.description), ''), l.description, '') AS description,
          coalesce(nullif(trim(a.model), ''), nullif(trim(l.model), ''), '') AS model,
          CASE WHEN a.launch_mode = 'background' THEN 'background' ELSE coalesce(a.launch_mode, 'inline') END AS launch_mode,
          CASE WHEN l.launcher_agent_id <> a.agent_id THEN l.launcher_agent_id END AS parent_agent_id, length(coalesce(l.prompt, '')) AS brief, epoch_us(l.launched_at) AS launched_at
        FROM a LEFT JOIN l ON l.session_id = a.session_id AND l.tool_use_id = a.tool_use_id""",
    "message_edges": r"""WITH k AS (SELECT DISTINCT session_id, agent_id, regexp_replace(lower(regexp_replace(agent_id, '^\s+|\s+$', '', 'g')), '^agent-', '') AS id FROM agents),
        s AS (SELECT DISTINCT session_id, transcript_id, seq, regexp_replace(lower(regexp_replace(target, '^\s+|\s+$', '', 'g')), '^agent-', '') AS id FROM tool_calls WHERE lower(trim(name)) = 'sendmessage')
        SELECT s.session_id, s.transcript_id AS src, k.agent_id AS dst, count(*) AS messages FROM s JOIN k ON k.session_id = s.session_id AND k.id = s.id
        WHERE s.id <> '' AND k.agent_id <> s.transcript_id GROUP BY 1, 2, 3""",
    "agent_verification": _VERIFIED + "SELECT transcript_id, state, checked_before FROM z",
    "verification": _VERIFIED + "SELECT state, count(*) AS transcripts FROM z GROUP BY 1",
    "api_errors": _MSG + """, w AS (SELECT DISTINCT session_id, attention_id, coalesce(error_type, 'error') AS error_type, epoch_us(since) AS since FROM attention WHERE kind = 'error' AND since IS NOT NULL),
        g AS (SELECT w.*, (SELECT min(CAST(round(at_s * 1e6) AS BIGINT)) FROM m WHERE m.session_id = w.session_id AND round(at_s * 1e6) > w.since) AS nx FROM w),
        sp AS (SELECT session_id, error_type, since AS y, nx AS z FROM g WHERE nx IS NOT NULL)""" + _UNION.format(k="session_id, error_type") + """
        SELECT session_id, error_type, count(*) AS errors, count(*) FILTER (nx IS NULL) AS ongoing, coalesce(any_value(covered), 0) AS lost
        FROM g LEFT JOIN un USING (session_id, error_type) GROUP BY 1, 2""",
    "waste_summary": _MSG + """, b AS (SELECT *, lag(at_s) OVER x AS pat, lag(model) OVER x AS pm FROM m WHERE at_s IS NOT NULL WINDOW x AS (PARTITION BY session_id, transcript_id ORDER BY at_s, mid)),
        k AS (SELECT *, CASE WHEN pm <> model AND pm <> '' AND model <> '' THEN 'model' WHEN at_s - pat >= 3600 THEN 'idle_long' WHEN at_s - pat >= 300 THEN 'idle_short' ELSE 'unknown' END AS cause
              FROM b WHERE pat IS NOT NULL AND cache_create >= 1000 AND cache_read < 0.2 * cache_create),
        t AS (SELECT session_id, sum(cache_create) AS written FROM m GROUP BY 1)
        SELECT session_id, count(*) AS rebuilds, CAST(sum(cache_create) AS BIGINT) AS rebuilt, CAST(coalesce(sum(cache_create) FILTER (cause = 'model'), 0) AS BIGINT) AS model,
          CAST(coalesce(sum(cache_create) FILTER (cause = 'idle_long'), 0) AS BIGINT) AS idle_long, CAST(coalesce(sum(cache_create) FILTER (cause = 'idle_short'), 0) AS BIGINT) AS idle_short,
          CAST(coalesce(sum(cache_create) FILTER (cause = 'unknown'), 0) AS BIGINT) AS unknown, round(sum(cache_create) / any_value(written), 6) AS share
        FROM k JOIN t USING (session_id) GROUP BY 1""",
    "pressure_summary": _MSG + _PRESSURE + "SELECT session_id, transcript_id, place, peak, fill, now_fill FROM pr",
    "near_limit": _STATUS + _MSG.replace("WITH d AS", ", d AS", 1) + _PRESSURE + """SELECT pr.session_id, pr.transcript_id, now_fill FROM pr JOIN ses ON ses.session_id = pr.session_id AND ses.live
        JOIN st ON st.session_id = pr.session_id AND st.agent_id = pr.transcript_id AND st.status IN ('running', 'waiting', 'stalled') WHERE now_fill >= 0.01""",
    "turn_usage": _TURNS + "SELECT * FROM tu",
    "prompt_summary": _TURNS + """SELECT transcript_id, count(*) AS prompts, round(median(seconds), 3) AS median_s, arg_min(turn, (-fresh, turn)) AS top_turn,
        round(max(fresh) / nullif(sum(fresh), 0), 6) AS top_share FROM tu GROUP BY 1""",
    "check_outcomes": CLASSES + rf"""SELECT session_id, count(*) FILTER (kind = 'CHECK' AND ok) AS passed, count(*) FILTER (kind = 'CHECK' AND NOT ok) AS failed,
        count(DISTINCT {_FILE.format("t")}) FILTER (kind = 'EDIT') AS edited, count(*) FILTER (kind = 'RUN') AS runs FROM k WHERE kind IS NOT NULL GROUP BY 1""",
    "call_classes": CLASSES + "SELECT kind AS class, count(*) AS n FROM k GROUP BY 1",
}
