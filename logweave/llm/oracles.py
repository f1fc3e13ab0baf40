"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_PATH = (
    r"array_to_string([CASE WHEN contains(w, '/') THEN array_to_string("
    r"list_reduce(list_prepend(CASE WHEN starts_with(w, '/') THEN [''] ELSE CAST([] AS VARCHAR[]) END, "
    r"[[x] FOR x IN string_split(w, '/')]), "
    r"lambda a, b: CASE WHEN b[1] = '' OR b[1] = '.' THEN a "
    r"WHEN b[1] = '..' AND len(a) > 0 AND a[-1] NOT IN ('..', '') THEN a[1:len(a) - 1] ELSE list_concat(a, b) END), '/') "
    r"ELSE w END FOR w IN string_split(replace(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), '\', '/'), ' ')], ' ')"
)
_VALUE = f"nullif({_PATH.format(c='name')}, '') || chr(10) || nullif({_PATH.format(c='target')}, '')"
_RUNS = f"""
  WITH c AS (SELECT transcript_id, seq, min({_VALUE}) AS value, min(at_s) AS tm FROM tool_calls
             WHERE transcript_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2),
  d AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY seq)
               - row_number() OVER (PARTITION BY transcript_id, value ORDER BY seq) AS run FROM c),
  r AS (SELECT transcript_id, value, run, CASE WHEN value IS NULL THEN seq END AS lone,
               min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, min(tm) AS started, max(tm) AS ended
        FROM d GROUP BY ALL)
"""
ORACLES = {
    "p1_found": _RUNS + "SELECT transcript_id, first_seq, last_seq FROM r WHERE n > 1",
    "p1_runs": _RUNS + """SELECT transcript_id AS entity, value, first_seq, last_seq, n, started, ended,
                          ended - started AS duration FROM r""",
}
