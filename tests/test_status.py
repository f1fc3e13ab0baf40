"""States of agents and sessions on small cases; times are in microseconds, written as seconds."""

from pyspark.sql import functions as F

from logweave.operators import status
from logweave.plans.state_queries import rebuilds, typed_prompt

S = 1_000_000


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_session_live(spark):
    rows = [("recent", 100 * S, None, 700 * S), ("quiet", 100 * S, None, 701 * S), ("ended", 100 * S, 99 * S, 110 * S), ("resumed", 100 * S, 98 * S, 110 * S), ("never", None, None, 5)]
    got = status.session_live(frame(spark, rows, "k string, w long, e long, now long"), "w", "e", "now").collect()
    assert {r["k"]: r["live"] for r in got} == {"recent": True, "quiet": False, "ended": False, "resumed": True, "never": False}


def test_ends_and_stops(spark):
    events = frame(spark, [("a", "session_start", 1, "", {}), ("a", "session_end", 5, "", {"reason": "quit"}), ("b", "session_end", 5, "", {}), ("b", "session_start", 6, "", {}),
                           ("a", "agent_stop", 3 * S, "x", {}), ("a", "agent_start", 2 * S, "x", {}), ("a", "agent_stop", 3 * S, "y", {}), ("a", "agent_start", 4 * S, "z", {}),
                           ("a", "agent_stop", 3 * S, "z", {}), ("a", "agent_stop", 3 * S, None, {})], "k string, kind string, at long, agent_id string, detail map<string,string>")
    assert [tuple(r) for r in status.last_words(events, ["k"], "kind", "at").collect()] == [("a", 5, "quit")]
    activity = frame(spark, [("a", "x", 4 * S), ("a", "y", 4 * S + 1)], "k string, agent_id string, seen long")
    stops = status.agent_stops(events, activity, ["k"], "kind", "at")
    assert [tuple(r) for r in stops.collect()] == [("a", "x", 3 * S)]  # y went on more than a second later, z started again
    finals = frame(spark, [("a", "x", 1 * S, None, "running", False), ("a", "w", 1 * S, None, "running", True)], "k string, agent_id string, s long, e long, status string, mid_tool boolean")
    closed = {r["agent_id"]: (r["e"], r["status"]) for r in status.close_by_stop(finals, stops, ["k"]).collect()}
    assert closed == {"x": (3 * S, "completed"), "w": (None, "running")}
    late = frame(spark, [("a", "x", 4 * S, None, "running", False), ("a", "x", 3 * S, None, "running", True)], finals.schema)
    assert [r["status"] for r in status.close_by_stop(late, stops, ["k"]).orderBy("s").collect()] == ["failed", "running"]


def test_status_of(spark):
    rows = [
        ("unknown", None, None, None, None, None, True, None, 900, None), ("completed", 1, 2, "completed", True, 5, True, True, 900, True), ("failed", 1, None, "running", True, 5, False, True, 900, True),
        ("orphaned", 1, None, "running", None, 5, None, None, 900, True), ("waiting", 1, None, "running", None, 5, True, True, 900, True), ("stalled", 1, None, "running", None, 599, True, False, 900, True),
        ("running", 1, None, "running", True, 600, True, None, 900, True), ("stalled", 1, None, "running", None, None, True, None, 900, True), ("running", None, None, "running", None, None, True, None, 900, True),
    ]
    names = ["want", "s", "e", "status", "mid", "seen", "live", "waiting", "now", "known"]
    types = ["string", "long", "long", "string", "boolean", "long", "boolean", "boolean", "long", "boolean"]
    scaled = [tuple(x * S if t == "long" and x is not None else x for x, t in zip(r, types, strict=True)) for r in rows]
    df = frame(spark, scaled, ", ".join(map(" ".join, zip(names, types, strict=True))))
    word = status.status_of(*[F.col(c) for c in ("s", "e", "status", "mid", "seen", "live", "waiting", "now", "known")])
    assert [r["got"] for r in df.select("want", word.alias("got")).collect()] == [r[0] for r in rows]


ASKED = "k string, attention_id long, kind string, agent_id string, since long"


def test_pending_attention(spark):
    asked = frame(spark, [("s", 1, "permission", "a", 10 * S), ("s", 2, "permission", "a", 20 * S), ("s", 3, "input", "b", 30 * S), ("s", 4, "idle", "", 50 * S), ("s", 5, "error", None, 12 * S),
                          ("s", 6, "permission", "nobody", 5 * S), ("s", 7, "other", "a", 99 * S), ("s", 8, "input", "a", None)], ASKED)
    agents = frame(spark, [("s", "a", 21 * S), ("s", "b", 40 * S)], "k string, agent_id string, seen long")
    session = frame(spark, [("s", 40 * S)], "k string, seen long")
    pending = status.pending_attention(asked, ["k"], agents, session)
    assert {(r["kind"], r["agent_id"], r["attention_id"]) for r in pending.collect()} == {("permission", "a", 2), ("idle", None, 4), ("permission", "nobody", 6)}
    assert [r["attention_id"] for r in status.most_urgent(pending, ["k"]).collect()] == [2]


def test_waits(spark):
    asked = frame(spark, [("s", 1, "permission", "a", 10 * S), ("s", 2, "permission", "a", 12 * S), ("s", 3, "input", "a", 40 * S), ("s", 4, "idle", "a", 41 * S), ("s", 5, "input", "", 8 * S),
                          ("t", 6, "permission", "a", 5 * S), ("s", 7, "permission", "a", 19 * S + 500_000)], ASKED)
    agents = frame(spark, [("s", "a", 11 * S), ("s", "a", 20 * S), ("s", "a", 25 * S), ("s", "b", 9 * S + 1)], "k string, agent_id string, seen long")
    live = frame(spark, [("s", True, 100 * S), ("t", False, 100 * S)], "k string, live boolean, now long")
    got = status.wait_states(asked, ["k"], agents, agents.select("k", "seen"), live, "now")
    rows = {(r["k"], r["agent_id"], r["since"] / S): (r["state"], r["answered_at"], r["prompts"], r["waited"] / S) for r in got.collect()}
    assert rows == {
        ("s", "a", 10.0): ("answered", 20 * S, 3, 10.0),  # the entry at 11 is not later than a second; 19.5 s is before the answer
        ("s", "a", 40.0): ("open", None, 1, 60.0), ("s", "", 8.0): ("answered", 9 * S + 1, 1, 1.000001), ("t", "a", 5.0): ("unanswered", None, 1, 0.0),
    }


def test_assembly_takes_the_first_known_launch(spark):
    metas = frame(spark, [("s", "a", "u1", "own", "", "background"), ("s", "b", " ", None, None, None), ("s", "c", None, None, None, None), ("s", "d", None, None, None, None)],
                  "session_id string, agent_id string, tool_use_id string, description string, model string, launch_mode string")
    launches = frame(spark, [("s", u, f"asked {u}", "small", by, "do", 5) for u, by in (("u1", "a"), ("u2", "a"), ("u3", None))],
                     "session_id string, tool_use_id string, description string, model string, launcher_agent_id string, prompt string, launched_at long")
    results = frame(spark, [("s", "b", "u2", "inline", 4), ("s", "b", "u3", "inline", 9), ("s", "phantom", "quoted", "inline", 1), ("s", "new", "u3", "background", 7)],
                    "session_id string, agent_id string, tool_use_id string, launch_mode string, seq long")
    notes = frame(spark, [("s", "c", "", 1), ("s", "c", "u3", 2), ("s", "b", "u1", 1)], "session_id string, agent_id string, tool_use_id string, seq long")
    got = {r["agent_id"]: r for r in status.assemble_agents(metas, launches, results, notes).collect()}
    assert {a: r["tool_use_id"] for a, r in got.items()} == {"a": "u1", "b": "u2", "c": "u3", "d": None, "new": "u3"}
    assert (got["a"]["description"], got["a"]["model"], got["a"]["launch_mode"], got["a"]["parent_agent_id"]) == ("own", "small", "background", None)
    assert (got["b"]["description"], got["b"]["parent_agent_id"], got["d"]["description"], got["d"]["launch_mode"]) == ("asked u2", "a", "", "inline")


def test_rebuild_causes(spark):
    rows = [("a", 0.0, "m", 0, 0), ("b", 10.0, "m", 20_000, 10), ("c", 20.0, "n", 20_000, 0), ("d", 400.0, "n", 20_000, 0), ("e", 5000.0, "n", 20_000, 3999), ("f", 5001.0, "n", 20_000, 4000),
            ("g", 5002.0, "n", 9_999, 0), ("h", 5100.0, "m", 20_000, 0)]
    m = frame(spark, [("s", "t", *r) for r in rows], "session_id string, transcript_id string, mid string, at_s double, model string, cache_create long, cache_read long")
    squeezed = frame(spark, [("s", "t", 5002.0)], "session_id string, transcript_id string, compacted_at double")
    assert {r["mid"]: r["cause"] for r in rebuilds(m, squeezed).collect()} == {"b": "unknown", "c": "model", "d": "idle_short", "e": "idle_long", "h": "compaction"}
    assert {r["mid"]: r["cause"] for r in rebuilds(m).collect()}["h"] == "model"


def test_typed_prompts(spark):
    user = '"type": "user", "message": {"content": '
    rows = {
        "{" + user + '" fix \\n it "}}': "fix it", "{" + user + '"<task-notification>x"}}': None, "{" + user + '"<b>typed</b>"}}': "<b>typed</b>",
        "{" + user + '"<command-message>x</command-message><command-name>/plan</command-name><command-args>all of it</command-args>"}}': "/plan all of it",
        "{" + user + '[{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]}}': "one two", "{" + user + '[{"type": "tool_result"}, {"type": "text", "text": "x"}]}}': None,
        '{"isMeta": true, ' + user + '"x"}}': None, '{"isSidechain": true, ' + user + '"x"}}': None, '{"type": "assistant", "message": {"content": "x"}}': None, "{" + user + '"Caveat: x"}}': None,
    }
    df = frame(spark, [(x,) for x in rows], "j string").withColumn("v", F.parse_json("j"))
    assert [r[0] for r in df.select(typed_prompt()).collect()] == list(rows.values())
