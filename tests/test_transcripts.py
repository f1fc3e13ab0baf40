import json

import pytest
from pyspark.sql import functions as F

from logweave.operators import transcripts as S

def stamp(second):
    return f"2026-03-02T{11 + second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}Z"


def line(second, kind, **fields):
    return {"uuid": fields.pop("uuid", f"{kind}-{second}"), "type": kind, "timestamp": stamp(second), **fields}


def spoken(second, role, content, **fields):
    extra = {k: fields.pop(k) for k in ("id", "model", "usage") if k in fields}
    return line(second, role, message={"role": role, "content": content, **extra}, **fields)


def call(ident, tool, **given):
    return {"type": "tool_use", "id": ident, "name": tool, "input": given}


def answer(ident, content, failed=None):
    return {"type": "tool_result", "tool_use_id": ident, "content": content} | ({} if failed is None else {"is_error": failed})


NOTE = "<task-notification><task-id>beefcafe12</task-id><status>completed</status><result>index is built</result></task-notification>"


@pytest.fixture(scope="module")
def entries(spark):
    git = lambda **op: {"gitOperation": op}
    top = [
        spoken(5, "assistant", [call("far", "Agent", description="Index the corpus", prompt="Build an index", model="small")]),
        spoken(6, "user", [answer("far", [{"type": "text", "text": "Async agent launched"}, {"type": "text", "text": "agentId: beefcafe12"}])]),
        spoken(200, "user", NOTE), spoken(230, "user", NOTE, uuid="again"),
        spoken(300, "assistant", [call("near", "Task", description="Count rows", prompt="n"), {"type": "text", "text": "fine"}, 7]),
        spoken(340, "user", [answer("near", "41 rows", False)]),
        spoken(400, "assistant", [call("g1", "Bash", command="git commit -m 'Add index'"), call("g2", "Bash", command="git commit -q -m \"Quiet\" && git push")]),
        spoken(401, "user", [answer("g1", "[main d00d] Add index")], toolUseResult=git(commit={"sha": "d00d", "branch": "main", "kind": "committed"})),
        spoken(402, "user", [answer("g2", "")], toolUseResult=git(push={"branch": "dev"}, pr={"url": "https://github.com/o/r/pull/3", "number": 3, "action": "created"})),
        line(403, "pr-link", prUrl="https://github.com/o/r/pull/3", prNumber=3, prRepository="o/r"), line(404, "pr-link", prUrl="javascript:x", prNumber=4),
        line(410, "user", message={"role": "user", "content": "p"}, toolUseResult={"filePath": "src/index.py", "structuredPatch": [{"lines": ["+x", "+y", "-z", " same"]}]}),
        line(411, "user", message={"role": "user", "content": "q"}, toolUseResult={"filePath": "src/new.py", "type": "create", "content": "1\n2", "structuredPatch": []}),
        line(420, "attachment", attachment={"type": "instructions", "files": [{"path": "GUIDE.md", "type": "project", "content": "abcdef"}]}),
    ]
    below = [
        spoken(20, "assistant", [call("w", "Write", file_path="out/index.bin", content="...")], id="m1", model="big", usage={"input_tokens": 70, "output_tokens": 2}),
        spoken(21, "assistant", [{"type": "text", "text": "t"}], id="m1", model="<synthetic>", usage={"input_tokens": 70, "output_tokens": 30}),
        spoken(22, "user", [answer("w", "disk full", True)]),
        spoken(23, "assistant", [call("o", "Odd", zeta="", beta="secret=abcdefgh1", alpha="last"), call("b", "Bash", note="no command")],
               usage={"input_tokens": True, "output_tokens": 2.5}),
        spoken(450, "user", [answer("g1", "replayed")], toolUseResult=git(commit={"sha": "d00d", "branch": "fork"}), uuid="fork"),
        spoken(449, "assistant", [call("g1", "Bash", command="git commit -m 'Add index'")], uuid="forked"),
    ]
    below[-2:] = below[:-3:-1]
    rows = [("main", i, json.dumps(x)) for i, x in enumerate(top)] + [("sub", i, json.dumps(x)) for i, x in enumerate(below)]
    rows += [("main", 50, "{torn"), ("main", 51, "[1]"), ("main", 52, rows[0][2]), ("main", 53, None)]
    return S.entry_table(spark.createDataFrame(rows, "transcript_id string, seq long, line string"), "line").cache()


def test_entries_once_and_only_objects(entries):
    assert entries.count() == 20


def test_calls_and_results(entries):
    got = {(r["transcript_id"], r["tool_use_id"]): r for r in S.calls(S.blocks(entries)).collect()}
    assert (got["sub", "w"]["target"], got["sub", "w"]["ok"]) == ("out/index.bin", False)
    assert got["sub", "o"]["ok"] is None and got["sub", "o"]["target"] == "secret=<redacted:secret>" and got["sub", "b"]["target"] == "no command"
    assert got["main", "far"]["result"] == "Async agent launched\nagentId: beefcafe12" and got["main", "near"]["result"] == "41 rows"


def test_usage(entries):
    got = {r["message"]: r for r in S.usage_totals(entries).collect()}
    assert (got["m1"]["input"], got["m1"]["output"], got["m1"]["model"]) == (70, 30, "big")
    assert (got["line 3"]["input"], got["line 3"]["output"]) == (0, 0)


def test_launches_notifications_rounds(entries):
    made = S.launches(S.calls(S.blocks(entries)))
    assert {r["tool_use_id"] for r in made.collect()} == {"far", "near"}
    results = {r["tool_use_id"]: r for r in S.launch_results(made).collect()}
    assert results["far"]["agent_id"] == "beefcafe12" and results["far"]["launch_mode"] == "background"
    assert results["near"]["inline_result"] == "41 rows" and results["near"]["is_error"] is False
    assert [(r["agent_id"], r["status"], r["result"]) for r in S.notifications(entries).collect()] == [("beefcafe12", "completed", "index is built")]


def test_build_rounds(spark):
    made = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 2.0)], "agent_id string, launched_at double")
    results = spark.createDataFrame([("b", "inline", True, 9.0)], "agent_id string, launch_mode string, is_error boolean, at double")
    notes = spark.createDataFrame([("a", "Completed ", 10.0), ("a", "failed", 20.0)], "agent_id string, status string, at double")
    activity = spark.createDataFrame([("a", 25.0), ("c", 3.0), ("d", 4.0)], "agent_id string, last_activity_at double")
    got = sorted((tuple(r) for r in S.build_rounds(made, results, notes, activity).collect()), key=str)
    assert got == sorted([("a", 0.0, 10.0, "completed"), ("a", 10.0, 20.0, "failed"), ("a", 20.0, None, "running"), ("b", 1.0, 9.0, "failed"),
                          ("c", 2.0, None, "running"), ("d", None, None, "running")], key=str)


def test_changes_commits_context(entries, spark):
    got = {r["path"]: (r["added"], r["removed"], r["created"]) for r in S.file_changes(entries).collect()}
    assert got == {"src/index.py": (2, 1, False), "src/new.py": (2, 0, True)}
    ops = S.git_operations(entries, S.calls(S.blocks(entries)))
    made = {r["key"]: r for r in S.commits(ops).collect()}
    assert set(made) == {"d00d", "tool:g2"} and made["d00d"]["transcript_id"] == "main" and made["d00d"]["transcripts"] == 2
    assert (made["tool:g2"]["branch"], made["tool:g2"]["message"], made["tool:g2"]["kind"]) == ("dev", "Quiet", "committed")
    assert [(r["url"], r["number"], r["repo"], r["action"]) for r in S.pull_requests(entries, ops).collect()] == [("https://github.com/o/r/pull/3", 3, "o/r", "created")]
    assert {r["transcript_id"]: (r["pushes"], r["merges"]) for r in S.outcome_counts(ops).collect()} == {"main": (1, 0), "sub": (0, 0)}
    assert [(r["path"], r["type"], r["chars"]) for r in S.context_files(entries).collect()] == [("GUIDE.md", "project", 6)]
    m = lambda t: spark.createDataFrame([(t,)], "t string").select(S.commit_message(F.col("t"))).collect()[0][0]
    assert m('git add . && git commit -m "Fix it\\nmore"') == "Fix it" and m("git commit -m 'One'") == "One"
    assert m("git commit -F - <<'E'\n\nBody line\nmore\nE\n") == "Body line" and m("git status") is None


def test_handbacks(spark):
    says = "The report was delivered to you as a message from kit (its SubagentHandback call)."
    rounds = spark.createDataFrame([("a", 1, 10.0, says), ("a", 2, 20.0, "It was sent to you, see above."), ("a", 3, None, says), ("a", 4, 3.0, says), ("b", 1, 1.0, says + "x" * 400),
                                    ("c", 1, 5.0, says), ("a", 5, 30.0, None)], "agent_id string, round_no int, ended_at double, result string")
    messages = spark.createDataFrame([("a", 1, 9.0, "first"), ("a", 2, 15.0, "second"), ("a", 3, 16.0, "late"), ("a", 4, 99.0, ""), ("c", 1, None, "undated"), (None, 1, 1.0, "x")],
                                     "agent_id string, seq long, at double, message string")
    got = {(r["agent_id"], r["round_no"]): r["result"] for r in S.handbacks(rounds, messages).collect()}
    assert got == {("a", 1): "second", ("a", 2): "It was sent to you, see above.", ("a", 3): "late", ("a", 4): says, ("b", 1): says + "x" * 400, ("c", 1): "undated", ("a", 5): None}
