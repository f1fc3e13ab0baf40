import json

from logweave.operators.schema_drift import consistent_table, schema_changes

SCHEMA = "record_id long, project string, file_no int, line_no int, raw string, kind string"


def rows_of(files):
    out = []
    for project, no, lines in files:
        for i, x in enumerate(lines):
            out.append((len(out), project, no, i, x if isinstance(x, str) or x is None else json.dumps(x), "clash"))
    return out


def changes(spark, files):
    df = spark.createDataFrame(rows_of(files), SCHEMA)
    return {tuple(r) for r in schema_changes(df).collect()}


def test_added_removed_retyped_renamed(spark):
    base = {"type": "user", "uuid": "u", "toolUseResult": {"stdout": "some words of text here", "exitCode": 3}}
    files = [
        ("p", 1, [base, {**base, "attachment": {"path": "a/b.py", "lines": 3}}]),
        ("p", 3, [{"kind": "user", "uuid": "u", "toolUseResult": {"stdout": "other words of text too", "exitCode": "3"}},
                  {"kind": "assistant", "attachment": {"filePath": "c/d.py", "lines": 4, "names": ["x"]}}, "{torn", "[1]", None]),
        ("p", 4, [{"kind": "user", "toolUseResult": "a whole text", "attachment": {"filePath": "c/d.py", "lines": None, "names": ["x"]}}]),
        ("q", 1, [base]),
        ("q", 2, [{**base, "toolUseResult": None}]),
    ]
    assert changes(spark, files) == {
        ("p", 3, "kind", "renamed"), ("p", 3, "toolUseResult.exitCode", "retyped"), ("p", 3, "attachment.filePath", "renamed"),
        ("p", 3, "attachment.names", "added"), ("p", 4, "toolUseResult", "retyped"), ("p", 4, "attachment.lines", "removed"),
        ("q", 2, "toolUseResult", "removed"),
    }


def test_names_that_occur_together_are_no_rename(spark):
    files = [
        ("p", 1, [{"type": "a", "attachment": {"one": 5}}]),
        ("p", 2, [{"type": "a", "attachment": {"two": 6}}]),
        ("q", 1, [{"type": "a", "attachment": {"one": 5, "two": 6}}]),
    ]
    assert changes(spark, files) == {("p", 2, "attachment.one", "removed"), ("p", 2, "attachment.two", "added")}


def test_empty_and_only_bad_lines(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [("p", 1, ["{", None, "3"]), ("p", 2, [""]), (None, 3, [{"type": "x"}])]) == set()


def test_one_table(spark):
    files = [("p", 1, [{"type": "user", "toolUseResult": {"a": 1}}]), ("p", 2, [{"entryType": "user", "toolUseResult": "12"}, "{"])]
    rows = {r["record_id"]: r for r in consistent_table(spark.createDataFrame(rows_of(files), SCHEMA)).collect()}
    assert rows[0]["type"]["text"] == rows[1]["type"]["text"] == "user"
    assert rows[0]["toolUseResult"]["branch"] == "object" and rows[1]["toolUseResult"]["number"] == 12.0
    assert rows[2]["parsed"] is False and rows[2]["type"] is None


def test_inner_fields_in_one_table(spark):
    say = "some words of text here"
    files = [
        ("p", 1, [{"type": "u", "toolUseResult": {"stdout": say, "code": 3, "done": True, "more": {"a": [1]}}}]),
        ("p", 2, [{"type": "u", "toolUseResult": {"out": say, "code": "4", "done": None, "list": ["x"]}}]),
        ("p", 3, [{"type": "u", "toolUseResult": {"standardOutput": say, "code": "x"}}]),
        ("q", 1, [{"type": "u", "toolUseResult": {"stdout": say}, "attachment": {"out": 5}}, {"type": "u", "toolUseResult": say}, "{"]),
        (None, 1, [{"type": "u", "toolUseResult": {"stdout": say, "out": "both"}}]),
    ]
    rows = {(r["project"], r["file_no"], r["line_no"]): r for r in consistent_table(spark.createDataFrame(rows_of(files), SCHEMA)).collect()}
    inner = {k: r["toolUseResult_fields"] for k, r in rows.items()}
    assert [(inner[k]["stdout"]["name"], inner[k]["stdout"]["branch"], inner[k]["stdout"]["text"]) for k in (("p", 1, 0), ("p", 2, 0), ("p", 3, 0), ("q", 1, 0))] == [
        (n, "string", say) for n in ("stdout", "out", "standardOutput", "stdout")]
    assert [(inner["p", n, 0]["code"]["branch"], inner["p", n, 0]["code"]["number"]) for n in (1, 2, 3)] == [("number", 3.0), ("string", 4.0), ("string", None)]
    assert inner["p", 1, 0]["done"]["flag"] is True and inner["p", 1, 0]["more"]["json"] == '{"a":[1]}'
    assert set(inner["p", 2, 0]) == {"stdout", "code", "list"} and inner["p", 2, 0]["list"]["branch"] == "array"
    assert inner["q", 1, 1] is None and inner["q", 1, 2] is None and set(inner[None, 1, 0]) == {"stdout", "out"}
    assert set(rows["q", 1, 0]["attachment_fields"]) == {"out"}


def test_names_with_quotes_and_objects_whose_names_are_data(spark):
    many = {f"k{i}": i for i in range(3000)}
    files = [
        ("p", 1, [{"type": "user", "attachment": {"all": many, 'a"b': 1}}]),
        ("p", 2, [{"kind": "user", "attachment": {"every": many, 'a"b': "x"}}]),
        ("p", 3, [{'k"ind': "user", "attachment": {"every": {"x": 1}}}]),
    ]
    assert changes(spark, files) == {
        ("p", 2, "kind", "renamed"), ("p", 2, "attachment.every", "renamed"), ("p", 2, 'attachment.a"b', "retyped"),
        ("p", 3, 'k"ind', "renamed"), ("p", 3, 'attachment.a"b', "removed"),
    }
    rows = {r["file_no"]: r for r in consistent_table(spark.createDataFrame(rows_of(files), SCHEMA)).collect()}
    assert [rows[n]["type"]["text"] for n in (1, 2, 3)] == ["user"] * 3
    assert rows[1]["attachment_fields"]['a"b']["number"] == 1.0
