import random

import pytest

from logweave.operators.hierarchy import hierarchy, with_paths

SCHEMA = "id string, parent string, v long, depth string"


def brute(links):
    out = {}
    for node in links:
        line, kind = [node], None
        while kind is None:
            up = links[line[-1]]
            if up is None:
                kind = "root"
            elif up not in links:
                kind = "orphan"
            elif up in line:
                kind = "cycle"
            else:
                line.append(up)
        out[node] = (kind, list(reversed(line)))
    return out


def check(spark, links):
    rows = [(n, p, 7, "x") for n, p in links.items()]
    tree = hierarchy(spark.createDataFrame(rows + rows[:3], SCHEMA), "id", "parent", buckets=3)
    got = {r["id"]: r for r in with_paths(tree).collect()}
    want = brute(links)
    assert set(got) == set(want)
    below = {n: 0 for n in links}
    for kind, line in want.values():
        if kind != "cycle":
            for n in line[:-1]:
                below[n] += 1
    for n, (kind, line) in want.items():
        r = got[n]
        assert r["kind"] == kind, n
        if kind == "cycle":
            assert r["depth"] is None and r["path"] is None and r["top"] is None
        else:
            assert (r["depth"], r["top"], r["path"], r["descendants"]) == (len(line), line[0], "/".join(line), below[n])
    sound = [n for n in links if want[n][0] != "cycle"]
    for a in sound[:25]:
        for d in sound[:25]:
            inside = got[a]["enter"] >= got[d]["enter"] and got[a]["leave"] <= got[d]["leave"] and got[a]["top"] == got[d]["top"]
            assert inside == (a in want[d][1])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i}" for i in range(150)]
    links = {n: rnd.choice([None, *ids[:20], *ids, "lost"]) for n in ids}
    check(spark, links)


def test_deep_chain_hot_parent_and_cycles(spark):
    links = {"c0": None, **{f"c{i}": f"c{i - 1}" for i in range(1, 70)}}
    links |= {f"h{i}": "c5" for i in range(60)}
    links |= {"x": "x", "y1": "y2", "y2": "y3", "y3": "y1", "t": "y2", "tt": "t", "o": "gone", "oo": "o"}
    check(spark, links)


def test_empty_and_null(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA), "id", "parent").count() == 0
    one = hierarchy(spark.createDataFrame([(None, "a", 1, "")], SCHEMA), "id", "parent")
    assert one.count() == 0
    rows = hierarchy(spark.createDataFrame([("a", None, 1, ""), ("a", None, 1, "")], SCHEMA), "id", "parent").collect()
    assert [(r["id"], r["kind"], r["depth"]) for r in rows] == [("a", "root", 1)]


def test_all_descendants(spark, tmp_path):
    from logweave.plans import core_problems as q

    # "a/b" holds the separator of paths; "x" hangs below an unknown id, "p" and "q" are a cycle, "r" hangs below it.
    links = {"a": None, "a/b": "a", "c": "a/b", "d": "a/b", "e": "c", "x": "gone", "y": "x", "p": "q", "q": "p", "r": "p"}
    rows = [(n, p, "s", None, None) for n, p in links.items()]
    spark.createDataFrame(rows, "agent_id string, parent_agent_id string, session_id string, tool_use_id string, spawn_depth int").write.parquet(f"{tmp_path}/agents.parquet")
    spark.createDataFrame([], "session_id string, tool_use_id string, launcher_agent_id string").write.parquet(f"{tmp_path}/launches.parquet")
    want = {(up, n, len(line) - 1 - i) for n, (kind, line) in brute(links).items() if kind != "cycle"
            for i, up in enumerate(line[:-1]) if up in links}
    got = [tuple(r) for r in q.p4_descendants(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    t = q.p4_tours(spark, str(tmp_path)).collect()
    inside = {(a["id"], b["id"]) for a in t for b in t if a["top"] == b["top"] and b["enter"] < a["enter"] and b["leave"] > a["leave"]}
    assert inside == {(a, b) for a, b, _ in want}
