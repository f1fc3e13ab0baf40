import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from logweave.functions.paths import canonical_text
from logweave.llm import runs
from logweave.llm.runs import collapse_runs

SCHEMA = "t string, seq long, v string, at double, entity string, value string"


def brute(rows):
    events = {}
    for t, seq, v, at, *_ in rows:
        if t is not None and seq is not None:
            old = events.get((t, seq))
            vs, ats = [x for x in ([v] + ([old[0]] if old else [])) if x is not None], [x for x in ([at] + ([old[1]] if old else [])) if x is not None]
            events[t, seq] = (min(vs, default=None), min(ats, default=None))
    out = []
    for t, group in groupby(sorted(events), key=lambda k: k[0]):
        run = []
        for k in [*group, None]:
            v = events[k][0] if k else None
            if run and (k is None or v is None or events[run[-1]][0] != v):
                ats = [events[x][1] for x in run if events[x][1] is not None]
                out.append((t, events[run[0]][0], run[0][1], run[-1][1], len(run), min(ats, default=None), max(ats, default=None)))
                run = []
            if k:
                run.append(k)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,shard,wider", [(1, 3, 4096), (2, 1, 3), (3, 4096, 4096), (4, 5, 2), (5, 2, 4)])
def test_against_brute_force(spark, monkeypatch, seed, shard, wider):
    monkeypatch.setattr(runs, "WIDER", wider)
    rnd = random.Random(seed)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(-20, 60)]), rnd.choice(["x", "x", "x", "y", None]),
             rnd.choice([None, rnd.random()]), "e", "w") for _ in range(200)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, SCHEMA)
    got = collapse_runs(df, "t", "seq", F.col("v"), "at", shard)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == brute(rows)


def test_a_run_over_many_shards_and_empty_input(spark):
    df = spark.range(0, 1000).select(F.lit("t").alias("t"), F.col("id").alias("seq"), F.when(F.col("id") != 500, "x").alias("v"),
                                     F.col("id").cast("double").alias("at"))
    got = sorted((r["first_seq"], r["last_seq"], r["n"], r["duration"]) for r in collapse_runs(df, "t", "seq", F.col("v"), "at", 7).collect())
    assert got == [(0, 499, 500, 499.0), (500, 500, 1, 0.0), (501, 999, 499, 498.0)]
    assert collapse_runs(spark.createDataFrame([], SCHEMA), "t", "seq", F.col("v"), "at").count() == 0


@pytest.mark.parametrize("a,b,same", [
    ("core/./notes_0.toml", "Core\\notes_0.toml ", True), ("./a/b", "a//b/", True), ("a/tmp/../b.py", "a/b.py", True),
    ("a/../../b", "b", False), ("/a/b", "a/b", False), ("sleep  3 &&\tcat ./out/x.log", "sleep 3 && cat out/x.log", True),
    ("a/b --limit 10", "a/b --limit 20", False), ("x in web/y", "x in web/z", False), ("E:/work/tmp/../n.md", "e:\\WORK\\n.md", True),
])
def test_spelling(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(canonical_text(F.col("a")).alias("a"), canonical_text(F.col("b")).alias("b")).collect()[0]
    assert (r["a"] == r["b"]) == same


def test_blank_values_are_no_value(spark):
    df = spark.createDataFrame([(" \n",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(canonical_text(F.col("a"))).collect()] == [None, None, None]
