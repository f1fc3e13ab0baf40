import random
from collections import defaultdict

import pytest

from logweave.operators.intervals import FOREVER, gaps_between, merge_intervals, union_length

SCHEMA = "who string, s long, e long, entity string"


def brute(rows):
    by = defaultdict(list)
    for who, s, e, _ in rows:
        if who is not None and s is not None and (e is None or e >= s):
            by[who].append((s, FOREVER if e is None else e))
    periods, gaps = set(), set()
    for who, spans in by.items():
        out = []
        for s, e in sorted(spans):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
                out[-1][2] += 1
            else:
                out.append([s, e, 1])
        periods |= {(who, *p) for p in out}
        gaps |= {(who, a[1], b[0]) for a, b in zip(out, out[1:])}
    return periods, gaps


@pytest.mark.parametrize("seed,span,shard", [(1, 40, 10), (2, 200, 7), (3, 1000, 10), (4, 60, 1), (5, 500, 100000), (6, 90, 13)])
def test_against_brute_force(spark, seed, span, shard):
    rnd = random.Random(seed)
    rows = []
    for _ in range(400):
        s = rnd.choice([None, *[rnd.randint(-span, span)] * 30])
        e = None if rnd.random() < 0.01 else (s or 0) + rnd.choice([-1, 0, 0, 1, 2, 3, rnd.randint(0, span // 4)])
        rows.append((rnd.choice(["a", "a", "b", "c", None, "d"]), s, e, "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    periods, gaps = brute(rows)
    merged = merge_intervals(df, "who", "s", "e", shard)
    assert sorted(map(tuple, merged.collect())) == sorted(periods)
    assert {tuple(r) for r in gaps_between(merged, shard).collect()} == gaps
    lengths = {r[0]: r[1] for r in union_length(df, "who", "s", "e", shard).collect()}
    assert lengths == {w: sum(e - s for x, s, e, _ in periods if x == w and e < FOREVER) for w in {p[0] for p in periods if p[2] < FOREVER}}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merge_intervals(df, "who", "s", "e", 10).count() == 0


def test_touching_across_a_shard_border_and_no_length(spark):
    rows = [("a", 0, 10, ""), ("a", 10, 12, ""), ("b", 10, 10, ""), ("b", 10, 10, ""), ("c", 5, 35, ""), ("c", 20, 21, "")]
    got = sorted(map(tuple, merge_intervals(spark.createDataFrame(rows, SCHEMA), "who", "s", "e", 10).collect()))
    assert got == [("a", 0, 12, 2), ("b", 10, 10, 2), ("c", 5, 35, 2)]
