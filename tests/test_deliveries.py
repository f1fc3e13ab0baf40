import random
from collections import defaultdict
from datetime import datetime, timedelta

from logweave.operators.deliveries import deduplicate_deliveries, surplus_deliveries

SCHEMA = "delivery_id long, received_at timestamp, session_id string, operation string, message_id string, __k0 string, usage long"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        if r[4] is not None and r[4].strip() and r[0] is not None:
            groups[r[2], r[3], r[4].strip()].append((r[1] is None, r[1] or datetime.min, r[0]))
    return {x[2] for g in groups.values() for x in sorted(g)[1:]}


def make(n, rnd):
    at = datetime(2026, 1, 1)
    return [
        (i, rnd.choice([None, *[at + timedelta(seconds=rnd.randint(0, 5))] * 9]), rnd.choice("ab") if rnd.random() > 0.05 else None,
         rnd.choice([None, "enqueue"]), rnd.choice([None, "", "  ", "m1", " m1", "m1\n", "m2", "hot", "hot", "hot"]), "x", rnd.randint(0, 9))
        for i in range(n)
    ]


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = make(300, rnd)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0] for r in surplus_deliveries(df, ["session_id", "operation"], "message_id").select("delivery_id").collect()}
    assert got == brute(rows)
    kept = deduplicate_deliveries(df, ["session_id", "operation"], "message_id")
    assert kept.columns == df.columns
    assert {r[0] for r in kept.collect()} == {r[0] for r in rows} - got


def test_empty_and_null_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert surplus_deliveries(df, ["session_id"], "message_id").count() == 0
    rows = [(None,) * 7, (1, None, None, None, "m", None, None), (2, None, None, None, "m ", None, None), (None, None, None, None, "m", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r[0] for r in surplus_deliveries(df, ["session_id"], "message_id").select("delivery_id").collect()] == [2]


def test_plan_aggregates_before_the_shuffle(spark):
    df = spark.createDataFrame(make(20, random.Random(1)), SCHEMA)
    plan = surplus_deliveries(df, ["session_id"], "message_id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "CartesianProduct" not in plan
