import random

import pytest

from logweave.llm.mixing import largest_true_mix, mix_sources, water_fill

SIZED = "doc_id long, source string, tokens long, repeats string"
TARGETS = "source string, weight double, max_repeats int, tokens string"


def test_water_fill():
    assert water_fill({"a": 1, "b": 1}, {"a": 10, "b": 100}, 50) == {"a": 10, "b": 40}
    assert water_fill({"a": 1, "b": 3}, {"a": 100, "b": 100}, 40) == {"a": 10, "b": 30}
    assert water_fill({"a": 1, "b": 1}, {"a": 10, "b": 20}, 500) == {"a": 10, "b": 20}
    assert water_fill({"a": 1, "b": None}, {"a": 10, "b": 20}, 5) == {"a": 5, "b": 0}
    assert largest_true_mix({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}) == 20
    assert largest_true_mix({}, {}) == 0


@pytest.mark.parametrize("total", [None, 3000.0, 1e9])
def test_shares_caps_and_determinism(spark, total):
    rnd = random.Random(1)
    docs = [(i, rnd.choice(["big", " BIG ", "big", "small", "mid", None, "other"]), rnd.randint(0, 40), "x") for i in range(900)]
    sized = spark.createDataFrame(docs, SIZED)
    targets = spark.createDataFrame([("big", 0.5, 1, ""), ("small", 0.3, 3, ""), ("mid", 0.2, 2, ""), ("none", 0.0, 5, "")], TARGETS)
    mix, report = mix_sources(sized, targets, total, seed=3)
    rows, rep = mix.collect(), {r["source"]: r for r in report.collect()}
    cap = {"big": 1, "small": 3, "mid": 2}
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert all(1 <= r["repeats"] <= cap[r["source"]] for r in rows)
    for s in cap:
        assert rep[s]["actual_tokens"] == sum(r["tokens"] * r["repeats"] for r in rows if r["source"] == s)
        assert abs(rep[s]["actual_tokens"] - rep[s]["target_tokens"]) <= 40
    if total is None:
        assert abs(rep["small"]["actual_share"] - 0.3) < 0.02
    if total == 1e9:
        assert all(r["repeats"] == cap[r["source"]] for r in rows)
    again = mix_sources(sized.orderBy("tokens"), targets, total, seed=3)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_empty(spark):
    mix, report = mix_sources(spark.createDataFrame([], SIZED), spark.createDataFrame([("a", 1.0, 1, "")], TARGETS))
    assert mix.count() == 0 and report.collect()[0]["actual_tokens"] == 0


def test_excess_is_shared_out_over_whole_tables(spark):
    import __spark_entry__ as entry

    rows = [r for r in entry.queries()["p9_shares_filled"](spark, "/root/testdata/sf0.001").collect() if r["available"]]
    total, weights = sum(r["target_tokens"] for r in rows), sum(r["weight"] for r in rows)
    cap = {r["source"]: r["available"] * r["max_repeats"] for r in rows}
    clamped = [r for r in rows if abs(r["target_tokens"] - cap[r["source"]]) < 0.01]
    taking = [r for r in rows if r["target_tokens"] < cap[r["source"]] - 1]
    assert clamped and taking and len(clamped) + len(taking) == len(rows)
    assert all(r["target_tokens"] > total * r["weight"] / weights for r in taking)
    assert len({round(r["target_tokens"] / r["weight"]) for r in taking}) == 1


def test_border_ranges_are_split_until_they_are_small(spark, monkeypatch):
    from logweave.llm import mixing

    rnd = random.Random(5)
    sized = spark.createDataFrame([(i, rnd.choice("aab"), rnd.randint(1, 30), "x") for i in range(6000)], SIZED)
    targets = spark.createDataFrame([("a", 0.7, 2, ""), ("b", 0.3, 2, "")], TARGETS)
    once = sorted(map(tuple, mix_sources(sized, targets, 70_000.0)[0].collect()))
    for ordered, digit in ((0, 12), (2, 4), (10_000, 60)):
        monkeypatch.setattr(mixing, "ORDERED", ordered)
        monkeypatch.setattr(mixing, "DIGIT", digit)
        assert sorted(map(tuple, mix_sources(sized, targets, 70_000.0)[0].collect())) == once


def test_repeated_rows_are_one_document(spark):
    sized = spark.createDataFrame([(1, "a", 10, "x"), (1, "A ", 10, "y"), (1, "a", 7, "x"), (2, "a", 10, None), (None, "a", 9, None)], SIZED)
    mix, report = mix_sources(sized, spark.createDataFrame([("a", 1.0, 2, "")], TARGETS), 1e6)
    assert sorted(map(tuple, mix.collect())) == [(1, "a", 10, 2), (2, "a", 10, 2)] and report.collect()[0]["most_repeats"] == 2
