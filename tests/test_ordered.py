"""Running values over ranges against a walk through the rows."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    out = [("hot", i, r.randint(0, 5), r.choice([None, None, "x", "y", "z"])) for i in range(400)]
    out += [(r.choice(["a", "b", "c", None]), 1000 + i, r.randint(-3, 3), r.choice([None, "p", "q"])) for i in range(150)]
    out += [(f"one{i}", None if i == 3 else i, 1, None) for i in range(20)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("range_rows", [7, 60, 10**6])
@pytest.mark.parametrize("group", [["g"], []])
def test_carried_equals_a_walk(spark, rows, range_rows, group):
    df = spark.createDataFrame(rows, "g string, at long, v long, mark string").withColumn("v2", F.col("v") * 2)
    order = ["at"] if group else ["at", "g"]
    got = ordered.carried(df, group, order, sums={"total": F.col("v"), "n": F.lit(1)}, lasts={"last": F.col("mark")}, before={"prior": F.col("mark")}, changes={"turns": F.col("mark"), "values": F.struct("v", "mark")}, range_rows=range_rows)
    assert got.columns == ["g", "at", "v", "mark", "v2", "total", "n", "last", "prior", "turns", "values"]
    want, state = [], {}
    for g, at, v, mark in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[0] is not None, x[0] or "")):
        key = g if group else 0
        total, n, last, turns, values, old = state.get(key, (0, 0, None, 0, 0, ()))
        prior, total, n, last = last, total + v, n + 1, mark if mark is not None else last
        turns, values = turns + (old[1:] != (mark,)), values + (old != (v, mark))
        state[key] = total, n, last, turns, values, (v, mark)
        want.append((g, at, v, mark, v * 2, total, n, last, prior, turns, values))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_window_holds_a_whole_group(spark, rows):
    df = spark.createDataFrame(rows, "g string, at long, v long, mark string")
    plan = ordered.carried(df, ["g"], ["at"], sums={"n": F.lit(1)})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range" in line.split("], [")[1] for line in windows)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, at long, v long")
    assert ordered.carried(df, ["g"], ["at"], sums={"n": F.col("v")}, lasts={"l": F.col("v")}).count() == 0


@pytest.mark.parametrize("ready", [False, True])
def test_whole_rows_are_stored_once_and_moved_once(spark, rows, ready, monkeypatch):
    """F16: what is carried along is not stored a second time, and no range is made of whole rows."""
    kept, stored = [], ordered.stored
    monkeypatch.setattr(ordered, "stored", lambda df, *a: kept.append(df.columns) or stored(df, *a))
    df = spark.createDataFrame(rows, "g string, at long, v long, mark string")
    got = ordered.carried(df, ["g"], ["at"], sums={"n": F.lit(1)}, range_rows=60, ready=ready)
    assert sum("mark" in columns for columns in kept) == (0 if ready else 1)
    assert "RepartitionByExpression" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_equal_place_share_a_range(spark):
    df = spark.createDataFrame([(f"g{i % 3}" if i % 3 else None, i // 40 or None) for i in range(600)], "g string, at long")
    got = ordered._ranged(df, ["g", "at"], 8).groupBy("g", "at").agg(F.count_distinct("_range").alias("n"), F.min("_range").alias("r")).orderBy("g", "at").collect()
    assert [r.n for r in got] == [1] * len(got)
    assert [r.r for r in got] == sorted(r.r for r in got) and len({r.r for r in got}) > 1
