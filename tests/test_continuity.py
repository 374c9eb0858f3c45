"""Quarantine and release, step by step, against the state from nothing."""

import random

import pytest

from memspark.operators import continuity as c


def graph(seed):
    rng = random.Random(seed)
    return [(f"u{k:02d}", rng.choice(["s0", "s1", "s2", "s3", None]), [f"u{rng.randrange(60):02d}" for _ in range(rng.choice([0, 0, 1, 1, 2]))]) for k in range(60)]


def plain(rows, sources):
    out = {u for u, s, _ in rows if s in sources}
    while True:
        more = {u for u, _, p in rows if u not in out and out.intersection(p)}
        if not more:
            return sorted(out)
        out |= more


@pytest.mark.parametrize("seed", range(3))
def test_every_step_is_the_state_from_nothing(spark, seed):
    rows = graph(seed)  # with cycles
    units = spark.createDataFrame(rows, "unit_id string, source string, provenance array<string>")
    keys = lambda *ks: spark.createDataFrame([(k, "why") for k in ks], "source_key string, reason string")
    ids = lambda state: sorted(r.unit_id for r in state.collect())
    one = c.blocked(units, keys("s0"))
    assert ids(one) == plain(rows, {"s0"})
    two = c.quarantine(one, units, keys("s1", "s2"))
    assert ids(two) == plain(rows, {"s0", "s1", "s2"})
    back = c.release(two, units, keys("s0"), keys("s1", "s2"))
    assert ids(back) == plain(rows, {"s1", "s2"})
    # release restores the former state
    again = c.release(c.quarantine(one, units, keys("s3")), units, keys("s3"), keys("s0"))
    assert ids(again) == ids(one)
    assert ids(c.release(one, units, keys("s0"), keys())) == []


def test_a_quarantine_needs_a_reason(spark):
    units = spark.createDataFrame(graph(0), "unit_id string, source string, provenance array<string>")
    with pytest.raises(ValueError, match="reason"):
        c.blocked(units, spark.createDataFrame([("s0", " ")], "source_key string, reason string"))


def test_relations_and_tasks(spark):
    units = spark.createDataFrame([("a", "s0", []), ("b", "s1", ["a"]), ("c", "s1", [])], "unit_id string, source string, provenance array<string>")
    state = c.blocked(units, spark.createDataFrame([("s0", "x")], "source_key string, reason string"))
    rel = spark.createDataFrame([("r1", "c", "c", ["b"], "confirmed"), ("r2", "c", "c", None, "proposed"), ("r3", "a", "c", [], "confirmed")], "relation_id string, source string, target string, evidence array<string>, status string")
    assert sorted(map(tuple, c.relation_states(rel, state).collect())) == [("r1", "unavailable"), ("r2", "proposed"), ("r3", "unavailable")]
    tasks = spark.createDataFrame([("t1", "open", [("a", True), ("c", True)]), ("t2", "open", [("b", False)]), ("t3", "open", [("c", True)]), ("t4", "closed", [("a", True)]), ("t5", "open", []), ("t6", "open", [("gone", True)])], "task_id string, state string, background array<struct<ref:string,required:boolean>>")
    assert sorted(map(tuple, c.task_states(tasks, units, state).collect())) == [("t1", "blocked", 1), ("t2", "partial", 1), ("t3", "ready", 0), ("t4", "closed", 0), ("t5", "ready", 0), ("t6", "blocked", 1)]
