"""Relations of neighbours in time, the plan made of them, and parents kept up to date."""

import random

import pytest

from memspark.operators import relations as r
from memspark.sources.scratch import written

PAIRS = [
    ("door is open", "door is not open", 9, "contradicts"),
    ("not a red car", "never a red car", 9, "newer"),
    ("a b c d e", "e d c b a", 9, "same"),
    ("blue bolt", "blue bolt of steel", 9, "refines"),
    ("Rome", "Paris", 1, "independent"),
    ("Rome", "Paris", 9, "newer"),
    ("", "", 1, "same"),
    ("", "x", 1, "refines"),
]


def test_relation(spark):
    df = spark.createDataFrame([(k, a, b, g) for k, (a, b, g, _) in enumerate([(a, b, float(g), w) for a, b, g, w in PAIRS])], "k int, a string, b string, g double")
    got = {x.k: x.rel for x in df.select("k", r.relation(df.a, df.b, df.g, 5.0).alias("rel")).collect()}
    assert [got[k] for k in range(len(PAIRS))] == [x[3] for x in PAIRS]


def test_plan_from_units_alone(spark):
    rows = [
        ("x", "a1", "lives in Rome", 1), ("x", "a2", "lives in Paris", 2), ("x", "a3", "lives in Paris", 3),
        ("y", "b1", "one two three four five", 1), ("y", "b2", "five four three two one", 2),
        ("z", "c1", "it is open", 1), ("z", "c2", "it is not open", 2),
        ("w", "d1", "alone", 1), ("v", "e1", "same text", 1), ("v", "e2", "same text", 2),
    ]
    df = spark.createDataFrame([(*x, False) for x in rows], "entity string, unit_id string, content string, t_ingest long, done boolean")
    got = sorted((p.entity, p.op, p.unit_id or "", p.content or "") for p in r.conflict_plan(df, ["entity"]).collect())
    assert got == sorted([
        ("x", "retire", "a2", ""), ("x", "retire", "a1", ""),
        ("y", "retire", "b1", ""), ("y", "retire", "b2", ""), ("y", "addition", "", "five four three two one"),
        ("z", "retire", "c2", ""), ("z", "replacement", "c2", "it is not open [against: it is open]"),
        ("v", "retire", "e1", ""),
    ])
    assert r.conflict_plan(df.limit(0), ["entity"]).count() == 0


LEAF = "user_id long, unit_id string, session string, at double, end double"


def leaves(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(3), f"u{k:03d}", rng.choice("aaab") if seed % 2 else None, float(rng.choice([rng.randrange(60), rng.randrange(400)])), 0.0) for k in range(n)]


def plain(rows, seconds):
    out = {}
    for u in {x[0] for x in rows}:
        run = begin = None
        first = True
        for _, unit, session, at, end in sorted((x for x in rows if x[0] == u), key=lambda x: (x[3], x[1])):
            if first or session != run or at - begin > seconds:
                run, begin, first = session, at, False
                out[u, unit] = []
                key = (u, unit)
            out[key].append(unit)
    return sorted((u, v) for (u, _), v in out.items())


@pytest.mark.parametrize("block", range(4))
def test_parents_after_each_run_are_those_of_a_rebuild(spark, block):
    """100 random orders of arrival, as users of one table: each user has leaves of its own, in runs of its own."""
    orders = []
    for order in range(25):
        seed = 100 * block + order
        for _, unit, session, at, end in [x for x in leaves(seed, 36) if x[0] == 0] + [x for x in leaves(seed + 7, 18) if x[0] == 1]:
            orders.append((order, f"{unit}-{len(orders)}", session, at, end))
    rng = random.Random(block)
    runs = [rng.randrange(3) for _ in orders]
    make = lambda k: spark.createDataFrame([x for x, run in zip(orders, runs, strict=True) if run == k], LEAF)
    held = written(r.assigned(make(0), "user_id", 40.0), "test-leaves")
    parents = written(r.parents_of(held, "user_id"), "test-parents")
    for k in (1, 2):
        parents, held = r.recomposed(parents, held, make(k), "user_id", 40.0)
        parents, held = written(parents, "test-parents"), written(held, "test-leaves")
        so_far = [x for x, run in zip(orders, runs, strict=True) if run <= k]
        got = sorted((p.user_id, list(p.child_ids)) for p in parents.collect())
        assert got == plain(so_far, 40.0)
        assert held.count() == len(so_far)


def test_untouched_parents_are_kept(spark):
    rows = [(1, f"u{k:02d}", "s", float(100 * k), 0.0) for k in range(20)]
    held = r.assigned(spark.createDataFrame(rows, LEAF), "user_id", 40.0)
    parents = r.parents_of(held, "user_id")
    marked = parents.withColumn("n", parents.n * 1000)  # a rebuilt parent counts anew
    after, _ = r.recomposed(marked, held, spark.createDataFrame([(1, "new", "s", 510.0, 0.0)], LEAF), "user_id", 40.0)
    got = {p.span_start: p.n for p in after.collect()}
    assert got[500.0] == 2 and sum(n < 1000 for n in got.values()) <= 2 and len(got) == 20
