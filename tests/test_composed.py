"""Composed retrieval, ingest, evolution and blocked joins: cases that the queries' tables do not have."""

import math
import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import evolve, govern, ingest, link, recall, retrieve


def test_channels_fail_apart_or_all_together(spark):
    good = spark.createDataFrame([("a", 1.0)], "unit_id string, score double")

    def broken():
        raise OSError("gone")

    hits, errors = retrieve.recalled({"x": lambda: good, "y": broken})
    assert [tuple(r) for r in hits.collect()] == [("a", 1.0, "x")] and errors == [("y", "OSError", "gone")]
    with pytest.raises(retrieve.AllChannelsFailed):
        retrieve.recalled({"y": broken})
    with pytest.raises(ValueError):
        retrieve.recalled({"x": lambda: good}, [])


def test_graph_recall_counts_a_seed_only_from_another(spark):
    nodes = spark.createDataFrame([(x, c) for x, c in [("a", "red"), ("b", ""), ("c", ""), ("d", "red fox"), ("e", ""), ("z", "red")]], "unit_id string, content string")
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("d", "c"), ("c", "e"), ("z", "z")], "a string, b string")
    found = lambda depth: sorted(r.unit_id for r in retrieve.graph_recall(nodes, edges, ["red", ""], depth, 10).collect())
    assert found(1) == ["b", "c"] and found(2) == ["a", "b", "c", "d", "e"]
    assert retrieve.graph_recall(nodes, edges, [], 2, 10).count() == 0


def test_actions_on_retired_units_are_void(spark):
    by = ["entity"]
    units = spark.createDataFrame([("e", "1", "x", 1, False), ("e", "2", "x", 2, False), ("e", "3", "y", 3, False), ("e", "4", "z", 4, False), ("done", "5", "p", 1, True), ("done", "6", "q", 1, True), ("one", "7", "p", 1, False)], "entity string, unit_id string, content string, t_ingest long, done boolean")
    rows = [
        ("e", 0, "merge", None, "xy", ["2", "3"]),
        ("e", 1, "update", "3", "new", None),
        ("e", 2, "archive", "1", None, None),
        ("e", 3, "merge", None, "one", ["4"]),
        ("e", 4, "create", None, "fact", ["4", "nobody"]),
        ("e", 5, "create", None, " ", ["4"]),
        ("e", 6, "DANCE", "4", "x", None),
        ("e", 7, "update", "4", "z2", None),
        ("done", 0, "archive", "5", None, None),
        ("one", 0, "archive", "7", None, None),
    ]
    actions = spark.createDataFrame(rows, "entity string, seq int, type string, unit_id string, content string, unit_ids array<string>")
    got = sorted((r.op, r.unit_id or "", r.content or "", tuple(r.sources)) for r in evolve.consolidated(units, actions, by).collect())
    # unit 1 repeats 2 and retires by itself, so that archiving it names no member
    assert got == sorted([("retire", "1", "", ()), ("retire", "2", "", ()), ("retire", "3", "", ()), ("addition", "", "xy", ("2", "3")), ("addition", "", "fact", ("4",)), ("retire", "4", "", ()), ("replacement", "4", "z2", ("4",))])


def test_merges_follow_chains(spark):
    near = spark.createDataFrame([("c", "b", 0.9), ("b", "a", 0.8), ("d", "c", 0.7), ("d", "a", 0.6), ("e", "z", 0.99), ("f", "a", 0.3)], "property string, other string, score double")
    assert {r.property: r.into for r in evolve.merge_plan(near, 0.5).collect()} == {"b": "a", "c": "a", "d": "a"}


@pytest.mark.parametrize(
    "wrong",
    [
        [{"name": "p", "owner": "user", "space_template": "u/{user}"}],
        [{"name": "p", "owner": "user", "space_template": "u", "fallback": True}],
        [{"name": "p", "owner": "user", "space_template": "u/{user}", "fallback": True, "cross_user": True, "members": ["x"]}],
        [{"name": "p", "owner": "user", "space_template": "u/{user}", "fallback": True}, {"name": "q", "owner": "user", "space_template": "u/{user}"}],
        [{"name": "p", "owner": "user", "space_template": "u/{user}", "fallback": True}, {"name": "q", "record_only": True}],
        [{"name": "p", "owner": "user", "space_template": "u/{user}", "fallback": True}, {"name": "q", "owner": "team", "space_template": "t/{team}", "cross_user": True}],
    ],
)
def test_route_tables_are_checked(wrong):
    with pytest.raises(ValueError):
        evolve.checked_routes(wrong)


def test_relative_times(spark):
    cases = {
        "see you next week on Monday or today": ("weekday of week", "2024-03-18"),
        "last Friday": ("weekday before", "2024-03-08"),
        "上个星期天": ("weekday of week", "2024-03-10"),
        "上个月31号": ("day of month", None),
        "下个月 30日": ("day of month", "2024-04-30"),
        "上周末": ("weekend before", "2024-03"),
        "just now": ("this day", "2024-03-15"),
        "next week": ("week after", "2024-03"),
        "去年": ("year before", "2023"),
        "nothing": (None, None),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string").withColumn("m", evolve.relative_mention(F.col("q")))
    out = df.select("q", "m.kind", evolve.relative_anchor(F.col("m"), F.lit("2024-03-15").cast("date")).alias("a")).collect()
    assert {r.q: (r.kind, r.a) for r in out} == cases


def test_hints_off(spark):
    meta = F.create_map(*map(F.lit, ("hierarchy_kind", "time", "hierarchy_role", "event")))
    row = spark.range(1).select(ingest.hierarchy_ref(meta, F.lit(None).cast("timestamp"), False).alias("h"), ingest.hierarchy_ref(meta, F.lit(None).cast("timestamp")).alias("g")).first()
    assert row.h.asDict() == {"kind": None, "role": None, "span_start": None, "span_end": None, "error": None} and row.g.error == "not a leaf role"


def test_shards(spark):
    rows = spark.range(100).withColumn("v", F.col("id") % 3)
    path = ingest.write_sharded(rows, F.col("v"), "test-shards")
    assert ingest.read_shards(spark, path, ["1"]).count() == 33 and ingest.read_shards(spark, path).count() == 100 and ingest.read_shards(spark, path, []).count() == 0
    plan = ingest.read_shards(spark, path, ["1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_blocks_of_a_join_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(link, "CHUNK", 7)
    monkeypatch.setattr(link, "HOT_BLOCKS", 1000)
    r = random.Random(5)
    rows = [(k, "hot" if k % 4 else "cold", [r.gauss(0, 1) for _ in range(4)]) for k in range(60)]
    v = spark.createDataFrame(rows, "unit_id long, block string, vector array<double>").repartition(4)
    norm = lambda a: sum(x * x for x in a) ** 0.5
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b)
    near = {(i, j): cos(a, b) for i, p, a in rows for j, q, b in rows if p == q and i != j}
    got = {(x.a, x.b): x.score for x in link.similar_pairs(v, 0.6, ["block"]).collect()}
    want = {k: s for k, s in near.items() if k[0] < k[1] and s >= 0.6}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    found = link.duplicates_of(v.withColumnRenamed("unit_id", "query_id"), v, ["block"], 3, 0.1).collect()
    best = {i: sorted(((-round(s, 9), j) for (a, j), s in near.items() if a == i and s >= 0.1))[:3] for i, *_ in rows}
    assert {(x.query_id, x.unit_id) for x in found} == {(i, j) for i, js in best.items() for _, j in js}


def test_fuzzy_names_lose_none(spark):
    r = random.Random(6)
    names = ["".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(120)] + ["Müller  Anna", "müller anne", "mullr anna"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string").withColumn("block", F.lit(1))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    key = [" ".join(n.lower().split()) for n in names]
    for most in (0, 1, 2):
        got = {x.a: x.b for x in link.fuzzy_names(df, ["block"], most).collect()}
        want = {}
        for a in range(len(names)):
            near = [b for b in range(a) if edits(key[a], key[b]) <= most]
            if near:
                want[a] = near[0]
        assert got == want


def test_personal_lists_and_neighbours(spark):
    u = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "unit_id string, n int")
    yes, no = F.lit(True), F.lit(False)
    assert sorted(r.unit_id for r in govern.personal(u, [(F.col("n") < 3, yes), (F.col("n") > 1, no)]).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="no scope"):
        govern.personal(u, [(F.col("n") < 3, no)]).collect()
    r = random.Random(7)
    rows = [(str(k), [r.gauss(0, 1) for _ in range(3)]) for k in range(200)] + [("10x", [1.0, 0.0, 0.0]), ("9x", [2.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "unit_id string, vector array<double>").repartition(5)
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, vector array<double>")
    got = [(x.unit_id, x.rank) for x in recall.knn(v, q, 5).orderBy("rank").collect()]
    cos = {k: a[0] / sum(x * x for x in a) ** 0.5 for k, a in rows}
    assert got == [(k, i) for i, k in enumerate(sorted(cos, key=lambda k: (-round(cos[k], 12), k))[:5])] and got[0][0] == "10x"


@pytest.mark.parametrize("most", [0, 1, 2])
def test_fuzzy_names_with_many_short_ones(spark, most):
    rng = random.Random(most)
    names = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 8]))) for _ in range(250)]
    rows = [(k, f"b{k % 2}", x) for k, x in enumerate(names)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row = following(row, c, b, i)
        return row[-1]

    def following(row, c, b, i):
        out = [i]
        for j, d in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (c != d)))
        return out

    want = sorted((k, min(j for j, g, y in rows if g == b and j < k and distance(x, y) <= most)) for k, b, x in rows if any(g == b and j < k and distance(x, y) <= most for j, g, y in rows))
    got = link.fuzzy_names(spark.createDataFrame(rows, "id long, block string, name string"), ["block"], most)
    assert sorted((r.a, r.b) for r in got.collect()) == want


@pytest.mark.parametrize("hot", [0, 1, 100])
def test_similar_pairs_over_parts(spark, monkeypatch, hot):
    monkeypatch.setattr(link, "CHUNK", 16)
    monkeypatch.setattr(link, "HOT_BLOCKS", hot)
    rng = random.Random(hot)
    rows = [(f"u{k:03d}", "b" if k % 5 else f"s{k % 3}", [rng.gauss(0, 1) for _ in range(3)]) for k in range(150)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = sorted((a, b) for a, g, v in rows for b, h, w in rows if a < b and g == h and cos(v, w) >= 0.9)
    got = link.similar_pairs(spark.createDataFrame(rows, "unit_id string, block string, vector array<double>"), 0.9, ["block"])
    assert sorted((r.a, r.b) for r in got.collect()) == want


def test_a_channel_that_fails_in_a_task(spark):
    good = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "unit_id string, score double")
    broken = lambda: good.select("unit_id", F.when(F.col("score") > 1, F.raise_error(F.lit("gone"))).cast("double").alias("score"))
    hits, errors = retrieve.recalled({"y": broken, "x": lambda: good})
    assert sorted(r.unit_id for r in hits.collect()) == ["a", "b"] and [e[0] for e in errors] == ["y"] and "gone" in errors[0][2]

    def fault():
        raise TypeError("a fault of the program")

    with pytest.raises(TypeError):
        retrieve.recalled({"x": lambda: good, "z": fault})


def test_the_stages_of_a_run_are_its_own(spark):
    good = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "unit_id string, score double")
    p = retrieve.Pipeline({"x": lambda: good}, good, F.lit(True))
    p.run()
    first = [r.stage for r in p.trajectory().orderBy("at").collect()]
    p.run()
    assert [r.stage for r in p.trajectory().orderBy("at").collect()] == first


def test_all_relative_times_of_a_text_are_judged(spark):
    # said on Friday 2024-03-15
    cases = [
        ("met yesterday", "2024-03-14", True), ("met yesterday", "2024-03-15", False), ("met yesterday", "2024-03", False),
        ("last friday", "2024-03", True), ("last friday", "2024-03-08", True), ("last friday", "2024-02", False),
        ("last month", "2024-02", True), ("last month on 2024-02-07", "2024-02-07", True), ("last month", "2024-02-07", False),
        ("last week", "2024-03-05", False), ("last week, 2024-03-05", "2024-03-05", True), ("last week, 2024-03-25", "2024-03-25", False), ("last week", "2024-03", True),
        ("last weekend", "2024-03-09", True), ("last weekend", "2024-03-08", False), ("last weekend, 2024-03-10", "2024-03-09", False), ("next weekend", "2024-03", True),
        ("last year", "2023", True), ("last year", "2024", False), ("yesterday or last year", "2024-03-14", False), ("tomorrow and 明天", "2024-03-16", True), ("no time", "2001", True), ("上个月31号", "2024-02", False),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, text string, given string")
    got = {r.k: r.fits for r in df.select("k", evolve.relative_times_fit(F.col("given"), F.col("text"), F.lit("2024-03-15").cast("date")).alias("fits")).collect()}
    assert [(a, b, got[k]) for k, (a, b, _) in enumerate(cases)] == cases
    two = spark.range(1).select(evolve.relative_mentions(F.lit("last week on Wednesday, 上个月5号 and Last Week")).alias("m")).first().m
    assert [(x.kind, x.phrase) for x in two] == [("weekday of week", "last week on Wednesday"), ("day of month", "上个月5号"), ("week before", "Last Week")]
