"""The engine's verbs, and streams against the same work in one batch."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memspark.engine import Engine
from memspark.sources.scratch import folder
from memspark.streaming import jobs

UNIT = "unit_id string, content string, lifecycle string, tier string, tags array<string>, t_event long, t_ingest long, t_valid long, t_invalid long, t_message long, importance double, provenance array<string>, supersedes string, space string, user_id string"


@pytest.fixture
def engine(spark):
    def row(k, content, lifecycle="active", **x):
        base = dict(unit_id=k, content=content, lifecycle=lifecycle, tier="core", tags=["t"], t_event=None, t_ingest=int(k[1:]), t_valid=None, t_invalid=None, t_message=int(k[1:]), importance=None, provenance=[], supersedes=None, space="s", user_id="u")
        return tuple((base | x).values())

    rows = [
        row("u1", "red fox jumps", t_valid=10, t_invalid=20, lifecycle="superseded"),
        row("u2", "red fox sleeps", supersedes="u1", t_valid=20),
        row("u3", "blue whale", provenance=["u2"]),
        row("u4", "green frog and red fox", provenance=["u3"], tags=["x"]),
        row("u5", "red fox elsewhere", space="other"),
        row("u6", "red archive", lifecycle="archived"),
    ]
    return Engine(spark.createDataFrame(rows, UNIT))


def ids(df):
    return [r.unit_id for r in df.collect()]


def test_search(engine):
    scope = {"space": "s"}
    assert ids(engine.search("red fox", scope)) == ["u2", "u4"]
    assert ids(engine.search("red fox", scope, as_of=15)) == ["u1", "u4", "u6"] or set(ids(engine.search("red fox", scope, as_of=15))) == {"u1", "u4", "u6"}
    assert set(ids(engine.search("red", scope, include_archived=True))) == {"u2", "u4", "u6"}
    assert ids(engine.search("red fox", scope, filters={"tags": {"contains": "x"}}, channels=("keyword",), fuser="comb_max")) == ["u4"]
    with pytest.raises(ValueError):
        engine.search("x", scope, channels=())
    with pytest.raises(ValueError):
        engine.search("x", scope, channels=("vector",))


def test_verbs(engine, spark):
    assert ids(engine.get("u2", as_of=12)) == ["u1"] and ids(engine.get("u1", as_of=25)) == ["u2"] and ids(engine.get("u3")) == ["u3"]
    assert {r.node: r.hop for r in engine.trace("u4").collect()} == {"u4": 0, "u3": 1, "u2": 2}
    assert sorted(ids(engine.delete("purge", ids=["u2"]).units)) == ["u1", "u5", "u6"]
    state = {r.unit_id: r.lifecycle for r in engine.delete("archive", ids=["u1", "u2"]).units.collect()}
    assert (state["u1"], state["u2"]) == ("superseded", "archived")
    assert {r.unit_id: r.importance for r in engine.delete("downweight", ids=["u2"]).units.collect()}["u2"] == 0.5
    page = engine.list({"space": "s", "user_id": "u"}, 1, 2).collect()
    assert [r.unit_id for r in page] == ["u5", "u4"][1:] + ["u3"] and page[0].total == 5
    patch = spark.createDataFrame([("u3", "working")], "unit_id string, tier string")
    assert {r.unit_id: r.tier for r in engine.update(patch).units.collect()}["u3"] == "working"
    with pytest.raises(Exception, match="Conflict"):
        engine.add(engine.units.limit(1)).units.collect()
    assert {tuple(sorted((r.a, r.b))) for r in engine.evolve("associate", least=2).select("a", "b").collect()} == {("u2", "u4")}
    assert set(ids(engine.candidates("recall", query="whale", scope={"space": "s"}))) == {"u3"}
    assert len(ids(engine.candidates("fan_out", cap=1))) == 2
    with pytest.raises(ValueError):
        engine.evolve("unknown")


def test_long_chains_are_followed_to_their_end(spark):
    """36 units, each derived from and superseding the one before: purge, trace and versions know no depth."""
    n = 36
    rows = [(f"u{k}", "x", "active", "core", [], None, k, k, k + 1, k, None, [f"u{k - 1}"] if k else [], f"u{k - 1}" if k else None, "s", "u") for k in range(n)] + [("v", "x", "active", "core", [], None, 1, 1, None, 1, None, [], None, "s", "u")]
    e = Engine(spark.createDataFrame(rows, UNIT).coalesce(1))
    assert ids(e.delete("purge", ids=["u0"]).units) == ["v"]
    assert e.trace(f"u{n - 1}").count() == n and e.trace(f"u{n - 1}", 5).count() == 6
    assert ids(e.get("u0", as_of=n - 1)) == [f"u{n - 1}"]


def test_streamed_spans(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(u, "s" if i % 17 else "t", start + timedelta(minutes=13 * i * (u + 1)), i) for u in range(3) for i in range(100)]
    schema = "user_id long, session string, ts timestamp, unit_id long"
    df = spark.createDataFrame(rows, schema).repartition(1)
    df.write.parquet(str(tmp_path / "in"))
    out = folder(spark, "test-spans")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.drained(jobs.time_spans(stream, 7200, 600), out, folder(spark, "test-check"))
    want = defaultdict(list)
    for u in range(3):
        first = session = None
        for _, s, ts, _ in (r for r in rows if r[0] == u):
            if first is None or s != session or (ts - first).total_seconds() > 7200:
                first = ts
                want[u].append([first, ts, 0])
            session = s
            want[u][-1][1] = ts
            want[u][-1][2] += 1
    got = defaultdict(list)
    for r in spark.read.schema(jobs.SPAN).parquet(out).collect():
        got[r.user_id].append((r.start, r.end, r.n))
    for u in range(3):
        closed = [(a.timestamp(), b.timestamp(), n) for a, b, n in want[u]]
        assert sorted(got[u])[: len(closed) - 1] == closed[:-1] or sorted(got[u]) == closed


def test_ingest_once_and_restart(spark, tmp_path):
    schema = "payload_id string, ts timestamp"
    at = datetime(2024, 1, 1)
    spark.createDataFrame([("a", at), ("a", at), ("b", at)], schema).write.parquet(str(tmp_path / "in"))
    out, check = folder(spark, "test-ingest"), folder(spark, "test-check")
    stream = lambda: jobs.ingested(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    jobs.drained(stream(), out, check)
    spark.createDataFrame([("b", at), ("c", at)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.drained(stream(), out, check)
    assert sorted(r.payload_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    seen = []
    jobs.each_batch(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), folder(spark, "test-check"), lambda df, k: seen.append((k, df.count())))
    assert sum(n for _, n in seen) == 5


def test_recorded(spark):
    df = spark.createDataFrame([("r", 1, "f", "x"), ("r", 2, "f", "y"), ("s", 3, "f", "x"), ("s", 4, "g", "y")], "request_id string, seq int, fingerprint string, body string")
    assert {(r.request_id, r.body, r.conflict) for r in jobs.recorded(df).collect()} == {("r", "x", False), ("s", "x", True)}
    marks = df.where(F.col("request_id") == "r")
    assert {r.request_id for r in jobs.unmarked(df, marks, "request_id").collect()} == {"s"}


def plain_settled(rows, seconds, settle, past):
    """Spans of (user, session, at, unit) rows below the slice ``past``, one after the other."""
    out, size = [], jobs.SLICE
    for u in {r[0] for r in rows}:
        start = last = session = None
        n = 0
        for _, own, at, _ in sorted((r for r in rows if r[0] == u and r[2] // size < past), key=lambda r: (r[2], r[3])):
            if n and (at - last >= settle or own != session or at - start > seconds):
                out.append((u, start, last, n, "settled" if at - last >= settle else "next"))
                n = 0
            start, last, session, n = start if n else at, at, own, n + 1
        if n and last + settle <= past * size:
            out.append((u, start, last, n, "settled"))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 4])
def test_settled_spans_do_not_depend_on_batches(spark, tmp_path, files, monkeypatch):
    rng = random.Random(files)
    base = 1_704_067_200
    # user 0 is a hot one: more rows in a slice than a part of it holds
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.choice("aab"), base + rng.choice([rng.uniform(0, 9000), rng.uniform(0, 40_000)]), k) for k in range(3000)]
    rows += [(7, "z", base + 60_000.0, 9001)]
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 2500))  # out of order, but within the watermark
    schema = "user_id long, session string, at double, unit_id long"
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).drop("at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    fields = "user_id long, session string, unit_id long, ts timestamp"
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = folder(spark, "test-settled")
    jobs.drained(jobs.settled_spans(stream, 1800, 300), out, folder(spark, "test-check"))
    got = sorted((r.user_id, round(r.start, 4), round(r.end, 4), r.n, r.closed_by) for r in spark.read.schema(jobs.SETTLED).parquet(out).collect())
    exact = [(u, s, int(at * 1_000_000) / 1e6, k) for u, s, at, k in rows]
    want = plain_settled(exact, 1800, 300, (int((base + 60_000) * 1000) - 3_600_000) // 1000 // jobs.SLICE)
    assert got == [(u, round(a, 4), round(b, 4), n, why) for u, a, b, n, why in want] and len(got) > 50


def test_settled_spans_keep_one_timer_for_a_user(spark, tmp_path):
    """Rows of a user that lie far apart share a value and a timer; they once had one of each for every slice."""
    rows = [(u, "a", 1_704_067_200 + 7200 * k + u, 1000 * u + k) for u in range(5) for k in range(40)]
    spark.createDataFrame(rows, "user_id long, session string, at long, unit_id long").withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, session string, unit_id long, ts timestamp").parquet(str(tmp_path / "in"))
    out, check = folder(spark, "test-timers"), folder(spark, "test-check")
    q = jobs.settled_spans(stream, 86_400, 3600).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    timers = [int(o.customMetrics["numRegisteredTimers"]) for p in q.recentProgress for o in p.stateOperators]
    assert timers[0] == 5 and sum(timers) <= 10
    # the watermark has passed all but each user's last two rows, and for user 0 the settling of the one before the last
    assert spark.read.schema(jobs.SETTLED).parquet(out).count() == 5 * 38 + 1
