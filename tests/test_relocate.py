"""Moves that stop after each step, writers that meet, and transactions that are seen whole or not at all."""

import pytest
from pyspark.sql import functions as F

from memspark.operators import relocate as r
from memspark.sources.manifest import Manifest
from memspark.sources.scratch import folder

SCHEMA = "unit_id string, content string, at long"


@pytest.fixture
def shards(spark):
    s = r.Shards(Manifest(spark, folder(spark, "test-shards")), SCHEMA)
    rows = [(f"u{k}", None if k == 3 else f"text {k}", k) for k in range(12)]
    s.load(spark.createDataFrame(rows, SCHEMA), F.when(F.col("at") % 2 == 0, "a").otherwise("b"))
    return s


def seen(s):
    rows = [tuple(x) for x in s.rows().select("unit_id", "content", "shard").collect()]
    assert len(rows) == 12 and len({x[0] for x in rows}) == 12  # every unit once, at every moment
    return {x[0]: x[1:] for x in rows}


@pytest.mark.parametrize("stop", range(1, 5))
def test_a_move_that_stops_after_any_step_goes_on(spark, shards, stop, monkeypatch):
    before = seen(shards)
    shards.begin(F.col("at") < 6, "c")
    for _ in range(stop - 1):
        shards.resume()
    # the next step does its work and dies before its commit
    monkeypatch.setattr(Manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        shards.resume()
    monkeypatch.undo()
    assert {k: v[0] for k, v in seen(shards).items()} == {k: v[0] for k, v in before.items()}
    again = r.Shards(Manifest(spark, shards.log.folder), SCHEMA)  # another process
    while again.resume():
        seen(again)
    after = seen(again)
    assert all(after[f"u{k}"] == (before[f"u{k}"][0], "c" if k < 6 else before[f"u{k}"][1]) for k in range(12))
    assert sorted(x.unit_id for x in again.shard("c").collect()) == sorted(f"u{k}" for k in range(6))
    assert again.shard("a").count() + again.shard("b").count() == 6 and again.resume() is None


@pytest.mark.parametrize("steps", [0, 1, 2])
def test_a_unit_that_changes_on_the_way_stays(spark, shards, steps):
    shards.begin(F.col("at") < 4, "c")
    for _ in range(steps):
        shards.resume()
    shards.update(spark.createDataFrame([("u1", "new text", 1)], SCHEMA))
    while shards.resume():
        pass
    after = seen(shards)
    assert after["u1"] == ("new text", "b") and after["u2"][1] == "c"
    assert "u1" not in {x.unit_id for x in shards.shard("c").collect()}


def test_one_of_two_writers_wins(spark, shards):
    one, two = shards.log.version(), shards.log.read()["tables"]
    assert shards.log.commit(one, two) and not shards.log.commit(one, two)
    shards.begin(F.col("at") < 2, "c")
    with pytest.raises(ValueError, match="under way"):
        shards.begin(F.col("at") < 2, "b")


def test_transactions_are_whole(spark):
    store = r.PrivacyStore(Manifest(spark, folder(spark, "test-privacy")), "0123456789abcdef")
    rows = lambda *x: spark.createDataFrame(x, "scope string, token string, value string, level int")
    snaps = lambda *x: spark.createDataFrame(x, "scope string, snapshot string, tokens array<string>")
    work = store.begin()
    store.stage_fragments(work, rows(("s", "t1", "secret one", 1), ("s", "t2", "secret two", 3), ("o", "t1", "other", 1)))
    store.stage_snapshots(work, snaps(("s", "day", ["t1", "t2"])))
    assert store.fragments().count() == 0  # staged is not seen
    late = store.begin()
    store.stage_fragments(late, rows(("s", "t9", "late", 1)))
    assert store.commit(work)
    assert not store.commit(late) and store.fragments().count() == 3  # of the one that came second nothing is
    assert sorted(map(tuple, store.opened("s", 3).collect())) == [("t1", "secret one"), ("t2", "secret two")]
    assert [tuple(x) for x in store.opened("s", 1).collect()] == [("t1", "secret one")]
    assert b"secret" not in b"".join(bytes(x.value) for x in store.fragments().collect())
    assert sorted(x.token for x in store.snapshot("s", "day").collect()) == ["t1", "t2"]
    first = store.log.version()
    with pytest.raises(ValueError, match="once"):
        store.stage_fragments(store.begin(), rows(("s", "t1", "again", 1)))
    more = store.begin()
    store.stage_fragments(more, rows(("s", "t3", "three", 1)))
    assert store.commit(more) and store.opened("s", 3, first).count() == 2 and store.opened("s", 3).count() == 3  # reads of a version
