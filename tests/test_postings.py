"""The full-text index against scans of all texts, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from memspark.engine import Engine
from memspark.operators import postings, recall
from memspark.sources import tables

WORDS = ["alpha", "beta", "rare", "中", "alpha", "none"]


def rows(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["alpha"] * 20 + ["beta"] * 5 + ["中"] * 3 + [f"w{k}" for k in range(60)]
    out = []
    for k in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 60]))] + ["RARE"] * (rng.random() < 0.02) * rng.randint(1, 3)
        out.append((f"u{k:05d}", " ".join(text), f"s{k % 3}", rng.choice(["active", "active", "archived"]), k))
    return out + [("null", None, "s0", "active", 0), ("u00001", out[1][1], "s1", "active", 1)]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(rows(3000), "unit_id string, content string, space string, lifecycle string, at long").repartition(6)


@pytest.fixture(scope="module")
def index(units):
    held, span = postings.HELD, postings.SPAN_BITS
    postings.HELD, postings.SPAN_BITS = 200, 5  # ranges of 32 places, blocks cut short
    yield postings.build(units, ("space",))
    postings.HELD, postings.SPAN_BITS = held, span


def hits(df):
    return sorted((r.unit_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("words", [WORDS, ["rare"], ["none"], [], ["w1", "w2", "w3"]])
def test_all_hits_are_those_of_a_scan(units, index, words):
    own = units.withColumn("content", F.coalesce("content", F.lit("")))
    assert hits(index.bm25(words)) == hits(recall.bm25(own, words))
    assert hits(index.keyword(words)) == hits(recall.keyword(own, words))


@pytest.mark.parametrize("channel", ["bm25", "keyword"])
@pytest.mark.parametrize(("words", "k"), [(WORDS, 10), (["rare"], 5), (["rare"], 500), (["alpha"], 50), (["none"], 3), (["beta", "beta", "w7"], 1)])
def test_the_best_hits_are_those_of_a_scan(units, index, channel, words, k):
    units = units.withColumn("content", F.coalesce("content", F.lit("")))
    scan = recall.bm25(units, words) if channel == "bm25" else recall.keyword(units, words)
    want = [(r.unit_id, r.score) for r in scan.withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), "unit_id").limit(k).select("unit_id", "score").collect()]
    got, _ = index.top(words, k, channel)
    assert [(r.unit_id, pytest.approx(r.score, abs=1e-11)) for r in got.collect()] == want


def test_most_ranges_are_skipped(index):
    every = index.bounds(["alpha", "rare"], "bm25").count()
    _, read = index.top(["alpha", "rare"], 3)
    assert every > 80 and read < every / 2


def test_a_search_reads_its_terms_only(index):
    plan = lambda df: df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = plan(index.counts(["rare"], [3, 4]))
    assert "PartitionFilters: [isnotnull(bucket" in blocks and "bucket#" in blocks and "In(range, [3,4])" in blocks and "EqualTo(term,rare)" in blocks
    heads = plan(index.bounds(["rare", "beta"], "bm25"))
    assert "places" not in heads and "sky_tf" in heads
    assert "EqualTo(place,5)" in plan(index.contents([5])) or "In(place, [5])" in plan(index.contents([5]))
    pool = plan(index.pool_counts(["rare"], index.texts().where("space = 's1'")))
    assert "content" not in pool.split("ReadSchema", 1)[1]


def test_dictionary(units, index):
    got = {r.term: (r.df, r.tf) for r in index.terms().collect()}
    want = {r.term: (r.df, r.tf) for r in recall.postings(units).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).collect()}
    # recall.postings() takes rows of one unit_id together, the index counts rows
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] for k in want)


@pytest.mark.parametrize("channels", [("keyword", "bm25"), ("bm25",), ("keyword",)])
def test_engine_with_and_without_an_index(units, index, channels):
    own = units.where("unit_id <> 'u00001'").withColumns({c: F.lit(None).cast("long") for c in ("t_valid", "t_invalid", "t_event", "t_ingest", "t_message")})
    plain = Engine(own, scope_dims=("space",))
    fast = Engine(own, scope_dims=("space",), index=postings.build(own, ("space",)))
    ask = lambda e: [(r.unit_id, round(r.score, 9), r.text) for r in e.search("alpha rare beta", {"space": "s1"}, 12, {"at": {"gt": 100}}, channels=channels).collect()]
    assert ask(fast) == ask(plain) and len(ask(fast)) == 12


def test_an_empty_index(spark):
    none = postings.build(spark.createDataFrame([], "unit_id string, content string"))
    assert none.top(["a"], 3)[0].collect() == [] and none.bm25(["a"]).collect() == [] and none.keyword(["a"]).collect() == []


def test_sky():
    rng = random.Random(2)
    for _ in range(300):
        pairs = [(rng.randint(1, 9), rng.randint(1, 40)) for _ in range(rng.randint(1, 30))]
        want = sorted({p for p in pairs if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in pairs)})
        assert sorted(postings.sky(pairs)) == want


def test_tasks_and_shares_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """What a task sorts is bounded: twice the bytes are twice the tasks, and a bucket's blocks more files."""
    rows = [(f"u{k:05}", "s", " ".join(f"w{(k * 7 + j) % 50}" for j in range(20))) for k in range(3000)]
    own = spark.createDataFrame(rows, "unit_id string, space string, content string").repartition(4)
    size = postings.text_bytes(own)
    monkeypatch.setattr(postings, "SHARE", size // 128)
    index = postings.build(own, ("space",), str(tmp_path / "index"))
    assert size == sum(len(r[2]) for r in rows) and postings.shares(spark, size) >= 128
    held = [r.n for r in index.texts().groupBy(F.input_file_name()).agg(F.count("*").alias("n")).select("n").collect()]
    assert len(held) > 64 and max(held) < 3000 // 32
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "index" / "blocks").glob("bucket=*")]
    assert max(files) > 1
    assert index.terms(["w3"]).select("df").first()[0] == sum("w3" in r[2].split() for r in rows)


def test_texts_meet_labels_unsorted(spark):
    plan = tables.engine_units(spark, "/root/testdata/sf0.001", 4)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_few_labels_meet_texts_where_they_lie(spark, monkeypatch):
    """The index build's texts are moved once, into their order; beyond the bound they meet labels as before, with the same rows."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = tables.engine_units(spark, "/root/testdata/sf0.001", 4, few=True)
    assert "BroadcastHashJoin" in plan(few) and "hashpartitioning" not in plan(few)
    monkeypatch.setattr(tables, "FEW_LABELS", 3)
    many = tables.engine_units(spark, "/root/testdata/sf0.001", 4, few=True)
    assert "ShuffledHashJoin" in plan(many) and "BroadcastHashJoin" not in plan(many)
    assert few.exceptAll(many).count() == many.exceptAll(few).count() == 0


def test_blocks_of_a_range_come_in_the_order_of_terms(spark, monkeypatch):
    """So that the sort after the shuffle only merges runs; heads and postings are those of a plain count."""
    monkeypatch.setattr(postings, "SPAN_BITS", 5)
    rng = random.Random(7)
    texts = [(p, " ".join(rng.choice(["b", "aa", "zz9", "中", "c", "x"]) for _ in range(rng.randint(0, 30)))) for p in range(100)]
    rows = spark.createDataFrame([(p, len(x.split()), x or None) for p, x in texts], "place long, dl int, low string").coalesce(1).sortWithinPartitions("place")
    got = postings.blocks_of(rows).collect()
    assert [(b.range, b.term) for b in got] == sorted((b.range, b.term) for b in got)
    want = {}
    for p, x in texts:
        for w in set(x.split()):
            want.setdefault((p >> 5, w), []).append((p, x.split().count(w), len(x.split())))
    assert {(b.range, b.term): list(zip(b.places, b.tfs, b.dls, strict=True)) for b in got} == want
    for b in got:
        assert b.n == len(b.places) and b.tf_sum == sum(b.tfs)
        assert list(zip(b.sky_tf, b.sky_dl, strict=True)) == [(tf, dl) for dl, tf in sorted((d, t) for t, d in set(zip(b.tfs, b.dls, strict=True)) if not any(q != (t, d) and q[0] >= t and q[1] <= d for q in zip(b.tfs, b.dls, strict=True)))]
