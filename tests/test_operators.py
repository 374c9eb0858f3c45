"""Operators against plain Python on small made-up inputs."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from memspark.functions import chunker
from memspark.functions import scopes as s
from memspark.functions import text as t
from memspark.operators import evaluate, fuse, govern, lifecycle, link, plugins, recall, temporal
from memspark.sources import connectors, model

RNG = random.Random(7)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def corpus(n=60):
    words = [f"w{k}" for k in range(25)] + ["the", "a"]
    return [(f"u{i:02}", " ".join(RNG.choice(words) for _ in range(RNG.randint(0, 40)))) for i in range(n)]


def test_bm25_on_random_pools(spark):
    for _ in range(4):
        docs = corpus()
        q = [RNG.choice(["w1", "w2", "the", "nowhere"]) for _ in range(3)]
        toks = {u: c.split() for u, c in docs}
        n, avg = len(docs), sum(map(len, toks.values())) / len(docs) or 1
        want = {}
        for u, ws in toks.items():
            total = 0.0
            for w in q:
                tf, df = ws.count(w), sum(w in x for x in toks.values())
                if tf:
                    total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
            if total > 0:
                want[u] = total
        got = {r.unit_id: r.score for r in recall.bm25(spark.createDataFrame(docs, "unit_id string, content string"), q).collect()}
        assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in want)


def hits(n=80):
    return [(RNG.choice("abc"), f"u{RNG.randrange(30)}", round(RNG.random(), 3)) for _ in range(n)]


def test_fusion(spark):
    rows = hits()
    best = {}
    for c, u, x in rows:
        best[c, u] = max(x, best.get((c, u), 0))
    by = defaultdict(list)
    for (c, u), x in best.items():
        by[c].append((-x, u))
    rrf, comb = Counter(), Counter()
    for c, xs in by.items():
        for rank, (x, u) in enumerate(sorted(xs)):
            rrf[u] += 1 / (61 + rank)
            comb[u] = max(comb[u], x / min(xs)[0])
    df = spark.createDataFrame(rows, "channel string, unit_id string, score double")
    got = {r.unit_id: r.score for r in fuse.rrf(df).collect()}
    assert got.keys() == rrf.keys() and all(abs(got[u] - rrf[u]) < 1e-12 for u in rrf)
    got = {r.unit_id: r.score for r in fuse.comb_max(df).collect()}
    assert all(abs(got[u] - comb[u]) < 1e-12 for u in comb)


def test_threshold(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.6), ("c", 0.2), ("d", 0.0), ("e", -1.0)], "unit_id string, score double")
    ids = lambda x: sorted(r.unit_id for r in x.collect())
    assert ids(fuse.threshold(df, 0.5)) == ["a", "b"]
    assert ids(fuse.threshold(df, 0.5, 0.7)) == ["a"]
    assert ids(fuse.threshold(df, 0.9, min_results=3)) == ["a", "b", "c"]
    assert ids(fuse.threshold(df.limit(0), 0.5, min_results=2)) == []


def test_bands_and_round_robin_and_disclosure(spark):
    rows = [("q", "a", 1.0, 0.1), ("q", "b", 0.97, 0.9), ("q", "c", 0.94, 0.5), ("q", "d", 0.5, 0.2)]
    got = fuse.banded(spark.createDataFrame(rows, "query_id string, unit_id string, score double, secondary double"), 0.05).orderBy("position").collect()
    assert [(r.unit_id, r.band) for r in got] == [("b", 0), ("a", 0), ("c", 1), ("d", 2)]
    rr = [("q", "a1", 0, 0, "x"), ("q", "a2", 0, 1, "y"), ("q", "b1", 1, 0, "x"), ("q", "b2", 1, 1, "z"), ("q", "b3", 1, 2, "w")]
    got = fuse.round_robin(spark.createDataFrame(rr, "query_id string, unit_id string, priority int, rank int, digest string"), 2, 10).orderBy("position").collect()
    assert [r.unit_id for r in got] == ["a1", "b2", "a2", "b3"]
    ad = [("q", "a", 0, "x" * 40, "x" * 8, "x"), ("q", "b", 1, "x" * 40, "x" * 8, "x"), ("q", "c", 2, "x" * 400, "x" * 80, "x" * 40), ("q", "d", 3, "x", "x", "x")]
    got = fuse.adaptive_disclosure(spark.createDataFrame(ad, "query_id string, unit_id string, rank int, l2 string, l1 string, l0 string"), 13).collect()
    assert [(r.unit_id, r.level) for r in got] == [("a", "l2"), ("b", "l1")]


@pytest.mark.parametrize("block", [2048, 3])
def test_knn(spark, block):
    vs = [(f"v{i}", [RNG.gauss(0, 1) for _ in range(8)]) for i in range(50)]
    df = spark.createDataFrame(vs, "unit_id string, vector array<double>").repartition(5)
    qs = spark.createDataFrame(vs[:7], "query_id string, vector array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    got = defaultdict(list)
    for r in recall.knn(df, qs, 5, block).collect():
        got[r.query_id].append((r.rank, r.unit_id))
    for q, v in vs[:7]:
        want = sorted(((-round(cos(v, w), 12), u) for u, w in vs if cos(v, w) > 0))[:5]
        assert [u for _, u in sorted(got[q])] == [u for _, u in want]
    assert recall.knn(df, qs.limit(0), 5).count() == 0


def test_graph(spark):
    edges = [(f"n{RNG.randrange(20)}", f"n{RNG.randrange(20)}") for _ in range(25)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    hop, front = {"n1": 0}, {"n1"}
    for d in (1, 2, 3):
        front = {y for x in front for y in near[x]} - hop.keys()
        hop |= dict.fromkeys(front, d)
    got = {r.node: r.hop for r in recall.bfs(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([("n1",)], "node string"), 3).collect()}
    assert got == hop


def test_token_pairs(spark):
    docs = corpus(40)
    sets = {u: set(c.split()) for u, c in docs}
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 6}
    got = recall.token_pairs(spark.createDataFrame(docs, "unit_id string, content string"), t.tokens(F.col("content")), 6)
    assert {(r.a, r.b): r.common for r in got.collect()} == want


def test_span_fold(spark):
    rows = [(u, i, RNG.choice(["s", None]), float(RNG.randrange(500))) for u in range(3) for i in range(60)]
    want = {}
    for u in range(3):
        start = session = None
        for _, i, s_, at in sorted((r for r in rows if r[0] == u), key=lambda r: (r[3], r[1])):
            if start is None or s_ != session or at - start > 40:
                start = at
            session = s_
            want[u, i] = start
    got = temporal.span_groups(spark.createDataFrame(rows, "user_id long, unit_id long, session string, at double"), "user_id", 40)
    assert {(r.user_id, r.unit_id): r.start for r in got.collect()} == want


def test_tree_faults(spark):
    rows = [("a", None, ["b", "c"], 0, 10), ("b", "a", ["d"], 1, 5), ("c", "x", [], 0, 3), ("d", "b", [], 2, 6), ("e", "e", [], 0, 1), ("f", None, ["d"], 0, 9)]
    got = {tuple(r) for r in temporal.tree_faults(spark.createDataFrame(rows, "unit_id string, parent_id string, child_ids array<string>, span_start int, span_end int")).collect()}
    assert got == {("e", "self"), ("c", "not_listed"), ("e", "not_listed"), ("c", "not_claimed"), ("d", "not_claimed"), ("d", "many_parents"), ("d", "outside")}


def test_expansion_stops_at_cycles(spark):
    kids = spark.createDataFrame([("a", "b", 0), ("b", "a", 0), ("b", "c", 1)], "unit_id string, child_id string, pos long")
    got = temporal.expanded(spark.createDataFrame([("a",)], "unit_id string"), kids, 5, 10).orderBy("depth", "pos").collect()
    assert [r.unit_id for r in got] == ["a", "b", "c"]


def test_store(spark):
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, value string")
    assert connectors.inserted(store, spark.createDataFrame([("c", "3")], store.schema), ["k"]).count() == 3
    with pytest.raises(Exception, match="Conflict"):
        connectors.inserted(store, spark.createDataFrame([("a", "3")], store.schema), ["k"]).collect()
    with pytest.raises(Exception, match="NotFound"):
        connectors.strict_read(store, spark.createDataFrame([("z",)], "k string"), ["k"]).collect()
    with pytest.raises(Exception, match="NotFound"):
        connectors.updated(store, spark.createDataFrame([("z", "9")], store.schema), ["k"]).collect()
    changes = spark.createDataFrame([("a", "1", "x"), ("b", "9", "y"), ("c", None, "n"), ("a", "1", None)][:3], "k string, expected string, replacement string")
    new, done = connectors.compare_and_swap(store, changes, ["k"])
    assert {tuple(r) for r in new.collect()} == {("a", "x"), ("b", "2"), ("c", "n")} and {r.k: r.applied for r in done.collect()} == {"a": True, "b": False, "c": True}
    assert [r.k for r in connectors.missing_keys(store, spark.createDataFrame([("a",), ("q",)], "k string"), ["k"]).collect()] == ["q"]


def test_sealed_values_open_only_in_their_place(spark):
    df = spark.createDataFrame([("v", "0123456789abcdef", "s/k")], "v string, key string, aad string").withColumn("c", connectors.encrypted(F.col("v"), F.col("key"), F.col("aad")))
    df = df.cache()
    assert df.select(connectors.decrypted(F.col("c"), F.col("key"), F.col("aad")).cast("string")).first()[0] == "v"
    with pytest.raises(Exception):
        df.select(connectors.decrypted(F.col("c"), F.col("key"), F.lit("other"))).collect()


def test_round_trips(spark, tmp_path):
    u = model.as_units(spark.createDataFrame([("a", ["x"], "active")], "id string, tags array<string>, lifecycle string"))
    assert u.schema == model.UNIT
    connectors.write_table(u, str(tmp_path / "t"), ["lifecycle"])
    assert connectors.read_table(spark, str(tmp_path / "t")).where("lifecycle = 'active'").count() == 1
    assert connectors.files(spark, str(tmp_path / "t")).where("path LIKE '%.parquet'").select("length").first().length > 0
    flat = spark.createDataFrame([("o", "s", 1)], "org string, space string, n int")
    connectors.export_space(flat, "o", "s", str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().n == 1
    bad = connectors.decode(spark.createDataFrame([("{\"k\": 1}",), ("{broken",), (None,)], "v string"), "v", "k int").select("decoded.k").collect()
    assert [r.k for r in bad] == [1]


def test_states(spark):
    with pytest.raises(Exception, match="no transition"):
        spark.range(1).select(lifecycle.transitioned(F.lit("forgotten"), "active")).collect()
    old = spark.createDataFrame([("a", 1, {"x": "1", "y": "2"})], "k string, n int, m map<string,string>")
    new = lifecycle.overlay(old, spark.createDataFrame([("a", None, {"y": "3"})], old.schema), "k").first()
    assert new.n == 1 and new.m == {"x": "1", "y": "3"}


def test_scopes(spark):
    lit = lambda **d: {k: F.lit(v) for k, v in d.items()}
    covers = lambda a, b: one(spark, s.scope_covers(lit(**a), lit(**b)))
    inner = {"org": "o", "space": "s", "user": "u"}
    assert covers({"org": "o", "space": "", "user": ""}, inner) and covers(inner, inner)
    assert not covers({"org": "", "space": "s", "user": ""}, inner) and not covers({"org": "p", "space": "", "user": ""}, inner)
    with pytest.raises(ValueError):
        s.selected()
    assert s.shard_labels(None, ("a",)) is None and s.shard_labels("a, b", ("a", "b")) == ["a", "b"]
    for bad in ("", "c"):
        with pytest.raises(ValueError):
            s.shard_labels(bad, ("a", "b"))
    with pytest.raises(Exception, match="no shard rule"):
        spark.range(1).select(s.route([(F.lit(False), "x")], None)).collect()


def test_text(spark):
    assert one(spark, t.sanitised(F.lit("Sender: bob\n[2024 UTC] hi\x07   you ```a   b``` c   d"))) == "hi you ```a   b``` c d"
    assert one(spark, t.luhn(F.lit("4111111111111111"))) and not one(spark, t.luhn(F.lit("4111111111111112")))
    assert one(spark, t.best_snippet(F.lit("aaa one bbb two one ccc"), ["one", "two"], 12)) == "one bbb two "
    assert one(spark, t.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert one(spark, t.normalised(F.array(F.lit(float("nan")), F.lit(1.0)))) == [0.0, 0.0]
    assert one(spark, t.fts_terms(F.lit('say "hi" ...'))) == ['"say"', '"""hi"""']
    h = 0
    for c in "token9":
        h = (h * 31 + ord(c)) % 2**32
    assert one(spark, t.bucket(F.lit("token9"))) == h % 64
    v = one(spark, t.embedded(F.lit("a b a")))
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-12
    assert one(spark, t.rendered("{a}/{b}", {"a": F.lit("x"), "b": F.lit(None).cast("string")})) == "x/"


def test_chunks():
    for _ in range(60):
        text = "".join(RNG.choice(["word ", "sentence. ", "\n", "\n\n", "xyz", "，"]) for _ in range(RNG.randint(0, 300)))
        cuts = chunker.split(text, 100, 10, 5)
        assert bool(cuts) == bool(text.strip())
        covered = set()
        for x, a, b in cuts:
            # blank pieces alone are left out of a chunk
            assert "".join(x.split()) == "".join(text[a:b].split()) and len(x) <= 230
            covered |= set(range(a, b))
        assert all(c.isspace() for k, c in enumerate(text) if k not in covered)
        assert all(c < b <= d for (_, _, b), (_, c, d) in zip(cuts, cuts[1:], strict=False))
    # paragraphs first; a piece that fits is cut no further, the next chunk begins with the last piece
    assert chunker.split("one. two.\n\nthree. four.\n\nfive", 15, 0, 1) == [("one. two.\n\n", 0, 11), ("one. two.\n\nthree. four.\n\n", 0, 25), ("three. four.\n\nfive", 11, 29)]
    # of a level only the first separator that is there counts: the full stop, not the question mark
    assert [x for x, *_ in chunker.split("aaaa.bbbb?cccc.dddd", 10, 0, 1)][:2] == ["aaaa.", "aaaa.bbbb?cccc."]
    # short pieces join the one before, blank ones go, no separator leaves a piece whole
    assert chunker.split("word  word", 512, 64, 10) == [("word word", 0, 10)]
    assert chunker.split("x" * 40, 10, 2, 5) == [("x" * 40, 0, 40)] and chunker.split(" \n ", 10) == []
    assert [x for x, *_ in chunker.split("甲甲甲甲：乙乙乙乙、丙丙丙丙", 8, 0, 1)] == ["甲甲甲甲：", "甲甲甲甲：乙乙乙乙、丙丙丙丙"]


def test_clusters_and_resolvers(spark):
    items = spark.createDataFrame([("q", u, x, 1, k) for k, (u, x) in enumerate([("a", 0.5), ("b", 0.9), ("c", 0.1), ("d", 0.2)])], "query_id string, unit_id string, score double, size int, position int")
    pairs = spark.createDataFrame([("q", "a", "b"), ("q", "b", "c")], "query_id string, a string, b string")
    assert {r.unit_id: r.representative for r in plugins.clusters(pairs, items).collect()} == {"a": "b", "b": "b", "c": "b", "d": "d"}
    up = plugins.model_udf(lambda: lambda xs: [x.upper() for x in xs], "string")
    assert spark.createDataFrame([("a",), (None,)], "x string").select(up(F.col("x")).alias("y")).collect()[0].y == "A"
    with pytest.raises(KeyError):
        plugins.get("llm", "none")
    frontier = spark.createDataFrame([("r", "a", ["d1", "d2"], 0)], "root string, node string, duties array<string>, hops int")
    edges = spark.createDataFrame([("a", "b", "t1", True), ("a", "b", "t2", True), ("a", "c", "t1", False)], "src string, dst string, edge_type string, confirmed boolean")
    rules = spark.createDataFrame([("t1", "d1"), ("t2", "d1"), ("t2", "d2")], "edge_type string, duty string")
    assert [(r.node, r.duties) for r in link.role_step(frontier, edges, rules, 2).collect()] == [("b", ["d1", "d2"])]


def test_metrics(spark):
    ranking = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, unit_id string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("p", "b")], "query_id string, unit_id string")
    got = {r.query_id: r for r in evaluate.ir_metrics(ranking, rel, 3).collect()}
    q = got["q"]
    assert (q.recall, q.rr, q.ap) == (0.5, 0.5, 0.25) and abs(q.precision - 1 / 3) < 1e-12
    assert abs(q.ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-12
    assert got["p"].ndcg == 0.0


def test_snapshot_token_ignores_order(spark):
    df = spark.range(200).withColumn("v", F.col("id") * 2)
    tokens = {govern.snapshot_token(df.repartition(n), ["id", "v"]).first().token for n in (1, 5)}
    assert len(tokens) == 1 and govern.snapshot_token(df.where("id > 0"), ["id", "v"]).first().token not in tokens


def test_pairs_by_blocks_are_those_of_the_join(spark, monkeypatch):
    """Broadcast or dealt out, with nulls and repeated rows; a key of all rows is no single task."""
    left = spark.createDataFrame([(k, None if k % 50 == 0 else 1 if k < 900 else k % 7) for k in range(1000)] + [(3, 1)], "a long, x int")
    right = spark.createDataFrame([(None if k % 40 == 0 else k, None if k % 30 == 7 else k % 5) for k in range(400)] + [(2, 2)], "b long, y int")
    pairs = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = pairs(left.join(right, F.col("x") == F.col("y")).select("a", "b"))
    monkeypatch.setattr(link, "CHUNK", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for held in (link.HELD, 0):
            monkeypatch.setattr(link, "HELD", held)
            met = link.by_blocks(left, right, "x", "y")
            assert pairs(met.select("a", F.inline("block"))) == want
            tasks = met.where("x = 1").select(F.spark_partition_id().alias("task")).collect()
            assert len({r.task for r in tasks}) > 1
            assert max(r.n for r in met.select(F.size("block").alias("n")).collect()) < 50
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_entity_links_are_filtered_before_their_shuffle(spark):
    """Links of other entities than the seeds' are dropped where they are made; they once were all made one first."""
    u = spark.createDataFrame([(f"u{k}", f"alpha w{k:03} w{k % 7:03}") for k in range(60)], "unit_id string, content string")
    links, wanted = recall.entity_links(u), spark.createDataFrame([("x",)], "entity_hash string")
    plan = links.join(recall.few(wanted), "entity_hash", "left_semi")._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("HashAggregate") < plan.index("BroadcastHashJoin") and plan.rindex("HashAggregate") < plan.index("BroadcastHashJoin")
    seeds = spark.createDataFrame([("u1", 1.0), ("u2", 0.5), ("u3", 0.25)], "unit_id string, score double")
    got = {r.unit_id for r in recall.expand_entities(seeds, links, seeds, seeds, 100).collect()}
    assert got == {f"u{k}" for k in range(60)} - {"u1", "u2", "u3"}
