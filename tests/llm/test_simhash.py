"""Fingerprints, the trie join and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from memspark.llm import graph, simhash


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least(n, near):
    root = list(range(n))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j) and up(i) != up(j):
                a, b = sorted((up(i), up(j)))
                root[b] = a
    return [up(i) for i in range(n)]


TEXTS = ["", None, " \n", "one", "one two", "ONE two THREE", "one two three four", "École à la É", "a  b\tc\x0bd\x1ce", "z " * 4000]


def test_fingerprints(monkeypatch):
    for limit in (1 << 17, 50):
        monkeypatch.setattr(simhash, "SHINGLES", limit)
        got = simhash.fingerprints([t.encode() if t is not None else None for t in TEXTS])
        assert got.tolist() == [plain(t) for t in TEXTS]


def clusters(seed, n):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 5, 30])):
            out.add(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("hot", [50_000, 6])
def test_links_lose_none(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    base = random.Random(5).getrandbits(64)
    ball = {base ^ 1 << i ^ 1 << j for i in range(0, 20) for j in range(0, 20)}
    fps = sorted({*clusters(1, 500), *ball, 0, 1, 3})
    want = least(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df).collect()
    place = {x: k for k, x in enumerate(signed)}
    assert all((fps[place[r.a]] ^ fps[place[r.b]]).bit_count() <= 64 for r in edges)
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame([(r.a, r.b) for r in edges], "a long, b long")).collect()}
    groups = {}
    for k, x in enumerate(signed):
        groups.setdefault(roots.get(x, x), set()).add(want[k])
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == len(set(want))


def test_components_of_a_long_path(spark):
    ids = list(range(200))
    random.Random(2).shuffle(ids)
    rows = [(ids[k], ids[k + 1]) for k in range(149)] + [(ids[k], ids[k + 1]) for k in range(150, 199)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    for part in (ids[:150], ids[150:]):
        assert all(got.get(i, i) == min(part) for i in part)


def corpus(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(4):
            text = base[:]
            text[rng.randrange(400)] = "changed"
            rows.append((len(rows) + 10, " ".join(text)))
    rows += [(1, ""), (2, None), (3, "  "), (None, rows[0][1]), (10, rows[0][1]), (10, rows[0][1]), (7, "solo text of a few words")]
    return rows, spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int")


def test_near_duplicates_and_the_stage(spark):
    rows, docs = corpus(spark)
    fps = [plain(t) for _, t in rows]
    root = least(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    smallest = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            smallest[r] = min(smallest.get(r, i), i)
    want = sorted((i is None, i or 0, fps[k], smallest[root[k]]) for k, (i, _) in enumerate(rows))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in got) == want
    stage = simhash.dedup_stage(docs)
    assert stage.columns == docs.columns
    assert sorted(r.doc_id for r in stage.collect()) == sorted(set(smallest.values()))


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.dedup_stage(empty).count() == 0


def rows_and_choice():
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 4) for _ in range(120)) for _ in range(5))
    # two null ids in different components; 9 is the choice for d only, its other row is a near-duplicate of 4
    rows = [(None, a), (None, b), (None, b), (4, c), (9, c), (9, d), (7, e), (None, e), (7, e)]
    return rows, sorted([(None, a), (None, b), (4, c), (9, d), (7, e)], key=str)


def test_the_stage_chooses_rows_not_ids(spark):
    rows, want = rows_and_choice()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.text) for r in simhash.dedup_stage(docs).collect()), key=str) == want


def test_a_hot_key_is_shared_out(spark):
    """Without Spark's own mending of skew: a third of all rows and more on one key, and a hub of a million leaves."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        rows = spark.range(1_200_000, numPartitions=40).selectExpr("if(id < 1000000, 0, id) AS u", "id AS v")
        table = rows.groupBy("u").count().selectExpr("u", "count AS n", "u + 1 AS m")
        each = graph.met(rows, table, "u", 1_200_000).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("m").alias("m")).collect()
        assert sum(r.n for r in each) == 1_200_000 and max(r.n for r in each) < 60_000
        assert sum(r.m for r in each) == sum(range(1_000_000, 1_200_000)) + 1_200_000
        star = spark.range(1_000_000, numPartitions=40).selectExpr("id AS a", "5000000 AS b")
        found = graph.components(star)
        assert found.count() == 1_000_000 and found.where("root <> 0").count() == 0
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
