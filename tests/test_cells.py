"""The vector index against the exact search, and what it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.operators import cells, recall


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 16))
    x = centre[rng.integers(12, size=1500)] + rng.normal(size=(1500, 16)) * 0.5
    x[:300] = x[0]  # a third of a cell and more are one vector
    rows = [(f"v{k:04d}", v.tolist(), k % 4) for k, v in enumerate(x)] + [("zero", [0.0] * 16, 1), ("null", None, 1), ("nan", [float("nan")] * 16, 1)]
    return spark.createDataFrame(rows, "unit_id string, vector array<double>, label int").repartition(4)


@pytest.fixture(scope="module")
def index(vectors):
    return cells.build(vectors)


def asked(vectors):
    return vectors.where(F.col("unit_id").rlike("^v...[05]$")).select(F.col("unit_id").alias("query_id"), "vector")


def hits(df):
    return {(r.query_id, r.rank): (r.unit_id, round(r.score, 9)) for r in df.collect()}


def test_all_cells_are_exact(vectors, index):
    good = vectors.where("unit_id like 'v%'")
    assert hits(index.search(asked(vectors), 7)) == hits(recall.knn(good, asked(vectors), 7))
    assert index.rows().count() == vectors.count()


def test_the_filter_takes_no_place(vectors, index):
    good = vectors.where("unit_id like 'v%' and label = 2")
    assert hits(index.search(asked(vectors), 7, keep=F.col("label") == 2)) == hits(recall.knn(good, asked(vectors), 7))


def test_recall_of_few_cells(vectors, index):
    exact = index.search(asked(vectors), 10).select("query_id", "score").collect()
    some = index.search(asked(vectors), 10, probes=len(index.centres) // 4).collect()
    # by scores: equal vectors stand for each other
    best = {}
    for r in exact:
        best.setdefault(r.query_id, []).append(round(r.score, 9))
    found = sum(round(r.score, 9) >= min(best[r.query_id]) for r in some)
    assert found >= 0.95 * len(exact)


def test_recall_on_the_tables(spark):
    from memspark.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.unit_id) for r in QUERIES["J02_exact_knn"](spark, sf).collect()}
    some = {(r.query_id, r.unit_id) for r in QUERIES["J05_probed_cells"](spark, sf).collect()}
    assert len(exact & some) >= 0.9 * len(exact)


def test_other_cells_are_not_read(vectors, index):
    q = cells.unit(np.array([r.vector for r in asked(vectors).limit(1).collect()]))
    looked = index.cells_of(q, 2)
    assert looked.sum() == 2
    plan = index.read(looked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    files = {f.rsplit("/", 2)[1] for r in index.read(looked).select(F.input_file_name()).distinct().collect() for f in r}
    assert files <= {f"cell={c}" for c in np.flatnonzero(looked[0])}


def test_nothing(spark):
    none = cells.build(spark.createDataFrame([], "unit_id string, vector array<double>"))
    some = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert none.search(some, 3).count() == 0
    assert cells.build(spark.createDataFrame([("a", [1.0, 0.0])], "unit_id string, vector array<double>")).search(some.limit(0), 3).count() == 0


def test_scores_at_once_are_bounded():
    """However many rows an Arrow batch has and queries a block, a worker makes PRODUCT scores at once; all rows are seen once, in their order."""
    import pyarrow as pa

    batches = [pa.record_batch([pa.array(range(k, k + n))], ["x"]) for k, n in ((0, 10_000), (10_000, 0), (10_000, 777))]
    for n in (1, 2048, 2 * recall.PRODUCT):
        cut = [*recall.sliced(batches, n)]
        assert max(map(len, cut)) <= max(1, recall.PRODUCT // n) and min(map(len, cut)) > 0
        assert [x for b in cut for x in b.column(0).to_pylist()] == [*range(10_777)]
