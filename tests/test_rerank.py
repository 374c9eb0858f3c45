"""The learned reranker: its fit against all pairs, and held-out rows against the overlap order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from memspark.operators import rerank
from memspark.plans import retrieval


def test_fit_is_that_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(f"q{rng.randrange(4)}", rng.choice([0, 1, 1, None]), rng.gauss(0, 1), rng.choice([0.0, 1.0, None]), 2.0) for _ in range(120)] + [("lone", 1, 9.0, 9.0, 2.0)]
    got = rerank.fit(spark.createDataFrame(rows, "q string, y int, a double, b double, c double"), "q", F.col("y"), ["a", "b", "c"])
    good = [r for r in rows if r[1] is not None and r[3] is not None]
    for k, f in ((2, "a"), (3, "b")):
        diffs = [x[k] - z[k] for x in good for z in good if x[0] == z[0] and x[1] == 1 and z[1] == 0]
        assert got[f] == pytest.approx(sum(diffs) / sum(d * d for d in diffs))
    assert got["c"] == 0.0


def ndcg(rows, k=20):
    gain = lambda ys: sum(y / math.log2(i + 2) for i, y in enumerate(ys[:k]))
    return gain([y for _, y in rows]) / max(1e-9, gain(sorted((y for _, y in rows), reverse=True)))


def test_held_out_rows_are_ordered_better_than_by_overlap(spark):
    rows = retrieval.labelled_hits(spark, "/root/testdata/sf0.1")
    weights = rerank.fit(rows.where("doc_id % 2 = 1"), "query_id", F.col("quality"), list(retrieval._FEATURES))
    held = rerank.scored(rows.where("doc_id % 2 = 0"), weights).select("query_id", "quality", "score", "overlap", "doc_id").collect()
    means = []
    for key in ("score", "overlap"):
        by = {}
        for r in held:
            by.setdefault(r.query_id, []).append((r[key], r.doc_id, r.quality))
        means.append(sum(ndcg([(s, y) for s, _, y in sorted(v, key=lambda x: (-x[0], x[1]))]) for v in by.values()) / len(by))
    print(means)
    assert means[0] > means[1] + 0.05
