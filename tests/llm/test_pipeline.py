"""The pipeline against its stages done by hand on a small corpus."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from tests.llm.test_quality import plain as measured
from tests.llm.test_similar import near
from tests.llm.test_similar import plain as shingles
from tests.llm.test_simhash import least
from tests.llm.test_tokens import plain_ids

from memspark.llm import decontam, pii
from memspark.llm.queries import ORACLES, QUERIES

ITEM = "What is the tallest building of the old town, and who built it in that year of peace?"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("mer", "tal", "son", "ver", "lin") for b in ("a", "en", "ort", "is", "um", "est", "or")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, make(rng.randint(60, 300)), "en", f"s{i % 2}") for i in range(1, 120)]
    # three texts under one doc_id, one of them near another document, stay but for that one
    rows += [(300, make(120), "en", "s0"), (300, make(150), "en", "s1"), (300, " ".join([*rows[9][1].split()[:-1], "other"]), "en", "s1")]
    rows += [(200, rows[5][1], "en", "s0"), (201, rows[5][1] + " " + make(1), "en", "s1"), (5, rows[7][1], "en", "s1")]
    rows += [(210, make(80) + " " + ITEM + " " + make(40), "en", "s0"), (211, make(90) + " " + ITEM.replace("tallest", "talest"), "en", "s0")]
    rows += [(220, make(70) + " a.b@mail.example.com or 4111 1111 1111 1111 " + make(30), "en", "s1"), (230, "too short", "en", "s0"), (231, None, "en", None), (232, "", None, "s0")]
    rows += [(240, " ".join(f"{w}%%%" for w in make(90).split()), "en", "s0"), (250, make(5) * 40, "en", "s0"), (260, make(6000), "en", "s1")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "Another question that is in no text of this corpus, as far as one can see.")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_pipeline(spark, folder):
    path, rows = folder
    good = [r for r in rows if not measured(r[1])[5] and r[0] != 240]
    sets = [shingles(r[1]) for r in good]
    root = least(len(good), lambda i, j: near(sets[i], sets[j]))
    groups = defaultdict(list)
    for r, k in zip(good, root, strict=True):
        groups[k].append(r)
    chosen = [min(members, key=lambda r: r[0]) for members in groups.values()]
    matcher = decontam.Matcher([(1, decontam.plain(ITEM))])
    judge = pii.model()
    want = sorted((r[0], len(plain_ids(pii.redacted(r[1], pii.spans(r[1], judge)))) + 1) for r in chosen if not matcher.find(r[1]))
    ids = [i for i, _ in want]
    assert not {200, 201, 210, 211, 230, 231, 232, 240, 250} & {*ids} and {220, 260} <= {*ids} and ids.count(300) == 2
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, path).collect():
        got[r.doc_id, r.doc_tokens] += r.length
    # pieces name their document by id and length: two documents of one id have two lengths here
    assert sorted((i, n) for (i, _), n in got.items()) == want


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema.simpleString() == docs.schema.simpleString()


def test_registered():
    assert [n for n in QUERIES if n.startswith("op")] == sorted((n for n in QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14)) and QUERIES["pipeline"] is corpus_pipeline.run
    assert ORACLES.keys() <= QUERIES.keys()
