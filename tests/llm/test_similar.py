"""Components at five-word shingles and similarity 0.8 against brute force."""

import random

import corpus_pipeline
import numpy as np
from tests.llm.test_simhash import least, rows_and_choice

from memspark.llm import simhash, similar


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def corpus():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(500)]
    texts = ["", None, " ", "one two", "ONE  two", "one two three four five six"]
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([20, 100, 300]))]
        texts.append(" ".join(base))
        for _ in range(3):
            text = base[:]
            for _ in range(rng.choice([1, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    # at the limit itself: 8 of 10 shingles in common
    texts += [" ".join(words[k : k + 13]) for k in (0, 1, 2)]
    return texts


def test_similar_at_the_limit():
    import numpy as np

    a = np.arange(9, dtype=np.uint64)
    assert similar.similar(a, np.arange(1, 10, dtype=np.uint64)) and not similar.similar(a, np.arange(2, 11, dtype=np.uint64))


def test_the_pipeline_stage_against_brute_force(spark):
    texts = corpus()
    sets = [plain(t) for t in texts]
    root = least(len(texts), lambda i, j: near(sets[i], sets[j]))
    want = sorted({min(k for k in range(len(texts)) if root[k] == r) for r in set(root)})
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(5)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    assert len(want) < len(texts) - 60
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_the_pipeline_stage_chooses_rows_not_ids(spark):
    rows, want = rows_and_choice()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str) == want


def test_a_group_over_many_blocks(spark, monkeypatch):
    """Copies of one text that drift apart, over blocks of four sets: the same classes as brute force."""
    monkeypatch.setattr(similar, "CHUNK", 4)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for _ in range(25):
        drift = base[:]
        for _ in range(rng.choice([0, 2, 4, 6])):
            drift[rng.randrange(120)] = rng.choice(words)
        for _ in range(8):
            drift[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(drift))
    sets = [plain(t) for t in texts]
    want = least(len(texts), lambda i, j: near(sets[i], sets[j]))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])], "doc_id long, text string").repartition(6)
    found = similar.rooted(docs).collect()
    assert len(found) == len(texts) + 2
    root = {r.doc_id: r.root for r in found if r.doc_id is not None}
    assert next(r.root for r in found if r.doc_id is None) == root[4]
    pairs = {(root[k], want[k]) for k in range(len(texts))}
    assert len(pairs) == len({a for a, _ in pairs}) == len(set(want)) > 1


def test_the_trie_gives_candidates(spark):
    """Fingerprints of five-word shingles, linked within two bits by the trie of op5; the bands come after."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, n)).encode() for n in (3, 40, 300)] + [b"one"]
    sets = [similar.shingled(t) for t in texts]
    assert [similar.fingerprint(s) % (1 << 64) for s in sets] == simhash.fingerprints(texts, similar.SHINGLE).tolist()
    base = int(rng.integers(0, 1 << 62))
    rows = [(1, base), (2, base), (3, base ^ 1), (4, base ^ (1 << 40) ^ (1 << 9)), (5, base ^ 0b1111 << 20), (6, ~base)]
    got = {(r.a, r.fp) for r in similar.by_trie(spark.createDataFrame(rows, "fp long, sim long")).collect()}
    seen = {1}
    for _ in rows:
        seen |= {y for pair in got for y in pair if set(pair) & seen}
    assert seen == {1, 2, 3, 4} and not any({5, 6} & set(pair) for pair in got)
