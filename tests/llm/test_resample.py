"""Resampling against plain Python on short and cut texts, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import pytest

from memspark.llm import resample as own


def plain(docs, target, n, buckets, percent, least):
    words = lambda x: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
    runs = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    s, t = [0] * buckets, [0] * buckets
    for _, x in docs:
        for b in runs(words(x)):
            s[b] += 1
    for x in target:
        for b in runs(words(x)):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, x in docs:
        f = runs(words(x))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    long = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(long[: percent * len(long) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["alpha", "Beta", "gamma9", "d", "é", "日本", "x-y", "naïve", "ΑΒΓ", "42", "İı"]
    text = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(k))
    docs = [(k, text(rng.randint(0, 60))) for k in range(300)] + [(None, text(30)), (400, None), (401, ""), (402, "!? -"), (403, text(3000)), (404, "w" * 900), (405, " " * 900 + text(50))]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (406, ("a" * 130 + " ") * 40)]
    return docs, [text(20) for _ in range(30)] + [None, ""]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_against_plain_python(spark, rows, monkeypatch, n):
    monkeypatch.setattr(own, "CHUNK", 128)  # most texts are cut
    monkeypatch.setattr(own, "RANKED", 20)  # and many tasks rank
    docs, target = rows
    d = spark.createDataFrame([(a, b, 5, 1) for a, b in docs], "doc_id long, text string, score int, row int").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = own.resample(d, t, n, buckets=500, percent=25).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, target, n, 500, 25, 20)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_chunks_own_every_start_once(n):
    rng = random.Random(n)
    for _ in range(200):
        text = "".join(rng.choice("ab  é-") for _ in range(rng.randint(0, 80))).encode()
        words = own.WORD.findall(text)
        whole = own.hashes(words, n, len(words))
        parts = [h for owned, piece in own.cut(text, n, 16) for h in own.hashes(own.WORD.findall(piece), n, owned)]
        assert sorted(parts) == sorted(whole)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two"), (2, "a " * 40)], "doc_id long, text string")
    assert own.resample(none, none).collect() == []
    assert own.resample(none, some).collect() == []
    assert sorted(tuple(r)[:2] for r in own.resample(some, none, percent=100).collect()) == [(1, 2), (2, 40)]
