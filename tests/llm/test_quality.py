"""Counts against a brute-force version; cutoffs that do not depend on how rows are dealt."""

import re
from collections import Counter

import pytest

from memspark.llm import quality as q

TEXTS = [None, "", " \n\t ", "a b c d e", "a b c d e f a b c d e g", "x " * 300, "one\none\n\n \ntwo\none", "École été # % & <b> |x|\x1cy z", "A\x0bB\x0cC\rD", "w1 w2 w3 w4 w5 w6 " * 3 + "end", "long " + "word" * 9000]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", "s", "clash", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, measures string, n_words int")
    got = {r.doc_id: tuple(r)[1:7] for r in q.quality(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def corpus(spark, parts):
    good = [(i, f"This is the story number {i} of a plain and honest author who wrote {i * 7 % 13} lines about it today", "en", "a" if i % 3 else None) for i in range(600)]
    bad = [(1000 + i, "These%%% words$$$ are### full*** of&&& marks%%% every$$$ one### of*** them&&& now%%%", "en", "a") for i in range(40)]
    rare = [(2000, "Eine kleine Gruppe hat keine eigene Grenze und nimmt die ihrer Sprache oder aller", "de", "b"), (2001, None, None, None)]
    return spark.createDataFrame(good + bad + rare, "doc_id long, text string, lang string, source string").repartition(parts)


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_verdicts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(q, "BROADCAST_GROUPS", broadcast)
    got = {}
    for parts in (1, 7):
        rows = q.quality(corpus(spark, parts)).collect()
        got[parts] = sorted((r.doc_id, r.kept) for r in rows)
    assert got[1] == got[7]
    kept = {i for i, k in got[1] if k}
    assert kept == {*range(600), 2000}
    stage = q.quality_stage(corpus(spark, 3))
    assert stage.columns == ["doc_id", "text", "lang", "source"] and {r.doc_id for r in stage.collect()} == kept


def test_sketches_merge(spark):
    rows = q.measured(corpus(spark, 2))
    whole = {tuple(r) for r in q.sketches(rows).collect()}
    a, b = q.sketches(rows.where("doc_id % 2 = 0")), q.sketches(rows.where("doc_id % 2 = 1"))
    merged = a.unionByName(b).groupBy("lang", "source", "rate", "bucket").sum("n")
    assert {tuple(r) for r in merged.collect()} == whole


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert q.quality(empty).count() == 0 and q.quality_stage(empty).count() == 0


def test_many_groups_give_the_same_verdicts(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    few = sorted(map(tuple, q.op3_adaptive_quality(spark, sf).collect()))
    monkeypatch.setattr(q, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, q.op3_adaptive_quality(spark, sf).collect())) == few
