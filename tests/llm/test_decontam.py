"""Edit matching against a plain dynamic programme, and the stage."""

import random

from memspark.llm import decontam as d


def brute(item, text):
    """Smallest distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def spoil(rng, text, edits):
    out = list(text)
    for _ in range(edits if out else 0):
        if not out:
            break
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[k : k + (kind != 1)] = [] if kind == 0 else [rng.choice("abcdef ")]
    return "".join(out)


def test_distance():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) + spoil(rng, item, rng.randint(0, 9)) + "ab"
        want = brute(item, text)
        got = d.distance(d.columns(item), len(item), text, 12)
        assert (got is None) == (want > 12) and (got is None or (got[0] == want and brute(item, text[: got[1]]) == want))


def test_no_match_is_lost():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "of", "the"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, make(rng.randint(1, 40))) for k in range(40)]
    m = d.Matcher(items)
    for _ in range(60):
        k, item = rng.choice(items)
        text = d.plain(make(rng.randint(0, 60)) + " " + spoil(rng, item, rng.randint(0, len(item) // 8)) + " " + make(10))
        got = {i: (a, b, n) for i, a, b, n in m.find(text)}
        for i, other in items:
            best = brute(other, text)
            assert (i in got) == (best <= len(other) // d.PIECE), (i, best)
            if i in got:
                a, b, n = got[i]
                assert n == best and brute(other, text[a:b]) == best


ITEM = "What is the tallest building of the town, and who built it in that year?"


def test_matches_and_the_stage(spark):
    near = ITEM.replace("tallest", "talest").upper()
    rows = [(1, "x " * 3000 + ITEM), (2, f"Before\n{near}  after"), (3, "What is the tallest building"), (4, None), (5, ""), (None, ITEM), (1, "x " * 3000 + ITEM)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "z") for i, t in rows], "doc_id long, text string, lang string, source string, item_id long, distance string")
    items = spark.createDataFrame([(7, ITEM, 1), (8, None, 1), (9, "  ", 1), (7, ITEM, 1), (10, "A second question that nobody put into any text.", 1)], "item_id long, text string, doc_id long")
    for block in (16_000_000, 50):
        got = sorted((r.doc_id or 0, r.item_id, r.distance) for r in d.matches(docs, items, block).collect())
        assert got == sorted([(1, 7, 0)] * 4 + [(2, 7, 1)] * 2 + [(0, 7, 0)] * 2)
        kept = d.decontaminate(docs, items, block)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_nothing(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert d.matches(docs.limit(0), items).count() == 0
    assert d.matches(docs, items.limit(0)).count() == 0
    assert d.decontaminate(docs, items.limit(0)).count() == 1
