"""Language profiles against a letter by letter bundle, on held-out rows, and on odd rows."""

import zlib

import numpy as np
import pytest

from memspark.llm import language as own
from memspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_symbols(text):
    """Lower-case letters, one space for anything else, at both ends too."""
    out = [" "]
    for c in text:
        if not c.isalpha():
            if out[-1] != " ":
                out.append(" ")
        else:
            out.append(c.lower() if len(c.lower()) == 1 else c)
    return out + [" "] * (out[-1] != " ")


def plain_bundle(text):
    s, total = plain_symbols(text), np.zeros(own.PLACES, int)
    for a, b, c in zip(s, s[1:], s[2:]):
        va, vb, vc = (own.letter(ord(x)).astype(int) for x in (a, b, c))
        total += np.array([va[i - 2] * vb[i - 1] * vc[i] for i in range(own.PLACES)])
    return total


TEXTS = ["The thing, and THE end", "", "  ", "1234 !?", "é", "ab", "Straße in Übersee", "İstanbul \U0001d400 日本語", "a\0b", "x" * 50, "été " * 30]


def test_bundles():
    assert (own.bundled(TEXTS) == np.stack([plain_bundle(x) for x in TEXTS])).all()


def test_long_texts_are_bundled_in_stretches(monkeypatch):
    want = own.bundled([" ".join(TEXTS) * 20])
    monkeypatch.setattr(own, "CHARS", 37)
    monkeypatch.setattr(own, "GRAMS", 5)
    monkeypatch.setattr(own, "KEPT", 8)
    assert (own.bundled([" ".join(TEXTS) * 20]) == want).all()


def test_query_against_bundles_of_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    protos: dict = {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.text is not None and r.lang is not None:
            protos[r.lang] = protos.get(r.lang, 0) + own.bundled([r.text])[0]
    got = {r.doc_id: r for r in QUERIES["op11_hyperdimensional_language"](spark, SF).collect()}
    assert len(got) == len(docs)
    right = held = 0
    for r in docs:
        v = own.bundled([r.text or ""])[0].astype(float)
        cos = {k: v @ p / max(1e-300, np.linalg.norm(v) * np.linalg.norm(p.astype(float))) for k, p in protos.items()}
        best = max(sorted(cos), key=cos.get)
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if any(c.isalpha() for c in r.text or ""):
            assert (g.lang_pred, round(g.score, 6)) == (best, round(min(1.0, max(0.0, cos[best])), 6))
        else:
            assert (g.lang_pred, g.score) == (own.UNKNOWN, 0.0)
        if g.held_out and r.lang is not None:
            held, right = held + 1, right + (g.lang_pred == r.lang)
    assert held > 20 and right >= 0.97 * held


@pytest.mark.parametrize("rows", [[], [(1, None, None, 3)], [(1, "abc", None, 3)], [(None, "abc abc", "en", 1), (2, None, "en", 1), (3, "12", "fr", 1), (3, "12", "fr", 1), (4, "abd", "en", 0)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    learned = own.prototypes(own.profiles(docs))
    got = own.identify(docs, learned, ("doc_id",)).collect()
    assert len(got) == len(rows)
    for g, r in zip(got, rows, strict=True):
        known = learned[0] and r[1] and any(c.isalpha() for c in r[1])
        assert (g.lang_pred in learned[0]) if known else (g.lang_pred, g.score) == (own.UNKNOWN, 0.0)
        assert 0 <= g.score <= 1
    assert set(learned[0]) == {r[2] for r in rows if any(c.isalpha() for c in r[1] or "") and r[2] is not None}
