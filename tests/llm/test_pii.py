"""Fixed patterns against plain finditer, trees and cuts on held-out rows, the stage."""

import re

import numpy as np
import pytest

from memspark.llm import pii, secret_scan, trees

TEXTS = [
    None,
    "",
    "mail a.b+c@mail7.example.com, @x.y a@b @@c@d.e a@b..c x@-.- é@ü.de q@w.e@r.t",
    "ips 1.2.3.4 256.1.1.1 1.2.3 1.1.1.1.1.1.1.1.1 097.51.017.173 12.34.56.78.9 99999999999.1.1.1",
    "cards 4111 1111 1111 1111 4111-1111-1111-1112 4845168114407329 2390409500648960 1  2 12345678901234567890",
    "phones +1 (136) 555-7479 +49.30.1234567 +12 +1 ... 2 +1234567890123456 ++44 20 7946 0958 x",
    "1" * 5000 + " " + "a" * 5000 + "@" + "b" * 10,
    "9-" * 3000 + "8",
]


def plain(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


@pytest.fixture(scope="module")
def judge():
    return pii.model()


def test_base_spans(judge):
    for text in TEXTS:
        assert [x for x in pii.spans(text, judge) if x[0] in pii.BASE] == plain(text), text and text[:60]


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (2000, 5)).astype(float)
    y = ((x[:, 0] > 1) ^ (x[:, 3] > 2)).astype(float)
    model = trees.boost(x[:1500], y[:1500], rounds=30)
    assert ((model.score(x[1500:]) > 0) == y[1500:]).mean() > 0.98


def test_calibration():
    scores, y = np.array([5.0, 4, 3, 2, 1]), np.array([1.0, 1, 1, 0, 1])
    assert trees.calibrated(scores, y, 0.99) == 3.0
    assert trees.calibrated(scores, 1 - y, 0.99) == float("inf")


def test_held_out_rows(judge):
    model, cuts = judge
    rows = [*pii.labelled(3000, seed=77)]
    found = model.score(np.array([pii.features(t, k, a, b) for t, k, a, b, _ in rows], float)) >= np.array([cuts[r[1]] for r in rows])
    y = np.array([r[4] for r in rows]) == 1
    assert (found & y).sum() / found.sum() > 0.96 and (found & y).sum() / y.sum() > 0.85


def test_added_spans(judge):
    texts = {
        "please call 415-555-0132 tomorrow": ["415-555-0132"],
        "her ssn: 123-45-6789": ["123-45-6789"],
        "bank account DE89 3704 0044 0532 0130 00 today": ["DE89 3704 0044 0532 0130 00"],
        "write to anna (at) example (dot) com": ["anna (at) example (dot) com"],
        "order 415-555-0132 has shipped on 2024-03-05": [],
        "the thnt 2669109448945251 on re thstntre": [],
        "pages 100-200 and rows 123-456": [],
    }
    for text, want in texts.items():
        assert [text[a:b] for k, a, b in pii.spans(text, judge)] == want, text


def test_query_and_stage(spark, judge):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "en", "s", None, "x"), (2, TEXTS[2], "en", "s", 5, "x")], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    rows = secret_scan.digest(pii.personal_data(docs), pii.BASE).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        found = pii.spans(TEXTS[2] if r.doc_id is None else TEXTS[r.doc_id], judge)
        assert r.base_sha256 == secret_scan.sha(found, pii.BASE) and r.spans == secret_scan.joined(found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in found) for x in pii.BASE)
    stage = pii.redact_stage(docs)
    assert stage.columns == docs.columns
    for r in stage.collect():
        text = TEXTS[2] if r.doc_id is None else TEXTS[r.doc_id]
        found = pii.spans(text, judge)
        assert r.text == (pii.redacted(text, found) if found else text)
        assert not found or (r.n_chars == len(r.text) and not plain(r.text))
    assert pii.redact_stage(docs.limit(0)).count() == 0 and pii.personal_data(docs.limit(0)).count() == 0


def test_overlapping_spans_are_redacted_once():
    assert pii.redacted("ab1234cd", [("ip", 2, 5), ("card", 3, 6)]) == "ab[IP]cd"


def test_numbers_next_to_each_other(judge):
    texts = {
        "call 555-123-4567 555-987-6543 now": ["555-123-4567", "555-987-6543"],
        "ssn 123-45-6789. 987-65-4321.": ["123-45-6789", "987-65-4321"],
        "phone 5551234567 5559876543": ["5551234567", "5559876543"],
        "phone 555-123-4567 24 hours": ["555-123-4567"],
        "order 555-123-4567 555-987-6543": [],
    }
    for text, want in texts.items():
        assert [text[a:b] for k, a, b in pii.spans(text, judge)] == want, text


def test_every_stretch_of_groups_is_a_candidate():
    texts = {
        "555-123-4567 24": {"555-123", "555-123-4567", "555-123-4567 24", "123-4567", "123-4567 24", "4567 24"},
        "(555) 987-6543, 12": {"(555) 987", "(555) 987-6543", "987-6543"},
        "5551234567 5559876543": {"5551234567", "5559876543"},
        "12345678 12345678 1": {"12345678", "12345678 12345678", "12345678 1"},
        "12345678901234567 3.141592 a123456 +4930123 123456b 1234567é": {"3.141592", "141592", "1234567"},
        "1 85 05 78 006 084 36": {"1 85 05 78", "85 05 78", "1 85 05 78 006", "85 05 78 006", "05 78 006", "1 85 05 78 006 084", "85 05 78 006 084", "05 78 006 084", "78 006 084", "1 85 05 78 006 084 36", "85 05 78 006 084 36", "05 78 006 084 36", "78 006 084 36", "006 084", "006 084 36"},
    }
    for text, want in texts.items():
        got = [*pii.numbers(text)]
        assert len(got) == len(set(got)) and {text[a:b] for a, b in got} == want, text


def test_cues_and_addresses_of_the_tables_languages(judge):
    texts = {
        "Telefon: 415-555-0132 heute": ["415-555-0132"],
        "mi teléfono es 415-555-0132": ["415-555-0132"],
        "Steuernummer 123-45-6789": ["123-45-6789"],
        "Rechnung 415-555-0132": [],
        "write to anna ( at ) host.org": ["anna ( at ) host.org"],
        "after creation. anna (at) host.org": ["anna (at) host.org"],
        "we saw the creation. Then it ended": [],
        "bank account ES91 2100 0418 4502 0005 1332 DE89 3704 0044 0532 0130 00": ["ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"],
    }
    for text, want in texts.items():
        assert [text[a:b] for k, a, b in pii.spans(text, judge)] == want, text


#: Sentences with one datum each, and sentences without any.
SAID = {
    "phone 1-800-555-0199": "1-800-555-0199", "Tel.: 0049 30 123456": "0049 30 123456", "my social security number is 123456789": "123456789",
    "passport no. 512345678": "512345678", "passport C01X00T47": "C01X00T47", "DNI 12345678Z": "12345678Z", "NIE X1234567L": "X1234567L",
    "Steuernummer 12/345/67890": "12/345/67890", "Steuer-ID 12 345 678 901": "12 345 678 901", "geboren am 3.4.1985": "3.4.1985",
    "date of birth: March 3, 1985": "March 3, 1985", "account number 12345678": "12345678", "john dot smith at gmail dot com": "john dot smith at gmail dot com",
    "call 06 12 34 56 78": "06 12 34 56 78", "llámame al 612 345 678": "612 345 678", "móvil: 612-34-56-78": "612-34-56-78",
    "office 555-123-4567 home 555-987-6543": "555-123-4567", "home 555-987-6543": "555-987-6543", "driver's licence D1234567": "D1234567",
    "numéro de sécurité sociale 1 85 05 78 006 084 36": "1 85 05 78 006 084 36", "tax id 12-3456789": "12-3456789", "call me at 415-555-0132": "415-555-0132",
    "ssn 123-45-6789": "123-45-6789", "IBAN DE89 3704 0044 0532 0130 00": "DE89 3704 0044 0532 0130 00", "anna (at) verein.de": "anna (at) verein.de",
    "née le 3 mars 1985": "3 mars 1985", "nacido el 12/10/1979": "12/10/1979", "(415) 555-0132 is her cell": "(415) 555-0132", "born 12.11.1961": "12.11.1961",
    "Handy 0171 2345678": "0171 2345678",
}
CLEAN = (
    "order 415-555-0132 has shipped", "page 123 of 1234", "in the year 2012 and 1985", "it cost $123.456.789", "on 2024-03-05 we met", "invoice 1234567890",
    "part AB12 3456 7890", "version 1.2.3.4.5", "built in 12.10.1999", "the score was 21 19 21 17 21", "the flight LH1234567 left", "pi is 3.14159265",
    "table 12 34 56 78 90 12", "error E1234567 in module", "rows 123-456 and 789-012", "published March 3, 2005", "since 3 mars 2001 it is open", "model X1000Z",
    "key A1B2C3D4E5", "chapter 123456789", "price 12.345.678", "it weighs 1234567 grams", "10.12.2003 opening", "commande 06 12 34 56 78", "look at example. then",
)


def test_sentences_with_and_without_a_datum(judge):
    texts = [f"we talked about it, {s}, and then left" for s in SAID]
    found = [[t[a:b] for _, a, b in own] for t, own in zip(texts, pii.spans_of(texts, judge), strict=True)]
    hits = sum(any(v in g and len(g) <= len(v) + 2 for g in own) for v, own in zip(SAID.values(), found, strict=True))
    false = sum(any(k not in pii.BASE for k, _, _ in own) for own in pii.spans_of([*CLEAN], judge))
    assert hits >= 0.9 * len(SAID) and hits >= 0.9 * (hits + false)


def test_features_of_many_stretches_are_those_of_each():
    import random

    rng = random.Random(1)
    pieces = [*"0123456789" * 2, *" -./(),:x$%é ", " tel ", " phone: ", "my ", "number ", " 12 34 ", "19"]
    for text in [*TEXTS[2:6], *("".join(rng.choice(pieces) for _ in range(rng.randint(5, 200))) for _ in range(200))]:
        all_ = pii.Stretches(text)
        all_.ready()
        for i, j in all_.spans():
            plain_ = [pii.features(text, "number", a, b) for a, b in zip(all_.start[i].tolist(), all_.end[j].tolist(), strict=True)]
            assert np.array_equal(all_.features(i, j), np.array(plain_, np.float32).reshape(len(i), -1) if len(i) else all_.features(i, j))


def test_texts_together_are_as_texts_alone(judge, monkeypatch):
    texts = [None, *TEXTS[1:6], *SAID, *CLEAN, " ".join(SAID)]
    alone = [pii.spans(t, judge) for t in texts]
    monkeypatch.setattr(pii, "BLOCK", 7)
    assert pii.spans_of(texts, judge) == alone


def test_a_table_of_digits_in_bounded_time_and_memory(judge):
    import random
    import time
    import tracemalloc

    rng = random.Random(3)
    text = " ".join(str(rng.randrange(1, 1000)) for _ in range(130_000))
    began = time.perf_counter()
    pii.spans(text, judge)
    assert time.perf_counter() - began < 20
    tracemalloc.start()
    pii.spans(text[:100_000], judge)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
