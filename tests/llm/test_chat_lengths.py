"""Perspectives against a plain rendering; length sums against plain counts."""

import random
from collections import Counter, defaultdict

import pytest

from memspark.llm import chat, lengths, tokens


def render(turns, me):
    out, marks = "", []
    for turn, who, text in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())):
        head = "<|assistant|>\n" if who == me else f"<|user name={who}|>\n"
        marks += [who == me] * len(text)
        out += head + text + "<|end|>\n"
    return out, sum(marks)


@pytest.mark.parametrize("block", [512, 2])
def test_perspectives(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(1)
    rows = []
    for conv in [1, 2, 3, None]:
        for turn in [*range(11), None, None, 3]:
            rows.append((conv, turn, rng.choice(["ann", "bob", "çem", "", None][: 2 + (conv or 4)]), rng.choice(["hi", "é<|end|>\n", "", None, "x" * 50])))
    rows += rows[:3] + rows[:1]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, mask int")
    got = defaultdict(list)
    for r in chat.perspectives(df).collect():
        got[r.conv_id, r.perspective].append(r)
    want = defaultdict(list)
    for conv, turn, who, text in rows:
        want[conv].append((turn, who or "unknown", text or ""))
    assert got.keys() == {(c, w) for c, turns in want.items() for _, w, _ in turns}
    for (conv, me), segments in got.items():
        segments.sort(key=lambda r: (r.seg_start, r.seg_end))
        whole, scored = render(want[conv], me)
        assert "".join(r.segment for r in segments) == whole
        at = 0
        for r in segments:
            assert r.seg_start == at and r.seg_end - at == len(r.segment) and (r.role == "assistant") == (r.mask == 1) == (r.name == me)
            at = r.seg_end
        assert sum(r.text_end - r.text_start for r in segments if r.mask) == scored
    assert chat.perspectives(df.limit(0)).count() == 0


@pytest.mark.parametrize("stretch", [4096, 3])
def test_length_sums(spark, monkeypatch, stretch):
    monkeypatch.setattr(lengths, "STRETCH", stretch)
    own = tokens.Encoder(tokens.default_vocabulary())
    texts = ["word " * (k * k % 23) for k in range(80)] + [None, "", "long " * 5000]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, length int")
    sizes = [len(x) // 4 + 1 for x in own.encode([(t or "").encode() for t in texts])]
    summed = lengths.sums(lengths.histogram(docs.repartition(3))).cache()
    rows = {r.length: r for r in summed.collect()}
    assert {k: r.docs for k, r in rows.items()} == Counter(sizes)
    for k, r in rows.items():
        assert (r.docs_at_least, r.tokens_at_least) == (sum(s >= k for s in sizes), sum(s for s in sizes if s >= k))
        assert (r.docs_up_to, r.tokens_up_to, r.docs_total, r.tokens_total) == (sum(s <= k for s in sizes), sum(s for s in sizes if s <= k), len(sizes), sum(sizes))
        assert r.truncated_tokens == sum(min(s, k) for s in sizes) and r.lost_tokens == sum(max(0, s - k) for s in sizes)
    for r in lengths.at_limits(summed, [1, 2, 7, 10_000]).collect():
        assert (r.docs_over, r.truncated_tokens) == (sum(s > r.context for s in sizes), sum(min(s, r.context) for s in sizes))
    for r in lengths.quantiles(summed, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r.length == min(x for x in sizes if sum(s <= x for s in sizes) >= r.share * len(sizes))
    summed.unpersist()
    assert lengths.sums(lengths.histogram(docs.limit(0))).count() == 0


def test_turns_without_numbers_are_shared_out(spark):
    """One conversation whose turns are all null: places are gapless, and the sums within blocks see no more than a block."""
    rows = [(1, None, "ab"[i % 2], f"text {i}") for i in range(3000)] + [(2, 1 << 60, "a", "x"), (2, (1 << 60) + 1, "b", "y")]
    out = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv, me in {(r.conv_id, r.perspective) for r in out}:
        segments = sorted((r.seg_start, r.seg_end, r.segment) for r in out if (r.conv_id, r.perspective) == (conv, me))
        assert [s for s, *_ in segments] == [0, *(e for _, e, _ in segments[:-1])]
        want, _ = render([(t, w, x) for c, t, w, x in rows if c == conv], me)
        assert "".join(s for *_, s in segments) == want
