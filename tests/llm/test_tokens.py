"""Ids, packing and token files against the library itself and brute force."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from memspark.llm import packing, shared, tokens, wavelet
from memspark.llm.shared import new_folder

ODD = [
    "",
    None,
    "   \n\t ",
    "Hello, WORLD. It's don't we'll 'S x'",
    "École Éç ß µ ªº ÀÉÎ ﬀ é ́x İstanbul Σίσυφος ΣΑΣ 東京 한국 ๑๒ 1234 ½²",
    "<|endoftext|> a<|ENDOFTEXT|>b <|startoftext|>x",
    "%%% word%%% word***, a_b _x_ foo.bar! (see) \"quoted\" don''t word'. ...",
    "a\x1cb\x85c\xa0d　e​f",
    "the " * 5000,
    "x" * 3000,
    "3 × 4 ÷ 2 ×) ÷< a×b÷c× ÷÷. é×! ÷",
]


@lru_cache(maxsize=1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def plain_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def some_docs(spark, n=60):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, f"Lorem {i} ipsum, dolor. " * (i * i % 97 * 5)) for i in range(n)]
    rows += [(None, "no id"), (3, "again the same id"), (3, "again the same id")]
    return rows, spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, ids string, bucket string")


def test_chunk_memory_gives_the_ids_of_the_library():
    own = tokens.Encoder(tokens.default_vocabulary())
    for _ in range(2):
        for text, ids in zip(ODD, own.encode([t.encode() if t is not None else None for t in ODD]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain_ids(text), text


def test_ids_do_not_depend_on_what_was_seen_before(monkeypatch):
    """50,000 odd strings through one memory that turns over, then again in another order."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MEMORY", 20_000)
    rng = random.Random(7)
    signs = "×÷×÷éÉßÿÀæµªº" + "abcxyzABC" + "'.,;:!<>|()[]{}_*%$&-=/" + "019½²" + "東한Σςİ\u0301"
    make = lambda: "".join(rng.choice(signs) for _ in range(rng.randint(1, 6)))
    texts = [" ".join(make() for _ in range(rng.randint(1, 3))) for _ in range(50_000)]
    library = Tokenizer.from_file(tokens.default_vocabulary())
    want = {t: e.ids for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True)}
    own = tokens.Encoder(tokens.default_vocabulary())
    for again in (texts, rng.sample(texts, len(texts))):
        for k in range(0, len(again), 1000):
            part = again[k : k + 1000]
            for text, ids in zip(part, own.encode([t.encode() for t in part]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == want[text], text


def test_memory_turns_over(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    own = tokens.Encoder(tokens.default_vocabulary())
    for k in range(30):
        text = f"alpha beta{k % 7} gamma{k} word{k % 5}... tail{k % 3},"
        assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == plain_ids(text)


def test_packing_places_every_id_once(spark):
    rows, docs = some_docs(spark)
    out = packing.pack(docs.repartition(3), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, t in rows:
        ids = plain_ids(t) + [1]
        want[(i, len(ids))].append(ids)
    assert by_doc.keys() == want.keys()
    for key, all_ids in want.items():
        got = sorted(by_doc[key], key=lambda r: r.start)
        assert sum(r.length for r in got) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            assert [x for r in got for x in r.ids] == all_ids[0]
            at = 0
            for r in got:
                assert r.start == at
                at += r.length
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * total


def test_a_class_holds_a_fixed_count():
    p = packing.Packer(64)
    for i in range(40):
        p.add(i, b"\0" * 4 * 21)
    full = defaultdict(list)
    for doc, *_, sequence, _, kind, _ in p.take():
        full[sequence].append((doc, kind))
    assert full and all(len(v) == 3 and {k for _, k in v} == {3} for v in full.values())


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, text string"), capacity=1000)


def test_wavelet_file_answers_as_the_plain_array():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 40, 70_000), rng.integers(0, 49_406, 9_000), [7] * 5])
    shard = wavelet.Shard(wavelet.build(ids, [1, None], [1000, len(ids) - 1000]))
    assert (shard.ids == ids).all() and shard.doc_ids == [1, None]
    for place in [0, 1, 32767, 32768, 65536, len(ids) - 1, *rng.integers(0, len(ids), 20)]:
        assert shard.access(int(place)) == ids[place]
    for symbol in [0, 7, 39, 41, int(ids[75_000]), 60_000, 1 << 20]:
        where = np.flatnonzero(ids == symbol)
        assert shard.count(symbol) == len(where)
        assert shard.count(symbol, 100, 40_000) == ((where >= 100) & (where < 40_000)).sum()
        for k in {0, 1, len(where) // 2, len(where) - 1, len(where)}:
            assert shard.select(symbol, k) == (where[k] if 0 <= k < len(where) else None)
    assert shard.locate(int(ids[-1000])) == np.flatnonzero(ids == ids[-1000]).tolist()
    assert wavelet.Shard(wavelet.build(np.zeros(0, int), [], [])).ids.tolist() == []
    ones = wavelet.Shard(wavelet.build(np.zeros(5, int), [4], [5]))
    assert ones.ids.tolist() == [0] * 5 and ones.count(0) == 5 and ones.count(1) == 0


@pytest.mark.parametrize("size", [100, 1 << 21])
def test_token_files_round_trip(spark, size):
    rows, docs = some_docs(spark)
    manifest = wavelet.write_shards(docs.repartition(4), new_folder(spark, "test"), shard=size)
    out = sorted(wavelet.read_shards(manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(plain_ids(t) + [1])
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in want[r.doc_id]
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        at += r.n_tokens


def test_token_files_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert wavelet.read_shards(wavelet.write_shards(empty, new_folder(spark, "test"))).count() == 0


def test_one_doc_id_of_many_rows_is_shared_out(spark):
    rows = [(7, f"text {i % 3}") for i in range(3000)] + [(None, "none")] * 500 + [(i, f"text {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    manifest = wavelet.write_shards(docs, new_folder(spark, "test"))
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 1000
    out = sorted(wavelet.read_shards(manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    want = {(i, tuple(plain_ids(t) + [1])) for i, t in rows}
    assert {(r.doc_id, tuple(r.ids)) for r in out} == want
    ends = [0, *(r.start + r.n_tokens for r in out)]
    assert [r.start for r in out] == ends[:-1]


def test_a_folder_without_a_scheme_is_where_spark_has_it(spark, tmp_path):
    """Under another default file system a bare path is not the machine's own disk."""
    assert shared.qualified(spark, str(tmp_path)).startswith("file:/")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    try:
        hadoop.set("fs.defaultFS", "viewfs://cluster/")
        hadoop.set("fs.viewfs.mounttable.cluster.link./shared", f"file://{tmp_path}")
        assert shared.qualified(spark, "/shared/x") == "viewfs://cluster/shared/x"
    finally:
        hadoop.set("fs.defaultFS", before) if before else hadoop.unset("fs.defaultFS")
    with pytest.raises(ValueError):
        wavelet.save("/bare/path", "x", b"")
    path = wavelet.save(f"file:{tmp_path}", "x", wavelet.build(np.array([3, 1, 3]), [1], [3]))
    assert wavelet.load(path).ids.tolist() == [3, 1, 3]


def test_distinct_chunks_of_a_block_are_looked_up_once(monkeypatch):
    """A text's repeated chunks cost no look-up of their own; white space at the ends, null and odd texts keep the library's ids."""
    own = tokens.Encoder(tokens.default_vocabulary())
    seen = []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda chunks: (seen.append(list(chunks)), learn(seen[-1]))[1])

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return dict.get(self, *a)

    own.now = Counted()
    texts = ["ab cd " * 500, " \tab\n", None, "", " ", "AB <|x|> Cd", "cd\x0b\x0cab\r", "a\xa0b c\x1cd\x85e"]
    got = own.encode([x.encode() if x is not None else None for x in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain_ids(x) if x else [] for x in texts]
    assert sorted(seen[0]) == sorted({c for x in texts if x for c in (x if "<|" in x else x.lower()).encode().split()}) and Counted.asked < 40
    assert own.encode([]) == [] and own.encode([None, b" "]) == [b"", b""]


def test_slices_of_a_batch_keep_their_texts(monkeypatch):
    """Blocks are slices of an Arrow batch, also of one that is a slice itself."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "BLOCK", 64)
    texts = [None if k % 7 == 3 else f"Größe {k} 中文 <|{k}|> Ab" if k % 5 == 0 else f"é{k} ñandú  wörter " * (k % 4) for k in range(200)]
    for kind in (pa.string(), pa.large_string()):
        for batch in (pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"]), pa.RecordBatch.from_arrays([pa.array(["x y", *texts], kind)], ["text"]).slice(1)):
            got = [x for _, _, ids in tokens.encoded([batch], tokens.default_vocabulary()) for x in ids]
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain_ids(x) if x else [] for x in texts]
