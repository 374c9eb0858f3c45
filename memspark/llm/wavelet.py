"""Token ids in wavelet-matrix files: one compressed file per shard.

A shard's ids are held as bit planes, highest bit first; each plane is stably
dealt by its bit into the next. With counts of ones before every block, the
file answers access (the id at a place), rank (how often an id occurs before a
place) and select (where its k-th occurrence is) by reading a few blocks of
each plane. Documents lie in ascending doc_id order, within and across shards.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.shared import new_folder, qualified, written
from memspark.llm.tokens import END_ID, default_vocabulary, encoded

MAGIC = b"WMX1"
#: Bits of a plane in one compressed block.
BLOCK = 1 << 15
#: Ids of a shard, after which the next document starts another.
SHARD = 1 << 21
LEVEL = 3
#: Buckets that ids are dealt to at most, and ids sampled for each bound between two: 1,000,000 on the driver at most.
BUCKETS, SAMPLED = 50_000, 20


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of one shard."""
    import zstandard

    z = zstandard.ZstdCompressor(level=LEVEL)
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    # two bytes hold the ids of most vocabularies, which halves what is moved about
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, ranks, sizes, body = [], [], [], []
    for level in range(bits - 1, -1, -1):
        one = (now & now.dtype.type(1 << level)).astype(bool)
        zeros.append(int(n - one.sum()))
        counts = np.add.reduceat(one, np.arange(0, n, BLOCK), dtype=np.int64) if n else np.zeros(0, np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(counts)])[:-1] if n else counts)
        packed = np.packbits(one)
        for k in range(0, len(packed), BLOCK // 8):
            frame = z.compress(packed[k : k + BLOCK // 8].tobytes())
            sizes.append(len(frame))
            body.append(frame)
        if level:
            now = np.concatenate([np.compress(~one, now), np.compress(one, now)])
    docs = z.compress(np.array([x if x is not None else 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes() + np.array(lengths, "<i8").tobytes())
    index = z.compress(np.array(sizes, "<u4").tobytes() + np.concatenate([*ranks, np.zeros(0, np.int64)]).astype("<u4").tobytes())
    head = json.dumps({"n": n, "bits": bits, "block": BLOCK, "zeros": zeros, "docs": len(doc_ids), "docs_bytes": len(docs), "index_bytes": len(index)}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + docs + index + b"".join(body)


class Shard:
    """A file of build(), read from its bytes or a memory map; only the blocks asked for are unpacked."""

    def __init__(self, data: bytes | memoryview):
        import zstandard

        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.data = data
        size = struct.unpack("<I", data[4:8])[0]
        self.head = json.loads(bytes(data[8 : 8 + size]))
        self.n, self.bits, self.block, self.zeros = (self.head[k] for k in ("n", "bits", "block", "zeros"))
        self.z = zstandard.ZstdDecompressor()
        at = 8 + size
        d = self.head["docs"]
        docs = self.z.decompress(bytes(data[at : at + self.head["docs_bytes"]]))
        keys, null = np.frombuffer(docs, "<i8", d), np.frombuffer(docs, "u1", d, 8 * d)
        self.doc_ids = [None if x else int(k) for k, x in zip(keys, null, strict=True)]
        self.lengths = np.frombuffer(docs, "<i8", d, 9 * d)
        at += self.head["docs_bytes"]
        index = self.z.decompress(bytes(data[at : at + self.head["index_bytes"]]))
        self.per = -(-self.n // self.block)
        sizes = np.frombuffer(index, "<u4", self.per * self.bits)
        self.ranks = np.frombuffer(index, "<u4", self.per * self.bits, 4 * self.per * self.bits).reshape(self.bits, self.per)
        self.starts = at + self.head["index_bytes"] + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.kept: dict[int, np.ndarray] = {}

    def _frame(self, plane: int, block: int) -> np.ndarray:
        """The bits of a block, as bytes of 0 and 1."""
        k = plane * self.per + block
        if k not in self.kept:
            raw = self.z.decompress(bytes(self.data[self.starts[k] : self.starts[k + 1]]))
            if len(self.kept) > 64:
                self.kept.clear()
            self.kept[k] = np.unpackbits(np.frombuffer(raw, np.uint8))[: min(self.block, self.n - block * self.block)]
        return self.kept[k]

    def _ones(self, plane: int, place: int) -> int:
        """Ones of a plane before a place."""
        if place >= self.n:
            return self.n - self.zeros[plane]
        block, rest = divmod(place, self.block)
        return int(self.ranks[plane, block]) + int(self._frame(plane, block)[:rest].sum())

    def access(self, place: int) -> int:
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for plane in range(self.bits):
            bit = int(self._frame(plane, place // self.block)[place % self.block])
            ones = self._ones(plane, place)
            place = self.zeros[plane] + ones if bit else place - ones
            value = value << 1 | bit
        return value

    def _narrow(self, symbol: int, start: int, end: int) -> tuple[int, int]:
        """The range of the last level that the symbol's occurrences in [start, end) fill."""
        for plane in range(self.bits):
            a, b = self._ones(plane, start), self._ones(plane, end)
            if symbol >> (self.bits - 1 - plane) & 1:
                start, end = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [start, end)."""
        if symbol < 0 or symbol >> self.bits:
            return 0
        a, b = self._narrow(symbol, max(0, start), min(self.n, self.n if end is None else end))
        return max(0, b - a)

    def rank(self, symbol: int, place: int) -> int:
        return self.count(symbol, 0, place)

    def _nth(self, plane: int, bit: int, k: int) -> int:
        """The place of a plane's k-th one or zero, from 0."""
        edges = self.ranks[plane].astype(np.int64)
        if not bit:
            edges = np.arange(self.per) * self.block - edges
        block = int(np.searchsorted(edges, k, "right")) - 1
        return block * self.block + int(np.flatnonzero(self._frame(plane, block) == bit)[k - edges[block]])

    def select(self, symbol: int, k: int) -> int | None:
        """The place of the k-th occurrence, from 0; None if there are not so many."""
        if symbol < 0 or symbol >> self.bits:
            return None
        a, b = self._narrow(symbol, 0, self.n)
        if not 0 <= k < b - a:
            return None
        place = a + k
        for plane in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - plane) & 1
            place = self._nth(plane, bit, place - self.zeros[plane] if bit else place)
        return place

    def locate(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    @cached_property
    def ids(self) -> np.ndarray:
        """All ids. The deal into the last plane is undone plane by plane."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for plane in range(self.bits - 1, -1, -1):
            first = plane * self.per
            raw = b"".join(self.z.decompress(bytes(self.data[self.starts[k] : self.starts[k + 1]])) for k in range(first, first + self.per))
            one = np.unpackbits(np.frombuffer(raw, np.uint8))[: self.n].astype(bool)
            back = np.empty(self.n, kind)
            back[~one] = values[: self.zeros[plane]]
            back[one] = values[self.zeros[plane] :] | kind(1 << (self.bits - 1 - plane))
            values = back
        return values.astype(np.uint32)


def _store(folder: str):
    """The file system of a qualified folder, and the path there."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":/")
    if not colon:
        raise ValueError(f"{folder} names no file system")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + colon + rest)


def save(folder: str, name: str, data: bytes) -> str:
    """Write whole or not at all: a lost or doubled task leaves no partial file under the name."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")
    return f"{folder}/{name}"


def load(file: str) -> Shard:
    folder, _, name = file.rpartition("/")
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/{name}") as f:
        return Shard(f.read())


def _bounds(docs: DataFrame) -> tuple[int, np.ndarray, list[int]]:
    """Buckets for null doc_ids; bounds between the others as (doc_id, tie), from a bounded sample.

    A doc_id of many rows stands in several bounds, parted by ties.
    """
    n = min(BUCKETS, max(2, docs.rdd.getNumPartitions()))
    ids = docs.select("doc_id")
    share = min(1.0, SAMPLED * n / max(1, ids.count()))
    sample = ids.sample(share, 42).select("doc_id", F.rand(7).alias("tie")).toPandas()
    nulls = sample["doc_id"].isna().to_numpy()
    known = sample["doc_id"][~nulls].to_numpy(np.int64)
    ties = (sample["tie"].to_numpy()[~nulls] * (1 << 62)).astype(np.int64)
    order = np.lexsort((ties, known))[SAMPLED::SAMPLED]
    return max(1, int(nulls.sum()) // SAMPLED), known[order], ties[order].tolist()


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, shard: int = SHARD) -> DataFrame:
    """Write all documents' ids below folder; returns a row for each shard: bucket, part, file, n_docs, n_tokens.

    Texts are encoded where they are read; only ids travel, compressed, to the
    bucket of their doc_id. Bounds between buckets are those of a sample of
    doc_ids; they set only how much each task gets. Null doc_ids come first;
    rows with the same doc_id lie side by side; a null or empty text has the
    end id alone; very long texts are one document of one shard. An empty table
    writes no file. Other columns are not read. The folder has a scheme, or is
    resolved as Spark does.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_null, bounds, between = _bounds(docs)

    def bucket_of(keys, first_tie: int) -> np.ndarray:
        import pyarrow.compute as pc

        missing = keys.is_null().to_numpy(zero_copy_only=False)
        known = pc.fill_null(keys, 0).to_numpy().astype(np.int64)
        # a tie is spread evenly by the row's place in its partition, and the same whenever the partition is read again
        ties = (np.arange(first_tie, first_tie + len(known), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(2)).astype(np.int64)
        low, high = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
        for k in np.flatnonzero(high > low):
            low[k] = bisect(between, ties[k], low[k], high[k])
        return np.where(missing, ties % n_null, n_null + low).astype(np.int32)

    def encode(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        z = zstandard.ZstdCompressor(level=1)
        row = TaskContext.get().partitionId() << 32
        for batch, first, ids in encoded(batches, vocabulary):
            keys = batch.column(0).slice(first, len(ids))
            bucket = bucket_of(keys, row)
            row += len(ids)
            small = [z.compress(x) for x in ids]
            yield pa.RecordBatch.from_arrays([keys, pa.array(bucket), pa.array(small, pa.binary())], ["doc_id", "bucket", "ids"])

    def shards(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import zstandard

        z = zstandard.ZstdDecompressor()
        end = END_ID.to_bytes(4, "little")
        keys, parts, total, part, bucket = [], [], 0, 0, None

        def flush():
            lengths = [len(x) // 4 for x in parts]
            name = f"tokens-{bucket:06d}-{part:06d}.wmx"
            file = save(folder, name, build(np.frombuffer(b"".join(parts), "<u4"), keys, lengths))
            columns = [[bucket], [part], [file], [len(keys)], [total]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["bucket", "part", "file", "n_docs", "n_tokens"])

        for batch in batches:
            for b, key, ids in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if parts and (total >= shard or b != bucket):
                    yield flush()
                    keys, parts, total, part = [], [], 0, part + 1 if b == bucket else 0
                bucket = b
                keys.append(key)
                parts.append(z.decompress(ids) + end)
                total += len(parts[-1]) // 4
        if parts:
            yield flush()

    dealt = docs.mapInArrow(encode, "doc_id long, bucket int, ids binary").repartitionById(n_null + len(bounds) + 1, F.col("bucket"))
    made = dealt.sortWithinPartitions(F.col("bucket"), F.asc_nulls_first("doc_id"), F.col("ids")).mapInArrow(shards, "bucket int, part int, file string, n_docs long, n_tokens long")
    return written(made, "wavelet-manifest")


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids_crc32; with_ids adds its ids."""
    before = lambda window: F.coalesce(F.sum("n_tokens").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # two steps: over at most as many buckets as were dealt, then within each
    buckets = manifest.groupBy("bucket").agg(F.sum("n_tokens").alias("n_tokens"))
    buckets = buckets.select("bucket", before(Window.orderBy("bucket")).alias("bucket_start"))
    placed = manifest.select("bucket", "file", before(Window.partitionBy("bucket").orderBy("part")).alias("in_bucket")).join(F.broadcast(buckets), "bucket")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = load(file)
                ids = own.ids.astype("<u4")
                ends = np.cumsum(own.lengths)
                starts = ends - own.lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                arrays = [pa.array(own.doc_ids, pa.int64()), pa.array(starts + start), pa.array(own.lengths), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    files = placed.select("file", (F.col("bucket_start") + F.col("in_bucket")).alias("start"))
    return files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "file").mapInArrow(run, schema)


def op10_wavelet_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, new_folder(spark, "wavelet")))
