"""Harmonic packing of documents into token sequences.

A document of n ids belongs to class k = floor(capacity / n): lengths from
capacity/(k+1), exclusive, to capacity/k. Each class fills one open bin with
exactly k documents. A full bin's rest, where it is worth a cut, waits for a
filler: a document longer than a sequence, which has to be cut anyway, or one
of class 1 when many bins wait. Every partition packs by itself, so no row is
shuffled; what is left at its end is poured together, and the last sequence is
cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.tokens import END_ID, default_vocabulary, encoded

CAPACITY = 2048
#: Documents shorter than capacity / MOST share one class.
MOST = 64
#: A rest shorter than this is padded and not filled.
WORTH = 16
#: Waiting bins from which class 1, and from which any document, is cut to fill them.
SOME, MANY = 32, 64
END = END_ID.to_bytes(4, "little")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int"


class Packer:
    """Packs one stream of documents. A piece is [doc_id, start, ids, doc_tokens]; ids are 4 bytes each."""

    def __init__(self, capacity: int = CAPACITY, first_id: int = 0):
        self.capacity, self.next = capacity, first_id
        self.open: dict[int, list[list]] = {}
        self.waiting: deque[tuple[int, list[list], int]] = deque()  # class, pieces, rest
        self.done: list[tuple] = []

    def _close(self, pieces: list[list], kind: int) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, zlib.crc32(ids), total, self.next, at, kind, ids))
            at += n
        self.next += 1

    def _fill(self, piece: list) -> list | None:
        """Cut the piece to fill bins that wait; what is left of it."""
        while self.waiting:
            kind, pieces, rest = self.waiting.popleft()
            doc_id, start, ids, total = piece
            pieces.append([doc_id, start, ids[: rest * 4], total])
            n = len(ids) // 4
            if n < rest:
                self.waiting.appendleft((kind, pieces, rest - n))
                return None
            self._close(pieces, kind)
            if n == rest:
                return None
            piece = [doc_id, start + rest, ids[rest * 4 :], total]
        return piece

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, most = len(ids) // 4, self.capacity
        piece = [doc_id, 0, ids, n]
        if n > most or len(self.waiting) >= (SOME if 2 * n > most else MANY):
            piece = self._fill(piece)
            if piece is None:
                return
            doc_id, start, ids, total = piece
            whole = len(ids) // 4 // most * most
            for k in range(0, whole, most):
                self._close([[doc_id, start + k, ids[k * 4 : (k + most) * 4], total]], 1)
            if whole * 4 == len(ids):
                return
            piece = [doc_id, start + whole, ids[whole * 4 :], total]
        n = len(piece[2]) // 4
        kind = min(most // n, MOST)
        bin_ = self.open.setdefault(kind, [])
        bin_.append(piece)
        if len(bin_) == kind:
            del self.open[kind]
            rest = most - sum(len(p[2]) // 4 for p in bin_)
            if rest < WORTH or rest == most // 2:
                self._close(bin_, kind)
            else:
                self.waiting.append((kind, bin_, rest))

    def finish(self) -> None:
        """Pour what is left together; the last sequence ends in powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        left = [p for _, pieces, _ in self.waiting for p in pieces] + left
        self.open, self.waiting = {}, deque()
        room = sum(len(p[2]) // 4 for p in left)
        size = self.capacity
        pieces, rest = [], 0
        for doc_id, start, ids, total in left:
            while ids:
                if not rest:
                    if pieces:
                        self._close(pieces, 0)
                        pieces = []
                    while size > room:
                        size //= 2
                    rest, room = size, room - size
                cut = ids[: rest * 4]
                pieces.append([doc_id, start, cut, total])
                rest -= len(cut) // 4
                start, ids = start + len(cut) // 4, ids[len(cut) :]
        if pieces:
            self._close(pieces, 0)

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with_ids adds each piece's ids as an array.

    A null or empty text has the end id alone. Null and repeated doc_ids are
    packed row by row like any other, ties included; an empty table gives no
    rows; other columns are not read. capacity has to be a power of two. Long
    texts are cut over as many sequences as they need.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.int32()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*rows)]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            if not with_ids:
                return pa.RecordBatch.from_arrays(arrays, names)
            ids = columns[8]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, [*names, "ids"])

        for batch, first, ids in encoded(batches, vocabulary):
            for doc_id, own in zip(batch.column(0).slice(first, len(ids)).to_pylist(), ids, strict=True):
                packer.add(doc_id, own + END)
            if rows := packer.take():
                yield table(rows)
        packer.finish()
        if rows := packer.take():
            yield table(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def op1_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
