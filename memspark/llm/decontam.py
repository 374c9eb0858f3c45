"""Benchmark passages in documents, up to an edit budget.

An item of n characters may be met with n // PIECE edits. Cut into one piece
more than that, at least one piece survives untouched (pigeonhole), so exact
hits of pieces, found for all items in one automaton, are the only places
where the item can be. There Myers' bit-parallel algorithm, with one integer
for a column, gives the distance: first for the hit piece with its neighbour,
which may differ by one edit together, then for four pieces with three edits,
and so on up to the item. (If two halves both had more edits than pieces less
one, so had the whole; so some piece of every match passes at all levels.)
Texts and items are compared in lower case with each run of white space as one
space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Characters of an item for each edit it is allowed; pieces have about so many.
PIECE = 12
#: Characters of items in one pass over the documents; more items take more passes.
BLOCK = 16_000_000


def plain(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str) -> list[tuple[int, str]]:
    """(start, text) of edit budget + 1 pieces of nearly equal lengths."""
    n, k = len(item), len(item) // PIECE + 1
    edges = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def columns(item: str) -> dict[str, int]:
    """For each character the set of its places, as bits."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def distance(peq: dict[str, int], n: int, text: str, budget: int) -> tuple[int, int] | None:
    """Smallest edit distance of the item to any part of the text, with that part's first end; None if over the budget."""
    full, high = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = full, 0, n, budget + 1, -1
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | ~(xh | up) & full
        minus = up & xh
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
                if not best:
                    break
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(xv | plus) & full
        down = plus & xv
    return (best, end) if best <= budget else None


class Matcher:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t, columns(t)) for i, t in items if t]
        self.parts: dict[tuple[int, int, int], dict[str, int]] = {}
        where: dict[str, list[tuple[int, int, list]]] = defaultdict(list)
        for k, (_, text, _) in enumerate(self.items):
            own = pieces(text)
            ends = [*(start for start, _ in own), len(text)]
            for i, (start, piece) in enumerate(own):
                levels, a, b = [], 0, len(own)
                while b - a > 1:
                    if b - a < len(own):
                        levels.append((a, b))
                    mid = (a + b) // 2
                    a, b = (a, mid) if i < mid else (mid, b)
                where[piece].append((k, start, self._levels(text, ends, i, levels[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    @staticmethod
    def _levels(text: str, ends: list[int], hit: int, spans: list[tuple[int, int]]) -> list[tuple]:
        """(start, end, budget, halves): of the halves of the other pieces of the smallest part, one is untouched, as there are more of them than edits."""
        out = []
        for a, b in spans:
            cuts = [(ends[j], (ends[j] + ends[j + 1]) // 2, ends[j + 1]) for j in range(a, b) if j != hit] if not out else []
            out.append((ends[a], ends[b], b - a - 1, [(x, text[x:y]) for p, q, r in cuts for x, y in ((p, q), (q, r))]))
        return out

    def _near(self, k: int, level: tuple, text: str, shift: int) -> bool:
        """Whether a part of the item is within its budget of the text that lies there at this shift."""
        a, b, budget, halves = level
        if halves and not any(text.find(half, max(0, shift + x - budget), max(0, shift + x + len(half) + budget)) >= 0 for x, half in halves):
            return False
        if text.startswith(self.items[k][1][a:b], max(0, shift + a)) and shift + a >= 0:
            return True
        peq = self.parts.get((k, a, b))
        if peq is None:
            peq = self.parts[(k, a, b)] = columns(self.items[k][1][a:b])
        return distance(peq, b - a, text[max(0, shift + a - budget) : max(0, shift + b + budget)], budget) is not None

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of each item met: its nearest place, then the first; offsets in the plain text."""
        text = plain(text)
        if not text or not self.items:
            return []
        shifts: dict[int, list[int]] = defaultdict(list)
        for last, (size, places) in self.automaton.iter(text):
            for k, start, levels in places:
                shift = last + 1 - size - start
                if all(self._near(k, level, text, shift) for level in levels):
                    shifts[k].append(shift)
        out = []
        for k, at in shifts.items():
            item_id, item, peq = self.items[k]
            n, budget = len(item), len(item) // PIECE
            best = None
            first, last = None, None
            for s in [*sorted(at), None]:
                if first is not None and (s is None or s - budget > last):
                    begin = max(0, first)
                    if (exact := text.find(item, begin, last)) >= 0 and (best is None or best[0]):
                        best = (0, exact + n)
                    elif best and not best[0]:
                        pass
                    elif (got := distance(peq, n, text[begin:last], budget)) and (best is None or got[0] < best[0]):
                        best = (got[0], begin + got[1])
                    first = None
                if s is None:
                    break
                first = s - budget if first is None else first
                last = s + n + budget
            if best:
                # the same from its end backwards gives the start
                far, end = best
                back = distance(columns(item[::-1]), n, text[max(0, end - n - far) : end][::-1], far)[1] if far else n
                out.append((item_id, end - back, end, far))
        return sorted(out)


@lru_cache(maxsize=2)
def _matcher(broadcast_id: int, holder) -> Matcher:
    return Matcher(holder.value)


class _Held:
    """A broadcast that the cache tells apart by its id alone."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return isinstance(other, _Held)

    @property
    def value(self):
        return self.broadcast.value


def item_blocks(items: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items, some BLOCK characters at a time. Null and empty ones match nothing and are left out."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.length(F.trim("text")) > 0)
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block)
    for k in range(n):
        yield [(r.item_id, plain(r.text)) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator()]


def matches(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, end, distance for each document and item it has.

    Null and empty texts have none; very long ones are read whole. An item's
    nearest place counts, of equal ones the first. Repeated documents and items
    each give their rows. Items are held by the driver and by each worker one
    block at a time (BLOCK characters); more items take more passes.
    Columns beyond doc_id and text, item_id and text, are not read; an empty
    table on either side gives no rows.
    """
    schema = "doc_id long, item_id long, start long, end long, distance long"
    spark, out = docs.sparkSession, None
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def run(held: _Held, key: int):
        def go(batches: Iterable) -> Iterator:
            import pyarrow as pa

            own = _matcher(key, held)
            for batch in batches:
                rows = [(doc_id, *hit) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in own.find(text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "start", "end", "distance"])

        return go

    for part in item_blocks(items, block):
        shared = spark.sparkContext.broadcast(part)
        found = docs.mapInArrow(run(_Held(shared), shared._jbroadcast.id()), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that have no item, in their own columns; nothing is shuffled.

    Null and empty texts have none and stay, rows that repeat stay or go
    together, very long texts are read whole; without items all stay. Null
    doc_ids are values like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession

    def run(held: _Held, key: int):
        def go(batches: Iterable) -> Iterator:
            import pyarrow as pa

            own = _matcher(key, held)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not own.find(text.as_py()) for text in texts], pa.bool_()))

        return go

    for part in item_blocks(items, block):
        shared = spark.sparkContext.broadcast(part)
        docs = docs.mapInArrow(run(_Held(shared), shared._jbroadcast.id()), docs.schema)
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
