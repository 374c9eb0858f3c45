"""Hard negatives by one-dimensional distance keys.

Vectors of whole numbers get one more place, so that all have the same length:
nearer then means a larger inner product. Every vector is stored under its
nearest pivot, sorted by (pivot, distance to it). A row within r of an anchor has
a key within r of the anchor's own distance to that pivot, so an anchor scans
key intervals, first short ones, then the annuli around what it has seen, until
no row beyond them can be among its best: the bound certifies the result.

Anchors are taken in blocks of ANCHORS, neighbours in the order of the keys
together; a block goes to all tasks, and each task scans what it has of the
index. Positives come first, then for each positive the best rows of other
labels in its window of scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.shared import new_folder, written

#: Anchors of a block; rows scored at a time; pivots, from a bounded sample of rows; rows of one index part.
ANCHORS, ROWS, PIVOTS, SAMPLE, PART = 4096, 512, 32, 4096, 1 << 14
#: Products of vectors below this are exact in doubles; others are taken in whole numbers of any size.
EXACT = 2.0**52
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "anchor int, slot int, vec_id long, score long"


def prepared(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, vec: rows that take part, each component x as floor(scale * x).

    Rows without id, label or vector, or with a component that is null, NaN or
    infinite, take none. Of rows with the same id the least by label and vector
    stays. Shorter vectors count as filled up with zeros. Other columns are not
    read.
    """
    x = F.col(vector).cast("array<double>")
    held = rows.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), x.alias("vec"))
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = held.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    # a double already; floor() would make it a long, which very large components are not
    whole = F.transform("vec", lambda v: F.when(F.abs(v * scale) < EXACT, F.floor(v * scale).cast("double")).otherwise(v * scale))
    return held.select("vec_id", "label", whole.alias("vec")).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def _matrix(column, places: int) -> np.ndarray:
    """A list column as rows of ``places`` numbers."""
    flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), places))
    out[np.arange(places) < sizes[:, None]] = flat
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        d = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(np.nan_to_num(d, nan=np.inf), 0))


def _augmented(x: np.ndarray, square: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.column_stack([x, np.sqrt(np.maximum(np.nan_to_num(square - (x**2).sum(1)), 0))])


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    """The first row, then always the row farthest from all chosen ones."""
    chosen, far = [0], _distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


class Index:
    """The stored table (part, pivot, key, vec_id, label, vec), with its pivots and the square of its longest vector."""

    def __init__(self, table: DataFrame, pivots: np.ndarray, square: float, places: int):
        self.table, self.pivots, self.square, self.places = table, pivots, square, places


def index(vectors: DataFrame, pivots: int = PIVOTS) -> Index | None:
    """Store all rows of prepared() sorted by (pivot, key); None for no rows. Pivots come from SAMPLE rows, those of the least hash; any pivots give the same results."""
    vectors = written(vectors, "negatives-vectors")
    squares = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)
    n, square, places = vectors.agg(F.count("*"), F.max(squares), F.max(F.size("vec"))).first()
    if not n:
        return None
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toArrow().column("vec").combine_chunks()
    chosen = _pivots(_augmented(_matrix(sample, places), square), pivots)
    held = vectors.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            d = _distances(_augmented(_matrix(batch.column(2), places), square), held.value)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), *batch.columns], ["pivot", "key", "vec_id", "label", "vec"])

    keyed = vectors.select("vec_id", "label", "vec").mapInArrow(run, "pivot int, key double, vec_id long, label long, vec array<double>")
    order = ["pivot", "key", "vec_id"]
    table = written(keyed.repartitionByRange(max(1, n // PART), *order).sortWithinPartitions(*order), "negatives-index")
    return Index(table, chosen, square, places)


class Block:
    """Anchors that are searched for together: ids, labels, vectors, and their distances to all pivots."""

    def __init__(self, ids: list[int], labels: list[int], vecs: list[list[float]], own: Index):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        self.x = np.zeros((len(ids), own.places))
        for k, v in enumerate(vecs):
            self.x[k, : len(v)] = v
        self.to_pivots = _distances(_augmented(self.x, own.square), own.pivots)


def radius(score: np.ndarray, square: float) -> np.ndarray:
    """The distance at which rows have this score, a little more for the rounding of keys."""
    with np.errstate(all="ignore"):
        d = np.sqrt(np.maximum(square + square - 2 * score, 0))
        return np.nan_to_num(d, nan=np.inf) * (1 + 1e-9) + 1e-6 * np.sqrt(square) + 1e-6


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs; those beyond a long's range become its ends."""
    if exact:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(q).dot(whole(x).T), LEAST, MOST).astype(np.int64)


def best(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each (anchor, slot): higher scores first, ties by smaller id."""
    order = np.lexsort((vec_id, ~score, slot, anchor))  # ~ turns the order of longs around without an overflow
    a, s = anchor[order], slot[order]
    fresh = np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1]))[: len(a)]
    firsts = np.flatnonzero(fresh)
    place = np.arange(len(a)) - np.repeat(firsts, np.diff(np.append(firsts, len(a))))
    return order[place < k]


def scan(own: Index, block: Block, done: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """anchor, slot, vec_id, score: for each anchor and slot the first k rows of the annulus.

    The annulus is what lies within ``reach`` but not within ``done`` of the
    anchor's distance to a row's pivot, by keys. Rows count if their label is
    the anchor's (same) or not, and their score is from low to high, one pair for
    each slot. An anchor never finds itself. Parts of the index that no interval
    meets are not read; a task holds ROWS rows and the block.
    """
    spark = own.table.sparkSession
    active = np.flatnonzero(reach > done)
    held = spark.sparkContext.broadcast((block.ids[active], block.labels[active], block.x[active], block.to_pivots[active], done[active], reach[active], low[active], high[active], active))
    exact = own.square < EXACT
    places = own.places

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        ids, labels, x, to_pivots, done, reach, low, high, names = held.value
        slots = low.shape[1]
        kept = [np.zeros(0, np.int64) for _ in range(4)]
        bar = np.full(low.shape, LEAST, np.int64)
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part = batch.slice(first, ROWS)
                pivot, key = np.asarray(part.column(0)), np.asarray(part.column(1))
                with np.errstate(invalid="ignore"):
                    gap = np.nan_to_num(np.abs(to_pivots[:, pivot] - key), nan=0.0, posinf=np.inf)  # distances too long for a double tell nothing
                fresh = (gap <= reach[:, None]) & ((gap > done[:, None]) | (done[:, None] < 0))
                who = np.flatnonzero(fresh.any(1))
                what = np.flatnonzero(fresh.any(0))
                if not len(who):
                    continue
                vec_id, label = np.asarray(part.column(2))[what], np.asarray(part.column(3))[what]
                s = products(x[who], _matrix(part.column(4).take(pa.array(what)), places), exact)
                fresh = fresh[np.ix_(who, what)] & ((labels[who][:, None] == label) == same) & (ids[who][:, None] != vec_id)
                new = []
                for slot in range(slots):
                    fits = fresh & (s >= np.maximum(low[who, slot], bar[who, slot])[:, None]) & (s <= high[who, slot][:, None])
                    a, b = np.nonzero(fits)
                    if len(a):
                        new.append((who[a], np.full(len(a), slot), s[a, b], vec_id[b]))
                if not new:
                    continue
                kept = [np.concatenate([o, *(n[c] for n in new)]) for c, o in enumerate(kept)]
                keep = best(*kept, k)
                kept = [c[keep] for c in kept]
                # what comes later counts only at the score of the last one kept, or above
                full, counts = np.unique(kept[0] * slots + kept[1], return_counts=True)
                last = np.cumsum(counts) - 1
                ready = counts == k
                bar[full[ready] // slots, full[ready] % slots] = kept[2][last[ready]]
        if len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(names[kept[0]].astype(np.int32)), pa.array(kept[1].astype(np.int32)), pa.array(kept[3]), pa.array(kept[2])], ["anchor", "slot", "vec_id", "score"])

    # one interval of keys for each pivot covers what the block still needs: others are not read from the files
    need = F.lit(not np.isfinite(own.square))
    for p in range(len(own.pivots)) if np.isfinite(own.square) else ():
        near = block.to_pivots[active, p]
        need = need | ((F.col("pivot") == p) & F.col("key").between(float((near - reach[active]).min()), float((near + reach[active]).max())))
    return own.table.where(need).select("pivot", "key", "vec_id", "label", "vec").mapInArrow(run, FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and slot, with rank from 1."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def search(own: Index, block: Block, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """anchor, slot, rank, vec_id, score: the certified first k rows of every anchor and slot whose score is from low to high.

    Each round scans new annuli only and is written; its few best rows meet
    those of the rounds before. An anchor is done when its intervals reach the
    distance of each slot's k-th best row, or that of the slot's least score.
    Where a slot has too few rows yet, the reach is doubled.
    """
    spark = own.table.sparkSession
    n, slots = low.shape
    with np.errstate(all="ignore"):
        whole = float(np.nan_to_num(2 * np.sqrt(own.square) * (1 + 1e-6) + 1, posinf=np.inf)) + 1
    bound = np.where(high < low, 0.0, np.minimum(radius(low.astype(float), own.square), whole))
    open_ = high >= low
    done, found = np.full(n, -1.0), None
    top = np.where(open_, np.minimum(radius(high.astype(float), own.square), whole), 0)
    reach = np.where(open_.any(1), np.minimum(np.maximum(top.max(1), whole / 16), np.where(open_, bound, 0).max(1)), -1.0)
    while (reach > done).any():
        new = scan(own, block, done, reach, low, high, same, k)
        found = written(first_of(new if found is None else found.select("anchor", "slot", "vec_id", "score").unionByName(new), k), "negatives-found")
        state = found.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("last")).toPandas()  # a row for each anchor of the block and slot
        last, full = np.zeros((n, slots)), np.zeros((n, slots), bool)
        at = (state["anchor"].to_numpy(int), state["slot"].to_numpy(int))
        last[at], full[at] = state["last"].to_numpy(float), state["n"].to_numpy() == k
        done = np.maximum(done, reach)
        sure = np.minimum(bound, radius(last, own.square))
        need = np.where(open_, np.where(full, sure, np.minimum(bound, np.maximum(2 * done, whole / 16)[:, None])), 0).max(1)
        reach = np.where(open_.any(1), np.minimum(need, whole), -1.0)
    if found is None:
        return spark.createDataFrame([], FOUND + ", rank int")
    return found


def _blocks(anchors: DataFrame, own: Index) -> Iterator[Block]:
    """Anchors in the order of their keys, ANCHORS at a time: the driver holds one block and one part of the index's order."""
    ids, labels, vecs = [], [], []
    for r in anchors.toLocalIterator():
        ids.append(r.vec_id)
        labels.append(r.label)
        vecs.append(r.vec)
        if len(ids) == ANCHORS:
            yield Block(ids, labels, vecs, own)
            ids, labels, vecs = [], [], []
    if ids:
        yield Block(ids, labels, vecs, own)


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over rows of prepared().

    Anchors are the rows for which the condition holds; their positives the
    first other rows of the same label; negatives of a positive the first rows
    of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score. Anchors without positives, and positives without negatives,
    give no rows. Each block's rows are appended to one table, so a failure
    costs one block's tasks.
    """
    spark = vectors.sparkSession
    own = index(vectors)
    if own is None:
        return spark.createDataFrame([], SCHEMA)
    folder = new_folder(spark, "negatives")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    chosen = own.table.where(anchors).select("pivot", "key", "vec_id", "label", "vec").orderBy("pivot", "key", "vec_id").select("vec_id", "label", "vec")
    for block in _blocks(chosen, own):
        n = len(block.ids)
        every = np.full((n, 1), LEAST, np.int64), np.full((n, 1), MOST, np.int64)
        pos = search(own, block, *every, True, positives)
        held = pos.select("anchor", "rank", "score").toPandas()  # ``positives`` rows for each anchor of the block
        # slots without a positive have a window that nothing fits
        least, most = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)
        score = [int(x) for x in held["score"]]
        at = (held["anchor"].to_numpy(int), held["rank"].to_numpy(int) - 1)
        least[at], most[at] = [max(LEAST, -(-low * x // 100)) for x in score], [min(MOST, high * x // 100) for x in score]
        neg = search(own, block, least, most, False, negatives)
        names = spark.createDataFrame([(k, int(v)) for k, v in enumerate(block.ids)], "anchor int, anchor_id long")
        left = pos.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(F.broadcast(names), "anchor")
        right = neg.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        left.join(right, ["anchor", "slot"]).select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("append").parquet(folder)
    return spark.read.schema(SCHEMA).parquet(folder)


def op13_distance_key_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepared(rows, label=label), F.col("vec_id") % 100 == 0)


SQL = """WITH rows_ AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM rows_ a, rows_ b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""
