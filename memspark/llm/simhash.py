"""Near-duplicates by SimHash fingerprints and a trie self-join.

Fingerprints within two bits agree on one of three blocks of bits (two errors
cannot touch all three). For each block the fingerprints, turned so that the
block leads, form a binary trie; a subtrie below one block value is joined with
itself: pairs of nodes go down together, differing bits add up, and a pair over
the budget is dropped with all below it. Only distinct fingerprints are joined,
so a ball of two bits bounds what one can meet, and each task passes on a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.graph import components, met
from memspark.llm.shared import written

SEED = 42
SHINGLE = 3
BUDGET = 2
#: Widths of the leading block, and the turns that bring each to the front.
BLOCKS = ((22, 0), (21, 22), (21, 43))
TOP = 42
#: Distinct fingerprints below one block value from which its subtrie is dealt out by pairs of nodes SPLIT levels down.
HOT = 50_000
SPLIT = 8
#: Block values over HOT that are broadcast at most.
BROADCAST_KEYS = 100_000
#: Node pairs that are taken down a level at once, and fingerprints of one array.
PAIRS, ROWS = 1 << 20, 1 << 16
#: Shingles whose bits are summed at once.
SHINGLES = 1 << 15


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints; zero for texts without words."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    starts: list[int] = []
    rows: list[int] = []

    def votes() -> None:
        each = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(np.unpackbits(each, axis=1), starts, axis=0, dtype=np.int64)
        sizes = np.diff([*starts, len(hashes)])
        bits = np.packbits(2 * sums > sizes[:, None], axis=1)
        out[rows] = bits.copy().view(">u8").ravel()
        hashes.clear(), starts.clear(), rows.clear()

    for row, text in enumerate(texts):
        words = text.lower().split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            own = [xxh64_intdigest(joined, SEED)]
        else:
            ends = np.cumsum([len(w) + 1 for w in words])
            own = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip([0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        if len(own) > SHINGLES:  # a text of its own, summed in parts
            sums = sum(np.unpackbits(np.array(own[k : k + SHINGLES], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) for k in range(0, len(own), SHINGLES))
            out[row] = np.packbits(2 * sums > len(own)).view(">u8")[0]
            continue
        starts.append(len(hashes))
        rows.append(row)
        hashes.extend(own)
        if len(hashes) > SHINGLES:
            votes()
    if hashes:
        votes()
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""
    return _fingerprinted(docs.select(F.col("doc_id").cast("long"), "text"), "long")


def _fingerprinted(docs: DataFrame, kind: str) -> DataFrame:

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            for k in range(0, len(texts), 256):
                fp = fingerprints(texts.slice(k, 256).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def trie_pairs(x: np.ndarray, roots: np.ndarray, budget: int = BUDGET, top: int = TOP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in x within the budget, below the given pairs of nodes.

    x is sorted below each node. A row of roots is (start, end, start, end,
    differing bits so far): two nodes whose values agree but for those bits
    above bit ``top``.
    """
    before: dict[int, np.ndarray] = {}
    stack = [(top, roots.astype(np.int64))]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > PAIRS:
            half = len(pairs) // 2
            stack += [(bit, pairs[:half]), (bit, pairs[half:])]
            continue
        a0, a1, b0, b1, d = pairs.T
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            rest = (x[i] ^ x[j]) & np.uint64((1 << (bit + 1)) - 1)
            near = (i != j) & (d[single] + np.bitwise_count(rest) <= budget)
            yield i[near], j[near]
            a0, a1, b0, b1, d = pairs[~single].T
        if not len(a0):
            continue
        if bit < 0:
            # distinct values end in single nodes; what is left are equal ones
            raise ValueError("values repeat")
        if bit not in before:
            before[bit] = np.concatenate([[0], np.cumsum(x >> np.uint64(bit) & np.uint64(1), dtype=np.int64)])
        ones = before[bit]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        apart = ~same
        down = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1), tuple(v[apart] for v in (am, a1, b0, bm, d + 1))]
        nodes = np.concatenate([np.stack(v, 1) for v in down])
        full = (nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2]) & (nodes[:, 4] <= budget)
        full &= ~((nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] - nodes[:, 0] == 1) & (nodes[:, 3] == nodes[:, 1]))
        if full.any():
            stack.append((bit - 1, nodes[full]))


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest place that the pairs tie it to."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def _turned(values: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Bits turned left, for each value by its own count."""
    left = left.astype(np.uint64)
    return np.where(left > 0, values << left | values >> (np.uint64(64) - np.maximum(left, 1)), values)


def links(distinct: DataFrame) -> DataFrame:
    """a, b: a spanning forest, for each subtrie, of the links between distinct fingerprints (column fp)."""
    spark = distinct.sparkSession
    turned = lambda s: F.col("fp") if not s else F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", 64 - s))
    each = F.array(*(F.struct(F.shiftrightunsigned(turned(s), 64 - w).bitwiseOR(F.lit(k << 22).cast("long")).alias("key"), turned(s).alias("x")) for k, (w, s) in enumerate(BLOCKS)))
    rows = distinct.select(F.explode(each).alias("r")).select("r.key", F.lit(0).alias("sub"), "r.x")
    hot = written(rows.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot-blocks")
    if n_hot := hot.count():
        # a hot subtrie: its nodes SPLIT levels down, in all pairs within the budget
        marks = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        below = F.shiftrightunsigned("x", TOP + 1 - SPLIT).cast("int").bitwiseAND(F.lit((1 << SPLIT) - 1))
        near = F.array(*(F.lit(m) for m in range(1 << SPLIT) if m.bit_count() <= BUDGET))
        other = below.bitwiseXOR(F.col("m"))
        dealt = rows.join(marks, "key", "left_semi").select("key", "x", F.explode(near).alias("m")).select("key", (1 + F.least(below, other) * (1 << SPLIT) + F.greatest(below, other)).alias("sub"), "x")
        rows = rows.join(marks, "key", "left_anti").unionByName(dealt)

    def join(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def flush(key: np.ndarray, sub: np.ndarray, x: np.ndarray):
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])]))
            last = np.append(first[1:], len(key))
            some = last - first > 1
            first, last = first[some], last[some]
            if not len(first):
                return None
            unsigned = x.view(np.uint64)
            roots = np.stack([first, last, first, last, np.zeros_like(first)], 1)
            pair = sub[first] - 1
            low, high = pair >> SPLIT, pair & ((1 << SPLIT) - 1)
            for k in np.flatnonzero((pair >= 0) & (low != high)):
                own = (unsigned[first[k] : last[k]] >> np.uint64(TOP + 1 - SPLIT)).astype(np.int64) & ((1 << SPLIT) - 1)
                cut = first[k] + int((own == low[k]).sum())
                roots[k] = first[k], cut, cut, last[k], int(low[k] ^ high[k]).bit_count()
            roots = roots[(roots[:, 1] > roots[:, 0]) & (roots[:, 3] > roots[:, 2])]
            split = roots[roots[:, 0] != roots[:, 2]]
            tied = [trie_pairs(unsigned, roots[roots[:, 0] == roots[:, 2]])]
            if len(split):
                tied.append(trie_pairs(unsigned, split, top=TOP - SPLIT))
            root = forest(len(x), (p for t in tied for p in t))
            moved = np.flatnonzero(root != np.arange(len(x)))
            if not len(moved):
                return None
            back = np.array([s for _, s in BLOCKS])[key[moved] >> 22]
            ends = [_turned(unsigned[v], (64 - back) % 64).view(np.int64) for v in (root[moved], moved)]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in ends], ["a", "b"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            size += len(batch)
            if size > ROWS:
                key, sub, x = (np.concatenate(v) for v in zip(*held, strict=True))
                whole = int(np.flatnonzero((key != key[-1]) | (sub != sub[-1]))[-1]) + 1 if ((key != key[-1]) | (sub != sub[-1])).any() else 0
                if whole and (out := flush(key[:whole], sub[:whole], x[:whole])) is not None:
                    yield out
                held, size = [(key[whole:], sub[whole:], x[whole:])], len(key) - whole
        if size and (out := flush(*(np.concatenate(v) for v in zip(*held, strict=True)))) is not None:
            yield out

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "sub").sortWithinPartitions("key", "sub", "x").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row.

    A null text is an empty one: fingerprint zero, linked like any other.
    component_id is the smallest non-null doc_id reachable; rows that repeat a
    doc_id each get a result, very long texts are read whole, an empty table
    gives no rows. Columns beyond doc_id and text are not read.
    """
    fps = written(fingerprinted(docs), "fingerprints")
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-fingerprints")
    n_distinct, n_rows = first.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tied = components(links(first))
    rooted = written(first.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    named = written(met(rooted, least, "root", n_distinct).select("fp", "component_id", F.col("rows").alias("n")), "fingerprint-components")
    return met(fps, named, "fp", n_rows).select("doc_id", "fp", "component_id")


def rooted(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text) and root (a fingerprint, the same throughout a component) of every row."""
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key")).alias("doc_id"), "text")
    fps = written(_fingerprinted(keyed, "struct<doc_id:long,key:long>").select("doc_id.*", "fp"), "fingerprints")
    first = written(fps.groupBy("fp").agg(F.count("*").alias("n")), "distinct-fingerprints")
    n_rows = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tied = components(links(first))
    named = written(first.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    return met(fps, named, "fp", n_rows).select("doc_id", "key", "root")


def dedup_stage(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = rooted) -> DataFrame:
    """One document of each component that ``find`` gives, the one with its smallest doc_id, in its own columns; one of repeated rows.

    A component without any doc_id keeps one row. A row that is not its
    component's choice goes, whatever other rows its doc_id has; texts that are
    not linked all stay, also under one doc_id. A null text is one without
    words. Very long texts travel whole; an empty table gives no rows.
    """
    found = find(docs).groupBy("root", "doc_id", "key").agg(F.count("*").alias("rows"))
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rows")).alias("r")).select("r.*")
    kept = written(chosen.select("doc_id", "key", "rows"), "kept-documents")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_key"))
    ids = lambda of: of.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    # ids are never few enough to broadcast at scale: at every size texts are shuffled once and met by a hash of ids, unsorted
    out = docs.join(ids(kept).hint("shuffle_hash"), same, "left_semi")
    if kept.where("rows > 1").limit(1).count():
        # rows that repeat: few, and the only ones dealt out again
        many = ids(kept.where("rows > 1"))
        names = docs.columns
        one = out.join(many, same, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(F.struct(*names), F.coalesce("text", F.lit(""))).alias("row")).select(*(F.col("row")[c].alias(c) for c in names))
        out = out.join(many, same, "left_anti").unionByName(one)
    return out


def op5_simhash_trie(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
