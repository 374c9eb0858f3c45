"""Near-duplicates by the Jaccard similarity of five-word shingles.

Texts are sets of shingle hashes. Each set has a SimHash fingerprint; those
that the trie self-join of simhash.py links are candidates. Two bits are far
tighter than the limit, so for the rest minima of the set under HASHES
multipliers are hashed in bands; sets that share a band are candidates too (a
pair at the limit of 0.8 shares none of the 24 bands in 7 of 100,000 cases, a
closer one more seldom). Distinct sets are compared, exactly, in two steps.
First each with the sets that the trie gives and with its bands' smallest set:
that settles pairs and ties most of a large group of copies. Then only bands whose sets are not all tied are left. Their groups,
closed under shared bands, are compared within but for pairs that are tied; of
a group over CHUNK sets, blocks of the sets outside its largest tied part meet
blocks of that part and each other, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.graph import components, met
from memspark.llm.shared import written
from memspark.llm.simhash import links

SEED = 42
SHINGLE = 5
SIMILAR = 0.8
BANDS, DEPTH = 24, 5
HASHES = BANDS * DEPTH
#: Shingles whose minima are taken at once.
SHINGLES = 1 << 15
#: Sets of a block; a task holds two at most.
CHUNK = 4096
#: Sets compared with their star in one task.
RAYS = 512


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingled(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; none for a text without words, one for a short one."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    own = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip([0, *ends[:-SHINGLE].tolist()], (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.array(own, np.uint64))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set the least product with each multiplier."""
    out = np.empty((len(sets), HASHES), np.uint64)
    multipliers = _multipliers()
    at = 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= SHINGLES:
            size += len(sets[end])
            end += 1
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        own = np.concatenate(sets[at:end])
        for k, m in enumerate(multipliers):
            out[at:end, k] = np.minimum.reduceat(own * m, starts)
        at = end
    return out


def banded(sets: list[np.ndarray]) -> list[list[int]]:
    """The hashes of each set's bands, the band's number among what is hashed; none for an empty set."""
    from xxhash import xxh64_intdigest

    full = [k for k, s in enumerate(sets) if len(s)]
    out: list[list[int]] = [[] for _ in sets]
    if full:
        for k, row in zip(full, minima([sets[k] for k in full]), strict=True):
            raw = row.tobytes()
            out[k] = [xxh64_intdigest(raw[8 * DEPTH * b : 8 * DEPTH * (b + 1)], b) - (1 << 63) for b in range(BANDS)]
    return out


def fingerprint(own: np.ndarray) -> int:
    """The set's SimHash fingerprint, as a signed number: a bit is 1 if it is set in over half the hashes."""
    each = (np.unpackbits(own[k : k + SHINGLES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1) for k in range(0, len(own), SHINGLES))
    sums = sum((bits.sum(0, dtype=np.int32) for bits in each), np.zeros(64, np.int64))
    return int(np.packbits(2 * sums > len(own)).view(">i8")[0])


def set_hash(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity; in whole numbers, so the limit itself counts."""
    if 10 * min(len(a), len(b)) < round(10 * SIMILAR) * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * common >= round(10 * SIMILAR) * (len(a) + len(b) - common)


def tied(sets: list[np.ndarray], parts: list[int] | None = None) -> np.ndarray:
    """For each set the first place that similar pairs, among those that share a band, tie it to; sets of one part are tied already."""
    root = np.arange(len(sets))
    if parts:
        first: dict[int, int] = {}
        root = np.array([first.setdefault(part, k) for k, part in enumerate(parts)])
    sizes = np.array([len(s) for s in sets])
    met: dict[int, list[int]] = defaultdict(list)
    for k, bands in enumerate(banded(sets)):
        for band in bands:
            met[band].append(k)
    for members in {tuple(m) for m in met.values() if len(m) > 1}:
        places = np.array(members)
        for n, i in enumerate(members[1:], 1):
            before = places[:n]
            near = 10 * np.minimum(sizes[before], sizes[i]) >= round(10 * SIMILAR) * np.maximum(sizes[before], sizes[i])
            for j in before[near & (root[before] != root[i])].tolist():
                if root[i] != root[j] and similar(sets[i], sets[j]):
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
    return root


def _binary(texts):
    import pyarrow as pa

    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), fp (a hash of its set), sim (its fingerprint) and bands of every row."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = _binary(batch.column(2))
            for k in range(0, len(texts), 256):
                sets = [shingled(t) for t in texts.slice(k, 256).to_pylist()]
                fp, sim = (pa.array([of(s) for s in sets], pa.int64()) for of in (set_hash, fingerprint))
                bands = pa.array(banded(sets), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), batch.column(1).slice(k, 256), fp, sim, bands], ["doc_id", "key", "fp", "sim", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key long, fp long, sim long, bands array<long>")


def _dealt(texts: DataFrame, *more: str) -> DataFrame:
    """Texts (fp, text and an array of places) at each of their places, in order of fp, the first set of a place marked by y = -1."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = texts.select("fp", F.explode("places").alias("p"), *more, "text").select("p.group", "p.x", "p.y", "fp", *more, "text")
    return at.repartition(n, "group", "x", F.greatest("y", F.lit(0)))


def starred(texts: DataFrame) -> DataFrame:
    """a, b: sets (fp of texts) similar to the set of their star. A place has the star's set first, marked by y = -1."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        star, own = None, None
        for batch in batches:
            a, b = [], []
            for group, y, fp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), _binary(batch.column(3)), strict=True):
                if y < 0:
                    star, own = group, shingled(text.as_py())
                elif star == group and similar(own, shingled(text.as_py())):
                    a.append(group)
                    b.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _dealt(texts).sortWithinPartitions("group", "x", "y", "fp").select("group", "y", "fp", "text").mapInArrow(run, "a long, b long")


def settled(texts: DataFrame) -> DataFrame:
    """a, b: ties between sets of a place that similar pairs bring together, besides those of one part (column part)."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def out(fps: list[int], parts: list[int], sets: list[np.ndarray]):
            root = tied(sets, parts)
            first: dict[int, int] = {}
            own = np.array([first.setdefault(part, k) for k, part in enumerate(parts)])
            moved = np.flatnonzero((root != np.arange(len(sets))) & (own == np.arange(len(sets))))
            fp = np.array(fps, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fp[root[moved]]), pa.array(fp[moved])], ["a", "b"])

        place, fps, parts, sets = None, [], [], []
        for batch in batches:
            for *at, fp, part, text in zip(*(batch.column(k).to_pylist() for k in range(5)), _binary(batch.column(5)), strict=True):
                if at != place:
                    if len(fps) > 1:
                        yield out(fps, parts, sets)
                    place, fps, parts, sets = at, [], [], []
                fps.append(fp)
                parts.append(part)
                sets.append(shingled(text.as_py()))
        if len(fps) > 1:
            yield out(fps, parts, sets)

    return _dealt(texts, "part").sortWithinPartitions("group", "x", "y", "fp").select("group", "x", "y", "fp", "part", "text").mapInArrow(run, "a long, b long")


def _blocks(sets: DataFrame, n_rows: int) -> DataFrame:
    """fp, part and places of sets (fp, part, group): the pairs of blocks at which each is compared."""
    parts = sets.groupBy("group", "part").agg(F.count("*").alias("k"))
    sizes = parts.groupBy("group").agg(F.max_by("part", F.struct("k", "part")).alias("main"), F.max("k").alias("k"), F.sum("k").alias("n"))
    blocks = lambda k: F.ceil(k / F.lit(CHUNK)).cast("int")
    sizes = sizes.select("group", "main", "n", F.when(F.col("n") <= CHUNK, 0).otherwise(blocks(F.col("k"))).alias("mains"), F.greatest(F.lit(1), blocks(F.col("n") - F.col("k"))).alias("rests"))
    own = F.xxhash64("fp", F.lit("block"))
    place = lambda x, y: F.struct(F.col("group"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    in_main, in_rest = F.pmod(own, F.col("mains")), F.pmod(own, F.col("rests")) + F.col("mains")
    main = F.transform(up_to(F.col("rests")), lambda j: place(in_main, j + F.col("mains")))
    rest = F.concat(
        F.transform(up_to(F.col("mains")), lambda i: place(i, in_rest)),
        F.transform(up_to(F.col("rests")), lambda j: place(F.least(j + F.col("mains"), in_rest), F.greatest(j + F.col("mains"), in_rest))),
    )
    whole = F.array(place(F.lit(0), F.lit(0)))
    placed = met(sets, sizes, "group", n_rows)
    return placed.select("fp", "part", F.when(F.col("mains") == 0, whole).when(F.col("part") == F.col("main"), main).otherwise(rest).alias("places"))


def by_trie(sets: DataFrame) -> DataFrame:
    """a, fp: of sets (fp, sim) those of one fingerprint with its smallest set, and the smallest sets of fingerprints that the trie self-join links."""
    sets = written(sets, "set-fingerprints")
    least = written(sets.groupBy("sim").agg(F.min("fp").alias("a"), F.count("*").alias("n")), "distinct-fingerprints")
    same = met(sets, least.where("n > 1"), "sim", sets.count()).where("fp <> a").select("a", "fp")
    near = written(links(least.select(F.col("sim").alias("fp"))).distinct(), "fingerprint-links")
    left, right = (least.select(F.col("sim").alias(end), F.col("a").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    ends = near.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("fp"))
    return same.unionByName(ends.where("fp <> a"))


def _tied_twice(docs: DataFrame, each: DataFrame, first: DataFrame) -> DataFrame:
    """node, root: a set with the smallest one that similar pairs tie it to, for sets tied to any."""
    n_each = each.count()
    least = each.groupBy("band").agg(F.min("fp").alias("a"), F.count("*").alias("n"))
    in_bands = met(each, least.where("n > 1"), "band", n_each).where("fp <> a").select("a", "fp")
    tried = by_trie(first.where(F.size("bands") > 0).select("fp", "sim"))
    stars = written(tried.unionByName(in_bands).distinct(), "stars")
    rays = stars.groupBy("a").agg(F.count("*").alias("n"))
    rays = rays.select("a", "n", F.ceil(F.col("n") / RAYS).cast("int").alias("cuts"))
    ends = met(stars, rays, "a", n_each).select("fp", F.struct(F.col("a").alias("group"), F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int").alias("x"), F.lit(0).alias("y")).alias("p"))
    heads = rays.select(F.col("a").alias("fp"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("x")).select("fp", F.struct(F.col("fp").alias("group"), "x", F.lit(-1).alias("y")).alias("p"))
    places = ends.unionByName(heads).groupBy("fp").agg(F.collect_list("p").alias("places"))
    members = places.join(first.select("fp", F.col("doc_id").alias("own_id"), F.col("key").alias("own_key")), "fp")
    members = written(members, "candidate-rows").hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    candidates = texts.join(members, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")))
    # rows that repeat stand for one set; equal keys have equal sets, so a set more than once at a place does no harm
    candidates = written(candidates.select("fp", "places", "text"), "candidate-texts")
    ties = written(starred(candidates).distinct(), "star-ties")
    parts = written(components(ties), "star-parts")

    part = each.join(parts.select(F.col("node").alias("fp"), "root"), "fp", "left").select("band", "fp", F.coalesce("root", "fp").alias("part"))
    part = written(part, "band-parts")
    apart = part.groupBy("band").agg(F.min("fp").alias("a"), F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high"))
    left = written(met(part, apart.where("n > 2 and low <> high").select("band", "a", "n"), "band", n_each), "bands-apart")
    n_left = left.count()
    if not n_left:
        return parts
    closed = components(left.select("a", F.col("fp").alias("b")))
    sets = left.select("fp", "part").distinct().join(closed.select(F.col("node").alias("fp"), "root"), "fp", "left")
    sets = written(sets.select("fp", "part", F.coalesce("root", "fp").alias("group")), "sets-apart")
    dealt = written(_blocks(sets, n_left), "set-places")
    more = settled(candidates.select("fp", "text").join(dealt, "fp"))
    return components(ties.unionByName(written(more, "group-ties")))


def rooted(docs: DataFrame) -> DataFrame:
    """doc_id, key and root (a set's hash, the same throughout a component) of every row; texts without words are one set.

    Null texts count as without words; null and repeated doc_ids each give
    their rows; very long texts are read whole; an empty table gives no rows;
    columns beyond doc_id and text are not read.
    """
    marks = written(marked(docs), "shingle-sets")
    # of each set one row stands for all
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "bands", "sim"))
    first = written(marks.groupBy("fp").agg(least.alias("r"), F.count("*").alias("n")).select("fp", "r.doc_id", "r.key", "r.bands", "r.sim", "n"), "distinct-sets")
    n_rows = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    each = written(first.select("fp", F.explode("bands").alias("band")), "bands")
    ties = _tied_twice(docs, each, first)
    named = written(first.select("fp", "n").join(ties.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "set-roots")
    return met(marks.select("doc_id", "key", "fp"), named, "fp", n_rows).select("doc_id", "key", "root")
