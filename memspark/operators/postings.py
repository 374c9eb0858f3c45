"""A full-text index as tables: postings in blocks with their highest scores.

Units lie in the order of their scope, so a range of SPAN places is mostly of
one scope. A block has what one term has in one range: places, frequencies and
lengths. With it go the (frequency, length) pairs that no other pair of the
block beats in both, so its highest score is known for any weights and any
average length without reading the block.

texts: place, all columns of the units, dl, in the order of places
blocks: bucket (folder), term, range, n, sky_tf, sky_dl, places, tfs, dls; each file in the order of terms and ranges
terms: bucket (folder), term, df, tf

A search reads the folders of its terms' buckets, by the filter on the term only
their row groups, and by the filter on ranges only blocks that can matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.operators import recall
from memspark.sources.scratch import folder as new_folder

#: Places of a range as a power of two; postings that a worker holds; folders of terms; ranges that are read first; ranges up to which they are named in the scan's filter.
SPAN_BITS, HELD, BUCKETS, FIRST, NAMED = 10, 1 << 18, 32, 8, 1000
#: Bytes of texts that a task sorts, or whose blocks it sorts, at most about: more texts make more tasks, not larger ones.
SHARE = 16 << 20
BLOCK = "term string, range long, n int, tf_sum long, sky_tf array<int>, sky_dl array<int>, places array<long>, tfs array<int>, dls array<int>"


def skies(code: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
    """Of postings with a term's code, frequency and length the places of those that no other of the term beats in both; a term's in the order of lengths."""
    order = np.lexsort((-tf, dl, code))
    # codes ascend: the highest key so far is the term's highest frequency so far
    key = (code[order].astype(np.int64) << 32) | tf[order].astype(np.int64)
    kept = np.ones(len(key), bool)
    kept[1:] = key[1:] > np.maximum.accumulate(key)[:-1]
    return order[kept]


def sky(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (frequency, length) pairs those that none beats in both: more frequent and no longer."""
    own = np.array(list(pairs), np.int64).reshape(-1, 2)
    return [(int(tf), int(dl)) for tf, dl in own[skies(np.zeros(len(own), np.int64), own[:, 0], own[:, 1])]]


def blocks_of(rows: DataFrame) -> DataFrame:
    """BLOCK rows from place, dl and low (the lower-case text), in the order in which places are read, a range's in the order of terms. A range is cut where a worker holds HELD postings: it may have several blocks of a term."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        token = re.compile("[0-9a-z]+|[一-鿿]")  # TOKEN of texts, after JVM lower case
        names = [c.split()[0] for c in BLOCK.split(", ")]
        # a text's distinct terms with their frequencies, text after text; of each text its place, length and number of terms
        words: list[str] = []
        tfs: list[int] = []
        texts: list[tuple[int, int, int]] = []
        where = None

        def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))

        def flush() -> pa.RecordBatch:
            coded = pa.array(words, pa.string()).dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            code, tf = rank[coded.indices.to_numpy()], np.array(tfs, np.int64)
            own = np.array(texts, np.int64)
            place, dl = np.repeat(own[:, 0], own[:, 2]), np.repeat(own[:, 1], own[:, 2])
            by, n, best = np.argsort(code, kind="stable"), np.bincount(code, minlength=len(order)), skies(code, tf, dl)
            tops, total = np.bincount(code[best], minlength=len(order)), np.add.reduceat(tf[by], np.cumsum(n) - n)
            columns = [coded.dictionary.take(order), pa.array(np.full(len(order), where), pa.int64()), pa.array(n, pa.int32()), pa.array(total, pa.int64())]
            columns += [lists(tops, tf[best], pa.int32()), lists(tops, dl[best], pa.int32())]
            columns += [lists(n, place[by], pa.int64()), lists(n, tf[by], pa.int32()), lists(n, dl[by], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for place, dl, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if words and (place >> SPAN_BITS != where or len(words) >= HELD):
                    yield flush()
                    words, tfs, texts = [], [], []
                where = place >> SPAN_BITS
                own = Counter(token.findall(low or ""))
                if own:
                    words.extend(own)
                    tfs.extend(own.values())
                    texts.append((place, dl, len(own)))
        if words:
            yield flush()

    return rows.select("place", "dl", "low").mapInArrow(run, BLOCK)


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def text_bytes(texts: DataFrame, column: str = "content") -> int:
    """Bytes of a column of texts."""
    return texts.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long")).first()[0]


def shares(spark: SparkSession, size: int) -> int:
    """Tasks for texts of so many bytes: the session's, or as many as keep each to SHARE."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARE))


def build(units: DataFrame, order: tuple[str, ...] = (), path: str | None = None, size: int | None = None) -> TextIndex:
    """Write the index of units (unit_id, content and any other columns) and open it.

    Units in the order of ``order``, then unit_id; texts are read twice, and
    only blocks are shuffled after. A null content has no tokens; repeated rows
    count each; an empty table gives an index that finds nothing. ``size`` has
    the texts' bytes if they are known: tasks are as many as keep what one of
    them sorts in memory, and so are the shares (by range) in which a bucket's
    blocks are written, so that a frequent term is no single task.
    """
    spark = units.sparkSession
    path = path or new_folder(spark, "text-index")
    size = text_bytes(units) if size is None else size
    parts = shares(spark, size)
    keys = [*order, "unit_id"]
    dl = F.coalesce(F.regexp_count(F.lower("content"), F.lit(t.TOKEN)), F.lit(0))
    # lengths after the sort: bounds of the ranges are taken without them
    dealt = units.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("dl", dl)
    dealt.withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    blocks = blocks_of(texts.select("place", "dl", F.lower("content").alias("low"))).withColumn("bucket", bucket_of(F.col("term")))
    salt = max(1, -(-size // (SHARE * BUCKETS)))
    # a place has its task's number above bit 33: ranges of one task, and of different ones, go to different shares
    share = F.pmod(F.xxhash64("range"), F.lit(salt))
    salted = blocks.repartitionById(BUCKETS * salt, (F.col("bucket") * salt + share).cast("int")).sortWithinPartitions("bucket", "term", "range")
    salted.write.partitionBy("bucket").parquet(f"{path}/blocks")
    heads = spark.read.schema(f"{BLOCK}, bucket int").parquet(f"{path}/blocks")
    terms = heads.groupBy("bucket", "term").agg(F.sum("n").cast("long").alias("df"), F.sum("tf_sum").alias("tf"))
    terms.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("dl")).write.parquet(f"{path}/sums")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    n, dl = spark.read.parquet(f"{path}/sums").first()
    return TextIndex(spark, path, n, (dl / n if n else 0.0) or 1.0)


@dataclass(frozen=True)
class TextIndex:
    """An index that has been written; n units of avgdl tokens (1 at least)."""

    spark: SparkSession
    path: str
    n: int
    avgdl: float

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def terms(self, words: list[str] | None = None) -> DataFrame:
        """term, df and tf of all terms, or of some."""
        return self._of("terms", "term string, df long, tf long, bucket int", words)

    def blocks(self, words: list[str]) -> DataFrame:
        return self._of("blocks", f"{BLOCK}, bucket int", words)

    def _of(self, name: str, schema: str, words: list[str] | None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        if words is None:
            return rows
        asked = sorted(set(words))
        if not asked:
            return rows.where("false")
        # the folders of a query's few words
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in asked})
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(asked))

    def counts(self, words: list[str], ranges: list[int] | DataFrame | None = None) -> DataFrame:
        """place, dl and tf (how often each distinct word, in their order, is there) of the units that have one: all, or those of some ranges."""
        asked = sorted(set(words))
        rows = self.blocks(asked)
        if isinstance(ranges, list):
            rows = rows.where(F.col("range").isin(ranges))
        elif ranges is not None:
            rows = rows.join(ranges.select("range"), "range", "left_semi")
        each = rows.select("term", F.explode(F.arrays_zip("places", "tfs", "dls")).alias("p")).select("term", F.col("p.places").alias("place"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        tf = [F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).cast("int") for w in asked]
        return each.groupBy("place", "dl").agg((F.array(*tf) if tf else F.array().cast("array<int>")).alias("tf"))

    def pool_counts(self, words: list[str], pool: DataFrame) -> DataFrame:
        """unit_id, place, dl and tf of the units of a pool (rows of texts(), filtered) that have one of the words. The pool's narrow columns are read, not its texts."""
        return self.counts(words).drop("dl").join(pool.select("place", "unit_id", "dl"), "place")

    def named(self, hits: DataFrame) -> DataFrame:
        """Hits with unit_id in the place of place."""
        return hits.join(self.texts().select("place", "unit_id"), "place").drop("place")

    def stats(self, words: list[str]) -> dict[str, int]:
        """How many units have each of the query's words."""
        return {r.term: r.df for r in self.terms(words).select("term", "df").collect()}

    def keyword(self, words: list[str]) -> DataFrame:
        """All hits of the keyword channel: unit_id, score, channel."""
        return recall.keyword_of(self.named(self.counts(words)), words)

    def bm25(self, words: list[str]) -> DataFrame:
        """All hits of BM25 over the whole index: unit_id, score."""
        return recall.bm25_scored(self.named(self.counts(words)), words, F.lit(float(self.n)), F.lit(self.avgdl), self._dfs(words))

    def pool_bm25(self, counts: DataFrame, words: list[str], pool: DataFrame) -> DataFrame:
        """BM25 from pool_counts(), with the number of units, lengths and frequencies of the pool."""
        q = range(len(set(words)))
        sums = pool.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
        dfs = counts.agg(F.lit(1).alias("one"), *(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in q))
        own = counts.select("unit_id", "dl", "tf").crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(dfs))  # one row of sums each
        return recall.bm25_scored(own, words, F.col("n"), F.col("avgdl"), [F.col(f"df{i}") for i in q])

    def _dfs(self, words: list[str]) -> list[Column]:
        df = self.stats(words)
        return [F.lit(float(df.get(w, 0))) for w in sorted(set(words))]

    def bounds(self, words: list[str], channel: str, df: dict[str, int] | None = None) -> DataFrame:
        """range, bound: no unit of the range scores more than its bound. Only the heads of blocks are read."""
        asked = sorted(set(words))
        if channel == "keyword":
            best = F.array_max(F.zip_with("sky_tf", "sky_dl", lambda tf, dl: tf / dl))
        else:
            df = self.stats(words) if df is None else df
            weight = F.lit(0.0)
            for w in asked:
                weight = F.when(F.col("term") == w, recall.expected_lift(self.n, df.get(w, 0)) * words.count(w)).otherwise(weight)
            best = F.array_max(F.zip_with("sky_tf", "sky_dl", lambda tf, dl: weight * tf * (recall.K1 + 1) / (tf + recall.K1 * (1 - recall.B + recall.B * dl / self.avgdl))))
        heads = self.blocks(asked).select("term", "range", best.alias("best"))
        return heads.groupBy("range", "term").agg(F.max("best").alias("best")).groupBy("range").agg(F.sum("best").alias("bound"))

    def top(self, words: list[str], k: int, channel: str = "bm25") -> tuple[DataFrame, int]:
        """The best k hits as unit_id, score, channel, and how many ranges were read.

        The FIRST ranges of the highest bounds are scored; then those whose bound
        reaches the k-th best score so far. The others cannot have a hit that is
        among the best: the result is that of a full scan, ties included.
        """
        df = self.stats(words)
        bounds = self.bounds(words, channel, df)
        best = bounds.orderBy(F.desc("bound"), "range").limit(NAMED + 1).collect()
        first, least, n = [r.range for r in best[:FIRST]], 0.0, len(best)
        if len(best) > FIRST:
            scores = [r.score for r in self._scored(words, channel, first, df).select("score").orderBy(F.desc("score")).limit(k).collect()]
            least = min(scores) * (1 - 1e-9) if len(scores) == k else 0.0
        if len(best) <= NAMED:
            chosen: list[int] | DataFrame = first + [r.range for r in best[FIRST:] if r.bound >= least]
            n = len(chosen)
        else:
            chosen = recall.written(bounds.where(F.col("bound") >= least).select("range"), "chosen-ranges")
            n = chosen.count()
        hits = self.named(self._scored(words, channel, chosen, df).where(F.col("score") >= least))
        out = hits.select("unit_id", F.round("score", 12).alias("score"), F.lit(channel).alias("channel"))
        return out.orderBy(F.desc("score"), "unit_id").limit(k), n

    def _scored(self, words: list[str], channel: str, ranges: list[int] | DataFrame, df: dict[str, int]) -> DataFrame:
        own = self.counts(words, ranges).withColumnRenamed("place", "unit_id")
        if channel == "keyword":
            rows = recall.keyword_of(own, words).select("unit_id", "score")
        else:
            rows = recall.bm25_scored(own, words, F.lit(float(self.n)), F.lit(self.avgdl), [F.lit(float(df.get(w, 0))) for w in sorted(set(words))])
        return rows.withColumnRenamed("unit_id", "place")

    def contents(self, places: list[int]) -> DataFrame:
        """The rows of some places: the few row groups that hold them."""
        return self.texts().where(F.col("place").isin(places))
