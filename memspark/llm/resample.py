"""Documents drawn by how much their hashed n-grams look like a target's.

Features are runs of 1 to n words, counted in buckets of their crc32. A
bucket's gain is the logarithm of how much more often the target has it than
the documents do. A document's weight is the sum of its features' gains; with
Gumbel noise from a hash of its doc_id, the highest scores are a draw without
replacement in proportion to exp(weight / 1000).

Long texts are cut into overlapping chunks at word boundaries: a chunk owns the
words that start in its stretch of CHUNK bytes and carries the n - 1 words after
them, so each feature is counted where it starts, once. Chunks are dealt out to
all tasks; their counts and weights are summed by document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.shared import written

#: A word, in UTF-8 bytes with A-Z in lower case: every byte from 80 on belongs to a character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of a text that one chunk owns; texts up to that are not cut. Rows that one task ranks, and the most tasks.
CHUNK, RANKED, PARTS = 1 << 16, 1 << 14, 4096


def hashes(words: list[bytes], n: int, owned: int) -> list[int]:
    """crc32 of every run of 1 to n words that starts at one of the first ``owned`` words."""
    out = list(map(zlib.crc32, words[:owned]))
    for size in range(2, n + 1):
        out += [zlib.crc32(b" ".join(words[k : k + size])) for k in range(min(owned, len(words) - size + 1))]
    return out


def cut(text: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(owned, piece): chunks of a lower-case text; the first ``owned`` words of a piece are its own, up to n - 1 more are carried."""
    inside = np.concatenate([[False], IN_WORD[np.frombuffer(text, np.uint8)], [False]])
    starts, ends = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    edges = np.searchsorted(starts, np.arange(0, len(text) + size, size))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a:
            yield b - a, text[starts[a] : ends[min(b + n - 1, len(ends)) - 1]]


def _lower(texts: list[str | None]) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]


def counted(docs: DataFrame, n: int, buckets: int, text: str = "text") -> DataFrame:
    """One pass over the texts, written to the shared folder: rows (bucket, total) for texts that are not cut, summed in each task, and rows (row, doc_id, owned, piece) for the chunks of the others.

    row tells rows of the table apart, repeated ones too. Tables without a
    doc_id column have null there.
    """

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["bucket", "total", "row", "doc_id", "owned", "piece"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        totals, row = np.zeros(buckets, np.int64), TaskContext.get().partitionId() << 33
        for batch in batches:
            found: list[int] = []
            for doc_id, low in zip(batch.column(0).to_pylist(), _lower(batch.column(1).to_pylist()), strict=True):
                row += 1
                if len(low) <= CHUNK:
                    words = WORD.findall(low)
                    found += hashes(words, n, len(words))
                    continue
                for owned, piece in cut(low, n):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((None, None, row, doc_id, owned, piece), kinds, strict=True)], names)
            totals += np.bincount(np.array(found, np.int64) % buckets, minlength=buckets)
        some = np.flatnonzero(totals)
        if len(some):
            gone = [pa.nulls(len(some), k) for k in kinds[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some]), *gone], names)

    doc_id = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(run, "bucket int, total long, row long, doc_id long, owned int, piece binary"), "resample-counts")


def _pieces(counts: DataFrame) -> DataFrame:
    """The chunks of cut texts, dealt out evenly."""
    return counts.where("piece is not null").select("row", "doc_id", "owned", "piece").repartition("row", F.xxhash64("piece"))


def totals(counts: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, total: features in each bucket, of whole texts and of chunks."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for owned, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.bincount(np.array(hashes(WORD.findall(piece), n, owned), np.int64) % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "total"])

    cut_ones = _pieces(counts).select("owned", "piece").mapInArrow(run, "bucket int, total long")
    return counts.where("bucket is not null").select("bucket", "total").unionByName(cut_ones).groupBy("bucket").agg(F.sum("total").alias("total"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket: ``buckets`` whole numbers, whatever the size of the tables, from totals() of both."""
    both = raw.withColumnRenamed("total", "s").join(target.withColumnRenamed("total", "t"), "bucket", "full").na.fill(0, ["s", "t"]).toPandas()
    out = np.zeros((2, buckets))
    out[:, both["bucket"].to_numpy(int)] = both[["s", "t"]].to_numpy(float).T
    (s, t), (all_s, all_t) = out, out.sum(1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weights(docs: DataFrame, counts: DataFrame, gain: np.ndarray, n: int, text: str = "text") -> DataFrame:
    """row, doc_id, n_words, n_features and weight of every row, each once.

    Null and empty texts and texts without words have zeros. Texts of one chunk
    are weighed where they are read; the others' chunks are dealt out, weighed,
    and summed by row.
    """
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)
    schema = "row long, doc_id long, n_words long, n_features long, weight long"

    def weighed(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in found], np.int64)
        every = np.fromiter((h for x in found for h in x), np.int64, int(sizes.sum()))
        sums = np.concatenate([[0], np.cumsum(held.value[every % buckets])])
        ends = np.cumsum(sizes)
        return sizes, sums[ends] - sums[ends - sizes]

    def whole(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            own, found, n_words = [], [], []
            for k, low in enumerate(_lower(batch.column(1).to_pylist())):
                if len(low) <= CHUNK or not WORD.search(low):
                    words = WORD.findall(low)
                    own.append(k)
                    n_words.append(len(words))
                    found.append(hashes(words, n, len(words)))
            sizes, weight = weighed(found)
            ids = batch.column(0).take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(own, np.int64) + row + 1), ids, pa.array(n_words, pa.int64()), pa.array(sizes), pa.array(weight)], ["row", "doc_id", "n_words", "n_features", "weight"])
            row += len(batch)

    def chunk(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            owned = batch.column(2).to_pylist()
            found = [hashes(WORD.findall(x), n, k) for k, x in zip(owned, batch.column(3).to_pylist(), strict=True)]
            sizes, weight = weighed(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(owned, pa.int64()), pa.array(sizes), pa.array(weight)], ["row", "doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
    parts = _pieces(counts).mapInArrow(chunk, schema).groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    return rows.mapInArrow(whole, schema).unionByName(parts)


def scores(weighed: DataFrame, seed: int) -> DataFrame:
    """With score: weight plus noise from sha256 of ``seed:doc_id``; a null doc_id stands for the empty text there."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def draw(scored: DataFrame, percent: int, least: int) -> DataFrame:
    """With rank: 1, 2, 3... for the floor(percent * N / 100) highest scores of the N rows of at least ``least`` words, ties to the smaller doc_id; null for all other rows.

    Rows are sorted by ranges; each range's ranks start after the rows of the
    ranges before it, so no task sees more than its range. Rows alike in score
    and doc_id are parted by their place in the table.
    """
    kept = written(scored, "resample-scores")
    n = kept.where(F.col("n_words") >= least).count()
    parts = max(1, min(PARTS, n // RANKED))
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]
    dealt = kept.where(F.col("n_words") >= least).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the number of a row: its partition, and its place there
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()), "resample-order")
    part = F.shiftright("at", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))  # at most PARTS rows
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= percent * n // 100, rank))
    out = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return ranked.select(out).unionByName(kept.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")).select(out))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024, text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of every document, drawn to look like the target.

    Null texts have no words; repeated rows are weighed and drawn each; other
    columns are not read; an empty target makes all gains those of an even
    spread; an empty table gives no rows. Weights are whole numbers, so they do
    not depend on how texts are dealt out.
    """
    counts = counted(docs, n, buckets, text)
    goal = counted(target, n, buckets, target_text)
    gain = gains(totals(counts, n, buckets), totals(goal, n, buckets), buckets)
    return draw(scores(weights(docs, counts, gain, n, text), seed), percent, least)


def op12_overlap_resampling(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents"), read("benchmark"))


SQL = """WITH table_ AS MATERIALIZED (SELECT list(list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS crc FROM (SELECT unnest(range(256)) AS x)),
docs AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
goal AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
each AS (SELECT row, unnest(words) AS word FROM docs),
kinds AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM each UNION ALL SELECT word FROM goal)),
hashed AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || h[2 * i - 1 : 2 * i])::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM kinds, table_),
s AS (SELECT bucket, count(*) AS s FROM each JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM goal JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT row, sum(gain)::BIGINT AS weight FROM each JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, row FROM docs LEFT JOIN weighed USING (row)),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, row) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank, n_features AS n_words FROM scored LEFT JOIN ranked USING (row)"""
