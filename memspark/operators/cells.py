"""A vector index of cells: rows stored by their nearest centre, searched cell by cell.

A query looks into the cells of its nearest centres only, which are folders of
the table; what it finds there is scored exactly, after the filter. With all
cells the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators.govern import top_by
from memspark.operators.recall import sliced
from memspark.sources.scratch import folder as new_folder

#: Rows that the centres are fitted to (those of the least hash), steps of the fit, most cells, queries of a block, shares in which a cell is written.
SAMPLE, STEPS, CELLS, BLOCK, SALT = 20_000, 12, 2048, 2048, 8


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; those without a length, or with one that is no number, are zeros."""
    with np.errstate(all="ignore"):
        out = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(np.isfinite(out).all(1, keepdims=True), out, 0.0)


def matrix(column, size: int) -> np.ndarray:
    """A list column as rows of ``size`` numbers; null and shorter ones are filled up with zeros, longer ones cut."""
    out = np.zeros((len(column), size))
    for k, v in enumerate(column.to_pylist()):
        if v:
            own = np.array([np.nan if x is None else x for x in v[:size]], float)
            out[k, : len(own)] = own
    return out


def centres(x: np.ndarray, n: int) -> np.ndarray:
    """Centres of n groups of directions: the first rows that differ, then STEPS rounds of nearest centre and mean."""
    _, first = np.unique(x, axis=0, return_index=True)
    own = x[np.sort(first)][:n].copy()
    for _ in range(STEPS):
        near = (x @ own.T).argmax(1)
        sums = np.zeros_like(own)
        np.add.at(sums, near, x)
        moved = unit(sums)
        own = np.where(np.abs(moved).sum(1, keepdims=True) > 0, moved, own)
    return own


def build(vectors: DataFrame, cells: int | None = None, path: str | None = None) -> CellIndex:
    """Write unit_id, vector and all other columns by cell; as many cells as the root of the rows unless said.

    Null vectors are zeros, which no search finds; a frequent cell is written
    in shares. Every row is in the index; only the centres come from a sample.
    """
    spark = vectors.sparkSession
    path = path or new_folder(spark, "cell-index")
    n, size = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    size = max(int(size), 1)
    sample = vectors.select("unit_id", "vector").orderBy(F.xxhash64(F.col("unit_id").cast("string"))).limit(SAMPLE).select("vector").toArrow().column("vector")
    x = unit(matrix(sample, size))
    own = centres(x, max(1, min(cells or int(n**0.5), CELLS))) if len(x) else np.zeros((1, size))
    held = spark.sparkContext.broadcast(own)
    names = [c for c in vectors.columns if c != "cell"]
    rows = vectors.select("vector", *(c for c in names if c != "vector"))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            near = (unit(matrix(batch.column(0), size)) @ held.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "cell"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "cell int"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(run, schema).repartition(parts, "cell", F.pmod(F.xxhash64(F.col("unit_id").cast("string")), F.lit(SALT)))
    dealt.sortWithinPartitions("cell").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(own)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return CellIndex(spark, path, own, schema)


@dataclass(frozen=True)
class CellIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    schema: str

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _blocks(self, queries: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
        """Queries in the order of their nearest cells, a block at a time."""
        size = self.centres.shape[1]
        held = self.spark.sparkContext.broadcast(self.centres)

        def run(batches: Iterable) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                near = (unit(matrix(batch.column(1), size)) @ held.value.T).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["query_id", "vector", "near"])

        asked = queries.select(F.col("query_id").cast("string"), F.col("vector").cast("array<double>"))
        ids, vs = [], []
        for r in asked.mapInArrow(run, "query_id string, vector array<double>, near int").orderBy("near", "query_id").toLocalIterator():
            ids.append(r.query_id)
            v = np.zeros(size)
            v[: len(r.vector or [])] = (r.vector or [])[:size]
            vs.append(v)
            if len(ids) == BLOCK:
                yield ids, unit(np.array(vs))
                ids, vs = [], []
        if ids:
            yield ids, unit(np.array(vs))

    def cells_of(self, q: np.ndarray, probes: int | None) -> np.ndarray:
        """For each query (rows) which cells (columns) it looks into: those of its nearest centres, or all."""
        if probes is None or probes >= len(self.centres):
            return np.ones((len(q), len(self.centres)), bool)
        near = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(q), len(self.centres)), bool)
        np.put_along_axis(out, near, True, 1)
        return out

    def read(self, looked: np.ndarray, keep: Column | None = None) -> DataFrame:
        """unit_id, vector and cell of the rows that pass the filter in the cells that some query looks into: other folders are not read."""
        cells = np.flatnonzero(looked.any(0)).tolist()
        rows = self.rows() if len(cells) == looked.shape[1] else self.rows().where(F.col("cell").isin(cells))
        return (rows if keep is None else rows.where(keep)).select(F.col("unit_id").cast("string").alias("unit_id"), "vector", "cell")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, keep: Column | None = None) -> DataFrame:
        """query_id, unit_id, score, rank (from 0): the best k rows by cosine, above 0, of each query's cells; ties by unit_id.

        Queries (query_id, vector) are taken in blocks; a task passes on its best
        k of each query. The filter comes before the k, so it takes no hit's
        place.
        """
        size, found = self.centres.shape[1], None
        for ids, q in self._blocks(queries):
            looked = self.cells_of(q, probes)
            held = self.spark.sparkContext.broadcast((np.array(ids, object), q, looked))

            def run(batches: Iterable, held=held) -> Iterator:
                import pyarrow as pa

                ids, q, looked = held.value
                for batch in sliced(batches, len(ids)):
                    cell = batch.column(2).to_numpy(zero_copy_only=False)
                    who = np.flatnonzero(looked[:, np.unique(cell)].any(1))
                    if not len(who):
                        continue
                    s = (q[who] @ unit(matrix(batch.column(1), size)).T).round(12)
                    s[~looked[np.ix_(who, cell)]] = 0
                    if s.shape[1] > k:
                        # everything from each query's k-th best score on, ties included
                        least = np.partition(s, -k, 1)[:, -k]
                        s[s < least[:, None]] = 0
                    a, b = np.nonzero(s > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who[a]].tolist(), pa.string()), batch.column(0).take(pa.array(b)), pa.array(s[a, b])], ["query_id", "unit_id", "score"])

            hits = self.read(looked, keep).mapInArrow(run, "query_id string, unit_id string, score double")
            found = hits if found is None else found.unionByName(hits)
        if found is None:
            return self.spark.createDataFrame([], "query_id string, unit_id string, score double, rank int")
        from pyspark.sql import Window

        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
        return top_by(found, ["query_id"], [F.desc("score"), F.asc("unit_id")], k).withColumn("rank", F.row_number().over(w) - 1)
