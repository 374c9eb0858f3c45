"""Reading, writing and small store operations as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fetch_since(source: DataFrame, ts: str, since) -> DataFrame:
    """Payloads after a moment; all of them without one."""
    return source if since is None else source.where(F.col(ts) > F.lit(since).cast("timestamp"))


def point_read(store: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of some keys, each once."""
    return store.join(keys.select(*on).distinct(), on, "left_semi")


def missing_keys(store: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Keys that a strict read has to report."""
    return keys.select(*on).distinct().join(store, on, "left_anti")


def strict_read(store: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """As point_read; fails when a key has no row."""
    marked = keys.select(*on).distinct().join(store.withColumn("_found", F.lit(True)), on, "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.lit("NotFound")).cast("boolean")).otherwise(True)
    return marked.where(checked).drop("_found")


def alive(now: Column, expires: str = "expires_at") -> Column:
    return F.col(expires).isNull() | (F.col(expires) > now)


def paged(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page with the number of rows before paging as total. The page is cut first; only its rows are joined to the count."""
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


def inserted(store: DataFrame, new: DataFrame, on: list[str], now: Column | None = None) -> DataFrame:
    """Rows appended; a live row with the same key is a conflict and fails."""
    live = store if now is None else store.where(alive(now))
    clash = new.join(live.select(*on).withColumn("_taken", F.lit(True)), on, "left")
    ok = clash.where(F.when(F.col("_taken").isNull(), True).otherwise(F.raise_error(F.lit("Conflict")).cast("boolean"))).drop("_taken")
    keep = store if now is None else store.join(new.select(*on), on, "left_anti")
    return keep.unionByName(ok.select(*store.columns))


def updated(store: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows replaced; a key without a row fails."""
    strict = strict_read(store.select(*on), new, on)
    return store.join(new.select(*on), on, "left_anti").unionByName(new.join(strict, on, "left_semi").select(*store.columns))


def deleted(store: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return store.join(keys.select(*on), on, "left_anti")


def compare_and_swap(store: DataFrame, changes: DataFrame, on: list[str], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """changes has the keys, expected and replacement. The new store, and for each change whether it was applied; null expects no row."""
    j = changes.join(store.select(*on, F.col(value).alias("_old")), on, "left").withColumn("applied", F.col("_old").eqNullSafe(F.col("expected")))
    done = j.where("applied")
    out = store.join(done.select(*on), on, "left_anti").unionByName(done.where(F.col("replacement").isNotNull()).select(*on, F.col("replacement").alias(value)), allowMissingColumns=True)
    return out, j.select(*on, "applied")


def drop_with_edges(edges: DataFrame, gone: DataFrame, key: str, ends: list[str]) -> DataFrame:
    """Edges without those at deleted nodes."""
    for end in ends:
        edges = edges.join(gone.select(F.col(key).alias(end)).distinct(), end, "left_anti")
    return edges


def project_edges(changes: DataFrame, on: list[str]) -> DataFrame:
    """The latest revision of each edge, unless that is a tombstone."""
    last = changes.groupBy(*on).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in on]), F.struct("revision", "tombstone")).alias("x"))
    return last.select(*on, "x.*").where("NOT tombstone").drop("tombstone")


def markdown_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct body lines with their hash and first place; titles and blank lines are skipped."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line")).where("line <> '' AND NOT startswith(line, '#')")
    return lines.groupBy(key, F.sha2("line", 256).alias("digest")).agg(F.min("pos").alias("pos"), F.first("line").alias("line"))


def decode(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON values as a struct; corrupt records are left out."""
    parsed = F.from_json(column, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = rows.withColumn("decoded", parsed).where("decoded IS NOT NULL AND decoded._corrupt_record IS NULL")
    return out.withColumn("decoded", F.col("decoded").dropFields("_corrupt_record"))


def encrypted(value: Column, key: Column, aad: Column) -> Column:
    """Sealed with its scope and key as associated data: a value moved elsewhere does not open."""
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def decrypted(value: Column, key: Column, aad: Column) -> Column:
    return F.aes_decrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A table partitioned by scope columns or shards, so that filters on them skip whole folders."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_space(units: DataFrame, org: str, space: str, path: str) -> None:
    units.where((F.col("org") == org) & (F.col("space") == space)).write.json(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files with size and time; contents are read only if selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, parts: int) -> DataFrame:
    """A relational table read in ranges of a key."""
    low, high = spark.read.jdbc(url, f"(SELECT min({key}) AS a, max({key}) AS b FROM {name}) t").first()
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation sets of sessions with turns, one row for each turn."""
    raw = spark.read.option("multiLine", True).json(path)
    s = raw.select(F.col("id").alias("case_id"), F.posexplode("sessions").alias("session", "turns"))
    return s.select("case_id", "session", F.posexplode("turns").alias("turn", "t")).select("case_id", "session", "turn", "t.*")


def maintained(index: DataFrame, fresh: DataFrame, gone: DataFrame, on: str, hard: bool = True) -> DataFrame:
    """An index table after changes: fresh entries replace those of their units; entries of gone units are dropped, or only marked (removed)."""
    kept = index.join(fresh.select(on).distinct(), on, "left_anti").unionByName(fresh)
    if hard:
        return kept.join(gone.select(on).distinct(), on, "left_anti")
    marked = kept.join(gone.select(on).distinct().withColumn("removed", F.lit(True)), on, "left")
    return marked.withColumn("removed", F.coalesce("removed", F.lit(False)))
