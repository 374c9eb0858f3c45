"""Payloads to units: routing by modality, parts, stamps, hints of hierarchy, and stores in shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.sources.scratch import folder

#: The leaf role that an input may name for each kind of hierarchy, and the hints it may give.
LEAF_ROLES = {"time": "snapshot", "topic": "node", "directory": "node", "cluster": "node", "custom": "node"}
HINTS = ("hierarchy_kind", "hierarchy_role", "hierarchy_span_start", "hierarchy_span_end")
ORIGINAL = "original"
#: Routes by modality: what makes a text of a payload.
ROUTES: dict[str, Callable[[Column], Column]] = {"text": lambda c: c, "markdown": lambda c: c, "json": lambda c: c}


def normalised(modality: Column, content: Column, routes: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """struct(text, error): the content by its modality's route; a modality without one is an error, not a text."""
    routes = routes or ROUTES
    out = None
    for name, make in routes.items():
        out = F.when(modality == name, make(content)) if out is None else out.when(modality == name, make(content))
    known = F.coalesce(modality.isin(*routes), F.lit(False))
    return F.struct(F.when(known, out.otherwise(F.lit(None))).alias("text"), F.when(~known, F.concat(F.lit("unsupported modality "), F.coalesce(modality, F.lit("null")))).alias("error"))


def stamped(payloads: DataFrame, now: Column, most: int) -> DataFrame:
    """Units of payloads (payload_id, content, occurred_at, event_time): parts of at most so many characters, all with the event time given or the first absolute date of the whole content, taken in and valid from now on, said when they occurred.

    part and parts are set only where a content was cut; an empty content is one
    empty unit.
    """
    pieces = t.chunks(F.coalesce("content", F.lit("")), most)
    each = payloads.select("*", F.posexplode(pieces).alias("_at", "_piece"), F.size(pieces).alias("_n"))
    cut = F.col("_n") > 1
    return each.select(
        F.col("payload_id").alias("source_ref"),
        F.when(cut, F.col("_at") + 1).alias("part"),
        F.when(cut, F.col("_n")).alias("parts"),
        F.col("_piece.text").alias("content"),
        F.coalesce(F.col("event_time").cast("timestamp"), t.first_date(F.col("content")).cast("timestamp")).alias("t_event"),
        now.alias("t_ingest"),
        now.alias("t_valid"),
        F.col("occurred_at").alias("t_message"),
        F.lit(ORIGINAL).alias("origin"),
    )


def hierarchy_ref(meta: Column, occurred_at: Column, enabled: bool = True) -> Column:
    """struct(kind, role, span_start, span_end, error) from an input's hints, a map of strings.

    Only leaf roles may be named, never parents or children. If enabled, an
    input without hints, or with a time snapshot without a span, stands at the
    time it occurred; if not, allowed hints are dropped. A wrong hint is an
    error, which goes with its row.
    """
    keys = F.filter(F.map_keys(meta), lambda k: k.startswith("hierarchy_"))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, HINTS))))
    kind, role, start, end = (F.try_element_at(meta, F.lit(h)) for h in HINTS)
    at = F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss")
    bare = (F.size(keys) == 2) & (kind == "time") & (role == "snapshot")
    implied = F.coalesce(occurred_at.isNotNull() & ((F.size(keys) == 0) | bare), F.lit(False))
    kind, role = F.when(implied, "time").otherwise(kind), F.when(implied, "snapshot").otherwise(role)
    start, end = F.when(implied, at).otherwise(start), F.when(implied, at).otherwise(end)
    leaf = F.create_map(*(F.lit(x) for pair in LEAF_ROLES.items() for x in pair))
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    has = F.size(keys) > 0
    error = (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown hints "), F.array_join(unknown, ",")))
        .when(has & (kind.isNull() != role.isNull()), "kind and role go together")
        .when(has & kind.isNull(), "a span without kind and role")
        .when(kind.isNotNull() & F.try_element_at(leaf, kind).isNull(), "unknown kind")
        .when(kind.isNotNull() & (role != F.try_element_at(leaf, kind)), "not a leaf role")
        .when((kind != "time") & (start.isNull() != end.isNull()), "both ends or none")
        .when((start.isNotNull() & a.isNull()) | (end.isNotNull() & b.isNull()), "unreadable time")
        .when(a > b, "the span ends before it starts")
    )
    if not enabled:
        error = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown hints "), F.array_join(unknown, ",")))
        kind = role = F.lit(None).cast("string")
        a = b = F.lit(None).cast("timestamp")
    good = error.isNull()
    return F.struct(F.when(good, kind).alias("kind"), F.when(good, role).alias("role"), F.when(good, a).alias("span_start"), F.when(good, b).alias("span_end"), error.alias("error"))


def write_sharded(rows: DataFrame, shard: Column, name: str) -> str:
    """Rows in a table partitioned by shard, below the shared folder; its path. A large shard is written by several tasks."""
    path = folder(rows.sparkSession, name)
    rows.withColumn("shard", shard.cast("string")).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """The rows of some shards (all without a list): only their files are opened. No shard is no row."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(path).withColumn("shard", F.col("shard").cast("string"))
    return rows if shards is None else rows.where(F.col("shard").isin(*shards)) if shards else rows.limit(0)


def moved(rows: DataFrame, name: str, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """A store copied to another: the copy, and one row that says whether it is whole: rows, and a sum of hashes over the key, on both sides."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    copy = rows.sparkSession.read.schema(rows.schema).parquet(path)
    side = lambda d, p: d.agg(F.count("*").alias(f"{p}_rows"), F.coalesce(F.sum(F.xxhash64(*key).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"{p}_sum"))
    both = side(rows, "old").crossJoin(side(copy, "new"))  # one row each
    return copy, both.select("old_rows", "new_rows", ((F.col("old_rows") == F.col("new_rows")) & (F.col("old_sum") == F.col("new_sum"))).alias("whole"))


def index_tables(units: DataFrame) -> dict[str, DataFrame]:
    """The tables that recall reads, from units (unit_id, content): forward (the record), fulltext (postings), vector (of units with any token), entity (hash to unit)."""
    from memspark.operators import recall

    own = units.select("unit_id", F.coalesce("content", F.lit("")).alias("content"))
    vectors = own.where(F.lower("content").rlike(t.TOKEN)).select("unit_id", t.embedded(F.col("content")).alias("vector"))
    parts = recall.parted(own)
    return {"forward": units, "fulltext": recall.postings(own, parts), "vector": vectors, "entity": recall.unit_entities(own, parts)}


def upserted(index: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """An index by unit_id with new rows in place of old ones, and without those gone; a row both new and gone is gone."""
    touched = new.select("unit_id").unionByName(gone.select("unit_id")).distinct()
    return index.join(touched, "unit_id", "left_anti").unionByName(new.join(gone.select("unit_id"), "unit_id", "left_anti").select(*index.columns))


def line_range(files: DataFrame, key: str, text: str, first: int, last: int) -> DataFrame:
    """key, line (from 1), text: some lines of text files."""
    each = files.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("_p", "text"))
    return each.where((F.col("_p") + 1 >= first) & (F.col("_p") + 1 <= last)).select(key, (F.col("_p") + 1).alias("line"), "text")


def edited(text: Column, first: int, last: int, new: Column) -> Column:
    """A text whose lines from first to last are replaced; beyond its end the new text is appended."""
    lines = F.split(text, "\n")
    head = F.slice(lines, 1, first - 1) if first > 1 else F.slice(lines, 1, 0)
    tail = F.when(F.size(lines) > last, F.slice(lines, F.lit(last + 1), F.greatest(F.size(lines) - last, F.lit(0)))).otherwise(F.slice(lines, 1, 0))
    return F.array_join(F.concat(head, F.array(new), tail), "\n")
