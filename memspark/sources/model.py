"""The nested record of a memory unit and the constants of its index view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _TS = T.StringType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCOPE_DIMS = ("org", "space", "user", "agent", "session")
SCOPE = _struct(**{d: _S for d in SCOPE_DIMS})
TEMPORAL = _struct(t_event=_TS, t_ingest=_TS, t_valid=_TS, t_invalid=_TS, t_message=_TS)
SEGMENT = _struct(content=_S, assets=T.ArrayType(_S), source=_S)
VECTOR = _struct(id=_S, seq=T.IntegerType(), vector=T.ArrayType(T.FloatType()))
HIERARCHY = _struct(kind=_S, role=_S, parent_id=_S, child_ids=T.ArrayType(_S), span_start=_TS, span_end=_TS, ordinal=T.IntegerType(), status=_S)
UNIT = _struct(
    id=_S,
    scope=SCOPE,
    tier=_S,
    lifecycle=_S,
    content=_S,
    segments=T.ArrayType(SEGMENT),
    layers=_struct(l0=_S, l1=_S),
    source_ref=_S,
    temporal=TEMPORAL,
    provenance=T.ArrayType(_S),
    supersedes=_S,
    tags=T.ArrayType(_S),
    system_metadata=T.MapType(_S, _S),
    user_metadata=T.MapType(_S, _S),
    entities=T.ArrayType(_S),
    vectors=T.ArrayType(VECTOR),
    hierarchy=HIERARCHY,
)
LIFECYCLES = ("active", "archived", "superseded", "forgotten")
TIERS = ("working", "episodic", "semantic", "core")
#: What the index view holds for an open end of validity and an unknown event time.
T_INVALID_OPEN = 253_402_300_799_000
T_EVENT_UNKNOWN = 0


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def content_of(segments: Column) -> Column:
    """The segments' contents, joined by line ends."""
    return F.array_join(F.transform(segments, lambda s: s["content"]), "\n")


def as_units(df: DataFrame) -> DataFrame:
    """Rows with any of the record's fields as a table of UNIT; missing ones are null."""
    have = dict(df.dtypes)
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in UNIT.fields))


def index_view(units: DataFrame) -> DataFrame:
    """The flat row that filters see: times as epoch milliseconds with sentinels, metadata under prefixed keys."""
    prefixed = lambda c, p: F.transform_keys(F.coalesce(F.col(c), F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit(p), k))
    return units.select(
        F.col("id").alias("unit_id"),
        *(F.col(f"scope.{d}").alias(d) for d in SCOPE_DIMS),
        "tier",
        "lifecycle",
        "tags",
        F.coalesce(millis(F.col("temporal.t_event")), F.lit(T_EVENT_UNKNOWN)).alias("t_event"),
        millis(F.col("temporal.t_ingest")).alias("t_ingest"),
        millis(F.col("temporal.t_valid")).alias("t_valid"),
        F.coalesce(millis(F.col("temporal.t_invalid")), F.lit(T_INVALID_OPEN)).alias("t_invalid"),
        F.map_concat(prefixed("system_metadata", "system_metadata."), prefixed("user_metadata", "user_metadata.")).alias("metadata"),
    )


def layer_documents(units: DataFrame) -> DataFrame:
    """unit_id, layer, text: the non-empty contents and layers, for a text index."""
    layers = F.array(*(F.struct(F.lit(n).alias("layer"), c.alias("text")) for n, c in (("l2", F.col("content")), ("l0", F.col("layers.l0")), ("l1", F.col("layers.l1")))))
    return units.select(F.col("id").alias("unit_id"), F.explode(F.filter(layers, lambda x: F.coalesce(x["text"], F.lit("")) != "")).alias("x")).select("unit_id", "x.*")
