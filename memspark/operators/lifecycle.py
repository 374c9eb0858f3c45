"""Changes of state: patches, sweeps, versions, duplicates, forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a unit's state may become; it may always stay.
TRANSITIONS = {
    "active": ("archived", "forgotten", "superseded"),
    "archived": ("forgotten",),
    "superseded": ("forgotten",),
    "forgotten": (),
}
#: Where a sweep may send units.
SWEPT = ("forgotten", "archived")


def overlay(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Fields of the patch that are not null replace the old ones; maps are merged, the patch's entries win."""
    types = dict(old.dtypes)
    p = patch.select(key, *(F.col(c).alias(f"_p_{c}") for c in patch.columns if c != key))
    j = old.join(p, key, "left")

    def field(c: str) -> Column:
        if c == key or f"_p_{c}" not in p.columns:
            return F.col(c)
        if types[c].startswith("map"):
            new = F.coalesce(F.col(f"_p_{c}"), F.create_map().cast(types[c]))
            return F.map_concat(F.map_filter(F.col(c), lambda k, _: ~F.map_contains_key(new, k)), new).alias(c)
        return F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c)

    return j.select(*(field(c) for c in old.columns))


def may_become(state: Column, target: Column) -> Column:
    """Whether the state may become the target; staying is allowed, an unknown state may become nothing else."""
    pair = F.concat_ws(">", state, target)
    return (state == target) | pair.isin(*(f"{a}>{b}" for a, after in TRANSITIONS.items() for b in after))


def transitioned(state: Column, target: str) -> Column:
    """The target state; a transition that is not allowed fails, staying is no transition."""
    return F.when(may_become(state, F.lit(target)), F.lit(target)).otherwise(F.raise_error(F.concat(F.lit(f"no transition to {target} from "), state)).cast("string"))


def sweep(units: DataFrame, now: Column, superseded: str = "forgotten", expired: str = "forgotten") -> DataFrame:
    """Superseded units, and active ones whose validity ended before now, each go to the state that the policy names for them."""
    if superseded not in SWEPT or expired not in SWEPT:
        raise ValueError(f"a sweep leads to one of {SWEPT}")
    old = F.col("lifecycle") == "superseded"
    ended = (F.col("lifecycle") == "active") & F.coalesce(F.col("t_invalid") < now, F.lit(False))
    return units.withColumn("swept", old | ended).withColumn("lifecycle", F.when(old, superseded).when(ended, expired).otherwise(F.col("lifecycle")))


def supersede(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old versions are closed where a new one of the same key begins; the new ones are appended."""
    starts = new.groupBy(key).agg(F.min("t_valid").alias("_at"))
    j = old.join(starts, key, "left")
    closing = F.col("_at").isNotNull() & (F.col("lifecycle") == "active")
    closed = j.withColumn("t_invalid", F.when(closing, F.least(F.coalesce("t_invalid", "_at"), F.col("_at"))).otherwise(F.col("t_invalid"))).withColumn("lifecycle", F.when(closing, "superseded").otherwise(F.col("lifecycle"))).drop("_at")
    return closed.unionByName(new)


def verdict(new_event: Column, old_event: Column, new_ingest: Column, old_ingest: Column) -> Column:
    """Which of two facts is newer: by event time if both have one, else by ingest; equal ones are both kept."""
    a = F.when(new_event.isNotNull() & old_event.isNotNull(), new_event).otherwise(new_ingest)
    b = F.when(new_event.isNotNull() & old_event.isNotNull(), old_event).otherwise(old_ingest)
    return F.when(a > b, "newer").when(a < b, "older").otherwise("preserve")


def dedup_decision(score: Column, noop: float, update: float, supersede_: float) -> Column:
    """NOOP, UPDATE, SUPERSEDE or ADD by the best score among existing units; no score is an ADD."""
    return F.when(score >= noop, "NOOP").when(score >= update, "UPDATE").when(score >= supersede_, "SUPERSEDE").otherwise("ADD")


def forget(units: DataFrame, retained: DataFrame, key: str) -> DataFrame:
    """Superseded units that nothing holds are forgotten."""
    held = retained.select(key).distinct().withColumn("_held", F.lit(True))
    gone = (F.col("lifecycle") == "superseded") & F.col("_held").isNull()
    return units.join(held, key, "left").withColumn("lifecycle", F.when(gone, "forgotten").otherwise(F.col("lifecycle"))).drop("_held")


def downweight(importance: Column) -> Column:
    return F.coalesce(importance, F.lit(1.0)) * 0.5


def newest_of_equal(rows: DataFrame, group: list[str], content: str, order: list[Column]) -> DataFrame:
    """Of rows with the same content in a group, the first by the order."""
    w = Window.partitionBy(*group, F.sha2(content, 256)).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def file_diff(new: DataFrame, active: DataFrame, known: DataFrame, key: str = "digest") -> DataFrame:
    """change, key: what a source dropped among active ones, and what is new to all states."""
    gone = active.select(key).distinct().join(new, key, "left_anti").select(F.lit("delete").alias("change"), key)
    add = new.select(key).distinct().join(known, key, "left_anti").select(F.lit("insert").alias("change"), key)
    return gone.unionByName(add)


def recent(history: DataFrame, by: list[str], n: int, current: DataFrame | None = None, key: str = "id") -> DataFrame:
    """A buffer of messages: the newest n of each scope without the current ones (keep), all others to be evicted."""
    rows = history if current is None else history.join(current.select(key), key, "left_anti")
    w = Window.partitionBy(*by).orderBy(F.desc("t_ingest"), F.desc(key))
    return rows.withColumn("keep", F.row_number().over(w) <= n)
