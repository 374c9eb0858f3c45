"""Quarantined sources and what follows from them: units that cite theirs, relations, tasks; release takes back what nothing else holds.

The state is a table of blocked units (unit_id). A unit is blocked if its source
is quarantined or a unit that it was derived from is blocked. Both changes work
on what they touch: a quarantine spreads from the source's units, a release
takes out all that the source may have blocked and puts back what another
quarantine still reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators import recall
from memspark.sources.scratch import written


def links(units: DataFrame) -> DataFrame:
    """src, dst: from a cited unit to each unit derived from it. units: unit_id, source, provenance."""
    return units.select(F.explode("provenance").alias("src"), F.col("unit_id").alias("dst")).where("src is not null")


def of_sources(units: DataFrame, sources: DataFrame) -> DataFrame:
    """Units whose source is among source_key; a null source is none."""
    return units.join(sources.select(F.col("source_key").alias("source")).distinct(), "source", "left_semi").select("unit_id")


def spread(units: DataFrame, seeds: DataFrame) -> DataFrame:
    """unit_id: the seeds and all that was derived from them, however far; cycles end."""
    return recall.reached(links(units), seeds.select(F.col("unit_id").alias("node"))).select(F.col("node").alias("unit_id")).distinct()


def blocked(units: DataFrame, quarantined: DataFrame) -> DataFrame:
    """The state from nothing: quarantined (source_key, reason); a quarantine without a reason is an error."""
    if quarantined.where("trim(coalesce(reason, '')) = '' OR trim(coalesce(source_key, '')) = ''").limit(1).count():
        raise ValueError("a quarantine needs a source and a reason")
    return written(spread(units, of_sources(units, quarantined)), "blocked")


def quarantine(state: DataFrame, units: DataFrame, sources: DataFrame) -> DataFrame:
    """The state after more sources (source_key, reason): it spreads only from units that were not blocked before."""
    new = of_sources(units, sources).join(state, "unit_id", "left_anti")
    return written(state.unionByName(spread(units, new)).distinct(), "blocked")


def release(state: DataFrame, units: DataFrame, gone: DataFrame, left: DataFrame) -> DataFrame:
    """The state after the release of sources (gone), while others (left) stay quarantined.

    All that the released sources reach is taken out; of that, what has a
    quarantined source of its own, or cites a unit that is blocked outside of
    it, is put back with all that was derived from it.
    """
    doubt = written(spread(units, of_sources(units, gone)), "doubt")
    sure = state.join(doubt, "unit_id", "left_anti")
    own = of_sources(units, left).join(doubt, "unit_id", "left_semi")
    cited = links(units).join(sure.select(F.col("unit_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("unit_id")).join(doubt, "unit_id", "left_semi")
    # what is derived from units in doubt is in doubt itself, so the spread stays among them
    return written(sure.unionByName(spread(units, own.unionByName(cited).distinct())).distinct(), "blocked")


def relation_states(relations: DataFrame, state: DataFrame) -> DataFrame:
    """relation_id, status: unavailable if an end or a piece of evidence is blocked, else its own status. relations: relation_id, source, target, evidence, status."""
    refs = relations.select("relation_id", F.explode(F.concat(F.array("source", "target"), F.coalesce("evidence", F.array().cast("array<string>")))).alias("unit_id"))
    hit = refs.join(state, "unit_id", "left_semi").select("relation_id", F.lit(True).alias("_hit")).distinct()
    return relations.join(hit, "relation_id", "left").select("relation_id", F.when(F.col("_hit"), "unavailable").otherwise(F.col("status")).alias("status"))


def task_states(tasks: DataFrame, units: DataFrame, state: DataFrame) -> DataFrame:
    """task_id, status, missing: an open task is blocked if required background is blocked or not there, partial if other background is, else ready; a closed one stays closed. missing counts what cannot be read, its ids are not told. tasks: task_id, state, background (ref, required)."""
    each = tasks.where("state = 'open'").select("task_id", F.explode("background").alias("b")).select("task_id", F.col("b.ref").alias("unit_id"), F.coalesce("b.required", F.lit(False)).alias("required"))
    good = units.select("unit_id").join(state, "unit_id", "left_anti").distinct()
    gaps = each.join(good, "unit_id", "left_anti").groupBy("task_id").agg(F.count("*").alias("missing"), F.max("required").alias("hard"))
    j = tasks.join(gaps, "task_id", "left")
    status = F.when(F.col("state") != "open", "closed").when(F.col("hard"), "blocked").when(F.col("missing") > 0, "partial").otherwise("ready")
    return j.select("task_id", status.alias("status"), F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))
