"""Retrieval as stages over tables: parse, recall with failing channels kept apart, fuse, re-check, roll up, threshold, order within bands, expand, and what each stage left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.operators import fuse, recall, temporal

#: The orders in which a pipeline may recall, read the truth record and rank.
ORDERS = ("recall_get_rank", "recall_and_get_rank", "retrieve")
#: Constant of the fusion of branches, and how many hits each multimodal branch brings.
BRANCH_K = 60


def parsed(queries: DataFrame, text: str, anchor: Column, embed: bool = True) -> DataFrame:
    """Queries as columns: raw (sanitised), tokens, keywords, entities, vector, time window, channels; a blank query has no channel."""
    raw = t.sanitised(F.col(text))
    own = queries.withColumn("raw", raw).withColumn("tokens", t.tokens(F.col("raw")))
    own = own.withColumn("keywords", F.array_distinct(F.concat("tokens", t.terms(F.col("raw"))))).withColumn("entities", t.entities(F.col("raw")))
    own = own.withColumn("vector", t.embedded(F.col("raw")) if embed else F.array().cast("array<double>")).withColumn("window", t.time_window(F.col("raw"), anchor))
    some = F.concat(F.array(F.lit("keyword"), F.lit("graph")), F.array(F.lit("vector")) if embed else F.array().cast("array<string>"), F.when(F.size("entities") > 0, F.array(F.lit("entity"))).otherwise(F.array().cast("array<string>")))
    return own.withColumn("channels", F.when(F.trim("raw") == "", F.array().cast("array<string>")).otherwise(some))


class AllChannelsFailed(ValueError):
    """No channel gave a plan."""


#: What a channel's store or job may raise; anything else is a fault of the program and is not caught.
FAILURES = (PySparkException, Py4JError, OSError, ValueError, RuntimeError)


def recalled(channels: dict[str, Callable[[], DataFrame]], asked: list[str] | None = None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """The bag of hits of the channels asked for (all by default), and (channel, error, message) of those that failed.

    Each channel's hits, the best few that it brings, are written before they
    meet the others', so a channel that fails when its plan is made or while its
    tasks run leaves the others alone; if all fail, so does the recall. The bag
    is computed once, whatever reads it. An empty list of channels is an error.
    """
    if asked is not None and not asked:
        raise ValueError("no channel")
    hits, errors = None, []
    chosen = [c for c in channels if asked is None or c in asked]
    for name in chosen:
        try:
            own = channels[name]().select("unit_id", F.col("score").cast("double").alias("score"), F.lit(name).alias("channel"))
            own = recall.written(own, f"channel-{name}")
        except FAILURES as e:
            errors.append((name, type(e).__name__, str(e)))
            continue
        hits = own if hits is None else hits.unionByName(own)
    if hits is None:
        raise AllChannelsFailed("; ".join(f"{c}: {m}" for c, _, m in errors) or "no channel is known by these names")
    return hits, errors


def graph_recall(nodes: DataFrame, edges: DataFrame, terms: list[str], depth: int, k: int) -> DataFrame:
    """unit_id, score 1: nodes within some hops of a node whose content has a term; a seed counts where another seed reaches it. nodes: unit_id, content; edges: a, b.

    A seed is reached from itself only by way of a neighbour, which is not
    another place: so seeds are in the result if a different seed is near.
    """
    seeds = nodes.where(t.any_word(F.col("content"), tuple(x for x in dict.fromkeys(terms) if x))).select("unit_id") if any(terms) else nodes.select("unit_id").limit(0)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    # pairs (seed, node) would grow with seeds times nodes: of each node only the two nearest seeds are kept, which tells whether another one reaches it
    front = seeds.select(F.col("unit_id").alias("node"), F.col("unit_id").alias("seed"), F.lit(0).alias("hop"))
    seen = front
    for hop in range(1, depth + 1):
        new = front.join(both.withColumnRenamed("a", "node"), "node").select(F.col("b").alias("node"), "seed", F.lit(hop).alias("hop")).distinct()
        w = Window.partitionBy("node").orderBy("hop", "seed")
        all_ = seen.unionByName(new).groupBy("node", "seed").agg(F.min("hop").alias("hop"))
        seen = recall.written(all_.withColumn("_r", F.row_number().over(w)).where("_r <= 2").drop("_r"), "graph-hop")
        front = seen.where(F.col("hop") == hop)
    found = seen.where("seed <> node").select(F.col("node").alias("unit_id")).distinct().join(nodes.select("unit_id"), "unit_id", "left_semi")
    return found.orderBy("unit_id").limit(k).select("unit_id", F.lit(1.0).alias("score"))


@dataclass(frozen=True)
class Pipeline:
    """A composed retrieval. fuser: (hits) -> unit_id, score; truth: the truth record; keep: what a hit has to pass there."""

    channels: dict[str, Callable[[], DataFrame]]
    truth: DataFrame
    keep: Column
    fuser: Callable[[DataFrame], DataFrame] = fuse.rrf
    order: str = ORDERS[0]
    top_k: int = 10
    ratio: float = 0.0
    min_results: int = 0
    calibrated: bool = False
    secondary: Column | None = None
    band: float = fuse.BAND
    #: unit_id, parent_id, role and the role that hits are rolled up to
    tree: DataFrame | None = None
    target_role: str | None = None
    steps: list[tuple[str, DataFrame]] = field(default_factory=list)

    def _step(self, stage: str, rows: DataFrame) -> DataFrame:
        self.steps.append((stage, rows))
        return rows

    def run(self, asked: list[str] | None = None) -> tuple[DataFrame, list[tuple[str, str, str]]]:
        """unit_id, score, position (from 0) of the best top_k, and the channels that failed."""
        if self.order not in ORDERS:
            raise ValueError(f"order is one of {ORDERS}")
        self.steps.clear()  # a run's stages are its own
        hits, errors = recalled(self.channels, asked)
        self._step("recall", hits)
        good = self.truth.where(self.keep).select("unit_id")
        if self.order == "retrieve":
            # ranked as recalled; the re-check takes hits out afterwards
            found = self.fuser(hits).select("unit_id", "score").join(good, "unit_id", "left_semi")
        else:
            # hits that the truth record refuses hold no rank
            found = self.fuser(hits.join(good, "unit_id", "left_semi")).select("unit_id", "score")
        self._step("fuse", found)
        if self.tree is not None and self.target_role:
            found = self._step("rollup", temporal.rolled_up(found, self.tree, self.target_role))
        found = self._step("threshold", fuse.threshold(found, self.ratio, min_results=self.min_results))
        w = Window.orderBy(F.desc(F.round("score", 12)), "unit_id")
        cut = found.orderBy(F.desc(F.round("score", 12)), "unit_id").limit(max(self.top_k, recall.RERANK_BUDGET))
        if self.secondary is not None and self.calibrated:
            own = self.truth.select("unit_id", self.secondary.alias("secondary"))
            rows = own.join(F.broadcast(cut), "unit_id").select(F.lit("q").alias("query_id"), "unit_id", "score", "secondary")
            placed = cut.join(fuse.banded(rows, self.band).select("unit_id", "position"), "unit_id")  # the same hits in another order
        else:
            placed = cut.withColumn("position", F.row_number().over(w) - 1)
        out = self._step("cut", placed.where(F.col("position") < self.top_k).select("unit_id", "score", F.col("position").cast("long").alias("position")))
        return out, errors

    def trajectory(self) -> DataFrame:
        """stage, channel (of the recall), candidate_count, at (the stage's place) of the stages of the last run(). The recall's bag was written by that run; later stages are small."""
        out = None
        for k, (stage, rows) in enumerate(self.steps):
            if stage == "recall":
                own = rows.groupBy("channel").agg(F.count("*").alias("candidate_count"))
            else:
                own = rows.agg(F.count("*").alias("candidate_count")).select(F.lit(None).cast("string").alias("channel"), "candidate_count")
            own = own.select(F.lit(stage).alias("stage"), "channel", "candidate_count", F.lit(k).alias("at"))
            out = own if out is None else out.unionByName(own)
        return out


def precision_of(start: Column, end: Column) -> Column:
    """year, month or day for whole ones of the calendar, else datetime; unknown for an open window."""
    whole = start == F.date_trunc("day", start)
    return (
        F.when(start.isNull() | end.isNull(), "unknown")
        .when(whole & (start == F.date_trunc("year", start)) & (end == F.add_months(start, 12).cast("timestamp")), "year")
        .when(whole & (start == F.date_trunc("month", start)) & (end == F.add_months(start, 1).cast("timestamp")), "month")
        .when(whole & (end == start + F.expr("interval 1 day")), "day")
        .otherwise("datetime")
    )


def temporal_plan(explicit: Column, parsed_from: Column, parsed_to: Column, window: Column, auto: bool = True) -> Column:
    """struct(mode, from, to, precision, source) of a query.

    What is asked for explicitly (a struct of mode, from, to; null if nothing
    is) comes first; then, if auto, the parsed window, then the one that the
    text names; else nothing is asked of time.
    """
    make = lambda mode, a, b, source: F.struct(mode.alias("mode"), a.cast("timestamp").alias("from"), b.cast("timestamp").alias("to"), precision_of(a.cast("timestamp"), b.cast("timestamp")).alias("precision"), F.lit(source).alias("source"))
    none = F.struct(F.lit("none").alias("mode"), F.lit(None).cast("timestamp").alias("from"), F.lit(None).cast("timestamp").alias("to"), F.lit("unknown").alias("precision"), F.lit("none").alias("source"))
    out = F.when(explicit.isNotNull(), make(explicit["mode"], explicit["from"], explicit["to"], "explicit"))
    if auto:
        out = out.when(parsed_from.isNotNull() | parsed_to.isNotNull(), make(F.lit("range"), parsed_from, parsed_to, "rule")).when(window.isNotNull(), make(F.lit("range"), window["start"], window["end"], "text"))
    return out.otherwise(none)


def branches(queries: dict[str, DataFrame], k: int, rrf_k: int = BRANCH_K) -> DataFrame:
    """unit_id, score: several branches' ranked hits (unit_id, score) fused by their places; the best k."""
    hits = None
    for name, rows in queries.items():
        own = rows.select("unit_id", "score", F.lit(name).alias("channel"))
        hits = own if hits is None else hits.unionByName(own)
    return recall.best(fuse.rrf(hits, rrf_k, first_rank=1).select("unit_id", "score"), k)


def property_recall(entries: DataFrame, hits: DataFrame, entity: str, budget: int, around: int, lo: Column, hi: Column) -> DataFrame:
    """The schema-temporal chain over property entries (entity, property, unit_id, anchor, anchor_end, knowledge): hits (unit_id, score) with the entries beside them on their timelines, within [lo, hi), the best of each entity, and their text.

    Neighbours are taken before the event filter, so an entry beside a hit
    counts if it lies in the window itself; they have no score of their own.
    """
    marked = entries.join(hits.select("unit_id", "score"), "unit_id", "left")
    near = temporal.neighbours(marked, [entity, "property"], F.col("score").isNotNull(), around)
    meant = temporal.in_range(near, lo, hi)
    return temporal.shrink(meant, entity, budget, [F.desc_nulls_last("score"), F.asc("anchor"), F.asc("unit_id")])
