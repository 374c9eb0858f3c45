"""Versions, property timelines, and groups of units in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.sources.scratch import written

#: Defaults of time groups.
SPAN_SECONDS, SCENE_SECONDS, EVENT_COSINE = 7200, 14 * 86_400, 0.65


def timeline_order() -> list[Column]:
    """Dated entries first, by date, then by what was known when, then id."""
    return [F.col("anchor").isNotNull().desc(), F.col("anchor").asc_nulls_last(), F.col("knowledge"), F.col("unit_id")]


def latest(entries: DataFrame, by: list[str]) -> DataFrame:
    """The entry of each property with the greatest date (knowledge time without one), knowledge time and id."""
    cols = [c for c in entries.columns if c not in by]
    key = F.struct(F.coalesce("anchor", "knowledge"), "knowledge", "unit_id")
    return entries.groupBy(*by).agg(F.max_by(F.struct(*cols), key).alias("x")).select(*by, "x.*")


def snapshot(entries: DataFrame, by: list[str], at: Column) -> DataFrame:
    """The entry in force at a moment: the last dated one up to it, else the latest undated one."""
    cols = [c for c in entries.columns if c not in by]
    ok = entries.where(F.col("anchor").isNull() | (F.col("anchor") <= at))
    key = F.struct(F.col("anchor").isNotNull(), "anchor", "knowledge", "unit_id")
    return ok.groupBy(*by).agg(F.max_by(F.struct(*cols), key).alias("x")).select(*by, "x.*")


def in_range(entries: DataFrame, lo: Column, hi: Column, undated: bool = False) -> DataFrame:
    """Entries whose event interval meets [lo, hi)."""
    meets = (F.col("anchor") < hi) & (F.coalesce("anchor_end", F.col("anchor")) >= lo)
    keep = F.coalesce(meets, F.lit(False))
    return entries.where(keep | F.col("anchor").isNull() if undated else keep)


def known_at(at: Column) -> Column:
    """What was known at a moment; archived and superseded entries are seen only without one."""
    return (F.col("lifecycle") != "forgotten") & (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def at_points(points: list[int], start: str = "anchor", end: str = "anchor_end") -> Column:
    """Whether the interval holds any of the points."""
    return F.exists(F.array(*map(F.lit, points)), lambda p: (F.col(start) <= p) & (F.col(end).isNull() | (p < F.col(end))))


def neighbours(entries: DataFrame, by: list[str], hit: Column, n: int) -> DataFrame:
    """Entries up to n places before or after a hit on the same timeline."""
    w = Window.partitionBy(*by).orderBy(*timeline_order()).rowsBetween(-n, n)
    return entries.withColumn("_near", F.max(hit.cast("int")).over(w)).where("_near = 1").drop("_near")


def shrink(entries: DataFrame, entity: str, budget: int, order: list[Column]) -> DataFrame:
    """The best entries of each entity."""
    w = Window.partitionBy(entity).orderBy(*order)
    return entries.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= budget).drop("_r")


def budgets(counts: DataFrame, total: int, least: int, most: int) -> DataFrame:
    """Each entity's share of a total, clamped."""
    all_ = counts.agg(F.sum("n").alias("_all"))
    share = F.floor(F.lit(total) * F.col("n") / F.col("_all"))
    return counts.crossJoin(F.broadcast(all_)).withColumn("budget", F.greatest(F.lit(least), F.least(F.lit(most), share)).cast("long")).drop("_all")  # one row


def as_of(versions: DataFrame, asked: DataFrame, family: str, at: str) -> DataFrame:
    """For each asked (family, at) the version valid then with the greatest start."""
    cols = [c for c in versions.columns if c != family]
    j = asked.join(versions, family).where((F.col("t_valid") <= F.col(at)) & (F.col("t_invalid").isNull() | (F.col(at) < F.col("t_invalid"))))
    return j.groupBy(*asked.columns).agg(F.max_by(F.struct(*cols), F.struct("t_valid", "unit_id")).alias("x")).select(*asked.columns, "x.*")


def gap_groups(rows: DataFrame, by: list[str], order: list[Column], boundary: Column) -> DataFrame:
    """group: a running number of rows at which a boundary, told from the row before alone, holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("_b", F.coalesce(boundary, F.lit(True)).cast("int"))
    return marked.withColumn("group", F.sum("_b").over(w)).drop("_b")


def span_groups(rows: DataFrame, user: str, seconds: float = SPAN_SECONDS) -> DataFrame:
    """group, start of each row's time span. rows: user, unit_id, session, at (seconds).

    A span ends where the session changes or where a row lies more than
    `seconds` after the span's own start, so membership is a fold along each
    user's rows. Runs cut by sessions are independent: the fold goes session run
    by session run.
    """
    w = Window.partitionBy(user).orderBy("at", "unit_id")
    cut = rows.withColumn("_run", F.sum(F.when(F.col("session").eqNullSafe(F.lag("session").over(w)) & F.lag("at").over(w).isNotNull(), 0).otherwise(1)).over(w))

    def fold(batches):
        import pyarrow as pa

        run, start = None, None
        for batch in batches:
            starts = []
            for u, r, a in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (u, r) != run or a - start > seconds:
                    run, start = (u, r), a
                starts.append(start)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.float64())], [user, "unit_id", "start"])

    # sorted runs are folded as they stream by: the state is one start, however long a run is
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.select(user, "unit_id", "_run", "at").repartition(n, user, "_run").sortWithinPartitions(user, "_run", "at", "unit_id")
    kinds = dict(rows.dtypes)
    return dealt.mapInArrow(fold, f"{user} {kinds[user]}, unit_id {kinds['unit_id']}, start double")


def event_groups(rows: DataFrame, by: list[str], order: list[Column], least_overlap: float, least_cosine: float = EVENT_COSINE) -> DataFrame:
    """Adjacent rows belong together while metadata agree, entities overlap enough and vectors are close enough. rows: meta, entities, vector."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    near = t.overlap_coefficient(F.col("entities"), before("entities")) >= least_overlap
    close = t.cosine(F.col("vector"), before("vector")) >= least_cosine
    return gap_groups(rows, by, order, ~(F.col("meta").eqNullSafe(before("meta")) & near & close))


def parents(groups: DataFrame, by: list[str]) -> DataFrame:
    """One parent of each group: span, ordered children, count."""
    return groups.groupBy(*by).agg(F.min("at").alias("span_start"), F.max("end").alias("span_end"), F.transform(F.array_sort(F.collect_list(F.struct("at", "unit_id"))), lambda x: x["unit_id"]).alias("child_ids"), F.count("*").alias("n"))


def settled(groups: DataFrame, by: list[str], now: Column, settle: float) -> DataFrame:
    """All groups but the last of each user, and the last once it has been silent long enough."""
    w = Window.partitionBy(*by)
    last = F.col("span_start") == F.max("span_start").over(w)
    return groups.withColumn("settled", ~last | (now - F.col("span_end") > settle))


def safe_prefix(groups: DataFrame, by: list[str]) -> DataFrame:
    """Settled groups before the first one that ends at or after the start of any pending one after it."""
    after = Window.partitionBy(*by).orderBy("span_start").rowsBetween(1, Window.unboundedFollowing)
    upto = Window.partitionBy(*by).orderBy("span_start").rowsBetween(Window.unboundedPreceding, 0)
    pending = F.min(F.when(~F.col("settled"), F.col("span_start"))).over(after)
    bad = ~F.col("settled") | F.coalesce(F.col("span_end") >= pending, F.lit(False))
    return groups.withColumn("_bad", bad).withColumn("_stop", F.max(F.col("_bad").cast("int")).over(upto)).where("_stop = 0").drop("_bad", "_stop")


def rolled_up(hits: DataFrame, tree: DataFrame, target: str, hops: int = 3) -> DataFrame:
    """unit_id, score: each hit's ancestor of the target role within some hops, with the best score below it. tree: unit_id, parent_id, role."""
    now = hits.join(tree.select("unit_id", "parent_id", "role"), "unit_id")
    out = now.where(F.col("role") == target).select("unit_id", "score")
    for _ in range(hops):
        up = now.where((F.col("role") != target) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("unit_id"), "score")
        now = up.join(tree.select("unit_id", "parent_id", "role"), "unit_id")
        out = out.unionByName(now.where(F.col("role") == target).select("unit_id", "score"))
    return out.groupBy("unit_id").agg(F.max("score").alias("score"))


def expanded(roots: DataFrame, children: DataFrame, depth: int, limit: int) -> DataFrame:
    """root, unit_id, depth, pos: descendants in order, cut after so many nodes of a root. children: unit_id, child_id, pos."""
    front = roots.select(F.col("unit_id").alias("root"), F.col("unit_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("pos"), F.array("unit_id").alias("path"))
    out = front
    for d in range(1, depth + 1):
        j = front.select("root", "unit_id", "path").join(children.select("unit_id", "child_id", F.col("pos").alias("p")), "unit_id")
        front = j.where(~F.array_contains("path", F.col("child_id"))).select("root", F.col("child_id").alias("unit_id"), F.lit(d).alias("depth"), F.col("p").alias("pos"), F.array_append("path", F.col("child_id")).alias("path"))
        out = out.unionByName(front)
    w = Window.partitionBy("root").orderBy("depth", "pos", "unit_id")
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r", "path")


def tree_faults(tree: DataFrame) -> DataFrame:
    """unit_id, fault: self references, missing or one-sided parents, several parents, children outside their parent's span. tree: unit_id, parent_id, child_ids, span_start, span_end."""
    down = tree.select(F.col("unit_id").alias("p"), F.col("span_start").alias("ps"), F.col("span_end").alias("pe"), F.explode("child_ids").alias("unit_id"))
    own = tree.where("parent_id = unit_id").select("unit_id", F.lit("self").alias("fault"))
    up = tree.where("parent_id IS NOT NULL").select("unit_id", F.col("parent_id").alias("p"))
    one_sided = up.join(down.select("unit_id", "p"), ["unit_id", "p"], "left_anti").select("unit_id", F.lit("not_listed").alias("fault"))
    stray = down.select("unit_id", "p").join(up, ["unit_id", "p"], "left_anti").select("unit_id", F.lit("not_claimed").alias("fault"))
    many = down.groupBy("unit_id").agg(F.countDistinct("p").alias("n")).where("n > 1").select("unit_id", F.lit("many_parents").alias("fault"))
    outside = tree.join(down, "unit_id").where("span_start < ps OR span_end > pe").select("unit_id", F.lit("outside").alias("fault"))
    return own.unionByName(one_sided).unionByName(stray).unionByName(many).unionByName(outside)


def scene_groups(rows: DataFrame, user: str, seconds: float, least_cosine: float) -> DataFrame:
    """user, unit_id, start: a scene ends at a change of meta, after an end signal, where adjacent vectors differ, or where a row lies too long after the scene's start.

    The first three cuts are told from the row before, so windows make them;
    only the time since the start is carried, by the fold of span_groups within
    the runs between those cuts. rows: unit_id, at, meta, ends, vector.
    """
    w = Window.partitionBy(user).orderBy("at", "unit_id")
    before = lambda c: F.lag(c).over(w)
    cut = before("at").isNull() | ~F.col("meta").eqNullSafe(before("meta")) | F.coalesce(before("ends"), F.lit(False)) | (t.cosine(F.col("vector"), before("vector")) < least_cosine)
    runs = rows.withColumn("_cut", cut).withColumn("session", F.sum(F.col("_cut").cast("int")).over(w))
    return span_groups(runs.select(user, "unit_id", "session", "at"), user, seconds)


def batches(rows: DataFrame, by: list[str], order: list[Column], cut: Column, size: int) -> DataFrame:
    """group, batch: continuous runs in batches of at most so many rows. A batch is full by its place in the run, so nothing has to be carried."""
    g = gap_groups(rows, by, order, cut)
    place = F.row_number().over(Window.partitionBy(*by, "group").orderBy(*order)) - 1
    return g.withColumn("batch", F.floor(place / size))


def families(versions: DataFrame, most: int = 64) -> DataFrame:
    """unit_id, family: the oldest version that a chain of supersedes leads to; a version that is not there ends the chain before it.

    Pointers are doubled, so a chain of n versions takes log2(n) joins; each
    step is written to the shared folder. A ring of versions fails.
    """
    own = versions.select("unit_id", F.col("supersedes").alias("up"))
    there = own.select(F.col("unit_id").alias("up"), F.lit(True).alias("_there"))
    jump = written(own.join(there, "up", "left").select("unit_id", F.when(F.col("_there"), F.col("up")).otherwise(F.col("unit_id")).alias("up")), "family")
    for _ in range(most):
        far = jump.select(F.col("unit_id").alias("up"), F.col("up").alias("_far"))
        nxt = written(jump.join(far, "up").select("unit_id", F.col("_far").alias("up"), (F.col("_far") != F.col("up")).alias("moved")), "family")
        jump = nxt.select("unit_id", "up")
        if not nxt.where("moved").limit(1).count():
            break
    roots = own.join(there, "up", "left").where("_there IS NULL").select(F.col("unit_id").alias("up"), F.lit(True).alias("_root"))
    ring = F.raise_error(F.lit("versions supersede each other in a ring")).cast("boolean")
    return jump.join(roots, "up", "left").where(F.coalesce("_root", ring)).select("unit_id", F.col("up").alias("family"))


def assembled(entries: DataFrame, entity: str, prop: str, at: str, unit: str) -> DataFrame:
    """entity, properties: a map from each property to its entries' ids in the order of time, then id."""
    lines = entries.groupBy(entity, prop).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(unit).alias("id")))).alias("tl"))
    return lines.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct(prop, F.transform("tl", lambda x: x["id"]).alias("v")))).alias("properties"))
