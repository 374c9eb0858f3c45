"""Typed relations within open clusters, the actions that follow from them, and span parents kept up to date."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.operators import evolve, temporal

TYPES = ("contradicts", "same", "refines", "independent", "newer")
#: Shares of words from which texts are the same, and from which a negation is one of the other text.
SAME, ABOUT = 0.8, 0.5


def relation(older: Column, newer: Column, gap: Column, together: float) -> Column:
    """What a newer value is to the older one, by the words of both, their negations and the time between them.

    contradicts: one is negated, and they share ABOUT of the shorter one's words;
    same: SAME of all words are common; refines: the newer one has all words of
    the older and more; independent: no common word within ``together`` (both
    hold at once); newer otherwise.
    """
    a, b = F.array_distinct(t.tokens(older)), F.array_distinct(t.tokens(newer))
    common, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return (
        F.when(t.negation_differs(older, newer) & (common >= ABOUT * least) & (least > 0), "contradicts")
        .when(common >= SAME * F.size(F.array_union(a, b)), "same")
        .when((common == F.size(a)) & (F.size(b) > F.size(a)), "refines")
        .when((common == 0) & (gap <= together), "independent")
        .otherwise("newer")
    )


def detected(members: DataFrame, by: list[str], together: float = 0.0) -> DataFrame:
    """Members of open clusters (by, unit_id, content, t_ingest) with previous, previous_content and relation to the member before them in time.

    The first member of a cluster has none. Only neighbours in time are
    compared, so the work is linear in a cluster's size; a cluster is sorted,
    never held. Null contents are empty ones.
    """
    w = Window.partitionBy(*by).orderBy("t_ingest", "unit_id")
    rows = members.withColumn("content", F.coalesce("content", F.lit("")))
    rows = rows.withColumn("previous", F.lag("unit_id").over(w)).withColumn("previous_content", F.lag("content").over(w)).withColumn("_gap", F.col("t_ingest") - F.lag("t_ingest").over(w))
    return rows.withColumn("relation", F.when(F.col("previous").isNotNull(), relation(F.col("previous_content"), F.col("content"), F.col("_gap"), together))).drop("_gap")


def actions(related: DataFrame, by: list[str]) -> DataFrame:
    """The actions of detected() relations, as consolidated() takes them: by, seq, type, unit_id, content, unit_ids.

    Neighbours that are the same make a group. A group that a newer or refined
    value follows is archived, member by member; another one of two and more is
    merged into its newest text; a single value that contradicts the one before
    it is updated to say so. Independent values stay.
    """
    w = Window.partitionBy(*by).orderBy("t_ingest", "unit_id")
    rows = related.withColumn("_g", F.sum(F.when(F.col("relation").eqNullSafe("same"), 0).otherwise(1)).over(w)).withColumn("_next", F.lead("relation").over(w))
    groups = rows.groupBy(*by, "_g").agg(
        F.array_sort(F.collect_list(F.struct("t_ingest", "unit_id", "content"))).alias("m"),
        F.max_by("_next", F.struct("t_ingest", "unit_id")).alias("after"),
        F.min_by("relation", F.struct("t_ingest", "unit_id")).alias("relation"),
        F.min_by("previous_content", F.struct("t_ingest", "unit_id")).alias("before"),
    )
    ids, last = F.transform("m", lambda x: x["unit_id"]), F.element_at("m", -1)
    none = F.array().cast("array<string>")
    text = F.lit(None).cast("string")
    make = lambda kind, unit, content, many: F.struct(F.lit(kind).alias("type"), unit.alias("unit_id"), content.alias("content"), many.alias("unit_ids"))
    done = (
        F.when(F.col("after").isin("newer", "refines"), F.transform(ids, lambda u: make("archive", u, text, none)))
        .when(F.size("m") > 1, F.array(make("merge", text, last["content"], ids)))
        .when(F.col("relation") == "contradicts", F.array(make("update", last["unit_id"], F.concat(last["content"], F.lit(" [against: "), "before", F.lit("]")), none)))
    )
    each = groups.where(done.isNotNull()).select(*by, "_g", F.posexplode(done).alias("_k", "a"))
    return each.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("_g", "_k")) - 1).alias("seq"), "a.*")


def conflict_plan(units: DataFrame, by: list[str], together: float = 0.0, least: int = 2) -> DataFrame:
    """From units alone to the plan of consolidated(): open clusters, relations, actions."""
    members = evolve.open_clusters(units, by, least)[0]
    return evolve.consolidated(units, actions(detected(members, by, together), by), by, least)


def _folded(rows: DataFrame, user: str, seconds: float) -> DataFrame:
    """Rows (user, unit_id, session, at, end, head, within) with the head that the fold gives them, and whether it was needed.

    A span is named by its head, its first leaf: two spans can begin at one
    moment. It ends where the session changes or a leaf lies more than
    ``seconds`` after the head. Past the last new leaf (not within), from where
    a span begins with a stored one's head, all is as it was. Sorted rows stream
    by; the state is one head.
    """
    kinds = dict(rows.dtypes)
    schema = f"{user} {kinds[user]}, unit_id string, session string, at double, end double, head string, _touched boolean"

    def fold(batches: Iterable) -> Iterator:
        import pyarrow as pa

        who = run = begin = head = None
        same = False
        for batch in batches:
            heads, touched = [], []
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6)]
            for u, unit, session, at, stored, within in zip(*columns, strict=True):
                if u != who or session != run or at - begin > seconds:
                    same = u == who and (same or (not within and stored == unit))
                    who, run, begin, head = u, session, at, unit
                heads.append(stored if same else head)
                touched.append(not same)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(heads, pa.string()), pa.array(touched)], [user, "unit_id", "session", "at", "end", "head", "_touched"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(user, F.col("unit_id").cast("string").alias("unit_id"), F.col("session").cast("string").alias("session"), F.col("at").cast("double").alias("at"), F.col("end").cast("double").alias("end"), "head", "within")
    return own.repartition(n, user).sortWithinPartitions(user, "at", "unit_id").mapInArrow(fold, schema)


def assigned(leaves: DataFrame, user: str, seconds: float) -> DataFrame:
    """Leaves (user, unit_id, session, at, end) with the head of their span: a full derivation."""
    return _folded(leaves.select("*", F.lit(None).cast("string").alias("head"), F.lit(True).alias("within")), user, seconds).drop("_touched")


def parents_of(leaves: DataFrame, user: str) -> DataFrame:
    """user, head, span_start, span_end, child_ids, n of assigned leaves."""
    return temporal.parents(leaves, [user, "head"])


def recomposed(parents: DataFrame, leaves: DataFrame, new: DataFrame, user: str, seconds: float) -> tuple[DataFrame, DataFrame]:
    """Parents and assigned leaves after a run of new leaves, late ones too: the same as a full derivation.

    For each user with new leaves the fold begins at the last stored span that
    begins before the first of them, and ends where, after the last of them, a
    span begins where a stored one did: from there on nothing changes. Only
    parents between those two points are made anew, all others are kept as they
    are. leaves: rows of assigned(); new: the same without head. A new leaf's
    id is in no stored one.
    """
    new = new.select(user, F.col("unit_id").cast("string").alias("unit_id"), F.col("session").cast("string").alias("session"), F.col("at").cast("double").alias("at"), F.col("end").cast("double").alias("end"), F.lit(None).cast("string").alias("head"))
    first = new.groupBy(user).agg(F.min(F.struct("at", "unit_id")).alias("first"), F.max(F.struct("at", "unit_id")).alias("last"))
    begins = parents.select(user, F.struct(F.col("span_start").alias("at"), F.col("head").alias("unit_id")).alias("begins"))
    reach = first.join(begins, user, "left").groupBy(user, "first", "last").agg(F.max(F.when(F.col("begins") < F.col("first"), F.col("begins"))).alias("from"))
    reach = reach.select(user, F.coalesce("from", "first").alias("from"), "last")
    here = F.struct("at", "unit_id")
    rows = leaves.select(*new.columns).unionByName(new).join(reach, user).where(here >= F.col("from")).withColumn("within", here <= F.col("last"))
    made = _folded(rows, user, seconds).where("_touched").drop("_touched")
    changed = made.select(user, "unit_id")
    kept = leaves.join(changed, [user, "unit_id"], "left_anti")
    gone = leaves.join(changed, [user, "unit_id"], "left_semi").select(user, "head").distinct()
    return parents.join(gone, [user, "head"], "left_anti").unionByName(parents_of(made, user).select(*parents.columns)), kept.unionByName(made.select(*leaves.columns))
