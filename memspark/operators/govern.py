"""Audit, usage, decisions and inheritance."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def audit(rows: DataFrame, exact: dict[str, object], after=None, before=None, limit: int | None = None) -> DataFrame:
    """Audit rows with given fields in an inclusive time range, oldest first."""
    for k, v in exact.items():
        rows = rows.where(F.col(k) == v)
    if after is not None:
        rows = rows.where(F.col("occurred_at") >= F.lit(after).cast("timestamp"))
    if before is not None:
        rows = rows.where(F.col("occurred_at") <= F.lit(before).cast("timestamp"))
    rows = rows.orderBy("seq")
    return rows if limit is None else rows.limit(limit)


def decide(ladder: list[tuple[Column, str]], default: str) -> Column:
    """The first condition that holds decides."""
    out = F.when(*ladder[0])
    for cond, reason in ladder[1:]:
        out = out.when(cond, reason)
    return out.otherwise(default)


def inherited(rows: DataFrame, group: list[str], column: str) -> DataFrame:
    """For each group the entries of a map on which all its rows agree."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    each = rows.select(*group, F.explode(column).alias("k", "v")).groupBy(*group, "k").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    same = each.join(sizes, group).where("c = _n AND lo = hi")
    return same.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("k", F.col("lo").alias("v")))).alias(column))


def broken_links(rows: DataFrame, seq: str = "seq", digest: str = "digest", previous: str = "previous_digest") -> DataFrame:
    """Rows whose previous digest is not that of the row before. Rows are tied by their number, which has no gaps, so any part can be checked by itself."""
    before = rows.select((F.col(seq) + 1).alias(seq), F.col(digest).alias("_expected"))
    return rows.join(before, seq, "left").where(~F.coalesce(F.col(previous) == F.col("_expected"), F.col(previous).isNull() & F.col("_expected").isNull())).drop("_expected")


def usage(entries: DataFrame, by: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """Counts of memories and messages by key prefix, and bytes."""
    return entries.groupBy(*by).agg(
        F.count_if(F.col(key).startswith("/memory/")).alias("memory_count"),
        F.count_if(F.col(key).startswith("/messages/")).alias("message_count"),
        F.sum(F.octet_length(value).cast("long")).alias("storage_bytes"),
    )


def state_counts(units: DataFrame, states: tuple[str, ...], column: str = "lifecycle") -> DataFrame:
    """Counts of all states, zeros too."""
    row = units.groupBy().agg(*(F.count_if(F.col(column) == s).alias(s) for s in states))
    return row.select(F.explode(F.array(*(F.struct(F.lit(s).alias(column), F.col(s).alias("n")) for s in states))).alias("x")).select("x.*")


def snapshot_token(rows: DataFrame, columns: list[str], buckets: int = 64) -> DataFrame:
    """A hash of a set of rows that no order changes: hashes are summed by bucket first, so no list of all rows is gathered."""
    h = F.sha2(F.to_json(F.struct(*columns)), 256)
    low = F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(h, 13, 12), 16, 10).cast("decimal(38,0)")
    by = rows.select(h.alias("h"), low.alias("a"), high.alias("b")).groupBy(F.substring("h", 1, 2).alias("k")).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return by.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("k", "n", "a", "b")))), 256).alias("token"))


def latest_label(rows: DataFrame, by: str, label: str, order: list[str]) -> DataFrame:
    """The last label that is not empty."""
    return rows.where(F.coalesce(label, F.lit("")) != "").groupBy(by).agg(F.max_by(label, F.struct(*order)).alias(label))


def top_by(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def chained(rows: DataFrame, chain: str, seq: str, body: str, heads: dict[str, str] | None = None) -> DataFrame:
    """chain, seq, previous_digest, digest: new rows of append-only logs, each bound to the row before; heads are the digests that the chains ended with.

    A chain is in order by nature: its rows stream by sorted, and the state is
    one digest. Checking needs no order (broken_links).
    """
    known = dict(heads or {})

    def run(batches):
        last, digest = None, ""
        for pdf in batches:
            before, after = [], []
            for c, n, x in zip(pdf[chain], pdf[seq], pdf[body], strict=True):
                if c != last:
                    last, digest = c, known.get(c, "")
                before.append(digest)
                digest = hashlib.sha256(f"{digest}\n{c}\n{n}\n{x or ''}".encode()).hexdigest()
                after.append(digest)
            yield pdf[[chain, seq]].assign(previous_digest=before, digest=after)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(chain).cast("string").alias(chain), F.col(seq).cast("long").alias(seq), body).repartition(n, chain).sortWithinPartitions(chain, seq)
    return dealt.mapInPandas(run, f"{chain} string, {seq} long, previous_digest string, digest string")


def revoked(grants: DataFrame, named: DataFrame, on: list[str], now: Column) -> DataFrame:
    """Grants with those named closed at a moment; one that was closed before keeps its time."""
    hit = named.select(*on).distinct().withColumn("_hit", F.lit(True))
    return grants.join(hit, on, "left").withColumn("revoked_at", F.coalesce("revoked_at", F.when(F.col("_hit"), now))).drop("_hit")


def write_targets(items: DataFrame, targets: DataFrame, on: list[str], item: str, most: int = 8) -> DataFrame:
    """The spaces that each item goes to, by order of priority; more of them than the limit is an error, none are left out. targets: on, target, priority, writable."""
    j = items.join(targets.where("writable"), on)
    n = F.count("*").over(Window.partitionBy(item))
    over = F.raise_error(F.lit("too many write targets")).cast("boolean")
    return j.withColumn("_n", n).where(F.when(F.col("_n") <= most, True).otherwise(over)).withColumn("place", F.row_number().over(Window.partitionBy(item).orderBy("priority", "target"))).drop("_n")


def personal(units: DataFrame, views: list[tuple[Column, Column]]) -> DataFrame:
    """Units of several scopes as one list, each once. A view is (its rows, whether the caller may read there): a scope that may not be read adds nothing, and if none may, the list is refused."""
    seen = F.lit(False)
    may = F.lit(False)
    for rows, allowed in views:
        seen = seen | (F.coalesce(rows, F.lit(False)) & F.coalesce(allowed, F.lit(False)))
        may = may | F.coalesce(allowed, F.lit(False))
    refused = F.raise_error(F.lit("no scope may be read")).cast("boolean")
    return units.where(F.when(may, seen).otherwise(refused)).dropDuplicates(["unit_id"])


def unsettled(rows: DataFrame, by: list[str], least: int, done: Column) -> DataFrame:
    """by, n: groups of at least so many rows that are not all done."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and(done).alias("_done")).where((F.col("n") >= least) & ~F.coalesce("_done", F.lit(False))).drop("_done")


def coverage(rows: DataFrame, by: list[str], covered: Column, seq: str) -> DataFrame:
    """by, coverage (unknown, partial, covered) and watermark (the greatest seq seen)."""
    g = rows.groupBy(*by).agg(F.count_if(covered).alias("_c"), F.count("*").alias("_n"), F.max(seq).alias("watermark"))
    return g.select(*by, F.when(F.col("_c") == 0, "unknown").when(F.col("_c") < F.col("_n"), "partial").otherwise("covered").alias("coverage"), "watermark")


def job_states(log: DataFrame) -> DataFrame:
    """job_id, state, at of jobs from their log (job_id, seq, state): the first of done, failed and cancelled ends a job, else the last entry counts."""
    end = F.col("state").isin("done", "failed", "cancelled")
    g = log.groupBy("job_id").agg(F.min(F.when(end, F.struct("seq", "state"))).alias("_end"), F.max(F.struct("seq", "state")).alias("_last"))
    return g.select("job_id", F.coalesce("_end.state", "_last.state").alias("state"), F.coalesce("_end.seq", "_last.seq").alias("at"))
