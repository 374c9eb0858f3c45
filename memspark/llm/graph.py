"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.shared import written

ROUNDS = 60
#: Rows of one key from which the key's partner goes to all tasks, and how many such keys there may be.
HOT, MOST = 100_000, 50_000


def met(rows: DataFrame, table: DataFrame, key: str, n_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key and, in column n, how many rows have it.

    Keys of many rows, at most MOST by their least number of rows, are broadcast
    and their rows stay where they are; the others meet by a shuffle. No task
    gets more rows of one key than HOT, or a share of 1 / MOST of all. Where
    there are no more than HOT rows, no key can have so many.
    """
    if n_rows <= HOT:
        return rows.join(table.drop("n"), key, how)
    limit = max(HOT, n_rows // MOST)
    values = [c for c in table.columns if c not in (key, "n")]
    hot = table.where(F.col("n") > limit).select(key, F.struct(*values).alias("_hot"))
    apart = rows.join(F.broadcast(hot), key, "left")
    plain = apart.where("_hot is null").drop("_hot").join(table.where(F.col("n") <= limit).select(key, *values), key, how)
    return plain.unionByName(apart.where("_hot is not null").select(*rows.columns, "_hot.*"))


def components(links: DataFrame) -> DataFrame:
    """node, root: each linked node except roots, with the smallest node it reaches.

    links has the columns a and b, both long. Every round ties all nodes to
    smaller neighbours and is written to the shared folder; a hub's links are
    summed to its smallest neighbour before they are shuffled, and meet it where
    they lie. Rounds grow with the logarithm of the longest path. Null ends,
    repeated links and links of a node to itself count for nothing; no links
    give no rows.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(now)
    for _ in range(ROUNDS):
        now = written(_small(_large(now, state[0]), state[0]), "links")
        new = _state(now)
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
    raise RuntimeError(f"components were not found in {ROUNDS} rounds")


def _state(links: DataFrame) -> tuple:
    """Count and sum of hashes: equal states are equal sets."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(links: DataFrame, n: int) -> DataFrame:
    """Tie each node's larger neighbours to its smallest one."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return met(both.where("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame, n: int) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = met(links, least, "u", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
