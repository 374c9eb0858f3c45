"""Role views with an order of exploration: first in, first out, with caps on nodes and edges that hold in that order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.sources.scratch import written

PATHS = "root string, position long, edge_id string, src string, node string, duties array<string>, hops int"


def bounded_view(seeds: DataFrame, edges: DataFrame, rules: DataFrame, depth: int, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame]:
    """The paths (PATHS) and nodes (root, node, position) of each root's view, as a queue would visit them.

    seeds: root, pos, node, duties; edges: edge_id, src, dst, edge_type,
    confirmed; rules: duty, edge_type, priority. A state is a node with the
    duties that are still valid there. States leave the queue in the order in
    which they came; a state's edges are tried by their type's priority, then
    id. An edge counts if it is confirmed, a valid duty allows its type, and its
    end is in the view or there is room for it; after max_edges edges the view
    is full. A state that another one has all duties of, in no more hops, is not
    followed; of one hop's states of a node the larger one wins.

    All roots go on together, hop by hop: a hop's states are a queue's stretch,
    and the caps are ranks in its order, so each hop is a join, sorts within a
    root and no state on the driver. A hub's edges beyond the first max_edges
    are never read into a root's view. Seeds over the cap are left out.
    """
    r = rules.groupBy("edge_type").agg(F.collect_set("duty").alias("allowed"), F.min("priority").alias("priority"))
    good = edges.where("confirmed").join(r, "edge_type").select("edge_id", "src", "dst", "allowed", "priority")
    # no root can follow more of a node's edges than the cap; all duties' edges are kept apart by what they allow
    near = Window.partitionBy("src", "allowed").orderBy("priority", "edge_id")
    good = written(good.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= max_edges).drop("_n").withColumn("allowed", F.array_sort("allowed")), "view-edges")
    first = Window.partitionBy("root").orderBy("pos", "node")
    once = seeds.withColumn("_d", F.row_number().over(Window.partitionBy("root", "node").orderBy("pos"))).where("_d = 1").drop("_d")
    ranked = once.withColumn("position", F.row_number().over(first)).where(F.col("position") <= max_nodes)
    front = written(ranked.select("root", "node", F.array_sort("duties").alias("duties"), F.col("position").cast("long").alias("order")), "view-front")
    nodes = [front.select("root", "node", F.col("order").alias("position"))]
    states, paths = [front.select("root", "node", "duties")], []
    for hop in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, nodes)
        used = reduce(DataFrame.unionByName, paths) if paths else None
        tried = front.withColumnRenamed("node", "src").join(good, "src").withColumn("duties", F.array_sort(F.array_intersect("duties", "allowed"))).where(F.size("duties") > 0)
        line = Window.partitionBy("root").orderBy("order", "priority", "edge_id")
        tried = tried.select("root", "order", "priority", "edge_id", "src", F.col("dst").alias("node"), "duties")
        # of one state and of one hop no more than the caps can count
        tried = tried.join(seen.select("root", "node", F.lit(True).alias("_in")), ["root", "node"], "left").withColumn("_at", F.row_number().over(line))
        fresh = Window.partitionBy("root", "node").orderBy("_at")
        tried = tried.withColumn("_new", F.col("_in").isNull() & (F.row_number().over(fresh) == 1))
        size = seen.groupBy("root").agg(F.count("*").alias("_size"))
        done = used.groupBy("root").agg(F.count("*").alias("_done")) if used is not None else size.select("root", F.lit(0).alias("_done"))
        tried = tried.join(size, "root", "left").join(done, "root", "left").na.fill(0, ["_size", "_done"])
        upto = Window.partitionBy("root").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        tried = tried.withColumn("_rank", F.sum(F.col("_new").cast("int")).over(upto))
        # an end has room if it is in the view or its first edge here found some
        own = Window.partitionBy("root", "node")
        tried = tried.withColumn("_place", F.min(F.when(F.col("_new"), F.col("_size") + F.col("_rank"))).over(own))
        kept = tried.where(F.col("_in") | (F.col("_place") <= max_nodes)).withColumn("_k", F.row_number().over(Window.partitionBy("root").orderBy("_at"))).where(F.col("_done") + F.col("_k") <= max_edges)
        kept = written(kept.select("root", (F.col("_done") + F.col("_k")).cast("long").alias("position"), "edge_id", "src", "node", "duties", F.lit(hop).alias("hops"), F.when(F.col("_new"), F.col("_place")).alias("_place")), "view-paths")
        if not kept.limit(1).count():
            break
        paths.append(kept.drop("_place"))
        nodes.append(kept.where("_place is not null").select("root", "node", F.col("_place").cast("long").alias("position")))
        # one state for each node and set of duties, in the order of the first edge to it
        new = written(kept.groupBy("root", "node", "duties").agg(F.min("position").alias("order")), "view-states")
        old = reduce(DataFrame.unionByName, states).withColumnRenamed("duties", "had")
        beaten = new.join(old, ["root", "node"]).where(F.size(F.array_except("duties", "had")) == 0)
        others = new.select("root", "node", F.col("duties").alias("had"))
        smaller = new.join(others, ["root", "node"]).where((F.size(F.array_except("duties", "had")) == 0) & (F.size("had") > F.size("duties")))
        names = ["root", "node", "duties"]
        front = written(new.join(beaten.select(names).unionByName(smaller.select(names)).distinct(), names, "left_anti").select("root", "node", "duties", "order"), "view-front")
        states.append(new.select(names))
    spark = seeds.sparkSession
    found = reduce(DataFrame.unionByName, paths) if paths else spark.createDataFrame([], PATHS)
    return found, reduce(DataFrame.unionByName, nodes)
