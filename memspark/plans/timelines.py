"""Queries on versions, timelines, time groups, trees and changes of state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.operators import lifecycle as life
from memspark.operators import recall
from memspark.operators import temporal as tm
from memspark.operators.govern import broken_links
from memspark.plans.registry import query
from memspark.plans.retrieval import TOKENS_SQL
from memspark.sources.tables import UNITS_SQL, table, units

AT = 1_704_672_000_000  # 2024-01-08

_P = "p AS (SELECT event_id AS unit_id, user_id AS entity, event_type AS property, value, CASE WHEN value >= 5 THEN epoch_ms(ts) END AS anchor, CASE WHEN value >= 5 THEN epoch_ms(ts) + (value * 60000)::bigint END AS anchor_end, epoch_ms(ts) AS knowledge FROM events)"


def properties(spark, sf_dir):
    """Events as property entries: small values have no date."""
    e = table(spark, sf_dir, "events")
    at, dated = F.unix_millis("ts"), F.col("value") >= 5
    return e.select(F.col("event_id").alias("unit_id"), F.col("user_id").alias("entity"), F.col("event_type").alias("property"), "value", F.when(dated, at).alias("anchor"), F.when(dated, at + F.round(F.col("value") * 60_000).cast("long")).alias("anchor_end"), at.alias("knowledge"))


BY = ["entity", "property"]


@query("W03_W06_timeline", f"WITH {_P} SELECT unit_id, row_number() OVER (PARTITION BY entity, property ORDER BY anchor IS NOT NULL DESC, anchor NULLS LAST, knowledge, unit_id)::int AS position FROM p")
def w03(spark, sf_dir):
    w = Window.partitionBy(*BY).orderBy(*tm.timeline_order())
    return properties(spark, sf_dir).select("unit_id", F.row_number().over(w).alias("position"))


@query("W04_latest", f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, property ORDER BY coalesce(anchor, knowledge) DESC, knowledge DESC, unit_id DESC) AS r FROM p) SELECT entity, property, unit_id, value FROM r WHERE r = 1")
def w04(spark, sf_dir):
    return tm.latest(properties(spark, sf_dir), BY).select(*BY, "unit_id", "value")


@query("W05_W08_snapshot", f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, property ORDER BY anchor IS NOT NULL DESC, anchor DESC NULLS LAST, knowledge DESC, unit_id DESC) AS r FROM p WHERE anchor IS NULL OR anchor <= {AT}) SELECT entity, property, unit_id, value FROM r WHERE r = 1")
def w05(spark, sf_dir):
    return tm.snapshot(properties(spark, sf_dir), BY, F.lit(AT)).select(*BY, "unit_id", "value")


@query("W07_values_in_range", f"WITH {_P} SELECT unit_id FROM p WHERE anchor IS NULL OR (anchor < {AT} AND anchor_end >= {AT - 86400000})")
def w07(spark, sf_dir):
    return tm.in_range(properties(spark, sf_dir), F.lit(AT - 86_400_000), F.lit(AT), True).select("unit_id")


@query("W09_timepoints", f"WITH {_P} SELECT unit_id FROM p WHERE (anchor <= {AT} AND {AT} < anchor_end) OR (anchor <= {AT + 90000000} AND {AT + 90000000} < anchor_end)")
def w09(spark, sf_dir):
    return properties(spark, sf_dir).where(tm.at_points([AT, AT + 90_000_000])).select("unit_id")


@query("W10_known_at", f"WITH {_P} SELECT unit_id FROM p WHERE property <> 'error' AND knowledge <= {AT} AND (anchor_end IS NULL OR anchor_end > {AT})")
def w10(spark, sf_dir):
    e = properties(spark, sf_dir).withColumn("lifecycle", F.when(F.col("property") == "error", "forgotten").otherwise("active")).withColumn("valid_from", F.col("knowledge")).withColumn("valid_to", F.col("anchor_end"))
    return e.where(tm.known_at(F.lit(AT))).select("unit_id")


@query("W11_full_timeline_fallback", f"WITH {_P}, s AS (SELECT *, count(*) FILTER (value > 60) OVER (PARTITION BY entity) AS n FROM p) SELECT unit_id FROM s WHERE n = 0 OR value > 60")
def w11(spark, sf_dir):
    p = properties(spark, sf_dir)
    some = p.where("value > 60").select("entity").distinct()
    return p.where("value > 60").select("unit_id").unionByName(p.join(some, "entity", "left_anti").select("unit_id"))


@query("W13_neighbours", f"WITH {_P}, s AS (SELECT *, max((value > 60)::int) OVER (PARTITION BY entity, property ORDER BY anchor IS NOT NULL DESC, anchor NULLS LAST, knowledge, unit_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM p) SELECT unit_id FROM s WHERE near = 1")
def w13(spark, sf_dir):
    return tm.neighbours(properties(spark, sf_dir), BY, F.col("value") > 60, 2).select("unit_id")


@query("W14_shrink", f"WITH {_P}, s AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC, unit_id) AS r FROM p) SELECT entity, unit_id FROM s WHERE r <= 5")
def w14(spark, sf_dir):
    return tm.shrink(properties(spark, sf_dir), "entity", 5, [F.desc("value"), F.asc("unit_id")]).select("entity", "unit_id")


@query("W15_budget_allocation", f"WITH {_P}, c AS (SELECT entity, count(*) AS n FROM p GROUP BY entity) SELECT entity, greatest(2, least(40, floor(1000 * n / sum(n) OVER ())))::bigint AS budget FROM c")
def w15(spark, sf_dir):
    return tm.budgets(properties(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n")), 1000, 2, 40).select("entity", "budget")


_SPAN = "WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS s, epoch_us(ts) / 1e6 AS t FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e), f AS (SELECT user_id, event_id, s, t, i, t AS start FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.s, o.t, o.i, CASE WHEN o.s <> f.s OR o.t - f.start > 86400 THEN o.t ELSE f.start END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)"


@query("W16_span_grouping", f"{_SPAN} SELECT user_id, event_id AS unit_id, round(start, 3) AS start FROM f")
def w16(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("unit_id"), (F.col("event_type") == "error").alias("session"), (F.unix_micros("ts") / 1e6).alias("at"))
    return tm.span_groups(e, "user_id", 86_400).select("user_id", "unit_id", F.round("start", 3).alias("start"))


@query("W18_event_grouping", "WITH w AS (SELECT event_id, user_id, event_type <> lag(event_type) OVER o OR lag(event_type) OVER o IS NULL OR abs(value - lag(value) OVER o) > 20 AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, sum(b::int) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::bigint AS grp FROM w")
def w18(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cut = (F.col("event_type") != F.lag("event_type").over(w)) | (F.abs(F.col("value") - F.lag("value").over(w)) > 20)
    return tm.gap_groups(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.lag("event_type").over(w).isNull(), True).otherwise(cut)).select("event_id", F.col("group").alias("grp"))


@query("W19_adjacent_cosine", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e, list_transform(lag(embedding) OVER (PARTITION BY label ORDER BY vec_id), lambda x: x::double) AS f FROM embeddings) SELECT vec_id, round(list_dot_product(e, f) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(f, f)), 6) AS score FROM v WHERE f IS NOT NULL")
def w19(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, sf_dir, "embeddings").withColumn("before", F.lag("embedding").over(w)).where("before IS NOT NULL")
    return v.select("vec_id", F.round(t.cosine(F.col("embedding"), F.col("before")), 6).alias("score"))


_GROUPS = "g AS (SELECT user_id, date_trunc('day', ts) AS day, min(epoch_us(ts) / 1e6) AS span_start, max(epoch_us(ts) / 1e6 + value * 60) AS span_end, count(*) AS n FROM events GROUP BY ALL)"


def day_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), (F.unix_micros("ts") / 1e6).alias("at"), (F.unix_micros("ts") / 1e6 + F.col("value") * 60).alias("end"), F.col("event_id").alias("unit_id"))
    return tm.parents(e, ["user_id", "day"])


@query("A24_parent_build", "SELECT user_id, epoch_us(date_trunc('day', ts)) // 1000000 AS day, round(min(epoch_us(ts) / 1e6), 3) AS span_start, round(max(epoch_us(ts) / 1e6 + value * 60), 3) AS span_end, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS children, count(*) AS n FROM events GROUP BY ALL")
def a24(spark, sf_dir):
    return day_groups(spark, sf_dir).select("user_id", F.unix_seconds("day").alias("day"), F.round("span_start", 3).alias("span_start"), F.round("span_end", 3).alias("span_end"), F.array_join("child_ids", ",").alias("children"), "n")


@query("W20_W21_settled_prefix", f"WITH {_GROUPS}, s AS (SELECT *, span_start < max(span_start) OVER (PARTITION BY user_id) OR 1706659200 - span_end > 86400 AS settled FROM g), q AS (SELECT *, min(CASE WHEN NOT settled THEN span_start END) OVER (PARTITION BY user_id ORDER BY span_start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS pending FROM s), b AS (SELECT *, max((NOT settled OR coalesce(span_end >= pending, false))::int) OVER (PARTITION BY user_id ORDER BY span_start ROWS UNBOUNDED PRECEDING) AS stop FROM q) SELECT user_id, round(span_start, 3) AS span_start FROM b WHERE stop = 0")
def w20(spark, sf_dir):
    s = tm.settled(day_groups(spark, sf_dir), ["user_id"], F.lit(1_706_659_200.0), 86_400)
    return tm.safe_prefix(s, ["user_id"]).select("user_id", F.round("span_start", 3).alias("span_start"))


@query("J23_as_of_join", "WITH v AS (SELECT o_custkey AS family, o_orderkey AS unit_id, epoch_ms(o_orderdate) AS t_valid, lead(epoch_ms(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t_invalid FROM orders), a AS (SELECT c_custkey AS family, 883612800000 AS tt FROM customer), j AS (SELECT family, tt, unit_id, row_number() OVER (PARTITION BY family, tt ORDER BY t_valid DESC, unit_id DESC) AS r FROM a JOIN v USING (family) WHERE t_valid <= tt AND (t_invalid IS NULL OR tt < t_invalid)) SELECT family, unit_id FROM j WHERE r = 1")
def j23(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    start = F.unix_millis("o_orderdate")
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("unit_id"), start.alias("t_valid"), F.lead(start).over(w).alias("t_invalid"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("family"), F.lit(883_612_800_000).alias("at"))
    return tm.as_of(v, asked, "family", "at").select("family", "unit_id")


@query("J20_roll_up", "SELECT 'r' || n_regionkey AS unit_id, max(c_acctbal) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j20(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    tree = c.select(tag("c", "c_custkey").alias("unit_id"), tag("n", "c_nationkey").alias("parent_id"), F.lit("leaf").alias("role")).unionByName(n.select(tag("n", "n_nationkey").alias("unit_id"), tag("r", "n_regionkey").alias("parent_id"), F.lit("scene").alias("role"))).unionByName(r.select(tag("r", "r_regionkey").alias("unit_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("event").alias("role")))
    return tm.rolled_up(c.select(tag("c", "c_custkey").alias("unit_id"), F.col("c_acctbal").alias("score")), tree, "event")


@query("J21_tree_expansion", "WITH x AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS unit_id, 0 AS depth, 0 AS pos FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 1, n_nationkey FROM nation UNION ALL SELECT 'r' || n_regionkey, 'c' || c_custkey, 2, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey), y AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, pos, unit_id) AS r FROM x) SELECT root, unit_id, depth::int AS depth FROM y WHERE r <= 40")
def j21(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    kids = n.select(tag("r", "n_regionkey").alias("unit_id"), tag("n", "n_nationkey").alias("child_id"), F.col("n_nationkey").cast("long").alias("pos")).unionByName(c.select(tag("n", "c_nationkey").alias("unit_id"), tag("c", "c_custkey").alias("child_id"), F.col("c_custkey").alias("pos")))
    return tm.expanded(r.select(tag("r", "r_regionkey").alias("unit_id")), kids, 2, 40).select("root", "unit_id", "depth")


_LINE = "l AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_quantity > 45 UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"


@query("J24_J25_J36_lineage_closure", f"WITH {_LINE}, s AS (SELECT DISTINCT 'c' || c_custkey AS node FROM customer WHERE c_acctbal > 9500), h1 AS (SELECT DISTINCT dst AS node FROM l JOIN s ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM l JOIN h1 ON src = node) SELECT node, 0 AS hop FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def j24(spark, sf_dir):
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    li, o, c = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))
    links = li.where("l_quantity > 45").select(tag("o", "l_orderkey").alias("src"), tag("p", "l_partkey").alias("dst")).unionByName(o.select(tag("c", "o_custkey").alias("src"), tag("o", "o_orderkey").alias("dst"))).distinct()
    return recall.reached(links, c.where("c_acctbal > 9500").select(tag("c", "c_custkey").alias("node")), 2)


@query("J32_audit_chain", "WITH e AS (SELECT event_id AS seq, md5(event_type || event_id) AS digest, CASE WHEN value > 95 THEN 'x' ELSE lag(md5(event_type || event_id)) OVER (ORDER BY event_id) END AS prev FROM events) SELECT a.seq FROM e a LEFT JOIN e b ON b.seq = a.seq - 1 WHERE NOT coalesce(a.prev = b.digest, a.prev IS NULL AND b.digest IS NULL)")
def j32(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value", F.md5(F.concat("event_type", F.col("event_id").cast("string"))).alias("digest"))
    before = e.select((F.col("seq") + 1).alias("seq"), F.col("digest").alias("b"))
    rows = e.join(before, "seq", "left").select("seq", "digest", F.when(F.col("value") > 95, "x").otherwise(F.col("b")).alias("previous_digest"))
    return broken_links(rows).select("seq")


@query("T08_lifecycle_sweep", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'forgotten' WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'archived' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'pending' END AS lifecycle FROM orders")
def t08(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    u = o.select("o_orderkey", F.col("o_orderdate").alias("t_invalid"), F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "O", "active").otherwise("pending").alias("lifecycle"))
    return life.sweep(u, F.lit("1996-01-01").cast("timestamp"), expired="archived").select("o_orderkey", "lifecycle")


_MAY = "CASE lifecycle WHEN 'active' THEN true WHEN 'archived' THEN target IN ('archived', 'forgotten') WHEN 'superseded' THEN target IN ('superseded', 'forgotten') ELSE target = lifecycle END"


@query("T09_transition_table", f"WITH {UNITS_SQL}, s AS (SELECT unit_id, CASE WHEN n_chars % 7 = 0 THEN 'forgotten' ELSE lifecycle END AS lifecycle FROM units), x AS (SELECT * FROM s, (VALUES ('active'), ('archived'), ('superseded'), ('forgotten')) v(target)) SELECT unit_id, target, {_MAY} AS allowed FROM x")
def t09(spark, sf_dir):
    u = units(spark, sf_dir).select("unit_id", F.when(F.col("n_chars") % 7 == 0, "forgotten").otherwise(F.col("lifecycle")).alias("lifecycle"))
    each = u.select("unit_id", "lifecycle", F.explode(F.array(*map(F.lit, ("active", "archived", "superseded", "forgotten")))).alias("target"))
    return each.select("unit_id", "target", life.may_become(F.col("lifecycle"), F.col("target")).alias("allowed"))


@query("T10_supersede_scd2", "WITH n AS (SELECT o_custkey AS k, min(epoch_ms(o_orderdate)) AS tt FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' AND tt IS NOT NULL THEN 'superseded' ELSE 'active' END AS lifecycle, CASE WHEN o_orderstatus <> 'O' THEN tt END AS t_invalid FROM orders LEFT JOIN n ON k = o_custkey")
def t10(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), "o_orderstatus", F.unix_millis("o_orderdate").alias("t_valid"), F.lit(None).cast("long").alias("t_invalid"), F.lit("active").alias("lifecycle"))
    return life.supersede(o.where("o_orderstatus <> 'O'"), o.where("o_orderstatus = 'O'"), "k").select("o_orderkey", "lifecycle", "t_invalid")


@query("T11_dedup_decision", "SELECT event_id, CASE WHEN value >= 90 THEN 'NOOP' WHEN value >= 60 THEN 'UPDATE' WHEN value >= 30 THEN 'SUPERSEDE' ELSE 'ADD' END AS decision FROM events")
def t11(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", life.dedup_decision(F.col("value"), 90, 60, 30).alias("decision"))


@query("T12_bitemporal_verdict", "WITH e AS (SELECT event_id, ts, CASE WHEN value > 30 THEN ts END AS te, lag(CASE WHEN value > 30 THEN ts END) OVER w AS pe, lag(ts) OVER w AS pi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), k AS (SELECT event_id, CASE WHEN te IS NOT NULL AND pe IS NOT NULL THEN te ELSE ts END AS a, CASE WHEN te IS NOT NULL AND pe IS NOT NULL THEN pe ELSE pi END AS b FROM e) SELECT event_id, CASE WHEN a > b THEN 'newer' WHEN a < b THEN 'older' ELSE 'preserve' END AS verdict FROM k")
def t12(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("te", F.when(F.col("value") > 30, F.col("ts")))
    e = e.withColumn("pe", F.lag("te").over(w)).withColumn("pi", F.lag("ts").over(w))
    return e.select("event_id", life.verdict(F.col("te"), F.col("pe"), F.col("ts"), F.col("pi")).alias("verdict"))


@query("T20_message_buffer", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, turn, r <= 4 AS keep FROM r")
def t20(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("t_ingest"), F.col("turn").alias("id"))
    return life.recent(c, ["conv_id"], 4).select("conv_id", "turn", "keep")


@query("T22_forget", f"WITH {UNITS_SQL} SELECT unit_id, CASE WHEN lifecycle = 'superseded' AND unit_id NOT IN (SELECT 'd' || vec_id FROM embeddings) THEN 'forgotten' ELSE lifecycle END AS lifecycle FROM units")
def t22(spark, sf_dir):
    held = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("unit_id"))
    return life.forget(units(spark, sf_dir), held, "unit_id").select("unit_id", "lifecycle")


@query("G06_downweight", f"WITH {UNITS_SQL} SELECT unit_id, coalesce(importance, 1.0) * 0.5 AS importance FROM units")
def g06(spark, sf_dir):
    return units(spark, sf_dir).select("unit_id", life.downweight(F.col("importance")).alias("importance"))


@query("J19_file_diff", f"WITH {UNITS_SQL}, h AS (SELECT sha256(content) AS digest, lifecycle FROM units), n AS (SELECT sha256(coalesce(text, '')) AS digest FROM documents WHERE source <> 'src1') SELECT 'delete' AS change, digest FROM (SELECT DISTINCT digest FROM h WHERE lifecycle = 'active') WHERE digest NOT IN (SELECT digest FROM n) UNION ALL SELECT 'insert', digest FROM (SELECT DISTINCT digest FROM n) WHERE digest NOT IN (SELECT digest FROM h WHERE lifecycle <> 'superseded')")
def j19(spark, sf_dir):
    u = units(spark, sf_dir).select(t.content_hash(F.col("content")).alias("digest"), "lifecycle")
    new = table(spark, sf_dir, "documents").where("source <> 'src1'").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return life.file_diff(new, u.where("lifecycle = 'active'"), u.where("lifecycle <> 'superseded'"))


@query("A28_exact_dedup", f"WITH {UNITS_SQL}, r AS (SELECT unit_id, row_number() OVER (PARTITION BY user_id, sha256(content) ORDER BY t_ingest DESC, unit_id DESC) AS r FROM units) SELECT unit_id FROM r WHERE r = 1")
def a28(spark, sf_dir):
    return life.newest_of_equal(units(spark, sf_dir), ["user_id"], "content", [F.desc("t_ingest"), F.desc("unit_id")]).select("unit_id")


@query("J12_coreference", "WITH m AS (SELECT o_custkey AS unit_id, o_orderpriority || o_orderstatus || year(o_orderdate) AS entity, avg(o_totalprice) AS conf FROM orders WHERE o_totalprice > 400000 GROUP BY ALL) SELECT a.unit_id AS a, b.unit_id AS b, round(avg((a.conf + b.conf) / 2), 7) AS score FROM m a JOIN m b USING (entity) WHERE a.unit_id < b.unit_id GROUP BY 1, 2")
def j12(spark, sf_dir):
    from memspark.operators.link import coreferences

    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    m = o.select(F.col("o_custkey").alias("unit_id"), F.concat("o_orderpriority", "o_orderstatus", F.year("o_orderdate").cast("string")).alias("entity"), F.col("o_totalprice").alias("confidence"))
    return coreferences(m).select("a", "b", t.rounded(F.col("score"), 7).alias("score"))


@query("J13_similarity_pairs", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.2")
def j13(spark, sf_dir):
    from memspark.operators.link import similar_pairs

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), "label", F.col("embedding").alias("vector"))
    return similar_pairs(v, 0.2, ["label"]).select("a", "b")


@query("J15_dedup_recall", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), c AS (SELECT a.vec_id AS query_id, b.vec_id AS unit_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 9) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM c) SELECT query_id, unit_id, round(score, 6) AS score FROM k WHERE r <= 3 AND score >= 0.1")
def j15(spark, sf_dir):
    from memspark.operators.link import duplicates_of

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), "label", F.col("embedding").alias("vector"))
    return duplicates_of(v.withColumnRenamed("unit_id", "query_id"), v, ["label"], 3, 0.1).select("query_id", "unit_id", F.round("score", 6).alias("score"))


@query("J16_J17_entity_upsert", f"WITH {TOKENS_SQL}, m AS (SELECT DISTINCT sha256(e) AS h, unit_id FROM (SELECT unit_id, unnest(toks) AS e FROM tk) WHERE length(e) >= 9), live AS (SELECT m.* FROM m JOIN units USING (unit_id) WHERE lifecycle = 'active') SELECT h AS entity_hash, count(*) AS links FROM live GROUP BY h")
def j16(spark, sf_dir):
    from memspark.operators.link import linked, unlinked

    u = units(spark, sf_dir)
    m = u.select("unit_id", F.explode(F.filter(t.tokens(F.col("content")), lambda x: F.length(x) >= 9)).alias("e")).select(t.entity_hash(F.col("e")).alias("entity_hash"), "unit_id").distinct()
    empty = m.limit(0)
    return unlinked(linked(empty, m), u.where("lifecycle <> 'active'")).groupBy("entity_hash").agg(F.count("*").alias("links"))


@query("J26_source_fallback", "WITH h AS (SELECT DISTINCT o_custkey AS unit_id FROM orders WHERE o_orderstatus = 'P'), d AS (SELECT DISTINCT o_custkey AS unit_id FROM orders WHERE o_orderstatus = 'O') SELECT unit_id FROM h WHERE unit_id NOT IN (SELECT unit_id FROM d)")
def j26(spark, sf_dir):
    from memspark.operators.link import source_fallback

    o = table(spark, sf_dir, "orders")
    hits = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("unit_id")).distinct()
    direct = o.where("o_orderstatus = 'O'").select(F.array("o_custkey").alias("provenance"), F.lit(True).alias("complete"))
    return source_fallback(hits, direct, "missing").select("unit_id")


@query("J28_entity_resolution", "SELECT a.p_partkey AS a, min(b.p_partkey) AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey > b.p_partkey WHERE levenshtein(lower(a.p_name), lower(b.p_name)) <= 2 GROUP BY 1")
def j28(spark, sf_dir):
    from memspark.operators.link import fuzzy_names

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.col("p_name").alias("name"))
    return fuzzy_names(p, ["p_brand", "p_size"], 2)


@query("J29_merge_candidates", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), n AS (SELECT * FROM v WHERE vec_id % 50 = 0), c AS (SELECT o.label, o.vec_id AS unit_id, max(list_dot_product(o.e, n.e) / sqrt(list_dot_product(o.e, o.e)) / sqrt(list_dot_product(n.e, n.e))) AS s FROM v o JOIN n ON o.label = n.label AND o.vec_id <> n.vec_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, unit_id) AS r FROM c) SELECT label, unit_id, round(s, 6) AS score FROM r WHERE r <= 5")
def j29(spark, sf_dir):
    from memspark.operators.link import merge_candidates

    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), "label", F.col("embedding").alias("vector"))
    new = v.where("unit_id % 50 = 0").withColumnRenamed("unit_id", "query_id")  # the new entries
    return merge_candidates(v, new, ["label"], 5).select("label", "unit_id", F.round("score", 6).alias("score"))
