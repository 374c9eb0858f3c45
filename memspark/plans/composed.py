"""Queries on composed retrieval, ingest, evolution and stores."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.engine import Engine
from memspark.functions import text as t
from memspark.operators import evolve, fuse, govern, ingest, plugins, recall, relations, retrieve
from memspark.plans.jobs import engine
from memspark.plans.registry import query
from memspark.plans.retrieval import _COS, _QV, _VEC, CHANNELS_SQL, KEYWORD_SQL, RANKED_SQL, TOKENS_SQL, WORDS, _best, channels, edges
from memspark.sources import connectors
from memspark.sources.scratch import folder, written
from memspark.sources.tables import EPOCH, STEP, UNITS_SQL, table, units

_AT = "TIMESTAMP '2024-03-15 10:00:00'"


def _at():
    return F.lit("2024-03-15 10:00:00").cast("timestamp")


@query("S02_stamped_units", f"""WITH p AS (SELECT conv_id || '/' || turn AS id, text || CASE turn % 3 WHEN 0 THEN ' on 2023-11-05 and 2024-01-01' WHEN 1 THEN ' 2023年2月7' ELSE '' END AS content, CASE WHEN turn % 5 = 0 THEN TIMESTAMP '2020-01-01 00:00:00' END AS given, turn FROM conversations),
s AS (SELECT *, unnest(range(0, greatest(length(content), 1), 50)) AS start FROM p)
SELECT id AS source_ref, CASE WHEN length(content) > 50 THEN start // 50 + 1 END::int AS part, CASE WHEN length(content) > 50 THEN (length(content) + 49) // 50 END::int AS parts, md5(substr(content, start + 1, 50)) AS digest,
  epoch_ms(coalesce(given, CASE turn % 3 WHEN 0 THEN TIMESTAMP '2023-11-05 00:00:00' WHEN 1 THEN TIMESTAMP '2023-02-07 00:00:00' END)) AS t_event, epoch_ms({_AT}) AS t_ingest, epoch_ms({_AT}) AS t_valid, turn AS t_message, 'original' AS origin FROM s""")
def s02(spark, sf_dir):
    tail = F.when(F.col("turn") % 3 == 0, " on 2023-11-05 and 2024-01-01").when(F.col("turn") % 3 == 1, " 2023年2月7").otherwise("")
    c = table(spark, sf_dir, "conversations")
    p = c.select(F.concat_ws("/", "conv_id", "turn").alias("payload_id"), F.concat("text", tail).alias("content"), F.col("turn").alias("occurred_at"), F.when(F.col("turn") % 5 == 0, F.lit("2020-01-01 00:00:00").cast("timestamp")).alias("event_time"))
    u = ingest.stamped(p, _at(), 50)
    return u.select("source_ref", "part", "parts", F.md5("content").alias("digest"), *(F.unix_millis(c).alias(c) for c in ("t_event", "t_ingest", "t_valid")), "t_message", "origin")


@query("S03_hierarchy_hints", """WITH e AS (SELECT event_id, event_id % 8 AS k, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS t0 FROM events)
SELECT event_id, CASE WHEN k IN (0, 1, 5) THEN 'time' WHEN k = 2 THEN 'topic' END AS kind, CASE WHEN k IN (0, 1, 5) THEN 'snapshot' WHEN k = 2 THEN 'node' END AS role, CASE WHEN k IN (0, 1) THEN t0 WHEN k = 5 THEN '2024-01-02 00:00:00' END AS span_start,
  CASE k WHEN 3 THEN 'unknown hints hierarchy_parent_id' WHEN 4 THEN 'not a leaf role' WHEN 6 THEN 'the span ends before it starts' WHEN 7 THEN 'kind and role go together' END AS error FROM e""")
def s03(spark, sf_dir):
    k = F.col("event_id") % 8
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    leaf = ("hierarchy_kind", "time", "hierarchy_role", "snapshot")
    meta = (
        F.when(k == 0, m("lang", "en"))
        .when(k == 1, m(*leaf))
        .when(k == 2, m("hierarchy_kind", "topic", "hierarchy_role", "node"))
        .when(k == 3, m("hierarchy_parent_id", "p"))
        .when(k == 4, m("hierarchy_kind", "time", "hierarchy_role", "event"))
        .when(k == 5, m(*leaf, "hierarchy_span_start", "2024-01-02T00:00:00"))
        .when(k == 6, m(*leaf, "hierarchy_span_start", "2024-01-02T00:00:00", "hierarchy_span_end", "2024-01-01T00:00:00"))
        .otherwise(m("hierarchy_kind", "time"))
    )
    h = table(spark, sf_dir, "events").select("event_id", ingest.hierarchy_ref(meta, F.col("ts")).alias("h"))
    return h.select("event_id", "h.kind", "h.role", F.date_format("h.span_start", "yyyy-MM-dd HH:mm:ss").alias("span_start"), "h.error")


@query("S04_normalised", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS text, CASE WHEN event_id % 3 = 1 THEN 'unsupported modality video' WHEN event_id % 3 = 2 THEN 'unsupported modality null' END AS error FROM events")
def s04(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "json").when(F.col("event_id") % 3 == 1, "video")
    n = table(spark, sf_dir, "events").select("event_id", ingest.normalised(kind, F.col("props")).alias("n"))
    return n.select("event_id", "n.text", "n.error")


@query("S15_shard_routed", "WITH o AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'hot' WHEN o_orderstatus = 'P' THEN 'cold' ELSE 'main' END AS shard FROM orders) SELECT o_orderkey, shard FROM o WHERE shard IN ('hot', 'cold')")
def s15(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rule = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "hot").when(F.col("o_orderstatus") == "P", "cold").otherwise("main")
    return ingest.read_shards(spark, ingest.write_sharded(o, rule, "shards"), ["hot", "cold"]).select("o_orderkey", "shard")


@query("S13_S35_moved_store", "SELECT count(*) AS old_rows, count(*) AS new_rows, true AS whole FROM orders")
def s35(spark, sf_dir):
    return ingest.moved(table(spark, sf_dir, "orders"), "store", ["o_orderkey", "o_totalprice"])[1]


@query("S32_space_export", f"WITH {UNITS_SQL} SELECT unit_id, md5(content) AS digest, n_chars FROM units WHERE space = 'src1' AND user_id = 'en'")
def s32(spark, sf_dir):
    path = folder(spark, "export")
    connectors.export_space(units(spark, sf_dir).withColumn("org", F.col("user_id")), "en", "src1", path)
    back = spark.read.schema("unit_id string, content string, n_chars long").json(path)
    return back.select("unit_id", F.md5("content").alias("digest"), "n_chars")


@query("S23_file_objects", "SELECT count(DISTINCT r_regionkey) AS files, sum(length(r_name) + 1)::bigint AS bytes FROM region")
def s23(spark, sf_dir):
    path = folder(spark, "objects")
    r = table(spark, sf_dir, "region")
    r.select(F.col("r_name").alias("value"), "r_regionkey").repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    f = connectors.files(spark, path).where(F.col("path").rlike(r"part-[^/]*\.txt$"))
    return f.agg(F.countDistinct(F.regexp_extract("path", "r_regionkey=([0-9]+)", 1)).alias("files"), F.sum("length").alias("bytes"))


@query("S22_fusion_store", f"WITH {KEYWORD_SQL}, {_VEC}, b AS (SELECT {_QV}::double[] AS e), s AS (SELECT u.unit_id, 0.6 * {_COS} + 0.4 * coalesce(kw.score, 0) AS score FROM units u JOIN v a ON 'd' || a.vec_id = u.unit_id JOIN kw ON kw.unit_id = u.unit_id, b WHERE u.lifecycle = 'active') SELECT unit_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(score, 12) DESC, unit_id LIMIT 20")
def s22(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    rows = units(spark, sf_dir).where("lifecycle = 'active'").join(v, "unit_id")
    return _best(recall.fusion_mix(rows, F.col("vector"), _QV, WORDS, 0.6), 20).select("unit_id", F.round("score", 6).alias("score"))


@query("J05_filtered_knn", f"WITH {_VEC}, q AS (SELECT * FROM v WHERE vec_id % 50 = 0), c AS (SELECT b.vec_id AS query_id, a.vec_id AS unit_id, round({_COS}, 12) AS score FROM v a, q b WHERE a.label < 3), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id::varchar) - 1 AS rank FROM c WHERE score > 0) SELECT query_id::varchar AS query_id, unit_id::varchar AS unit_id, rank::int AS rank FROM k WHERE rank < 5")
def j05(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    rows = v.where("label < 3").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))  # the query set
    return recall.knn(rows, asked, 5).select("query_id", "unit_id", "rank")


@query("J07_graph_recall", """WITH e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
s AS (SELECT 'n' || n_nationkey AS node FROM nation WHERE contains(n_name, '_1') OR contains(n_name, '_03')), h1 AS (SELECT DISTINCT node AS seed, b AS node FROM s JOIN u ON a = node), h2 AS (SELECT DISTINCT seed, b AS node FROM h1 JOIN u ON a = node)
SELECT DISTINCT node AS unit_id, 1.0::double AS score FROM (SELECT * FROM h1 UNION SELECT * FROM h2) WHERE seed <> node ORDER BY node LIMIT 50""")
def j07(spark, sf_dir):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c, s, n, r = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation", "region"))
    nodes = c.select(tag("c", "c_custkey").alias("unit_id"), F.lit("").alias("content")).unionByName(s.select(tag("s", "s_suppkey").alias("unit_id"), F.lit("").alias("content"))).unionByName(n.select(tag("n", "n_nationkey").alias("unit_id"), F.col("n_name").alias("content"))).unionByName(r.select(tag("r", "r_regionkey").alias("unit_id"), F.lit("").alias("content")))
    return retrieve.graph_recall(nodes, edges(spark, sf_dir), ["_1", "_03"], 2, 50)


@query("P01_query_parse", "WITH c AS (SELECT conv_id, turn, text || CASE turn % 2 WHEN 0 THEN ' yesterday' ELSE '' END AS q FROM conversations), k AS (SELECT conv_id, turn, turn % 2 AS odd, regexp_extract_all(lower(q), '[0-9a-z]+|[\\x{4e00}-\\x{9fff}]') AS toks FROM c) SELECT conv_id, turn, len(toks)::int AS tokens, len(list_distinct(toks))::int AS keywords, CASE WHEN odd = 0 THEN epoch_ms(TIMESTAMP '2024-03-14 00:00:00') END AS time_from, CASE WHEN len(list_filter(toks, lambda x: length(x) >= 3 AND regexp_full_match(x, '[0-9a-z]+'))) > 0 THEN 'keyword,graph,entity' ELSE 'keyword,graph' END AS channels FROM k")
def p01(spark, sf_dir):
    tail = F.when(F.col("turn") % 2 == 0, " yesterday").otherwise("")
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("q"))
    p = retrieve.parsed(q, "q", _at(), embed=False)
    return p.select("conv_id", "turn", F.size("tokens").alias("tokens"), F.size("keywords").alias("keywords"), F.unix_millis("window.start").alias("time_from"), F.array_join("channels", ",").alias("channels"))


def _pipeline(spark, sf_dir, **options):
    u = units(spark, sf_dir)
    hits = written(channels(spark, sf_dir), "channels")

    def vector():
        raise RuntimeError("no index")

    own = lambda c: lambda: hits.where(F.col("channel") == c)
    return retrieve.Pipeline({"keyword": own("keyword"), "vector": vector, "bm25": own("bm25")}, u, (F.col("lifecycle") == "active") & (F.col("tier") != "working"), **options)


@query("P03_channel_errors", "SELECT * FROM (VALUES ('keyword', ''), ('bm25', ''), ('vector', 'RuntimeError: no index')) v(channel, error)")
def p03(spark, sf_dir):
    p = _pipeline(spark, sf_dir)
    hits, errors = retrieve.recalled(p.channels)
    good = hits.select("channel", F.lit("").alias("error")).distinct()
    bad = spark.createDataFrame([(c, f"{kind}: {message}") for c, kind, message in errors], "channel string, error string")
    return good.unionByName(bad)


@query("P03_isolated_channels", f"WITH {CHANNELS_SQL} SELECT unit_id, channel, round(score, 6) AS score FROM hits")
def p03_isolated(spark, sf_dir):
    """Two sound channels, one whose plan cannot be made and one that fails in its tasks."""
    u = units(spark, sf_dir)
    sound = written(channels(spark, sf_dir), "channels")
    own = lambda name: lambda: sound.where(F.col("channel") == name).drop("channel")
    broken = lambda: u.select("unit_id", F.when(F.col("n_chars") >= 0, F.raise_error(F.lit("the store is away"))).cast("double").alias("score"))
    hits, errors = retrieve.recalled({"graph": broken, "keyword": own("keyword"), "entity": lambda: u.select("no_such_column"), "bm25": own("bm25")})
    if [e[0] for e in errors] != ["graph", "entity"]:
        raise AssertionError(errors)
    return hits.select("unit_id", "channel", F.round("score", 6).alias("score"))


_GOOD = "lifecycle = 'active' AND tier <> 'working'"
_KEPT = f"{RANKED_SQL}, kept AS (SELECT channel, hits.unit_id, score, row_number() OVER (PARTITION BY channel ORDER BY round(score, 12) DESC, hits.unit_id) - 1 AS rank FROM hits JOIN units u ON u.unit_id = hits.unit_id WHERE {_GOOD}), f1 AS (SELECT unit_id, sum(1.0 / (61 + rank)) AS score FROM kept GROUP BY unit_id), f2 AS (SELECT r.unit_id, sum(1.0 / (61 + rank)) AS score FROM r JOIN units u ON u.unit_id = r.unit_id WHERE {_GOOD} GROUP BY r.unit_id)"


@query("P04_orders_of_retrieval", f"WITH {_KEPT}, x AS (SELECT 'recall_get_rank' AS pipeline, * FROM f1 UNION ALL SELECT 'recall_and_get_rank', * FROM f1 UNION ALL SELECT 'retrieve', * FROM f2), p AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY round(score, 12) DESC, unit_id) - 1 AS position FROM x) SELECT pipeline, unit_id, round(score, 9) AS score, position FROM p WHERE position < 10")
def p04(spark, sf_dir):
    base, out = _pipeline(spark, sf_dir), None
    for order in retrieve.ORDERS:
        rows = replace(base, order=order, steps=[]).run()[0].select(F.lit(order).alias("pipeline"), "unit_id", F.round("score", 9).alias("score"), "position")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("P09_P10_rollup_threshold", f"WITH {_KEPT}, a AS (SELECT 's:' || space AS unit_id, max(score) AS score FROM f1 JOIN units USING (unit_id) GROUP BY space), g AS (SELECT *, max(score) OVER () AS top FROM a), o AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, unit_id) AS r FROM g) SELECT unit_id, round(score, 9) AS score, r - 1 AS position FROM o WHERE (score >= top * 0.8 OR r <= 3) AND r <= 10")
def p09(spark, sf_dir):
    u = units(spark, sf_dir)
    leaves = u.select("unit_id", F.concat(F.lit("s:"), "space").alias("parent_id"), F.lit("leaf").alias("role"))
    tops = u.select(F.concat(F.lit("s:"), "space").alias("unit_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("space").alias("role")).distinct()
    p = _pipeline(spark, sf_dir, ratio=0.8, min_results=3, tree=leaves.unionByName(tops), target_role="space")
    return p.run()[0].select("unit_id", F.round("score", 9).alias("score"), "position")


@query("P11_P17_trajectory", f"WITH {_KEPT}, g AS (SELECT *, max(score) OVER () AS top FROM f1), c AS (SELECT count(*) AS n FROM g WHERE score >= top * 0.5) SELECT 'recall' AS stage, channel, count(*) AS candidate_count, 0 AS at FROM hits GROUP BY channel UNION ALL SELECT 'fuse', NULL, count(*), 1 FROM f1 UNION ALL SELECT 'threshold', NULL, n, 2 FROM c UNION ALL SELECT 'cut', NULL, least(n, 10), 3 FROM c")
def p17(spark, sf_dir):
    p = _pipeline(spark, sf_dir, ratio=0.5)
    p.run()
    return p.trajectory()


@query("P02_P18_named_pipeline", f"WITH {UNITS_SQL}, tk AS (SELECT unit_id, t_ingest, regexp_extract_all(lower(content), '[0-9a-z]+|[\\x{{4e00}}-\\x{{9fff}}]') AS toks FROM units WHERE space = 'src2' AND user_id = 'en' AND lifecycle = 'active'), s AS (SELECT unit_id, len(list_filter(toks, lambda x: list_contains(['license', 'the'], x))) / len(toks) AS score FROM tk WHERE len(toks) > 0) SELECT unit_id, round(score / max(score) OVER (), 6) AS score FROM s WHERE score > 0 ORDER BY round(score, 12) DESC, unit_id LIMIT 10")
def p18(spark, sf_dir):
    found = engine(spark, sf_dir).named("keyword", "the license", {"space": "src2", "user_id": "en"}, top_k=10)
    return found.select("unit_id", F.round("score", 6).alias("score"))


@query("P12_schema_temporal_chain", """WITH e AS (SELECT o_custkey, o_orderpriority AS p, o_orderkey AS k, epoch_ms(o_orderdate) AS a, CASE WHEN o_totalprice > 300000 THEN o_totalprice END AS score FROM orders),
n AS (SELECT *, max((score IS NOT NULL)::int) OVER (PARTITION BY o_custkey, p ORDER BY a, k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM e),
w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC NULLS LAST, a, k) AS r FROM n WHERE near = 1 AND a >= 788918400000 AND a < 852076800000) SELECT o_custkey, k AS unit_id, p AS property, score IS NOT NULL AS hit FROM w WHERE r <= 3""")
def p12(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    entries = o.select("o_custkey", F.col("o_orderpriority").alias("property"), F.col("o_orderkey").alias("unit_id"), F.unix_millis("o_orderdate").alias("anchor"), F.lit(None).cast("long").alias("anchor_end"), F.col("o_orderkey").alias("knowledge"))
    hits = o.where("o_totalprice > 300000").select(F.col("o_orderkey").alias("unit_id"), F.col("o_totalprice").alias("score"))
    found = retrieve.property_recall(entries, hits, "o_custkey", 3, 1, F.lit(788_918_400_000), F.lit(852_076_800_000))
    return found.select("o_custkey", "unit_id", "property", F.col("score").isNotNull().alias("hit"))


@query("P14_temporal_resolution", """WITH e AS (SELECT event_id, event_id % 5 AS k FROM events) SELECT event_id, CASE k WHEN 0 THEN 'latest' WHEN 4 THEN 'none' ELSE 'range' END AS mode, CASE k WHEN 1 THEN epoch_ms(TIMESTAMP '2024-01-01') WHEN 2 THEN epoch_ms(TIMESTAMP '2024-02-01') WHEN 3 THEN epoch_ms(TIMESTAMP '2024-03-14') END AS since, CASE k WHEN 1 THEN 'year' WHEN 2 THEN 'month' WHEN 3 THEN 'day' ELSE 'unknown' END AS precision, CASE k WHEN 0 THEN 'explicit' WHEN 1 THEN 'explicit' WHEN 2 THEN 'rule' WHEN 3 THEN 'text' ELSE 'none' END AS source FROM e""")
def p14(spark, sf_dir):
    k, ts = F.col("event_id") % 5, lambda x: F.lit(x).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    explicit = F.when(k == 0, F.struct(F.lit("latest").alias("mode"), none.alias("from"), none.alias("to"))).when(k == 1, F.struct(F.lit("range").alias("mode"), ts("2024-01-01").alias("from"), ts("2025-01-01").alias("to")))
    a, b = F.when(k <= 2, ts("2024-02-01")), F.when(k <= 2, ts("2024-03-01"))
    window = t.time_window(F.when(k <= 3, "what was it yesterday").otherwise("what is it"), _at())
    e = table(spark, sf_dir, "events").select("event_id", retrieve.temporal_plan(explicit, a, b, window).alias("p"))
    return e.select("event_id", "p.mode", F.unix_millis("p.from").alias("since"), "p.precision", "p.source")


@query("P15_multimodal_branches", f"WITH {KEYWORD_SQL}, b AS (SELECT kw.unit_id, score, CASE WHEN tier = 'working' THEN 'event' WHEN tier = 'episodic' THEN 'clip' ELSE 'native' END AS branch FROM kw JOIN units u ON u.unit_id = kw.unit_id WHERE score > 0), r AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY round(score, 12) DESC, unit_id) AS rank FROM b) SELECT unit_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM r WHERE rank <= CASE branch WHEN 'native' THEN 20 ELSE 5 END GROUP BY unit_id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, unit_id LIMIT 15")
def p15(spark, sf_dir):
    u = units(spark, sf_dir)
    counts = written(recall.term_counts(u, WORDS).join(u.select("unit_id", "tier"), "unit_id"), "term-counts")
    branch = lambda keep, k: _best(recall.keyword_of(counts.where(keep), WORDS), k)
    found = retrieve.branches({"native": branch("tier NOT IN ('working', 'episodic')", 20), "clip": branch("tier = 'episodic'", 5), "event": branch("tier = 'working'", 5)}, 15)
    return found.select("unit_id", F.round("score", 9).alias("score"))


@query("V11_conflict_plan", """WITH m AS (SELECT o_custkey::varchar AS entity, o_orderpriority AS property, o_orderkey::varchar AS unit_id, o_orderstatus AS content, epoch_ms(o_orderdate) AS t0 FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, property, content ORDER BY t0 DESC, unit_id DESC) AS dup, count(*) OVER (PARTITION BY entity, property) AS size FROM m), k AS (SELECT *, count(*) OVER (PARTITION BY entity, property) AS n, row_number() OVER (PARTITION BY entity, property ORDER BY t0 DESC, unit_id DESC) AS age FROM r WHERE dup = 1 AND size > 1),
o AS (SELECT * FROM k WHERE n > 1)
SELECT entity, property, 'retire' AS op, unit_id, NULL AS content FROM r WHERE dup > 1 UNION ALL SELECT entity, property, 'retire', unit_id, NULL FROM o WHERE age > 1 UNION ALL SELECT entity, property, 'retire', unit_id, NULL FROM o WHERE age = 1 UNION ALL SELECT entity, property, 'replacement', unit_id, 'now ' || content FROM o WHERE age = 1""")
def v11(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    by = ["entity", "property"]
    m = o.select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderpriority").alias("property"), F.col("o_orderkey").cast("string").alias("unit_id"), F.col("o_orderstatus").alias("content"), F.unix_millis("o_orderdate").alias("t_ingest"), F.lit(False).alias("done"))
    members = evolve.open_clusters(m, by)[0]
    # the deterministic model: the newest member is rewritten, older ones are archived; a second action on the newest is void
    top = members.groupBy(*by).agg(F.max(F.struct("t_ingest", "unit_id")).alias("top"))
    j = members.join(top, by).withColumn("new", F.col("top.unit_id") == F.col("unit_id"))
    act = j.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("new"), "unit_id")) - 1).alias("seq"), F.when(F.col("new"), "update").otherwise("ARCHIVE").alias("type"), "unit_id", F.when(F.col("new"), F.concat(F.lit("now "), "content")).alias("content"), F.array().cast("array<string>").alias("unit_ids"))
    again = act.where("seq = 0").select(*by, F.lit(1_000_000).alias("seq"), F.lit("archive").alias("type"), "unit_id", "content", "unit_ids")
    return evolve.consolidated(m, act.unionByName(again), by).select(*by, "op", "unit_id", "content")


_PARTS = """SELECT p_brand AS entity, p_type AS property, p_partkey::varchar AS unit_id, p_partkey::bigint AS t0, p_name || CASE p_size % 4 WHEN 0 THEN ' not in stock' WHEN 1 THEN ' in stock' WHEN 2 THEN ' in stock' ELSE '' END AS content FROM part"""


@query("V11_detected_plan", f"""WITH m AS ({_PARTS}), d AS (SELECT *, row_number() OVER (PARTITION BY entity, property, content ORDER BY t0 DESC, unit_id DESC) AS dup, count(*) OVER (PARTITION BY entity, property) AS size FROM m),
o AS (SELECT *, count(*) OVER (PARTITION BY entity, property) AS n FROM d WHERE dup = 1 AND size > 1), k AS (SELECT *, lag(content) OVER w AS pc, lag(t0) OVER w AS pt FROM o WHERE n > 1 WINDOW w AS (PARTITION BY entity, property ORDER BY t0, unit_id)),
x AS (SELECT *, list_distinct(regexp_extract_all(lower(pc), '[0-9a-z]+')) AS a, list_distinct(regexp_extract_all(lower(content), '[0-9a-z]+')) AS b FROM k),
y AS (SELECT *, len(list_intersect(a, b)) AS c, regexp_matches(pc, '\\b(not|no|never|none)\\b') <> regexp_matches(content, '\\b(not|no|never|none)\\b') AS neg FROM x),
r AS (SELECT *, CASE WHEN pc IS NULL THEN NULL WHEN neg AND c >= 0.5 * least(len(a), len(b)) THEN 'contradicts' WHEN c >= 0.8 * (len(a) + len(b) - c) THEN 'same' WHEN c = len(a) AND len(b) > len(a) THEN 'refines' WHEN c = 0 AND t0 - pt <= 200 THEN 'independent' ELSE 'newer' END AS rel FROM y),
g AS (SELECT *, sum(CASE WHEN rel = 'same' THEN 0 ELSE 1 END) OVER w AS g, lead(rel) OVER w AS nx FROM r WINDOW w AS (PARTITION BY entity, property ORDER BY t0, unit_id)),
h AS (SELECT entity, property, g, list(unit_id ORDER BY t0, unit_id) AS ids, arg_max(content, t0) AS last, list(nx ORDER BY t0 DESC, unit_id DESC)[1] AS nx, list(rel ORDER BY t0, unit_id)[1] AS rel, list(pc ORDER BY t0, unit_id)[1] AS pc FROM g GROUP BY ALL),
z AS (SELECT *, CASE WHEN nx IN ('newer', 'refines') THEN 'archive' WHEN len(ids) > 1 THEN 'merge' WHEN rel = 'contradicts' THEN 'update' END AS op FROM h)
SELECT entity, property, 'retire' AS op, unit_id, NULL AS content FROM d WHERE dup > 1 AND size > 1 UNION ALL SELECT entity, property, 'retire', unnest(ids), NULL FROM z WHERE op IS NOT NULL
UNION ALL SELECT entity, property, 'addition', NULL, last FROM z WHERE op = 'merge' UNION ALL SELECT entity, property, 'replacement', ids[1], last || ' [against: ' || pc || ']' FROM z WHERE op = 'update'""")
def v11_detected(spark, sf_dir):
    """From the units alone: open clusters, typed relations of neighbours in time, actions, plan."""
    p = table(spark, sf_dir, "part")
    said = F.when(F.col("p_size") % 4 == 0, " not in stock").when((F.col("p_size") % 4).isin(1, 2), " in stock").otherwise("")
    m = p.select(F.col("p_brand").alias("entity"), F.col("p_type").alias("property"), F.col("p_partkey").cast("string").alias("unit_id"), F.concat("p_name", said).alias("content"), F.col("p_partkey").cast("long").alias("t_ingest"), F.lit(False).alias("done"))
    return relations.conflict_plan(m, ["entity", "property"], 200.0).select("entity", "property", "op", "unit_id", "content")


@query("V12_property_merge", """WITH RECURSIVE c AS (SELECT DISTINCT o_custkey % 40 AS g, (o_custkey % 40) // 2 AS up FROM orders WHERE (o_custkey % 40) % 3 <> 0),
f AS (SELECT g, up FROM c UNION ALL SELECT f.g, c.up FROM f JOIN c ON c.g = f.up), e AS (SELECT g, min(up) AS fin FROM f GROUP BY g)
SELECT o_orderkey, 'p' || lpad(coalesce(fin, o_custkey % 40)::varchar, 2, '0') AS property, CASE WHEN fin IS NOT NULL THEN 'p' || lpad((o_custkey % 40)::varchar, 2, '0') END AS merged_from FROM orders LEFT JOIN e ON g = o_custkey % 40""")
def v12(spark, sf_dir):
    name = lambda c: F.concat(F.lit("p"), F.lpad(c.cast("string"), 2, "0"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("g"))
    g = o.select("g").distinct().where("g % 3 <> 0 AND g > 0")
    near = g.select(name(F.col("g")).alias("property"), name(F.floor(F.col("g") / 2)).alias("other"), F.lit(0.9).alias("score"))
    weak = g.select(name(F.col("g")).alias("property"), F.lit("p00").alias("other"), F.lit(0.4).alias("score"))
    plan = evolve.merge_plan(near.unionByName(weak), 0.5)
    return evolve.merged_properties(o.select("o_orderkey", name(F.col("g")).alias("property")), plan)


@query("V14_hierarchy_composer", """WITH RECURSIVE e AS (SELECT conv_id, turn, turn * 1000.0::double AS t0, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, i, t0, role, turn, t0 AS start FROM e WHERE i = 1 UNION ALL SELECT e.conv_id, e.i, e.t0, e.role, e.turn, CASE WHEN e.t0 - f.start > 2500 THEN e.t0 ELSE f.start END FROM f JOIN e ON e.conv_id = f.conv_id AND e.i = f.i + 1)
SELECT conv_id, min(t0) AS span_start, max(t0) + 10 AS span_end, string_agg(turn::varchar, ',' ORDER BY t0) AS children, count(*) AS n, CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS role FROM f GROUP BY conv_id, start""")
def v14(spark, sf_dir):
    at = F.col("turn") * F.lit(1000.0)
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.concat_ws("/", "conv_id", "turn").alias("unit_id"), F.lit(True).alias("session"), at.alias("at"), (at + 10).alias("end"), "role")
    up = evolve.composed(c, "conv_id", 2500, "role")
    return up.select("conv_id", "span_start", "span_end", F.array_join(F.transform("child_ids", lambda x: F.element_at(F.split(x, "/"), -1)), ",").alias("children"), "n", "role")


@query("V14_incremental_parents", """WITH RECURSIVE e AS (SELECT conv_id, turn, turn * 1000.0::double AS t0, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, i, t0, turn, t0 AS start FROM e WHERE i = 1 UNION ALL SELECT e.conv_id, e.i, e.t0, e.turn, CASE WHEN e.t0 - f.start > 2500 THEN e.t0 ELSE f.start END FROM f JOIN e ON e.conv_id = f.conv_id AND e.i = f.i + 1)
SELECT conv_id, min(t0) AS span_start, max(t0) + 10 AS span_end, string_agg(turn::varchar, ',' ORDER BY t0) AS children, count(*) AS n FROM f GROUP BY conv_id, start""")
def v14_incremental(spark, sf_dir):
    """Two late runs of turns merged into stored parents: the parents of a full derivation."""
    at = F.col("turn") * F.lit(1000.0)
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.format_string("%010d", F.col("turn").cast("long")).alias("unit_id"), F.lit("s").alias("session"), at.alias("at"), (at + 10).alias("end"), "turn")
    run = lambda k: c.where(F.pmod(F.col("turn") * 7 + F.col("conv_id"), F.lit(3)) == k).drop("turn")
    held = written(relations.assigned(run(0), "conv_id", 2500), "leaves")
    up = written(relations.parents_of(held, "conv_id"), "parents")
    for k in (1, 2):
        up, held = relations.recomposed(up, held, run(k), "conv_id", 2500)
        up, held = written(up, "parents"), written(held, "leaves")
    return up.select("conv_id", "span_start", "span_end", F.array_join(F.transform("child_ids", lambda x: x.cast("int").cast("string")), ",").alias("children"), "n")


_ROUTES = [
    {"name": "personal", "owner": "user", "space_template": "u/{user}", "fallback": True},
    {"name": "team", "owner": "team", "space_template": "t/{team}", "cross_user": True, "members": ["*"]},
    {"name": "audit", "owner": "team", "record_only": True},
]


@query("V16_routed_spaces", f"""WITH {UNITS_SQL}, k AS (SELECT unit_id, user_id, space, CASE n_chars % 4 WHEN 0 THEN 'team' WHEN 1 THEN 'audit' WHEN 2 THEN 'other' ELSE 'personal' END AS c FROM units)
SELECT unit_id, CASE WHEN c = 'team' AND space IN ('src0', 'src1', 'src2') THEN 't/' || space ELSE 'u/' || user_id END AS space, CASE WHEN c = 'audit' OR (c = 'team' AND space IN ('src0', 'src1', 'src2')) OR (c = 'personal' AND user_id IN ('en', 'de')) THEN c ELSE 'personal' END AS memory_class,
  CASE WHEN c = 'audit' AND trim(space) <> '' THEN 'team_id=' || space END AS record_tag, CASE WHEN c = 'other' THEN 'unknown class' WHEN c = 'audit' OR (c = 'team' AND space IN ('src0', 'src1', 'src2')) OR (c = 'personal' AND user_id IN ('en', 'de')) THEN '' ELSE 'space not allowed' END AS reason FROM k""")
def v16(spark, sf_dir):
    k = F.col("n_chars") % 4
    u = units(spark, sf_dir).select("unit_id", F.col("user_id").alias("user"), F.col("space").alias("team"), F.when(k == 0, "team").when(k == 1, "audit").when(k == 2, "other").otherwise("personal").alias("memory_class"))
    allowed = spark.createDataFrame([("t/src0",), ("t/src1",), ("t/src2",), ("u/en",), ("u/de",)], "space string")
    return evolve.routed(u, _ROUTES, {"user": F.col("user"), "team": F.col("team")}, allowed)


@query("X39_relative_anchors", """WITH e AS (SELECT event_id, event_id % 9 AS k, ts::date AS d, date_trunc('week', ts)::date AS m FROM events) SELECT event_id, CASE k WHEN 0 THEN 'day before' WHEN 1 THEN 'weekday of week' WHEN 2 THEN 'weekday before' WHEN 3 THEN 'month before' WHEN 4 THEN 'year after' WHEN 5 THEN 'weekday of week' WHEN 6 THEN 'weekend before' WHEN 7 THEN 'day of month' END AS kind,
CASE k WHEN 0 THEN strftime(d - 1, '%Y-%m-%d') WHEN 1 THEN strftime(m - 7 + 2, '%Y-%m-%d') WHEN 2 THEN strftime(d - (CASE (isodow(d) - 1 - 4 + 7) % 7 WHEN 0 THEN 7 ELSE (isodow(d) - 1 - 4 + 7) % 7 END)::int, '%Y-%m-%d') WHEN 3 THEN strftime(d - INTERVAL 1 MONTH, '%Y-%m') WHEN 4 THEN strftime(d + INTERVAL 1 YEAR, '%Y') WHEN 5 THEN strftime(m + 7 + 6, '%Y-%m-%d') WHEN 6 THEN strftime(m - 2, '%Y-%m') WHEN 7 THEN strftime(date_trunc('month', d) - INTERVAL 1 MONTH + INTERVAL 4 DAY, '%Y-%m-%d') END AS anchor FROM e""")
def x39(spark, sf_dir):
    said = F.array(*map(F.lit, ("we met Yesterday or last year", "it was last week on Wednesday", "on last friday", "last month, today", "maybe next year", "下周日见", "last weekend was fine", "上个月 5号", "no time at all")))
    e = table(spark, sf_dir, "events").select("event_id", "ts", evolve.relative_mention(F.element_at(said, (F.col("event_id") % 9 + 1).cast("int"))).alias("m"))
    return e.select("event_id", "m.kind", evolve.relative_anchor(F.col("m"), F.col("ts")).alias("anchor"))


@query("X39_compatible_times", """WITH e AS (SELECT event_id, event_id % 6 AS k, ts::date AS d, date_trunc('week', ts)::date AS m FROM events), g AS (SELECT *, left(strftime(CASE WHEN k < 3 THEN d - 1 ELSE m - 2 END, '%Y-%m-%d'), CASE WHEN k IN (2, 5) THEN 7 ELSE 10 END) AS given FROM e)
SELECT event_id, given, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN given = strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%Y-%m') WHEN 3 THEN true WHEN 4 THEN false ELSE true END AS fits FROM g""")
def x39_fits(spark, sf_dir):
    """Given times beside one and two relative times of their texts."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("event_id") % 6).cast("int").alias("k"))
    monday = F.date_sub(F.to_date("ts"), F.weekday(F.to_date("ts")))
    given = F.left(F.date_format(F.when(F.col("k") < 3, F.date_sub(F.to_date("ts"), 1)).otherwise(F.date_sub(monday, 2)), "yyyy-MM-dd"), F.when(F.col("k").isin(2, 5), 7).otherwise(10))
    said = F.element_at(F.array(*map(F.lit, ("we met yesterday", "it was today, not yesterday", "in the last month", "it was last weekend", "last weekend or last year", "上周末见"))), F.col("k") + 1)
    return e.select("event_id", given.alias("given"), evolve.relative_times_fit(given, said, F.col("ts")).alias("fits"))


@query("X40_property_time", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '2024-05-06' WHEN 1 THEN '2024-05' WHEN 7 THEN '2023' ELSE '' END AS time, CASE event_id % 8 WHEN 2 THEN 'several times' WHEN 3 THEN 'no time' WHEN 4 THEN 'empty time' WHEN 5 THEN 'invalid time' WHEN 6 THEN 'inconsistent time' END AS error FROM events""")
def x40(spark, sf_dir):
    k = (F.col("event_id") % 8 + 1).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), k)
    value = pick("moved on 2024-05-06 to Rome", "since 2024-05", "from 2020 to 2024", "likes tea", "in 2021", "in 2021", "in 2021-03", "born 2023, met 2024-01-01")
    given = F.when(k.isin(1, 3, 4), None).otherwise(pick("", "2024-05", "", "", " ", "2021-13", "2021", " 2023 "))
    p = table(spark, sf_dir, "events").select("event_id", evolve.property_time(given, value).alias("p"))
    return p.select("event_id", "p.time", "p.error")


@query("W30_analytic_windows", "SELECT event_id, percent_rank() OVER w AS percent, ntile(4) OVER w AS quarter, lead(event_id) OVER w AS following, lag(event_id, 2) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)")
def w30(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.percent_rank().over(w).alias("percent"), F.ntile(4).over(w).cast("long").alias("quarter"), F.lead("event_id").over(w).alias("following"), F.lag("event_id", 2).over(w).alias("before"))


@query("F14_F15_pushed_filter", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'P') AND NOT coalesce(o_orderpriority = '5-LOW', false)")
def f14(spark, sf_dir):
    from memspark.functions import predicates as p

    o = table(spark, sf_dir, "orders")
    tree = p.parse({"AND": [{"o_totalprice": {"gte": 100000}}, {"o_orderstatus": {"in": ["F", "P"]}}, {"NOT": {"o_orderpriority": "5-LOW"}}]})
    return o.where(p.predicate(tree, p.resolver(o.dtypes))).select("o_orderkey")


@query("V01_V08_annotated_chunks", f"WITH {UNITS_SQL}, s AS (SELECT unit_id, content, tags, unnest(range(0, greatest(length(content), 1), 120)) AS start FROM units), c AS (SELECT unit_id, start, substr(content, start + 1, 120) AS x, tags FROM s) SELECT unit_id, start::int AS start, md5(left(x, 20)) AS l1, len(regexp_extract_all(lower(x), '[0-9a-z]+|[\\x{{4e00}}-\\x{{9fff}}]'))::int AS tokens FROM c")
def v01(spark, sf_dir):
    u = units(spark, sf_dir)
    c = u.select("unit_id", "tags", F.explode(plugins.get("chunker", "fixed")(F.col("content"), 120)).alias("c"))
    layers = plugins.get("annotator", "keyword")(F.col("c.text"), F.col("tags"), 20)
    return c.select("unit_id", "c.start", F.md5(layers["l1"]).alias("l1"), F.size(plugins.get("tokenizer", "simple")(F.col("c.text"))).alias("tokens"))


@query("V03_V09_echo_and_pairs", "WITH pt AS (SELECT p_partkey::varchar AS unit_id, p_brand, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[0-9a-z]+'))) AS tok FROM part) SELECT a.unit_id AS a, b.unit_id AS b, count(*)::int AS common, a.unit_id || '-' || b.unit_id AS said FROM pt a JOIN pt b ON a.p_brand = b.p_brand AND a.tok = b.tok AND a.unit_id < b.unit_id GROUP BY 1, 2 HAVING count(*) >= 2")
def v03(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("unit_id"), "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("content"))
    pairs = plugins.get("associator", "keyword")(p, 2, ["p_brand"])
    return pairs.select("a", "b", "common", plugins.get("llm", "echo")(F.concat_ws("-", "a", "b")).alias("said"))


def _lineage(spark, sf_dir) -> Engine:
    """The engine over units of which each is derived from the one before it in its ten."""
    e = engine(spark, sf_dir)
    n = F.substring("unit_id", 2, 20).cast("long")
    return replace(e, units=e.units.withColumn("provenance", F.when(n % 10 != 0, F.array(F.concat(F.lit("d"), n - 1))).otherwise(F.array().cast("array<string>"))))


@query("G09_trace", "SELECT 'd' || doc_id AS node, (27 - doc_id)::int AS hop FROM documents WHERE doc_id BETWEEN 20 AND 27")
def g09(spark, sf_dir):
    return _lineage(spark, sf_dir).trace("d27")


@query("G06_purge_derived", "SELECT 'd' || doc_id AS unit_id FROM documents WHERE doc_id < 23 OR doc_id >= 30")
def g06p(spark, sf_dir):
    return _lineage(spark, sf_dir).delete("purge", ids=["d23"]).units.select("unit_id")


@query("G01_batch_add", f"WITH {UNITS_SQL} SELECT unit_id, 'there' AS outcome FROM units UNION ALL SELECT 'e' || event_id, CASE WHEN event_id % 4 = 1 THEN 'empty content' WHEN event_id % 4 = 2 THEN 'unknown space' ELSE 'added' END FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT 'd' || event_id % 50, 'conflict' FROM events WHERE event_id % 4 = 3")
def g01(spark, sf_dir):
    e = engine(spark, sf_dir)
    k = F.col("event_id") % 4
    new = table(spark, sf_dir, "events").select(F.when(k == 3, F.concat(F.lit("d"), F.col("event_id") % 50)).otherwise(F.concat(F.lit("e"), "event_id")).alias("unit_id"), F.when(k == 1, "").otherwise(F.col("props")).alias("content"), F.when(k == 2, "nowhere").otherwise("src0").alias("space"), F.lit("en").alias("user_id"))
    spaces = e.units.select("space").distinct()
    report = e.batch_add(new, spaces)[1]
    return e.units.select("unit_id", F.lit("there").alias("outcome")).unionByName(report.select("unit_id", "outcome"))


@query("G05_batch_supersede", f"WITH {UNITS_SQL}, h AS (SELECT unit_id FROM units WHERE list_contains(tags, 'fr') AND lifecycle = 'active' ORDER BY t_ingest, unit_id LIMIT 7) SELECT unit_id, CASE WHEN unit_id IN (SELECT unit_id FROM h) THEN 'superseded' ELSE lifecycle END AS lifecycle, NULL AS supersedes FROM units UNION ALL SELECT unit_id || '+', 'active', unit_id FROM h")
def g05s(spark, sf_dir):
    out = engine(spark, sf_dir).batch_update({"content": F.lit("new")}, limit=7, mode="supersede", at=EPOCH + STEP, tags=["fr"])
    return out.units.select("unit_id", "lifecycle", "supersedes")


@query("G11_space_usage", f"WITH {UNITS_SQL} SELECT space, count(*) AS memories, sum(length(content))::bigint AS chars, count(*) FILTER (lifecycle = 'active') AS active FROM units GROUP BY space")
def g11(spark, sf_dir):
    return engine(spark, sf_dir).usage("space")


@query("A21_snapshot_digest", f"WITH {UNITS_SQL} SELECT user_id, sha256(string_agg(unit_id || ':' || lifecycle, chr(10) ORDER BY unit_id)) AS token FROM units GROUP BY user_id")
def a21(spark, sf_dir):
    u = units(spark, sf_dir).select("user_id", F.struct("unit_id", "lifecycle").alias("r"))
    each = u.groupBy("user_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return each.select("user_id", F.sha2(F.array_join(F.transform("rs", lambda r: F.concat_ws(":", r["unit_id"], r["lifecycle"])), "\n"), 256).alias("token"))


@query("P10_secondary_order", f"WITH {_KEPT}, p AS (SELECT f1.unit_id, score, coalesce(importance, 0.5) AS secondary FROM f1 JOIN units u ON u.unit_id = f1.unit_id ORDER BY round(score, 12) DESC, f1.unit_id LIMIT 60), o AS (SELECT unit_id, row_number() OVER (ORDER BY secondary DESC, score DESC, unit_id) - 1 AS position FROM p) SELECT unit_id, position FROM o WHERE position < 10")
def p10(spark, sf_dir):
    p = _pipeline(spark, sf_dir, calibrated=True, secondary=F.coalesce("importance", F.lit(0.5)), band=fuse.BAND)
    return p.run()[0].select("unit_id", "position")


@query("V15_index_tables", f"WITH {TOKENS_SQL}, p AS (SELECT unit_id, unnest(toks) AS e FROM tk) SELECT 'forward' AS name, count(*) AS n FROM units UNION ALL SELECT 'fulltext', count(*) FROM (SELECT DISTINCT unit_id, e FROM p) UNION ALL SELECT 'vector', count(*) FROM tk WHERE len(toks) > 0 UNION ALL SELECT 'entity', count(*) FROM (SELECT DISTINCT unit_id, e FROM p WHERE length(e) >= 3 AND regexp_full_match(e, '[\\x00-\\x7f]+'))")
def v15(spark, sf_dir):
    out = None
    for name, rows in ingest.index_tables(units(spark, sf_dir)).items():
        own = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("S18_vector_index", f"WITH {_VEC}, x AS (SELECT vec_id, label, CASE WHEN label = 1 THEN list_reverse(e) ELSE e END AS e FROM v WHERE label <> 0), q AS (SELECT * FROM v WHERE vec_id % 50 = 0), c AS (SELECT b.vec_id AS query_id, a.vec_id AS unit_id, round({_COS}, 12) AS score FROM x a, q b), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id::varchar) - 1 AS rank FROM c WHERE score > 0) SELECT query_id::varchar AS query_id, unit_id::varchar AS unit_id, rank::int AS rank FROM k WHERE rank < 5")
def s18(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"), "label")
    new = v.where("label = 1").withColumn("vector", F.reverse("vector"))
    index = written(ingest.upserted(v, new, v.where("label = 0")), "vector-index")
    asked = v.where("unit_id % 50 = 0").select(F.col("unit_id").alias("query_id"), "vector")  # the query set
    return recall.knn(index, asked, 5).select("query_id", "unit_id", "rank")


@query("G13_file_lines", "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents) SELECT doc_id, line::int AS line, md5(t) AS digest FROM l WHERE line BETWEEN 2 AND 4")
def g13(spark, sf_dir):
    return ingest.line_range(table(spark, sf_dir, "documents"), "doc_id", "text", 2, 4).select("doc_id", "line", F.md5("text").alias("digest"))


@query("G13_file_edit", "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, md5(array_to_string(list_concat(list_concat(list_slice(l, 1, 1), ['new']), list_slice(l, 4, len(l))), chr(10))) AS digest FROM s")
def g13e(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(ingest.edited(F.col("text"), 2, 3, F.lit("new"))).alias("digest"))


@query("V13_V18_dynamic_evolution", f"WITH {UNITS_SQL}, f AS (SELECT unit_id || '#' || (start // 120) AS id, user_id, substr(content, start + 1, 120) AS c FROM (SELECT unit_id, user_id, content, unnest(range(0, greatest(length(content), 1), 120)) AS start FROM units)), k AS (SELECT *, min(id) OVER (PARTITION BY user_id, sha256(c)) AS one FROM f), a AS (SELECT user_id, id, left(c, 50) AS c, row_number() OVER (PARTITION BY user_id ORDER BY id) AS r FROM k WHERE id = one) SELECT CASE WHEN id = one THEN 'fact' ELSE 'retired' END AS kind, id AS unit_id, md5(c) AS digest FROM k UNION ALL SELECT 'abstract', 'abstract:' || user_id, md5(string_agg(c, '；' ORDER BY id)) FROM a WHERE r <= 8 GROUP BY user_id")
def v18(spark, sf_dir):
    return evolve.dynamic(units(spark, sf_dir), ["user_id"]).select("kind", "unit_id", F.md5("content").alias("digest"))


@query("G12_job_states", "WITH l AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'running' END AS state FROM events) SELECT job_id, coalesce(arg_min(state, seq) FILTER (state <> 'running'), 'running') AS state, coalesce(min(seq) FILTER (state <> 'running'), max(seq)) AS at FROM l GROUP BY job_id")
def g12(spark, sf_dir):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("running")
    return govern.job_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), state.alias("state")))


@query("G16_personal_page", f"WITH {UNITS_SQL}, p AS (SELECT * FROM units WHERE (user_id = 'en' AND space = 'src0') OR (user_id = 'de' AND tier = 'core')) SELECT unit_id, count(*) OVER () AS total FROM p WHERE lifecycle = 'active' ORDER BY t_ingest DESC, unit_id DESC LIMIT 12 OFFSET 3")
def g16(spark, sf_dir):
    yes = F.lit(True)
    own = govern.personal(units(spark, sf_dir), [(F.expr("user_id = 'en' AND space = 'src0'"), yes), (F.expr("user_id = 'de' AND tier = 'core'"), yes), (F.expr("user_id = 'fr'"), F.lit(False))])
    return connectors.paged(own.where("lifecycle = 'active'"), [F.desc("t_ingest"), F.desc("unit_id")], 3, 12).select("unit_id", "total")
