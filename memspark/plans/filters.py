"""Queries on scans and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import predicates as p
from memspark.functions import scopes as s
from memspark.operators.link import blocked, by_blocks, tiled
from memspark.plans.registry import query
from memspark.sources.tables import EPOCH, UNITS_SQL, table, units

NOW = EPOCH + 500 * 60_000

#: name: (filter, SQL condition that is true or false)
PREDICATES = {
    "F01_eq": ({"tier": "core"}, "coalesce(tier = 'core', false)"),
    "F02_ne_null_is_true": ({"importance": {"ne": 1}}, "importance IS NULL OR importance <> 1"),
    "F03_in_list": ({"tier": ["core", "working"]}, "tier IN ('core', 'working')"),
    "F04_not_in": ({"importance": {"not_in": [0, 2]}}, "importance IS NULL OR importance NOT IN (0, 2)"),
    "F05_compare": ({"n_chars": {"gte": 1000, "lt": 5000}}, "n_chars >= 1000 AND n_chars < 5000"),
    "F05_type_mismatch": ({"OR": [{"tier": {"gt": 3}}, {"t_event": {"lte": EPOCH + 60_000_000}}]}, f"coalesce(t_event <= {EPOCH + 60_000_000}, false)"),
    "F06_contains": ({"tags": {"contains": "de"}}, "list_contains(tags, 'de')"),
    "F07_not_pushed_inward": ({"NOT": {"OR": [{"t_event": {"gt": EPOCH}}, {"AND": [{"tags": {"contains": "en"}}, {"lifecycle": "active"}]}]}}, f"NOT (coalesce(t_event > {EPOCH}, false) OR (list_contains(tags, 'en') AND lifecycle = 'active'))"),
    "F08_dsl_multi_key": ({"user_id": "en", "lifecycle": {"ne": "archived"}, "OR": [{"tier": "core"}, {"importance": 1}]}, "user_id = 'en' AND lifecycle <> 'archived' AND (tier = 'core' OR coalesce(importance = 1, false))"),
    "F09_dsl_round_trip": (p.unparse(p.parse([{"tier": ["core"]}, {"NOT": {"user_id": "en"}}])), "tier = 'core' AND user_id <> 'en'"),
}


def _predicate(name: str, spec: dict, where: str) -> None:
    @query(name, f"WITH {UNITS_SQL} SELECT unit_id, ({where}) AS holds FROM units")
    def run(spark, sf_dir, spec=spec):
        u = units(spark, sf_dir)
        return u.select("unit_id", p.truth(p.parse(spec), p.resolver(u.dtypes)).alias("holds"))

    kept = name.replace("_", "_keep_", 1)

    @query(kept, f"WITH {UNITS_SQL} SELECT unit_id, tier, user_id FROM units WHERE {where}")
    def keep(spark, sf_dir, spec=spec):
        u = units(spark, sf_dir)
        return u.where(p.predicate(p.parse(spec), p.resolver(u.dtypes))).select("unit_id", "tier", "user_id")


for _name, (_spec, _where) in PREDICATES.items():
    _predicate(_name, _spec, _where)


@query("F10_canonical_metadata", "SELECT event_id, coalesce(json_extract_string(props, '$.k') = '42', false) AS holds FROM events")
def f10(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("user_metadata"))
    return e.select("event_id", p.truth(p.parse({"k": "42"}, p.canonical), p.resolver(e.dtypes)).alias("holds"))


@query("F11_and_merge", f"WITH {UNITS_SQL} SELECT unit_id FROM units WHERE lifecycle = 'active' AND (tier = 'core' OR user_id = 'fr')")
def f11(spark, sf_dir):
    u = units(spark, sf_dir)
    expr = p.and_merge(p.parse({"OR": [{"tier": "core"}, {"user_id": "fr"}]}), p.Leaf("lifecycle", "eq", "active"))
    return u.where(p.predicate(expr, p.resolver(u.dtypes))).select("unit_id")


@query("F12_required_equality", f"WITH {UNITS_SQL} SELECT unit_id, space FROM units WHERE space = 'src0' AND (tier = 'core' OR n_chars < 100)")
def f12(spark, sf_dir):
    u = units(spark, sf_dir)
    expr = p.parse({"space": "src0", "OR": [{"tier": "core"}, {"n_chars": {"lt": 100}}]})
    assert p.required_equality(expr, "space") == "src0"
    return u.where(p.predicate(expr, p.resolver(u.dtypes))).select("unit_id", "space")


_ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, epoch_ms(o_orderdate) AS t_valid, CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + (o_custkey % 700 - 100) * 86400000 END AS t_invalid FROM orders)"
AT = 883_612_800_000  # 1998-01-01


def orders_validity(spark, sf_dir):
    """Orders as facts with a validity: from their date, closed ones some days after (or before: an empty window)."""
    o = table(spark, sf_dir, "orders")
    start = F.unix_millis("o_orderdate")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", start.alias("t_valid"), F.when(F.col("o_orderstatus") != "O", start + (F.col("o_custkey") % 700 - 100) * 86_400_000).alias("t_invalid"))


@query("F13_index_sentinels", f"WITH {_ORDERS} SELECT o_orderkey, t_valid, coalesce(t_invalid, 253402300799000) AS t_invalid, 0::bigint AS t_event FROM o")
def f13(spark, sf_dir):
    from memspark.sources.model import as_units, index_view

    o = orders_validity(spark, sf_dir)
    made = o.select(F.col("o_orderkey").cast("string").alias("id"), F.struct(F.lit(None).cast("timestamp").alias("t_event"), F.lit(None).cast("timestamp").alias("t_ingest"), F.timestamp_millis("t_valid").alias("t_valid"), F.timestamp_millis("t_invalid").alias("t_invalid"), F.lit(None).cast("timestamp").alias("t_message")).alias("temporal"))
    return index_view(as_units(made)).select(F.col("unit_id").cast("long").alias("o_orderkey"), "t_valid", "t_invalid", F.col("t_event").cast("long").alias("t_event"))


@query("F16_scope_exact", f"WITH {UNITS_SQL} SELECT unit_id FROM units WHERE space = 'src0' AND user_id = 'de'")
def f16(spark, sf_dir):
    return units(spark, sf_dir).where(s.exact({"space": "src0", "user_id": "de"}, ("space", "user_id"))).select("unit_id")


@query("F17_scope_hierarchical", f"WITH {UNITS_SQL} SELECT unit_id FROM units WHERE space = 'src0'")
def f17(spark, sf_dir):
    return units(spark, sf_dir).where(s.hierarchical({"space": "src0"}, ("space", "user_id"))).select("unit_id")


@query("F19_system_predicate_as_of", f"WITH {_ORDERS} SELECT o_orderkey FROM o WHERE o_orderstatus <> 'F' AND t_valid <= {AT} AND coalesce(t_invalid, 253402300799000) > {AT}")
def f19(spark, sf_dir):
    o = orders_validity(spark, sf_dir).withColumn("lifecycle", F.when(F.col("o_orderstatus") == "F", "forgotten").otherwise("active"))
    return o.where(s.system_predicate(AT)).select("o_orderkey")


@query("F20_event_window", f"WITH {UNITS_SQL} SELECT unit_id FROM units WHERE t_event IS NULL OR (t_event >= {EPOCH + 30_000_000} AND t_event < {EPOCH + 120_000_000})")
def f20(spark, sf_dir):
    return units(spark, sf_dir).where(s.event_window(EPOCH + 30_000_000, EPOCH + 120_000_000)).select("unit_id")


@query("F21_F22_valid_at", f"WITH {_ORDERS} SELECT o_orderkey, t_valid <= {AT} AND (t_invalid IS NULL OR {AT} < t_invalid) AS plain, CASE WHEN coalesce(t_invalid <= t_valid, false) THEN {AT} < t_invalid ELSE t_valid <= {AT} AND (t_invalid IS NULL OR {AT} < t_invalid) END AS engine FROM o")
def f21(spark, sf_dir):
    return orders_validity(spark, sf_dir).select("o_orderkey", s.valid_at(F.lit(AT)).alias("plain"), s.engine_valid_at(F.lit(AT)).alias("engine"))


@query("F23_F24_truth_recheck", f"WITH {_ORDERS} SELECT o_orderkey FROM o WHERE o_orderstatus IN ('O', 'P') AND t_valid <= {AT} AND (t_invalid IS NULL OR {AT} < t_invalid) AND o_orderpriority <> '5-LOW'")
def f23(spark, sf_dir):
    o = orders_validity(spark, sf_dir).withColumn("lifecycle", F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "P", "archived").otherwise("active"))
    user = p.predicate(p.parse({"o_orderpriority": {"ne": "5-LOW"}}), p.resolver(o.dtypes))
    return o.where(s.passes_lifecycle(None, True, F.lit(AT)) & user).select("o_orderkey")


_H = "h AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'time' WHEN 'view' THEN 'time' WHEN 'error' THEN 'topic' END AS h_kind, CASE event_type WHEN 'click' THEN 'scene' WHEN 'view' THEN 'leaf' END AS h_role, CASE WHEN value < 50 THEN 'active' ELSE 'stale' END AS h_status, epoch_ms(ts) AS span_start, epoch_ms(ts) + (value * 60000)::bigint AS span_end FROM events)"


def _hierarchy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    start = F.unix_millis("ts")
    return e.select("event_id", F.when(t.isin("click", "view"), "time").when(t == "error", "topic").alias("h_kind"), F.when(t == "click", "scene").when(t == "view", "leaf").alias("h_role"), F.when(F.col("value") < 50, "active").otherwise("stale").alias("h_status"), start.alias("span_start"), (start + F.round(F.col("value") * 60_000).cast("long")).alias("span_end"))


@query("F25_hierarchy_predicate", f"WITH {_H} SELECT event_id FROM h WHERE h_kind = 'time' AND h_status = 'active' AND h_role IN ('leaf', 'time_span', 'scene') AND span_start <= 1704672000000 AND span_end >= 1704240000000")
def f25(spark, sf_dir):
    return _hierarchy(spark, sf_dir).where(s.hierarchy_hit("time", s.roles_up_to("scene"), F.lit(1_704_240_000_000), F.lit(1_704_672_000_000))).select("event_id")


@query("F26_not_generated", f"WITH {_H} SELECT event_id FROM h WHERE NOT coalesce(h_kind = 'time' AND h_role IN ('time_span', 'scene', 'event'), false)")
def f26(spark, sf_dir):
    return _hierarchy(spark, sf_dir).where(s.hierarchy_hit(None, (), None, None)).select("event_id")


@query("F27_role_ladder", f"WITH {_H} SELECT h_role, count(*) AS n FROM h WHERE h_role IN ('leaf', 'time_span', 'scene') GROUP BY h_role")
def f27(spark, sf_dir):
    return _hierarchy(spark, sf_dir).where(F.col("h_role").isin(*s.roles_up_to("scene"))).groupBy("h_role").agg(F.count("*").alias("n"))


@query("F29_F30_selectors", f"WITH {UNITS_SQL} SELECT unit_id FROM units WHERE list_has_any(tags, ['fr', 'src3']) AND t_ingest < {NOW} AND t_ingest > {EPOCH} AND tier <> 'core'")
def f29(spark, sf_dir):
    u = units(spark, sf_dir).withColumn("t_message", F.col("t_ingest"))
    return u.where(s.selected(tags=["fr", "src3"], before=NOW, after=EPOCH, extra=F.col("tier") != "core")).select("unit_id")


@query("F31_audit_filter", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20' ORDER BY event_id LIMIT 50")
def f31(spark, sf_dir):
    from memspark.operators.govern import audit

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.col("ts").alias("occurred_at"))
    out = audit(rows, {"action": "error"}, "2024-01-03", "2024-01-20", 50)
    return out.select(F.col("seq").alias("event_id"), F.col("actor").alias("user_id"), F.col("action").alias("event_type"))


@query("F32_project_default", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type = 'click' THEN 'p1' WHEN event_type = 'view' THEN '' END, '') = ''")
def f32(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").withColumn("project", F.when(t == "click", "p1").when(t == "view", "")).where(s.project_default(False)).select("event_id")


@query("F33_shard_predicate", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O') OR coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN 'O' END IN ('O'), false)")
def f33(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("shard", F.col("o_orderstatus")).withColumn("shard_next", F.when(F.col("o_orderpriority") == "1-URGENT", "O"))
    return o.where(s.in_shards(s.shard_labels("O", ("O", "F", "P")))).select("o_orderkey")


@query("F35_covered_by", "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_mktsegment <> ''")
def f35(spark, sf_dir):
    c, sup = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    nation = lambda k: F.col(k).cast("string")
    # a scope decides for all customers and all suppliers of its nation, so blocks of them meet and pairs are made last
    asked = blocked(c.select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], "customers")
    j = by_blocks(asked, sup.select("s_nationkey", "s_suppkey"), "c_nationkey", "s_nationkey")
    kept = j.where(s.covered_by({"org": nation("s_nationkey"), "user": F.lit("")}, {"org": nation("c_nationkey"), "user": F.col("c_mktsegment")}, (), ("user",)))
    return tiled(kept, "customers", "block")


@query("F36_F37_grants", "SELECT o_orderkey, count(DISTINCT c_custkey) AS holders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' AND o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1998-01-01' AND c_mktsegment = 'BUILDING' GROUP BY o_orderkey")
def f36(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") == "1-URGENT", "read").otherwise("none").alias("action"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("expires_at"))
    c = table(spark, sf_dir, "customer")
    live = o.where(s.granted("read", F.lit("1998-01-01").cast("timestamp"))).join(c, F.col("o_custkey") == F.col("c_custkey"))
    covers = s.scope_covers({"org": F.lit("BUILDING"), "user": F.lit("")}, {"org": F.col("c_mktsegment"), "user": F.col("c_name")})
    return live.where(covers).groupBy("o_orderkey").agg(F.countDistinct("c_custkey").alias("holders"))


@query("F38_space_decision", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'deny:overdrawn' WHEN c_mktsegment = 'MACHINERY' THEN 'deny:segment' WHEN c_acctbal > 5000 THEN 'allow:owner' WHEN n_regionkey = 1 THEN 'allow:member' ELSE 'deny:no_role' END AS decision FROM customer JOIN nation ON c_nationkey = n_nationkey")
def f38(spark, sf_dir):
    from memspark.operators.govern import decide

    facts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ladder = [(F.col("c_acctbal") < 0, "deny:overdrawn"), (F.col("c_mktsegment") == "MACHINERY", "deny:segment"), (F.col("c_acctbal") > 5000, "allow:owner"), (F.col("n_regionkey") == 1, "allow:member")]
    return facts.select("c_custkey", decide(ladder, "deny:no_role").alias("decision"))


@query("F40_candidate_window", f"WITH {UNITS_SQL} SELECT unit_id FROM units WHERE t_ingest >= {NOW} - 7200000")
def f40(spark, sf_dir):
    return units(spark, sf_dir).where(F.col("t_ingest") >= NOW - 7_200_000).select("unit_id")


@query("F42_layer_documents", f"WITH {UNITS_SQL}, x AS (SELECT unit_id, 'l2' AS layer, content AS text FROM units UNION ALL SELECT unit_id, 'l0', CASE WHEN tier = 'core' THEN left(content, 40) END FROM units UNION ALL SELECT unit_id, 'l1', left(content, 200) FROM units) SELECT unit_id, layer, md5(text) AS text FROM x WHERE text IS NOT NULL AND text <> ''")
def f42(spark, sf_dir):
    from memspark.sources.model import layer_documents

    u = units(spark, sf_dir).select(F.col("unit_id").alias("id"), "content", F.struct(F.when(F.col("tier") == "core", F.substring("content", 1, 40)).alias("l0"), F.substring("content", 1, 200).alias("l1")).alias("layers"))
    return layer_documents(u).select("unit_id", "layer", F.md5("text").alias("text"))


@query("F43_metadata_inheritance", "SELECT o_custkey, list(k ORDER BY k) AS keys, list(v ORDER BY k) AS vals FROM (SELECT o_custkey, k, min(v) AS v FROM (SELECT o_custkey, o_orderkey, unnest(['status', 'priority', 'year']) AS k, unnest([o_orderstatus, o_orderpriority, year(o_orderdate)::varchar]) AS v FROM orders) GROUP BY o_custkey, k HAVING count(DISTINCT v) = 1) GROUP BY o_custkey")
def f43(spark, sf_dir):
    from memspark.operators.govern import inherited

    o = table(spark, sf_dir, "orders").select("o_custkey", F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("year"), F.year("o_orderdate").cast("string")).alias("metadata"))
    kept = inherited(o, ["o_custkey"], "metadata")
    pairs = F.array_sort(F.map_entries("metadata"))
    return kept.select("o_custkey", F.transform(pairs, lambda e: e["key"]).alias("keys"), F.transform(pairs, lambda e: e["value"]).alias("vals"))


@query("F44_patch_overlay", f"WITH {UNITS_SQL} SELECT u.unit_id, coalesce(CASE WHEN l.toxic = 1 THEN 'core' END, u.tier) AS tier, coalesce(l.quality::double, u.importance, 0.5) AS importance FROM units u LEFT JOIN labels l ON u.unit_id = 'd' || l.doc_id")
def f44(spark, sf_dir):
    from memspark.operators.lifecycle import overlay

    u = units(spark, sf_dir).select("unit_id", "tier", F.coalesce("importance", F.lit(0.5)).alias("importance"))
    patch = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("unit_id"), F.when(F.col("toxic") == 1, "core").alias("tier"), F.col("quality").cast("double").alias("importance"))
    return overlay(u, patch, "unit_id")


@query("F45_tags_merge", f"WITH {UNITS_SQL} SELECT unit_id, array_to_string(list_sort(list_distinct(list_concat(tags, [tier, user_id]))), ',') AS tags FROM units")
def f45(spark, sf_dir):
    u = units(spark, sf_dir)
    return u.select("unit_id", F.array_join(F.array_sort(F.array_union("tags", F.array("tier", "user_id"))), ",").alias("tags"))


@query("F46_personal_facets", f"WITH {UNITS_SQL} SELECT unit_id FROM units WHERE user_id = 'en' AND contains(lower(content || ' ' || array_to_string(tags, ' ')), 'license')")
def f46(spark, sf_dir):
    return units(spark, sf_dir).where(s.text_facets("License", user_id="en")).select("unit_id")


@query("F48_retention_guard", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def f48(spark, sf_dir):
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").join(held, "c_custkey", "left_anti").select("c_custkey")


@query("S01_fetch_since", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10'")
def s01(spark, sf_dir):
    from memspark.sources.connectors import fetch_since

    return fetch_since(table(spark, sf_dir, "events"), "ts", "2024-01-10").select("event_id")


@query("S06_mget", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def s06(spark, sf_dir):
    from memspark.sources.connectors import point_read

    keys = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return point_read(table(spark, sf_dir, "orders"), keys, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("S07_prefix_scan", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%'")
def s07(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").startswith("small")).select("p_partkey", "p_name")


@query("S08_paged_list", f"WITH {UNITS_SQL} SELECT unit_id, t_ingest, count(*) OVER () AS total FROM units WHERE tier = 'semantic' ORDER BY t_ingest DESC, unit_id DESC LIMIT 20 OFFSET 10")
def s08(spark, sf_dir):
    from memspark.sources.connectors import paged

    return paged(units(spark, sf_dir).where("tier = 'semantic'"), [F.desc("t_ingest"), F.desc("unit_id")], 10, 20).select("unit_id", "t_ingest", "total")


@query("S09_scopes", f"WITH {UNITS_SQL} SELECT DISTINCT space, user_id FROM units")
def s09(spark, sf_dir):
    return units(spark, sf_dir).select("space", "user_id").distinct()


@query("S10_ttl", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'P' THEN o_orderdate END IS NULL OR o_orderdate > TIMESTAMP '1998-06-01'")
def s10(spark, sf_dir):
    from memspark.sources.connectors import alive

    o = table(spark, sf_dir, "orders").withColumn("expires_at", F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")))
    return o.where(alive(F.lit("1998-06-01").cast("timestamp"))).select("o_orderkey")


@query("S16_shard_rules", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'cold' WHEN o_totalprice > 300000 THEN 'big' ELSE 'default' END AS shard, count(*) AS n FROM orders GROUP BY 1")
def s16(spark, sf_dir):
    shard = s.route([(F.col("o_orderstatus") == "F", "cold"), (F.col("o_totalprice") > 300_000, "big")], "default")
    return table(spark, sf_dir, "orders").groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))


@query("S20_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def s20(spark, sf_dir):
    from memspark.sources.connectors import drop_with_edges

    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return drop_with_edges(table(spark, sf_dir, "lineitem"), gone, "id", ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("S21_edge_projection", "SELECT user_id, k, event_id AS revision FROM (SELECT user_id, (json_extract_string(props, '$.k'))::int AS k, event_id, event_type, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def s21(spark, sf_dir):
    from memspark.sources.connectors import project_edges

    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_id").alias("revision"), (F.col("event_type") == "error").alias("tombstone"))
    return project_edges(e, ["user_id", "k"]).select("user_id", "k", "revision")


@query("S27_markdown_lines", "SELECT doc_id, sha256(line) AS digest, min(pos) AS pos FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)) WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY doc_id, sha256(line)")
def s27(spark, sf_dir):
    from memspark.sources.connectors import markdown_lines

    return markdown_lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "digest", F.col("pos").cast("long").alias("pos"))


@query("S30_codec", "SELECT event_id, (json_extract_string(props, '$.k'))::int AS k FROM events")
def s30(spark, sf_dir):
    from memspark.sources.connectors import decode

    e = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return decode(e, "value", "k int").select("event_id", "decoded.k")
