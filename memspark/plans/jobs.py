"""Queries on streaming jobs, plugins and the engine's verbs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from memspark.engine import Engine
from memspark.functions import text as t
from memspark.operators import plugins
from memspark.plans.registry import query
from memspark.plans.retrieval import indexed
from memspark.sources.scratch import folder
from memspark.sources.tables import UNITS_SQL, engine_units, table, units
from memspark.streaming import jobs


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema)
    parent = now.inputFiles()[0].rsplit("/", 1)[0]
    # a file source watches folders: a table of one file is the only one of its name in its folder
    raw = reader.parquet(path) if parent.endswith("events.parquet") else reader.option("pathGlobFilter", "events.parquet").parquet(parent)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


_SETTLED = """WITH RECURSIVE past AS (SELECT (epoch_ms(max(ts)) - 3600000) // 600000 AS k FROM events),
e AS (SELECT user_id, event_id, event_type = 'error' AS s, epoch_us(ts) / 1e6 AS t FROM events WHERE epoch_ms(ts) // 600000 < (SELECT k FROM past)),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM e),
f AS (SELECT user_id, s, t, i, t AS start, 0 AS g, '' AS why FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.s, o.t, o.i,
  CASE WHEN o.t - f.t >= 3600 OR o.s <> f.s OR o.t - f.start > 86400 THEN o.t ELSE f.start END, CASE WHEN o.t - f.t >= 3600 OR o.s <> f.s OR o.t - f.start > 86400 THEN f.g + 1 ELSE f.g END,
  CASE WHEN o.t - f.t >= 3600 THEN 'settled' WHEN o.s <> f.s OR o.t - f.start > 86400 THEN 'next' ELSE f.why END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1),
p AS (SELECT user_id, g, min(t) AS start, max(t) AS "end", count(*) AS n FROM f GROUP BY user_id, g),
c AS (SELECT p.*, (SELECT min(f.why) FROM f WHERE f.user_id = p.user_id AND f.g = p.g + 1 AND f.t = f.start) AS why FROM p)
SELECT user_id, round(start, 6) AS start, round("end", 6) AS "end", n, coalesce(why, 'settled') AS closed_by FROM c WHERE why IS NOT NULL OR ("end" + 3600) * 1000 <= (SELECT k FROM past) * 600000"""


@query("T01_T02_stream_spans", _SETTLED)
def t01(spark, sf_dir):
    s = _stream(spark, sf_dir).select("user_id", (F.col("event_type") == "error").alias("session"), "ts", F.col("event_id").alias("unit_id"))
    out = folder(spark, "spans")
    jobs.drained(jobs.settled_spans(s, 86_400, 3600), out, folder(spark, "spans-checkpoint"))
    return spark.read.schema(jobs.SETTLED).parquet(out).select("user_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n", "closed_by")


@query("T03_session_windows", "WITH w AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS b FROM events), g AS (SELECT user_id, ts, sum(coalesce(b, true)::int) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM w) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start FROM g GROUP BY user_id, g")
def t03(spark, sf_dir):
    return jobs.session_windows(table(spark, sf_dir, "events"), "6 hours").select("user_id", "n", F.unix_micros("start").alias("start"))


@query("T04_late_rows", "WITH p AS (SELECT user_id, max(epoch_us(ts) / 1e6) AS mark FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT state, count(*) AS n FROM (SELECT CASE WHEN coalesce(epoch_us(ts) / 1e6 <= mark, false) THEN 'late' WHEN epoch_us(ts) / 1e6 < 1704400000 THEN 'out_of_window' ELSE 'pending' END AS state FROM events LEFT JOIN p USING (user_id)) GROUP BY state")
def t04(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros("ts") / 1e6)
    return jobs.late_rows(e, e.where("event_type = 'error'").withColumn("span_end", F.col("at")), 1_704_400_000.0).groupBy("state").agg(F.count("*").alias("n"))


@query("T05_middle_to_long", f"WITH {UNITS_SQL} SELECT unit_id FROM units WHERE tier = 'working' AND lifecycle = 'active' ORDER BY t_ingest, unit_id LIMIT 100")
def t05(spark, sf_dir):
    return jobs.middle_to_long(units(spark, sf_dir), 100).select("unit_id")


@query("T14_ingest_once", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY ALL")
def t14(spark, sf_dir):
    s = _stream(spark, sf_dir).withColumn("payload_id", F.concat_ws("/", "user_id", "event_type", "value"))
    out = folder(spark, "ingest")
    jobs.drained(jobs.ingested(s, watermark="3650 days"), out, folder(spark, "ingest-checkpoint"))
    return spark.read.schema(s.schema).parquet(out).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("T17_idempotent_recording", "SELECT user_id || '/' || event_type AS request_id, arg_min(value, event_id) AS value, min(value) <> max(value) AS conflict FROM events GROUP BY 1")
def t17(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("request_id"), F.col("event_id").alias("seq"), "value", F.col("value").cast("string").alias("fingerprint"))
    return jobs.recorded(e).select("request_id", "value", "conflict")


@query("T18_latest_revision", "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS revision FROM events GROUP BY user_id")
def t18(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("revision"))


@query("T21_settled_skip", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def t21(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return jobs.unmarked(o.select("o_custkey").distinct(), o.where("o_orderstatus = 'P'"), "o_custkey")


_TOKENS = "unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[0-9a-z]+'))"


@query("V02_hashing_embedder", f"WITH RECURSIVE w AS (SELECT p_partkey, {_TOKENS} AS tok FROM part), h AS (SELECT DISTINCT tok, 0 AS i, 0::bigint AS h FROM w UNION ALL SELECT tok, i + 1, (h * 31 + ascii(substr(tok, i + 1, 1))) % 4294967296 FROM h WHERE i < length(tok)), c AS (SELECT p_partkey, h % 64 AS place, count(*) AS n FROM w JOIN h USING (tok) WHERE i = length(tok) GROUP BY 1, 2), s AS (SELECT p_partkey, sqrt(sum(n * n)) AS size FROM c GROUP BY 1), v AS (SELECT s.p_partkey, t.i, coalesce(c.n, 0) / size AS x FROM s CROSS JOIN range(64) t(i) LEFT JOIN c ON c.p_partkey = s.p_partkey AND c.place = t.i) SELECT p_partkey, round(sum(x * x), 6) AS norm, string_agg(round(x, 6)::varchar, ',' ORDER BY i) AS vector FROM v GROUP BY p_partkey")
def v02(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", plugins.get("embedder", "hashing")(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("v"))
    return p.select("p_partkey", F.round(t.dot(F.col("v"), F.col("v")), 6).alias("norm"), F.array_join(F.transform("v", lambda x: F.round(x, 6).cast("string")), ",").alias("vector"))


@query("V04_keyword_extractor", f"WITH {UNITS_SQL}, s AS (SELECT unit_id, content, unnest(range(0, greatest(length(content), 1), 120)) AS start FROM units) SELECT unit_id || '#' || (start // 120) AS unit_id, unit_id AS source, md5(substr(content, start + 1, 120)) AS digest FROM s")
def v04(spark, sf_dir):
    return plugins.extracted(units(spark, sf_dir)).select("unit_id", F.col("provenance")[0].alias("source"), F.md5("content").alias("digest"))


@query("V05_schema_validation", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id <> 3")
def v05(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") == 3, " Unknown ").otherwise(F.col("user_id").cast("string")).alias("entity"), F.lit("person").alias("entity_type"), F.col("event_type").alias("property"), F.date_format("ts", "yyyy-MM-dd").alias("at"))
    allowed = spark.createDataFrame([("person", "click"), ("person", "view")], "entity_type string, property string")
    return plugins.validated(e, allowed).select("event_id")


@query("V10_A31_recency_resolver", f"WITH {UNITS_SQL}, k AS (SELECT unit_id, user_id, tier, coalesce(t_event, t_ingest) AS tt, CASE tier WHEN 'core' THEN 3 WHEN 'semantic' THEN 2 WHEN 'episodic' THEN 1 ELSE 0 END AS r FROM units), b AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY tt DESC, r DESC) AS p FROM k) SELECT user_id, unit_id FROM b WHERE p = 1")
def v10(spark, sf_dir):
    u = units(spark, sf_dir).withColumn("provenance", F.array("unit_id"))
    return plugins.adjudicated(u, ["user_id"]).select("user_id", "unit_id")


@query("V17_entity_admission", f"WITH {UNITS_SQL} SELECT unit_id, CASE WHEN trim(content) = '' THEN 'empty_content' WHEN tier NOT IN ('semantic', 'core', 'episodic') THEN 'tier' ELSE 'ok' END AS reason FROM units")
def v17(spark, sf_dir):
    return units(spark, sf_dir).select("unit_id", plugins.admitted(F.col("content"), F.col("tier")).alias("reason"))


def engine(spark, sf_dir) -> Engine:
    return Engine(engine_units(spark, sf_dir))


@query("G03_list", f"WITH {UNITS_SQL} SELECT unit_id, count(*) OVER () AS total FROM units WHERE space = 'src0' AND user_id = 'en' AND tier <> 'working' ORDER BY t_ingest DESC, unit_id DESC LIMIT 10 OFFSET 5")
def g03(spark, sf_dir):
    return engine(spark, sf_dir).list({"space": "src0", "user_id": "en"}, 5, 10, {"tier": {"ne": "working"}}).select("unit_id", "total")


@query("G05_update", f"WITH {UNITS_SQL} SELECT unit_id, CASE WHEN unit_id IN (SELECT 'd' || doc_id FROM labels WHERE toxic = 1) THEN 'core' ELSE tier END AS tier FROM units")
def g05(spark, sf_dir):
    patch = table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("unit_id"), F.lit("core").alias("tier"))
    return engine(spark, sf_dir).update(patch).units.select("unit_id", "tier")


@query("G06_delete_forget", f"WITH {UNITS_SQL} SELECT unit_id, CASE WHEN lifecycle <> 'superseded' AND list_has_any(tags, ['fr']) THEN 'forgotten' ELSE lifecycle END AS lifecycle FROM units")
def g06(spark, sf_dir):
    return engine(spark, sf_dir).delete("forget", tags=["fr"]).units.select("unit_id", "lifecycle")


@query("G08_candidates_fan_out", f"WITH {UNITS_SQL}, r AS (SELECT unit_id, space, row_number() OVER (PARTITION BY space, user_id ORDER BY t_ingest, unit_id) AS r FROM units) SELECT unit_id, space FROM r WHERE r <= 3")
def g08(spark, sf_dir):
    return engine(spark, sf_dir).candidates("fan_out", cap=3).select("unit_id", "space")


_POOL = f"{UNITS_SQL}, tk AS (SELECT unit_id, content, regexp_extract_all(lower(content), '[0-9a-z]+|[\\x{{4e00}}-\\x{{9fff}}]') AS toks FROM units WHERE space = 'src0' AND lifecycle = 'active' AND tier <> 'working')"
_ASKED = ("a", "heat", "license", "of", "the")
_TFS = ", ".join(f"len(list_filter(toks, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(_ASKED))
_PARTS = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(_ASKED)))
_FOUND = f"{_POOL}, tf AS (SELECT unit_id, len(toks) AS dl, {_TFS} FROM tk), st AS (SELECT count(*) AS n, coalesce(nullif(avg(dl), 0), 1) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(_ASKED)))} FROM tf), kb AS (SELECT unit_id, CASE WHEN dl = 0 THEN 0 ELSE ({' + '.join(f'tf{i}' for i in range(len(_ASKED)))}) / dl END AS k, {_PARTS} AS b FROM tf, st), hits AS (SELECT unit_id, row_number() OVER (ORDER BY k DESC, unit_id) AS rank FROM kb WHERE k > 0 UNION ALL SELECT unit_id, row_number() OVER (ORDER BY b DESC, unit_id) FROM kb WHERE b > 0), fused AS (SELECT unit_id, sum(1.0::double / (60 + rank)) AS score FROM hits WHERE rank <= 60 GROUP BY unit_id)"
_SAID = "CASE WHEN regexp_matches(content, '[。！？.!?\\n]') THEN left(content, length(regexp_extract(content, '^[^。！？.!?\\n]*')) + 1) ELSE left(content, 80) END"


@query("G02_engine_search", f"WITH {_FOUND}, c AS (SELECT *, max(score) OVER () AS top FROM fused) SELECT c.unit_id, round(score, 9) AS score, {_SAID} AS text FROM c JOIN tk ON tk.unit_id = c.unit_id WHERE score >= 0.1 * top ORDER BY score DESC, c.unit_id LIMIT 10")
def g02(spark, sf_dir):
    own = replace(engine(spark, sf_dir), index=indexed(spark, sf_dir))
    return own.search("the heat of a license", {"space": "src0"}, 10, {"tier": {"ne": "working"}}, ratio=0.1).select("unit_id", F.round("score", 9).alias("score"), "text")


@query("G07_evolve_dedup", f"WITH {UNITS_SQL}, r AS (SELECT unit_id, row_number() OVER (PARTITION BY space, user_id, sha256(content) ORDER BY t_ingest DESC, unit_id DESC) AS r FROM units) SELECT unit_id FROM r WHERE r = 1")
def g07(spark, sf_dir):
    return engine(spark, sf_dir).evolve("dedup").select("unit_id")
