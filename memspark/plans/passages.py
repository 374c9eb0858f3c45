"""Queries on passages of text: questions, dates, segments, prompts, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.plans.registry import query
from memspark.sources.tables import table

_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\[[^\]]*UTC[^\]]*\]', '', 'g'), '(?m)^Sender:[^\n]*\n?', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'))"


@query("X04_phrases", r"""SELECT item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_matches(x, '[A-Za-z0-9一-鿿]')), lambda x: '"' || replace(x, '"', '""') || '"'), ' ') AS phrases FROM benchmark""")
def x04(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(t.fts_terms(F.col("text")), " ").alias("phrases"))


@query("X08_X09_time_windows", """WITH e AS (SELECT event_id, ts, date_trunc('day', ts) AS d, CASE event_id % 5 WHEN 0 THEN 'what happened yesterday?' WHEN 1 THEN 'the day before yesterday' WHEN 2 THEN 'Notes of last month' WHEN 3 THEN 'on 2024-01-03 we met' ELSE 'no time at all' END AS q FROM events),
w AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN d - INTERVAL 1 DAY WHEN 1 THEN d - INTERVAL 2 DAY WHEN 2 THEN date_trunc('month', ts) - INTERVAL 1 MONTH WHEN 3 THEN TIMESTAMP '2024-01-03' END AS a, CASE event_id % 5 WHEN 0 THEN d WHEN 1 THEN d - INTERVAL 1 DAY WHEN 2 THEN date_trunc('month', ts) WHEN 3 THEN TIMESTAMP '2024-01-04' END AS b FROM e)
SELECT event_id, epoch_ms(a::timestamp) AS start_ms, epoch_ms(b::timestamp) AS end_ms FROM w""")
def x08(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("what happened yesterday?", "the day before yesterday", "Notes of last month", "on 2024-01-03 we met", "no time at all"))), (F.col("event_id") % 5 + 1).cast("int"))
    w = table(spark, sf_dir, "events").select("event_id", t.time_window(said, F.col("ts")).alias("w"))
    return w.select("event_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"))


_PHRASES = ("最近3天发生了什么", "过去 2 周", "昨日的会议", "上星期谁来了", "这周", "上个月", "去年12月的事", "今年13月", "他的生日是昨天吗", "6月8日见面", "没有时间", "what happened yesterday")
_LIST = "['" + "', '".join(_PHRASES) + "']"


@query("X08_question_windows", f"""WITH e AS (SELECT event_id, ts, date_trunc('day', ts) AS d, date_trunc('week', ts) AS w, date_trunc('month', ts) AS m, date_trunc('year', ts) AS y, event_id % {len(_PHRASES)} AS k FROM events),
x AS (SELECT event_id, CASE k WHEN 0 THEN ts - INTERVAL 3 DAY WHEN 1 THEN ts - INTERVAL 14 DAY WHEN 2 THEN d - INTERVAL 1 DAY WHEN 3 THEN w - INTERVAL 7 DAY WHEN 4 THEN w WHEN 5 THEN m - INTERVAL 1 MONTH WHEN 6 THEN y - INTERVAL 1 MONTH WHEN 7 THEN y WHEN 9 THEN y + INTERVAL 5 MONTH + INTERVAL 7 DAY WHEN 11 THEN d - INTERVAL 1 DAY END AS a,
CASE k WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN d WHEN 3 THEN w WHEN 4 THEN ts WHEN 5 THEN m WHEN 6 THEN y WHEN 7 THEN ts WHEN 9 THEN y + INTERVAL 5 MONTH + INTERVAL 8 DAY WHEN 11 THEN d END AS b, {_LIST}[k + 1] AS asked FROM e)
SELECT event_id, asked, epoch_us(a::timestamp) AS start_us, epoch_us(b::timestamp) AS end_us FROM x""")
def x08_question(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("event_id") % len(_PHRASES) + 1).cast("int"))
    w = table(spark, sf_dir, "events").select("event_id", asked.alias("asked"), t.question_window(asked, F.col("ts")).alias("w"))
    return w.select("event_id", "asked", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"))


@query("X09_least_window", "SELECT event_id, epoch_us(ts) - 1800000000 AS start_us, epoch_us(ts) + 1800000000 AS end_us FROM events")
def x09(spark, sf_dir):
    w = table(spark, sf_dir, "events").select("event_id", t.widened(F.struct(F.col("ts").alias("start"), F.col("ts").alias("end")), 3600).alias("w"))
    return w.select("event_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"))


@query("X17_cosine", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS a, list_transform(list_reverse(embedding), lambda x: x::double) AS b FROM embeddings) SELECT vec_id, round(list_dot_product(a, b) / list_dot_product(a, a), 6) AS cosine, 0.0::double AS other_length FROM v")
def x17(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(t.cosine(v, F.reverse(v)), 6).alias("cosine"), t.cosine(v, F.slice(v, 1, 3)).alias("other_length"))


@query("X24_category_importance", "SELECT event_id, 0.5::double AS importance, CASE event_id % 9 WHEN 0 THEN 0.95 WHEN 1 THEN 0.90 WHEN 2 THEN 0.85 WHEN 3 THEN 0.80 WHEN 4 THEN 0.75 WHEN 5 THEN 0.50 WHEN 6 THEN 0.30 ELSE 0.5 END::double AS given FROM events")
def x24(spark, sf_dir):
    names = F.array(*map(F.lit, (" Identity", "rule", "preference", "KNOWLEDGE", "relation", "default", "transient", "other")))
    given = F.try_element_at(names, (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", t.category_importance(F.col("event_type")).alias("importance"), t.category_importance(given).alias("given"))


@query("X34_merged_segments", """WITH RECURSIVE p AS (SELECT conv_id, role AS text, turn * 10.0::double AS s, turn * 10.0::double + CASE WHEN length(text) % 3 = 0 THEN 2.0 ELSE 10.0 END::double AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn, turn * 10.0 + CASE WHEN length(text) % 3 = 0 THEN 2.0 ELSE 10.0 END, role) AS i FROM conversations),
f AS (SELECT conv_id, i, 0 AS seq, s, e, text FROM p WHERE i = 1
  UNION ALL SELECT p.conv_id, p.i, f.seq + CASE WHEN p.e - p.s < 5 OR f.e - f.s < 5 THEN 0 ELSE 1 END, CASE WHEN p.e - p.s < 5 OR f.e - f.s < 5 THEN f.s ELSE p.s END, p.e, CASE WHEN p.e - p.s < 5 OR f.e - f.s < 5 THEN f.text || ' ' || p.text ELSE p.text END FROM f JOIN p ON p.conv_id = f.conv_id AND p.i = f.i + 1)
SELECT conv_id, seq::int AS seq, max_by(s, i) AS start, max_by(e, i) AS end, max_by(text, i) AS text FROM f GROUP BY conv_id, seq""")
def x34(spark, sf_dir):
    at = F.col("turn").cast("double")
    part = F.struct((at * 10).alias("start"), (at * 10 + F.when(F.length("text") % 3 == 0, 2.0).otherwise(10.0)).alias("end"), F.col("role").alias("text"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return c.select("conv_id", F.posexplode(t.merged_segments(F.col("parts"), 5.0)).alias("seq", "s")).select("conv_id", "seq", "s.*")


@query("X35_prompt_guard", "SELECT doc_id, CASE WHEN text IS NULL OR length(text) <= 600 THEN text ELSE left(text, 600 - 6) || '…[cut]' END AS prompt FROM documents")
def x35(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.guarded(F.col("text"), 600).alias("prompt"))


@query("X37_fingerprint", """SELECT event_id, sha256('{"id":"' || event_id || '","kind":"' || event_type || '","user":"' || user_id || '"}') AS fingerprint FROM events""")
def x37(spark, sf_dir):
    values = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), "event_type", F.lit("id"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", t.fingerprint(values).alias("fingerprint"))


@query("X47_dates_in_words", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%B %Y') ELSE strftime(o_orderdate, '%-d %B %Y') END AS said FROM orders")
def x47(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", t.humanised(F.col("o_orderdate"), F.when(k == 0, "year").when(k == 1, "month").otherwise("day")).alias("said"))


@query("X43_log_redaction", "SELECT event_id, '*' AS token, '*' AS kind, CASE WHEN event_id % 3 = 0 THEN 'u1' ELSE '*' END AS unit, '*' AS other FROM events")
def x43(spark, sf_dir):
    own = F.concat(F.lit("u"), (F.col("event_id") % 3 + 1).cast("string"))
    details = F.create_map(F.lit("Token"), "props", F.lit("kind"), "event_type", F.lit("system_metadata.Unit_Id"), own, F.lit("user_id"), F.lit("u1"))
    d = table(spark, sf_dir, "events").select("event_id", t.redacted(details, ["u1"]).alias("d"))
    return d.select("event_id", F.col("d")["Token"].alias("token"), F.col("d")["kind"].alias("kind"), F.col("d")["system_metadata.Unit_Id"].alias("unit"), F.col("d")["user_id"].alias("other"))


_SENTENCES = r"list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?\n]+[。！？.!?]*'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query("X48_sentences", rf"WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, s, unnest(range(len(s))) AS seq FROM s) SELECT doc_id, seq::int AS seq, s[seq + 1] AS text, CASE WHEN seq = 0 THEN '' ELSE right(array_to_string(s[greatest(seq - 2, 0) + 1:seq], ' '), 80) END AS context FROM e")
def x48(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", t.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.posexplode(t.with_context(F.col("s"), 2, 80)).alias("seq", "p")).select("doc_id", "seq", "p.text", "p.context")


@query("X49_scalar_metadata", "SELECT event_id, event_id % 4 <> 1 AS scalar FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3")
def x49(spark, sf_dir):
    k = F.col("event_id") % 4
    given = F.when(k == 0, F.col("props")).when(k == 1, F.lit('{"a": [1, 2], "b": 1}')).when(k == 2, F.lit('{"a": null, "b": "x"}')).otherwise(F.lit("no object"))
    return table(spark, sf_dir, "events").select("event_id", t.scalar_metadata(given).alias("scalar"))


@query("W27_overlapping_chunks", "WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 250)) AS start FROM documents WHERE text IS NOT NULL) SELECT doc_id, start::int AS start, substring(text, start::int + 1, 300) AS piece FROM s")
def w27(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(t.overlapping_chunks(F.col("text"), 300, 50)).alias("c"))
    return d.select("doc_id", "c.start", F.col("c.text").alias("piece"))


@query("X07_sanitised", rf"""SELECT conv_id, turn, {_CLEAN.format(x="'[2024-01-01 10:00 UTC] ' || text")} AS text FROM conversations""")
def x07(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.sanitised(F.concat(F.lit("[2024-01-01 10:00 UTC] "), "text")).alias("text"))
