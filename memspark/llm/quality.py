"""Quality rules whose cutoffs come from the data.

Each text is measured by built-in functions. Measures go into quantile
sketches: log-linear histograms of whole numbers, 128 steps an octave, so a
quantile is off by less than 1 %. Sketches merge by adding counts, in any order,
so a hot source is summed where it is read. Cutoffs are quartile fences per
language and source; small groups merge up to their language, then to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from memspark.llm.graph import met
from memspark.llm.shared import written

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Ratios in parts of 10,000 (word length in hundredths) with the least spread a fence counts with.
SPREAD = {"symbol_rate": 100, "dup_line_rate": 1000, "upper_rate": 500, "word_length": 100, "repeat_rate": 500}
#: Fences lie so many spreads outside the quartiles.
REACH = 3
#: Documents from which a group has cutoffs of its own.
ENOUGH = 200
#: Groups up to which the cutoffs (some 100 bytes each) are broadcast.
BROADCAST_GROUPS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside a window of WINDOW words that the text has twice or more. Windows are compared by 64-bit hashes of their words' hashes."""

    def windows(hashes: Column) -> Column:
        return F.transform(F.slice(hashes, 1, F.size(hashes) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, WINDOW))))

    def places(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, j: F.coalesce(p["h"] == F.get(pairs, j - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get(pairs, j + 1)["h"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(pairs, lambda p: _let(places(p), covered)))

    return F.when(F.size(words) <= WINDOW, 0).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: _let(windows(hashes), counted)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a struct ``measures`` of COUNTS."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.split(F.btrim(body, F.lit(BLANKS)), BLANK)
    words = F.filter(words, lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    by_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    by_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    flat = F.struct(
        by_words.alias("w"),
        by_lines.alias("l"),
        F.regexp_count(body, F.lit(SYMBOLS)).alias("n_symbols"),
        (F.length(body) - F.length(F.regexp_replace(body, "[A-Z]+", ""))).alias("n_upper"),
    )
    of = {"n_words": "w", "word_chars": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    return docs.withColumn("measures", _let(flat, lambda m: F.struct(*((m[of[c]][c] if c in of else m[c]).cast("long").alias(c) for c in COUNTS))))


def _rates(m: Column) -> dict[str, Column]:
    share = lambda part, whole, unit: F.coalesce(F.floor(part * unit / F.nullif(whole, F.lit(0))).cast("long"), F.lit(0))
    return {
        "symbol_rate": share(m["n_symbols"], m["word_chars"], 10_000),
        "dup_line_rate": share(m["n_dup_lines"], m["n_lines"], 10_000),
        "upper_rate": share(m["n_upper"], m["word_chars"], 10_000),
        "word_length": share(m["word_chars"], m["n_words"], 100),
        "repeat_rate": share(m["n_repeat_words"], m["n_words"], 10_000),
    }


def _base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n of the measured rows that pass the base rules. The union of two results, summed, is the sketch of all their rows."""
    rates = F.array(*(F.struct(F.lit(k).alias("rate"), v.alias("x")) for k, v in _rates(F.col("measures")).items()))
    each = rows.where(~_base_failed(F.col("measures"))).select("lang", "source", F.explode(rates).alias("r"))
    buckets = each.select("lang", "source", "r.rate", "r.x").select("lang", "source", "rate", F.expr("shiftleft(shiftright(x, greatest(length(bin(x)) - 8, 0)), greatest(length(bin(x)) - 8, 0))").alias("bucket"))
    return buckets.groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def cutoffs(sketch: DataFrame) -> DataFrame:
    """For each lang and source of the sketch, the fences of each rate: <rate>_low and <rate>_high."""
    none = F.lit(None).cast("string")
    levels = [sketch.groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n")).withColumn("level", F.lit(0))]
    levels.append(sketch.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n")).select("lang", none.alias("source"), "rate", "bucket", "n", F.lit(1).alias("level")))
    levels.append(sketch.groupBy("rate", "bucket").agg(F.sum("n").alias("n")).select(none.alias("lang"), none.alias("source"), "rate", "bucket", "n", F.lit(2).alias("level")))
    every = levels[0].unionByName(levels[1]).unionByName(levels[2])
    group = Window.partitionBy("level", "lang", "source", "rate")
    ranked = every.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    spread = F.create_map(*(F.lit(x) for kv in SPREAD.items() for x in kv))
    quartiles = ranked.groupBy("level", "lang", "source", "rate").agg(
        F.max("total").alias("total"),
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
    )
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("rate")])
    wide = quartiles.groupBy("level", "lang", "source").agg(
        F.max("total").alias("total"),
        *(F.max(F.when(F.col("rate") == k, F.col("q1") - reach)).alias(f"{k}_low") for k in SPREAD),
        *(F.max(F.when(F.col("rate") == k, F.col("q3") + reach)).alias(f"{k}_high") for k in SPREAD),
    )
    fences = [f"{k}_{side}" for k in SPREAD for side in ("low", "high")]
    pick = lambda level: F.struct("total", *fences)
    own = wide.where("level = 0").select("lang", "source", pick(0).alias("own"))
    by_lang = wide.where("level = 1").select(F.col("lang").alias("lang1"), pick(1).alias("by_lang"))
    whole = wide.where("level = 2").select(pick(2).alias("whole"))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("lang1"))).join(F.broadcast(whole))  # one row
    chosen = F.when(F.col("own.total") >= ENOUGH, F.col("own")).when(F.col("by_lang.total") >= ENOUGH, F.col("by_lang")).otherwise(F.col("whole"))
    return joined.select("lang", "source", chosen.alias("c")).select(F.col("lang").alias("cut_lang"), F.col("source").alias("cut_source"), *(F.col(f"c.{f}").alias(f) for f in fences))


def judged(rows: DataFrame) -> DataFrame:
    """Measured rows, read twice, with base_failed and kept."""
    cuts = written(cutoffs(written(sketches(rows), "quality-sketch")), "quality-cutoffs")
    m = F.col("measures")
    inside = F.lit(True)
    for rate, value in _rates(m).items():
        inside = inside & (value <= F.col(f"{rate}_high")) & (value >= F.col(f"{rate}_low"))
    if cuts.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(cuts), F.col("lang").eqNullSafe(F.col("cut_lang")) & F.col("source").eqNullSafe(F.col("cut_source")), "left")
    else:
        # rows of large groups stay where they are; the others meet their cutoffs by a shuffle
        keyed = rows.withColumn("_group", F.to_json(F.struct("lang", "source")))
        sizes = keyed.groupBy("_group").agg(F.count("*").alias("n"))
        named = cuts.withColumn("_group", F.to_json(F.struct(F.col("cut_lang").alias("lang"), F.col("cut_source").alias("source")))).drop("cut_lang", "cut_source")
        table = written(sizes.join(named, "_group", "left"), "quality-groups")
        joined = met(keyed, table, "_group", table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "left")
    kept = ~_base_failed(m) & F.coalesce(inside, F.lit(False))
    return joined.select(*rows.columns, _base_failed(m).alias("base_failed"), kept.alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row.

    A null text has no words and fails. Null languages and sources are groups
    of their own. Repeated rows count as often as they occur and get the same
    verdict. Columns beyond doc_id, text, lang and source are not read. An
    empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    rows = written(measured(docs).drop("text"), "quality-measures")
    counts = [F.col(f"measures.{c}").alias(c) for c in COUNTS]
    return judged(rows).select("doc_id", *counts[:5], "base_failed", "kept")


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents kept, with their own columns. Texts are measured once and written beside their measures.

    Null and empty texts have no words and go; very long ones are measured
    whole; rows that repeat are judged alike and all stay or go; null languages
    and sources are groups of their own; columns of any name stay; an empty
    table gives no rows.
    """
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    at = docs.columns.index("text")
    rows = written(measured(own.drop(f"c{at}")), "quality-measures")
    back = [F.col("text").cast(docs.schema[at].dataType).alias("text") if k == at else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return judged(rows).where("kept").select(*back)


def op3_adaptive_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rates = ", ".join(f"('{k}', {v})" for k, v in {"symbol_rate": "coalesce(n_symbols * 10000 // nullif(word_chars, 0), 0)", "dup_line_rate": "coalesce(n_dup_lines * 10000 // nullif(n_lines, 0), 0)", "upper_rate": "coalesce(n_upper * 10000 // nullif(word_chars, 0), 0)", "word_length": "coalesce(word_chars * 100 // nullif(n_words, 0), 0)", "repeat_rate": "coalesce(n_repeat_words * 10000 // nullif(n_words, 0), 0)"}.items())
    spread = ", ".join(f"('{k}', {v})" for k, v in SPREAD.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o END AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM g),
r AS (SELECT doc_id, i, max(again::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM c),
n AS (SELECT doc_id, count(*) AS n_words, sum(inside)::bigint AS n_repeat_words FROM r GROUP BY doc_id),
k AS (SELECT doc_id, sum(length(w))::bigint AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
x AS (SELECT doc_id, lang, source, base_failed, rate, x FROM b, LATERAL (VALUES {rates}) v(rate, x)),
h AS (SELECT lang, source, rate, (x >> greatest(length(bin(x)) - 8, 0)) << greatest(length(bin(x)) - 8, 0) AS bucket FROM x WHERE NOT base_failed),
e AS (SELECT 0 AS level, lang, source, rate, bucket, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT 1, lang, NULL, rate, bucket, count(*) FROM h GROUP BY lang, rate, bucket UNION ALL SELECT 2, NULL, NULL, rate, bucket, count(*) FROM h GROUP BY rate, bucket),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM e),
q AS (SELECT level, lang, source, rate, max(total) AS total, min(bucket) FILTER (4 * upto >= total) AS q1, min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM u GROUP BY ALL),
f AS (SELECT q.*, q1 - {REACH} * greatest(q3 - q1, s.s) AS low, q3 + {REACH} * greatest(q3 - q1, s.s) AS high FROM q JOIN (VALUES {spread}) s(rate, s) USING (rate)),
z AS (SELECT a.lang, a.source, a.rate, CASE WHEN a.total >= {ENOUGH} THEN a.low WHEN l.total >= {ENOUGH} THEN l.low ELSE o.low END AS low, CASE WHEN a.total >= {ENOUGH} THEN a.high WHEN l.total >= {ENOUGH} THEN l.high ELSE o.high END AS high
  FROM f a JOIN f l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM a.lang AND l.rate = a.rate JOIN f o ON o.level = 2 AND o.rate = a.rate WHERE a.level = 0),
v AS (SELECT doc_id, bool_and(coalesce(x BETWEEN low AND high, false)) AS inside FROM x LEFT JOIN z ON z.lang IS NOT DISTINCT FROM x.lang AND z.source IS NOT DISTINCT FROM x.source AND z.rate = x.rate GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM b JOIN v USING (doc_id)
"""


SQL = _sql()
