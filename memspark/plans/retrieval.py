"""Queries on recall, fusion, ranking and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import text as t
from memspark.operators import cells, fuse, postings, recall, rerank
from memspark.plans.registry import query
from memspark.sources.scratch import written
from memspark.sources.tables import EPOCH, STEP, UNITS_SQL, engine_units, table, units

WORDS = ["the", "heat", "ing", "license", "eau", "the"]
_SET = "['" + "', '".join(sorted(set(WORDS))) + "']"
_TOK = "regexp_extract_all(lower(content), '[0-9a-z]+|[\\x{4e00}-\\x{9fff}]')"
TOKENS_SQL = f"{UNITS_SQL}, tk AS (SELECT unit_id, {_TOK} AS toks FROM units)"
KEYWORD_SQL = f"{TOKENS_SQL}, kw AS (SELECT unit_id, CASE WHEN len(toks) = 0 THEN 0 ELSE len(list_filter(toks, lambda x: list_contains({_SET}, x))) / len(toks) END AS score FROM tk)"


def _idf(i: int) -> str:
    return f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5))"


_Q = sorted(set(WORDS))
_TF = ", ".join(f"len(list_filter(toks, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(_Q))
_SCORE = " + ".join(f"{WORDS.count(w)} * CASE WHEN tf{i} > 0 THEN {_idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i, w in enumerate(_Q))
BM25_SQL = f"{KEYWORD_SQL}, tf AS (SELECT unit_id, len(toks) AS dl, {_TF} FROM tk), st AS (SELECT count(*) AS n, coalesce(nullif(avg(dl), 0), 1) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(_Q)))} FROM tf), bm AS (SELECT unit_id, {_SCORE} AS score FROM tf, st)"
CHANNELS_SQL = f"{BM25_SQL}, hits AS (SELECT unit_id, 'keyword' AS channel, score FROM (SELECT * FROM kw WHERE score > 0 ORDER BY round(score, 12) DESC, unit_id LIMIT 100) UNION ALL SELECT unit_id, 'bm25', score FROM (SELECT * FROM bm WHERE score > 0 ORDER BY round(score, 12) DESC, unit_id LIMIT 100))"
RANKED_SQL = f"{CHANNELS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY round(score, 12) DESC, unit_id) - 1 AS rank, max(score) OVER (PARTITION BY channel) AS top FROM hits)"


def _best(hits, k):
    return hits.withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), "unit_id").limit(k)


_indexes: dict[tuple, postings.TextIndex] = {}


def indexed(spark, sf_dir) -> postings.TextIndex:
    """The full-text index of a folder's units: written once, and again when the files that it was made from change."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted(f for name in ("documents", "labels") for f in spark.read.parquet(f"{sf_dir}/{name}.parquet").inputFiles())
    seen = []
    for f in files:
        path = hadoop.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append((f, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, sf_dir, *seen)
    if key in _indexes:
        path = hadoop.Path(f"{_indexes[key].path}/sums")
        if path.getFileSystem(conf).exists(path):
            return _indexes[key]
    size = postings.text_bytes(table(spark, sf_dir, "documents"), "text")
    _indexes[key] = postings.build(engine_units(spark, sf_dir, postings.shares(spark, size), few=True), ("space", "user_id"), size=size)
    return _indexes[key]


def channels(spark, sf_dir, words=None):
    """The best hits of both lexical channels, from the index."""
    words, index = words or WORDS, indexed(spark, sf_dir)
    return index.top(words, 100, "keyword")[0].unionByName(index.top(words, 100, "bm25")[0])


def _r(df, *cols, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in ("score", "raw", "contribution", "value") else F.col(c) for c in cols))


@query("A04_keyword_overlap", f"WITH {KEYWORD_SQL} SELECT unit_id, round(score, 9) AS score FROM kw WHERE score > 0")
def a04(spark, sf_dir):
    return _r(indexed(spark, sf_dir).keyword(WORDS), "unit_id", "score", digits=9)


@query("A03_bm25", f"WITH {BM25_SQL} SELECT unit_id, round(score, 6) AS score FROM bm WHERE score > 0")
def a03(spark, sf_dir):
    return _r(indexed(spark, sf_dir).bm25(WORDS), "unit_id", "score")


@query("S19_J04_postings", f"WITH {TOKENS_SQL} SELECT term, count(*) AS df, sum(tf)::bigint AS tf FROM (SELECT unit_id, term, count(*) AS tf FROM (SELECT unit_id, unnest(toks) AS term FROM tk) GROUP BY ALL) GROUP BY term")
def s19(spark, sf_dir):
    return indexed(spark, sf_dir).terms().select("term", "df", "tf")


@query("A03_top_of_blocks", f"WITH {BM25_SQL} SELECT unit_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, unit_id) - 1 AS position FROM bm WHERE score > 0 ORDER BY position LIMIT 20")
def a03_top(spark, sf_dir):
    from pyspark.sql import Window

    hits, _ = indexed(spark, sf_dir).top(WORDS, 20)
    return hits.select("unit_id", F.round("score", 6).alias("score"), (F.row_number().over(Window.orderBy(F.desc("score"), "unit_id")) - 1).cast("long").alias("position"))


_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings)"
_COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"


@query("J02_exact_knn", f"WITH {_VEC}, q AS (SELECT * FROM v WHERE vec_id % 50 = 0), c AS (SELECT b.vec_id AS query_id, a.vec_id AS unit_id, round({_COS}, 12) AS score FROM v a, q b), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id::varchar) - 1 AS rank FROM c WHERE score > 0) SELECT query_id::varchar AS query_id, unit_id::varchar AS unit_id, round(score, 6) AS score, rank::int AS rank FROM k WHERE rank < 10")
def j02(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    rows = v.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))  # the query set
    return _r(recall.knn(rows, asked, 10), "query_id", "unit_id", "score", "rank")


def vector_index(spark, sf_dir) -> cells.CellIndex:
    v = table(spark, sf_dir, "embeddings")
    return cells.build(v.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"), "label"))


@query("S18_J05_vector_index", f"WITH {_VEC}, q AS (SELECT * FROM v WHERE vec_id % 50 = 0), c AS (SELECT b.vec_id AS query_id, a.vec_id AS unit_id, round({_COS}, 12) AS score FROM v a, q b WHERE a.label < 5), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id::varchar) - 1 AS rank FROM c WHERE score > 0) SELECT query_id::varchar AS query_id, unit_id::varchar AS unit_id, round(score, 6) AS score, rank::int AS rank FROM k WHERE rank < 10")
def j05(spark, sf_dir):
    """All cells, the filter within them."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))  # the query set
    return _r(vector_index(spark, sf_dir).search(asked, 10, keep=F.col("label") < 5), "query_id", "unit_id", "score", "rank")


@query("J05_probed_cells")
def j05_probed(spark, sf_dir):
    """The nearest two thirds of the cells: hits by query, whose share of the exact ones is measured in the tests."""
    index = vector_index(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))  # the query set
    return _r(index.search(asked, 10, probes=-(-2 * len(index.centres) // 3)), "query_id", "unit_id", "score", "rank")


_QV = [((i * 7) % 13 - 6) / 10 for i in range(64)]


@query("P19_vector_min_similarity", f"WITH {_VEC}, b AS (SELECT {_QV}::double[] AS e) SELECT a.vec_id::varchar AS unit_id, round({_COS}, 6) AS score FROM v a, b WHERE {_COS} > 0.1")
def p19(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("unit_id"), F.col("embedding").alias("vector"))
    return _r(recall.vector(v, _QV, least=0.1), "unit_id", "score")


@query("X18_X19_distance_normalise", f"WITH {_VEC}, b AS (SELECT {_QV}::double[] AS e) SELECT a.vec_id, round(-list_distance(a.e, b.e), 6) AS l2, round(list_sum(list_transform(a.e, lambda x: x / sqrt(list_dot_product(a.e, a.e)))), 6) AS total FROM v a, b")
def x18(spark, sf_dir):
    q = F.array(*map(F.lit, _QV))
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(t.l2_score(F.col("embedding"), q), 6).alias("l2"), F.round(F.aggregate(t.normalised(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("A05_W01_rrf", f"WITH {RANKED_SQL} SELECT unit_id, round(sum(1.0 / (61 + rank)), 9) AS score, count(*) AS n FROM r GROUP BY unit_id")
def a05(spark, sf_dir):
    return fuse.rrf(channels(spark, sf_dir)).select("unit_id", F.round("score", 9).alias("score"), F.size("evidence").cast("long").alias("n"))


@query("A06_weighted_rrf", f"WITH {RANKED_SQL} SELECT unit_id, round(sum(CASE channel WHEN 'bm25' THEN 2.0 ELSE 0.5 END / (61 + rank)), 9) AS score FROM r GROUP BY unit_id")
def a06(spark, sf_dir):
    return _r(fuse.rrf(channels(spark, sf_dir), weights={"bm25": 2.0, "keyword": 0.5}), "unit_id", "score", digits=9)


@query("A11_A12_A13_rrf_from_one", f"WITH {RANKED_SQL} SELECT unit_id, round(sum(1.0 / (61 + rank)), 9) AS score, array_to_string(list_sort(list(DISTINCT channel)), ',') AS channels FROM r GROUP BY unit_id")
def a11(spark, sf_dir):
    f = fuse.rrf(channels(spark, sf_dir), first_rank=1)
    return f.select("unit_id", F.round("score", 9).alias("score"), F.array_join(F.array_sort(F.transform("evidence", lambda e: e["channel"])), ",").alias("channels"))


@query("A07_W02_comb_max", f"WITH {RANKED_SQL} SELECT unit_id, round(max(score / top), 9) AS score FROM r GROUP BY unit_id")
def a07(spark, sf_dir):
    return _r(fuse.comb_max(channels(spark, sf_dir)), "unit_id", "score", digits=9)


@query("A10_comb_max_bm25", f"WITH {RANKED_SQL}, c AS (SELECT unit_id, max(score / top * CASE channel WHEN 'keyword' THEN 0.6 ELSE 0.1 END) AS s FROM r GROUP BY unit_id), x AS (SELECT c.unit_id, s, bm.score AS b, max(bm.score) OVER () AS m FROM c LEFT JOIN bm ON c.unit_id = bm.unit_id AND bm.score > 0) SELECT unit_id, round(greatest(s, coalesce(b / m, 0)), 6) AS score FROM x")
def a10(spark, sf_dir):
    lex = indexed(spark, sf_dir).bm25(WORDS)
    return _r(fuse.comb_max_bm25(channels(spark, sf_dir), lex, {"keyword": 0.6, "bm25": 0.1}), "unit_id", "score")


@query("A01_A02_max_rollup", f"WITH {RANKED_SQL} SELECT space, round(max(score / top), 6) AS score, count(*) AS n FROM r JOIN units USING (unit_id) GROUP BY space")
def a01(spark, sf_dir):
    h = fuse.comb_max(channels(spark, sf_dir))
    both = fuse.merge_layers(channels(spark, sf_dir)).join(units(spark, sf_dir).select("unit_id", "space"), "unit_id").groupBy("space").agg(F.count("*").alias("n"))
    top = h.join(units(spark, sf_dir).select("unit_id", "space"), "unit_id").groupBy("space").agg(F.round(F.max("score"), 6).alias("score"))
    return top.join(both, "space")


_EMB = "CASE WHEN len(toks) = 0 THEN 0 ELSE len(list_filter(toks, lambda x: list_contains(['the', 'ing'], x))) / len(toks) END"


@query("A08_fusion_mix", f"WITH {TOKENS_SQL}, {_VEC}, b AS (SELECT {_QV}::double[] AS e), s AS (SELECT unit_id, 0.7 * {_COS} + 0.3 * {_EMB} AS score FROM tk JOIN v a ON 'd' || a.vec_id = unit_id, b) SELECT unit_id, round(score, 6) AS score FROM s WHERE score > 0")
def a08(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    return _r(recall.fusion_mix(units(spark, sf_dir).join(v, "unit_id"), F.col("vector"), _QV, ["the", "ing"], 0.7), "unit_id", "score")


_LINKS = f"{KEYWORD_SQL}, ent AS (SELECT DISTINCT unit_id, e FROM (SELECT unit_id, unnest(toks) AS e FROM tk) WHERE length(e) >= 3 AND regexp_full_match(e, '[\\x00-\\x7f]+')), seeds AS (SELECT unit_id, score FROM kw WHERE score > 0 ORDER BY round(score, 12) DESC, unit_id LIMIT 10)"


@query("A09_J06_entity_expansion", f"WITH {_LINKS}, df AS (SELECT e, count(*) AS df FROM ent GROUP BY e), want AS (SELECT DISTINCT e FROM ent SEMI JOIN seeds USING (unit_id)), raw AS (SELECT unit_id, sum(1 / ln(1 + df)) AS raw FROM ent JOIN df USING (e) WHERE e IN (SELECT e FROM want) AND unit_id NOT IN (SELECT unit_id FROM seeds) GROUP BY unit_id), c AS (SELECT * FROM raw ORDER BY round(raw, 9) DESC, unit_id LIMIT 20), a AS (SELECT count(*) AS n, max(score) AS top, median(score) AS mid FROM seeds) SELECT unit_id, round(least(raw, top / CASE WHEN n < 3 THEN top * 0.5 ELSE mid END) * CASE WHEN n < 3 THEN top * 0.5 ELSE mid END, 6) AS score FROM c, a")
def a09(spark, sf_dir):
    u = units(spark, sf_dir)
    seeds = written(_best(recall.keyword(u, WORDS), 10), "seeds")
    return _r(recall.expand_entities(seeds, recall.entity_links(u), seeds, seeds), "unit_id", "score")


@query("S24_entity_links", f"WITH {_LINKS} SELECT sha256(e) AS entity_hash, count(*) AS n FROM ent GROUP BY e")
def s24(spark, sf_dir):
    return recall.unit_entities(units(spark, sf_dir)).groupBy("entity_hash").agg(F.count("*").alias("n"))


@query("L01_top_k", f"WITH {KEYWORD_SQL} SELECT unit_id, round(score, 9) AS score FROM kw WHERE score > 0 ORDER BY round(score, 12) DESC, unit_id LIMIT 10")
def l01(spark, sf_dir):
    return _r(_best(recall.keyword(units(spark, sf_dir), WORDS), 10), "unit_id", "score", digits=9)


@query("L04_threshold", f"WITH {KEYWORD_SQL}, p AS (SELECT *, max(score) OVER () AS top, row_number() OVER (ORDER BY score DESC, unit_id) AS r FROM kw WHERE score > 0) SELECT unit_id FROM p WHERE (score >= top * 0.5 AND score >= 0.2) OR r <= 5")
def l04(spark, sf_dir):
    return fuse.threshold(recall.keyword(units(spark, sf_dir), WORDS), 0.5, 0.2, 5).select("unit_id")


@query("L05_list_order", f"WITH {UNITS_SQL} SELECT unit_id, t_event FROM units ORDER BY coalesce(t_event, -9223372036854775808) DESC, unit_id DESC LIMIT 25 OFFSET 5")
def l05(spark, sf_dir):
    return units(spark, sf_dir).orderBy(F.coalesce("t_event", F.lit(-(2**63))).desc(), F.desc("unit_id")).offset(5).limit(25).select("unit_id", "t_event")


@query("L06_scatter_gather", f"WITH {KEYWORD_SQL} SELECT unit_id, round(score, 9) AS score FROM kw WHERE score > 0 ORDER BY round(score, 12) DESC, unit_id LIMIT 30")
def l06(spark, sf_dir):
    u = units(spark, sf_dir)
    shards = [_best(recall.keyword(u.where(F.col("user_id") == x), WORDS), 30).select("unit_id", "score") for x in ("en", "de", "fr", "es")]
    rest = _best(recall.keyword(u.where(~F.col("user_id").isin("en", "de", "fr", "es")), WORDS), 30).select("unit_id", "score")
    return _r(fuse.scatter_merge([*shards, rest], "unit_id", 30), "unit_id", "score", digits=9)


@query("L07_oldest_first", f"WITH {UNITS_SQL} SELECT unit_id FROM units WHERE tier = 'working' ORDER BY t_ingest, unit_id LIMIT 40")
def l07(spark, sf_dir):
    return units(spark, sf_dir).where("tier = 'working'").orderBy("t_ingest", "unit_id").limit(40).select("unit_id")


@query("L09_secondary_score", f"WITH {UNITS_SQL} SELECT unit_id, round(0.5 * coalesce(importance, 0.5) + CASE WHEN t_event IS NULL THEN 0 ELSE 0.5 / (1 + greatest(0, (({EPOCH} + 3000 * {STEP}::bigint) - t_event) / 86400000.0) / 30) END, 6) AS score FROM units")
def l09(spark, sf_dir):
    age = (F.lit(EPOCH + 3_000 * STEP) - F.col("t_event")) / 86_400_000.0
    return units(spark, sf_dir).select("unit_id", F.round(t.secondary(F.coalesce("importance", F.lit(0.5)), age), 6).alias("score"))


@query("L12_P06_rerank", f"WITH {KEYWORD_SQL}, p AS (SELECT unit_id, row_number() OVER (ORDER BY round(score, 12) DESC, unit_id) - 1 AS prev FROM kw WHERE score > 0 ORDER BY prev LIMIT 60), s AS (SELECT unit_id, prev, len(list_filter(['the', 'ing', 'heat'], lambda x: list_contains(toks, x))) / (len(toks) + 1) AS score FROM p JOIN tk USING (unit_id)) SELECT unit_id, round(score, 9) AS score, (row_number() OVER (ORDER BY round(score, 12) DESC, prev) - 1)::int AS position FROM s")
def l12(spark, sf_dir):
    from pyspark.sql import Window

    u = units(spark, sf_dir)
    pool = _best(recall.keyword(u, WORDS), recall.RERANK_BUDGET).withColumn("prev", F.row_number().over(Window.orderBy(F.desc("score"), "unit_id")))
    s = pool.drop("score").join(u.select("unit_id", "content"), "unit_id").withColumn("score", F.round(t.rerank_overlap(t.tokens(F.col("content")), ["the", "ing", "heat"]), 12))
    w = Window.orderBy(F.desc("score"), "prev")
    return s.select("unit_id", F.round("score", 9).alias("score"), (F.row_number().over(w) - 1).alias("position"))


@query("J01_materialise_missing", "SELECT 'd' || l.doc_id AS unit_id, d.doc_id IS NULL AS missing FROM (SELECT DISTINCT vec_id AS doc_id FROM embeddings) l LEFT JOIN documents d USING (doc_id)")
def j01(spark, sf_dir):
    hits = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), "vec_id").alias("unit_id")).distinct()
    u = units(spark, sf_dir).select("unit_id", F.lit(True).alias("found"))
    return hits.join(u, "unit_id", "left").select("unit_id", F.col("found").isNull().alias("missing"))


_EDGES = "e AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def edges(spark, sf_dir):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c, s, n = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation"))
    return c.select(tag("c", "c_custkey").alias("a"), tag("n", "c_nationkey").alias("b")).unionByName(s.select(tag("s", "s_suppkey").alias("a"), tag("n", "s_nationkey").alias("b"))).unionByName(n.select(tag("n", "n_nationkey").alias("a"), tag("r", "n_regionkey").alias("b")))


@query("J07_J08_bfs", f"WITH {_EDGES}, h0 AS (SELECT 's1' AS node), h1 AS (SELECT DISTINCT b AS node FROM u JOIN h0 ON a = node), h2 AS (SELECT DISTINCT b AS node FROM u JOIN h1 ON a = node), h3 AS (SELECT DISTINCT b AS node FROM u JOIN h2 ON a = node), x AS (SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3) SELECT node, min(hop)::int AS hop FROM x GROUP BY node")
def j08(spark, sf_dir):
    return recall.bfs(edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), 3)


@query("J09_neighbour_decay", f"WITH {_EDGES}, s AS (SELECT * FROM (VALUES ('s1', 1.0::double), ('n3', 0.4::double)) s(node, score)), h1 AS (SELECT b AS node, max(score * 0.5) AS score FROM u JOIN s ON a = node GROUP BY b), h2 AS (SELECT b AS node, max(score * 0.5) AS score FROM u JOIN h1 ON a = node GROUP BY b), x AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2) SELECT node, max(score) AS score FROM x WHERE node NOT IN (SELECT node FROM s) GROUP BY node UNION ALL SELECT * FROM s")
def j09(spark, sf_dir):
    return recall.neighbours(edges(spark, sf_dir), spark.createDataFrame([("s1", 1.0), ("n3", 0.4)], "node string, score double"), 2, 0.5)


@query("J10_incident_edges", f"WITH {_EDGES} SELECT DISTINCT a, b FROM e WHERE a IN ('n1', 'n2') OR b IN ('n1', 'n2')")
def j10(spark, sf_dir):
    return recall.incident(edges(spark, sf_dir), spark.createDataFrame([("n1",), ("n2",)], "node string")).select("a", "b")


_PT = "pt AS (SELECT p_partkey::varchar AS unit_id, p_brand, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' size' || p_size), '[0-9a-z]+'))) AS tok FROM part)"


def _part_units(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("unit_id"), "p_brand", F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("size"), "p_size")).alias("content"))


@query("J11_keyword_association", f"WITH {_PT} SELECT a.unit_id AS a, b.unit_id AS b, count(*)::int AS common FROM pt a JOIN pt b ON a.p_brand = b.p_brand AND a.tok = b.tok AND a.unit_id < b.unit_id GROUP BY 1, 2 HAVING count(*) >= 3")
def j11(spark, sf_dir):
    return recall.token_pairs(_part_units(spark, sf_dir), t.tokens(F.col("content")), 3, ["p_brand"])


@query("J14_jaccard_pairs", f"WITH {_PT}, n AS (SELECT unit_id, count(*) AS n FROM pt GROUP BY unit_id), c AS (SELECT a.unit_id AS a, b.unit_id AS b, count(*) AS common FROM pt a JOIN pt b ON a.p_brand = b.p_brand AND a.tok = b.tok AND a.unit_id < b.unit_id GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a, b, round(common / (x.n + y.n - common), 6) AS score FROM c JOIN n x ON x.unit_id = a JOIN n y ON y.unit_id = b WHERE common / (x.n + y.n - common) >= 0.6")
def j14(spark, sf_dir):
    return recall.token_pairs(_part_units(spark, sf_dir), t.tokens(F.col("content")), 3, ["p_brand"], share=0.6).withColumn("score", F.round("score", 6))


SEARCH_SQL = f"WITH {RANKED_SQL}, f AS (SELECT unit_id, sum(1.0 / (61 + rank)) AS score FROM r GROUP BY unit_id), g AS (SELECT f.unit_id, score, lifecycle, tier, content FROM f JOIN units u ON u.unit_id = f.unit_id WHERE lifecycle = 'active' AND tier <> 'working'), h AS (SELECT *, max(score) OVER () AS top FROM g) SELECT unit_id, round(score, 9) AS score, tier, left(content, 120) AS snippet FROM h WHERE score >= top * 0.2 ORDER BY round(score, 12) DESC, unit_id LIMIT 10"


def search(spark, sf_dir, words=None, k=10):
    """Recall by keyword and BM25, fuse by RRF, re-check the truth record, cut by threshold and disclose an excerpt."""
    index = indexed(spark, sf_dir)
    hits = channels(spark, sf_dir, words)
    truth = index.texts().where((F.col("lifecycle") == "active") & (F.col("tier") != "working")).select("unit_id", "tier", "place")
    # at most two channels' best 100: the units stay where they are
    found = truth.join(F.broadcast(fuse.rrf(hits).select("unit_id", "score")), "unit_id")
    cut = written(fuse.threshold(found, 0.2).orderBy(F.desc(F.round("score", 12)), "unit_id").limit(k), "search-hits")
    shown = index.contents([r.place for r in cut.select("place").collect()]).select("place", F.substring("content", 1, 120).alias("snippet"))  # k rows
    return shown.join(F.broadcast(cut), "place").orderBy(F.desc(F.round("score", 12)), "unit_id").select("unit_id", F.round("score", 9).alias("score"), "tier", "snippet")


@query("G02_search", SEARCH_SQL)
def g02(spark, sf_dir):
    return search(spark, sf_dir)


@query("W26_fixed_disclosure", f"WITH {KEYWORD_SQL}, p AS (SELECT unit_id, score FROM kw WHERE score > 0 ORDER BY round(score, 12) DESC, unit_id LIMIT 100), c AS (SELECT p.unit_id, score, (CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, (length(content) + 3) // 4) END)::bigint AS cost FROM p JOIN units u ON u.unit_id = p.unit_id), s AS (SELECT *, sum(cost) OVER (ORDER BY round(score, 12) DESC, unit_id ROWS UNBOUNDED PRECEDING)::bigint AS spent FROM c) SELECT unit_id, cost, spent FROM s WHERE spent <= 4000")
def w26(spark, sf_dir):
    u = units(spark, sf_dir)
    pool = _best(recall.keyword(u, WORDS), 100).join(u.select("unit_id", "content"), "unit_id")
    return fuse.fixed_disclosure(pool, "content", 4000, [F.desc("score"), F.asc("unit_id")]).select("unit_id", "cost", "spent")


def _pool(spark, sf_dir):
    u = units(spark, sf_dir)
    pool = _best(recall.keyword(u, WORDS), 60).join(u, "unit_id")
    return pool.withColumn("query_id", F.lit("q")).withColumn("secondary", F.coalesce("importance", F.lit(0.5)))


_COST = lambda x: f"greatest(1, (length({x}) + 3) // 4)"
_FITS = f"CASE WHEN content <> '' AND {_COST('content')} <= left_ THEN 'l2' WHEN content <> '' AND {_COST('left(content, 200)')} <= left_ THEN 'l1' WHEN content <> '' AND {_COST('left(content, 40)')} <= left_ THEN 'l0' END"
_TAKES = f"CASE WHEN content <> '' AND {_COST('content')} <= left_ THEN {_COST('content')} WHEN content <> '' AND {_COST('left(content, 200)')} <= left_ THEN {_COST('left(content, 200)')} WHEN content <> '' AND {_COST('left(content, 40)')} <= left_ THEN {_COST('left(content, 40)')} END"


@query("P05_adaptive_disclosure", f"WITH RECURSIVE {KEYWORD_SQL}, p AS (SELECT k.unit_id, content, row_number() OVER (ORDER BY round(score, 12) DESC, k.unit_id) AS i FROM kw k JOIN units u ON u.unit_id = k.unit_id WHERE score > 0 ORDER BY i LIMIT 60), f AS (SELECT 0::bigint AS i, NULL::varchar AS unit_id, NULL::varchar AS level, NULL::bigint AS cost, 3000::bigint AS left_ UNION ALL SELECT p.i, p.unit_id, {_FITS}, {_TAKES}, left_ - {_TAKES} FROM f JOIN p ON p.i = f.i + 1 WHERE left_ IS NOT NULL) SELECT 'q' AS query_id, unit_id, level, cost FROM f WHERE level IS NOT NULL")
def p05(spark, sf_dir):
    from pyspark.sql import Window

    p = _pool(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")))
    rows = p.select("query_id", "unit_id", "rank", F.col("content").alias("l2"), F.substring("content", 1, 200).alias("l1"), F.substring("content", 1, 40).alias("l0"))
    return fuse.adaptive_disclosure(rows, 3000)


@query("W22_score_bands", f"WITH RECURSIVE {KEYWORD_SQL}, p AS (SELECT k.unit_id, round(score, 12) AS score, coalesce(importance, 0.5) AS secondary, row_number() OVER (ORDER BY round(score, 12) DESC, k.unit_id) AS i FROM kw k JOIN units u ON u.unit_id = k.unit_id WHERE score > 0 ORDER BY i LIMIT 60), f AS (SELECT i, unit_id, secondary, score, score AS first, 0 AS band FROM p WHERE i = 1 UNION ALL SELECT p.i, p.unit_id, p.secondary, p.score, CASE WHEN p.score < f.first - 0.05 - 1e-9 THEN p.score ELSE f.first END, CASE WHEN p.score < f.first - 0.05 - 1e-9 THEN f.band + 1 ELSE f.band END FROM f JOIN p ON p.i = f.i + 1) SELECT unit_id, band::bigint AS band, row_number() OVER (ORDER BY band, secondary DESC, score DESC, unit_id) - 1 AS position FROM f")
def w22(spark, sf_dir):
    return fuse.banded(_pool(spark, sf_dir).select("query_id", "unit_id", "score", "secondary"), 0.05).drop("query_id")


@query("W24_P16_cross_space")
def w24(spark, sf_dir):
    from pyspark.sql import Window

    p = _pool(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "space").orderBy(F.desc("score"), "unit_id")))
    return fuse.round_robin(p.select("query_id", "unit_id", F.col("space").alias("priority"), "rank", t.content_hash(F.col("content")).alias("digest")), 5, 20).drop("query_id")


@query("W25_interleave", f"WITH {RANKED_SQL}, s AS (SELECT unit_id, rank, CASE channel WHEN 'keyword' THEN rank ELSE ceil((rank + 1) / 0.5) - 0.5 END AS slot FROM r) SELECT unit_id, row_number() OVER (ORDER BY slot, rank, unit_id) - 1 AS position FROM s")
def w25(spark, sf_dir):
    r = fuse.ranked(channels(spark, sf_dir))
    a = r.where("channel = 'keyword'").select("unit_id", "rank")
    b = r.where("channel = 'bm25'").select("unit_id", "rank")
    return fuse.interleaved(a, b, 0.5).select("unit_id", "position")


@query("A49_task_search", "WITH tk AS (SELECT conv_id || '/' || turn AS unit_id, regexp_extract_all(lower(text), '[0-9a-z]+|[\\x{4e00}-\\x{9fff}]') AS toks FROM conversations), tf AS (SELECT unit_id, len(toks) AS dl, len(list_filter(toks, lambda x: x = 'the')) AS a, len(list_filter(toks, lambda x: x = 'que')) AS b FROM tk), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf), s AS (SELECT unit_id, CASE WHEN a > 0 THEN ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END AS score FROM tf, st) SELECT unit_id, round(score, 6) AS score FROM s WHERE score > 0")
def a49(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("unit_id"), F.coalesce("text", F.lit("")).alias("content"))
    return _r(recall.bm25(c, ["que", "the"]), "unit_id", "score")


def labelled_hits(spark, sf_dir):
    """Labelled documents as hits of one query for each language, with their features and whether they are good."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null and lang is not null")
    own = rerank.hit_features(F.coalesce("text", F.lit("")), WORDS)
    return d.select(F.col("lang").alias("query_id"), "doc_id", F.col("quality").cast("int").alias("quality"), *(c.alias(n) for n, c in own.items()))


_FEATURES = ("length", "distinct", "symbols", "overlap")
_W = ", ".join(f"coalesce(sum(m * p_{f} - p * m_{f}) / nullif(sum(m * pp_{f} + p * mm_{f} - 2 * p_{f} * m_{f}), 0), 0) AS w_{f}" for f in _FEATURES)
_S = ", ".join(f"sum({f} * quality) AS p_{f}, sum({f} * (1 - quality)) AS m_{f}, sum({f} * {f} * quality) AS pp_{f}, sum({f} * {f} * (1 - quality)) AS mm_{f}" for f in _FEATURES)


@query("P07_learned_rerank", f"""WITH t AS (SELECT lang AS query_id, doc_id, quality::int AS quality, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+|[\\x{{4e00}}-\\x{{9fff}}]') AS toks FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL),
x AS (SELECT query_id, doc_id, quality, ln(1 + len(toks)) AS length, len(list_distinct(toks)) / greatest(len(toks), 1) AS "distinct", (length(text) - length(regexp_replace(text, '[#*$%&|<>!]', '', 'g'))) / greatest(length(text), 1) AS symbols, CASE WHEN len(toks) = 0 THEN 0 ELSE len(list_filter(toks, lambda x: list_contains({_SET}, x))) / len(toks) END AS overlap FROM t),
q AS (SELECT query_id, sum(quality) AS p, count(*) - sum(quality) AS m, {_S.replace('distinct ', '"distinct" ').replace('(distinct', '("distinct"')} FROM x WHERE doc_id % 2 = 1 GROUP BY query_id), w AS (SELECT {_W} FROM q),
s AS (SELECT query_id, doc_id, quality, w_length * length + w_distinct * "distinct" + w_symbols * symbols + w_overlap * overlap AS score FROM x, w WHERE doc_id % 2 = 0)
SELECT query_id, doc_id, quality, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20""")
def p07(spark, sf_dir):
    """Weights from the labelled hits of odd ids, the best 20 of each query among the others."""
    from pyspark.sql import Window

    rows = labelled_hits(spark, sf_dir)
    weights = rerank.fit(rows.where("doc_id % 2 = 1"), "query_id", F.col("quality"), list(_FEATURES))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    best = rerank.scored(rows.where("doc_id % 2 = 0"), weights).withColumn("_r", F.row_number().over(w)).where("_r <= 20")
    return best.select("query_id", "doc_id", "quality", F.round("score", 6).alias("score"))
