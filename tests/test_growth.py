"""Queries against their SQL on tables with what the small ones lack: odd words, copies, large groups."""

import duckdb
import pytest

from memspark.plans.catalogue import ORACLES, QUERIES
from tests.test_queries import rows


def same_as_sql(spark, folder, name, tables):
    """The query's rows over these tables, {name: DuckDB select}, are those of its SQL."""
    con = duckdb.connect()
    for table, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    r = con.execute(ORACLES[name])
    got, want = rows(df.columns, columns, df.collect()), rows([d[0] for d in r.description], columns, r.fetchall())
    assert got == want
    return got


@pytest.mark.parametrize("text", ["estèpa", "réno il", "no", "a_no", "İno", "ño", "NO."])
def test_negation_ends_at_ascii_word_bounds(spark, tmp_path, text):
    same_as_sql(spark, tmp_path, "X36_negation", {"conversations": f"SELECT 1 AS conv_id, 0 AS turn, '{text}' AS text"})


COPIES = "SELECT p.* REPLACE (p_partkey + 100000 * i AS p_partkey) FROM '/root/testdata/sf0.001/part.parquet' p, range({n}) r(i)"


@pytest.mark.parametrize("name", ["J11_keyword_association", "V03_V09_echo_and_pairs", "J14_jaccard_pairs"])
def test_pairs_of_copies_are_whole_and_never_shuffled(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr("memspark.operators.link.TOKEN_CHUNK", 16)  # blocks of many parts
    assert same_as_sql(spark, tmp_path, name, {"part": COPIES.format(n=9)})
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan.split("MapInArrow")[1]
    assert not [s for s in ("Join", "Aggregate", "Repartition", "Sort") if s in plan.split("MapInArrow")[0]]


def test_coreference_of_large_entities_is_whole_and_never_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("memspark.operators.link.CHUNK", 16)
    orders = "SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderdate, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice + 400000 END AS o_totalprice FROM '/root/testdata/sf0.001/orders.parquet'"
    assert same_as_sql(spark, tmp_path, "J12_coreference", {"orders": orders})
    plan = QUERIES["J12_coreference"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not [s for s in ("Join", "Aggregate", "Repartition", "Sort") if s in plan.split("MapInArrow")[0]]


def written_bytes(df, path):
    """Bytes of each row of a query's pairs as Parquet."""
    df.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / df.sparkSession.read.parquet(str(path)).count()


def test_pairs_of_large_entities_are_written_small(spark, tmp_path):
    """Pairs come in tiles, equal scores after each other: as Parquet these took 1.14 bytes each in the order of the blocks."""
    copies = "SELECT o.* REPLACE (o_orderkey + 10000 * i AS o_orderkey, o_custkey + 1000 * i AS o_custkey, '1-URGENT' AS o_orderpriority, 'F' AS o_orderstatus) FROM '/root/testdata/sf0.001/orders.parquet' o, range(20) r(i)"
    duckdb.execute(f"COPY ({copies}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    assert written_bytes(QUERIES["J12_coreference"](spark, str(tmp_path)), tmp_path / "out") < 0.9


def test_pairs_of_copies_are_written_small(spark, tmp_path):
    """Pairs of a set's copies come in tiles: in the order of the sets their ids took 0.76 bytes of a pair as Parquet."""
    duckdb.execute(f"COPY ({COPIES.format(n=120)}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    assert written_bytes(QUERIES["V03_V09_echo_and_pairs"](spark, str(tmp_path)).select("a", "b", "common"), tmp_path / "out") < 0.55


def test_scope_pairs_are_whole_and_written_small(spark, tmp_path, monkeypatch):
    """Blocks of customers meet blocks of suppliers: as Parquet, customer by customer, these pairs took 1.23 bytes each."""
    customers = "SELECT CASE WHEN i % 99 > 0 THEN i % 1900 END AS c_custkey, CASE WHEN i % 50 > 0 THEN i % 2 END::int AS c_nationkey, CASE i % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'S' || i % 3 END AS c_mktsegment FROM range(2000) r(i)"
    suppliers = "SELECT CASE WHEN i % 90 > 0 THEN i * 7919 % 1999 END AS s_suppkey, CASE WHEN i % 40 > 0 THEN i % 3 END::int AS s_nationkey FROM range(1{n}) r(i)"
    monkeypatch.setattr("memspark.operators.link.BLOCK", 64)
    assert same_as_sql(spark, tmp_path, "F35_covered_by", {"customer": customers, "supplier": suppliers.format(n="00")})
    monkeypatch.undo()
    duckdb.execute(f"COPY ({suppliers.format(n='600')}) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    assert written_bytes(QUERIES["F35_covered_by"](spark, str(tmp_path)), tmp_path / "out") < 0.6


def test_rounded_is_that_of_the_sql(spark):
    import math

    from memspark.functions import text as t

    xs = [0.5, -0.5, 2.5, 3.5, -3.5, 0.125, 0.375, -0.375, 450000.12345675, 1e308, 7.0, 0.49999999999999994]
    df = spark.createDataFrame([(x,) for x in [*xs, float("nan"), float("inf"), None]], "x double")
    got = df.select(t.rounded(df.x, 0), t.rounded(df.x, 2), t.rounded(df.x, 7)).collect()
    want = duckdb.execute(f"SELECT round(x, 0), round(x, 2), round(x, 7) FROM (SELECT unnest({xs}::double[]) AS x)").fetchall()
    assert [tuple(r) for r in got[: len(xs)]] == want
    assert math.isnan(got[-3][0]) and got[-2][0] == float("inf") and got[-1][0] is None


def test_conflict_plan_of_many_clusters_streams(spark, tmp_path):
    orders = "SELECT o.* REPLACE (o_orderkey + 1000000 * i AS o_orderkey, o_custkey + 100000 * (i % 3) AS o_custkey) FROM '/root/testdata/sf0.001/orders.parquet' o, range(9) r(i)"
    got = same_as_sql(spark, tmp_path, "V11_conflict_plan", {"orders": orders})
    plan = QUERIES["V11_conflict_plan"](spark, str(tmp_path))
    assert plan.groupBy().count().first()[0] == len(got) > 0
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().optimizedPlan().toString()


ODD_DOCUMENTS = """SELECT * FROM (VALUES (1, 'b aa b 中中 x9y', 'en', 's', 10), (1, 'aa zz zz', 'en', 's', 8), (1, 'aa zz zz', 'en', 's', 8), (NULL, 'aa Aa bcd', 'de', 's', 9),
(NULL, 'bcd q', NULL, 's', 5), (2, NULL, 'en', NULL, 0), (3, '', 'en', 's', 0), (4, '?!', 'en', 's', 2), (5, 'ééé one', 'fr', 's', 7)) v(doc_id, text, lang, source, n_chars)"""
NO_LABELS = "SELECT 9 AS doc_id, 0 AS quality, 0 AS toxic"


@pytest.mark.parametrize("name", ["V15_index_tables", "S28_index_tables", "S24_entity_links"])
def test_index_tables_of_rows_that_share_an_id(spark, tmp_path, name):
    """Rows of one id are one unit for postings and links; a row of its own for lengths."""
    assert same_as_sql(spark, tmp_path, name, {"documents": ODD_DOCUMENTS, "labels": NO_LABELS})


def test_index_tables_shuffle_no_terms(spark):
    def shuffled(df):
        return [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x and ("term" in x or "unit_id" in x)]

    from memspark.operators import ingest
    from memspark.sources.tables import units

    tables = ingest.index_tables(units(spark, "/root/testdata/sf0.001"))
    assert not shuffled(tables["fulltext"]) and not shuffled(tables["entity"]) and not shuffled(QUERIES["S28_index_tables"](spark, "/root/testdata/sf0.001"))
    got = tables["fulltext"].groupBy("unit_id").sum("tf").count()
    assert got == tables["vector"].count() > 0


def test_expansion_breaks_ties_of_sums_by_id(spark, tmp_path):
    """240 units have entities of the same counts, each others, so that their sums differ by no more than the order of adding."""
    sizes = (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 16, 20)
    words = " || ' ' || ".join(f"'e{n}x' || i % {n}" for n in sizes)
    every = " ".join(f"e{n}x{k}" for n in sizes for k in range(n))
    documents = f"SELECT i AS doc_id, {words} AS text, 'en' AS lang, 's' AS source, 9::bigint AS n_chars FROM range(240) r(i) UNION ALL SELECT 1000 + i, 'the the ing {every}', 'en', 's', 9 FROM range(10) r(i)"
    got = same_as_sql(spark, tmp_path, "A09_J06_entity_expansion", {"documents": documents, "labels": NO_LABELS})
    assert len(got) == 20
